"""Webhook documents: JSON files, message bodies and the audit table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from buildlens import schemas

CORRUPT = "_corrupt_record"
# A log is one JSON string and may be of any length.
JSON_OPTIONS = {"maxStringLen": str(2**31 - 1)}


def read_webhooks(spark: SparkSession, path: str, multi_line: bool = True,
                  extension_field: str = "_extended", stream: bool = False) -> DataFrame:
    """GitHub, GitLab and generic payloads in one superset schema.

    ``extension_field`` is the vendor key of the optional log extension.  It is
    renamed to ``_extended``.  Documents that do not parse carry their text in
    ``_corrupt_record``.
    """
    schema = schemas.webhook_schema(extension_field) + f", `{CORRUPT}` string"
    reader = (spark.readStream if stream else spark.read).schema(schema) \
        .option("multiLine", multi_line).option("columnNameOfCorruptRecord", CORRUPT).options(**JSON_OPTIONS)
    return reader.json(path).withColumnRenamed(extension_field, "_extended")


def is_object(body: Column) -> Column:
    """Body is one JSON object (arrays, scalars and broken texts are not); keys may repeat.

    The text is parsed as the only element of an array, so that nothing may follow it.
    """
    alone = F.from_json(F.concat(F.lit("["), body, F.lit("]")), "array<map<string,string>>", JSON_OPTIONS)
    return F.coalesce(F.startswith(F.ltrim(body), F.lit("{")) & (F.size(alone) == 1) & F.get(alone, F.lit(0)).isNotNull(), F.lit(False))


def parse_bodies(messages: DataFrame, body: str = "body", extension_field: str = "_extended") -> DataFrame:
    """Expand message bodies into payload columns next to the other columns."""
    payload = F.from_json(F.col(body), schemas.webhook_schema(extension_field), JSON_OPTIONS)
    others = [c for c in messages.columns if c != body]
    return messages.select(*others, payload.alias("_p")).select(*others, "_p.*") \
        .withColumnRenamed(extension_field, "_extended")


def quarantine(messages: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """Messages whose body is a JSON object, and the dead letters."""
    flagged = messages.withColumn("_ok", is_object(F.col(body)))
    return (flagged.filter("_ok").drop("_ok"),
            flagged.filter("NOT _ok").drop("_ok").withColumn("reason", F.lit("not a JSON object")))


def raw_log_rows(messages: DataFrame, source: Column, payload: Column, signature_valid: Column,
                 received_at: Column) -> DataFrame:
    """Audit rows; rows without source, payload or time are not stored."""
    return messages.select(
        *[c for c in ("delivery_id",) if c in messages.columns],
        source.alias("source"), payload.alias("payload"), signature_valid.alias("signature_valid"),
        received_at.alias("received_at"), F.lit(False).alias("processed"),
    ).filter("source IS NOT NULL AND payload IS NOT NULL AND received_at IS NOT NULL")


def write_raw_logs(rows: DataFrame, path: str) -> None:
    """Append audit rows, partitioned by day of arrival and source."""
    rows.withColumn("day", F.to_date("received_at")).hint("rebalance", F.col("day"), F.col("source")) \
        .write.mode("append").partitionBy("day", "source").parquet(path)


def assemble_log_files(files: DataFrame) -> DataFrame:
    """One log per run from its files: ``=== name ===`` headers, blank line between files.

    The pieces of one run become one text, so a run's log is bounded by the size
    of a string (2 GB); runs themselves spread over the cluster.
    """
    lines = F.when(F.coalesce(F.col("content"), F.lit("")) == "", F.lit(1)).otherwise(F.size(F.split("content", "\n", -1)))
    piece = F.struct("file_no", "file_name", "content", lines.alias("lines"))
    return (
        files.filter("content <> ''").groupBy("run_id").agg(F.sort_array(F.collect_list(piece)).alias("_f"))
        .select(
            "run_id",
            F.array_join(F.transform("_f", lambda f: F.concat(
                F.lit("=== "), f["file_name"], F.lit(" ===\n"), f["content"])), "\n\n").alias("raw_logs"),
            F.size("_f").alias("file_count"),
            F.aggregate("_f", F.lit(0), lambda a, f: a + f["lines"]).alias("total_lines"),
            F.transform("_f", lambda f: F.struct(f["file_name"].alias("name"), f["lines"].alias("lines"))).alias("files"),
        )
    )


def assemble_job_traces(traces: DataFrame) -> DataFrame:
    """Job traces of a pipeline in one text, each under a ``=== Job: name ===`` line."""
    piece = F.struct("file_no", "file_name", "content")
    return traces.filter("content <> ''").groupBy("run_id").agg(F.sort_array(F.collect_list(piece)).alias("_f")).select(
        "run_id",
        F.array_join(F.transform("_f", lambda f: F.concat(
            F.lit("\n=== Job: "), f["file_name"], F.lit(" ===\n"), f["content"])), "").alias("log_content"))

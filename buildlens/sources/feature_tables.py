"""Feature rows as CSV files, queue messages and metric tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from buildlens import schemas
from buildlens.functions import rules
from buildlens.operators.features import feature_vector
from buildlens.sources.webhooks import JSON_OPTIONS

_CSV_TYPES = {c: "double" for c in rules.FEATURE_NAMES}


def read_training_csv(spark: SparkSession, path: str) -> DataFrame:
    """Feature CSV with header; only ``label = 'normal'`` rows where a label exists.

    Only the header line is read ahead, no schema is inferred from the data.
    """
    header = spark.read.option("header", True).csv(path).columns
    schema = ", ".join(f"`{c}` {_CSV_TYPES.get(c, 'string')}" for c in header)
    rows = spark.read.schema(schema).option("header", True).csv(path)
    return rows.filter("label = 'normal'") if "label" in header else rows


def write_feature_csv(features: DataFrame, path: str) -> None:
    features.write.option("header", True).csv(path)


def feature_messages(features: DataFrame, request_id: Column, mongo_id: Column, processed_at: Column) -> DataFrame:
    """One JSON message per build: envelope, features, vector and names."""
    ids = [c for c in ("build_id", "repo_name", "branch", "commit_sha") if c in features.columns]
    message = F.struct(
        F.struct(request_id.alias("request_id"), mongo_id.alias("mongo_id"), F.lit("log-parser").alias("source"),
                 processed_at.alias("processed_at")).alias("_meta"),
        F.struct(*ids, *rules.FEATURE_NAMES).alias("features"),
        feature_vector().alias("feature_vector"),
        F.array(*[F.lit(c) for c in rules.FEATURE_NAMES]).alias("feature_names"),
    )
    return features.select(F.col("build_id").alias("key"), F.to_json(message).alias("value"))


def message_schema() -> T.StructType:
    return T.StructType([
        T.StructField("_meta", T.StructType([
            T.StructField(c, T.StringType()) for c in ("request_id", "mongo_id", "source", "processed_at")])),
        T.StructField("features", schemas.FEATURES),
        T.StructField("feature_vector", T.ArrayType(T.DoubleType())),
        T.StructField("feature_names", T.ArrayType(T.StringType())),
    ])


def decode_feature_messages(messages: DataFrame, value: str = "value") -> DataFrame:
    """Feature columns of the messages; ``build_id`` falls back to the request id."""
    others = [c for c in messages.columns if c != value]
    build_id = F.coalesce(F.col("_m.features.build_id"), F.col("_m._meta.request_id"), F.lit("unknown"))
    return messages.select(*others, F.from_json(F.col(value), message_schema(), JSON_OPTIONS).alias("_m")).select(
        *others, build_id.alias("build_id"), F.col("_m._meta.request_id").alias("request_id"),
        F.try_to_timestamp(F.col("_m._meta.processed_at")).alias("message_time"),
        *[F.col(f"_m.features.{c}").alias(c) for c in rules.FEATURE_NAMES])


def build_metric_rows(features: DataFrame, created_at: Column) -> DataFrame:
    """Metric rows with the template and security counts as one JSON text."""
    distribution = F.struct(
        F.col("unique_templates"), F.col("template_entropy"),
        F.col("suspicious_pattern_count").alias("suspicious_patterns"),
        F.col("external_ip_count").alias("external_ips"),
        F.col("external_url_count").alias("external_urls"),
    )
    ids = [F.col(c) if c in features.columns else F.lit(None).cast("string").alias(c)
           for c in ("build_id", "repo_name", "branch", "commit_sha")]
    return features.select(
        *ids, "duration_seconds", "log_line_count", "char_density", "error_count", "warning_count",
        F.to_json(distribution).alias("event_distribution"), created_at.alias("created_at"))


def result_rows(results: DataFrame, created_at: Column) -> DataFrame:
    """Result rows with reasons and contributions as JSON; version ``unknown`` when missing.

    ``id`` is a hash of the row's content and message, so a batch that runs again gives the
    same ids if ``created_at`` is a time of the message or the batch, not of the run.
    """
    version = F.col("model_version") if "model_version" in results.columns else F.lit(None).cast("string")
    raw = F.to_json(F.struct(*[c for c in rules.FEATURE_NAMES if c in results.columns]))
    request = [F.col("request_id")] if "request_id" in results.columns else []
    key = F.xxhash64("build_id", "anomaly_score", "prediction", version, raw, created_at.cast("string"), *request)
    return results.select(
        F.pmod(key, F.lit(2**63 - 1)).alias("id"), "build_id", "is_anomaly", "anomaly_score", "prediction", "confidence",
        F.to_json("anomaly_reasons").alias("anomaly_reasons"),
        F.to_json("top_features").alias("top_features"),
        F.coalesce(version, F.lit("unknown")).alias("model_version"),
        raw.alias("raw_features"), created_at.alias("created_at"))

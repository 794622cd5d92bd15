"""Structured Streaming jobs: payloads to features, features to explained results.

Checkpoints take the place of acknowledgements: a batch that fails is run again,
and the sinks are keyed by batch so that a repeated batch replaces its rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from buildlens.operators.features import build_features_12, with_log_text
from buildlens.operators.forest import Model, predict
from buildlens.operators.mining import (
    assign_templates, latest_dictionary, masked_lines, parsed_logs, simple_lines, unmatched_sequences)
from buildlens.operators.normalize import normalize_build
from buildlens.operators.serving import bucketed, partial_states
from buildlens.sources import feature_tables as T
from buildlens.sources.storage import materialize, spread
from buildlens.sources.webhooks import parse_bodies, quarantine


def read_messages(spark: SparkSession, path: str, schema: str, files_per_batch: int | None = None) -> DataFrame:
    """Messages appended as parquet files to a folder, in batches of some files."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def _write(df: DataFrame, path: str, batch: int) -> None:
    """Write one batch under its number: a batch that runs again replaces itself."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def _start(stream: DataFrame, handle, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="5 seconds")).start()


def _open_table(spark: SparkSession, path: str, schema: str) -> None:
    """An empty first partition, so that a table can be read before anything is in it."""
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{path}/batch=-1")


def first_deliveries(batch: DataFrame, out: str, number: int, key: str = "delivery_id", time: str = "received_at") -> DataFrame:
    """Messages of a batch that no earlier batch had, each once; messages without a key are all kept.

    The broker may deliver a message again at any later time, so the ids of finished batches
    are kept by day of arrival and only the days of the batch are read.  (A watermark would
    forget old ids, and drop late messages.)  A batch that runs again does not see its own ids.
    """
    spark = batch.sparkSession
    day = F.coalesce(F.to_date(time), F.to_date(F.lit("1970-01-01")))
    first, last = batch.agg(F.min(day), F.max(day)).first()
    if first is None:
        return batch
    seen = spark.read.schema(f"{key} string, batch int, day date").parquet(f"{out}/seen") \
        .filter((F.col("batch") < number) & F.col("day").between(F.lit(first), F.lit(last))).select(F.col(key).alias("_id")).distinct()
    once = batch.filter(F.col(key).isNotNull()).dropDuplicates([key])
    return once.join(seen, F.col(key).cast("string") == F.col("_id"), "left_anti").unionByName(batch.filter(F.col(key).isNull()))


def _remember(batch: DataFrame, out: str, number: int, key: str = "delivery_id", time: str = "received_at") -> None:
    """Written last: until then the batch counts as not delivered."""
    day = F.coalesce(F.to_date(time), F.to_date(F.lit("1970-01-01")))
    batch.filter(F.col(key).isNotNull()).select(F.col(key).cast("string").alias(key), day.alias("day")).distinct() \
        .write.mode("overwrite").partitionBy("day").parquet(f"{out}/seen/batch={number}")


def feature_batches(spark: SparkSession, out: str, body: str = "body", duration_mode: str = "strict",
                    dictionary: str | None = None, once: bool = False) -> Callable[[DataFrame, int], None]:
    """What happens to one numbered batch of payload messages (``delivery_id, received_at, body``).

    With ``once`` a message delivered again, in the same batch or any later one, counts once;
    otherwise every delivery has its row.
    With a ``dictionary`` folder (``mining.save_dictionary``) its newest version is read for
    every batch and gives lines their mined templates; sequences that it does not hold stand
    for themselves and are put aside in ``unmatched`` for the next mining run.
    """
    if once:
        spark.createDataFrame([], "delivery_id string").write.mode("ignore").parquet(f"{out}/seen/batch=-1/day=1970-01-01")

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        # A queue may hold few files: its messages are dealt out, as parsing them costs far more than moving them.
        batch = spread(first_deliveries(batch, out, number) if once else batch).persist()
        builds = timed = None
        try:
            good, bad = quarantine(batch, body)
            _write(bad, f"{out}/dead_letters", number)
            builds = normalize_build(parse_bodies(good, body), duration_mode).persist()  # parsed once for all that follows
            timed = build_features_12(builds).persist()
            _write(T.build_metric_rows(timed, F.col("received_at")), f"{out}/build_metrics", number)
            request = F.concat(F.lit("delivery-"), F.col("delivery_id"))
            _write(T.feature_messages(timed, request, F.col("delivery_id").cast("string"),
                                      F.date_format("received_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")),
                   f"{out}/messages", number)
            texts = with_log_text(builds)
            if dictionary is None:
                lines = simple_lines(texts, "line_text", "delivery_id")
            else:
                known = latest_dictionary(spark, dictionary)
                masked = masked_lines(texts, "line_text", "delivery_id")
                _write(unmatched_sequences(masked, known), f"{out}/unmatched", number)
                lines = assign_templates(masked, known)
            _write(parsed_logs(lines, "delivery_id"), f"{out}/parsed_logs", number)
            if once:
                _remember(batch, out, number)
        finally:
            for held in (timed, builds, batch):
                if held is not None:
                    held.unpersist()

    return handle


def stream_features(messages: DataFrame, out: str, available_now: bool = True, body: str = "body",
                    duration_mode: str = "strict", dictionary: str | None = None, once: bool = False) -> StreamingQuery:
    """Messages (``delivery_id, received_at, body``) to metric rows, parsed logs, feature
    messages and dead letters; with ``once`` a message delivered again, in any batch, counts once."""
    handle = feature_batches(messages.sparkSession, out, body, duration_mode, dictionary, once)
    return _start(messages, handle, f"{out}/_checkpoint", available_now)


def drain(messages: DataFrame, handle: Callable[[DataFrame, int], None], out: str, limit: int, key: str = "delivery_id",
          time: str = "received_at") -> tuple[int, int]:
    """Handle the next ``limit`` pending messages of a queue, oldest first, and stop: ``(handled, still pending)``.

    A message is acknowledged when its batch is through; a run that fails before takes the
    same messages again under the same number.  Counted in messages, not files.  Messages
    need a key; one delivered again before or after is the same message.
    """
    spark = messages.sparkSession
    _open_table(spark, f"{out}/acknowledged", "id string")
    acknowledged = spark.read.schema("id string, batch int").parquet(f"{out}/acknowledged")
    number = acknowledged.agg(F.max("batch")).first()[0]
    number = 0 if number is None else number + 1
    pending = messages.filter(F.col(key).isNotNull()).join(
        acknowledged.select("id").distinct(), F.col(key).cast("string") == F.col("id"), "left_anti").dropDuplicates([key])
    # Times and keys alone are put in order, in ranges; only the range with the last message to take is cut.
    places = materialize(pending.select(time, key).repartitionByRange(time, key).withColumn("_range", F.spark_partition_id()), "pending")
    waiting, chosen = 0, places.filter("false")
    for part, size in sorted(places.groupBy("_range").count().collect()):
        if waiting < limit:
            own = places.filter(F.col("_range") == part)
            chosen = places.filter(F.col("_range") < part).unionByName(own if waiting + size <= limit else own.orderBy(time, key).limit(limit - waiting))
        waiting += size
    batch = materialize(pending.join(chosen.select(key), key, "left_semi"), "drained")
    taken = batch.count()
    if taken:
        handle(batch, number)
        batch.select(F.col(key).cast("string").alias("id")).write.mode("overwrite").parquet(f"{out}/acknowledged/batch={number}")
    return taken, waiting - taken


def _batch_time(spark: SparkSession, out: str, number: int) -> Column:
    """Time of a batch, noted when it first runs, so that a second run has the same."""
    path = f"{out}/batch_times/batch={number}"
    spark.range(1).select(F.current_timestamp().alias("time")).write.mode("ignore").parquet(path)
    return F.lit(spark.read.schema("time timestamp").parquet(path).first()["time"])


def stream_scoring(messages: DataFrame, model: Model, out: str, available_now: bool = True,
                   value: str = "value") -> StreamingQuery:
    """Feature messages to explained results.

    A result's time is its message's; one without time has that of its batch's first run.
    So a batch that runs again gives the same rows and ids.
    """

    def handle(batch: DataFrame, number: int) -> None:
        good, bad = quarantine(batch, value)
        _write(bad, f"{out}/dead_letters", number)
        scored = predict(T.decode_feature_messages(good, value), model)
        time = F.coalesce(F.col("message_time"), _batch_time(batch.sparkSession, out, number))
        _write(T.result_rows(scored, time), f"{out}/results", number)

    return _start(messages, handle, f"{out}/_checkpoint", available_now)


def stream_quarantine(messages: DataFrame, out: str, body: str = "body", available_now: bool = True) -> StreamingQuery:
    """Split a stream into usable messages and dead letters."""

    def handle(batch: DataFrame, number: int) -> None:
        good, bad = quarantine(batch, body)
        _write(good, f"{out}/good", number)
        _write(bad, f"{out}/dead_letters", number)

    return _start(messages, handle, f"{out}/_checkpoint", available_now)


def stream_counters(results: DataFrame, out: str, available_now: bool = True) -> StreamingQuery:
    """Copy results, batch by batch, to ``out/results``."""

    def handle(batch: DataFrame, number: int) -> None:
        _write(batch, f"{out}/results", number)

    return _start(results, handle, f"{out}/_checkpoint", available_now)


def counter_rows(spark: SparkSession, out: str, queue: DataFrame | None = None) -> DataFrame:
    """``batch, processed_total, anomalies_detected`` of all batches so far; with the ``queue`` also
    ``backlog``, the messages in it that no batch has handled.

    The stored results are counted, so nothing is lost when the query's progress
    history is trimmed or the query is started again.
    """
    counts = spark.read.parquet(f"{out}/results").groupBy("batch").agg(
        F.count(F.lit(1)).alias("processed_total"), F.count_if("is_anomaly").alias("anomalies_detected"))
    if queue is None:
        return counts
    done = counts.agg(F.coalesce(F.sum("processed_total"), F.lit(0))).first()[0]
    return counts.withColumn("backlog", F.lit(queue.count() - done).cast("long"))


def stream_timeseries(results: DataFrame, interval: str, out: str, closed_only: bool = False,
                      delay: str = "1 hour", available_now: bool = True, digits: int = 6) -> StreamingQuery:
    """Keep the buckets of the time series and of the statistics.

    ``closed_only`` appends each bucket once, when the watermark has passed it; otherwise a
    batch adds the partial states of its own buckets to ``out/states``, and
    ``serving.merged_series`` and ``serving.merged_stats`` add them up.  So a batch writes
    what it changes, late rows count like others, and a reader never meets a missing table.
    """
    timed = results.withColumn("created_at", F.col("created_at").cast("timestamp"))
    if closed_only:
        series = bucketed(timed.withWatermark("created_at", delay), interval, digits)
        writer = series.writeStream.outputMode("append").format("parquet").option("path", f"{out}/series")
        writer = writer.option("checkpointLocation", f"{out}/_checkpoint")
        return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")).start()

    def add(batch: DataFrame, number: int) -> None:
        _write(partial_states(batch, interval), f"{out}/states", number)

    return _start(timed, add, f"{out}/_checkpoint", available_now)

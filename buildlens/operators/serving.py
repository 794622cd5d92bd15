"""Questions asked of the stored results, metrics and audit rows.

Every "now" is a parameter (``as_of``), so a query gives the same answer on a
rerun and the time bound reaches the scan as a plain comparison.
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from buildlens.functions.numbers import round_to
from buildlens.functions import rules
from buildlens.sources.storage import materialize

RESULT_COLUMNS = ["id", "build_id", "created_at", "is_anomaly", "anomaly_score", "prediction",
                  "confidence", "anomaly_reasons", "model_version"]


def latest(df: DataFrame, time_column: str = "created_at") -> dt.datetime | None:
    """Newest time of a table (one partial maximum per task)."""
    return df.agg(F.max(time_column)).first()[0]


def since(df: DataFrame, hours: float, as_of: dt.datetime, time_column: str = "created_at") -> DataFrame:
    """Rows of the last hours, bound excluded."""
    return df.filter(F.col(time_column) > F.lit(as_of - dt.timedelta(hours=hours)).cast(df.schema[time_column].dataType))


def results_page(results: DataFrame, limit: int = 100, anomalies_only: bool = False,
                 start: dt.datetime | None = None, end: dt.datetime | None = None) -> DataFrame:
    """Newest results first; both time bounds are inclusive."""
    kind = results.schema["created_at"].dataType
    if anomalies_only:
        results = results.filter("is_anomaly")
    if start is not None:
        results = results.filter(F.col("created_at") >= F.lit(start).cast(kind))
    if end is not None:
        results = results.filter(F.col("created_at") <= F.lit(end).cast(kind))
    columns = [c for c in RESULT_COLUMNS if c in results.columns]
    return results.select(*columns).orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def latest_result_by_build(results: DataFrame) -> DataFrame:
    """Newest result of every build.

    A maximum over a struct is combined before the shuffle, so a build with very
    many results sends one row per task.
    """
    rest = [c for c in results.columns if c not in ("build_id", "created_at", "id")]
    row = F.struct("created_at", "id", *rest)
    return results.groupBy("build_id").agg(F.max_by(row, F.struct("created_at", "id")).alias("_r")).select("build_id", "_r.*")


def anomaly_stats(results: DataFrame, hours: int, as_of: dt.datetime, digits: int = 6) -> DataFrame:
    """Totals, rate and score range of the period; empty periods give zeros."""
    def zero(col: Column) -> Column:
        return F.coalesce(round_to(col, digits), F.lit(0.0))

    return since(results, hours, as_of).agg(
        F.count(F.lit(1)).alias("total_builds"),
        F.count_if("is_anomaly").alias("total_anomalies"),
        zero(F.avg("anomaly_score")).alias("avg_score"),
        zero(F.min("anomaly_score")).alias("min_score"),
        zero(F.max("anomaly_score")).alias("max_score"),
        zero(F.avg("confidence")).alias("avg_confidence"),
    ).withColumn("anomaly_rate", F.coalesce(round_to(F.try_divide("total_anomalies", "total_builds"), digits), F.lit(0.0))) \
        .withColumn("period_hours", F.lit(hours))


def partial_states(results: DataFrame, grain: str = "1 hour") -> DataFrame:
    """``bucket`` and mergeable states: counts, sums and extremes that add up to any statistic over whole buckets."""
    return results.groupBy(time_bucket(grain, F.col("created_at")).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_anomaly").alias("anomalies"),
        F.count("anomaly_score").alias("scores"), F.sum("anomaly_score").alias("score_sum"),
        F.min("anomaly_score").alias("score_min"), F.max("anomaly_score").alias("score_max"),
        F.count("confidence").alias("confidences"), F.sum("confidence").alias("confidence_sum"))


def merged_series(states: DataFrame, interval: str, digits: int = 6) -> DataFrame:
    """The time series of ``bucketed`` from partial states whose buckets lie within its own."""
    mean = F.coalesce(round_to(F.try_divide(F.sum("score_sum"), F.sum("scores")), digits), F.lit(0.0))
    return states.groupBy(time_bucket(interval, F.col("bucket")).alias("time")).agg(
        F.sum("n").alias("total_builds"), F.sum("anomalies").alias("anomalies"), mean.alias("avg_score"))


def merged_stats(states: DataFrame, results: DataFrame, hours: int, as_of: dt.datetime, digits: int = 6, grain_hours: int = 1) -> DataFrame:
    """``anomaly_stats`` from hourly states; results themselves are read only for the bucket that the period begins in."""
    start = as_of - dt.timedelta(hours=hours)
    first = start.replace(minute=0, second=0, microsecond=0) + dt.timedelta(hours=grain_hours)
    edge = results.filter(F.col("created_at") < F.lit(first).cast(results.schema["created_at"].dataType))
    edge = partial_states(since(edge, hours, as_of)).withColumn("bucket", F.col("bucket").cast(states.schema["bucket"].dataType))
    parts = states.filter(F.col("bucket") >= F.lit(first).cast(states.schema["bucket"].dataType)).select(*edge.columns).unionByName(edge)

    def zero(col: Column) -> Column:
        return F.coalesce(round_to(col, digits), F.lit(0.0))

    n, anomalies = F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("anomalies"), F.lit(0))
    return parts.agg(
        n.alias("total_builds"), anomalies.alias("total_anomalies"),
        zero(F.try_divide(F.sum("score_sum"), F.sum("scores"))).alias("avg_score"),
        zero(F.min("score_min")).alias("min_score"), zero(F.max("score_max")).alias("max_score"),
        zero(F.try_divide(F.sum("confidence_sum"), F.sum("confidences"))).alias("avg_confidence"),
    ).withColumn("anomaly_rate", F.coalesce(round_to(F.try_divide("total_anomalies", "total_builds"), digits), F.lit(0.0))) \
        .withColumn("period_hours", F.lit(hours))


_UNIT_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}
_ORIGIN_DAY = 10959  # 2000-01-03, the Monday that buckets of days and weeks count from


def _bucket(interval: str, time: Column) -> tuple[Column, bool]:
    """Grouping column of an interval, and whether it is a window (whose start is the bucket)."""
    match = re.fullmatch(r"\s*(\d+)\s+(second|minute|hour|day|week|month|year)s?\s*", interval.lower())
    if not match:
        raise ValueError(f"unsupported interval: {interval!r}")
    n, unit = int(match[1]), match[2]
    if unit in ("month", "year"):
        n *= 12 if unit == "year" else 1
        months = (F.year(time) - 2000) * 12 + F.month(time) - 1
        return F.add_months(F.lit(dt.date(2000, 1, 1)), (F.floor(months / n) * n).cast("int")).cast("timestamp_ntz"), False
    seconds = n * _UNIT_SECONDS[unit]
    offset = _ORIGIN_DAY * 86400 % seconds
    return F.window(time, f"{seconds} seconds", None, f"{offset} seconds"), True


def time_bucket(interval: str, time: Column) -> Column:
    """Start of the bucket of a time, e.g. ``1 hour``, ``15 minutes``, ``2 weeks``, ``1 month``."""
    key, is_window = _bucket(interval, time)
    return key["start"] if is_window else key


def anomaly_timeseries(results: DataFrame, interval: str, hours: int, as_of: dt.datetime, digits: int = 6) -> DataFrame:
    """Builds, anomalies and mean score per bucket, oldest first; empty buckets are not filled."""
    return bucketed(since(results, hours, as_of), interval, digits).orderBy("time")


def bucketed(results: DataFrame, interval: str, digits: int = 6) -> DataFrame:
    # Grouped by the window itself, which keeps the watermark of a stream.
    key, is_window = _bucket(interval, F.col("created_at"))
    return results.groupBy(key.alias("_bucket")).agg(
        F.count(F.lit(1)).alias("total_builds"),
        F.count_if("is_anomaly").alias("anomalies"),
        F.coalesce(round_to(F.avg("anomaly_score"), digits), F.lit(0.0)).alias("avg_score"),
    ).select((F.col("_bucket.start") if is_window else F.col("_bucket")).alias("time"), "total_builds", "anomalies", "avg_score")


def normal_vs_anomaly_series(series: DataFrame) -> DataFrame:
    return series.withColumn("normal_builds", F.col("total_builds") - F.col("anomalies"))


def score_band(score: Column) -> Column:
    return (F.when(score < -0.1, "Strong deviation from normal behavior")
            .when(score < 0, "Slight deviation detected")
            .otherwise("Within normal parameters"))


def rate_percent(stats: DataFrame) -> DataFrame:
    """Rate in percent with one decimal."""
    return stats.withColumn("anomaly_rate_pct", round_to(F.col("anomaly_rate") * 100, 1))


def radar_features(results: DataFrame, names: list[str] = rules.FEATURE_NAMES) -> DataFrame:
    """First six numeric features of a result, capped at 100, one row each."""
    entries = F.array(*[F.struct(F.lit(n.replace("_", " ")).alias("feature"), F.col(n).cast("double").alias("v")) for n in names])
    numeric = F.slice(F.filter(entries, lambda e: e["v"].isNotNull()), 1, 6)
    return results.select("build_id", F.posexplode(numeric).alias("axis", "e")).select(
        "build_id", "axis", F.col("e.feature").alias("feature"),
        F.least(F.col("e.v"), F.lit(100.0)).alias("value"), F.lit(100).alias("full_mark"))


def z_bar(z_score: Column) -> Column:
    """Bar width in percent of a contribution."""
    return F.least(z_score * 20, F.lit(100.0))


# ----------------------------------------------------------------- audit

def audit_stats(raw_logs: DataFrame) -> DataFrame:
    return raw_logs.agg(F.count(F.lit(1)).alias("total"), F.count_if("processed").alias("processed")) \
        .withColumn("pending", F.col("total") - F.col("processed"))


def recent_raw_logs(raw_logs: DataFrame, limit: int = 10, tie: str = "delivery_id") -> DataFrame:
    return raw_logs.orderBy(F.desc("received_at"), F.desc(tie)).limit(limit)


# ----------------------------------------------------------------- joins

def recent_builds_status(metrics: DataFrame, results: DataFrame) -> DataFrame:
    """Builds with their results, newest build first; a build has one row per result.

    A left join cannot split a build with very many results over several tasks.
    So builds with results come from an inner join, which adaptive execution
    splits, and the others from an anti join with the distinct build ids.
    """
    right = results.select("build_id", "is_anomaly", "anomaly_score",
                           *[c for c in ("anomaly_reasons",) if c in results.columns])
    with_results = metrics.join(right, "build_id")
    without = metrics.join(results.select("build_id").distinct(), "build_id", "left_anti")
    return with_results.unionByName(without, allowMissingColumns=True).orderBy(F.desc("created_at"))


def mark_processed(raw_logs: DataFrame, parsed: DataFrame, processed_at: Column, key: str = "delivery_id") -> DataFrame:
    """Audit rows with ``processed`` set for every id that was parsed."""
    done = parsed.select(key).distinct().withColumn("_done", F.lit(True))
    joined = raw_logs.join(done, key, "left")
    hit = F.coalesce(F.col("_done"), F.lit(False))
    before = F.col("processed_at") if "processed_at" in raw_logs.columns else F.lit(None).cast("timestamp_ntz")
    return joined.withColumn("processed_at", F.when(hit, processed_at).otherwise(before)) \
        .withColumn("processed", F.col("processed") | hit).drop("_done")


def mark_processed_table(spark: SparkSession, path: str, parsed: DataFrame, processed_at: Column, key: str = "delivery_id") -> None:
    """``mark_processed`` on a stored audit table: only partitions with a row to mark are written again.

    With ``received_at`` in ``parsed`` only the days of these rows are read.  The new rows
    are written aside first, then they replace their partitions.
    """
    table = spark.read.parquet(path)
    if "processed_at" not in table.columns:
        table = table.withColumn("processed_at", F.lit(None).cast("timestamp_ntz"))
    if "received_at" in parsed.columns:
        days = parsed.select(F.to_date("received_at").alias("day")).distinct()
        looked = table.join(F.broadcast(days), "day", "left_semi")  # a row per day
    else:
        looked = table
    hit = looked.filter("NOT processed").join(parsed.select(key).distinct(), key, "left_semi").select("day", "source").distinct()
    hit = materialize(hit, "marked-partitions")
    marked = mark_processed(table.join(F.broadcast(hit), ["day", "source"], "left_semi"), parsed, processed_at, key)  # a row per partition
    materialize(marked.select(*table.columns), "marked-rows").hint("rebalance", F.col("day"), F.col("source")) \
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "source").parquet(path)


def trusted_suffix_join(domains: DataFrame, trusted: DataFrame) -> DataFrame:
    """Domains that end with no trusted suffix.

    Not a cross join: a domain is expanded to its endings of the lengths that
    occur among the suffixes (a few dozen), and the endings are matched by
    equality.  Distinct domains only, so frequent domains cost nothing extra.
    """
    lengths = [r[0] for r in trusted.select(F.length("suffix")).distinct().collect()]
    distinct = domains.select("domain").distinct()
    endings = distinct.select("domain", F.explode(F.array(*[
        F.when(F.length("domain") >= n, F.right(F.col("domain"), F.lit(n))) for n in sorted(lengths)])).alias("suffix"))
    known = endings.join(trusted.select("suffix").distinct(), "suffix", "left_semi").select("domain").distinct()
    return domains.join(known, "domain", "left_anti")


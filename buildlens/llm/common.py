"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows per Arrow batch: bounds a Python worker's memory when texts are long.
BATCH_ROWS = 1000


def arrow_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keep the Arrow batches of Python operators small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; NULL for a NULL id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(modulus))


def held_out(id_col: str, modulus: int, rest: int) -> Column:
    """Whether a row's label may not be learned from; rows without id have no such label."""
    return F.coalesce(remainder(id_col, modulus) == rest, F.lit(False))


#: Distinct groups that a sample may have (languages, labels): their counts go through the driver.
MAX_GROUPS = 10_000


def bounded_sample(df: DataFrame, group: str, per_group: int, keys: list[str]) -> DataFrame:
    """At most ``per_group`` rows of each group, those with the smallest hashes of ``keys``.

    The share of hashes that leaves about twice the bound follows from the groups' counts
    and is filtered while scanning, so what is ranked is small however large a group is.
    Copies share a hash; the row limit is applied per task before the shuffle.
    """
    counts = df.groupBy(group).agg(F.count("*")).limit(MAX_GROUPS + 1).collect()
    if len(counts) > MAX_GROUPS:
        raise ValueError(f"{group} has more than {MAX_GROUPS} values")
    spot = F.pmod(F.xxhash64(*keys), F.lit(1 << 30)) / (1 << 30)
    share = [F.lit(x) for g, n in counts if g is not None for x in (g, (2.0 * per_group + 64) / n)]
    if not share:
        return df.limit(0)
    thin = df.withColumn("__u", spot).where(F.col("__u") < F.create_map(*share)[F.col(group)])
    order = Window.partitionBy(group).orderBy("__u", *keys)
    return thin.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= per_group).drop("__u", "__r")

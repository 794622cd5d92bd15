"""Blocks of vectors: what both vector searches share.

A search is a stated query set against all rows.  Both sides are cut into blocks of
bounded size, every pair of a query block and a vector block is one group, and a group
returns the best few of each of its queries; a last step keeps the best of all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from buildlens.sources.storage import materialize

#: Rows of a block of vectors, and of queries.
BLOCK = 4096
QUERY_BLOCK = 1024


def usable(vector: Column) -> Column:
    """Not NULL, not empty, every component finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite, F.lit(False))


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """``vector, ids``: each distinct vector with its k + 1 smallest ids, each as often as it has rows, up to k times.

    A result of k rows without the query's own id never needs more: one of the ids may be
    the query's, the other k have a row each at least.  So a hot vector costs one row.
    Rows are counted per id first, in partial aggregations; ids are thinned per task before
    the shuffle and the row limit works on partial groups.
    """
    first = Window.partitionBy("vector", "salt").orderBy("id")
    again = Window.partitionBy("vector").orderBy("id")
    counted = rows.groupBy("vector", "id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("n"))
    salted = counted.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    thin = salted.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1).drop("r", "salt")
    few = thin.withColumn("r", F.row_number().over(again)).where(F.col("r") <= k + 1)
    ids = F.transform(F.sort_array(F.collect_list(F.struct("id", "n"))), lambda m: F.array_repeat(m["id"], m["n"]))
    return few.groupBy("vector").agg(F.flatten(ids).alias("ids"))


def one_vector(rows: DataFrame) -> DataFrame:
    """``id, vector``: one row for each id; of several vectors the smallest, component by component."""
    return rows.groupBy("id").agg(F.min("vector").alias("vector"))


def numbered(rows: DataFrame, order: list[Column], size: int, name: str) -> tuple[DataFrame, int]:
    """Add column ``block``: consecutive runs of ``size`` rows in the given order; and their number.

    Rows are range-partitioned and sorted, ranks come from the partitions' sizes.
    """
    parted = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order)
                         .withColumn("part", F.spark_partition_id())
                         .withColumn("place", F.monotonically_increasing_id()), name)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    sizes = (parted.groupBy("part").agg(F.count("*").alias("n"), F.min("place").alias("first"))
             .select("part", "first", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    place = F.col("base") + F.col("place") - F.col("first")
    out = parted.join(F.broadcast(sizes), "part").withColumn("block", F.floor(place / size).cast("int"))  # one row per partition
    return out.drop("part", "place", "first", "n", "base"), -(-total // size)


def matrix(vectors: pd.Series, dtype: type = np.float64) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=dtype) for v in vectors]) if len(vectors) else np.empty((0, 0), dtype=dtype)


def blockwise(queries: DataFrame, n_query_blocks: int, vectors: DataFrame, n_blocks: int,
              search: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``search(query block, vector block)`` over all pairs of blocks.

    Column ``block`` numbers the blocks of both sides; a vector block is sent once per
    query block and the reverse, a group holds one of each.
    """
    left = queries.withColumn("vector_block", F.explode(F.sequence(F.lit(0), F.lit(max(n_blocks, 1) - 1)))).withColumnRenamed("block", "query_block")
    right = vectors.withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(max(n_query_blocks, 1) - 1)))).withColumnRenamed("block", "vector_block")
    keys = ["query_block", "vector_block"]

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return search(a, b) if len(a) and len(b) else pd.DataFrame()

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, schema)


def best(found: DataFrame, k: int) -> DataFrame:
    """The k best candidates of each query with ``rank`` from 1: highest score, ties to the smaller id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)


def top_members(query_ids: np.ndarray, scores: np.ndarray, ids: list[np.ndarray], k: int, lowest: float) -> Iterator[tuple]:
    """(query, id, score) of the k best rows of one group: distinct vectors' scores (queries x vectors,
    ``lowest`` where left out) spread over their ids, ties to the smaller id, never the query itself."""
    width = min(k + 1, scores.shape[1])
    for i, query in enumerate(query_ids):
        own = scores[i]
        cut = np.partition(own, -width)[-width]
        rows = [(own[j], m) for j in np.flatnonzero((own >= cut) & (own > lowest)) for m in ids[j][ids[j] != query][:k]]
        for score, member in sorted(rows, key=lambda r: (-r[0], r[1]))[:k]:
            yield query, member, score

"""Approximate nearest neighbours by a permutation index.

Every vector is represented by its ``PREFIX`` nearest pivots in order.  A block of the
index holds an inverted file per pivot: which vectors have it, and at which place.  A
query walks the files of its own pivots and accumulates the footrule distance, the sum
of differences of places (a missing pivot counts as place ``PREFIX``); the ``RERANK`` share
of each block with the smallest distances is ranked again by the exact cosine.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buildlens.llm import vectors as V
from buildlens.llm.common import arrow_batches
from buildlens.sources.storage import materialize

#: Pivots, drawn from the vectors with the smallest hashes: the only sample in the index.
PIVOTS = 128
#: Places of a permutation that are kept.
PREFIX = 64
#: Share of a block that is ranked again, and the least number.
RERANK = 0.25
RERANK_LEAST = 64


@dataclass
class Index:
    """Distinct vectors in blocks, each with ids and permutation, and the pivots."""

    blocks: DataFrame
    n_blocks: int
    pivots: np.ndarray
    prefix: int


def _even(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings the largest component near 1: cosines stay the same, bit by bit."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, without overflow of large components."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def permutations(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The nearest pivots of each row in order; ties to the smaller pivot."""
    return np.argsort(-(_unit(x) @ pivots.T), axis=1, kind="stable")[:, :prefix].astype(np.int16)


def _rows(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, vector`` of the rows that take part: usable, not all zero."""
    vector = F.transform(F.col(vector_col), lambda v: v.cast("double") + F.lit(0.0))
    return (df.select(F.col(id_col).cast("long").alias("id"), vector.alias("vector"))
            .where(F.col("id").isNotNull() & V.usable(F.col("vector")) & F.exists("vector", lambda v: v != 0)))


def build(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5,
          pivots: int = PIVOTS, prefix: int = PREFIX) -> Index:
    """Index every usable row of the table.

    Pivots have the length that most vectors have; vectors of another length have no
    permutation and are compared one by one with queries of that length.
    """
    spark = df.sparkSession
    arrow_batches(spark, 5000)
    distinct = materialize(V.distinct_vectors(_rows(df, id_col, vector_col), k), "index-vectors")
    common = distinct.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    usual = distinct.where(F.size("vector") == (common["dim"] if common else 0))
    drawn = (usual.orderBy(F.xxhash64("vector"), F.element_at("ids", 1)).limit(pivots).select("vector")).toPandas()
    chosen = _unit(V.matrix(drawn["vector"])) if len(drawn) else np.empty((0, 1))
    prefix = min(prefix, len(chosen))
    shared = spark.sparkContext.broadcast(chosen)  # PIVOTS vectors

    def permuted(batches):
        for batch in batches:
            if len(batch):
                order = np.zeros((len(batch), prefix), dtype=np.int16)
                usual = batch["vector"].map(len).to_numpy() == shared.value.shape[1]
                if usual.any():
                    order[usual] = permutations(V.matrix(batch["vector"][usual]), shared.value, prefix)
                yield batch.assign(permutation=list(order))

    schema = "vector array<double>, ids array<long>, permutation array<smallint>"
    blocks, n = V.numbered(distinct.mapInPandas(permuted, schema), [F.xxhash64("ids")], V.BLOCK, "index-blocks")
    return Index(blocks, n, chosen, prefix)


def footrule(queries: np.ndarray, own: np.ndarray, n_pivots: int) -> np.ndarray:
    """(queries, rows) footrule distances, by the inverted files of the rows' permutations.

    A pivot missing on one side counts as place ``prefix``; the distance is accumulated as
    the gain over no shared pivot at all, so only posted rows are touched.
    """
    n, prefix = own.shape
    pivot = own.ravel().astype(np.int64)
    order = np.argsort(pivot, kind="stable")
    row, place = (order // prefix), (order % prefix).astype(np.int32)
    file = np.searchsorted(pivot[order], np.arange(n_pivots + 1))
    nothing = prefix * (prefix + 1)  # both sums of prefix - place
    out = np.full((len(queries), n), nothing, dtype=np.int32)
    for i, permutation in enumerate(queries):
        for at, p in enumerate(permutation.tolist()):
            lo, hi = file[p], file[p + 1]
            j = place[lo:hi]
            out[i, row[lo:hi]] += np.abs(j - at) - (prefix - at) - (prefix - j)
    return out


def search(index: Index, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5,
           rerank: float = RERANK) -> DataFrame:
    """``query_id, rank, vec_id, score``: about the k nearest indexed rows of each query by cosine.

    The query's own id is no candidate.  NULL, zero and non-finite vectors take no part on
    either side; with fewer candidates all are returned; copies tie and go by id.
    A row that repeats is that many candidates; a query id with several vectors has the
    smallest of them.  Only vectors as long as the query's are candidates; components of
    any finite size are scaled first.  Empty tables give an empty result; other columns are
    ignored, whatever their names.
    """
    arrow_batches(queries.sparkSession, 5000)
    chosen, prefix = index.pivots, index.prefix
    shared = queries.sparkSession.sparkContext.broadcast(chosen)
    asked = V.one_vector(_rows(queries, id_col, vector_col))
    asked, n_asked = V.numbered(asked, [F.col("id")], V.QUERY_BLOCK, "index-queries")

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        parts = []
        own, sizes = a["vector"].map(len).to_numpy(), b["vector"].map(len).to_numpy()
        for dim in np.intersect1d(own, sizes):
            asked, rows = a[own == dim], b[sizes == dim]
            q, x = _even(V.matrix(asked["vector"])), _even(V.matrix(rows["vector"]))
            keep = len(rows)
            if dim == shared.value.shape[1]:
                distance = footrule(permutations(q, shared.value, prefix), V.matrix(rows["permutation"], np.int16), len(shared.value))
                keep = min(len(rows), max(RERANK_LEAST, int(np.ceil(rerank * len(rows)))))
                near = np.argpartition(distance, keep - 1, axis=1)[:, :keep]
            else:
                near = np.tile(np.arange(keep), (len(asked), 1))
            lq, lx = np.sqrt((q * q).sum(axis=1)), np.sqrt((x * x).sum(axis=1))
            out = np.full((len(asked), len(rows)), -np.inf)
            for i in range(len(asked)):
                out[i, near[i]] = x[near[i]] @ q[i] / (lx[near[i]] * lq[i])
            parts += V.top_members(asked["id"].to_numpy(), out, [np.asarray(m) for m in rows["ids"]], k, -np.inf)
        return pd.DataFrame(parts, columns=["query_id", "vec_id", "score"])

    found = V.blockwise(asked, n_asked, index.blocks, index.n_blocks, run, "query_id long, vec_id long, score double")
    return V.best(found, k).select("query_id", "rank", "vec_id", "score")

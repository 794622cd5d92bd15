"""Exact top-k inner products over vectors in descending order of length.

Integer vectors are sorted by length into blocks.  The longest block is searched first
and gives every query a lower bound of its k-th score.  A query block needs only blocks
whose largest length reaches the smallest quotient of bound and length of its queries;
as lengths fall, these are the first blocks, and the others are never sent.  Within a
block a query stops where the product of lengths is below its bound; vectors and queries
are rotated to the singular axes of all vectors, so that few coordinates hold most of a
product, and a candidate is dropped as soon as its partial sum plus the product of the
remaining lengths (Cauchy-Schwarz) is below the bound.  What is left is scored exactly:
in doubles where every sum stays below 2^53, else in 64-bit, else in Python integers.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from buildlens.llm import vectors as V
from buildlens.llm.common import arrow_batches
from buildlens.sources.storage import materialize

#: Rotated coordinates after which candidates are dropped.
STAGES = (8, 16, 32)
#: Scores are integers, partial sums are not: a bound must be missed by more than this.
SLACK = 0.5
#: Rounding of a sum of products, as a share of the product of lengths.
ERROR = 1e-9


def quantised(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``id, vector``: floor(scale * x) / scale of every component, exact in doubles of any size; unusable rows and NULL ids left out.

    ``scale`` is a power of two up to 256; a double of 2^53 or more is whole.
    """
    exact = df.select(F.col(id_col).cast("long").alias("id"), F.transform(F.col(vector_col), lambda x: x.cast("double")).alias("v"))
    exact = exact.where(F.col("id").isNotNull() & V.usable(F.col("v")))
    whole = lambda x: F.when(F.abs(x) < 2.0**53, F.floor(x * scale).cast("double") / scale).otherwise(x)
    return exact.select("id", F.transform("v", whole).alias("vector"))


def axes(vectors: DataFrame) -> np.ndarray:
    """Columns are the right singular vectors of all vectors of the commonest length, by falling singular value.

    Each vector counts by its direction only.  Tasks add up the products of their rows; the driver gets one matrix per task, of the
    vectors' length squared.
    """
    def grams(batches):
        total = None
        for batch in batches:
            if len(batch):
                x = V.matrix(batch["vector"])
                x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), np.finfo(float).tiny)
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pd.DataFrame({"i": np.repeat(np.arange(len(total)), len(total)), "j": np.tile(np.arange(len(total)), len(total)), "v": total.ravel()})

    common = vectors.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if common is None:
        return np.eye(1)
    parts = vectors.where(F.size("vector") == common["dim"]).select("vector").mapInPandas(grams, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    n = int(parts["i"].max()) + 1
    gram = np.zeros((n, n))
    gram[parts["i"], parts["j"]] = parts["v"]
    return np.linalg.eigh((gram + gram.T) / 2)[1][:, ::-1]


def exact_products(x: np.ndarray, q: np.ndarray, scale: int) -> np.ndarray:
    """Integer inner products of rows scale * x with scale * q, where doubles may round: 64-bit or Python integers."""
    with np.errstate(over="ignore"):
        top_x, top_q = np.abs(x).max() * scale, np.abs(q).max() * scale
        if top_x * top_q * len(q) < 2.0**62 and max(top_x, top_q) < 2.0**62:
            return (x * scale).astype(np.int64) @ (q * scale).astype(np.int64)
    whole = lambda v: [n * (scale // d) for n, d in (c.as_integer_ratio() for c in v)]
    own = whole(q.tolist())
    return np.array([sum(a * b for a, b in zip(own, whole(r), strict=True)) for r in x.tolist()], dtype=object)


def candidates(qs: np.ndarray, xs: np.ndarray, bound: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    """(queries, vectors) which products may reach the queries' bounds; comparisons keep a pair wherever a sum overflows."""
    with np.errstate(all="ignore"):
        qr, xr = qs @ rotation, xs @ rotation
        sizes, lengths = np.sqrt((qs * qs).sum(axis=1)), np.sqrt((xs * xs).sum(axis=1))
        least = bound - SLACK - ERROR * sizes * lengths.max()
        alive = ~(sizes[:, None] * lengths < least[:, None])
        partial, done = np.zeros(alive.shape), 0
        for stage in STAGES:
            rows = np.flatnonzero(alive.any(axis=1) & np.isfinite(bound))
            cols = np.flatnonzero(alive[rows].any(axis=0))
            if stage >= rotation.shape[1] or not len(rows) or not len(cols):
                break
            at = np.ix_(rows, cols)
            partial[at] += qr[rows, done:stage] @ xr[cols, done:stage].T
            rest = np.sqrt((qr[rows, stage:] ** 2).sum(axis=1))[:, None] * np.sqrt((xr[cols, stage:] ** 2).sum(axis=1))
            alive[at] &= ~(partial[at] + rest < least[rows, None])
            done = stage
    return alive


def order_key(score: int) -> str | None:
    """Text whose order is that of the integers; only for those beyond 64 bits."""
    if -(1 << 63) <= score < 1 << 63:
        return None
    digits = str(abs(score))
    if score > 0:
        return f"{len(digits):05d}{digits}"
    return f"{99999 - len(digits):05d}{digits.translate(str.maketrans('0123456789', '9876543210'))}"


#: Beyond 64 bits: the sign and a text in the integers' order; NULL and 0 for all others.
FOUND = "query_id long, vec_id long, score long, beyond int, wide string, exact string"


def best(found: DataFrame, k: int) -> DataFrame:
    """The k best candidates of each query with ``rank`` from 1: highest score, ties to the smaller id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("beyond"), F.desc("wide"), F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)


def _search(a: pd.DataFrame, b: pd.DataFrame, k: int, scale: int, rotation: np.ndarray) -> pd.DataFrame:
    """The k best rows of a vector block for each query of a query block, length by length."""
    out = []
    sizes, own = b["vector"].map(len).to_numpy(), a["vector"].map(len).to_numpy()
    for dim in np.intersect1d(sizes, own):
        rows, asked = b[sizes == dim], a[own == dim]
        x, q = V.matrix(rows["vector"]), V.matrix(asked["vector"])
        with np.errstate(over="ignore"):
            xs, qs = x * scale, q * scale
            exact = np.abs(xs).max() * np.abs(qs).max() * dim < 2.0**53  # whole numbers: no sum is rounded
        bound = np.nan_to_num(asked["bound"].to_numpy(dtype=float, na_value=-np.inf), nan=-np.inf, posinf=np.inf, neginf=-np.inf)
        alive = candidates(qs, xs, bound, rotation if len(rotation) == dim else np.eye(dim))
        ids, names = [np.asarray(m) for m in rows["ids"]], asked["id"].to_numpy()
        cols = np.flatnonzero(alive.any(axis=0))
        products = qs @ xs[cols].T if exact else None
        for i in np.flatnonzero(alive.any(axis=1)):
            left = np.flatnonzero(alive[i, cols])
            scores = products[i, left] if exact else exact_products(x[cols[left]], q[i], scale)
            # k + 1 distinct vectors hold the k best rows: one of them may be the query's own.
            width = min(k + 1, len(scores))
            cut = np.partition(scores, -width)[-width] if exact else np.sort(scores)[-width]
            members = [(int(scores[j]), m) for j in np.flatnonzero(scores >= cut) for m in ids[cols[left[j]]][ids[cols[left[j]]] != names[i]][:k].tolist()]
            for score, member in sorted(members, key=lambda r: (-r[0], r[1]))[:k]:
                wide = order_key(score)
                out.append((names[i], member, None if wide else score, 0 if wide is None else 1 if score > 0 else -1, wide, str(score)))
    kinds = {"query_id": "Int64", "vec_id": "Int64", "score": "Int64", "beyond": "Int32", "wide": object, "exact": object}
    return pd.DataFrame({c: pd.Series([r[i] for r in out], dtype=kind) for i, (c, kind) in enumerate(kinds.items())})


def reachable(asked: DataFrame, blocks: DataFrame) -> DataFrame:
    """``query_block, vector_block`` with a row for every pair that may hold a better score than the queries' bounds.

    Lengths fall with the block number, so a query block needs the first so many; how many
    follows from one ordered pass over one row per block.
    """
    need = F.try_divide(F.col("bound") - SLACK, F.col("length") * (1 + 2 * ERROR))
    some = F.when(F.col("bound").isNull() | (F.col("bound") <= SLACK), F.lit(0.0)).otherwise(F.coalesce(need, F.lit(0.0)))
    lows = asked.groupBy(F.col("block").alias("query_block")).agg(F.min(some).alias("length"))
    tops = blocks.groupBy("block").agg(F.max("length").alias("length"))
    marks = tops.select("length", F.lit(0).alias("kind"), F.lit(None).cast("int").alias("query_block")).unionByName(
        lows.select("length", F.lit(1).alias("kind"), "query_block"))
    before = Window.orderBy(F.desc("length"), "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = marks.withColumn("n", F.sum(1 - F.col("kind")).over(before)).where("kind = 1 AND n > 1")
    return counted.select("query_block", F.explode(F.sequence(F.lit(1), F.col("n").cast("int") - 1)).alias("vector_block"))


def top_products(df: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score, exact``: the k rows of ``df`` with the largest integer inner product.

    The query's own id is no candidate.  NULL and non-finite vectors take no part on either
    side; with fewer candidates all are returned; ties go to the smaller id.
    A row that repeats is that many candidates; a query id with several vectors has the
    smallest of them.  Only vectors as long as the query's are candidates.  Components of
    any finite size are exact: ``exact`` is the score in decimal digits, ``score`` is NULL
    where it is beyond a 64-bit integer (it still ranks by its value).  Empty tables give an
    empty result; other columns are ignored, whatever their names.  ``scale`` is a power of two.
    """
    spark = df.sparkSession
    arrow_batches(spark, 5000)
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, v: s + (v * scale) * (v * scale)))  # may be infinite
    distinct = materialize(V.distinct_vectors(quantised(df, id_col, vector_col, scale), k).withColumn("length", length), "norm-vectors")
    rotation = spark.sparkContext.broadcast(axes(distinct))
    blocks, _ = V.numbered(distinct, [F.desc("length"), F.element_at("ids", 1)], V.BLOCK, "norm-blocks")
    blocks = materialize(blocks, "norm-numbered")
    asked, n_asked = V.numbered(V.one_vector(quantised(queries, id_col, vector_col, scale)), [F.col("id")], V.QUERY_BLOCK, "norm-queries")
    asked = materialize(asked.withColumn("length", length), "norm-asked")

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return _search(a, b, k, scale, rotation.value)

    first = materialize(V.blockwise(asked.withColumn("bound", F.lit(None).cast("double")), n_asked,
                                    blocks.where("block = 0"), 1, run, FOUND), "norm-first")
    low = F.when(F.col("beyond") == 0, F.col("score").cast("double")).when(F.col("beyond") < 0, F.lit(float("-inf"))).otherwise(F.lit(2.0**62))
    worst = (best(first, k).groupBy("query_id").agg(F.count("*").alias("n"), F.min(low).alias("least"))
             .where(F.col("n") >= k).select(F.col("query_id").alias("id"), F.col("least").alias("bound")))
    bounded = materialize(asked.join(worst, "id", "left"), "norm-bounded")
    pairs = materialize(reachable(bounded, blocks), "norm-pairs")
    left = bounded.withColumnRenamed("block", "query_block").join(pairs, "query_block")
    right = blocks.withColumnRenamed("block", "of_block").join(
        pairs.select(F.col("query_block").alias("for_queries"), F.col("vector_block").alias("of_block")), "of_block")

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return run(a, b) if len(a) and len(b) else pd.DataFrame()

    more = left.groupBy("query_block", "vector_block").cogroup(right.groupBy("for_queries", "of_block")).applyInPandas(meet, FOUND)
    return best(first.unionByName(more), k).select("query_id", "rank", "vec_id", "score", "exact")

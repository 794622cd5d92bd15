"""Centroid clustering of 64-component vectors on bit planes, in exact integers.

A vector of 64 integers is kept as its two's complement bit planes: plane p is one 64-bit
word that holds bit p of every component, the last plane counts negative.  Then

    dot(v, c) = sum over planes i of v and j of c of weight_i * weight_j * popcount(v_i & c_j)

and |v - c|^2 = dot(v, v) - 2 dot(v, c) + dot(c, c), without rounding.  A row has as many
planes as its own largest component needs, eleven or so for components in -1..1 at scale
1024.  The sum of a cluster's vectors follows from counts of set bits per plane and
component, so a round returns a few counts per task and the driver sees a row per cluster,
plane and component.

Rows: vectors without exactly 64 components, NULL ones and those with NULL or non-finite
components take no part.  A row is a vector: rows that repeat an id or a vector all count.
Rows without id take part; the starting order sees an empty id.  Starting vectors with one
hash are taken in ascending order of their planes.  An empty table gives an empty result,
fewer vectors than clusters give as many clusters as vectors.  Components of any finite
size are exact; a distance or sum beyond a 64-bit integer is NULL.  Other columns of the
input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buildlens.llm.common import arrow_batches
from buildlens.llm.vectors import usable
from buildlens.sources.storage import materialize

COMPONENTS = 64
SCALE = 1024
CLUSTERS = 8
ROUNDS = 10
MAX_LONG = (1 << 63) - 1

#: cluster -> its components
Centroids = list[list[int]]


def integers(vectors: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x); Python integers where a product may leave 62 bits."""
    if not vectors.size or np.abs(vectors).max() * scale < 2.0**61:
        return np.floor(vectors * scale).astype(np.int64)
    exact = [[int(np.floor(x * scale)) if abs(x) < 2.0**52 else int(x) * scale for x in row] for row in vectors.tolist()]
    return np.array(exact, dtype=object).reshape(vectors.shape)


def to_planes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows x widest) words and each row's number of planes; planes beyond a row's number repeat its sign."""
    folded = np.where(values < 0, -1 - values, values)
    widths = np.array([int(m).bit_length() + 1 for m in folded.max(axis=1)], dtype=np.int64)
    words = np.empty((len(values), int(widths.max())), dtype=np.uint64)
    for p in range(words.shape[1]):
        bits = ((values >> min(p, 62) if values.dtype != object else values >> p) & 1).astype(np.uint8)
        words[:, p] = np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]
    return words, widths


def weights(width: int, wide: bool) -> np.ndarray:
    """Value of each plane of a number in two's complement."""
    return np.array([1 << p for p in range(width - 1)] + [-(1 << (width - 1))], dtype=object if wide else np.int64)


def dots(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Row by row inner products of two sets of planes; a single row on the right goes with every left row."""
    wide = left.shape[1] + right.shape[1] + 8 > 62
    own, other = weights(left.shape[1], wide), weights(right.shape[1], wide)
    total = np.zeros(len(left), dtype=own.dtype)
    for j in range(right.shape[1]):
        total = total + np.bitwise_count(left & right[:, j:j + 1]).astype(own.dtype) @ own * other[j]
    return total


def _centroid_planes(centroids: Centroids) -> list[np.ndarray]:
    return [to_planes(np.array([c], dtype=object))[0] for c in centroids]


def nearest(words: np.ndarray, centroids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid (ties: the smaller number) and squared distance of rows with one number of planes."""
    own = dots(words, words)
    parts = [(own, dots(words, c), np.repeat(dots(c, c), len(words))) for c in centroids]
    kind = object if any(x.dtype == object for part in parts for x in part) else np.int64  # all or none, so sums stay exact
    distances = np.stack([a.astype(kind) - 2 * b.astype(kind) + c.astype(kind) for a, b, c in parts], axis=1)
    at = distances.argmin(axis=1)
    return at, distances[np.arange(len(at)), at]


def _by_width(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, planes) for each number of planes in a batch."""
    starts = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False).view(np.uint64)
    widths = np.diff(starts)
    for width in np.unique(widths):
        rows = np.flatnonzero(widths == width)
        yield rows, flat[starts[rows][:, None] + np.arange(width)]


def packed(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``vec_id, planes`` of every usable row."""
    arrow_batches(rows.sparkSession, 4000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False)
            words, widths = to_planes(integers(flat.reshape(-1, COMPONENTS), scale))
            used = np.arange(words.shape[1]) < widths[:, None]
            offsets = np.concatenate([[0], np.cumsum(widths)]).astype(np.int32)
            planes = pa.ListArray.from_arrays(pa.array(offsets), pa.array(words[used].view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), planes], ["vec_id", "planes"])

    vector = F.col(vector_col).cast("array<double>")
    kept = rows.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("vector"))
    kept = kept.where(usable(F.col("vector")) & (F.size("vector") == COMPONENTS))
    return kept.mapInArrow(run, "vec_id long, planes array<long>")


def _from_planes(planes: list[int]) -> list[int]:
    value = weights(len(planes), True)
    bits = [(word & MAX_LONG) | (int(word < 0) << 63) for word in planes]
    return [sum(int(w) for w, word in zip(value, bits, strict=True) if word >> k & 1) for k in range(COMPONENTS)]


def first_centroids(table: DataFrame, clusters: int = CLUSTERS) -> Centroids:
    """The vectors whose ids have the smallest hashes."""
    digest = F.sha2(F.concat(F.lit("3:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [_from_planes(r["planes"]) for r in table.orderBy(digest, "planes").limit(clusters).collect()]


def next_centroids(table: DataFrame, centroids: Centroids) -> Centroids:
    """Each non-empty cluster's floor of the mean; tasks return counts of set bits, sign planes negative."""
    at = _centroid_planes(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = np.zeros(len(at), dtype=np.int64)
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, words in _by_width(batch.column("planes")):
                member = np.zeros((len(at), len(words)), dtype=np.int64)
                member[nearest(words, at)[0], np.arange(len(words))] = 1
                sizes += member.sum(axis=1)
                last = words.shape[1] - 1
                for p in range(last + 1):
                    bits = np.unpackbits(np.ascontiguousarray(words[:, p:p + 1]).view(np.uint8), axis=1, bitorder="little")
                    found = member @ bits
                    counts[p] = counts.get(p, 0) + (-found if p == last else found)
        rows = [(c, -1, 0, int(n)) for c, n in enumerate(sizes) if n]
        rows += [(c, p, k, int(n)) for p, grid in counts.items() for (c, k), n in np.ndenumerate(grid) if n]
        columns = zip(*rows, strict=True) if rows else ([], [], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)],
                                         ["cluster", "plane", "component", "n"])

    found = (table.mapInArrow(run, "cluster int, plane int, component int, n long")
             .groupBy("cluster", "plane", "component").agg(F.sum("n").alias("n")).collect())
    sizes = {r["cluster"]: r["n"] for r in found if r["plane"] < 0}
    sums = [[0] * COMPONENTS for _ in centroids]
    for r in found:
        if r["plane"] >= 0:
            sums[r["cluster"]][r["component"]] += r["n"] << r["plane"]
    return [[s // sizes[c] for s in sums[c]] if c in sizes else old for c, old in enumerate(centroids)]


def fit(table: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS) -> Centroids:
    """Centroids after the given rounds over a table of ``packed`` vectors; rounds that change nothing are not run again."""
    centroids = first_centroids(table, clusters)
    for _ in range(rounds if centroids else 0):
        before, centroids = centroids, next_centroids(table, centroids)
        if centroids == before:
            break
    return centroids


def assign(table: DataFrame, centroids: Centroids) -> DataFrame:
    """``vec_id, cluster, distance`` of every packed vector."""
    at = _centroid_planes(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster = np.zeros(batch.num_rows, dtype=np.int32)
            distance: list[int | None] = [None] * batch.num_rows
            for rows, words in _by_width(batch.column("planes")):
                found, squares = nearest(words, at)
                cluster[rows] = found
                for i, d in zip(rows.tolist(), squares.tolist(), strict=True):
                    distance[i] = d if d <= MAX_LONG else None
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cluster), pa.array(distance, pa.int64())],
                                             ["vec_id", "cluster", "distance"])

    return table.mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(rows: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, centroid`` per usable vector."""
    spark = rows.sparkSession
    table = materialize(packed(rows, id_col, vector_col), "plane-vectors")
    centroids = fit(table, clusters, rounds)
    assigned = materialize(assign(table, centroids), "plane-clusters")
    whole = F.sum(F.col("distance").cast("decimal(38,0)"))
    sums = (assigned.groupBy("cluster").agg(F.when(F.count("distance") == F.count("*"), whole).alias("total"))
            .collect())  # a row per cluster
    known = {r["cluster"]: None if r["total"] is None else int(r["total"]) for r in sums}
    everything = None if None in known.values() else sum(known.values())
    fits = lambda n: n if n is not None and n <= MAX_LONG else None
    facts = [(c, fits(known.get(c, 0)), fits(everything), hashlib.sha256(",".join(map(str, v)).encode()).hexdigest(), [str(x) for x in v])
             for c, v in enumerate(centroids)]
    schema = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<string>"
    return assigned.join(F.broadcast(spark.createDataFrame(facts, schema)), "cluster").select(  # a row per cluster
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid")

"""Near-duplicate vectors of one label: E8 lattice cells in several tables, verified by cosine.

Each distinct vector of a label is scaled to length one and projected to eight dimensions
by a random matrix per table; the nearest point of the lattice E8 is its cell.  It is
posted in its own cell and in the ``PROBES`` cells around that lie nearest to its
projection.  Two vectors meet where one's own cell is the other's own or probed cell.  In a
simulation of pairs at cosine 0.98, scale 1.5 and 16 probes, one table finds 0.84 of them,
so six tables miss one in 60,000 at the very threshold; at 0.985 one in ten million.

Cells that hold one vector only are left out before any vector moves.  The rest of a
cell's rows are dealt into blocks; every pair of blocks is one unit, compared as a matrix,
so that a hot cell is spread over many units and no unit holds more than two blocks.  A
unit returns a count per vector and a spanning forest of what it linked, never pairs.  A
pair that meets in several cells counts in the first one only, which both rows' cells tell.

Handling: NULL labels, NULL, empty and zero vectors, NULL or non-finite components link
with nothing.  Vectors of different length are never compared.  Rows with equal label and
vector are one node, so copies cost nothing and count as links of each other.  Components
of any finite size are scaled first, so no product overflows.  A row without id takes part
but gives no component its number; it is kept only if its component has no id.  Rows that
repeat an id are rows of their own.  An empty table gives an empty result; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buildlens.llm.common import arrow_batches
from buildlens.llm.minhash import components
from buildlens.llm.vectors import usable
from buildlens.sources.storage import materialize, spread

THRESHOLD = 0.98
TABLES = 6
PROBES = 16
#: Lattice steps of a unit vector's length; larger cells find more and compare more.
SCALE = 1.5
SEED = 20240311
#: Rows of a block of a cell.
BLOCK = 1024

_MIX = np.uint64(0x9E3779B97F4A7C15)


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: the neighbours of a lattice point."""
    whole = [np.eye(8)[i] * s + np.eye(8)[j] * t for i, j in itertools.combinations(range(8), 2) for s, t in itertools.product((1, -1), repeat=2)]
    half = [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(whole + half)


def _even(points: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum: where the sum is odd the worst rounded coordinate goes the other way."""
    near = np.rint(points)
    odd = np.flatnonzero(near.sum(axis=1) % 2)
    off = points[odd] - near[odd]
    worst = np.abs(off).argmax(axis=1)
    near[odd, worst] += np.where(off[np.arange(len(odd)), worst] >= 0, 1.0, -1.0)
    return near


def decode(points: np.ndarray) -> np.ndarray:
    """The nearest E8 point of each row: integers with an even sum, or those moved by one half."""
    whole, half = _even(points), _even(points - 0.5) + 0.5
    closer = ((points - whole) ** 2).sum(axis=1) <= ((points - half) ** 2).sum(axis=1)
    return np.where(closer[:, None], whole, half)


def cell_codes(table: int, cells: np.ndarray) -> np.ndarray:
    """64-bit hash of table and lattice point (last axis); equal hashes of unequal cells only add candidates."""
    code = np.full(cells.shape[:-1], table + 1, dtype=np.uint64)
    for k in range(8):
        code = (code ^ (2 * cells[..., k]).astype(np.int64).view(np.uint64)) * _MIX
        code ^= code >> np.uint64(29)
    return code.view(np.int64)


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, by their largest component first."""
    small = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return small / np.sqrt((small * small).sum(axis=1, keepdims=True))


def signatures(units: np.ndarray, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """Own cell codes (rows x tables) and probed ones (rows x tables * probes)."""
    around = minimal_vectors()
    own, near = [], []
    for t in range(tables):
        matrix = np.random.default_rng([SEED, t, units.shape[1]]).normal(size=(units.shape[1], 8)) * scale
        points = units @ matrix
        cells = decode(points)
        best = np.argsort(-((points - cells) @ around.T), axis=1, kind="stable")[:, :probes]
        own.append(cell_codes(t, cells))
        near.append(cell_codes(t, cells[:, None, :] + around[best]))
    return np.stack(own, axis=1), np.concatenate(near, axis=1)


def _lists(values: np.ndarray) -> pa.ListArray:
    offsets = np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel()))


def signed(nodes: DataFrame, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE) -> DataFrame:
    """Add ``own`` and ``near``, the cell codes, to ``node, label, dim, n, vector``."""
    arrow_batches(nodes.sparkSession, 2000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                vectors = part.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                own, near = signatures(unit_rows(vectors), tables, probes, scale)
                yield pa.RecordBatch.from_arrays([*part.columns, _lists(own), _lists(near)], [*part.schema.names, "own", "near"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema.fields)
    return nodes.mapInArrow(run, f"{schema}, own array<long>, near array<long>")


def units(found: DataFrame, block: int = BLOCK) -> DataFrame:
    """``label, dim, cell, first, second, node, mine, part``: the rows of each pair of blocks of each cell worth a look."""
    posted = found.select("label", "dim", "node", F.explode("own").alias("cell"), F.lit(True).alias("mine")).unionByName(
        found.select("label", "dim", "node", F.explode("near").alias("cell"), F.lit(False).alias("mine")))
    keys = ["label", "dim", "cell"]
    shared = posted.groupBy(*keys).agg(F.count("*").alias("m"), F.count_if("mine").alias("o")).where("m > 1 AND o > 0")
    parts = F.ceil(F.col("m") / block).cast("int")
    member = posted.join(shared, keys).withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    member = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return member.select(*keys, F.least("part", "other").alias("first"), F.greatest("part", "other").alias("second"), "node", "mine", "part")


def _first_meeting(own: np.ndarray, near: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Code of the first cell in which rows a and b meet; both own cells in a table: the shared one, then the smaller."""
    tables = own.shape[1]
    probes = near.shape[1] // tables
    out = np.zeros(len(a), dtype=np.int64)
    open_ = np.ones(len(a), dtype=bool)
    for t in range(tables):
        oa, ob = own[a, t], own[b, t]
        probed = near[:, t * probes:(t + 1) * probes]
        in_b, in_a = (probed[b] == oa[:, None]).any(axis=1), (probed[a] == ob[:, None]).any(axis=1)
        here = np.where(in_a & in_b, np.minimum(oa, ob), np.where(in_b, oa, ob))
        met = open_ & ((oa == ob) | in_a | in_b)
        out[met] = np.where(oa == ob, oa, here)[met]
        open_ &= ~met
    return out


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest row that each row reaches over the given pairs."""
    least = np.arange(n)
    while True:
        low = np.minimum(least[a], least[b])
        before = least.copy()
        np.minimum.at(least, a, low)
        np.minimum.at(least, b, low)
        least = least[least]
        if (least == before).all():
            return least


def compare(unit: pd.DataFrame, threshold: float = THRESHOLD) -> pd.DataFrame:
    """``a, b, links`` of one unit: a row per linked node with the rows it links here, and the edges of a spanning forest."""
    split = unit["first"].iat[0] != unit["second"].iat[0]
    left = np.flatnonzero(unit["part"].to_numpy() == unit["first"].iat[0]) if split else np.arange(len(unit))
    right = np.flatnonzero(unit["part"].to_numpy() != unit["first"].iat[0]) if split else left
    mine = unit["mine"].to_numpy()
    if not mine.any() or not len(left) or not len(right):
        return pd.DataFrame()
    rows = unit_rows(np.stack([np.asarray(v, dtype=np.float64) for v in unit["vector"]]))
    close = rows[left] @ rows[right].T >= threshold
    close &= mine[left][:, None] | mine[right][None, :]
    if not split:
        close = np.triu(close, 1)
    i, j = np.nonzero(close)
    a, b = left[i], right[j]
    if not len(a):
        return pd.DataFrame()
    first = _first_meeting(np.stack(unit["own"].to_list()), np.stack(unit["near"].to_list()), a, b) == unit["cell"].iat[0]
    a, b = a[first], b[first]
    node, copies = unit["node"].to_numpy(), unit["n"].to_numpy()
    links = np.zeros(len(unit), dtype=np.int64)
    np.add.at(links, a, copies[b])
    np.add.at(links, b, copies[a])
    least = _forest(len(unit), a, b)
    linked, below = np.flatnonzero(links), np.flatnonzero(least != np.arange(len(unit)))
    return pd.DataFrame({"a": np.concatenate([node[linked], node[below]]),
                         "b": pd.array([None] * len(linked) + node[least[below]].tolist(), dtype="Int64"),
                         "links": pd.array(links[linked].tolist() + [None] * len(below), dtype="Int64")})


def compared(found: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """``compare`` over all units: sorted within partitions, one unit in memory at a time."""
    keys = ["label", "dim", "cell", "first", "second"]
    arrow_batches(found.sparkSession, 2000)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in itertools.chain(batches, [None]):
            rows = rest if batch is None else batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            if rows is None or not len(rows):
                continue
            starts = np.flatnonzero((rows[keys] != rows[keys].shift()).any(axis=1).to_numpy())
            ends = [*starts[1:], len(rows)]
            whole = len(starts) if batch is None else len(starts) - 1
            out = [compare(rows.iloc[s:e], threshold) for s, e in zip(starts[:whole], ends[:whole], strict=True) if e - s > 1]
            rest = None if batch is None else rows.iloc[starts[-1]:]
            if out:
                yield pd.concat(out, ignore_index=True)

    carried = found.select("node", "n", "vector", "own", "near")
    pairs = units(found, block).join(carried, "node")
    return spread(pairs, *keys).sortWithinPartitions(*keys).mapInPandas(run, "a long, b long, links long")


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                    threshold: float = THRESHOLD) -> DataFrame:
    """``vec_id, label, n_links, component_id, kept`` of every row."""
    table = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"), F.col(label_col).alias("label"))
    whole = usable(F.col("vector")) & F.col("label").isNotNull() & F.exists("vector", lambda x: x != 0)
    nodes = table.where(whole).groupBy("label", "vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    nodes = materialize(nodes.withColumn("dim", F.size("vector")).withColumn("node", F.monotonically_increasing_id()), "lattice-nodes")
    found = materialize(signed(nodes.select("node", "label", "dim", "n", "vector")), "lattice-cells")
    result = materialize(compared(found, threshold), "lattice-links")
    links = result.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    linked = components(result.where("b IS NOT NULL").select("a", "b")).select(F.col("doc_id").alias("node"), F.col("component_id").alias("root"))
    known = nodes.join(links, "node", "left").join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    known = materialize(known.select("node", "label", "vector", "rep", "n", "links", "root"), "lattice-nodes-linked")
    smallest = known.groupBy("root").agg(F.min("rep").alias("least"))
    known = known.join(smallest, "root").select("label", "vector", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "least",
                                                F.lit(True).alias("usable"))
    component = F.when(F.col("usable"), F.col("least")).otherwise(F.col("vec_id"))
    return table.join(known, ["label", "vector"], "left").select(
        "vec_id", "label", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, component.isNull()).alias("kept"))

"""Sharding by sampled splitters: size-weighted samples, quantile boundaries, ranges, exact byte positions.

Rows get a key (hash of the text, hash of the id, place in the table), so copies of
a text are neighbours and yet divisible.  Splitters are quantiles of a sample drawn
in proportion to size; a range that turns out overfull is sampled and cut again.
Exact totals of the ranges then give every row its byte position in key order, and
slices of the positions are the shards; a small group of copies goes where its middle lies.  The few rows that are large against a shard
are placed first, so that shard sizes differ by about 1 / LARGE at most.  All steps are DataFrame operations; the driver sees only the
samples (``ranges * SAMPLES`` keys), the large rows' keys and one total per range.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from buildlens.sources.storage import materialize

#: Ranges into which the key space is cut.
RANGES = 1024
#: Sampled keys per wanted range.
SAMPLES = 16
#: A range is overfull beyond this multiple of the mean weight.
OVERFULL = 4.0
#: A row above this part of a shard is placed on its own; a group of copies up to this part of a shard is not divided.
LARGE = 64
#: Rounds of subdivision; the key is unique, so only a single huge row resists.
ROUNDS = 8


def _hex(c: Column) -> Column:
    return F.lpad(F.hex(c), 16, "0")


def _range_of(key: Column, bounds: list[str]) -> Column:
    """Number of boundaries at or below the key, by binary descent in a literal array."""
    if not bounds:
        return F.lit(0)
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    array = F.lit(bounds)
    return F.aggregate(
        F.lit(steps), F.lit(0),
        lambda lo, s: F.when(F.coalesce(F.get(array, lo + s - 1) <= key, F.lit(False)), lo + s).otherwise(lo))


def _sample(keyed: DataFrame, weight: Column, chance: float) -> list[str]:
    """Sorted keys, each row drawn with probability ``min(1, weight * chance)``."""
    drawn = F.pmod(F.xxhash64(F.lit(17), "key"), F.lit(1 << 40)) / (1 << 40) < weight * chance
    return sorted(r[0] for r in keyed.where(drawn).select("key").collect())


def _quantiles(keys: list[str], parts: int) -> list[str]:
    return sorted({keys[len(keys) * i // parts] for i in range(1, parts)}) if len(keys) >= parts > 1 else sorted(set(keys))


def splitters(keyed: DataFrame, rows: int, total: int, ranges: int = RANGES, samples: int = SAMPLES) -> list[str]:
    """Boundaries of ranges of about equal weight (half by bytes, half by rows: many
    tiny rows make a range as heavy as a few large ones)."""
    weight = F.col("size") / total + F.lit(1.0 / rows)
    bounds = _quantiles(_sample(keyed, weight, ranges * samples / 2), ranges)
    for _ in range(ROUNDS):
        at = keyed.withColumn("range", _range_of(F.col("key"), bounds))
        heavy = (at.groupBy("range").agg(F.sum(weight).alias("w"), F.count("*").alias("n"))
                 .where((F.col("w") > OVERFULL * 2 / ranges) & (F.col("n") > 1)).collect())
        if not heavy:
            break
        inside = at.where(F.col("range").isin([r["range"] for r in heavy]))
        more = _sample(inside, weight, ranges * samples / 2)
        finer = sorted({*bounds, *more[samples // 2::samples], *more[:1], *more[-1:]})
        if finer == bounds:
            break
        bounds = finer
    return bounds


def spread_large(large: list[tuple[str, int]], small_total: int, shards: int) -> tuple[dict[str, tuple[int, int]], list[float]]:
    """Longest-first places ``key -> (shard, index)`` of the large rows, and where each shard's slice of
    the small rows ends, so that all shards fill up to one level as far as the large rows allow."""
    heap = [(0, s) for s in range(shards)]
    counts, places = [0] * shards, {}
    for key, size in sorted(large, key=lambda r: (-r[1], r[0])):
        load, s = heapq.heappop(heap)
        places[key] = (s, counts[s])
        counts[s] += 1
        heapq.heappush(heap, (load + size, s))
    loads = sorted(heap)
    level, filled = 0.0, 0
    for n in range(1, shards + 1):  # the n least loaded shards share the small rows
        filled += loads[n - 1][0]
        level = (small_total + filled) / n
        if n == shards or level <= loads[n][0]:
            break
    room = dict.fromkeys(range(shards), 0.0) | {s: max(0.0, level - load) for load, s in loads}
    return places, list(itertools.accumulate(room[s] for s in range(shards)))


def assign(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text",
           carry: Sequence[str] = (), ranges: int = RANGES, samples: int = SAMPLES) -> DataFrame:
    """Shard and slot of every row: id, size, text_crc32, ``carry`` columns, shard, slot.

    Size is the text's UTF-8 bytes plus 8; a NULL text counts as empty (crc32 0), a
    NULL id is kept and only loses its part of the key.  Equal texts are neighbours.  A
    group of copies of up to ``1 / LARGE`` of a shard lies in one shard, unless one of the
    at most ``ranges`` range boundaries runs through it; a larger group may lie in two
    neighbouring shards, or more if it is larger than a shard.  A carried column named like
    a computed one (size, text_crc32, shard, slot or the id) gets ``_`` after its name.  Fully
    equal rows are kept apart by their place.  Rows above ``1 / LARGE`` of a shard (at
    most ``shards * LARGE`` of them) are placed longest first, the ranges fill the rest.
    Slots run from 0 without a gap.  An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    place = F.monotonically_increasing_id()
    keyed = materialize(docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.concat(_hex(F.xxhash64(text)), _hex(F.xxhash64(F.col(id_col))), _hex(place)).alias("key"),
        F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)]).alias("carried")), "shard-keys")
    rows, total = keyed.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(1))).first()
    is_large = F.col("size") * (shards * LARGE) > total
    large = [tuple(r) for r in keyed.where(is_large).select("key", "size").collect()]  # at most shards * LARGE
    places, ends = spread_large(large, total - sum(s for _, s in large), shards)

    small = keyed.where(~is_large)
    bounds = splitters(small, max(rows, 1), total, ranges, samples)
    at = small.withColumn("range", _range_of(F.col("key"), bounds))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    base = (at.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
            .select("range", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes0"),
                    F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows0")))
    inner = Window.partitionBy("range").orderBy("key")
    until = inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # A group's part in its range: copies share the first half of the key, so they follow each other.
    group = Window.partitionBy("range", "copies")
    end = F.col("bytes0") + F.sum("size").over(until)
    part, begin = F.sum("size").over(group), F.min("begin").over(group)
    middle = F.when(part * (shards * LARGE) <= total, begin + part / 2).otherwise(F.col("begin") + F.col("size") / 2)
    shard = sum((F.when(middle >= e, 1).otherwise(0) for e in ends[:-1]), F.lit(0))
    kept = ["id", "size", "text_crc32", "carried"]
    placed = materialize(
        at.join(F.broadcast(base), "range")  # one row per range
        .withColumn("copies", F.substring("key", 1, 16)).withColumn("begin", end - F.col("size"))
        .select(*kept, (F.col("rows0") + F.row_number().over(inner) - 1).alias("place"), shard.alias("shard")), "shard-places")
    first = placed.groupBy("shard").agg(F.min("place").alias("first"), F.count("*").alias("n"))  # one row per shard
    session = docs.sparkSession
    moved = session.createDataFrame([(k, *v) for k, v in places.items()], "key string, shard int, index long")
    of_small = placed.join(F.broadcast(first), "shard").select(*kept, "shard", (F.col("place") - F.col("first")).alias("slot"))
    of_large = (keyed.where(is_large).join(F.broadcast(moved), "key").join(F.broadcast(first), "shard", "left")
                .select(*kept, "shard", (F.coalesce("n", F.lit(0)) + F.col("index")).alias("slot")))
    taken = {id_col, "size", "text_crc32", "shard", "slot"}
    names = []
    for c in carry:
        while c in taken:
            c += "_"
        taken.add(c)
        names.append(c)
    return of_small.unionByName(of_large).select(
        F.col("id").alias(id_col), "size", "text_crc32", *[F.col("carried")[f"c{i}"].alias(c) for i, c in enumerate(names)], "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the rows with all their columns as one folder per shard, files ordered by slot.

    NULLs, empty texts, repeated rows, empty tables and clashing names as in ``assign``.
    """
    placed = assign(docs, shards, id_col, text_col, carry=[c for c in docs.columns if c != id_col])
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)

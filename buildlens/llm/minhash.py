"""Near-duplicates: MinHash signatures, an inverted join over their coordinates, confirmed on full sets.

A document is the set of its distinct five-word shingles.  Documents with the same set
are one class.  A class has a signature of ``COORDINATES`` minima; the first ``POSTED``
of them are posted as (coordinate, value) pairs.  Two classes with Jaccard 0.75 share 96
of 128 and 48 of 64 coordinates on average.  Pairs are kept with at least ``MATCHES`` of
all and ``POSTED_MATCHES`` of the posted coordinates, which loses a pair at the very
threshold with a chance below 1e-6.  A pair with that many posted matches shares a value
among any ``POSTED - POSTED_MATCHES + 1`` coordinates, so each class posts only that many,
its rarest ones: the long lists of common passages are skipped.

Lists are linked in steps, so that a group of copies never yields all its pairs:

1. each class against one class of its lists (the one with the most collisions among the
   lists' smallest members): a star per list;
2. each component that meets another in a list, through one member, against the list's
   most frequent component;
3. all pairs that remain between classes of different components.  Pages that share a
   template but link with nothing make long lists here, so the classes of contested lists
   meet under their rarest shingles instead (prefix filter, Xiao et al., 2008): of two
   similar sets the larger one has one of the smaller one's rarest seventh among its own
   rarest quarter.  Shingles of one component only come first in that order and are not
   posted, so pages that differ in more than a seventh of their own text post nothing in
   common.  What meets is compared inside the join by the places of the shingle and by odd
   sketches of the sets (Mitzenmacher et al., 2014): the bits in which two sketches differ
   never outnumber the shingles in which the sets differ.  Both drop no link.

Every link is confirmed on the full sets.  A pair left out in step 3 joins classes that
are already linked, so the components are those of all links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buildlens.llm.common import arrow_batches
from buildlens.sources.storage import materialize

WORDS = 5
PERCENT = 75
COORDINATES = 128
MATCHES = 70
POSTED = 64
POSTED_MATCHES = 30
SEED = 20240229
#: 64-bit words of the odd sketch.
SKETCH = 16

FEATURES = "doc_id long, n_shingles long, set_a long, set_b long, signature array<int>, sketch array<long>"


class _Words(dict):
    """64-bit hash of each distinct word, computed once."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingle_hashes(text: str | None, words: dict, size: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; a shorter sequence is one shingle, no word none.

    A-Z are lower-cased; words are what ASCII white space separates.
    """
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.empty(0, dtype=np.uint64)
    w = np.fromiter(map(words.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
    n = min(size, len(w))
    h = np.full(len(w) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        h = (h ^ w[i:len(w) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return np.unique(h)


def _signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(documents, COORDINATES) 32-bit minima over independent re-hashes of the sets' members."""
    rng = np.random.default_rng(SEED)
    mask = rng.integers(1 << 63, size=COORDINATES, dtype=np.uint64)
    odd = rng.integers(1 << 63, size=COORDINATES, dtype=np.uint64) | np.uint64(1)
    flat = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), COORDINATES), dtype=np.uint64)
    buffer = np.empty_like(flat)
    for k in range(COORDINATES):
        np.bitwise_xor(flat, mask[k], out=buffer)
        np.multiply(buffer, odd[k], out=buffer)
        out[:, k] = np.minimum.reduceat(buffer, starts)
    # The minimum's own low bits vary; fold them into the value that is posted.
    return ((out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _odd_sketch(hashes: np.ndarray) -> np.ndarray:
    """Per bit, whether an odd number of the set's members hash to it."""
    bits = np.bincount((hashes >> np.uint64(11)).astype(np.int64) & (64 * SKETCH - 1), minlength=64 * SKETCH) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, set_a, set_b, signature, sketch`` per row; neither of the last for an empty set.

    Two documents have the same 128-bit hash of their sorted sets only if the sets agree.
    """
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            if len(words) > 2_000_000:
                words.clear()
            sets = [shingle_hashes(t, words) for t in batch.column("text").to_pylist()]
            full = [i for i, s in enumerate(sets) if len(s)]
            signatures: list = [None] * len(sets)
            for at in range(0, len(full), 200):
                some = full[at:at + 200]
                for i, s in zip(some, _signatures([sets[i] for i in some]), strict=True):
                    signatures[i] = s
            digests = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                pa.array(np.array([d >> 64 for d in digests], dtype=np.uint64).view(np.int64)),
                pa.array(np.array([d & (1 << 64) - 1 for d in digests], dtype=np.uint64).view(np.int64)),
                pa.array(signatures, pa.list_(pa.int32())),
                pa.array([_odd_sketch(s) if len(s) else None for s in sets], pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "set_a", "set_b", "signature", "sketch"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, FEATURES)


def _similar_sizes(a: Column, b: Column) -> Column:
    return (a * 100 >= b * PERCENT) & (b * 100 >= a * PERCENT)


def postings(classes: DataFrame) -> DataFrame:
    """``key, doc_id, n_shingles``: each class under its rarest coordinate-value pairs that another class has too.

    The order of rarity covers all classes: pairs are counted, pairs that occur once are
    dropped but hold their place in the prefix.
    """
    pairs = classes.select("doc_id", "n_shingles", F.posexplode(F.slice("signature", 1, POSTED)).alias("k", "v"))
    pairs = pairs.select("doc_id", "n_shingles", (F.shiftleft(F.col("k").cast("long"), 32) + F.col("v").cast("long")).alias("key"))
    shared = pairs.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    kept = POSTED - POSTED_MATCHES + 1
    mine = (pairs.join(shared, "key").groupBy("doc_id", "n_shingles")  # at most POSTED rows a class
            .agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("found"))
            .where(F.size("found") >= POSTED_MATCHES))
    prefix = F.slice("found", 1, F.size("found") - (POSTED - kept))
    return mine.select("doc_id", "n_shingles", F.explode(prefix).alias("p")).select("doc_id", "n_shingles", F.col("p.key").alias("key"))


def matching(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs ``a, b`` whose signatures agree in enough coordinates."""
    sig = classes.select("doc_id", "signature")
    same = lambda n: F.aggregate(
        F.zip_with(F.slice("sa", 1, n), F.slice("sb", 1, n), lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return (pairs.join(sig.select(F.col("doc_id").alias("a"), F.col("signature").alias("sa")), "a")
            .join(sig.select(F.col("doc_id").alias("b"), F.col("signature").alias("sb")), "b")
            .where((same(POSTED) >= POSTED_MATCHES) & (same(COORDINATES) >= MATCHES)).select("a", "b"))


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs ``a, b`` whose full sets are similar enough; one side's set is kept while its rows follow each other."""
    arrow_batches(pairs.sparkSession, 200)
    both = (pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
            .join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
            .select("a", "b", "text_a", "text_b"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, last, own = _Words(), None, np.empty(0, dtype=np.uint64)
        for batch in batches:
            if len(words) > 1_000_000:
                words.clear()
            out = []
            for a, b, text_a, text_b in batch.itertuples(index=False):
                if text_a != last:
                    last, own = text_a, shingle_hashes(text_a, words)
                other = shingle_hashes(text_b, words)
                common = len(np.intersect1d(own, other, assume_unique=True))
                if common and 100 * common >= PERCENT * (len(own) + len(other) - common):
                    out.append((a, b))
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return both.mapInPandas(run, "a long, b long")


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31)))).first())


def components(edges: DataFrame) -> DataFrame:
    """``doc_id, component_id`` of all vertices of the edges: the smallest vertex reachable.

    Alternating large-star and small-star steps (Kiveris et al., 2014); each step is one
    aggregation and one equality join, written to the shared folder.
    """
    edges = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                        .where("u <> v").distinct(), "cc-edges")
    mark = _checksum(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = materialize(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                            .where("u <> v").distinct(), "cc-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"),
                                               F.col("m").alias("v")).where("u <> v").distinct())
        edges = materialize(small, "cc-small")
        before, mark = mark, _checksum(edges)
        if mark == before:
            break
    return edges.select(F.col("u").alias("doc_id"), F.col("v").alias("component_id")).unionByName(
        edges.select(F.col("v").alias("doc_id"), F.col("v").alias("component_id")).distinct())


def _with_component(rows: DataFrame, found: DataFrame) -> DataFrame:
    return rows.join(found, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))


def star_pairs(lists: DataFrame) -> DataFrame:
    """Step 1: each class with the hub it collides with most often."""
    hubs = lists.groupBy("key").agg(F.min(F.struct("doc_id", "n_shingles")).alias("hub"), F.count("*").alias("n")).where("n > 1")
    met = (lists.join(hubs, "key").where((F.col("doc_id") != F.col("hub.doc_id")) & _similar_sizes(F.col("n_shingles"), F.col("hub.n_shingles")))
           .groupBy(F.col("doc_id").alias("b"), F.col("hub.doc_id").alias("a")).agg(F.count("*").alias("hits")))
    return met.groupBy("b").agg(F.max_by("a", F.struct("hits", -F.col("a"))).alias("a")).select("a", "b")


def bridge_pairs(lists: DataFrame) -> DataFrame:
    """Step 2: per list, the smallest member of each component with that of the most frequent one."""
    per = lists.groupBy("key", "component_id").agg(F.min(F.struct("doc_id", "n_shingles")).alias("m"), F.count("*").alias("n"))
    major = per.groupBy("key").agg(F.max_by("m", F.struct("n", -F.col("component_id"))).alias("hub"))
    return (per.join(major, "key").where((F.col("m.doc_id") != F.col("hub.doc_id")) & _similar_sizes(F.col("m.n_shingles"), F.col("hub.n_shingles")))
            .select(F.least("m.doc_id", "hub.doc_id").alias("a"), F.greatest("m.doc_id", "hub.doc_id").alias("b")).distinct())


RARE = "doc_id long, component_id long, version long, n long, hashes array<long>, sketch array<long>"


def rare_shingles(members: DataFrame, texts: DataFrame) -> DataFrame:
    """``doc_id, component_id, n, sketch, key, place, short``: the prefix postings of ``members`` (``doc_id, component_id``).

    ``place`` counts a set's shingles by rising frequency, those of one component first; the
    first quarter (what a set of any size needs) is posted where another component has the
    shingle, ``short`` marks the seventh that suffices against sets of the same size or more.
    Versions of an id are sets of their own.
    """
    arrow_batches(members.sparkSession, 200)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            if len(words) > 1_000_000:
                words.clear()
            sets = [shingle_hashes(t, words) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("component_id"),
                pa.array(np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], dtype=np.uint64).view(np.int64)),
                pa.array([len(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                pa.array([_odd_sketch(s) for s in sets], pa.list_(pa.int64()))],
                ["doc_id", "component_id", "version", "n", "hashes", "sketch"])

    sets = materialize(members.join(texts, "doc_id").select("doc_id", "component_id", "text").mapInArrow(run, RARE), "minhash-sets")
    rows = sets.select("doc_id", "component_id", "version", "n", F.explode("hashes").alias("key"))
    shared = (rows.groupBy("key").agg(F.count("*").alias("times"), F.min("component_id").alias("lo"), F.max("component_id").alias("hi"))
              .where("lo <> hi").select("key", "times"))
    mine = (rows.join(shared, "key").groupBy("doc_id", "version", "n")  # at most a document's own shingles
            .agg(F.sort_array(F.collect_list(F.struct("times", "key"))).alias("found")))
    alone = F.col("n") - F.size("found")
    least = F.ceil(F.col("n") * PERCENT / F.lit(100))
    prefix = F.slice("found", 1, F.greatest(F.lit(0), F.col("n") - least + 1 - alone).cast("int"))
    posted = mine.select("doc_id", "version", "n", alone.alias("alone"), F.posexplode(prefix).alias("at", "p"))
    even = F.ceil(F.col("n") * (2 * PERCENT) / F.lit(100 + PERCENT))
    place = F.col("alone") + F.col("at")
    return (posted.select("doc_id", "version", F.col("p.key").alias("key"), place.alias("place"), (place < F.col("n") - even + 1).alias("short"))
            .join(sets.drop("hashes"), ["doc_id", "version"]).drop("version"))


def rest_pairs(lists: DataFrame, texts: DataFrame) -> DataFrame:
    """Step 3: all pairs of different components that share a contested list and may be similar enough.

    In a list of a shingle, members outside its largest component meet all of it, the
    others only those.  Sets with Jaccard 0.75 differ in at most a seventh of their sizes'
    sum, and share six sevenths of its half, of which none comes before the first common
    place.
    """
    several = lists.groupBy("key").agg(F.min("component_id").alias("lo"), F.max("component_id").alias("hi")).where("lo <> hi").select("key")
    members = lists.join(several, "key", "left_semi").select("doc_id", "component_id").distinct()
    posted = materialize(rare_shingles(members, texts), "minhash-rare")
    per = posted.groupBy("key", "component_id").agg(F.count("*").alias("m"), F.max(F.col("short").cast("int")).alias("short"))
    major = (per.groupBy("key").agg(F.max_by("component_id", F.struct("m", -F.col("component_id"))).alias("major"), F.count("*").alias("parts"),
                                    F.max("short").alias("some")).where("parts > 1 AND some = 1").select("key", "major"))
    rows = posted.join(major, "key").select(
        "key", "doc_id", "component_id", "n", "place", "short", (F.col("component_id") != F.col("major")).alias("minor"),
        *[F.get("sketch", F.lit(i)).alias(f"s{i}") for i in range(SKETCH)])
    rows = materialize(rows, "minhash-lists")
    large = rows.select(*[F.col(c).alias(f"x_{c}") for c in rows.columns])
    differ = sum((F.bit_count(F.col(f"s{i}").bitwiseXOR(F.col(f"x_s{i}"))) for i in range(SKETCH)), F.lit(0))
    total = F.col("n") + F.col("x_n")
    near = differ * (200 - (100 - PERCENT)) <= total * (100 - PERCENT)
    enough = F.least(F.col("n") - F.col("place"), F.col("x_n") - F.col("x_place")) * (100 + PERCENT) >= total * PERCENT
    smaller = (F.col("n") < F.col("x_n")) | ((F.col("n") == F.col("x_n")) & (F.col("doc_id") < F.col("x_doc_id")))
    meets = ((F.col("key") == F.col("x_key")) & (F.col("component_id") != F.col("x_component_id")) & smaller
             & _similar_sizes(F.col("n"), F.col("x_n")) & enough & near)
    met = (rows.where("short AND minor").join(large, meets).select("doc_id", "x_doc_id")
           .unionByName(rows.where("short AND NOT minor").join(large.where("x_minor"), meets).select("doc_id", "x_doc_id")))
    return met.select(F.least("doc_id", "x_doc_id").alias("a"), F.greatest("doc_id", "x_doc_id").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, set_size`` for every row.

    ``component_id`` is the smallest id reachable over links, ``kept`` marks that document,
    ``set_size`` counts the rows with the same set.  NULL and empty texts have no set and
    link with nothing.  Rows that share an id are versions of one document and always
    linked; rows without id take no part in links and come back with a NULL component,
    kept.  Whole texts are read, however long; equal sets are one class whatever their order
    of rows; other columns are ignored, whatever their names.  An empty table gives an empty
    result.
    """
    rows = materialize(features(docs, id_col, text_col), "minhash-features")
    full = rows.where("doc_id IS NOT NULL AND n_shingles > 0")
    by_set = full.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"), F.count("*").alias("set_size"))
    by_set = materialize(by_set, "minhash-sets")
    reps = by_set.select(F.col("rep").alias("doc_id"), "set_a", "set_b")
    classes = materialize(full.join(reps, ["doc_id", "set_a", "set_b"], "left_semi")
                          .dropDuplicates(["doc_id", "set_a", "set_b"]).select("doc_id", "n_shingles", "signature", "sketch"), "minhash-classes")
    lists = materialize(postings(classes), "minhash-postings")
    listed = lists.select("doc_id").distinct()
    texts = materialize(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
                        .join(listed, "doc_id", "left_semi").dropDuplicates(), "minhash-texts")
    edges = materialize(confirmed(matching(star_pairs(lists), classes), texts), "minhash-links")
    found = materialize(components(edges), "minhash-components")
    for step in (bridge_pairs, lambda x: rest_pairs(x, texts)):
        pairs = materialize(matching(step(_with_component(lists, found)), classes), "minhash-pairs")
        more = materialize(confirmed(pairs, texts), "minhash-links")
        if not more.isEmpty():
            edges = edges.unionByName(more)
            found = materialize(components(edges), "minhash-components")
    # Versions of one id may belong to several sets: their components meet at the id.
    ids = full.join(by_set, ["set_a", "set_b"]).select("doc_id", "rep", "set_size", "set_a", "set_b")
    shared = ids.where("doc_id <> rep").groupBy("doc_id").agg(F.collect_set("rep").alias("reps")).where("size(reps) > 1")
    joint = shared.select(F.col("doc_id").alias("b"), F.explode("reps").alias("a"))
    own = full.groupBy("doc_id").agg(F.count_distinct("set_a", "set_b").alias("sets")).where("sets > 1")
    versions = ids.join(own, "doc_id").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).where("a <> b").unionByName(joint)
    if not versions.isEmpty():
        found = materialize(components(edges.unionByName(versions.distinct())), "minhash-components")
    by_set = by_set.join(found.withColumnRenamed("doc_id", "rep"), "rep", "left")
    out = rows.join(by_set, ["set_a", "set_b"], "left")
    linked = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    component = F.when(linked, F.coalesce("component_id", "rep")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
                      F.when(linked, F.col("set_size")).otherwise(1).alias("set_size"))

"""Ranked lexical search of a set of items over all documents with two trees.

A document is a sparse vector of whole numbers, one coordinate per term of the items: the
term's weight times its damped frequency.  An item is the set of its terms, so a score is
the sum of the document's coordinates over the item's terms.  Documents are ordered by
their rarest term and length and cut into blocks; items are ordered by their rarest term
and cut into blocks.  Trees over the documents and the items of a block hold coordinate
maxima: for a pair of nodes, the product of the maxima bounds every score below, and where
it stays under the weakest k-th score of the node's items the whole batch is skipped.
Scores are exact, nothing else is left out: a batch at the bound itself is looked at, so
ties are kept.

1. One pass over the texts counts terms; only terms that may belong to an item go on (a
   bitmap of fixed size says which; a join then decides).
2. Each item is run against the blocks with the highest bounds: its k-th score there is a
   bound from below for all that follows.
3. Items and blocks whose bound reaches that score are paired before any vector moves, and
   a group of one item block and one document block walks both trees.

Handling: NULL and empty texts have no term and are not counted; texts are read whole.
Every row of the documents is a document, also where ids repeat; equal scores go by id,
rows without id last, then by any order.  Rows that repeat an item's id are one item with
the terms of all of them, so are rows without id.  Items without terms, or without a
document that holds one, have no rows.  Empty tables give an empty result.  Columns other
than id and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from buildlens.llm.common import arrow_batches
from buildlens.llm.vectors import numbered
from buildlens.sources.storage import materialize

TOP = 10
#: Rows of a block of documents, and of items, and of the leaves of their trees.
DOC_BLOCK = 2048
ITEM_BLOCK = 256
DOC_LEAF = 32
ITEM_LEAF = 8
#: Blocks per item that the first scores come from.
FIRST_BLOCKS = 2
#: Bits of the bitmap of item terms: 128 KiB whatever the number of items.
BITMAP_BITS = 1 << 20

#: Bytes that separate terms become a space, A-Z lower case; bytes of other alphabets stay.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """All terms of a UTF-8 text: runs of ASCII letters and digits and of other alphabets, A-Z lower-cased."""
    return text.translate(_TERMS).split()


class _Known(dict):
    """Whether a term's hash is in the bitmap, looked up once per term."""

    def __init__(self, bits: np.ndarray):
        super().__init__()
        self.bits = bits

    def __missing__(self, term: bytes) -> bool:
        self[term] = found = bool(self.bits[xxhash.xxh64_intdigest(term) % BITMAP_BITS])
        return found


def counted(rows: DataFrame, text: Column, carry: dict[str, Column], bits: np.ndarray | None = None) -> DataFrame:
    """``n``, the number of terms, and ``found``, the distinct ones with their counts (only those in the bitmap); with carried columns."""
    arrow_batches(rows.sparkSession)
    packed = None if bits is None else np.packbits(bits)
    names = list(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if packed is None else _Known(np.unpackbits(packed))
        for batch in batches:
            sizes, words, counts, ends = [], [], [], [0]
            if known is not None and len(known) > 1_000_000:
                known.clear()
            for value in batch.column("_text").to_pylist():
                found = terms(value or b"")
                sizes.append(len(found))
                for term, n in Counter(found).items():
                    if known is None or known[term]:
                        words.append(term)
                        counts.append(n)
                ends.append(len(words))
            entry = pa.StructArray.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())], ["term", "tf"])
            columns = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entry)],
                                             [*names, "n", "found"])

    kept = rows.select(*[c.alias(name) for name, c in carry.items()], text.cast("binary").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields if f.name != "_text")
    return kept.mapInArrow(run, f"{schema}, n long, found array<struct<term:string,tf:long>>")


def bitmap(words: DataFrame) -> np.ndarray:
    """Bits of all ``term`` values: a fixed size, gathered as at most ``BITMAP_BITS / 64`` words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(np.array([xxhash.xxh64_intdigest(t) % BITMAP_BITS for t in batch.column("term").cast(pa.binary()).to_pylist()], dtype=np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(at // 64, pa.int32()), pa.array(np.left_shift(np.int64(1), at % 64), pa.int64())], ["word", "bit"])

    found = words.select("term").mapInArrow(run, "word int, bit long").groupBy("word").agg(F.expr("bit_or(bit)").alias("bits")).collect()
    out = np.zeros(BITMAP_BITS // 64, dtype=np.int64)
    for r in found:
        out[r["word"]] = r["bits"]
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def vocabulary(item_terms: DataFrame, docs: DataFrame) -> DataFrame:
    """``term, tid, df, w`` of the items' terms that documents hold, and the totals N and L in every row."""
    total = docs.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
    df = docs.select(F.explode("found.term").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    share = (2 * F.lit(total["docs"]) + 2).cast("double") / (2 * F.col("df") + 1).cast("double")
    return (item_terms.select("term").distinct().join(df, "term")
            .withColumn("w", F.floor(F.lit(1000.0) * F.log(share)).cast("long"))
            .withColumn("docs", F.lit(total["docs"])).withColumn("length", F.lit(total["length"]))
            .withColumn("tid", F.monotonically_increasing_id()))


def vectors(docs: DataFrame, vocab: DataFrame) -> DataFrame:
    """``row, doc_id, size, rare, coords`` per document with a known term; ``rare`` is its rarest one."""
    m = F.expr("10 + CAST((CAST(90 AS DECIMAL(38,0)) * n * docs) div length AS BIGINT)")
    rows = docs.select("row", "doc_id", "n", F.explode("found").alias("f")).select("row", "doc_id", "n", F.col("f.term").alias("term"), F.col("f.tf").alias("tf"))
    hit = rows.join(vocab, "term").withColumn("m", m)
    hit = hit.withColumn("x", F.expr("w * ((1000000000 * tf) div (1000 * tf + 8 * m))"))
    return hit.groupBy("row", "doc_id", F.col("n").alias("size")).agg(F.min_by("tid", F.struct("df", "tid")).alias("rare"),
                                                 F.sort_array(F.collect_list(F.struct("tid", "x"))).alias("coords"))  # distinct terms of one document


class _Search:
    """One block of items against one block of documents, walked from both roots."""

    def __init__(self, items: pd.DataFrame, docs: pd.DataFrame, top: int):
        self.top = top
        self.items = items.sort_values(["rare", "item"]).reset_index(drop=True)
        docs = docs.sort_values(["rare", "size", "row"]).reset_index(drop=True)
        self.ids, self.rows = docs["doc_id"].tolist(), docs["row"].tolist()
        tids = np.unique(np.concatenate(self.items["tids"].to_list()))
        wanted = np.zeros((self._padded(len(self.items), ITEM_LEAF), len(tids)))
        for i, own in enumerate(self.items["tids"]):
            wanted[i, np.searchsorted(tids, own)] = 1
        sizes = docs["tids"].map(len).to_numpy()
        at, xs = np.concatenate(docs["tids"].to_list()), np.concatenate(docs["xs"].to_list())
        place = np.minimum(np.searchsorted(tids, at), len(tids) - 1)
        hit = tids[place] == at
        # Whole numbers below 2^53 are exact in doubles; larger sums are taken in 64-bit integers.
        largest = int(xs.max()) * max(map(len, self.items["tids"]))
        kind = np.float64 if largest < 1 << 53 else np.int64
        have = np.zeros((self._padded(len(docs), DOC_LEAF), len(tids)), dtype=kind)
        have[np.repeat(np.arange(len(docs)), sizes)[hit], place[hit]] = xs[hit]
        self.wanted, self.have = wanted.astype(kind), have
        self.item_tree, self.doc_tree = self._tree(self.wanted, ITEM_LEAF), self._tree(have, DOC_LEAF)
        self.least = np.concatenate([self.items["least"].to_numpy(dtype=np.int64), np.full(len(wanted) - len(self.items), np.iinfo(np.int64).max)])
        self.found: list[list[tuple]] = [[] for _ in range(len(self.items))]

    @staticmethod
    def _padded(n: int, leaf: int) -> int:
        return leaf << max(0, (-(-n // leaf) - 1).bit_length())

    @staticmethod
    def _tree(rows: np.ndarray, leaf: int) -> list[np.ndarray]:
        """Coordinate maxima per level, from the leaves to the root."""
        levels = [rows.reshape(-1, leaf, rows.shape[1]).max(axis=1)]
        while len(levels[-1]) > 1:
            levels.append(np.maximum(levels[-1][::2], levels[-1][1::2]))
        return levels

    def _weakest(self, level: int, node: int) -> int:
        width = ITEM_LEAF << level
        return self.least[node * width:(node + 1) * width].min()

    def run(self) -> list[tuple]:
        open_ = [(len(self.item_tree) - 1, 0, len(self.doc_tree) - 1, 0)]
        while open_:
            il, i, dl, d = open_.pop()
            bound = self.item_tree[il][i] @ self.doc_tree[dl][d]
            if bound <= 0 or bound < self._weakest(il, i):
                continue
            if il == 0 and dl == 0:
                self._score(i, d)
            elif dl >= il:  # the children with the higher bound are looked at first
                pair = [(self.item_tree[il][i] @ self.doc_tree[dl - 1][c], c) for c in (2 * d, 2 * d + 1)]
                open_ += [(il, i, dl - 1, c) for _, c in sorted(pair)]
            else:
                open_ += [(il - 1, 2 * i, dl, d), (il - 1, 2 * i + 1, dl, d)]
        return [(self.items["item"].iat[i], self.rows[d], self.ids[d], -negative) for i, own in enumerate(self.found) for negative, _, _, d in own]

    def _score(self, i: int, d: int) -> None:
        lo, at = i * ITEM_LEAF, d * DOC_LEAF
        scores = self.wanted[lo:lo + ITEM_LEAF] @ self.have[at:at + DOC_LEAF].T
        good = (scores > 0) & (scores >= self.least[lo:lo + ITEM_LEAF, None])
        for r in np.flatnonzero(good.any(axis=1)):
            own = self.found[lo + r]
            for c in np.flatnonzero(good[r]):
                key = self.ids[at + c]
                own.append((-int(scores[r, c]), key is None or key != key, 0 if key is None or key != key else key, at + c))
            own.sort()
            del own[self.top:]
            if len(own) == self.top:
                self.least[lo + r] = max(self.least[lo + r], -own[-1][0])


def _scored(pairs: DataFrame, items: DataFrame, docs: DataFrame, top: int) -> DataFrame:
    """``item, row, doc_id, score``: the best documents of each paired (item, document block) from that block."""
    keys = ["item_block", "block"]
    left = pairs.join(items, ["item", "item_block"])
    right = docs.join(pairs.select(F.col("item_block").alias("for_items"), "block").distinct(), "block").withColumnRenamed("block", "of_docs")

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = _Search(a, b, top).run() if len(a) and len(b) else []
        return pd.DataFrame({"item": pd.array([f[0] for f in found], "Int64"), "row": pd.array([f[1] for f in found], "Int64"),
                             "doc_id": pd.array([None if f[2] is None or f[2] != f[2] else int(f[2]) for f in found], "Int64"),
                             "score": pd.array([f[3] for f in found], "Int64")})

    return left.groupBy(*keys).cogroup(right.groupBy("for_items", "of_docs")).applyInPandas(run, "item long, row long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` documents of each item with a score above 0."""
    kind = items.schema[item_col].dataType
    asked = counted(items, F.col(item_text_col), {"item_id": F.col(item_col)}).select("item_id", F.explode("found.term").alias("term"))
    asked = materialize(asked.distinct(), "dual-asked")
    bits = bitmap(asked.select("term").distinct())
    read = materialize(counted(docs, F.col(text_col), {"doc_id": F.col(id_col).cast("long")}, bits).where("n > 0")
                       .withColumn("row", F.monotonically_increasing_id()), "dual-counted")
    vocab = materialize(vocabulary(asked, read), "dual-terms")
    whole, _ = numbered(vectors(read, vocab), [F.col(c) for c in ("rare", "size", "row")], DOC_BLOCK, "dual-vectors")
    docs_in = materialize(whole.select("block", "row", "doc_id", "size", "rare", F.col("coords.tid").alias("tids"), F.col("coords.x").alias("xs")), "dual-blocks")

    own = (asked.join(vocab.select("term", "tid", "df"), "term").groupBy("item_id")
           .agg(F.min_by("tid", F.struct("df", "tid")).alias("rare"), F.sort_array(F.collect_list("tid")).alias("tids"))  # terms of one item
           .withColumn("item", F.monotonically_increasing_id()))
    named = materialize(own, "dual-items")
    blocked, _ = numbered(named.select("item", "rare", "tids"), [F.col("rare"), F.col("item")], ITEM_BLOCK, "dual-item-order")
    blocked = materialize(blocked.withColumnRenamed("block", "item_block"), "dual-item-blocks")

    peaks = docs_in.select("block", F.explode(F.arrays_zip("tids", "xs")).alias("c")).groupBy("block", F.col("c.tids").alias("tid")).agg(F.max("c.xs").alias("x"))
    bounds = (blocked.select("item", "item_block", F.explode("tids").alias("tid")).join(peaks, "tid")
              .groupBy("item", "item_block", "block").agg(F.sum("x").alias("bound")))
    bounds = materialize(bounds.where("bound > 0"), "dual-bounds")

    order = Window.partitionBy("item").orderBy(F.desc("bound"), "block")
    first = bounds.withColumn("r", F.row_number().over(order)).where(F.col("r") <= FIRST_BLOCKS).select("item", "item_block", "block")
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "row")
    seen = _scored(first, blocked.withColumn("least", F.lit(0).cast("long")), docs_in, top)
    least = (seen.withColumn("r", F.row_number().over(best)).where(F.col("r") == top).select("item", F.col("score").alias("least")))
    least = blocked.join(materialize(least, "dual-least"), "item", "left").withColumn("least", F.coalesce("least", F.lit(0)).cast("long"))
    least = materialize(least, "dual-item-bounds")
    pairs = materialize(bounds.join(least.select("item", "least"), "item").where("bound >= least").select("item", "item_block", "block"), "dual-pairs")
    found = _scored(pairs, least, docs_in, top).withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= top)
    return found.join(named.select("item", F.col("item_id").cast(kind).alias("item_id")), "item").select("item_id", "rank", "doc_id", "score")

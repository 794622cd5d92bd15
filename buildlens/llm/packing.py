"""Best-fit packing of documents into sequences under token, document and attention-cost capacities.

A document is tokenised once and cut into pieces.  A piece is a vector (tokens, 1,
tokens squared); it goes to the open sequence whose residual vector has the smallest norm
after it, every part measured by its limit.  All parts follow from a piece's length, so
best fit over all pieces is decided on the counts per length, at most one per token of the
capacity, whatever the number of documents.  Equal pieces are placed in bulk, exactly as one at a time would be.
The resulting plan maps (length, rank among equals) to (sequence, offset); ranks come
from hashed slices of each length, so a frequent length is not ranked by one task.
"""

from __future__ import annotations

import functools
import json
import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from buildlens.llm.common import arrow_batches
from buildlens.sources.storage import materialize

#: Split of a text before merges; a fixed value of the vocabulary's family.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> id of a byte-level BPE file whose ids follow the merge order."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    return {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if all(c in byte for c in token) and not token.startswith("<|")}


#: Characters of a white-space run that the library's pattern engine surely walks in one go.
LONG_RUN = 100_000


def encode(encoding, library, text: str) -> list[int]:
    """Ids of a text; those with a very long run of white space, on which tiktoken's engine
    overflows its stack, are encoded by the tokenizer library, which gives the same ids."""
    if len(text) > LONG_RUN and any(m.end() - m.start() >= LONG_RUN for m in re.finditer(r"\s+", text)):
        return library().encode(text, add_special_tokens=False).ids
    return encoding.encode_ordinary(text)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first may be shorter than the capacity."""
    first = (n - 1) % capacity + 1
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def tokenize(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id",
             text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Pieces of every document: id, piece, start, length, ids_crc32 (and the ids, if kept).

    NULL text counts as empty, so every row gives at least the piece of its end id; a
    NULL id is carried along.  Strings of special tokens are ordinary text.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    ranks = spark.sparkContext.broadcast(byte_ranks(path))  # the vocabulary, one entry a token
    with open(path, encoding="utf-8") as f:
        tokenizer = spark.sparkContext.broadcast(f.read())  # the same for the library
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        @functools.cache
        def library():
            from tokenizers import Tokenizer

            made = Tokenizer.from_str(tokenizer.value)
            made.encode_special_tokens = True
            return made

        encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks.value, special_tokens={})
        for batch in batches:
            row, out, kept = [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = np.array(encode(encoding, library, text or "") + [end_id], dtype="<u4")
                for piece, (start, length) in enumerate(cut(len(ids), capacity)):
                    own = ids[start:start + length]
                    row.append(i)
                    out.append((piece, start, length, zlib.crc32(own.tobytes())))
                    kept.append(own.astype("int32") if keep_ids else None)
            found = np.array(out, dtype=np.int64).reshape(-1, 4)
            columns = [batch.column("id").take(pa.array(row, pa.int64())), pa.array(found[:, 0].astype(np.int32)), *[pa.array(found[:, k]) for k in (1, 2, 3)]]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.list_(pa.int32()))] * keep_ids, names + ["ids"] * keep_ids)

    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
            .withColumnRenamed("id", id_col))


@dataclass(frozen=True)
class Capacity:
    """What one sequence may hold, and how a bin is chosen for a piece."""

    tokens: int = 1024
    documents: int | None = None
    attention: int | None = None  # sum of squared lengths
    rule: str = "norm"  # smallest residual norm, or "dot": largest weighted dot product with the residual
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0)

    def limits(self) -> np.ndarray:
        """Limits of the vector (tokens, documents, squared lengths).  A part that is not limited has the
        most that the tokens allow, so its residual counts in the choice of a bin though it never binds."""
        documents = self.tokens if self.documents is None else self.documents
        attention = self.tokens ** 2 if self.attention is None else self.attention
        return np.array([self.tokens, min(documents, self.tokens), min(attention, self.tokens ** 2)], dtype=np.int64)


class _OpenBins:
    """Open bins by residual vector: a row per vector, with its runs (first bin, number) of bins."""

    def __init__(self):
        self.left = np.zeros((1024, 3), dtype=np.int64)  # all zero: a free row
        self.at: dict[tuple[int, ...], int] = {}
        self.runs: dict[int, list[tuple[int, int]]] = {}
        self.free = list(range(1024))

    def add(self, left: tuple[int, ...], first: int, number: int) -> None:
        row = self.at.get(left)
        if row is None:
            if not self.free:
                self.free = list(range(len(self.left), 2 * len(self.left)))
                self.left = np.vstack([self.left, np.zeros_like(self.left)])
            row = self.at[left] = self.free.pop()
            self.left[row], self.runs[row] = left, []
        self.runs[row].append((first, number))

    def take(self, row: int) -> tuple[tuple[int, ...], int, int]:
        """The last run of a row: residual vector, first bin, number."""
        left = tuple(self.left[row].tolist())
        first, number = self.runs[row].pop()
        if not self.runs[row]:
            del self.at[left], self.runs[row]
            self.left[row] = 0
            self.free.append(row)
        return left, first, number

    def fitting(self, vector: np.ndarray, score) -> np.ndarray:
        """Rows that hold the vector, best score first, ties to the smaller residual vector."""
        rows = np.flatnonzero((self.left >= vector).all(axis=1))
        left = self.left[rows]
        return rows[np.lexsort((left[:, 2], left[:, 1], left[:, 0], score(left)))]


def plan(counts: dict[int, int], capacity: Capacity) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Vector best fit, longest first, over ``length -> count``.

    Returns rows ``(length, first rank, number, first bin, pieces per bin, offset)``
    and the number of bins: piece ``first rank + i`` goes to bin ``first bin + i // per``
    at ``offset + i % per * length``.  Open bins of one residual vector form one class, and
    all three parts of the vector decide between classes, binding or not.  Under the norm
    rule a bin that got a piece has a smaller residual in every part, so it is the best for
    the next equal piece too: it takes as many as fit, and the order of the other classes
    stays.  Under the dot rule every bin of a class gets one piece before the classes are
    compared again.
    """
    limits = capacity.limits()
    weights = np.array(capacity.weights)
    bins_open = _OpenBins()
    least = min(counts, default=0)
    rows: list[tuple[int, int, int, int, int, int]] = []
    bins = 0
    for length in sorted(counts, reverse=True):
        vector = np.array([length, 1, length * length], dtype=np.int64)
        if (vector > limits).any():
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        parts = tuple(vector.tolist())
        left, rank = counts[length], 0

        def score(states: np.ndarray, vector=vector) -> np.ndarray:
            if capacity.rule == "dot":
                return -((vector / limits) * (states / limits)) @ weights
            return (((states - vector) / limits) ** 2) @ weights

        def fill(state: tuple[int, ...], first: int, number: int, per: int, parts=parts, length=length) -> None:
            """Put the next pieces into a run of bins; what is not used stays open."""
            nonlocal left, rank
            whole = min(number, left // per)
            rest = 1 if whole < number and left - whole * per > 0 else 0
            for n_bins, each, start in ((whole, per, first), (rest, left - whole * per, first + whole)):
                if n_bins:
                    taken = n_bins * each
                    rows.append((length, rank, taken, start, each, capacity.tokens - state[0]))
                    rank, left = rank + taken, left - taken
                    after = tuple(r - each * v for r, v in zip(state, parts, strict=True))
                    if after[0] >= least and after[1] and after[2] >= least * least:  # something may still fit
                        bins_open.add(after, start, n_bins)
            if number - whole - rest:
                bins_open.add(state, first + whole + rest, number - whole - rest)

        def per_bin(state: tuple[int, ...], parts=parts) -> int:
            return min(r // v for r, v in zip(state, parts, strict=True))

        while left:
            order = bins_open.fitting(vector, score)
            if not len(order):
                state = tuple(limits.tolist())
                per = per_bin(state)
                first, number = bins, -(-left // per)
                bins += number
                fill(state, first, number, per)
            for row in order.tolist() if capacity.rule == "norm" else order[:1].tolist():
                for _ in range(len(bins_open.runs[row]) if capacity.rule == "norm" else 1):
                    if left:
                        state, first, number = bins_open.take(row)
                        fill(state, first, number, per_bin(state) if capacity.rule == "norm" else 1)
    return rows, bins


def place(pieces: DataFrame, keys: list[str], capacity: Capacity | None = None) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a table of pieces with column ``length``.

    ``pieces`` must be written already (it is read three times); ``keys`` order equal
    lengths, fully equal rows are interchangeable.  An empty table stays empty.
    """
    capacity = capacity or Capacity()
    spark: SparkSession = pieces.sparkSession
    arrow_batches(spark, 10_000)
    counts = {r[0]: r[1] for r in pieces.groupBy("length").agg(F.count("*")).collect()}  # a row per length
    rows, _ = plan(counts, capacity)
    # A length's rows are ranked in about as many slices as a slice has rows.
    slices = F.lit([1 + math.isqrt(counts.get(n, 0)) for n in range(capacity.tokens + 1)])
    sliced = pieces.withColumn("__slice", F.pmod(F.xxhash64(*keys), F.get(slices, F.col("length").cast("int")).cast("long")))
    order = Window.partitionBy("length").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    before = (sliced.groupBy("length", "__slice").agg(F.count("*").alias("__n"))
              .select("length", "__slice", F.coalesce(F.sum("__n").over(order), F.lit(0)).alias("__before")))
    inner = Window.partitionBy("length", "__slice").orderBy(*keys)
    ranked = (sliced.withColumn("__in", F.row_number().over(inner)).join(before, ["length", "__slice"])
              .withColumn("__rank", F.col("__before") + F.col("__in") - 1).drop("__slice", "__in", "__before"))

    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 6)
    shared = spark.sparkContext.broadcast(table)  # a few rows per length and residual
    columns = pieces.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = shared.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "__rank"))
            at = np.empty(len(length), dtype=np.int64)
            for n in np.unique(length):
                mine = length == n
                lo, hi = np.searchsorted(step[:, 0], [n, n + 1])
                at[mine] = lo + np.searchsorted(step[lo:hi, 1], rank[mine], side="right") - 1
            within = rank - step[at, 1]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in columns] + [pa.array(step[at, 3] + within // step[at, 4]), pa.array(step[at, 5] + within % step[at, 4] * length)],
                [*columns, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return ranked.mapInArrow(run, schema)


def pack(docs: DataFrame, path: str, capacity: Capacity | None = None, end_id: int = 2, id_col: str = "doc_id",
         text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Tokenise, cut and place all documents; see ``tokenize`` and ``place``.

    NULL and empty texts give the piece of their end id; very long texts are cut into full
    pieces after a first one that may be shorter; pieces of equal length are placed in the
    order of id, piece and checksum, repeated rows are interchangeable; an empty table gives
    an empty result; other columns are ignored, whatever their names.
    """
    capacity = capacity or Capacity()
    limit = min([capacity.tokens] + ([math.isqrt(capacity.attention)] if capacity.attention is not None else []))
    pieces = materialize(tokenize(docs, path, limit, end_id, id_col, text_col, keep_ids), "pieces")
    return place(pieces, [id_col, "piece", "ids_crc32"], capacity)

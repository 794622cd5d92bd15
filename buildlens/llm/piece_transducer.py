"""SentencePiece encoding and decoding by a weighted transducer.

The transducer is the composition of three machines compiled from the model file: the
normaliser (space escaping, an added space at the start, removal of extra spaces), the
pieces (a path per piece from characters to its id) and the byte fallback (a path of byte
ids for a character no piece covers).  Encoding composes it with the input, which gives
a lattice over positions, and takes the shortest path in the tropical semiring (minimum
of sums).

Weights.  In a unigram model a piece costs minus its score.  In a BPE model the merges
decide: a sequence of pieces is the encoding exactly if every two neighbours are the
encoding of their own concatenation (a merge across a boundary would already happen
between the two).  So a state also remembers the last piece, an arc between neighbours
that are not such a pair costs infinity, every other arc 0, and the one path of finite
weight is the encoding.

No piece has a space after another character, so the lattice falls apart before every
run of spaces; each distinct part is solved once per task.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buildlens.llm.common import arrow_batches

# ---- fixed values: the model file's piece types, model types and its space symbol ----
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
SPACE = "▁"
#: A character that no piece covers costs this more than the worst piece (unigram models).
UNKNOWN_PENALTY = 10.0
# ---- end of fixed values ----
#: Solved parts that a task keeps.
MEMORY = 2_000_000


@dataclass
class Machine:
    """The compiled transducer."""

    pieces: dict[str, int]
    scores: list[float]
    texts: list[str]
    kinds: list[int]
    model_type: int
    unknown: int
    bytes_of: dict[int, int]
    add_space: bool
    trim: bool
    longest: int
    pairs: dict[tuple[int, int], bool] = field(default_factory=dict)
    prefixes: dict[str, int] = field(default_factory=dict)
    solved: dict[str, list[int]] = field(default_factory=dict)
    extra: dict[str, int] = field(default_factory=dict)
    extra_texts: list[str] = field(default_factory=lambda: [""])

    def __post_init__(self):
        """The pieces as a trie: every beginning of a piece, with its id where it is one, else -1."""
        for text in self.pieces:
            for n in range(1, len(text)):
                self.prefixes.setdefault(text[:n], -1)
        self.prefixes.update(self.pieces)

    def normalise(self, text: str) -> str:
        """Spaces escaped; one added in front of a text; extra ones removed if the model does."""
        if self.trim:
            text = " ".join(t for t in text.split(" ") if t)
        if not text:
            return ""
        return (SPACE if self.add_space else "") + text.replace(" ", SPACE)

    def arcs(self, part: str) -> list[list[tuple[int, int, tuple[int, ...]]]]:
        """The lattice of a part: per end position the arcs (start, piece or -1, ids written)."""
        ends: list[list[tuple[int, int, tuple[int, ...]]]] = [[] for _ in range(len(part) + 1)]
        pieces, longest = self.pieces, self.longest
        for i in range(len(part)):
            for j in range(i + 1, min(len(part), i + longest) + 1):
                piece = pieces.get(part[i:j])
                if piece is not None:
                    ends[j].append((i, piece, (piece,)))
            if part[i] not in pieces:
                ends[i + 1].append((i, -1, self.fallback(part[i])))
        return ends

    def fallback(self, char: str) -> tuple[int, ...]:
        """Ids of a character without a piece: its bytes, or the unknown id."""
        if self.bytes_of:
            return tuple(self.bytes_of[b] for b in char.encode("utf-8", "replace"))
        return (self.unknown,)

    def part(self, part: str) -> list[int]:
        """Ids on the shortest path through one part."""
        return self.merged(part) if self.model_type == BPE else self.cheapest(part)

    def cheapest(self, part: str) -> list[int]:
        """Shortest path with piece costs: one state per position."""
        ends = self.arcs(part)
        worst = -min(self.scores) + UNKNOWN_PENALTY
        cost, back = [0.0] + [math.inf] * len(part), [None] * (len(part) + 1)
        for j in range(1, len(part) + 1):
            for i, piece, ids in ends[j]:
                c = cost[i] + (worst if piece < 0 else self.cost(piece, j - i))
                if c < cost[j]:
                    cost[j], back[j] = c, (i, ids)
        return self.read(back, len(part))

    def cost(self, piece: int, length: int) -> float:
        return -0.1 * (length * max(self.scores) - 0.1) if self.kinds[piece] == USER_DEFINED else -self.scores[piece]

    def merged(self, part: str) -> list[int]:
        """The path of finite weight.  A prefix has one encoding, so each position has one state:
        its last piece, reached over the one arc whose two pieces join."""
        walk, known, n = self.prefixes.get, self.pairs.get, len(part)
        last: list[int | None] = [0] + [None] * n
        back = [0] * (n + 1)
        for i in range(n):
            before = last[i]
            j = i + 1
            piece = walk(part[i:j])
            if piece is None or piece < 0:  # a path of the trie may go on from a character without a piece
                if last[j] is None and (not i or self.join(before, self.uncovered(part[i]))):
                    last[j], back[j] = self.uncovered(part[i]), i
            while piece is not None:
                if piece >= 0 and last[j] is None:
                    fits = known((before, piece)) if i else True
                    if fits or fits is None and self.join(before, piece):
                        last[j], back[j] = piece, i
                j += 1
                if j > n:
                    break
                piece = walk(part[i:j])
        out: list[int] = []
        j = n
        while j:
            out.extend((last[j],) if last[j] >= 0 else reversed(self.fallback(self.extra_texts[-last[j]])))
            j = back[j]
        return out[::-1]

    def uncovered(self, char: str) -> int:
        """A negative number for a character without a piece, so that it can stand in pairs."""
        number = self.extra.get(char)
        if number is None:
            number = self.extra[char] = -len(self.extra_texts)
            self.extra_texts.append(char)
        return number

    def join(self, a: int, b: int) -> bool:
        """Whether the encoding of the two pieces' concatenation is the two pieces."""
        first, second = (self.texts[i] if i >= 0 else self.extra_texts[-i] for i in (a, b))
        fits = self.pairs[(a, b)] = self.merge(first + second) == [first, second]
        return fits

    def merge(self, text: str) -> list[str]:
        """Merges of a short text, best score first, leftmost among equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = -math.inf, -1
            for k in range(len(parts) - 1):
                piece = self.pieces.get(parts[k] + parts[k + 1])
                if piece is not None and self.scores[piece] > best:
                    best, at = self.scores[piece], k
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    @staticmethod
    def read(back: list, end: int) -> list[int]:
        out: list[int] = []
        while end:
            end, ids = back[end]
            out.extend(reversed(ids))
        return out[::-1]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text; none for a NULL or empty one."""
        normal = self.normalise(text or "")
        if len(self.solved) > MEMORY or len(self.pairs) > MEMORY:
            self.solved.clear()
            self.pairs.clear()
        out: list[int] = []
        for part in self.parts(normal):
            ids = self.solved.get(part)
            if ids is None:
                ids = self.solved[part] = self.part(part)
            out += ids
        return out

    @staticmethod
    def parts(normal: str) -> list[str]:
        """Cuts before every run of spaces: a run goes with the word after it."""
        words = normal.split(SPACE)
        out, run = [words[0]] if words[0] else [], 0
        for word in words[1:]:
            run += 1
            if word:
                out.append(SPACE * run + word)
                run = 0
        if run:
            out.append(SPACE * run)
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of the ids: bytes joined, spaces restored, the added one removed."""
        out, pending = [], bytearray()
        for i in ids:
            if self.kinds[i] == BYTE:
                pending.append(int(self.texts[i][3:5], 16))
                continue
            if pending:
                out.append(pending.decode("utf-8", "replace"))
                pending.clear()
            if self.kinds[i] != CONTROL:
                out.append(" ⁇ " if self.kinds[i] == UNKNOWN else self.texts[i])
        if pending:
            out.append(pending.decode("utf-8", "replace"))
        text = "".join(out).replace(SPACE, " ")
        return text[1:] if self.add_space and text.startswith(" ") else text


def compile_model(path: str) -> Machine:
    """Read a model file and compile its machines.

    Models that carry a character map beyond the identity, treat spaces as suffixes or
    have pieces with inner spaces are refused: their normaliser is not one of the above.
    """
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    spec, norm = model.trainer_spec, model.normalizer_spec
    if norm.precompiled_charsmap or spec.treat_whitespace_as_suffix or spec.model_type not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models with the identity character map are compiled")
    texts = [p.piece for p in model.pieces]
    kinds = [p.type for p in model.pieces]
    if any(SPACE in t.lstrip(SPACE) for t in texts):
        raise ValueError("a piece has a space after another character")
    usable = {t: i for i, (t, k) in enumerate(zip(texts, kinds, strict=True)) if k in (NORMAL, USER_DEFINED)}
    return Machine(usable, [p.score for p in model.pieces], texts, kinds, spec.model_type, spec.unk_id,
                   {int(t[3:5], 16): i for i, (t, k) in enumerate(zip(texts, kinds, strict=True)) if k == BYTE},
                   norm.add_dummy_prefix, norm.remove_extra_whitespaces, max(map(len, usable)))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids``: the encoding of every whole text; NULL and empty texts have no ids.

    Rows keep their (possibly NULL or repeated) id; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    arrow_batches(spark, 500)
    shared = spark.sparkContext.broadcast(compile_model(path))  # the vocabulary
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        for batch in batches:
            ids = [np.array(machine.encode(t), dtype=np.int32) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
            .mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col))


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text``: the text of every row's ids; NULL ids give an empty text."""
    spark = encoded.sparkSession
    arrow_batches(spark, 500)
    shared = spark.sparkContext.broadcast(compile_model(path))
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [shared.value.decode(i or []) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], ["id", "text"])

    return (encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
            .mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col))


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_ids, ids_crc32, restored``: digest of each encoding, and whether decoding gives the text back."""
    spark = docs.sparkSession
    arrow_batches(spark, 500)
    shared = spark.sparkContext.broadcast(compile_model(path))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        for batch in batches:
            n, crc, same = [], [], []
            for text in batch.column("text").to_pylist():
                ids = machine.encode(text)
                n.append(len(ids))
                crc.append(zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
                same.append(machine.decode(ids) == (text or ""))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())],
                                             ["id", "n_ids", "ids_crc32", "restored"])

    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
            .mapInArrow(run, f"id {kind}, n_ids long, ids_crc32 long, restored boolean").withColumnRenamed("id", id_col))

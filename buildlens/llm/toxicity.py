"""Toxic spans by a linear-chain conditional random field, aggregated to document scores.

Only documents are labelled, so tokens get labels from them: in a toxic training
document, the words (or word beginnings) that occur in toxic documents and hardly in
others are toxic tokens.  The field has two states and the chain of a sentence; its
emission is a sum of weights of the word's features (word, beginnings, ending), its
transitions are learned with it.  Forward-backward marginals give each
token's probability; the largest one, the expected number and the length give the
document's score through a logistic function fitted on other documents than the field.
"""

from __future__ import annotations

import itertools
import math
import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from buildlens.llm.common import arrow_batches, bounded_sample

#: Labelled rows of each label that the field and the document score are fitted on.
TRAIN_ROWS = 3000
#: Part of them that only fits the document score.
CALIBRATION = 0.35
ROUNDS = 40
#: Chains that are walked together as arrays; fewer are walked one by one.
TOGETHER = 8
THRESHOLD = 0.7
#: A token is an offending one from this marginal on.
SPAN = 0.5
#: Token labels: least factor between a mark's rates in toxic and other documents, and how far the
#: log likelihood ratio must exceed the logarithm of the number of candidates tried.
LEAST_LIFT = 8.0
CERTAINTY = 3.0
_TOKEN = re.compile(r"[^\W\d_]+|[.!?\n]")
_WORD = re.compile(r"[^\W\d_]+")
_ENDS = frozenset(".!?\n")


def _stems(word: str) -> list[str]:
    return ["=" + word] + [word[:n] for n in range(4, min(len(word), 7))]


def _features(word: str) -> list[str]:
    return ["=" + word, "$" + word[-3:]] + [word[:n] for n in range(3, min(len(word), 7) + 1)]


class _Emissions(dict):
    """Emission of a word: the sum of its features' weights, computed once; none for a sentence's end."""

    def __init__(self, weight: dict[str, float]):
        super().__init__()
        self.weight = weight

    def __missing__(self, word: str) -> float:
        if word in _ENDS:
            e = math.nan
        else:
            get = self.weight.get
            e = sum(get(f, 0.0) for f in _features(word))
        self[word] = e
        return e


def tokens(text: str | None) -> list[str]:
    """Lower-cased words and sentence ends of the whole text."""
    return _TOKEN.findall(text.lower()) if text else []


def chains(is_end: np.ndarray, document: np.ndarray) -> np.ndarray:
    """Lengths of the chains of the words, from flags of sentence ends and document numbers per token.

    A chain is a whole sentence, however long."""
    words = np.flatnonzero(~is_end)
    sentence = np.cumsum(is_end)[words]
    new = np.ones(len(words), dtype=bool)
    new[1:] = (np.diff(sentence) > 0) | (np.diff(document[words]) > 0)
    return np.diff(np.append(np.flatnonzero(new), len(words)))


def marginals(emission: np.ndarray, lengths: np.ndarray, start: np.ndarray, step: np.ndarray,
              moves: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """Probability of state 1 at each token, and (if wanted) the chains' expected transition counts.

    ``emission`` holds the score of state 1 over state 0, chain after chain; all chains
    advance together, longest first, and the last few long ones alone.
    """
    order = np.argsort(-lengths, kind="stable")
    first = (np.cumsum(lengths) - lengths)[order]
    sizes = lengths[order]
    joint = int(sizes[min(TOGETHER, len(sizes)) - 1]) if len(sizes) else 0  # up to here that many chains go on
    active = np.searchsorted(-sizes, -np.arange(1, joint + 1), side="right")  # chains longer than t
    # One odds ratio per token carries the two normalised states.
    (m00, m01), (m10, m11) = np.exp(step).tolist()
    odds = np.exp(np.clip(emission, -40, 40))
    forward = np.empty_like(odds)  # state 1 over state 0 given the tokens so far
    backward = np.ones_like(odds)
    for t in range(joint):
        at = first[:active[t]] + t
        if t == 0:
            forward[at] = odds[at] * math.exp(start[1] - start[0])
        else:
            r = forward[at - 1]
            forward[at] = odds[at] * (m01 + r * m11) / (m00 + r * m10)
    for f, n in zip(first[:TOGETHER].tolist(), sizes[:TOGETHER].tolist(), strict=True):
        if n <= joint:
            break
        tail = odds[f + joint:f + n].tolist()
        r, ahead = forward[f + joint - 1], []
        for o in tail:
            r = o * (m01 + r * m11) / (m00 + r * m10)
            ahead.append(r)
        forward[f + joint:f + n] = ahead
        r, behind = 1.0, []
        for o in reversed(tail):
            r = (m10 + o * r * m11) / (m00 + o * r * m01)
            behind.append(r)
        backward[f + joint - 1:f + n - 1] = behind[::-1]
    for t in range(joint - 2, -1, -1):
        at = first[:active[t + 1]] + t
        r = odds[at + 1] * backward[at + 1]
        backward[at] = (m10 + r * m11) / (m00 + r * m01)
    both = forward * backward
    p = both / (1 + both)
    if not moves:
        return p, None
    inner = np.ones(len(odds), dtype=bool)  # tokens with another one of their chain after them
    inner[first + sizes - 1] = False
    inner = np.flatnonzero(inner)
    f, r = forward[inner], odds[inner + 1] * backward[inner + 1]
    pair = np.stack([np.full_like(f, m00), m01 * r, m10 * f, m11 * f * r], axis=1).reshape(-1, 2, 2)
    pair /= pair.sum(axis=(1, 2), keepdims=True)
    return p, pair.sum(axis=0)


@dataclass
class Model:
    weight: dict[str, float]
    start: np.ndarray
    step: np.ndarray
    document: np.ndarray  # logistic weights of the document features and a constant

    def marginals(self, texts: list[str | None], emissions: _Emissions) -> list[np.ndarray]:
        """Marginals of the words of each text."""
        found = [tokens(t) for t in texts]
        sizes = np.array([len(f) for f in found], dtype=np.int64)
        values = np.fromiter((e for f in found for e in map(emissions.__getitem__, f)), dtype=float, count=int(sizes.sum()))
        document = np.repeat(np.arange(len(found)), sizes)
        end = np.isnan(values)
        p, _ = marginals(values[~end], chains(end, document), self.start, self.step, moves=False)
        return np.split(p, np.cumsum(np.bincount(document[~end], minlength=len(found)))[:-1]) if found else []

    def documents(self, texts: list[str | None], emissions: _Emissions) -> tuple[np.ndarray, list[np.ndarray]]:
        """Score of each text, and the marginals of its words in order."""
        parts = self.marginals(texts, emissions)
        x = np.array([document_features(part) for part in parts]).reshape(-1, 4)
        return 1 / (1 + np.exp(-np.clip(x @ self.document, -30, 30))), parts


def document_features(p: np.ndarray) -> list[float]:
    """Log odds of the likeliest token, expected number of toxic tokens, length; 1."""
    top = float(p.max()) if len(p) else 0.0
    top = min(max(top, 1e-6), 1 - 1e-6)
    return [math.log(top / (1 - top)), math.log1p(float(p[p > 0.2].sum())), math.log1p(len(p)) / 5, 1.0]


def token_labels(docs: list[tuple[list[str], int]]) -> set[str]:
    """Words and beginnings that mark toxic documents, counted once per distinct sentence
    of either label, so that copies of a document are no evidence."""
    seen = {0: Counter(), 1: Counter()}
    known: set[tuple[int, tuple[str, ...]]] = set()
    for found, y in docs:
        cuts = [-1, *(i for i, w in enumerate(found) if w in _ENDS), len(found)]
        for a, b in itertools.pairwise(cuts):
            sentence = (y, tuple(found[a + 1:b]))
            if sentence[1] and sentence not in known:
                known.add(sentence)
                seen[y].update({stem for w in set(sentence[1]) for stem in _stems(w)})
    rows = Counter(y for y, _ in known)
    base = rows[1] / max(rows[0] + rows[1], 1)
    if not 0 < base < 1:
        return set()
    certain = math.log(max(len(seen[1]), 1)) + CERTAINTY

    def marks(key: str, n: int) -> bool:
        clean = seen[0][key]
        share = n / (n + clean)
        surprise = n * math.log(share / base) + (clean * math.log((1 - share) / (1 - base)) if clean else 0.0)
        return share > base and surprise >= certain and n / rows[1] >= LEAST_LIFT * (clean + 0.5) / rows[0]

    return {k for k, n in seen[1].items() if marks(k, n)}


def fit_rows(texts: list[str], labels: list[int]) -> Model:
    """Fit field and document score on the given rows."""
    docs = [(tokens(t), y) for t, y in zip(texts, labels, strict=True)]
    cut = int(len(docs) * (1 - CALIBRATION)) if len(docs) >= 10 else len(docs)
    marks = token_labels(docs[:cut])
    tag_of: dict[str, int] = {}
    rng = np.random.default_rng(7)
    words: list[str] = []
    tags, lengths = [], []
    for found, y in docs[:cut]:
        end = np.array([w in _ENDS for w in found], dtype=bool)
        own = [w for w in found if w not in _ENDS]
        for w in own:
            if w not in tag_of:
                tag_of[w] = int(any(k in marks for k in _stems(w)))
        at = 0
        for n in chains(end, np.zeros(len(found), dtype=np.int64)).tolist() if found else []:
            tag = [y * tag_of[w] for w in own[at:at + n]]
            if any(tag) or (not y and rng.random() < 0.15):
                words += own[at:at + n]
                tags += tag
                lengths.append(n)
            at += n
    model = Model({}, np.zeros(2), np.zeros((2, 2)), np.zeros(4))
    if words:
        _fit_field(model, words, np.array(tags), np.array(lengths, dtype=np.int64))
    rest = list(range(cut, len(docs))) or list(range(len(docs)))
    emissions = _Emissions(model.weight)
    a = np.array([document_features(p) for i in range(0, len(rest), 500)
                  for p in model.marginals([texts[k] for k in rest[i:i + 500]], emissions)]).reshape(-1, 4)
    y = np.array([labels[k] for k in rest], dtype=float)
    for _ in range(50):  # Newton steps of a ridge logistic regression
        q = 1 / (1 + np.exp(-np.clip(a @ model.document, -30, 30)))
        pull = np.diag([0.05, 0.05, 0.05, 1e-3])
        hessian = (a * (q * (1 - q))[:, None]).T @ a + pull
        model.document = model.document - np.linalg.solve(hessian, a.T @ (q - y) + pull @ model.document)
    return model


def _fit_field(model: Model, words: list[str], tag: np.ndarray, lengths: np.ndarray) -> None:
    """Weights of the field that make the tags likely: full-batch steps with an adaptive rate."""
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(words))}
    names: dict[str, int] = {}
    feats = [[names.setdefault(f, len(names)) for f in _features(w)] for w in vocabulary]
    owner = np.repeat(np.arange(len(feats)), [len(f) for f in feats])
    flat = np.array([i for f in feats for i in f], dtype=np.int64)
    token = np.array([vocabulary[w] for w in words], dtype=np.int64)
    weight, start, step = np.zeros(len(names)), model.start, model.step
    history, past = np.full(len(names), 1e-6), np.full((3, 2), 1e-6)
    firsts = np.cumsum(lengths) - lengths
    inner = np.ones(len(token), dtype=bool)
    inner[firsts] = False
    seen = np.bincount(tag[np.flatnonzero(inner) - 1] * 2 + tag[inner], minlength=4).reshape(2, 2)
    begun = np.bincount(tag[firsts], minlength=2)
    for _ in range(ROUNDS):
        p, moves = marginals(np.bincount(owner, weight[flat], minlength=len(feats))[token], lengths, start, step)
        word = np.bincount(token, p - tag, minlength=len(feats))
        grad = np.bincount(flat, word[owner], minlength=len(names)) + 0.05 * weight
        history += grad ** 2
        weight -= 0.3 * grad / np.sqrt(history)
        first = p[firsts].sum()
        change = np.vstack([moves - seen, [len(lengths) - first - begun[0], first - begun[1]]]) + 0.05 * np.vstack([step, start])
        past += change ** 2
        step = step - 0.1 * change[:2] / np.sqrt(past[:2])
        start = start - 0.1 * change[2] / np.sqrt(past[2])
    model.weight = {n: float(weight[i]) for n, i in names.items() if abs(weight[i]) > 1e-3}
    model.start, model.step = start, step


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        per_label: int = TRAIN_ROWS) -> Model:
    """Fit on at most ``per_label`` rows of each label, those with the smallest hashes.

    A document counts as toxic if any of its label rows does; labels other than 0 and 1
    and documents without text are left out.  Without labelled rows every score is 0.5.
    """
    marked = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
              .where("id IS NOT NULL AND y IN (0, 1)").groupBy("id").agg(F.max("y").alias("y")))
    # Labels are drawn before the texts are met; the limit holds again where an id has many rows.
    drawn = F.broadcast(bounded_sample(marked, "y", per_label, ["id"]))  # at most 2 * per_label ids
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.length("text") > 0).join(drawn, "id")
    order = Window.partitionBy("y").orderBy(F.xxhash64("id", "text"), "id", "text")
    sample = rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_label).select("y", "text")

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values(["text", "y"]).sample(frac=1, random_state=5)
        return pd.DataFrame({"model": [pickle.dumps(fit_rows(batch["text"].tolist(), batch["y"].tolist()).__dict__)]})

    found = sample.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(run, "model binary").collect()
    if not found:
        return Model({}, np.zeros(2), np.zeros((2, 2)), np.zeros(4))
    return Model(**pickle.loads(found[0][0]))


SPANS = "array<struct<start:int,end:int,probability:double>>"
SPAN_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))


def _original(text: str) -> list[int] | None:
    """Place in the text of each character of its lower-cased form; none where both have the same length."""
    if len(text.lower()) == len(text):
        return None
    return [i for i, c in enumerate(text) for _ in c.lower()]


def offending(text: str | None, p: np.ndarray) -> list[dict]:
    """Character offsets, in the text itself, of the words whose marginal reaches ``SPAN``."""
    hot = np.flatnonzero(p >= SPAN)
    if not len(hot):
        return []
    places = [m.span() for m in _WORD.finditer(text.lower())]
    at = _original(text)
    spans = [places[i] if at is None else (at[places[i][0]], at[places[i][1] - 1] + 1) for i in hot]
    return [{"start": a, "end": b, "probability": float(p[i])} for (a, b), i in zip(spans, hot, strict=True)]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, predicted, spans``: spans are the offending words' character offsets.

    The whole text is read; a sentence is one chain however long, so a text without a sentence
    end costs time in proportion to its length.  NULL and empty texts get the score of a
    text without words and no span.  Rows keep their (possibly NULL or repeated) id, equal
    texts get equal scores, an empty table gives an empty result.  Offsets are those of the
    text itself, also where lower case is longer.  Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    arrow_batches(spark, 500)
    shared = spark.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        emissions = _Emissions(own.weight)
        for batch in batches:
            if len(emissions) > 1_000_000:
                emissions.clear()
            texts = batch.column("text").to_pylist()
            scores, parts = own.documents(texts, emissions)
            spans = [offending(t, p) for t, p in zip(texts, parts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(scores, pa.float64()), pa.array((scores >= THRESHOLD).astype(np.int32)), pa.array(spans, SPAN_TYPE)],
                ["id", "score", "predicted", "spans"])

    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
            .mapInArrow(run, f"id {kind}, score double, predicted int, spans {SPANS}").withColumnRenamed("id", id_col))


def filter_rows(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows that score below the threshold, all columns as they are."""
    arrow_batches(docs.sparkSession, 500)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emissions = _Emissions(shared.value.weight)
        for batch in batches:
            if len(emissions) > 1_000_000:
                emissions.clear()
            scores, _ = shared.value.documents(batch.column(text_col).to_pylist(), emissions)
            yield batch.filter(pa.array(scores < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)

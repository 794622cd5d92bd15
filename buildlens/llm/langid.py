"""Language ID by error-correcting output codes over binary character n-gram classifiers.

Each language has a codeword of bits; one logistic classifier over hashed character
n-grams (orders 1 to 4) predicts each bit.  A text's language is the codeword with the
least loss, each bit weighted by how well its classifier did on rows kept from it; a
close second makes the prediction ambiguous.  Up to ``EXHAUSTIVE`` languages the code has
every split of the languages, beyond that random dense splits.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buildlens.llm.common import arrow_batches, bounded_sample

#: Rows of each language that the classifiers are fitted on; all of them if there are fewer.
TRAIN_ROWS = 400
#: Hash buckets of the n-grams, and the orders.
BUCKETS = 1 << 13
ORDERS = (1, 2, 3, 4)
EXHAUSTIVE = 5
ROUNDS = 300
#: A prediction is ambiguous below this margin between the two best codewords' mean losses.
MARGIN = 0.5
UNDETERMINED = "und"


def codewords(n: int) -> np.ndarray:
    """(n, bits) of -1 and 1: all splits of few languages, random splits of many; rows and columns differ."""
    if n == 1:
        return np.ones((1, 1))
    if n <= EXHAUSTIVE:
        splits = range(1, 1 << (n - 1))  # the last language is always on the negative side
        return np.array([[1.0 if s >> i & 1 else -1.0 for s in splits] for i in range(n)])
    rng = np.random.default_rng(5)
    bits = max(15, math.ceil(10 * math.log2(n)))
    best, apart = None, -1
    for _ in range(200):  # the draw with the largest least distance between codewords
        code = np.where(rng.random((n, bits)) < 0.5, -1.0, 1.0)
        gram = code @ code.T - 2 * bits * np.eye(n)
        distance = (bits - gram.max()) / 2
        if distance > apart and (np.abs(code.sum(axis=0)) < n).all():
            best, apart = code, distance
    return best


def ngram_buckets(text: str) -> np.ndarray:
    """Bucket of every n-gram of the whole text; what is no letter counts as one separator."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    letter = _letters(points)
    code = np.where(letter, points, np.uint32(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one separator after each run of letters
    code = np.concatenate([[np.uint32(32)], code[keep], [np.uint32(32)]]).astype(np.uint32)
    h, out = np.zeros(len(code), dtype=np.uint32), []
    for order in range(1, max(ORDERS) + 1):
        h = (h[:len(code) - order + 1] ^ code[order - 1:]) * np.uint32(0x9E3779B1)
        h = h ^ (h >> np.uint32(15))
        if order in ORDERS:
            out.append((h * np.uint32(0x85EBCA77 + 2 * order)) >> np.uint32(32 - BUCKETS.bit_length() + 1))
        if len(h) <= 1:
            break
    return np.concatenate(out)


_TABLE: dict[str, np.ndarray] = {}


def _letters(points: np.ndarray) -> np.ndarray:
    if "letters" not in _TABLE:
        _TABLE["letters"] = np.array([chr(c).isalpha() for c in range(1 << 16)])
    return np.where(points < 1 << 16, _TABLE["letters"][points & 0xFFFF], True)


@dataclass
class Model:
    """Bit classifiers (buckets x bits), their weights in decoding, and the codewords."""

    languages: list[str]
    code: np.ndarray
    weight: np.ndarray
    bias: np.ndarray
    trust: np.ndarray
    temperature: float = 1.0

    def margins(self, text: str) -> np.ndarray:
        """Value of each bit classifier for the mean of the text's n-grams."""
        return self.weight[ngram_buckets(text)].mean(axis=0) + self.bias

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """Weighted mean logistic loss of the bits under each codeword."""
        return (np.logaddexp(0, -self.code * margins) * self.trust).sum(axis=1) / self.trust.sum()

    def decode(self, margins: np.ndarray) -> tuple[str, float, float]:
        """Language, score, and margin to the next codeword."""
        loss = self.losses(margins)
        order = np.argsort(loss, kind="stable")
        share = np.exp(-(loss - loss.min()) / self.temperature)
        gap = loss[order[1]] - loss[order[0]] if len(order) > 1 else math.log(2)
        return self.languages[order[0]], float(share[order[0]] / share.sum()), float(gap)


def fit_rows(texts: list[str], langs: list[str]) -> Model:
    """Fit on the given rows: full-batch logistic regression; every fifth row only weighs the bits."""
    languages = sorted(set(langs))
    code = codewords(len(languages))
    rng = np.random.default_rng(11)
    own = np.array([languages.index(x) for x in langs])
    rows, owner, kept = [], [], []
    for i, text in enumerate(texts):
        cuts = [text]
        if len(text) > 200:  # short passages too, so that short texts are met in training
            at = int(rng.integers(len(text) - 100))
            cuts.append(text[at:at + int(rng.integers(20, 100))])
        for c in cuts:
            buckets = ngram_buckets(c)
            rows.append(np.bincount(buckets, minlength=BUCKETS).astype(np.float32) / len(buckets))
            owner.append(own[i])
            kept.append(i % 5 == 4)
    x, y, kept = np.array(rows), code[np.array(owner)].astype(np.float32), np.array(kept)
    if len(languages) == 1 or kept.all():
        return Model(languages, code, np.zeros((BUCKETS, code.shape[1])), np.ones(code.shape[1]), np.ones(code.shape[1]))
    spread = np.sqrt((x[~kept] ** 2).mean(axis=0)) + 1e-4
    a, b = x[~kept] / spread, y[~kept]
    weight, bias = np.zeros((BUCKETS, b.shape[1]), dtype=np.float32), np.zeros(b.shape[1], dtype=np.float32)
    history = np.full_like(weight, 1e-8)
    for _ in range(ROUNDS):
        slope = -b / (1 + np.exp(np.clip(b * (a @ weight + bias), -30, 30))) / len(a)
        grad = a.T @ slope + 1e-6 * weight
        history += grad * grad
        weight -= 0.05 * grad / np.sqrt(history)
        bias -= slope.mean(axis=0) * len(a) * 0.05
    weight = weight / spread[:, None]
    test = x[kept] @ weight + bias if kept.any() else x @ weight + bias
    right = (np.sign(test) == (y[kept] if kept.any() else y)).mean(axis=0)
    model = Model(languages, code, weight.astype(np.float32), bias, np.maximum(right - 0.5, 1e-3) * 2)
    if kept.any():  # the temperature under which the kept rows are likeliest
        loss = np.array([model.losses(m) for m in test])
        truth = np.array(owner)[kept]
        cost = {t: (loss[np.arange(len(loss)), truth] / t + np.log(np.exp(-loss / t).sum(axis=1))).mean() for t in 2.0 ** np.arange(-3, 6)}
        model.temperature = float(min(cost, key=cost.get))
    return model


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id",
        per_language: int = TRAIN_ROWS) -> Model | None:
    """Fit on at most ``per_language`` rows of each language, those with the smallest hashes.

    Rows without language, text or letter take no part; None if no row is left.  The one
    task that fits sees ``languages * per_language`` rows.
    """
    rows = (docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id"))
            .where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")))
    sample = bounded_sample(rows, "lang", per_language, ["id", "text"]).select("lang", "text")

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values(["text", "lang"]).sample(frac=1, random_state=3)
        return pd.DataFrame({"model": [pickle.dumps(fit_rows(batch["text"].tolist(), batch["lang"].tolist()).__dict__)]})

    found = sample.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(run, "model binary").collect()  # one row, BUCKETS x bits floats
    return Model(**pickle.loads(found[0][0])) if found else None


def decide(model: Model | None, texts: list[str | None]) -> tuple[list[str], list[float], list[float], list[bool]]:
    """Language, score, margin and ambiguity of each text."""
    out = [(UNDETERMINED, 0.0, 0.0, True) if model is None or not t or not any(map(str.isalpha, t)) else (*(d := model.decode(model.margins(t))), d[2] < MARGIN)
           for t in texts]
    return tuple(map(list, zip(*out, strict=True))) if out else ([], [], [], [])


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, margin, ambiguous`` of every row, from its whole text alone.

    NULL, empty and letterless texts are undetermined with score 0, as are all texts
    without a model.  Ties go to the first language by name.  Rows keep their (possibly
    NULL or repeated) id; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score, gap, close = decide(shared.value, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(gap, pa.float64()), pa.array(close, pa.bool_())],
                ["id", "lang_pred", "score", "margin", "ambiguous"])

    schema = f"id {kind}, lang_pred string, score double, margin double, ambiguous boolean"
    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
            .withColumnRenamed("id", id_col))


def filter_rows(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows whose language is determined and not ambiguous, all columns as they are."""
    arrow_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, _, _, close = decide(shared.value, batch.column(text_col).to_pylist())
            yield batch.filter(pa.array([x != UNDETERMINED and not c for x, c in zip(lang, close, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

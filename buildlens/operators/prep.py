"""Column alignment, imputation, scaling and exact percentiles.

Statistics are single aggregations with map-side combine.  What reaches the
driver is one row of numbers per column, whatever the size of the table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from buildlens.functions.numbers import round_to
from buildlens.functions import rules


def align_features(df: DataFrame, names: list[str] = rules.FEATURE_NAMES) -> tuple[list[str], list[str]]:
    """Available and missing features, in model order."""
    return [n for n in names if n in df.columns], [n for n in names if n not in df.columns]


def require_features(df: DataFrame, names: list[str] = rules.FEATURE_NAMES) -> DataFrame:
    """Reject a table that lacks a feature (uploaded training data)."""
    missing = align_features(df, names)[1]
    if missing:
        raise ValueError(f"missing required columns: {missing}; provided: {df.columns}")
    return df


def alignment_report(training: DataFrame, names: list[str] = rules.FEATURE_NAMES,
                     not_features: tuple[str, ...] = ("build_id", "label", "timestamp", "repository", "branch")) -> DataFrame:
    """One row per column of the training table or the model: where it is and how many values it has."""
    trained = [c for c in training.columns if c not in not_features]
    entries = [F.struct(F.lit(c).alias("feature"), F.lit(c in trained).alias("in_training"), F.lit(c in names).alias("in_model"),
                        (F.count(c) if c in trained else F.lit(0).cast("bigint")).alias("n_values"))
               for c in dict.fromkeys([*trained, *names])]
    return training.agg(F.array(*entries).alias("_e")).select(F.explode("_e").alias("e")).select("e.*")


def _value(name: str) -> Column:
    v = F.col(name).cast("double")
    return F.when(~F.isnan(v), v)


#: Rows of a bracket that one task may walk, and buckets of a bracket in a round of narrowing.
WALKED = 200_000
SLOTS = 1024


def _narrowed(df: DataFrame, brackets: list[tuple], times: Column, walked: int) -> list[tuple]:
    """Brackets cut down by rounds of histograms until each holds few rows or a single value.

    A round counts the weight below each bracket and in its ``SLOTS`` equal parts, for all
    brackets at once, and keeps the parts with the two wanted ranks, with their own least and
    largest value.  The driver sees at most ``SLOTS`` counts a bracket.  A part is a 1024th
    of its bracket, so the rounds are few.
    """
    done = [False] * len(brackets)
    while not all(done):
        open_ = [k for k, ready in enumerate(done) if not ready]
        below = df.agg(*[F.coalesce(F.sum(F.when(_value(brackets[k][0]) < brackets[k][5], times)), F.lit(0)).alias(f"b{k}") for k in open_]).first()
        parts = []
        for k in open_:
            n, lo, hi = brackets[k][0], float(brackets[k][5]), float(brackets[k][6])
            v, width = _value(n), hi / 2 - lo / 2
            slot = F.least(F.floor((v / 2 - lo / 2) / width * SLOTS), F.lit(SLOTS - 1)) if width > 0 else F.lit(0)
            parts.append(F.when(v.between(lo, hi), F.struct(F.lit(k).alias("k"), slot.cast("int").alias("slot"), v.alias("v"))))
        counts = df.select(times.alias("_w"), F.explode(F.array_compact(F.array(*parts))).alias("e")) \
            .groupBy(F.col("e.k").alias("k"), F.col("e.slot").alias("slot")) \
            .agg(F.sum("_w").alias("w"), F.count(F.lit(1)).alias("rows"), F.min("e.v").alias("lo"), F.max("e.v").alias("hi")).collect()
        for k in open_:
            n, i, r, part, r2, lo, hi = brackets[k]
            slots = sorted((c for c in counts if c["k"] == k), key=lambda c: c["slot"])
            if sum(c["rows"] for c in slots) <= walked:
                done[k] = True
                continue
            upto, ends = below[f"b{k}"], []
            for c in slots:
                ends.append((upto, upto := upto + c["w"], c))
            first = next((c for start, end, c in ends if start <= r < end), None)
            last = next((c for start, end, c in ends if start <= r2 < end), None)
            if first is None or last is None:
                done[k] = True  # the ranks lie outside: the caller looks again
                continue
            # Neighbouring ranks in two parts are the end of one and the beginning of the other.
            bounds = (first["lo"], first["hi"]) if first is last else (first["hi"], last["lo"])
            done[k] = bounds == (lo, hi) or first is not last
            brackets[k] = (n, i, r, part, r2, *bounds)
    return brackets


def exact_percentiles(df: DataFrame, names: list[str], fractions: list[float],
                      accuracy: int = 10_000, weight: str | None = None, walked: int = WALKED) -> dict[str, list[float | None]]:
    """Exact interpolated percentiles without gathering the values in one task.

    First an approximate sketch brackets each percentile, histograms narrow brackets of more
    than ``walked`` rows, then only the distinct values inside are counted and walked in order.  A row stands for ``weight`` equal ones; for the sketch it is
    repeated in proportion, ``4 * accuracy`` times in all besides one for each row.
    """
    times = F.lit(1).cast("bigint") if weight is None else F.col(weight).cast("bigint")
    sketched = df
    if weight is not None:
        total = df.agg(F.sum(times)).first()[0] or 1
        copies = F.ceil(times.cast("double") * (4.0 * accuracy) / F.lit(float(total)))
        sketched = df.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), copies)))
    margin = 2.0 / accuracy
    probes = [p for f in fractions for p in (max(f - margin, 0.0), min(f + margin, 1.0))]
    counts = df.agg(*[F.coalesce(F.sum(F.when(_value(n).isNotNull(), times)), F.lit(0)).alias(n) for n in names]).first()
    first = sketched.agg(*[
        F.struct(F.min(_value(n)).alias("lo"), F.max(_value(n)).alias("hi"),
                 F.percentile_approx(_value(n), probes, accuracy).alias("q")).alias(n) for n in names]).first()
    out: dict[str, list[float | None]] = {n: [None] * len(fractions) for n in names}
    brackets = []
    for n in names:
        count, (lo, hi, q) = counts[n], first[n]
        if not count:
            continue
        for i, f in enumerate(fractions):
            rank = f * (count - 1)
            low = lo if f - margin <= 0 else q[2 * i]
            high = hi if f + margin >= 1 else q[2 * i + 1]
            brackets.append((n, i, int(rank), rank - int(rank), min(int(rank) + 1, count - 1), low, high))
    if not brackets:
        return out
    brackets = _narrowed(df, brackets, times, walked)
    inside = [F.when(_value(n).between(lo, hi), F.struct(F.lit(k).alias("k"), _value(n).alias("v")))
              for k, (n, _, _, _, _, lo, hi) in enumerate(brackets)]
    below = df.agg(*[F.coalesce(F.sum(F.when(_value(n) < lo, times)), F.lit(0)).alias(f"b{k}")
                     for k, (n, _, _, _, _, lo, _) in enumerate(brackets)]).first()
    counted = df.select(times.alias("_w"), F.explode(F.array_compact(F.array(*inside))).alias("e")) \
        .groupBy(F.col("e.k").alias("k"), F.col("e.v").alias("v")).agg(F.sum("_w").alias("count"))
    upto = F.sum("count").over(Window.partitionBy("k").orderBy("v"))
    wanted = F.lit(False)
    for k, (_, _, r, _, r2, _, _) in enumerate(brackets):
        lower = r - below[k]
        upper = r2 - below[k]
        hit = ((F.col("upto") > lower) & (F.col("upto") - F.col("count") <= lower)) | \
              ((F.col("upto") > upper) & (F.col("upto") - F.col("count") <= upper))
        wanted = wanted | ((F.col("k") == k) & hit)
    found: dict[int, list] = {}
    for row in counted.withColumn("upto", upto).filter(wanted).collect():
        found.setdefault(row["k"], []).append((row["upto"], row["v"]))
    for k, (n, i, r, part, r2, _, _) in enumerate(brackets):
        stops = sorted(found.get(k, []))
        at = lambda rank: next((v for upto_, v in stops if upto_ > rank - below[k]), None)
        a, b = at(r), at(r2)
        if a is None or b is None:  # the sketch missed its bound: look again with a wider bracket
            return exact_percentiles(df, names, fractions, max(accuracy // 10, 10), weight, walked)
        out[n][i] = a + (b - a) * part
    return out


def medians(df: DataFrame, names: list[str] = rules.FEATURE_NAMES) -> dict[str, float]:
    found = exact_percentiles(df, names, [0.5])
    return {n: v[0] for n, v in found.items() if v[0] is not None}


def impute_median(df: DataFrame, names: list[str] = rules.FEATURE_NAMES) -> DataFrame:
    """Replace missing (NULL or NaN) feature values by the column median.

    One counting pass finds the columns that miss values; only those are ranked.
    """
    missing = df.agg(*[F.count_if(_value(n).isNull()).alias(n) for n in names]).first()
    fill = medians(df, [n for n in names if missing[n]]) if any(missing) else {}
    return df.withColumns({n: F.coalesce(_value(n), F.lit(fill[n])) if n in fill else F.col(n).cast("double") for n in names})


@dataclass
class Scaler:
    """Mean and population deviation per feature; a zero deviation divides by 1."""

    means: dict[str, float]
    stds: dict[str, float]

    def transform(self, df: DataFrame, digits: int | None = None) -> DataFrame:
        def scaled(n: str) -> Column:
            z = (F.col(n).cast("double") - F.lit(self.means[n])) / F.lit(self.stds[n])
            return z if digits is None else round_to(z, digits)

        return df.withColumns({n: scaled(n) for n in self.means})


def fit_scaler(df: DataFrame, names: list[str] = rules.FEATURE_NAMES) -> Scaler:
    row = df.agg(*[F.avg(_value(n)).alias(f"m_{n}") for n in names],
                 *[F.stddev_pop(_value(n)).alias(f"s_{n}") for n in names]).first()
    return Scaler({n: row[f"m_{n}"] or 0.0 for n in names}, {n: row[f"s_{n}"] or 1.0 for n in names})


def training_stats(scored: DataFrame, names: list[str] = rules.FEATURE_NAMES, score: str = "anomaly_score",
                   prediction: str = "prediction") -> DataFrame:
    """One row: sample counts, score mean and deviation, mean and sample deviation per feature."""
    return scored.agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.count_if(F.col(prediction) == -1).alias("n_anomalies_detected"),
        F.avg(score).alias("score_mean"), F.stddev_pop(score).alias("score_std"),
        *[F.avg(n).alias(f"mean_{n}") for n in names],
        *[F.stddev_samp(n).alias(f"std_{n}") for n in names],
    ).withColumn("n_features", F.lit(len(names))) \
        .withColumn("anomaly_ratio", F.try_divide("n_anomalies_detected", "n_samples"))

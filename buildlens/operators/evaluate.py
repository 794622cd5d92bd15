"""Detector evaluation: labels, splits, metrics, importance, sweeps and profiles.

Labels and predictions are 1 for normal and -1 for anomalous.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from buildlens.functions.numbers import round_to
from buildlens.functions import rules
from buildlens.operators import forest as M
from buildlens.operators import prep
from buildlens.sources.storage import materialize

ANOMALY = -1


def prepare_labels(df: DataFrame, names: list[str] = rules.FEATURE_NAMES) -> DataFrame:
    """Add ``y`` from ``label``, else ``is_anomaly``, else all normal; at least 6 features."""
    if len(prep.align_features(df, names)[0]) < 6:
        raise ValueError(f"not enough features: {df.columns}")
    if "label" in df.columns:
        y = F.when(F.col("label") == "normal", 1).otherwise(-1)
    elif "is_anomaly" in df.columns:
        y = F.when(F.col("is_anomaly"), -1).otherwise(1)
    else:
        y = F.lit(1)
    return df.withColumn("y", y)


def hash_percent(key: Column) -> Column:
    """0-99 from the first 8 hex digits of the key's md5; the same on every engine."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") % 100


def train_test_split(df: DataFrame, key: str = "build_id", percent: int = 80) -> DataFrame:
    """Add ``is_train``: deterministic, without a shuffle."""
    return df.withColumn("is_train", hash_percent(F.col(key)) < percent)


def threshold_prediction(duration: float = 600, security: float = 1) -> Column:
    """Baseline on raw values: long builds and any security indicator except URLs."""
    flagged = (
        (F.col("duration_seconds") > duration) | (F.col("suspicious_pattern_count") >= security)
        | (F.col("external_ip_count") >= security) | (F.col("base64_pattern_count") >= security)
    )
    return F.when(F.coalesce(flagged, F.lit(False)), -1).otherwise(1)


# -------------------------------------------------------------- metrics

def _share(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


def confusion_counts(df: DataFrame, by: list[str] | None = None, y: str = "y", p: str = "prediction") -> DataFrame:
    true, pred = F.col(y) == ANOMALY, F.col(p) == ANOMALY
    return df.groupBy(*(by or [])).agg(
        F.count_if(true & pred).alias("tp"), F.count_if(~true & pred).alias("fp"),
        F.count_if(true & ~pred).alias("fn"), F.count_if(~true & ~pred).alias("tn"))


def metrics_of_counts(counts: DataFrame, digits: int = 6) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.withColumns({
        "accuracy": round_to(_share(tp + tn, tp + tn + fp + fn), digits),
        "precision": round_to(_share(tp, tp + fp), digits),
        "recall": round_to(_share(tp, tp + fn), digits),
        "f1": round_to(_share(2 * tp, 2 * tp + fp + fn), digits),
        "false_positive_rate": round_to(_share(fp, fp + tn), digits),
        "false_negative_rate": round_to(_share(fn, fn + tp), digits),
    })


def classification_metrics(df: DataFrame, by: list[str] | None = None, y: str = "y", p: str = "prediction",
                           digits: int = 6) -> DataFrame:
    """Accuracy, precision, recall, F1 and error rates in one aggregation; 0 for 0/0."""
    return metrics_of_counts(confusion_counts(df, by, y, p), digits)


def confusion_matrix(df: DataFrame, y: str = "y", p: str = "prediction", digits: int = 4) -> DataFrame:
    """All four cells with count and percent of the total, and the two error rates."""
    m = classification_metrics(df, None, y, p)
    total = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    cells = F.array(*[
        F.struct(F.lit(a).alias("actual"), F.lit(b).alias("predicted"), F.col(c).alias("n"))
        for a, b, c in (("normal", "normal", "tn"), ("normal", "anomaly", "fp"),
                        ("anomaly", "normal", "fn"), ("anomaly", "anomaly", "tp"))])
    return m.select(F.explode(cells).alias("c"), total.alias("_t"), "false_positive_rate", "false_negative_rate").select(
        "c.actual", "c.predicted", "c.n",
        round_to(_share(F.col("c.n") * 100.0, F.col("_t")), digits).alias("percent"),
        "false_positive_rate", "false_negative_rate")


def roc_auc(df: DataFrame, score: str, y: str = "y", by: str | None = None, buckets: int = 256,
            digits: int = 6) -> DataFrame:
    """Area under the ROC curve of a score that is larger for more anomalous rows.

    Rank sum without a global sort: equal scores are counted first, distinct
    scores go to buckets cut at sketched quantiles, and only the bucket totals
    (at most ``buckets`` rows per group) are accumulated in order.
    """
    name = by or "_one"
    data = df if by else df.withColumn("_one", F.lit(0))
    pos = F.col(y) == ANOMALY
    scores = data.groupBy(name, F.col(score).alias("s")).agg(F.count_if(pos).alias("p"), F.count_if(~pos).alias("n"))
    cuts = data.agg(F.percentile_approx(score, [i / buckets for i in range(1, buckets)], 100 * buckets)).first()[0] or []
    cuts = sorted(set(cuts))
    bucket = F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]).cast("array<double>"), lambda c: c < F.col("s")))
    scores = scores.withColumn("b", bucket)
    inside = Window.partitionBy(name, "b").orderBy("s")
    lower = F.sum("n").over(inside) - F.col("n")
    per_bucket = scores.withColumn("_w", F.col("p") * (lower + F.col("n") / 2.0)).groupBy(name, "b").agg(
        F.sum("_w").alias("w"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    order = Window.partitionBy(name).orderBy("b")
    before = F.sum("n").over(order) - F.col("n")
    total = per_bucket.withColumn("_before", before).groupBy(name).agg(
        F.sum(F.col("w") + F.col("p") * F.col("_before")).alias("u"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    out = total.select(*([name] if by else []), round_to(F.try_divide(F.col("u"), F.col("p") * F.col("n") * F.lit(1.0)), digits).alias("auc_roc"))
    return out


# ------------------------------------------------------------------ folds

def stratified_folds(df: DataFrame, folds: int = 5, key: str = "build_id", y: str = "y") -> DataFrame:
    """Add ``fold``: position in hash order within the class, modulo the number of folds.

    The position is exact but no task sorts a whole class: keys are counted
    first, ranked within one of 4096 hash ranges, and the sizes of the ranges are
    accumulated apart.  Rows that share a key are dealt over the folds by a hash of their content.
    """
    keys = df.groupBy(y, key).agg(F.count(F.lit(1)).alias("_n")) \
        .withColumn("_h", F.md5(F.col(key))).withColumn("_b", F.substring("_h", 1, 3))
    sizes = keys.groupBy(y, "_b").agg(F.sum("_n").alias("_size"))
    offsets = sizes.select(y, "_b", (F.sum("_size").over(Window.partitionBy(y).orderBy("_b")) - F.col("_size")).alias("_o"))
    before = F.sum("_n").over(Window.partitionBy(y, "_b").orderBy("_h", key)) - F.col("_n")
    # Two classes times 4096 ranges at most.
    placed = keys.withColumn("_before", before).join(F.broadcast(offsets), [y, "_b"]) \
        .select(y, key, "_n", (F.col("_o") + F.col("_before")).alias("_at"))
    copy = F.when(F.col("_n") > 1, F.pmod(F.xxhash64(*sorted(df.columns)), F.lit(folds))).otherwise(F.lit(0))
    return df.join(placed, [y, key]).withColumn("fold", ((F.col("_at") + copy) % folds).cast("int")).drop("_at", "_n")


# ---------------------------------------------------- forest experiments

def _split_and_scale(df: DataFrame, names: list[str], key: str) -> tuple[DataFrame, DataFrame]:
    """Scaled training normals and scaled test rows, written once; the scaler sees training rows only."""
    labelled = train_test_split(prepare_labels(df), key).select(key, "y", "is_train", *names)
    rows = materialize(labelled, "evaluation")
    scaler = prep.fit_scaler(rows.filter("is_train"), names)
    scaled = scaler.transform(rows.fillna(0.0, names), None)
    return scaled.filter("is_train AND y = 1"), scaled.filter("NOT is_train")


def _offset(scored: DataFrame, contamination: float, score: str = "s") -> float:
    return prep.exact_percentiles(materialize(scored, "scores"), [score], [contamination])[score][0]


def permutation_importance(df: DataFrame, names: list[str] = rules.FEATURE_NAMES, key: str = "build_id",
                           trees: int = rules.N_ESTIMATORS, contamination: float = rules.CONTAMINATION) -> DataFrame:
    """F1 lost when one feature is shuffled among the test rows, largest first.

    The baseline and the variants with one shuffled feature are scored together, row by
    row: a variant is walked apart only where its value leaves the row's own path.
    """
    normals, test = _split_and_scale(df, names, key)
    forest = M.fit_forests(normals, names, key, trees)[0]
    offset = _offset(M.score_columns(normals, [forest]).select(F.col("scores")[0].alias("s")), contamination)
    shuffled = shuffle_features(test, names, key)
    rows = F.explode(F.array(*[F.struct(F.lit(v).alias("feature"), F.when(F.col("scores")[i] < offset, -1).otherwise(1).alias("prediction"))
                               for i, v in enumerate(["", *names])]))
    scored = M.score_moved(shuffled, forest, [f"_s_{n}" for n in names]).select("y", rows.alias("v")).select("y", "v.*")
    # A row per variant, written so that the scores are not computed for the baseline and the rest apart.
    f1 = materialize(classification_metrics(scored, ["feature"]).select("feature", "f1"), "importance")
    base = f1.filter("feature = ''").first()["f1"]
    return f1.filter("feature <> ''").select(
        "feature", F.lit(base).alias("baseline_f1"), F.col("f1").alias("permuted_f1"),
        round_to(F.lit(base) - F.col("f1"), 6).alias("importance")).orderBy(F.desc("importance"), "feature")


def shuffle_features(df: DataFrame, names: list[str], key: str = "build_id", rows_per_range: int = 10_000) -> DataFrame:
    """Add ``_s_<name>``: each feature moved to another row.

    Rows are dealt to ranges by a hash of the key.  Within a range every feature is put in its
    own hash order and takes the value of the next row, the last one that of the
    first: a permutation per feature with one shuffle in all.
    """
    ranges = -(-df.count() // rows_per_range)
    dealt = df.withColumn("_g", F.pmod(F.xxhash64(F.lit(rules.RANDOM_STATE), F.col(key)), F.lit(max(ranges, 1))))
    moved = {}
    for i, name in enumerate(names):
        order = Window.partitionBy("_g").orderBy(F.xxhash64(F.lit(i), F.col(key)), key)
        first = F.first(name).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        moved[f"_s_{name}"] = F.coalesce(F.lead(name).over(order), first)
    return dealt.withColumns(moved).drop("_g")


def ablation_study(df: DataFrame, names: list[str] = rules.FEATURE_NAMES, key: str = "build_id",
                   trees: int = rules.N_ESTIMATORS, contamination: float = rules.CONTAMINATION) -> DataFrame:
    """F1 and its change when the forest is trained without one feature.

    All variants share the tree samples and are grown and scored in one pass each.
    """
    normals, test = _split_and_scale(df, names, key)
    variants: list[int | None] = [None, *range(len(names))]
    grown = M.fit_forests(normals, names, key, trees, without=variants)
    forests = [grown[i] for i in range(len(variants))]
    labels = ["", *names]
    columns = [f"s{i}" for i in range(len(forests))]
    wide = materialize(M.score_columns(normals, forests).select(*[F.col("scores")[i].alias(c) for i, c in enumerate(columns)]), "ablation")
    offsets = prep.exact_percentiles(wide, columns, [contamination])
    rows = F.explode(F.array(*[F.struct(F.lit(labels[i]).alias("feature"), F.when(F.col("scores")[i] < offsets[c][0], -1).otherwise(1).alias("prediction"))
                               for i, c in enumerate(columns)]))
    scored = M.score_columns(test, forests).select("y", rows.alias("v")).select("y", "v.*")
    f1 = materialize(classification_metrics(scored, ["feature"]).select("feature", "f1"), "ablation-f1")
    base = f1.filter("feature = ''").first()["f1"]
    return f1.filter("feature <> ''").select(
        "feature", F.col("f1").alias("f1_without"),
        round_to(F.col("f1") - F.lit(base), 6).alias("delta_from_baseline")).orderBy("feature")


def contamination_sweep(normals: DataFrame, test: DataFrame, score: str = "anomaly_score",
                        levels: list[float] = rules.CONTAMINATION_SWEEP, digits: int = 6) -> DataFrame:
    """Precision, recall and F1 when the decision bound is moved over given scores.

    ``normals`` set the bounds (percentiles of their scores), ``test`` is judged.
    One scan: every row is compared with all bounds inside its row.
    """
    bounds = prep.exact_percentiles(normals, [score], levels)[score]
    judged = F.explode(F.array(*[F.struct(F.lit(c).alias("contamination"), F.when(F.col(score) < b, -1).otherwise(1).alias("prediction"))
                                 for c, b in zip(levels, bounds)]))
    rows = test.select("y", judged.alias("v")).select("y", "v.*")
    return classification_metrics(rows, ["contamination"], digits=digits).select("contamination", "precision", "recall", "f1")


def n_estimators_sweep(df: DataFrame, stops: list[int] = rules.ESTIMATOR_SWEEP, names: list[str] = rules.FEATURE_NAMES,
                       key: str = "build_id", contamination: float = rules.CONTAMINATION) -> DataFrame:
    """F1 by number of trees: the largest forest is fitted once and read after its first k trees."""
    normals, test = _split_and_scale(df, names, key)
    forest = M.fit_forests(normals, names, key, trees=max(stops))[0]
    columns = [f"s{k}" for k in stops]
    wide = materialize(M.score_columns(normals, [forest], stops).select(*[F.col("scores")[i].alias(c) for i, c in enumerate(columns)]), "estimators")
    bounds = prep.exact_percentiles(wide, columns, [contamination])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("n_estimators"), F.when(F.col("scores")[i] < bounds[c][0], -1).otherwise(1).alias("prediction"))
                               for i, (k, c) in enumerate(zip(stops, columns))]))
    scored = M.score_columns(test, [forest], stops).select("y", rows.alias("v")).select("y", "v.*")
    return classification_metrics(scored, ["n_estimators"]).select("n_estimators", "f1").orderBy("n_estimators")


def cross_validate(df: DataFrame, folds: int = 5, names: list[str] = rules.FEATURE_NAMES, key: str = "build_id",
                   trees: int = rules.N_ESTIMATORS, contamination: float = rules.CONTAMINATION) -> DataFrame:
    """Mean and population deviation of F1, precision and recall over stratified folds.

    All folds are fitted in one job: a training row belongs to every fold but its own.
    """
    # The folds read their rows twice: rows that cost much to derive are written once.
    labelled = stratified_folds(materialize(prepare_labels(df), "labelled"), folds, key).select(key, "y", "fold", *names)
    rows = materialize(labelled.fillna(0.0, names), "folds")
    scaled = prep.fit_scaler(rows, names).transform(rows)
    others = F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda f: f != F.col("fold"))
    training = scaled.filter("y = 1").withColumn("held_out", F.explode(others))
    grown = M.fit_forests(training, names, key, trees, group="held_out")
    forests = [grown[f] for f in range(folds)]
    scores = materialize(M.score_columns(training, forests, pick="held_out").select(
        "held_out", F.col("scores")[0].alias("s")), "fold-scores")
    per_fold = scores.select(*[F.when(F.col("held_out") == f, F.col("s")).alias(f"s{f}") for f in range(folds)])
    bounds = prep.exact_percentiles(per_fold, [f"s{f}" for f in range(folds)], [contamination])
    bound = F.array(*[F.lit(bounds[f"s{f}"][0]) for f in range(folds)])[F.col("fold")]
    judged = M.score_columns(scaled, forests, pick="fold").withColumn(
        "prediction", F.when(F.col("scores")[0] < bound, -1).otherwise(1))
    per = classification_metrics(judged, ["fold"], digits=10)
    return per.agg(*[round_to(agg(m), 6).alias(f"{m}_{s}") for m in ("f1", "precision", "recall")
                     for s, agg in (("mean", F.avg), ("std", F.stddev_pop))])


# --------------------------------------------------------------- profiles

def baseline_profile(df: DataFrame, names: list[str] = rules.FEATURE_NAMES, digits: int = 4) -> DataFrame:
    """Mean, sample deviation, range and exact quartiles per feature, one row each."""
    quartiles = prep.exact_percentiles(df, names, [0.25, 0.75])
    aggs = []
    for n in names:
        v = prep._value(n)
        aggs.append(F.struct(
            F.lit(n).alias("feature"), F.count(v).alias("n"), round_to(F.avg(v), digits).alias("mean"),
            round_to(F.stddev_samp(v), digits).alias("std"), round_to(F.min(v), digits).alias("min"),
            round_to(F.max(v), digits).alias("max"),
            round_to(F.lit(quartiles[n][0]).cast("double"), digits).alias("p25"),
            round_to(F.lit(quartiles[n][1]).cast("double"), digits).alias("p75")))
    return df.agg(F.array(*aggs).alias("_a")).select(F.explode("_a").alias("r")).select("r.*")


def label_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("label").count()


def deviation_report(df: DataFrame, baseline: DataFrame, names: list[str] = rules.FEATURE_NAMES, top: int = 3,
                     key: str = "build_id", digits: int = 2) -> DataFrame:
    """Largest signed deviations per build against a baseline profile.

    The profile has one row per feature and goes into the projection, so the
    report is computed within each row.
    """
    profile = {r["feature"]: (r["mean"], r["std"]) for r in baseline.select("feature", "mean", "std").collect()}
    entries = []
    for i, n in enumerate(names):
        mean, std = profile.get(n, (0.0, 0.0))
        value = F.col(n).cast("double")
        z = (value - F.lit(mean)) / F.lit(std) if std else F.when(value.isNotNull(), F.lit(0.0))
        entries.append(F.when(value.isNotNull(), F.struct(
            (-F.abs(z)).alias("order"), F.lit(i).alias("idx"), F.lit(n).alias("feature"), value.alias("value"),
            z.alias("z"), F.lit(float(mean or 0.0)).alias("mean"))))
    ranked = F.slice(F.sort_array(F.array_compact(F.array(*entries))), 1, top)
    return df.select(key, F.posexplode(ranked).alias("rank", "e")).select(
        key, (F.col("rank") + 1).alias("rank"), F.col("e.feature").alias("feature"),
        round_to("e.value", digits).alias("value"), round_to("e.mean", digits).alias("mean"),
        round_to("e.z", digits).alias("z_score"), (F.abs("e.z") > 2).alias("flagged"),
        F.when(F.col("e.z") > 0, "higher").otherwise("lower").alias("direction"))


def flag_summary(results: DataFrame) -> DataFrame:
    """Flagged and total builds, and whether all of them are flagged."""
    return results.agg(F.count_if("is_anomaly").alias("anomalies"), F.count(F.lit(1)).alias("total")) \
        .withColumn("all_flagged", (F.col("total") > 0) & (F.col("anomalies") == F.col("total")))


def model_comparison(parts: dict[str, DataFrame], spark: SparkSession) -> DataFrame:
    """One row of metrics per detector; ``score`` must grow with suspicion."""
    stacked = None
    for name, judged in parts.items():
        rows = judged.select(F.lit(name).alias("model"), "y", "prediction", F.col("score").cast("double").alias("score"))
        stacked = rows if stacked is None else stacked.unionByName(rows)
    stacked = materialize(stacked, "comparison")
    return classification_metrics(stacked, ["model"]).join(
        F.broadcast(roc_auc(stacked, "score", by="model")), "model").orderBy("model")

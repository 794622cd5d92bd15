import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from buildlens.functions import rules
from buildlens.operators import evaluate as E
from buildlens.operators import forest as M
from buildlens.operators import prep as P
from buildlens.sources.storage import materialize, new_folder

N = rules.FEATURE_NAMES


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    values = rng.normal(100, 10, size=(1200, 12))
    values[:40] += rng.choice([-120, 120], size=(40, 12))  # planted outliers
    data = [(f"b{i}", *map(float, v), "anomaly" if i < 40 else "normal") for i, v in enumerate(values)]
    return materialize(spark.createDataFrame(data, ["build_id", *N, "label"]), "rows")


def test_planted_outliers_are_found(rows):
    model = M.train(rows.filter("label = 'normal'"))
    assert model.stats["anomaly_ratio"] == pytest.approx(0.05, abs=0.01)
    scored = E.prepare_labels(model.score(rows)).withColumn("s", -F.col("anomaly_score"))
    assert E.roc_auc(scored, "s").first()[0] > 0.99
    assert E.classification_metrics(scored).first()["recall"] == 1.0


def test_same_forest_under_any_partitioning(rows):
    a = M.fit_forests(rows.repartition(1), trees=5)[0]
    b = M.fit_forests(rows.repartition(7), trees=5)[0]
    assert (a.feature == b.feature).all() and np.allclose(a.threshold, b.threshold) and np.allclose(a.path, b.path)


def test_save_load_versions_and_backup(spark, rows):
    folder = new_folder(spark, "models")
    model = M.train(rows, trees=10, trained_at="2024-01-01T00:00:00")
    M.save_model(spark, model, f"{folder}/v1")
    M.backup_model(spark, f"{folder}/v1", folder, "x")
    loaded = M.load_model(spark, f"{folder}/v1")
    assert M.model_versions(spark, folder).count() == 2
    assert loaded.info() == model.info()
    pairs = model.score(rows).select("build_id", F.col("anomaly_score").alias("a")).join(
        loaded.score(rows).select("build_id", F.col("anomaly_score").alias("b")), "build_id")
    assert pairs.filter("a <> b").count() == 0


def test_exact_percentiles(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.exponential(size=900), np.full(500, 1.0), [np.nan]])
    df = spark.createDataFrame([(float(v), None if i % 3 else float(i)) for i, v in enumerate(x)], "x double, y double")
    got = P.exact_percentiles(df, ["x", "y"], [0.0, 0.05, 0.25, 0.5, 0.95, 1.0], accuracy=100)
    assert got["x"] == pytest.approx(list(np.percentile(x[:-1], [0, 5, 25, 50, 95, 100])))
    assert got["y"] == pytest.approx(list(np.percentile(np.arange(0, len(x), 3), [0, 5, 25, 50, 95, 100])))
    empty = P.exact_percentiles(df.filter("x > 1e9"), ["x"], [0.5])
    assert empty["x"] == [None]


def test_shuffled_features_are_permutations(rows):
    names = N[:3]
    out = E.shuffle_features(rows, names, rows_per_range=100).toPandas()
    for n in names:
        assert sorted(out[n]) == sorted(out[f"_s_{n}"])
        assert (out[n] != out[f"_s_{n}"]).mean() > 0.9


def test_moved_values_score_as_rows_of_their_own(rows):
    forest = M.fit_forests(rows, trees=20)[0]
    x = rows.select(*N).toPandas().to_numpy()
    moved = np.random.default_rng(4).permuted(x, axis=0)
    got = forest.anomaly_with_moved(x, moved)
    for i in range(len(N) + 1):
        variant = x.copy()
        if i:
            variant[:, i - 1] = moved[:, i - 1]
        assert (got[:, i] == forest.anomaly(variant)[:, 0]).all()


def test_variants_are_scored_once(spark, rows, monkeypatch):
    scored = spark.sparkContext.accumulator(0)
    whole = M.score_moved

    def counting(df, forest, moved):
        @F.udf("string")
        def seen(key):
            scored.add(1)
            return key
        return whole(df.withColumn("build_id", seen("build_id")).filter("build_id IS NOT NULL"), forest, moved)

    monkeypatch.setattr(M, "score_moved", counting)
    out = E.permutation_importance(rows, trees=5).collect()
    assert sorted(r["feature"] for r in out) == sorted(N)
    assert scored.value == E.train_test_split(rows).filter("NOT is_train").count()


def test_rule_override_keeps_the_prediction(spark, rows):
    model = M.train(rows, trees=10)
    hit = spark.createDataFrame([("x", *[100.0] * 8, 3.0, 2.0, 0.0, 0.0)], ["build_id", *N]) \
        .withColumn("duration_seconds", F.lit(1500.0))
    r = M.predict(hit, model).first()
    assert r["is_anomaly"] and r["anomaly_score"] <= 0
    assert [x["feature"] for x in r["anomaly_reasons"]][:3] == ["suspicious_pattern_count", "external_ip_count", "duration_seconds"]
    assert len(r["top_features"]) == 5 and r["top_features"][0]["deviation"] == "high"


def test_retrain_needs_enough_rows(spark):
    results = spark.createDataFrame([("a", False, "{}", dt.datetime(2024, 1, 1))], "build_id string, is_anomaly boolean, raw_features string, created_at timestamp")
    with pytest.raises(ValueError, match="insufficient"):
        M.retrain_from_normal(results, dt.datetime(2024, 1, 2))


def test_missing_features(spark):
    df = spark.createDataFrame([("a", 1.0)], "build_id string, duration_seconds double")
    assert P.align_features(df)[0] == ["duration_seconds"]
    with pytest.raises(ValueError, match="missing"):
        P.require_features(df)
    with pytest.raises(ValueError, match="not enough"):
        E.prepare_labels(df)


def test_auc_with_ties(spark):
    rng = np.random.default_rng(7)
    y, s = rng.choice([-1, 1], 500), rng.integers(0, 20, 500).astype(float)
    pos, neg = s[y == -1], s[y == 1]
    want = np.mean([(p > neg).mean() + (p == neg).mean() / 2 for p in pos])
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, s double")
    for buckets in (2, 7, 256):
        assert E.roc_auc(df, "s", buckets=buckets).first()[0] == pytest.approx(want, abs=1e-6)

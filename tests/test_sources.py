import datetime as dt
import hashlib
import hmac
import json

import pytest

from pyspark.sql import functions as F

from buildlens.functions import rules, signature, times
from buildlens.operators import explain as X
from buildlens.operators import normalize as N
from buildlens.operators import serving as G
from buildlens.sources import feature_tables as T
from buildlens.sources import webhooks as H
from buildlens.sources import storage
from buildlens.sources.storage import new_folder
from buildlens.streaming import jobs as J


def test_hmac_equals_library(spark):
    bodies = ["", "x", '{"a": "ü"}', "y" * 500]
    for secret in ("k", "s" * 100):
        df = spark.createDataFrame([(b,) for b in bodies], "b string")
        for r in df.select("b", signature.hmac_sha256(F.col("b"), secret).alias("h")).collect():
            assert r["h"] == hmac.new(secret.encode(), r["b"].encode(), hashlib.sha256).hexdigest()


def test_webhook_files_with_vendor_extension(spark, tmp_path):
    doc = {"action": "completed", "workflow_run": {"id": 23, "head_branch": "f", "status": "completed",
           "run_started_at": "2025-11-25T11:38:45.872263Z", "updated_at": "2025-11-25T11:40:23.694433Z"},
           "repository": {"full_name": "o/r", "name": "r"}, "sender": {"login": "d"},
           "_vendor": {"raw_logs": "a\nb", "label": "normal", "steps": [{"name": "s", "log_lines": ["a", "b"]}]}}
    (tmp_path / "a.json").write_text(json.dumps(doc, indent=2))
    (tmp_path / "b.json").write_text("{broken")
    docs = H.read_webhooks(spark, str(tmp_path), extension_field="_vendor")
    assert sorted(r["_corrupt_record"] is None for r in docs.collect()) == [False, True]
    build = N.normalize_build(docs.filter("_corrupt_record IS NULL"), "iso").first()
    assert (build["build_id"], build["repo_name"], build["raw_logs"], build["provider"]) == ("23", "o/r", "a\nb", "github")
    assert build["duration_seconds"] == 97.82217
    assert N.normalize_build(docs.filter("_corrupt_record IS NULL")).first()["duration_seconds"] == 0.0


def test_durations(spark):
    cases = [("2024-01-01T00:00:00Z", "2024-01-01T00:01:00Z", 60.0, 60.0), ("2024-1-1T0:0:0", "2024-01-01T00:00:05", 5.0, 0.0),
             ("2024-01-01 00:00:10", "2024-01-01 00:00:00", -10.0, -10.0), ("2024-01-01T00:00:00.5Z", "2024-01-01T00:00:01Z", 0.0, 0.5),
             ("2024-01-01T00:00:00", "2024-01-01 00:00:10", 0.0, 10.0), ("", "2024-01-01T00:00:00", 0.0, 0.0), (None, None, 0.0, 0.0),
             ("2024-13-01T00:00:00", "2024-13-01T00:00:01", 0.0, 0.0), ("2024-01-01T02:00:00+02:00", "2024-01-01T00:00:01Z", 0.0, 1.0),
             ("2024-01-01T00:00:00", "2024-01-01T00:00:01Z", 1.0, 0.0)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _, _) in enumerate(cases)], "i int, a string, b string")
    for r in df.select("i", times.duration_strict(F.col("a"), F.col("b")).alias("s"), times.duration_iso(F.col("a"), F.col("b")).alias("t")).collect():
        assert (r["s"], r["t"]) == cases[r["i"]][2:], cases[r["i"]]


def test_csv_without_label_keeps_all_rows(spark):
    path = new_folder(spark, "csv")
    T.write_feature_csv(spark.createDataFrame([("a", 1.5), ("b", None)], "build_id string, duration_seconds double"), path)
    assert sorted((r[0], r[1]) for r in T.read_training_csv(spark, path).collect()) == [("a", 1.5), ("b", None)]


def test_time_buckets(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 2, 14, 13, 47, 5),)], "t timestamp_ntz")
    want = {"15 minutes": (2024, 2, 14, 13, 45), "1 hour": (2024, 2, 14, 13), "1 day": (2024, 2, 14), "1 week": (2024, 2, 12),
            "1 month": (2024, 2, 1), "3 months": (2024, 1, 1), "1 year": (2024, 1, 1)}
    for interval, parts in want.items():
        assert df.select(G.time_bucket(interval, F.col("t"))).first()[0] == dt.datetime(*parts, *([1, 1][:max(0, 3 - len(parts))])), interval


def test_empty_period_gives_zeros(spark):
    df = spark.createDataFrame([], "build_id string, created_at timestamp_ntz, is_anomaly boolean, anomaly_score double, confidence double")
    row = G.anomaly_stats(df, 24, dt.datetime(2024, 1, 1)).first()
    assert (row["total_builds"], row["anomaly_rate"], row["avg_score"]) == (0, 0.0, 0.0)


def test_objects_are_recognised_like_a_json_parser(spark):
    good = ['{"a":1}', ' {"a": {"b": [1, {"c": null}]}} ', '{"a":1,"a":2}', "{}", '{"a":"}"}', '{"a":"é\\u00e9"}']
    bad = ["", "[]", "1", '"x"', "null", "{", '{"a":1', '{"a":1} x', '{"a":1}}', '{"a":1},{"b":2}', "{a}", "x{}", None]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(good + bad)], "i int, body string")
    found = {r["i"]: r["ok"] for r in df.select("i", H.is_object(F.col("body")).alias("ok")).collect()}
    assert found == {i: i < len(good) for i in range(len(good + bad))}


def test_long_logs_are_kept_by_every_reader(spark, tmp_path):
    log = "line\n" * 4_200_000  # over 20 million characters
    body = json.dumps({"action": "completed", "workflow_run": {"id": 1}, "_extended": {"raw_logs": log}})
    messages = spark.createDataFrame([(1, body)], "delivery_id long, body string")
    good, dead = H.quarantine(messages)
    assert dead.count() == 0
    size = lambda df: df.select(F.length("raw_logs")).first()[0]
    assert size(N.normalize_build(H.parse_bodies(good))) == len(log)
    (tmp_path / "a.json").write_text(body)
    docs = H.read_webhooks(spark, str(tmp_path))
    assert size(N.normalize_build(docs)) == len(log)


def test_repeated_deliveries_give_a_row_each(spark, tmp_path):
    body = json.dumps({"action": "completed", "workflow_run": {"id": 7}, "_extended": {"raw_logs": "a\nerror"}})
    rows = [(5, dt.datetime(2024, 1, 1), "github", body)] * 2
    schema = "delivery_id long, received_at timestamp_ntz, provider string, body string"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame(rows, schema).write.parquet(source)
    J.stream_features(J.read_messages(spark, source, schema), out).awaitTermination()
    for name in ("build_metrics", "messages"):
        assert spark.read.parquet(f"{out}/{name}").count() == 2


def test_counters_hold_more_batches_than_the_progress_history(spark, tmp_path):
    schema = "id long, is_anomaly boolean"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(i, i % 3 == 0) for i in range(105)], schema).repartitionByRange(105, "id").write.parquet(source)
    J.stream_counters(J.read_messages(spark, source, schema, 1), out).awaitTermination()
    row = J.counter_rows(spark, out).agg(F.sum("processed_total"), F.sum("anomalies_detected"), F.count("*")).first()
    assert tuple(row) == (105, 35, spark.read.parquet(f"{out}/results").select("batch").distinct().count()) and row[2] > 100


def test_stored_results_can_be_served(spark):
    names = rules.FEATURE_NAMES
    rows = [(f"b{i % 3}", dt.datetime(2024, 1, 1, i), -1 if i % 2 else 1, 0.1 - i / 20, *[float(i)] * len(names)) for i in range(8)]
    schema = "build_id string, created_at timestamp, prediction int, anomaly_score double, " + ", ".join(f"{n} double" for n in names)
    scored = spark.createDataFrame(rows, schema)
    results = X.explain(scored, dict.fromkeys(names, 2.0), dict.fromkeys(names, 1.0))
    path = new_folder(spark, "served")
    storage.append_by_period(T.result_rows(results, F.col("created_at")), path)
    stored = spark.read.parquet(path)
    assert stored.select("id").distinct().count() == 8
    again = T.result_rows(results.repartition(3), F.col("created_at"))
    assert {r[0] for r in again.select("id").collect()} == {r[0] for r in stored.select("id").collect()}
    assert [r["build_id"] for r in G.results_page(stored, 2).collect()] == ["b1", "b0"]
    assert {r["build_id"]: r["created_at"].hour for r in G.latest_result_by_build(stored).collect()} == {"b0": 6, "b1": 7, "b2": 5}
    assert G.anomaly_stats(stored, 24, dt.datetime(2024, 1, 1, 8)).first()["total_builds"] == 8


def test_a_cluster_must_name_a_shared_folder():
    class Context:
        master = "spark://host"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        conf = {}
        sparkContext = Context

    with pytest.raises(RuntimeError):
        storage.shared_folder(Session)

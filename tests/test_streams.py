"""Streams: repeats, restarts, dictionaries, draining, kept statistics, marked partitions."""

import datetime as dt
import math
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from buildlens.operators import features as B
from buildlens.operators import mining as D
from buildlens.operators import normalize as N
from buildlens.operators import serving as G
from buildlens.sources import feature_tables as T
from buildlens.sources import webhooks as H
from buildlens.streaming import jobs as J

SCHEMA = "delivery_id long, received_at timestamp_ntz, body string"
DAY = dt.datetime(2024, 1, 1)


def message(i, lines=None):
    text = "\\n".join(lines or [f"step {i} of job", "all done", f"error at line {i}"])
    return (i, DAY + dt.timedelta(hours=7 * i), f'{{"build_id":"b{i}","_enriched":{{"raw_logs":"{text}"}}}}')


def put(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def run(spark, queue, out, **options):
    J.stream_features(J.read_messages(spark, queue, SCHEMA, 1), out, once=True, **options).awaitTermination()


def test_a_message_counts_once_in_whatever_batch_it_comes(spark, tmp_path):
    queue, out = str(tmp_path / "queue"), str(tmp_path / "out")
    put(spark, queue, [message(i) for i in range(6)] + [message(2), (7, DAY, "broken")])
    run(spark, queue, out)
    put(spark, queue, [message(i) for i in (0, 5, 6)] + [(7, DAY, "broken"), (8, None, message(8)[2])])
    run(spark, queue, out)
    put(spark, queue, [(8, None, message(8)[2]), message(6)])
    run(spark, queue, out)
    metrics = spark.read.parquet(f"{out}/build_metrics")
    assert metrics.count() == 8 and metrics.select("batch").distinct().count() == 2
    assert spark.read.parquet(f"{out}/dead_letters").count() == 1
    assert spark.read.parquet(f"{out}/messages").count() == spark.read.parquet(f"{out}/parsed_logs").count() == 8


def test_a_batch_that_runs_again_gives_the_same_rows(spark, tmp_path):
    out = str(tmp_path / "out")
    handle = J.feature_batches(spark, out, once=True)
    batch = spark.createDataFrame([message(i) for i in range(4)], SCHEMA)
    rows = []
    for _ in range(2):
        handle(batch, 0)
        rows.append(sorted(map(str, spark.read.parquet(f"{out}/build_metrics").collect())))
    handle(batch.unionByName(spark.createDataFrame([message(9)], SCHEMA)), 1)
    assert rows[0] == rows[1] and len(rows[0]) == 4
    assert spark.read.parquet(f"{out}/build_metrics").count() == 5


def test_streamed_templates_equal_the_batch(spark, tmp_path):
    queue, out, folder = (str(tmp_path / n) for n in ("queue", "out", "dictionary"))
    messages = [message(i, [f"job {i} has started on host{i % 3}", f"copy file{i} ok", "news" if i % 2 else "other words"]) for i in range(8)]

    def lines(some):
        builds = N.normalize_build(H.parse_bodies(spark.createDataFrame(some, SCHEMA)))
        return D.masked_lines(B.with_log_text(builds), "line_text", "delivery_id")

    D.save_dictionary(spark.createDataFrame([("0", "old", "old")], "sid string, template_id string, template string"), folder, 1)
    known = messages[0:8:2]
    _, assignment = D.mine_templates(lines(known).withColumnRenamed("delivery_id", "build_id"))
    D.save_dictionary(assignment, folder, 2)
    put(spark, queue, messages[:5])
    put(spark, queue, messages[5:])
    run(spark, queue, out, dictionary=folder)
    batch = D.parsed_logs(D.assign_templates(lines(messages), D.latest_dictionary(spark, folder)), "delivery_id")
    got = spark.read.parquet(f"{out}/parsed_logs").drop("batch")
    assert sorted(map(str, got.collect())) == sorted(map(str, batch.collect())) and got.count() == 8
    waiting = {r["seq"] for r in spark.read.parquet(f"{out}/unmatched").collect()}
    assert waiting == {r["seq"] for r in lines(messages).join(assignment, F.md5("seq") == F.col("sid"), "left_anti").collect()} and "news" in waiting


def test_a_drain_counts_messages_and_survives_a_failure(spark, tmp_path):
    queue, out = str(tmp_path / "queue"), str(tmp_path / "out")
    put(spark, queue, [message(i) for i in (5, 1, 3)])
    put(spark, queue, [message(i) for i in (0, 2, 4, 6, 2)])
    seen = []

    def handle(batch, number):
        seen.append((number, sorted(r["delivery_id"] for r in batch.collect())))
        if len(seen) == 2:
            raise RuntimeError("lost")

    queued = spark.read.schema(SCHEMA).parquet(queue)
    assert J.drain(queued, handle, out, 2) == (2, 5)
    with pytest.raises(RuntimeError):
        J.drain(queued, handle, out, 3)
    assert J.drain(queued, handle, out, 3) == (3, 2)
    put(spark, queue, [message(7), message(0)])
    assert J.drain(spark.read.schema(SCHEMA).parquet(queue), handle, out, 100) == (3, 0)
    assert J.drain(spark.read.schema(SCHEMA).parquet(queue), handle, out, 100) == (0, 0)
    assert seen == [(0, [0, 1]), (1, [2, 3, 4]), (1, [2, 3, 4]), (2, [5, 6, 7])]


def test_message_times_are_read(spark):
    rows = [('{"_meta":{"request_id":"r","processed_at":"2024-01-02T03:04:05Z"},"features":{"build_id":"b"}}',), ('{"features":{"build_id":"c"}}',)]
    got = T.decode_feature_messages(spark.createDataFrame(rows, "value string")).select("build_id", F.col("message_time").cast("string")).collect()
    assert sorted(map(tuple, got)) == [("b", "2024-01-02 03:04:05"), ("c", None)]


def test_the_time_of_a_batch_is_that_of_its_first_run(spark, tmp_path):
    first, again, other = (spark.range(1).select(J._batch_time(spark, str(tmp_path), n)).first()[0] for n in (0, 0, 1))
    assert first == again < other


def test_kept_states_equal_the_statistics(spark):
    rows = [(i, DAY + dt.timedelta(minutes=37 * i), i % 4 == 0, None if i % 9 == 0 else i / 64 - 2, None if i % 5 == 0 else i / 256) for i in range(200)]
    results = spark.createDataFrame(rows, "id long, created_at timestamp_ntz, is_anomaly boolean, anomaly_score double, confidence double")
    states = G.partial_states(results.filter("id < 90")).unionByName(G.partial_states(results.filter("id >= 90")))
    for as_of in (rows[-1][1], DAY + dt.timedelta(hours=40), DAY + dt.timedelta(hours=40, minutes=20), DAY - dt.timedelta(days=9)):
        for hours in (1, 5, 24, 5000):
            upto = results.filter(F.col("created_at") <= F.lit(as_of))
            own = G.partial_states(upto)
            want, got = G.anomaly_stats(upto, hours, as_of, 9).first().asDict(), G.merged_stats(own, upto, hours, as_of, 9).first().asDict()
            assert got == want, (as_of, hours)
    for interval in ("1 hour", "6 hours", "1 day", "2 weeks", "1 month"):
        assert sorted(map(str, G.merged_series(states, interval, 9).collect())) == sorted(map(str, G.bucketed(results, interval, 9).collect()))


def test_marking_leaves_other_partitions_alone(spark, tmp_path):
    path = str(tmp_path / "audit")
    rows = [(i, ("github", "gitlab")[i % 2], "{}", True, DAY + dt.timedelta(days=i % 4), False) for i in range(40)]
    audit = spark.createDataFrame(rows, "delivery_id long, source string, payload string, signature_valid boolean, received_at timestamp_ntz, processed boolean")
    H.write_raw_logs(audit, path)
    files = lambda: {str(p.relative_to(path)) for p in Path(path).rglob("*.parquet")}
    before = files()
    for parsed in (audit.filter("delivery_id IN (0, 4)").select("delivery_id", "received_at"), audit.filter("delivery_id = 8").select("delivery_id")):
        G.mark_processed_table(spark, path, parsed, F.lit(DAY).cast("timestamp_ntz"))
    touched = {f for f in before - files()}
    assert touched and all(f.startswith("day=2024-01-01/source=github") for f in touched)
    stored = {r["delivery_id"]: r for r in spark.read.parquet(path).collect()}
    assert len(stored) == 40 and {i for i, r in stored.items() if r["processed"]} == {0, 4, 8}
    assert all((r["processed_at"] == DAY) == r["processed"] and r["payload"] == "{}" for r in stored.values())


def test_mined_features_equal_a_restatement(spark):
    logs = [("a", "x 1 y\nx 2 y\n\nz"), ("b", "x 3 y\nq w e"), ("c", ""), ("d", "{}\n  "), ("e", "unseen words here\nz")]
    builds = spark.createDataFrame(logs, "build_id string, raw_logs string")
    lines = D.masked_lines(B.with_log_text(builds), "line_text")
    _, assignment = D.mine_templates(lines.filter("build_id <> 'e'"))
    for measured in (True, False):
        assigned = D.assign_templates(lines, assignment, measured).filter("template_id <> 'empty'").collect()
        counts = {}
        for r in assigned:
            counts.setdefault(r["build_id"], Counter())[r["template_id"]] += 1
        want = {b: (len(c), round(-sum(n / c.total() * math.log2(n / c.total()) for n in c.values()), 4) + 0.0) for b, c in counts.items()}
        rows = B.build_features_mined(builds, D.mined_measures(lines, assignment)).collect()
        assert {r["build_id"]: (r["unique_templates"], r["template_entropy"]) for r in rows} == {b: want.get(b, (0, 0.0)) for b, _ in logs}


def test_a_queue_in_one_file_is_drained_in_order_by_many_tasks(spark, monkeypatch, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, None if i % 11 == 0 else start + dt.timedelta(minutes=i * 7 % 40), "github", "{}") for i in range(200)]
    messages = spark.createDataFrame(rows + rows[:20], "delivery_id long, received_at timestamp_ntz, provider string, body string").coalesce(1)
    order = [r[0] for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or start, r[0]))]
    out, got = str(tmp_path / "ordered"), []
    for limit in (0, 63, 63, 1000, 5):
        calls = []
        done = J.drain(messages, lambda batch, number: calls.append({r["delivery_id"] for r in batch.collect()}), out, limit)
        got.append((done, calls))
    assert got == [((0, 200), []), ((63, 137), [set(order[:63])]), ((63, 74), [set(order[63:126])]), ((74, 0), [set(order[126:])]), ((0, 0), [])]
    tasks = []
    real = J.quarantine
    monkeypatch.setattr(J, "quarantine", lambda batch, body: tasks.append(batch.rdd.getNumPartitions()) or real(batch, body))
    J.feature_batches(spark, str(tmp_path / "dealt"))(messages, 0)
    assert tasks == [int(spark.conf.get("spark.sql.shuffle.partitions"))]

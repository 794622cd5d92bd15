"""Every query against its SQL twin on the smallest data, and the streaming jobs."""

import os

import pytest

import __spark_entry__ as entry
from buildlens.operators import serving as G
from buildlens.plans import queries as Q
from buildlens.plans.views import view
from buildlens.sources.storage import new_folder
from buildlens.streaming import jobs as J
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@needs_data
@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    difference, _ = compare(spark, SF, entry.queries()[name], entry.oracle_sql()[name], con)
    assert difference is None


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() > 0


@needs_data
def test_streams_equal_batch(spark):
    out = Q._features_out(spark, SF, 2)
    metrics = spark.read.parquet(f"{out}/build_metrics")
    batch = Q.B.build_features_12(Q._builds(spark, SF))
    columns = ["build_id", "log_line_count", "char_density", "error_count"]
    assert sorted(map(str, metrics.select(*columns).collect())) == sorted(map(str, batch.select(*columns).collect()))
    assert metrics.select("batch").distinct().count() > 1
    dead = spark.read.parquet(f"{out}/dead_letters")
    assert dead.count() + metrics.count() == view(spark, SF, "deliveries").count()
    assert spark.read.parquet(f"{out}/parsed_logs").count() > 0


@needs_data
def test_closed_windows_are_part_of_the_series(spark):
    out = new_folder(spark, "closed")
    messages = J.read_messages(spark, Q._queue(spark, SF, "build_results"), Q.RESULT)
    J.stream_timeseries(messages, "1 hour", out, closed_only=True).awaitTermination()
    closed = {r["time"]: r["total_builds"] for r in spark.read.parquet(f"{out}/series").collect()}
    whole = {r["time"]: r["total_builds"] for r in G.bucketed(view(spark, SF, "build_results"), "1 hour").collect()}
    assert 0 < len(closed) <= len(whole)
    assert all(whole[t] == n for t, n in closed.items())


@needs_data
def test_steps_are_found_in_every_line_of_a_build(spark, con):
    lines = view(spark, SF, "events").count()
    logs = view(spark, SF, "marked_logs").selectExpr("sum(size(split(raw_logs, '\n', -1)))").first()[0]
    assert logs == lines
    builds = con.execute("SELECT count(DISTINCT event_id // 40) FROM events").fetchone()[0]
    unmarked = {r["build_id"] for r in view(spark, SF, "marked_logs").filter("build_no % 7 = 0").collect()}
    found = Q.detect_steps(spark, SF).collect()
    assert len({r["build_id"] for r in found}) == builds
    # A build without markers is one step with all its lines.
    whole = sum(r["line_count"] for r in found if r["build_id"] in unmarked)
    assert whole == con.execute("SELECT count(*) FROM events WHERE event_id // 40 % 7 = 0").fetchone()[0]

"""Feature rows against their SQL text, on rows that the given tables do not hold."""

import datetime as dt
import re

import numpy as np

from buildlens.operators import forest as M
from buildlens.plans.views import VIEWS, feature_rows

ORDERS = "o_orderkey long, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"
ITEMS = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double, l_returnflag string"


def _tables(spark):
    day = dt.datetime(2024, 1, 1)
    orders = [(1, 10.0, day, "1-URGENT"), (2, 20.5, day, "5-LOW"), (2, 30.0, None, "1-URGENT"), (3, None, day, "1-URGENT"), (3, 7.0, day, None),
              (4, 1.0, day, "0"), (4, 2.0, day, "1"), (5, 5.0, day, ""), (6, 6.0, day, None), (None, 8.0, day, "1-URGENT"), (None, 9.0, day, "1"),
              *[(k, float(k), day, "1-URGENT" if k % 3 else "2-HIGH") for k in range(10, 60)]]
    items = [(1, 5, 7, 1, 49.0, 0.1, 0.02, "R"), (1, 5, 8, 2, 3.0, 0.001, None, "A"), (2, 5, None, None, None, None, 0.01, None), (2, None, 8, 4, -3.0, 0.095, 0.0, "A"),
             (3, 1, 1, 1, -2.0, 0.0, -0.5, "N"), (3, 1, 1, 1, -2.0, 0.0, -0.5, "N"), (None, 1, 1, 1, 50.0, 0.1, 0.1, "R"), (99, 1, 1, 2, 50.0, 0.1, 0.1, "R"),
             *[(10 + i % 50, i % 7, i % 3, i % 5, float(i % 51), (i % 12) / 100, (i % 9) / 100, "RAN"[i % 3]) for i in range(400)]]
    return spark.createDataFrame(orders, ORDERS), spark.createDataFrame(items, ITEMS)


def test_feature_rows_equal_their_sql(spark):
    orders, items = _tables(spark)
    orders.createOrReplaceTempView("odd_orders")
    items.createOrReplaceTempView("odd_items")
    want = spark.sql(VIEWS["feature_rows"].replace("{orders}", "odd_orders").replace("{lineitem}", "odd_items"))
    for task_rows in (1_000_000, 20):
        got = feature_rows(orders, items, task_rows)
        assert [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in want.schema]
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_feature_rows_move_once_in_tasks_of_bounded_size(spark):
    got = feature_rows(*_tables(spark), 20)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1 and "SortAggregate" not in plan and "Expand" not in plan
    assert got.rdd.getNumPartitions() >= 20


def test_walk_of_trees_equals_a_walk_node_by_node():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 4)).round(1)
    x[0], x[1, 2] = np.inf, -np.inf
    nodes = [M._grow(rng.normal(size=(40, 4)).round(1), np.arange(4), rng, 6) for _ in range(5)]
    width = max(map(len, nodes))
    grid = lambda i, fill: np.array([[n[i] for n in t] + [fill] * (width - len(t)) for t in nodes])
    forest = M.Forest(list("abcd"), grid(0, -1), grid(1, 0.0), grid(2, -1), grid(3, -1), grid(4, 0.0), 6, 40)

    def depth(tree, row):
        at = 0
        while tree[at][0] >= 0:
            at = tree[at][2] if row[tree[at][0]] <= tree[at][1] else tree[at][3]
        return tree[at][4]

    walked = np.array([[depth(t, row) for t in nodes] for row in x])
    assert np.allclose(forest.paths(x, [2, 5]), np.column_stack([walked[:, :2].mean(1), walked.mean(1)]))

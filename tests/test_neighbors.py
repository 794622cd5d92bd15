import itertools

import numpy as np
import pandas as pd
import pytest

from buildlens.operators import neighbors as K

NAMES = ["a", "b", "c"]


def brute_force(x, queries, k, contamination):
    def nearest(q, skip=None):
        d = np.sqrt(((x - q) ** 2).sum(1))
        if skip is not None:
            d[skip] = np.inf
        order = np.argsort(d, kind="stable")[:k]
        return order, d[order]

    around = [nearest(x[i], i) for i in range(len(x))]
    reach = np.array([d[-1] for _, d in around])
    density = np.array([1 / (np.maximum(reach[o], d).mean() + 1e-10) for o, d in around])
    own = np.array([density[o].mean() / density[i] for i, (o, _) in enumerate(around)])
    factors = []
    for q in queries:
        o, d = nearest(q)
        factors.append(density[o].mean() * (np.maximum(reach[o], d).mean() + 1e-10))
    return np.array(factors), np.percentile(own, 100 * (1 - contamination))


@pytest.mark.parametrize("cut", [{}, {"pivots": 7, "query_block": 11, "data_block": 13}])
def test_lof_equals_brute_force_with_copies(spark, cut):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(300, 3)), 2)
    x[:100] = x[0]  # a third of all rows are copies
    x[160:163] = x[161]
    queries = np.vstack([np.round(rng.normal(size=(40, 3)), 2), x[:2], x[200:205], [[9, 9, 9]]])
    rows = lambda p, m: spark.createDataFrame([(f"{p}{i}", *map(float, r)) for i, r in enumerate(m)], ["build_id", *NAMES])
    want, bound = brute_force(x, queries, 20, 0.05)
    found = {r["build_id"]: r for r in K.lof_novelty(rows("t", x), rows("q", queries), NAMES, **cut).collect()}
    assert len(found) == len(queries)
    for i, w in enumerate(want):
        assert found[f"q{i}"]["lof"] == pytest.approx(w, rel=1e-5)
        assert found[f"q{i}"]["prediction"] == (-1 if w > bound else 1)


def test_neighbour_lists_are_written_once(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x, queries = rng.normal(size=(400, 3)), rng.normal(size=(100, 3))
    rows = lambda p, m: spark.createDataFrame([(f"{p}{i}", *map(float, r)) for i, r in enumerate(m)], ["build_id", *NAMES])
    written = []
    whole = K.materialize

    def counting(df, name):
        out = whole(df, name)
        if "dist" in out.columns:
            written.append(out.count())
        return out

    monkeypatch.setattr(K, "materialize", counting)
    assert K.lof_novelty(rows("t", x), rows("q", queries), NAMES).count() == 100
    assert written == [500 * 20]


def test_weighted_percentiles(spark):
    import numpy as np

    from buildlens.operators import prep

    rng = np.random.default_rng(3)
    rows = [(float(v), int(w)) for v, w in zip(rng.integers(0, 500, 3000), rng.integers(1, 40, 3000), strict=True)] + [(None, 9)]
    df = spark.createDataFrame(rows, "v double, w long")
    whole = np.repeat([v for v, _ in rows[:-1]], [w for _, w in rows[:-1]])
    fractions = [0.0, 0.05, 0.5, 0.951, 1.0]
    assert np.allclose(prep.exact_percentiles(df, ["v"], fractions, weight="w")["v"], np.quantile(whole, fractions))
    heavy = spark.createDataFrame([(1.0, 5), (2.0, 4_000_000_000), (3.0, 3_000_000_000)], "v double, w long")
    assert prep.exact_percentiles(heavy, ["v"], [0.0, 0.5, 0.9], weight="w")["v"] == [1.0, 2.0, 3.0]


@pytest.mark.parametrize("weighted", [False, True])
def test_percentiles_of_wide_brackets_are_narrowed(spark, weighted):
    from buildlens.operators import prep

    # A coarse sketch leaves a bracket of over a million distinct values.
    n = 3_000_000
    value = "pow(1.0 + pmod(xxhash64(id), 1000003) / 1000003.0 + id / 1e9, 9) - 200"
    df = spark.range(n).selectExpr(f"CASE WHEN id % 10 = 0 THEN 7.0 ELSE {value} END AS v", "1 + id % 3 AS w", f"{value} * 1e300 AS big")
    rows = df.toPandas()
    fractions = [0.0, 0.07, 0.5, 0.93, 1.0]
    for name in ("v", "big"):
        whole = np.repeat(rows[name].to_numpy(), rows["w"] if weighted else 1)
        got = prep.exact_percentiles(df, [name], fractions, accuracy=10, weight="w" if weighted else None, walked=1000)[name]
        assert np.allclose(got, np.quantile(whole, fractions), rtol=1e-12)


def block(ids, vectors, **more):
    return pd.DataFrame({"qid": ids, "vid": ids, "vec": [np.asarray(v, dtype=float) for v in vectors], **more})


def test_ties_in_a_block_go_by_number():
    # 48 vectors at the same distance from the query, their numbers in no order.
    signs, orders = itertools.product([1, -1], repeat=3), list(itertools.permutations([1, 2, 3]))
    around = [[s * v for s, v in zip(sign, order)] for sign in signs for order in orders]
    ids = np.random.default_rng(2).permutation(len(around)) + 10
    found = K._nearest_in_block(block([0], [[0, 0, 0]], tau=[np.inf]), block(ids, around, w=1), 20)
    assert found["vid"].tolist() == list(range(10, 30))


def test_a_query_meets_only_vectors_of_near_groups(monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6000, 3)) + 1000.0 * rng.integers(0, 8, size=(6000, 1))
    met, squares = [], K._Groups.squares
    monkeypatch.setattr(K._Groups, "squares", lambda self, a, at: met.append((out := squares(self, a, at)).size) or out)
    found = K._nearest_in_block(block(np.arange(6000), x, tau=np.inf), block(np.arange(6000), x, w=1), 20)
    assert sum(met) < 6000 * 6000 / 2
    for i in range(0, 6000, 500):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        d[i] = np.inf
        mine = found[found["qid"] == i]
        assert mine["vid"].tolist() == np.argsort(d, kind="stable")[:20].tolist()
        assert np.allclose(mine["dist"], np.sort(d)[:20])

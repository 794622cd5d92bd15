"""Vector searches against brute force."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from buildlens.llm import norm_search, permutation_index

SCHEMA = "vec_id long, embedding array<float>, query_id string, score string"


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(900, 24)).astype(np.float32) * rng.lognormal(size=(900, 1)).astype(np.float32)
    rows = [(i, v.tolist(), "own", "own") for i, v in enumerate(x)]
    hot = x[3].tolist()
    rows += [(2000 + i, hot, None, None) for i in range(300)]  # a third are copies
    rows += [(5000, None, "a", "b"), (5050, [0.0] * 24, "a", "b"), (5100, [float("nan")] * 24, "a", "b"), (None, hot, "a", "b"),
             (5150, [None] * 24, "a", "b"), (5200, [float("inf")] + [1.0] * 23, "a", "b"), (7, x[7].tolist(), "a", "b")]
    return spark.createDataFrame(rows, SCHEMA), {r[0]: np.array(r[1], dtype=np.float32) for r in rows if r[0] is not None and r[0] < 5000}


def brute(vectors, measure):
    ids = np.array(sorted(vectors))
    x = np.stack([vectors[i] for i in ids])
    out = {}
    for q in ids[ids % 50 == 0]:
        s = measure(x, vectors[q])
        order = [k for k in np.lexsort((ids, -s)) if ids[k] != q][:5]
        out[int(q)] = [(int(ids[k]), s[k]) for k in order]
    return out


def test_products_equal_brute_force(table):
    df, vectors = table
    whole = {i: np.floor(256 * v.astype(float)).astype(np.int64) for i, v in vectors.items()}
    whole[5050] = np.zeros(24, dtype=np.int64)
    got = norm_search.top_products(df, df.where("vec_id % 50 = 0")).collect()
    want = brute(whole, lambda x, q: x @ q)
    found = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert found == want


def test_neighbours_recall_and_scores(table):
    df, vectors = table
    got = permutation_index.search(permutation_index.build(df), df.where("vec_id % 50 = 0")).collect()

    def cosine(x, q):
        x, q = x.astype(float), q.astype(float)
        return x @ q / np.sqrt((x * x).sum(axis=1) * (q @ q))

    want = brute(vectors, cosine)
    found = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert abs(r["score"] - cosine(vectors[r["vec_id"]][None], vectors[r["query_id"]])[0]) < 1e-9
    assert found.keys() == want.keys() and all(len(v) == 5 for v in found.values())
    hits = [len({i for i, _ in found[q]} & {i for i, _ in want[q]}) / 5 for q in want]
    assert np.mean(hits) >= 0.9


def test_repeated_rows_equal_brute_force(spark):
    rng = np.random.default_rng(9)
    hot, far = rng.integers(-8, 8, size=(2, 6)) / 4 + 0.25
    for name, some in {"every row twice": [(i, hot) for i in range(50, 56)] * 2, "own row six times": [(50, hot)] * 6 + [(i, hot) for i in range(60, 64)],
                       "one id often": [(50, hot)] + [(51, hot)] * 9 + [(52, hot)], "two vectors": [(50, hot), (50, far), (51, hot), (52, far)] * 2}.items():
        table = some + [(i, rng.integers(-8, 8, size=6) / 4 + 0.125) for i in range(70, 90)]
        df = spark.createDataFrame([(i, v.tolist(), "", "") for i, v in table], SCHEMA)
        ids, x = np.array([i for i, _ in table]), np.stack([v for _, v in table])
        q = np.array(min(v.tolist() for i, v in table if i == 50))
        for score, search in ((np.floor(256 * x) @ np.floor(256 * q), lambda: norm_search.top_products(df, df.where("vec_id % 50 = 0"))),
                              (x @ q / np.sqrt((x * x).sum(axis=1) * (q @ q)), lambda: permutation_index.search(permutation_index.build(df), df.where("vec_id % 50 = 0")))):
            score = score.round(9)
            want = [(ids[j], score[j]) for j in np.lexsort((ids, -score)) if ids[j] != 50][:5]
            got = [(r["vec_id"], round(r["score"], 9)) for r in sorted(search().collect(), key=lambda r: r["rank"])]
            assert got == want, name


def test_large_components_and_other_lengths(spark):
    rng = np.random.default_rng(12)
    table = [(i, (rng.normal(size=8) * 10.0 ** (i % 10)).tolist()) for i in range(60)]
    table += [(100, [1e8] * 8), (101, [1e8] * 8), (150, [1e300] * 8), (151, [-1e300] * 8), (153, [1.7e308, -1.7e308] * 4), (152, [1e300] + [0.0] * 7), (200, [1e16 + 2] * 8), (201, [3e12 + 0.3] * 8),
              (250, [1.0, 2.0]), (251, [2.0, 1.0]), (252, [-1e8, 1e300]), (300, [1.0] * 7), (350, [5e-324] * 8), (351, [-5e-324] * 8)]
    schema = "vec_id long, embedding array<double>, query_id string, score string"
    df = spark.createDataFrame([(*r, "", "") for r in table], schema)
    got = {}
    for r in norm_search.top_products(df, df.where("vec_id % 50 = 0")).collect():
        assert r["score"] == (int(r["exact"]) if -(2**63) <= int(r["exact"]) < 2**63 else None)
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], int(r["exact"])))
    near = {}
    for r in permutation_index.search(permutation_index.build(df), df.where("vec_id % 50 = 0"), rerank=1.0).collect():
        near.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], round(r["score"], 9)))
    whole = {i: [math.floor(Fraction(x) * 256) for x in v] for i, v in table}
    assert max(abs(x) for v in whole.values() for x in v) > 2**1030
    for q, v in table:
        if q % 50 == 0:
            products = sorted((-sum(a * b for a, b in zip(whole[q], whole[i], strict=True)), i) for i, u in table if i != q and len(u) == len(v))[:5]
            assert sorted(got.get(q, [])) == [(n + 1, i, -p) for n, (p, i) in enumerate(products)]
            unit = lambda u: np.array(u) / np.abs(u).max() / np.linalg.norm(np.array(u) / np.abs(u).max())
            cosines = {i: round(float(unit(v) @ unit(u)), 9) for i, u in table if i != q and len(u) == len(v)}
            assert [c for _, _, c in sorted(near.get(q, []))] == sorted(cosines.values(), reverse=True)[:5]
            assert all(cosines[i] == c for _, i, c in near.get(q, []))


def test_blocks_out_of_reach_are_not_sent(spark):
    rows = [(b, 10.0 ** (5 - b)) for b in range(5)]
    blocks = spark.createDataFrame(rows, "block int, length double")
    asked = spark.createDataFrame([(0, 1.0, 5e4), (0, 1.0, 9e5), (1, 1.0, None), (2, 2.0, 30.0), (3, 0.0, 0.0), (4, 1e-3, 1e6)], "block int, length double, bound double")
    got = sorted(map(tuple, norm_search.reachable(asked, blocks).collect()))
    assert got == [(1, b) for b in range(1, 5)] + [(2, b) for b in range(1, 4)] + [(3, b) for b in range(1, 5)]
    got = sorted(map(tuple, norm_search.reachable(asked.where("block = 2").withColumn("bound", F.lit(2500.0)), blocks).collect()))
    assert got == [(2, 1)]


def test_few_and_no_vectors(spark):
    two = spark.createDataFrame([(0, [1.0, 2.0], "", ""), (50, [2.0, 1.0], "", "")], SCHEMA)
    for df, n in ((two, 2), (two.where("vec_id = 0"), 0), (two.limit(0), 0)):
        assert norm_search.top_products(df, df.where("vec_id % 50 = 0")).count() == n
        assert permutation_index.search(permutation_index.build(df), df.where("vec_id % 50 = 0")).count() == n


def test_footrule_of_the_files_is_the_definition():
    rng = np.random.default_rng(2)
    own = np.stack([rng.permutation(20)[:8] for _ in range(30)]).astype(np.int16)
    got = permutation_index.footrule(own[:5], own, 20)
    place = lambda p, k: list(p).index(k) if k in p else 8
    for i in range(5):
        for j in range(30):
            assert got[i, j] == sum(abs(place(own[i], k) - place(own[j], k)) for k in range(20))

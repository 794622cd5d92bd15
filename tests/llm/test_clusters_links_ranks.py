"""Clusters on bit planes, lattice links and dual-tree ranks against brute force."""

import hashlib
import math
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from buildlens.llm import dual_tree, lattice_dedup, plane_clusters

VECTORS = "vec_id long, embedding array<double>, label int, cluster string, planes int, vector string, node int"


def _rows(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], VECTORS)


def _usable(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v)


# ---- clusters


def brute_clusters(rows, clusters=8, rounds=10):
    kept = [(i, [math.floor(Fraction(x) * 1024) for x in v]) for i, v in rows if _usable(v) and len(v) == 64]
    digest = lambda i: hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda r: digest(r[0]))[:clusters]]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min(range(len(centroids)), key=lambda c: (square(v, centroids[c]), c))
    for _ in range(rounds):
        members = {}
        for _, v in kept:
            members.setdefault(nearest(v), []).append(v)
        centroids = [[sum(x) // len(members[c]) for x in zip(*members[c], strict=True)] if c in members else old for c, old in enumerate(centroids)]
    final = [(i, nearest(v), square(v, centroids[nearest(v)])) for i, v in kept]
    short = lambda n: n if n < 2**63 else None
    total = short(sum(d for _, _, d in final)) if all(d < 2**63 for _, _, d in final) else None
    out = []
    for i, c, d in final:
        own = [e for _, b, e in final if b == c]
        out.append((i, c, short(d), short(sum(own)) if max(own) < 2**63 else None, total,
                    hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()))
    return sorted(out, key=repr)


def _clusters(spark, rows, **options):
    found = plane_clusters.cluster(_rows(spark, [(i, v, None) for i, v in rows]), **options).drop("centroid")
    return sorted(map(tuple, found.collect()), key=repr)


def test_clusters_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), (rng.normal(size=64) / 8).tolist()) for i in range(60)]
    rows += [(7, rows[7][1]), (None, rows[3][1]), (100, None), (101, []), (102, [0.5] * 63), (103, [0.0] * 64), (104, [float("nan")] + [0.0] * 63),
             (105, [None] + [0.1] * 63), (106, [-0.0] * 64), (107, [1.0, -1.0] * 32)]
    assert _clusters(spark, rows) == brute_clusters(rows)


def test_clusters_of_large_components_are_exact(spark):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=64) * 10.0 ** (i % 9)).tolist()) for i in range(30)]
    rows += [(50, [1e300] + [0.0] * 63), (51, [-1e300] + [0.25] * 63), (52, [1e17] * 64), (53, [1.7e308] * 64)]
    assert _clusters(spark, rows) == brute_clusters(rows)


def test_clusters_of_few_and_no_vectors(spark):
    few = [(i, [float(i)] * 64) for i in range(3)]
    assert _clusters(spark, few) == brute_clusters(few)
    assert _clusters(spark, []) == []
    assert _clusters(spark, [(1, None), (2, [1.0])]) == []


def test_dot_products_on_planes():
    rng = np.random.default_rng(7)
    for top in (1, 5, 2**20, 2**40):
        a, b = rng.integers(-top, top + 1, (20, 64)), rng.integers(-top, top + 1, (1, 64))
        exact = [sum(int(x) * int(y) for x, y in zip(r, b[0], strict=True)) for r in a]
        assert list(plane_clusters.dots(plane_clusters.to_planes(a)[0], plane_clusters.to_planes(b)[0])) == exact


# ---- links


def brute_links(rows, threshold=0.98):
    n = len(rows)
    near = [[] for _ in range(n)]
    units = [None if not _usable(v) or label is None or not any(v) else (np.array(v) / np.abs(v).max()) / np.linalg.norm(np.array(v) / np.abs(v).max())
             for _, v, label in rows]
    for a in range(n):
        for b in range(n):
            if a != b and units[a] is not None and units[b] is not None and rows[a][2] == rows[b][2] and len(units[a]) == len(units[b]) and units[a] @ units[b] >= threshold:
                near[a].append(b)
    out = []
    for a in range(n):
        reach, todo = {a}, [a]
        while todo:
            for b in near[todo.pop()]:
                if b not in reach:
                    reach.add(b)
                    todo.append(b)
        ids = [rows[b][0] for b in reach if rows[b][0] is not None]
        least = min(ids, default=None)
        out.append((rows[a][0], rows[a][2], len(near[a]), least, least is None if rows[a][0] is None or least is None else rows[a][0] == least))
    return sorted(out, key=repr)


def _planted(seed, groups, members, dim=64):
    rng = np.random.default_rng(seed)
    rows, at = [], 0
    for g in range(groups):
        centre = rng.normal(size=dim)
        centre /= np.linalg.norm(centre)
        for _ in range(members):
            rows.append((at, (centre + rng.normal(size=dim) * rng.choice([0.004, 0.012, 0.02])).tolist(), g % 2))
            at += 1
    return rows


def _links(spark, rows):
    return sorted(map(tuple, lattice_dedup.near_duplicates(_rows(spark, rows)).collect()), key=repr)


def test_links_equal_brute_force(spark):
    rows = _planted(1, 6, 12)
    assert sum(r[2] for r in brute_links(rows)) > 300
    rows += [(200, rows[0][1], 1), (201, rows[0][1], 0), (202, rows[0][1], 0), (None, rows[0][1], 0), (203, None, 0), (204, [], 0), (205, [0.0] * 64, 0),
             (206, rows[1][1], None), (None, rows[2][1], None), (207, [float("inf")] * 64, 1), (208, rows[0][1][:10], 0), (209, rows[0][1][:10], 0),
             (210, [x * 1e300 for x in rows[0][1]], 0), (0, rows[30][1], 1), (211, [1.0], 0), (212, [None] * 64, 0), (213, [5e-324] * 64, 0)]
    assert _links(spark, rows) == brute_links(rows)


def test_links_of_nothing(spark):
    assert _links(spark, []) == []
    assert _links(spark, [(4, None, 1)]) == [(4, 1, 0, 4, True)]


def test_hot_cells_are_compared_in_blocks(spark):
    rows = _planted(2, 2, 60)
    frame = _rows(spark, rows).selectExpr("vec_id AS node", "label", "size(embedding) AS dim", "1L AS n", "embedding AS vector")
    found = lattice_dedup.signed(frame)
    whole, cut = (lattice_dedup.compared(found, block=b).where("b IS NULL").groupBy("a").sum("links").collect() for b in (1024, 8))
    assert sorted(map(tuple, whole)) == sorted(map(tuple, cut)) != []


def test_lattice_points_are_nearest():
    rng = np.random.default_rng(3)
    points = rng.normal(size=(200, 8)) * 3
    cells = lattice_dedup.decode(points)
    own = ((points - cells) ** 2).sum(axis=1)
    around = ((points[:, None] - cells[:, None] - lattice_dedup.minimal_vectors()[None]) ** 2).sum(axis=2)
    assert (own[:, None] <= around + 1e-12).all()
    assert (cells.sum(axis=1) % 2 == 0).all() and ((cells * 2) % 2 == (cells * 2)[:, :1] % 2).all()


def test_recall_at_the_threshold():
    rng = np.random.default_rng(4)
    a = rng.normal(size=(3000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    off = rng.normal(size=a.shape)
    off -= (off * a).sum(axis=1, keepdims=True) * a
    b = 0.98 * a + math.sqrt(1 - 0.98**2) * off / np.linalg.norm(off, axis=1, keepdims=True)
    (oa, na), (ob, nb) = lattice_dedup.signatures(a), lattice_dedup.signatures(b)
    met = [bool(set(x) & (set(y) | set(q)) or set(y) & set(p)) for x, p, y, q in zip(oa.tolist(), na.tolist(), ob.tolist(), nb.tolist(), strict=True)]
    assert np.mean(met) > 0.999


# ---- ranks


def brute_ranks(docs, items, top=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    counts = [(i, Counter(words(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in counts]
    n, length = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(words(t))
    out = []
    for item, own in asked.items():
        found = []
        for (i, c), size in zip(counts, sizes, strict=True):
            m = 10 + 90 * size * n // length if length else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in own if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(found, key=lambda f: f[:3])[:top])]
    return sorted(out, key=repr)


def _ranks(spark, docs, items):
    d = spark.createDataFrame([(i, t, 1, 2, "z") for i, t in docs], "doc_id long, text string, n int, row int, term string")
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    return sorted(map(tuple, dual_tree.search(d, q).collect()), key=repr)


def _texts(seed, n, longest=60):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(150)] + ["Grüße", "ΑΒΓ", "naïve", "x1"]
    shares = 1 / np.arange(1, len(vocabulary) + 1)
    return [" ".join(rng.choice(vocabulary, rng.integers(0, longest), p=shares / shares.sum())) for _ in range(n)]


@pytest.mark.parametrize("sizes", [(2048, 256), (64, 16)])
def test_ranks_equal_brute_force(spark, monkeypatch, sizes):
    monkeypatch.setattr(dual_tree, "DOC_BLOCK", sizes[0])
    monkeypatch.setattr(dual_tree, "ITEM_BLOCK", sizes[1])
    docs = list(enumerate(_texts(1, 300)))
    docs += [(400, None), (401, ""), (402, " \t--\n"), (5, docs[5][1]), (None, docs[6][1]), (403, docs[6][1]), (404, docs[6][1].upper()), (405, "w1 " * 5000)]
    items = list(enumerate(_texts(2, 40, 12))) + [(100, None), (101, "--"), (102, "nowhere"), (3, "w140 w1"), (None, "w7 w9"), (103, "GRÜSSE Grüße w1,w2.w1")]
    assert _ranks(spark, docs, items) == brute_ranks(docs, items)


def test_ranks_of_nothing(spark):
    assert _ranks(spark, [], [(1, "a")]) == []
    assert _ranks(spark, [(1, "a")], []) == []
    assert _ranks(spark, [(1, "a a"), (2, None)], [(1, "a")]) == brute_ranks([(1, "a a"), (2, None)], [(1, "a")])

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from buildlens.functions import logtext as L
from buildlens.functions import rules
from buildlens.operators import mining as D
from buildlens.plans.queries import QUERIES


def sequential(lines, max_children):
    """Leaf by leaf restatement: distinct sequences in order of first sight."""
    seqs = {}
    for line in lines:
        seqs[line] = seqs.get(line, 0) + 1
    keys = {s: [str(len(s.split(" ")))] for s in seqs}
    for depth in range(3):
        seen = {}
        for s in seqs:
            tokens = s.split(" ")
            b = "" if depth >= len(tokens) else "<*>" if re.search(r"\d", tokens[depth]) else tokens[depth]
            branches = seen.setdefault(tuple(keys[s]), [])
            if b and b not in branches:
                branches.append(b)
            if b and branches.index(b) >= max_children:
                b = "<*>"
            keys[s] = keys[s] + [b]
    clusters = {}
    for s, n in seqs.items():
        tokens = s.split(" ")
        best, found = rules.TEMPLATE_SIMILARITY, None
        for c in clusters.setdefault(tuple(keys[s]), []):
            fixed = [(a, b) for a, b in zip(tokens, c["t"]) if "<*>" not in (a, b)]
            sim = sum(a == b for a, b in fixed) / max(len(fixed), 1)
            if sim > best:
                best, found = sim, c
        if found is None:
            clusters[tuple(keys[s])].append({"id": hashlib.md5(s.encode()).hexdigest()[:12], "t": tokens, "n": n})
        else:
            found["t"] = [a if a == b else "<*>" for a, b in zip(tokens, found["t"])]
            found["n"] += n
    return sorted((c["id"], " ".join(c["t"]), c["n"]) for group in clusters.values() for c in group)


def corpus():
    out = []
    for i in range(400):
        out.append([f"user u{i % 37} logged in from host{chr(97 + i % 5)}", "build done ok", f"{chr(97 + i % 26)} starts now {i % 3}",
                    f"GET page {chr(97 + i % 7)} took long", "a b c d e f", f"w{i} x{i} y{i}"][i % 6])
    return out


@pytest.mark.parametrize("max_children", [100, 4])
def test_mining_equals_sequential_restatement(spark, max_children):
    lines = corpus()
    df = spark.createDataFrame([("b", i, x, x) for i, x in enumerate(lines)], "build_id string, line_no int, raw string, seq string")
    templates, assignment = D.mine_templates(df.repartition(5), max_children=max_children)
    assert sorted((r["template_id"], r["template"], r["n"]) for r in templates.collect()) == sequential(lines, max_children)
    assigned = D.assign_templates(df, assignment).collect()
    assert len(assigned) == len(lines)
    known = {r["template_id"]: r["template"] for r in templates.collect()}
    for r in assigned:
        assert known[r["template_id"]] == r["template"]
        assert all(t in ("<*>", s) for t, s in zip(r["template"].split(" "), r["raw"].split(" ")))


def tree_walk(lines, max_children, threshold=rules.TEMPLATE_SIMILARITY, depth=3):
    """Restatement of the search tree, one distinct sequence after the other.

    A search follows a token's own branch, else the shared one, else it fails; the most similar
    cluster of the leaf above the threshold is joined, its differing tokens become wild; else a
    new cluster opens own branches, or the shared one in a node that is full.
    """
    roots, clusters = {}, []
    for line in dict.fromkeys(lines):
        tokens = line.split(" ")
        keys = ["<*>" if re.search(r"\d", t) else t for t in tokens[:depth]]
        node = roots.get(len(tokens))
        for key in keys:
            if node is not None:
                node = node["sub"].get(key, node["sub"].get("<*>"))
        best, found = threshold, None
        for c in node["clusters"] if node else []:
            fixed = [(a, b) for a, b in zip(tokens, c["t"], strict=True) if "<*>" not in (a, b)]
            likeness = sum(a == b for a, b in fixed) / max(len(fixed), 1)
            if likeness > best:
                best, found = likeness, c
        if found is None:
            node = roots.setdefault(len(tokens), {"sub": {}, "clusters": []})
            for key in keys:
                if key not in node["sub"] and len(node["sub"]) >= max_children:
                    key = "<*>"
                node = node["sub"].setdefault(key, {"sub": {}, "clusters": []})
            found = {"id": hashlib.md5(line.encode()).hexdigest()[:12], "t": tokens, "lines": []}
            clusters.append(found)
            node["clusters"].append(found)
        else:
            found["t"] = [a if a == b else "<*>" for a, b in zip(tokens, found["t"], strict=True)]
        found["lines"].append(line)
    return {line: (c["id"], " ".join(c["t"])) for c in clusters for line in c["lines"]}


def noisy(seed, n, words=8, longest=6):
    rng = random.Random(seed)
    pool = [chr(97 + i) for i in range(words)] + ["x1", "y2", "<*>", "z٣"]
    return [" ".join(rng.choices(pool, k=rng.randint(1, longest))) for _ in range(n)]


def mined(spark, lines, **options):
    df = spark.createDataFrame([("b", i, x, x) for i, x in enumerate(lines)], "build_id string, line_no int, raw string, seq string")
    templates, assignment = D.mine_templates(df.repartition(5), **options)
    by_hash = {hashlib.md5(x.encode()).hexdigest(): x for x in lines}
    counts = {r["template_id"]: r["n"] for r in templates.collect()}
    assigned = {by_hash[r["sid"]]: (r["template_id"], r["template"]) for r in assignment.collect()}
    for template in counts:
        assert counts[template] == sum(assigned[x][0] == template for x in lines)
    return assigned


@pytest.mark.parametrize(("heads", "max_children"), [(20_000, 100), (20_000, 3), (7, 100), (7, 3), (1, 2)])
def test_exact_mining_equals_the_tree_walk(spark, heads, max_children):
    n = 60 if heads == 1 else 500
    lines = noisy(heads + max_children, n) + ["pkg1 a b c", "foo a b c", "pkg1 a b c", "foo q r s", "foo a b c d e f g"]
    assert mined(spark, lines, exact=True, heads=heads, max_children=max_children) == tree_walk(lines, max_children)


def test_the_shared_branch_takes_tokens_without_their_own(spark):
    lines = ["pkg1 a b c", "foo a b c"]
    assert len({t for t, _ in mined(spark, lines, exact=True).values()}) == 1
    assert len({t for t, _ in mined(spark, lines).values()}) == 2


@pytest.mark.parametrize("heads", [5, 40])
def test_a_large_leaf_in_rounds_equals_one_walk(spark, heads):
    rng = random.Random(heads)
    lines = ["go on now " + " ".join(rng.choices("abcdefgh", k=5)) for _ in range(600)] + corpus()
    assert mined(spark, lines, heads=heads) == mined(spark, lines)


def test_a_leaf_of_200_000_sequences(spark):
    n = 200_000
    df = spark.range(n).selectExpr("'b' AS build_id", "CAST(id AS int) AS line_no", """concat('job has ended node', id % 977, ' after ', id, ' steps with ',
        CASE WHEN id % 10 < 7 THEN 'success' WHEN id % 10 < 9 THEN 'failure' ELSE concat('code', id % 13) END, ' in ', CASE id % 3 WHEN 0 THEN 'red' WHEN 1 THEN 'green' ELSE 'blue' END) AS seq""")
    df = df.withColumn("raw", df["seq"])
    templates, assignment = D.mine_templates(df, heads=5_000)
    got = {r["sid"]: (r["template_id"], r["template"]) for r in assignment.toLocalIterator()}
    leaf, words = D._Leaf(11), {}
    for r in df.orderBy("line_no").select("seq").toLocalIterator():
        sid = hashlib.md5(r["seq"].encode()).hexdigest()
        words[sid] = leaf.place(sid, r["seq"].split(" "), rules.TEMPLATE_SIMILARITY)[:12]
    assert len(got) == n and {s: t for s, (t, _) in got.items()} == words
    assert sum(r["n"] for r in templates.collect()) == n


def test_templates_do_not_depend_on_partitioning(spark):
    lines = [f"worker finished task item{i} on {'abc'[i % 3]} {'quickly' if i % 7 else 'never at all'}" for i in range(300)] * 2 + ["single line"]
    df = spark.createDataFrame([("b", i, x, x) for i, x in enumerate(lines)], "build_id string, line_no int, raw string, seq string")
    found = []
    for n in (1, 3, 7):
        templates, assignment = D.mine_templates(df.repartition(n))
        found.append(sorted((r["template_id"], r["template"], r["n"]) for r in templates.collect()))
        assert assignment.count() == 301
    assert found[0] == found[1] == found[2]
    assert sum(n for _, _, n in found[0]) == len(lines)


def test_parsed_logs_keep_all_templates_of_a_build(spark):
    logs = spark.createDataFrame([("b", "\n".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)} done" for i in range(60)))], "build_id string, raw_logs string")
    row = D.parsed_logs(D.simple_lines(logs)).first()
    assert len(row["templates"]) == len(row["event_ids"]) == 60


def test_unseen_and_empty_lines(spark):
    known = spark.createDataFrame([("b", 0, "x y", "x y")], "build_id string, line_no int, raw string, seq string")
    _, assignment = D.mine_templates(known)
    logs = spark.createDataFrame([("c", "x y\n\n{}\nnew thing 7 ")], "build_id string, raw_logs string")
    got = {r["line_no"]: (r["template_id"], r["template"], r["tokens"]) for r in D.assign_templates(D.masked_lines(logs), assignment).collect()}
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()[:12]
    assert got == {0: (md5("x y"), "x y", ["x", "y"]), 2: ("empty", "", []),
                   3: (md5("new thing <NUM>"), "new thing <NUM>", ["new", "thing", "<NUM>"])}


def test_indexed_clusters_give_what_comparing_with_all_gives(monkeypatch):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)] + ["<*>"] * 4
    sequences = [[rng.choice(words[:3 + 7 * (i + 1)]) for i in range(6)] for _ in range(3000)]
    sequences += [[t if rng.random() < 0.7 else rng.choice(words) for t in rng.choice(sequences)] for _ in range(2000)] + [["<*>"] * 6]

    def placed(indexed, threshold):
        monkeypatch.setattr(D, "INDEXED", indexed)
        leaf = D._Leaf(6)
        return [leaf.place(str(i), s, threshold) for i, s in enumerate(sequences)], leaf.templates().values.tolist(), leaf.grid[:len(leaf.leaders)].tolist()

    for threshold in (0.0, 0.4, 0.7):
        assert placed(2, threshold) == placed(10 ** 9, threshold)


def test_a_sequence_meets_few_of_many_unlike_clusters():
    rng = random.Random(6)
    leaf = D._Leaf(12)
    for i in range(4000):
        leaf.place(str(i), [f"w{rng.randrange(300)}" for _ in range(12)], 0.4)
    assert len(leaf.leaders) > 3900
    assert len(leaf._candidates(leaf.row([f"w{rng.randrange(300)}" for _ in range(12)]), 0.4)) < 40


def test_masking_by_line_equals_masking_of_whole_texts(spark):
    hexes = ["deadbeef-cafe-babe-dead-beefcafebabe", "ABCDEFab" * 5, "abcdefab" * 8, "abcdefabcdef", "0xfe", "٣٤ x", "1.2.3.4", "v 1.2.3 b", "12:00:01",
             "2024-01-02T03:04:05", "-7 z", "x9", "/a/b", "https://q.r/s", "plain words only", "\rcr 5 \r", " ", "", "7", "a=b:c"]
    rng = random.Random(3)
    lines = [" ".join(rng.choices(hexes, k=rng.randint(1, 4))) for _ in range(300)] + hexes
    text = spark.createDataFrame([("\n".join(lines),)], "t string")
    whole, apart = text.select(F.split(L.mask_variables(F.col("t")), "\n", -1), F.transform(F.split("t", "\n", -1), L.mask_line)).first()
    assert whole == apart


def test_mining_masks_every_line_once(spark, capsys):
    logs = spark.createDataFrame([("b", "x 1\n\n{}\ny 2")], "build_id string, raw_logs string")
    D.sequences(D.masked_lines(logs)).explain()
    assert capsys.readouterr().out.count("<TIMESTAMP>") == 1


def test_lookup_masks_documents_once(spark, capsys, tmp_path):
    tables = {"documents": spark.sql("SELECT 1L AS doc_id, 'a 1\\nb 2' AS text, 'en' AS lang, 's' AS source, 7L AS n_chars"),
              "labels": spark.sql("SELECT 1L AS doc_id, 0 AS quality, 0 AS toxic"),
              "events": spark.sql("SELECT id AS event_id, timestamp_ntz'2024-01-01' AS ts, id AS user_id, 'error' AS event_type, 1.0D AS value, 'p' AS props FROM range(50)")}
    for name, table in tables.items():
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    found = QUERIES["template_lookup_join"](spark, str(tmp_path))
    assert found.count() == 52
    found.explain()
    assert "documents.parquet" not in capsys.readouterr().out


def test_long_lists_of_common_tokens_are_not_read(monkeypatch):
    rng = random.Random(7)
    leaf, read = D._Leaf(12), []
    for i in range(3000):
        # Three of twelve places hold the same word in every sequence.
        leaf.place(str(i), ["and", "of", "the"] + [f"w{rng.randrange(20000)}" for _ in range(9)], 0.4)
    assert len(leaf.leaders) > 2500
    count = np.frombuffer
    monkeypatch.setattr(D.np, "frombuffer", lambda *a, **k: read.append(len(found := count(*a, **k))) or found)
    leaf._candidates(leaf.row(["and", "of", "the"] + [f"w{rng.randrange(20000)}" for _ in range(9)]), 0.4)
    assert sum(read) < 400

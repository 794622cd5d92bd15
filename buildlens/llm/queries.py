"""The registered queries of this package: thin digests of the operators, and SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buildlens.llm import (
    dual_tree, langid, lattice_dedup, licenses, minhash, norm_search, packing, permutation_index, piece_transducer, pii, plane_clusters,
    sharding, toxicity)

#: Folder of the public vocabulary files; a parameter of the operators, a fixed value of the queries.
TOKENIZERS = "/opt/tokenizers"
from buildlens.llm.common import held_out


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_paragraph_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices of every document: confirmed families, and all classified paragraphs."""
    docs = _table(spark, sf_dir, "documents")
    found = licenses.scan(docs, licenses.fit(docs))
    confirmed = F.filter("paragraphs", lambda p: p["confirmed"])
    return found.select("doc_id", F.array_sort(F.array_distinct(F.transform(confirmed, lambda p: p["family"]))).alias("families"),
                        F.size(confirmed).alias("n_confirmed"), "paragraphs")


def op2_minhash_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op3_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded, as a digest of its ids, and decoded again."""
    return piece_transducer.round_trip(_table(spark, sf_dir, "documents"), f"{TOKENIZERS}/piece_bpe_32k.model")


def op4_output_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those with crc32(id) mod 4 other than 2."""
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~held_out("doc_id", 4, 2)))
    return (langid.identify(docs, model).withColumn("held_out", held_out("doc_id", 4, 2))
            .select("doc_id", "held_out", "lang_pred", "score", "margin", "ambiguous"))


def op5_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth one."""
    rows = _table(spark, sf_dir, "embeddings")
    return permutation_index.search(permutation_index.build(rows), rows.where("vec_id % 50 = 0"))


def op6_chain_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labels of those with crc32(id) mod 3 other than 1."""
    docs = _table(spark, sf_dir, "documents")
    labels = _table(spark, sf_dir, "labels").where(~held_out("doc_id", 3, 1))
    model = toxicity.fit(docs, labels)
    return (toxicity.score(docs, model).withColumn("held_out", held_out("doc_id", 3, 1))
            .select("doc_id", "held_out", "score", "predicted", F.size("spans").cast("long").alias("n_spans"), "spans"))


def op7_norm_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest integer inner products of every fiftieth vector."""
    rows = _table(spark, sf_dir, "embeddings")
    return norm_search.top_products(rows, rows.where("vec_id % 50 = 0")).drop("exact")


def op8_vector_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens."""
    return packing.pack(_table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json")


def op9_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with personal data replaced, and what was replaced by what kind."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return (pii.pseudonymise(docs, report="found")
            .select("doc_id", "text", F.size("found").alias("n_entities"),
                    F.transform("found", lambda r: r["kind"]).alias("kinds"),
                    F.transform("found", lambda r: r["replacement"]).alias("replacements")))


def op10_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes."""
    return (sharding.assign(_table(spark, sf_dir, "documents"), 24)
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                    F.lit(None).cast("int").alias("grown_shard")))


def op11_plane_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight clusters of all vectors after ten rounds, in exact integers."""
    return plane_clusters.cluster(_table(spark, sf_dir, "embeddings")).drop("centroid")


def op12_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of the vectors of each label with cosine of 0.98 or more."""
    return lattice_dedup.near_duplicates(_table(spark, sf_dir, "embeddings")).drop("label")


def op13_dual_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return dual_tree.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


#: Rounds of the cluster twin, each one assignment and one mean.
_ROUND = """
near{i} AS (
  SELECT vec_id, v, arg_min(c, list_dot_product(v, v) - 2 * list_dot_product(v, w) + list_dot_product(w, w)) AS c FROM (
    SELECT vec_id, v, c, w FROM kept, cents{i} ORDER BY vec_id, c) GROUP BY vec_id, v),
moved{i} AS (
  SELECT c, list(m ORDER BY k) AS w FROM (
    SELECT c, k, floor(sum(x) / count(*)) AS m FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS k FROM near{i}) GROUP BY c, k) GROUP BY c),
cents{j} AS (SELECT a.c, coalesce(b.w, a.w) AS w FROM cents{i} a LEFT JOIN moved{i} b ON a.c = b.c)"""

QUERIES = {
    "op1_paragraph_classifier": op1_paragraph_classifier,
    "op2_minhash_postings": op2_minhash_postings,
    "op3_transducer": op3_transducer,
    "op4_output_codes": op4_output_codes,
    "op5_permutation_index": op5_permutation_index,
    "op6_chain_field": op6_chain_field,
    "op7_norm_sorted": op7_norm_sorted,
    "op8_vector_best_fit": op8_vector_best_fit,
    "op9_surrogates": op9_surrogates,
    "op10_sampled_splitters": op10_sampled_splitters,
    "op11_plane_clusters": op11_plane_clusters,
    "op12_lattice_dedup": op12_lattice_dedup,
    "op13_dual_tree": op13_dual_tree,
}

ORACLE = {
    "op2_minhash_postings": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM items a JOIN items b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS x, doc_id AS y FROM sets UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least ON x = doc_id""",
    "op7_norm_sorted": """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
    "op11_plane_clusters": """
WITH kept AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cents0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256(concat('3:', vec_id))) - 1 AS INTEGER) AS c, v AS w FROM kept
  ORDER BY c LIMIT 8),""" + ",".join(_ROUND.format(i=i, j=i + 1) for i in range(10)) + """,
last AS (
  SELECT vec_id, c, list_dot_product(v, v) - 2 * list_dot_product(v, w) + list_dot_product(w, w) AS d, w FROM kept, cents10),
best AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, c) AS r FROM last)
SELECT vec_id, c AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(list_transform(w, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
FROM best WHERE r = 1""",
    "op12_lattice_dedup": """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.98),
reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
degree AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT e.vec_id, coalesce(d.n, 0) AS n_links, l.component_id, e.vec_id = l.component_id AS kept
FROM embeddings e JOIN least l ON l.x = e.vec_id LEFT JOIN degree d ON d.x = e.vec_id""",
    "op13_dual_tree": r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
sizes AS (SELECT doc_id, CAST(len(t) AS BIGINT) AS n FROM words WHERE len(t) > 0),
total AS (SELECT count(*) AS docs, CAST(coalesce(sum(n), 0) AS HUGEINT) AS length FROM sizes),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM words)
  WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, term),
weight AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM tf, total GROUP BY term, docs),
impact AS (SELECT tf.doc_id, tf.term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + CAST((90 * n::HUGEINT * docs) // length AS BIGINT)))) AS x
  FROM tf JOIN sizes USING (doc_id) JOIN weight USING (term), total),
scored AS (SELECT item_id, doc_id, sum(x) AS score FROM asked JOIN impact USING (term) GROUP BY item_id, doc_id HAVING sum(x) > 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored)
SELECT item_id, rank, doc_id, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 10""",
}

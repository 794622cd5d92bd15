"""The corpus pipeline: language ID, toxicity, near-duplicates, personal data, packing.

Each stage takes what its predecessor kept; all but the last return the columns of
``documents``, the last one the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buildlens.llm import langid, minhash, packing, pii, toxicity
from buildlens.llm.queries import TOKENIZERS
from buildlens.sources.storage import materialize

#: No SQL expresses the stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language is undetermined or ambiguous."""
    return langid.filter_rows(docs, langid.fit(docs))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents with a toxicity score of 0.7 or more; labels come from the table beside the documents."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.filter_rows(docs, toxicity.fit(docs, labels))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies, the one with the smallest id; rows that repeat an id
    are versions of one document, rows without id are all kept."""
    found = minhash.near_duplicates(docs).where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("kept_id"))
    one = docs.where("doc_id IS NOT NULL").join(materialize(found, "pipeline-kept"), F.col("doc_id") == F.col("kept_id"), "left_semi")
    return one.dropDuplicates(["doc_id"]).unionByName(docs.where("doc_id IS NULL"))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in every text; the length column follows the text."""
    out = pii.pseudonymise(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents into sequences of at most 1024 tokens."""
    return packing.pack(docs, f"{TOKENIZERS}/byte_bpe_50k.json")


STAGES = [
    ("language_id", language_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("personal_data", personal_data_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

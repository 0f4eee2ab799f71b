"""Corpus pipeline: quality rules, near-duplicates, personal data, mixing, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept; all but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prudent.llm import minhash, mixing, packing, pii, quality
from prudent.llm.common import keep_ids, read, shared_path

#: key of the pseudonyms; a deployment passes its own
PII_KEY = "corpus-pipeline-key"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base or the list learned from ``labels`` rejects go."""
    return quality.keep_good(docs, quality.fit(docs, read(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8) stays.

    Rows without an id can't be named as copies and stay; repeated rows of a kept id stay together.
    """
    gone = (minhash.near_duplicates(docs, shingle_words=5).where("NOT kept")
            .select(F.col("doc_id").alias("__gone")).distinct())
    return keep_ids(docs, gone, "doc_id", "__gone", "left_anti")


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets give way to pseudonyms; ``n_chars`` follows the text."""
    return pii.pseudonymise(docs, PII_KEY, "text", "n_chars")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Half of the tokens, drawn so that sources, languages and forms come to their target shares."""
    return mixing.sample(docs, mixing.default_margins(), keep=mixing.KEEP)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenised documents with their sequence of at most 1024 ids and place in it."""
    return packing.pack_documents(docs)


STAGES = [("quality_rules", quality_stage), ("minhash_near_dedup", near_duplicate_stage), ("pii", pii_stage),
          ("source_mixing", mixing_stage), ("best_fit_packing", packing_stage)]

#: the list is learned, components are iterative and ids are a tokenizer's: not SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; every stage's rows are written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        out = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return STAGES[-1][1](spark, docs, sf_dir)

"""The corpus pipeline: quality, near-duplicates, secrets, mixing, packing. Each stage takes what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import best_fit_packing, minhash_dedup, mixing, quality_cnn, secret_scan
from factloom.llm.common import materialize


def _labels(docs: DataFrame, sf_dir: str) -> DataFrame:
    return docs.sparkSession.read.parquet(f"{sf_dir}/labels.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier doesn't reject. Null and empty texts are scored like others; texts are scored whole,
    however long; repeated rows have one fate; columns pass unchanged, whatever their names; no rows give no rows."""
    return quality_cnn.good_documents(docs, _labels(docs, sf_dir))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: five words, a similarity of 0.8. The smallest doc_id stays, one row of it; null doc_ids and
    wordless texts belong to no group, and repeated rows of a doc_id become one; columns pass unchanged; no rows give no rows."""
    return minhash_dedup.near_dedup(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets redacted. Null and empty texts stay; n_chars follows the text, other columns pass unchanged; texts are
    searched whole; repeated rows are redacted alike; no rows give no rows."""
    return secret_scan.redact_secrets(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the fitted rates say. Null and empty texts count as texts without tokens; repeated rows are rows of
    their own; ties of the drawing are settled by hashes; columns pass unchanged, whatever their names; no rows give no rows."""
    return mixing.mixed(docs, mixing.label_domains(_labels(docs, sf_dir)), mixing.TARGETS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences. Null and empty texts give one piece of one token; long texts
    are cut; repeated rows have pieces of their own; other columns are not read; no rows give no rows."""
    return best_fit_packing.pack(docs, best_fit_packing.tokenizer_path())


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("secrets", secrets), ("mixing", mix), ("packing", pack)]

#: No stage but the secrets' base patterns can be said in SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs

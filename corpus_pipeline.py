"""From raw documents to token ids: quality rules, near-duplicates, personal data, source mix, SentencePiece.

Each stage takes what its predecessor kept and returns the columns of documents, but for the last, which returns the
ids. Null texts, repeated rows and extra columns pass through as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drawlake.llm import minhash, mixing, pii, quality, sentencepieces
from drawlake.llm.common import documents, materialize, scope, table, whole_text_batches


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned decision list keeps; labels teach it.

    Null, empty and blank texts fail the base test and go; repeated rows are judged each and stay or go together; long
    texts are counted whole. An empty table, or labels of one kind only, give the base test's verdict.
    """
    return quality.kept_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8 or more).

    The smallest doc_id stays, null ids last, ties by the hash of the text; of repeated rows one stays. Texts without words
    are in no group and all stay.
    """
    return minhash.without_near_duplicates(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with their personal data replaced by its kind; n_chars follows. Null texts stay null, repeated rows stay."""
    whole_text_batches(spark)
    out = docs.withColumn("text", pii.redact(F.col("text")))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them. Texts without words are never taken; a null source is one of its own; equal rows are interchangeable."""
    return mixing.mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, ids, n_pieces, n_bytes, decoded_ok`` of every document of the mix, repeats included; a null text has null ids."""
    return sentencepieces.encode_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
    ("token_ids", token_ids),
]

#: The rules are learned and the pieces come from a vocabulary file: no SQL gives these rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. A stage's own tables are deleted once its output is written; the outputs go with ``forget_tables``."""
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        if k + 1 == len(STAGES):
            return stage(spark, docs, sf_dir)
        with scope(spark, name) as forget:
            made = stage(spark, docs, sf_dir)
        docs = materialize(made, name)
        forget()
    raise AssertionError("no stages")

"""Training-data pipeline over documents: each stage reads what the one before has written, and what it decides takes effect.

1. toxicity: documents scored as toxic go. 2. near_duplicates: of each group of near copies (linked by a similarity of five-word
shingles of 0.8 or more, checked on the texts) one document stays. 3. decontamination: documents that hold a passage of the benchmark go. 4. personal_data: spans are
replaced by their kind. 5. mixing: every document that is left gets its domain and its rate. Stages 1 to 4 return the columns of
documents; nulls in any of them pass through, and an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import table, written
from ledgerline.llm.decontaminate import find_passages
from ledgerline.llm.mixing import mix
from ledgerline.llm.near import one_of_each
from ledgerline.llm.pii import redacted
from ledgerline.llm.queries import MIX_WEIGHTS, labelled_languages
from ledgerline.llm.toxicity import score_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score below 0.5, learnt from all labels."""
    scored = score_toxicity(docs, table(spark, sf_dir, "labels"), F.lit(True), docs.columns)
    return scored.where("score < 0.5").select("kept.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group. Every row counts for itself: rows that share an id, or have none, are told apart by their texts."""
    return one_of_each(docs, words=5, least=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of ten words of the benchmark."""
    found = find_passages(docs, table(spark, sf_dir, "benchmark"), 10, columns=docs.columns)
    return found.where(F.size("hits") == 0).select("kept.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in text replaced, n_chars counted anew."""
    return redacted(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with mix_tokens, mix_domain, mix_posterior and mix_rate."""
    return mix(docs, labelled_languages(docs, table(spark, sf_dir, "labels")), MIX_WEIGHTS)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_copies),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("mixing", mixing),
]

#: The stages learn models, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs

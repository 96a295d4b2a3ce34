"""A training corpus from raw documents: grade, drop near-copies, decontaminate, hide secrets, pack.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written as Parquet and read again as the next one's docs. All but
the last return the columns of documents; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmatch.llm import _common, decontaminate, grading, near_copies, packing, secrets


def _kept(found: DataFrame, docs: DataFrame, condition: str) -> DataFrame:
    return found.where(condition).select(*[F.col(f"`{x}`") for x in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose probability of the highest grade reaches the threshold. A null or empty text has the thresholds' own odds."""
    labels = grading.quality_grade(_common.table(spark, sf_dir, "labels"))
    names = _common.fresh(docs, "_grade", "_tail", "_keep")
    return _kept(grading.classify(docs, labels, names=names), docs, names[2])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class that covering SimHash proposes and 0.8 or more of five-word shingles links: that with the smallest id.

    Of rows that share it the smallest text stays; all texts without words, null ones too, are one class.
    """
    return near_copies.representatives(docs)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops every document in which a window of a benchmark item occurs, however small its share. A null text has no windows."""
    names = _common.fresh(docs, "_n_words", "_n_hit", "_items", "_contaminated")
    found = decontaminate.find(docs, _common.table(spark, sf_dir, "benchmark"), names=names)
    return _kept(found, docs, f"{names[1]} = 0")


def hidden_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in texts; all documents stay, and a null text stays null."""
    made = secrets.redact(docs)
    return made.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else made


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens."""
    return packing.pack(docs)


STAGES = [("quality classifier", quality), ("SimHash near-dedup", near_duplicates), ("decontamination", contamination), ("secrets", hidden_secrets), ("packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared folder and read again."""
    docs = _common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = _common.materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

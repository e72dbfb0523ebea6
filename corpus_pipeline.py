"""The corpus pipeline: quality classifier, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.  All but the last
return the columns of `documents`; the last returns each kept piece and its place in a training sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutplan.llm import decontaminate, line_dedup, near_dedup, packing, quality
from cutplan.llm.shared import saved, table, work_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(docs: DataFrame, text: str) -> DataFrame:
    """The columns of documents, with `text` as the text and its length counted anew."""
    return docs.withColumn("text", F.col(text)).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5 go; all labels are learned from."""
    model = quality.learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold=None)
    return quality.score(docs, model).where("quality_score >= 0.5").select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go except in the largest doc_id; a document that is left without any text goes too."""
    done = line_dedup.dedup_lines(docs).withColumn("kept", F.col("line_dedup.kept"))
    return _documents(done.where("line_dedup.n_dropped = 0 OR kept <> ''"), "kept")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of the smallest doc_id of each near-duplicate group stays (five words, similarity 0.8 or more)."""
    return near_dedup.kept_documents(docs).select(*COLUMNS)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; a document that is mostly benchmark text goes."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return _documents(decontaminate.remove_spans(found), "text")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every kept document's pieces and their places in training sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("decontaminate", benchmark_stage),
    ("packing", packing_stage),
]
#: The stages learn, hash and pack, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = work_dir(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs, f"{folder}/{name}")
    return docs

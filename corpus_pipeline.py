"""From raw documents to packed sequences: each stage works on what the one before it kept.

toxicity        documents that score 0.7 or more go
exact_dedup     one of each group of equal texts stays
near_dedup      one of each group of near duplicates stays
decontaminate   contaminated documents go, hit spans of the others are cut out
pack            pieces of sequences of 4096 ids

A stage is written as Parquet in the shared folder before the next reads it; what the stage made on its way is
deleted then.  Null texts count as empty: they pass the first stage, one of them the second, and are packed as an
end id.  Repeated rows are documents of their own, of which the second stage keeps one.  Empty tables give no
pieces.  Columns besides doc_id, text and n_chars pass through whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarn import shared
from tarn.llm.common import remove, saved, scratch
from tarn.llm.decontamination import decontaminate
from tarn.llm.exact_dedup import drop_exact_duplicates
from tarn.llm.near_dedup import drop_near_duplicates
from tarn.llm.packing import pack
from tarn.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.7 stay, those without words too; rules as in ``toxicity.fit`` and ``with_scores``."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays, of all empty ones too; rules as in ``exact_duplicates``."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays, and every text without words; rules as in ``near_duplicates``."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated stay, without the spans hit; rules as in ``decontaminate``."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), length_col="n_chars")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece, an end id for an empty text; rules as in ``pack``."""
    return pack(docs).drop("row_id")


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontamination),
    ("pack", packing),
]

#: Scores, signatures and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the table ``documents`` to pieces."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for i, (name, stage) in enumerate(STAGES):
        before = set(shared.MADE)
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            made = [path for path in shared.MADE if path not in before]
            path = scratch(spark, f"pipeline-{name}")
            docs = saved(docs, path)
            remove(spark, *made, *last)
            last = [path]
    return docs

"""A corpus pipeline: five stages in a row, each over all that the stage before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet in the folder of
spark.checkpoint.dir and read again as the next stage's documents.  All but the last return the columns of documents; the last adds
epoch, shard, position and repeats.

1. toxicity: documents whose calibrated score reaches the threshold go.
2. near_duplicates: of each group of near copies the document of the least id stays.
3. repeated_passages: later occurrences of runs of 50 tokens are cut from the texts; documents that nothing is left of go.
4. decontamination: documents that leak a benchmark item go.
5. mixing: sources by tempered weights, in shuffled shards.  Every document that is left has one row, with the place of its first draw; a
   scarce source's are drawn again, at the places in repeats.  op1_mixing.unfold makes a row of every draw.

Tables may be empty or have NULLs, repeated rows and further columns; each stage's module states what comes of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import op1_mixing, op2_toxicity, op3_neardup, op4_decontamination, op7_suffixes
from textloom.llm.packed import Stored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op2_toxicity.drop_toxic(docs, _table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op3_neardup.drop_near_duplicates(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op7_suffixes.cut_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op4_decontamination.drop_leaks(docs, _table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op1_mixing.mix(docs, fold=True)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

ORACLE_SQL = None  # votes, signatures and draws are beyond SQL; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = _table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        kept = Stored(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            before.drop()
        docs, before = kept.df, kept
    return docs

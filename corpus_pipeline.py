"""The training-data pipeline: documents through quality rules, line dedup, near duplicates, decontamination and mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again
as the next stage's documents. All stages but the last return the columns of documents.

SQL can't express the pipeline as a whole: its third and fourth stages have no SQL form, so ORACLE_SQL is
None and the tests hold every stage against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import decontaminate, jaccard, line_dedup, mixing, quality
from sluice.session import fresh, write_out

ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that their own rules and their host's verdict keep."""
    measures, kept = fresh("quality", docs), fresh("kept", docs)
    judged = quality.quality_rules(docs, quality=measures, out=kept)
    return judged.filter(F.col(kept)).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of repeated runs of lines; documents of which nothing is left go."""
    prefix = "lines_"
    while any(c.lower().startswith(prefix.lower()) for c in docs.columns):
        prefix += "_"
    cut = line_dedup.line_dedup(docs, prefix=prefix)
    left = cut.filter((F.col(f"{prefix}removed") == 0) | (F.trim(F.col("text")) != ""))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return jaccard.one_per_group(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents that it takes, with size, source_size, target and taken words."""
    mixed = mixing.mix(docs, prefix="mix_")
    return mixed.filter("mix_taken > 0")


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("ngram_jaccard", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_out(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

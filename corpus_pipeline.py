"""Corpus pipeline: quality rules, near-duplicates, repeated passages, source mix, packing.

Each stage takes all rows its predecessor kept and its decisions take effect: rejected documents
and copies go, repeated passages are cut out of the text, the mix repeats or leaves out documents,
and the last stage returns the pieces of the packed sequences.  All stages but the last return the
columns of ``documents`` (``n_chars`` follows the text).  Only copies go in the near-duplicate
stage: unlike texts under one id stay, and rows without an id give way to copies that have one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.llm.mixing import emit
from jobloom.llm.near_dups import one_of_each
from jobloom.llm.packing import pack
from jobloom.llm.quality_rules import keep_good
from jobloom.llm.scratch import Scratch
from jobloom.llm.substring_dedup import without_repeats


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a quality rule go."""
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays: the one with the smallest id."""
    return one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are cut; a document that loses all its words goes."""
    cut = without_repeats(docs).where((F.col("n_removed") == 0) | (F.col("text") != ""))
    new = {"n_chars": F.char_length("text").cast("long")} if "n_chars" in docs.columns else {}
    return cut.withColumns(new).select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources by target weights: a row for each copy that it takes."""
    return emit(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences."""
    return pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

# Tokenizer ids, exact overlap classes and greedy bins have no SQL form: the stages are tested
# against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""The registered queries of this subpackage: each applies one operator to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_model import classify
    from .textmap import held_out
    good = table(spark, sf_dir, "labels", "doc_id", "quality").where("quality = 1")
    docs = table(spark, sf_dir, "documents", "doc_id", "lang", "text")
    held = held_out("doc_id", 5, 1)
    return classify(docs, good, held).withColumn("held_out", held)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack
    return pack(table(spark, sf_dir, "documents", "doc_id", "text"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import fingerprint_pairs
    return fingerprint_pairs(table(spark, sf_dir, "documents", "doc_id", "text"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_scoring import fit, score
    from .textmap import held_out
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = fit(docs.where(~held_out("doc_id", 5, 1)))
    return score(docs, model, keep_text=False).select(
        "doc_id", held_out("doc_id", 5, 1).alias("held_out"), "n_tokens", "n_known",
        "train_tokens", "base_score", "score")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import apply_rules
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return apply_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .textmap import held_out
    from .toxicity import fit, score
    held = held_out("doc_id", 3, 1)
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic").where(~held)
    return score(docs, fit(docs, labels), keep_text=False).select(
        "doc_id", held.alias("held_out"), "score", "predicted")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import removals
    return removals(table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dups import near_duplicates
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix
    docs = mix(table(spark, sf_dir, "documents", "doc_id", "source", "text"))
    return docs.select("doc_id", "size", "source_size", "target",
                       (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import fit, predict
    from .textmap import held_out
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    net = fit(docs.where(~held_out("doc_id", 4, 2)))
    return predict(docs.select("doc_id", "text"), net, keep_text=False).select(
        "doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periodic import run_digests
    return run_digests(table(spark, sf_dir, "documents", "doc_id", "text"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hard_negatives import hard_negatives, quantised
    rows = quantised(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved), "vec_id % 100 = 0")


def op13_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_fingerprints": op3_fingerprints,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_quality_rules": op5_quality_rules,
    "op6_toxicity": op6_toxicity,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_source_mixing": op9_source_mixing,
    "op10_language_id": op10_language_id,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_simhash_near_duplicates": op13_simhash_near_duplicates,
}

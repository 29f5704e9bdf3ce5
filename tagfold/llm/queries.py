"""The numbered queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagfold.llm import license_templates, near_dedup, packing, permutation_index, quality_forest, range_coder, rule_ensemble, source_mix, token_counts, warc
from tagfold.llm.common import table


def op1_range_coder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return range_coder.read(range_coder.written(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op2_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_templates.scanned(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.grouped(table(spark, sf_dir, "documents"), unnamed=True)


def op5_quality_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_forest.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op7_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.captures(spark, warc.write(table(spark, sf_dir, "pages")))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", source_mix.size_of(F.col("text")).alias("size"))
    return source_mix.mix(docs, ["doc_id"]).select("doc_id", "size", "source_size", "target", "taken", "first_slot")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = rule_ensemble.train(docs, table(spark, sf_dir, "labels"))
    score = rule_ensemble.scored(docs, model, ["doc_id"])
    return score.select("doc_id", rule_ensemble.is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_range_coder": op1_range_coder,
    "op2_license_templates": op2_license_templates,
    "op3_token_counts": op3_token_counts,
    "op4_near_dedup": op4_near_dedup,
    "op5_quality_forest": op5_quality_forest,
    "op6_permutation_index": op6_permutation_index,
    "op7_warc_transactions": op7_warc_transactions,
    "op8_source_mix": op8_source_mix,
    "op9_packing": op9_packing,
    "op10_rule_ensemble": op10_rule_ensemble,
}

ORACLES: dict[str, str] = {
    "op4_near_dedup": near_dedup.ORACLE_SQL,
    "op7_warc_transactions": warc.ORACLE_SQL,
    "op8_source_mix": source_mix.ORACLE_SQL,
}

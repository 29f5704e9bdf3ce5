"""A training corpus from documents, stage by stage.

Each stage takes all that the one before kept. Quality rules and the classifier drop what they reject, near-dedup keeps
one document of each group, the mix repeats and cuts documents until each source gives its target, and packing deals the
mixed documents, encoded whole, to sequences. Rows are whole throughout; nothing is sampled but the rows that the two
models are fitted on, which documented parameters bound.

Documents without a source mix as a source of their own; an empty table passes through all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tagfold.llm import near_dedup, packing, quality_forest, rule_ensemble, source_mix
from tagfold.llm.common import saved, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_forest.filtered(docs, table(spark, sf_dir, "labels"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return rule_ensemble.filtered(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.filtered(docs, unnamed=True)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return source_mix.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document that the mix repeats is packed each time: its pieces appear once for each copy."""
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


#: Fitted forests and rules, and a tokenizer, can't be written in SQL; a test compares the stages with brute force instead.
ORACLE_SQL = None

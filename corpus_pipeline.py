"""From raw documents to an encoded training mix: five stages, each over all that the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import mixing, quality_classifier, quality_rules, sentencepiece_codec, simhash
from millrace.llm.common import stage_table
from millrace.llm.queries import piece_model_path


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be good."""
    return quality_classifier.keep_predicted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base checks and that the weakly supervised rules hold to be good."""
    return quality_rules.keep_good(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: sets of five-word shingles that have four fifths or more in common."""
    return simhash.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, and whether they decode to its text."""
    return sentencepiece_codec.encode(docs, sentencepiece_codec.Model.load(piece_model_path()), check=True)


STAGES = [
    ("quality classifier", classify),
    ("quality rules", apply_rules),
    ("simhash near-dedup", deduplicate),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: The classifier, the label model, fingerprints and tokens are beyond SQL; tests hold each against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)

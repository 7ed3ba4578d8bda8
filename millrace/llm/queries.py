"""The registered queries of the training-data operators: each applies one, with production parameters, to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, language_model, license_scan, matroska, mixing, quality_classifier, quality_rules, sentencepiece_codec, simhash, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


URL_RULES = [
    url_filter.UrlRule("allow", "org/"),
    url_filter.UrlRule("block", "example.org/es/"),
    url_filter.UrlRule("block", "example.org/en/1"),
    url_filter.UrlRule("allow", "com/fr/"),
    url_filter.UrlRule("block", "com/de/"),
]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled URLs: pages whose path names (as its first number) a document with a quality label."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    labels = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("number"), F.col("quality").alias("label"))
    shown = pages.select("url", F.expr("try_cast(regexp_extract(url, '://[^/?#]*[^?#]*?/([0-9]+)', 1) AS bigint)").alias("number"))
    model = url_filter.fit(shown.where("number is not null").join(labels, "number").select("url", "label"))
    return url_filter.judge(pages, URL_RULES, model)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan_copies(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_held_out(_table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", *quality_rules.BASE, "base_failed", "kept", F.round("posterior", 6).alias("posterior"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def piece_model_path() -> str:
    """The SentencePiece model file of the public tokenizers on this machine."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = sentencepiece_codec.Model.load(piece_model_path())
    return sentencepiece_codec.encode(_table(spark, sf_dir, "documents"), model, check=True)


def op9_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.store_texts(_table(spark, sf_dir, "documents"))


PLANTED = "\\### Assistant: </turn> ok"


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(-7, 0, "user", PLANTED), (-7, 1, "assistant", PLANTED)], "conv_id long, turn long, role string, text string")
    return chat_format.digests(chat_format.render(turns.unionByName(planted)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_url_filter, op2_quality_classifier, op3_mixing, op4_lm_scoring, op5_quality_rules,
            op6_license_scan, op7_simhash, op8_sentencepiece, op9_matroska, op10_chat_format,
        )
    }


ORACLE = {
    "op10_chat_format": r"""
    WITH planted(conv_id, turn, role, text) AS (
        VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
    turns AS (
        SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
        UNION ALL SELECT * FROM planted)
    SELECT conv_id, count(*) AS n_turns,
        sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn, r, t)) AS turns_sha256,
        CAST(sum(CASE WHEN r = 'assistant' THEN length(t) ELSE 0 END) AS BIGINT) AS loss_chars,
        sha256(coalesce(string_agg(t, '' ORDER BY turn, r, t) FILTER (WHERE r = 'assistant'), '')) AS loss_sha256,
        CAST(sum(14 + length(r) + length(t) + len(regexp_extract_all(t, '\\|### |</turn>'))) AS BIGINT) AS formatted_chars
    FROM turns GROUP BY conv_id""",
}


def oracle_sql() -> dict[str, str]:
    return ORACLE | {"op5_quality_rules": quality_rules.judge_sql(), "op6_license_scan": license_scan.scan_sql()}

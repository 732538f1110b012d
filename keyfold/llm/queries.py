"""Thin queries over the standard tables, one for each training-data operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linededup import dedup_lines, digest

    return digest(dedup_lines(table(spark, sf_dir, "documents")))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .chat import digest, format_chat, text_parts

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    added = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(tricky).alias("text"))
    return digest(format_chat(turns.unionByName(added).withColumn("parts", text_parts())))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import digest, mix

    return digest(mix(table(spark, sf_dir, "documents")))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urlfilter import judge, labelled_urls, train

    return judge(table(spark, sf_dir, "pages"), train(labelled_urls(spark)))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rules of op5 say, without the model, which SQL can't fit."""
    from .urlfilter import ruled

    return ruled(table(spark, sf_dir, "pages"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .langid import held_out, identify, train

    docs = table(spark, sf_dir, "documents")
    found = identify(docs, train(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan

    return scan(table(spark, sf_dir, "documents"))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .vectors import build_index, search

    graphs, clean = build_index(table(spark, sf_dir, "embeddings"))
    return search(graphs, clean.where(F.col("vec_id") % 20 == 0))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .tokens import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination, digest

    return digest(contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def queries() -> dict:
    return {f.__name__: f for f in (op1_line_dedup, op2_near_dedup, op3_chat_format, op4_mixing, op5_url_filter, url_rules, op6_language_id, op7_license_scan, op8_nearest, op9_token_counts, op10_decontamination)}


def oracle_sql() -> dict[str, str]:
    from .oracle import SQL

    return {k: v for k, v in SQL.items() if k in queries()}

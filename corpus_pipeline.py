"""Corpus pipeline: each stage takes the documents that the last one kept.

Stages, in order: language identification, line dedup, near-dedup, benchmark
decontamination, mixing.  ``run`` applies them to the documents table; each
stage's result is written as Parquet to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfold.llm import decontaminate, langid, linededup, mixing, neardup
from keyfold.llm.common import remove, table, temporary

#: A text of JUDGED normal characters or more is in no learned language if it needs more than MOST_PHRASES times the phrases
#: that labelled text of that language needs.  Text of a learned language needs about once as many, unknown letters six times.
MOST_PHRASES, JUDGED = 3.5, 40


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those that are in no learned language."""
    return langid.known_rows(docs, langid.train(docs), MOST_PHRASES, JUDGED)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; every document stays, if only with the rest of its lines."""
    return linededup.replace_texts(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays.  Rows that repeat a doc_id stay or go together."""
    found = neardup.near_duplicates(docs.select("doc_id", "text"))
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("gone_id"))
    return docs.alias("d").join(gone.hint("shuffle_hash").alias("g"), F.col("d.doc_id").cast("bigint") == F.col("g.gone_id"), "left_anti")


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of the benchmark occurs go, however long they are."""
    return decontaminate.clean_rows(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with ``copies``, how often."""
    return mixing.take(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", decontaminate_benchmark),
    ("mixing", mix_sources),
]

#: SQL can't express language identification by suffix automata; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        # A stage's own tables go once its result is written, and the result once the next one is.
        with temporary(spark) as keep:
            docs, path = keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if last:
            remove(spark, last)
        last = path
    return docs

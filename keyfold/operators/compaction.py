"""Levelled compaction: scores, picks, merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyfold.config import StorageConfig
from keyfold.operators.log import newest
from keyfold.operators.runs import recency


def level_stats(meta: DataFrame) -> DataFrame:
    return meta.groupBy("level").agg(F.count(F.lit(1)).alias("runs"), F.sum("size_bytes").alias("bytes"))


def level_scores(meta: DataFrame, config: StorageConfig) -> DataFrame:
    """level, score: runs over their target for level 0, bytes over theirs below; 32-bit floats."""
    target = F.lit(float(config.level_1_bytes)) * F.pow(F.lit(float(config.level_growth)), F.col("level") - 1)
    runs = F.col("runs").cast("float") / F.lit(config.level_0_runs).cast("float")
    share = (F.col("bytes").cast("float") / target.cast("float")).cast("float")
    return level_stats(meta).select("level", F.when(F.col("level") == 0, runs.cast("float")).otherwise(share).alias("score"))


def due_level(meta: DataFrame, config: StorageConfig, broken: tuple = ()) -> DataFrame:
    """The level to compact next, none if all scores are below 1: the highest score, the deepest of equals."""
    return level_scores(meta, config).where((F.col("score") >= 1) & ~F.col("level").isin(list(broken) or [-1])).orderBy(F.col("score").desc(), F.col("level").desc()).limit(1)


def pick_level_0(meta: DataFrame) -> DataFrame:
    """All runs of level 0 and the runs of level 1 within their joint range."""
    span = meta.where("level = 0").agg(F.min("min_key").alias("low"), F.max("max_key").alias("high"))
    near = meta.where("level = 1").join(span, (F.col("min_key") <= F.col("high")) & (F.col("max_key") >= F.col("low")), "left_semi")
    return meta.where("level = 0").unionByName(near)


def pick_level(meta: DataFrame, level: int) -> DataFrame:
    """The first run of a level by keys and the runs of the next within its range."""
    first = meta.where(F.col("level") == level).orderBy("min_key", "max_key", "run_id").limit(1)
    span = first.select(F.col("min_key").alias("low"), F.col("max_key").alias("high"))
    near = meta.where(F.col("level") == level + 1).join(span, (F.col("min_key") <= F.col("high")) & (F.col("max_key") >= F.col("low")), "left_semi")
    return first.unionByName(near)


def merge(run_entries: DataFrame) -> DataFrame:
    """One entry a key, from the lowest level and newest run; tombstones stay."""
    return newest(run_entries, *recency())


def stale(run_entries: DataFrame) -> DataFrame:
    """The entries that a merge discards."""
    place = F.row_number().over(Window.partitionBy("key").orderBy(*recency()))
    return run_entries.withColumn("place", place).where(F.col("place") > 1).drop("place")

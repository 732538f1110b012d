"""The run catalogue as a relation of edits.

An edit is (edit_seq, action, run_id, metadata).  The edits of one commit share
an edit_seq and take effect together: removals first, then additions.  Replay
reads all edits of each commit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

META = ("entry_count", "size_bytes", "level", "min_key", "max_key")


def replay(edits: DataFrame) -> DataFrame:
    """The live runs: those whose last edit adds them."""
    last = F.struct("edit_seq", (F.col("action") == "ADD").alias("added"))
    fold = edits.groupBy("run_id").agg(F.max_by(F.struct("action", *META), last).alias("last"))
    return fold.where(F.col("last.action") == "ADD").select("run_id", *[F.col(f"last.{c}").alias(c) for c in META])


def snapshot_at(edits: DataFrame, edit_seq: int) -> DataFrame:
    return replay(edits.where(F.col("edit_seq") <= edit_seq))


def additions(meta: DataFrame, edit_seq: int) -> DataFrame:
    return meta.select(F.lit(edit_seq).cast("bigint").alias("edit_seq"), F.lit("ADD").alias("action"), "run_id", *META)


def removals(run_ids: DataFrame, edit_seq: int) -> DataFrame:
    nothing = {"entry_count": "bigint", "size_bytes": "bigint", "level": "int", "min_key": "binary", "max_key": "binary"}
    return run_ids.select(F.lit(edit_seq).cast("bigint").alias("edit_seq"), F.lit("REMOVE").alias("action"), "run_id", *[F.lit(None).cast(t).alias(c) for c, t in nothing.items()])

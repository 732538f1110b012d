"""Sorted runs: assignment, exact rotation, sizes, metadata, overlap, tiered reads.

Exact rotation and output splitting depend on all rows before; they are folds
over a shard's rows in order.  A fold streams through sorted partitions in
constant memory (a memtable's keys at most), one task a shard, block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyfold.errors import OversizedEntry
from keyfold.functions import entry_size
from keyfold.operators.log import carried, entries, newest

#: Bytes of a run's header.
HEADER = 2


def sized(rows: DataFrame) -> DataFrame:
    return rows.withColumn("size", entry_size(F.col("key"), F.col("value"), F.col("tombstone")))


def size_deltas(rows: DataFrame, *within: str) -> DataFrame:
    """What each write adds to a memtable: its size less that of the key's last one."""
    before = carried(sized(rows), [*within, "key"], F.col("size"), "before")
    return before.withColumn("delta", F.col("size") - F.coalesce("before", F.lit(0))).drop("before")


def runs_by_count(log: DataFrame, every: int) -> DataFrame:
    """Run entries, a new run after so many mutations: the last entry of each key and run.

    Numbers come from counts of blocks of seq, summed in two levels, so neither
    the log nor the list of blocks is gathered in one task.  seq must be unique.
    """
    rows = entries(log).withColumn("block", F.floor(F.col("seq") / every))
    upto = lambda *within: Window.partitionBy(*within).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("block").agg(F.count(F.lit(1)).alias("n")).withColumn("large", F.floor(F.col("block") / 4096))
    larges = counts.groupBy("large").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("large").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("block", "large", F.coalesce(F.sum("n").over(upto("large")), F.lit(0)).alias("inside")).join(larges.select("large", before.alias("before")), "large")
    place = F.row_number().over(Window.partitionBy("block").orderBy("seq"))
    numbered = rows.withColumn("place", place).join(starts.select("block", (F.col("before") + F.col("inside")).alias("start")), "block")
    run = F.floor((F.col("start") + F.col("place") - 1) / every).cast("bigint")
    return newest(numbered.select("key", "tombstone", "value", "seq", run.alias("run_id")), F.col("seq").desc(), within=("run_id",))


def _fold(rows: DataFrame, order: str, schema: str, step) -> DataFrame:
    """step(): called for each shard, gives a function from the shard's next block of rows to the block to emit."""
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, act = None, None
        for frame in frames:
            for own, block in frame.groupby("shard", sort=False):
                if act is None or own != shard:
                    shard, act = own, step()
                yield pd.DataFrame(dict(zip(columns, act(block))))

    return rows.repartition("shard").sortWithinPartitions("shard", order).mapInPandas(run, schema)


def _shard(shard: Column | None) -> Column:
    return (F.lit(1) if shard is None else shard).cast("int").alias("shard")


def rotate(log: DataFrame, max_bytes: int, shard: Column | None = None) -> DataFrame:
    """seq, run_id, used of each mutation under the exact memtable limit.

    A write that would grow the table past max_bytes starts the next one;
    shrinking and equal writes always fit.  An entry that no table can hold is
    refused.
    """
    sizes = sized(entries(log)).select(_shard(shard), "seq", "key", "size")

    def step():
        table, used, run_id = {}, 0, 0

        def act(block):
            nonlocal table, used, run_id
            if (block["size"] > max_bytes).any():
                first = block[block["size"] > max_bytes].iloc[0]
                raise OversizedEntry(f"mutation {first['seq']} has {first['size']} bytes; a memtable holds {max_bytes}")
            runs, useds = [], []
            for key, size in zip(map(bytes, block["key"]), block["size"].tolist()):
                delta = size - table.get(key, 0)
                if delta > 0 and used + delta > max_bytes:
                    table, used, run_id, delta = {}, 0, run_id + 1, size
                table[key] = size
                used += delta
                runs.append(run_id)
                useds.append(used)
            return block["shard"], block["seq"], runs, useds

        return act

    return _fold(sizes, "seq", "shard int, seq bigint, run_id bigint, used bigint", step)


def split_outputs(merged: DataFrame, run_bytes: int, shard: Column | None = None) -> DataFrame:
    """shard, key, output, bytes of each merged entry (key, value, tombstone): a run ends with the entry that reaches run_bytes.

    Each shard is cut on its own, as it is compacted on its own.
    """
    sizes = sized(merged).select(_shard(shard), "key", "size")

    def step():
        output, held = 0, HEADER

        def act(block):
            nonlocal output, held
            upto = np.cumsum(block["size"].to_numpy())
            outputs, bytes_, at, before = np.empty(len(upto), np.int64), np.empty(len(upto), np.int64), 0, 0
            while at < len(upto):
                # The entry that reaches the limit, or the block's last.
                last = min(int(np.searchsorted(upto, run_bytes - held + before)), len(upto) - 1)
                outputs[at : last + 1], bytes_[at : last + 1] = output, held + upto[at : last + 1] - before
                held, before, at = int(bytes_[last]), int(upto[last]), last + 1
                if held >= run_bytes:
                    output, held = output + 1, HEADER
            return block["shard"], block["key"], outputs, bytes_

        return act

    return _fold(sizes, "key", "shard int, key binary, output bigint, bytes bigint", step)


def group_commits(commands: DataFrame, batch_commands: int, window_ms: int, shard: Column | None = None) -> DataFrame:
    """shard, seq, batch of each logged command (seq, at_ms): a batch ends at so many commands or when the window is over.

    The window starts with the shard's log, and anew after each end.
    """
    rows = commands.select(_shard(shard), "seq", F.col("at_ms").cast("bigint").alias("at_ms"))

    def step():
        batch, n, deadline = 0, 0, None

        def act(block):
            nonlocal batch, n, deadline
            times = block["at_ms"].to_numpy()
            # Times may fall; the window is over with the first that isn't before its end.
            out, at = np.empty(len(times), np.int64), 0
            deadline = int(times[0]) + window_ms if deadline is None else deadline
            while at < len(times):
                if times[at] >= deadline:
                    batch, n = batch + (n > 0), 0
                    deadline += (int(times[at]) - deadline) // window_ms * window_ms + window_ms
                room = times[at : at + batch_commands - n]
                over = np.flatnonzero(room >= deadline)
                some = int(over[0]) if len(over) else len(room)
                out[at : at + some] = batch
                at, n = at + some, n + some
                if n >= batch_commands:
                    batch, n, deadline = batch + 1, 0, int(times[at - 1]) + window_ms
            return block["shard"], block["seq"], out

        return act

    return _fold(rows, "seq", "shard int, seq bigint, batch bigint", step)


def describe(run_entries: DataFrame) -> DataFrame:
    """run_id, level, entry_count, size_bytes, min_key, max_key of each run."""
    rows = sized(run_entries if "level" in run_entries.columns else run_entries.withColumn("level", F.lit(0)))
    return rows.groupBy("run_id", "level").agg(
        F.count(F.lit(1)).alias("entry_count"), (F.sum("size") + HEADER).alias("size_bytes"), F.min("key").alias("min_key"), F.max("key").alias("max_key")
    )


def overlapping(meta: DataFrame, level: int, low: Column, high: Column) -> DataFrame:
    """The runs of a level of 1 or more that share keys with low to high, both included."""
    if level == 0:
        raise ValueError("runs of level 0 overlap each other; only deeper levels can be searched by range")
    return meta.where((F.col("level") == level) & (F.col("min_key") <= high) & (F.col("max_key") >= low))


#: Where a row can stand, newest first.
TIERS = {"active": 0, "draining": 1, "immutable": 2, "run": 3}


def recency(level: str = "level", run_id: str = "run_id") -> list[Column]:
    """Newest first: lower level, then higher run."""
    return [F.col(level).asc(), F.col(run_id).desc()]


def tiered_latest(run_entries: DataFrame) -> DataFrame:
    """Each key's entry by tier, level and run; a tombstone counts as found."""
    tier = F.lit(3) if "tier" not in run_entries.columns else F.coalesce(*[F.when(F.col("tier") == k, v) for k, v in TIERS.items()])
    return newest(run_entries.withColumn("rank", tier), F.col("rank").asc(), *recency()).drop("rank")


def _last_before(spark, marks: DataFrame, points: DataFrame, folder: str) -> DataFrame:
    """points (level, key, ...) with ``mark``: that of the last of marks (level, key, mark) at or before each, by key in its level.

    Both are dealt together by ranges of (level, key), and each range's last mark
    is handed on, so neither a level nor the marks are gathered in one task.
    """
    empty = [F.lit(None).cast(t).alias(c) for c, t in points.dtypes if c not in ("level", "key")]
    both = marks.select("level", "key", "mark", *empty).unionByName(points.select("*", F.lit(None).cast(marks.schema["mark"].dataType).alias("mark")))
    dealt = both.repartitionByRange("level", "key").withColumn("part", F.spark_partition_id())
    # Written: ranges are drawn anew each time that a plan runs.
    dealt.write.parquet(folder)
    dealt = spark.read.schema(dealt.schema).parquet(folder)
    inside = Window.partitionBy("part", "level").orderBy("key", F.col("mark").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("level").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ends = dealt.groupBy("part", "level").agg(F.max_by("mark", F.when(F.col("mark").isNotNull(), F.col("key"))).alias("end"))
    ends = ends.select("part", "level", F.last("end", ignorenulls=True).over(earlier).alias("handed"))
    near = dealt.withColumn("near", F.last("mark", ignorenulls=True).over(inside)).where(F.col("mark").isNull())
    return near.join(ends, ["part", "level"]).withColumn("mark", F.coalesce("near", "handed")).drop("near", "handed", "part")


def read_cost(run_entries: DataFrame, meta: DataFrame, probes: DataFrame, folder: str) -> DataFrame:
    """req_id, runs_visited of each probe: all of level 0 from the newest, then by range, up to the first hit.

    Runs of level 1 and more are disjoint in each level, so a probe visits one at
    most of each.  folder: where to put a table for the time of the query.
    """
    asked = probes.select("req_id", "key")
    hits = run_entries.join(asked.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.min(F.struct("level", (-F.col("run_id")).alias("newest"))).alias("hit"))
    # Level 0 is what compaction has not merged yet: a few runs, numbered from the newest.
    counts = {r["level"]: r["n"] for r in meta.groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect()}
    top = meta.where("level = 0").select((-F.col("run_id")).alias("newest"), F.row_number().over(Window.orderBy(F.col("run_id").desc())).alias("visited"))
    deep = meta.where("level > 0")
    marks = deep.select("level", F.col("min_key").alias("key"), F.col("max_key").alias("mark"))
    levels = F.array(*[F.lit(k) for k in sorted(counts) if k > 0]).cast("array<int>")
    points = asked.withColumn("level", F.explode(levels))
    inside = _last_before(asked.sparkSession, marks, points, folder).where(F.col("mark") >= F.col("key")).select("req_id", "key", F.col("level").alias("inside"))
    told = asked.join(hits, "key", "left").join(top, (F.col("hit.level") == 0) & (F.col("hit.newest") == F.col("newest")), "left")
    before = inside.join(hits, "key", "left").where(F.col("hit").isNull() | (F.col("inside") <= F.col("hit.level"))).groupBy("req_id").agg(F.count(F.lit(1)).alias("deeper"))
    return told.join(before, "req_id", "left").select("req_id", F.coalesce("visited", F.lit(counts.get(0, 0)) + F.coalesce("deeper", F.lit(0))).cast("bigint").alias("runs_visited"))

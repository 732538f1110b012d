"""Mutation logs and their resolution.

A log row is (seq, op, key, value): SET or REMOVE of a binary key.  An entry is
(key, tombstone, value, seq).  A tombstone is kept apart from null, and an empty
value is a value.  Ranking always comes before dropping tombstones: the other
order would bring deleted keys back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyfold.config import VALUE
from keyfold.functions import response_code, shard_of


def mutations(df: DataFrame, key: Column, order: Column, value: Column, remove_when: Column | None = None) -> DataFrame:
    """A log from any table; remove_when marks the rows that remove their key."""
    gone = F.coalesce(remove_when, F.lit(False)) if remove_when is not None else F.lit(False)
    return df.select(
        order.cast("bigint").alias("seq"), F.when(gone, "REMOVE").otherwise("SET").alias("op"),
        key.cast("binary").alias("key"), F.when(~gone, F.coalesce(value.cast("binary"), F.lit(b""))).alias("value"),
    )


def entries(log: DataFrame) -> DataFrame:
    return log.select("key", (F.col("op") == "REMOVE").alias("tombstone"), "value", "seq")


def newest(rows: DataFrame, *recency: Column, within: tuple = ()) -> DataFrame:
    """The first row of each key by recency: a top-1 before the shuffle and one after."""
    place = F.row_number().over(Window.partitionBy(*within, "key").orderBy(*recency))
    return rows.withColumn("place", place).where(F.col("place") == 1).drop("place")


def latest(log: DataFrame) -> DataFrame:
    """The last entry of each key, tombstones included."""
    return newest(entries(log), F.col("seq").desc())


def live(log: DataFrame) -> DataFrame:
    """The keys with a value now."""
    return latest(log).where(~F.col("tombstone")).drop("tombstone")


def as_of(log: DataFrame, seq: int) -> DataFrame:
    """The state after the mutations up to seq."""
    return live(log.where(F.col("seq") <= seq))


def scan(state: DataFrame, low: bytes | None = None, high: bytes | None = None) -> DataFrame:
    """Entries in key order, from low up to but without high."""
    if low is not None:
        state = state.where(F.col("key") >= F.lit(low))
    if high is not None:
        state = state.where(F.col("key") < F.lit(high))
    return state.orderBy("key")


def get(log: DataFrame, key: bytes) -> DataFrame:
    """The response to one GET, always one row; the key reaches the scan as a filter."""
    probe = log.sparkSession.range(1).select(F.lit(0).alias("req_id"), F.lit(key).alias("key"))
    return lookup(latest(log.where(F.col("key") == F.lit(key))), probe)


def lookup(state: DataFrame, probes: DataFrame) -> DataFrame:
    """One response for each probe (req_id, key): found, deleted, code, value_len, value.

    On the wire a missing key, a deleted one and an empty value look the same:
    code 1, length 0.  found and deleted tell them apart.
    """
    hits = probes.select("req_id", "key").join(state.select("key", "tombstone", "value"), "key", "left")
    found = F.col("tombstone").isNotNull() & ~F.coalesce("tombstone", F.lit(False))
    return hits.select(
        "req_id", "key", found.alias("found"), F.coalesce("tombstone", F.lit(False)).alias("deleted"), F.lit(VALUE).cast("tinyint").alias("code"),
        F.coalesce(F.octet_length("value"), F.lit(0)).cast("bigint").alias("value_len"), F.when(found, F.col("value")).alias("value"),
    )


def carried(rows: DataFrame, keys: list[str], value: Column, name: str, stretch: int = 1 << 20) -> DataFrame:
    """Adds the last value that is not null before each row, by seq within the keys.

    Rows meet in stretches of seq, and each stretch's last value is handed on to
    the next: so a key with most of the rows is many tasks.
    """
    rows = rows.withColumns({"stretch": F.floor(F.col("seq") / stretch), name: value})
    inside = Window.partitionBy(*keys, "stretch").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy(*keys, "stretch").agg(F.max_by(name, F.when(F.col(name).isNotNull(), F.col("seq"))).alias("end"))
    ends = ends.select(*keys, "stretch", F.last("end", ignorenulls=True).over(earlier).alias("handed"))
    near = rows.withColumn(name, F.last(name, ignorenulls=True).over(inside))
    return near.join(ends, [*keys, "stretch"], "left").withColumn(name, F.coalesce(name, "handed")).drop("stretch", "handed")


def execute(requests: DataFrame, shards: int = 1, here: int = 1) -> DataFrame:
    """Responses (req_id, code, value_len, value) to a sequence of requests (seq, req_id, op, key, value).

    A GET sees the last earlier SET or REMOVE of its key.  Requests of other
    shards get the mismatch code and do nothing.
    """
    routed = requests.withColumn("mismatch", shard_of(F.col("key"), shards) != here)
    is_get = F.col("op") == "GET"
    written = F.when(~is_get, F.struct((F.col("op") == "REMOVE").alias("tombstone"), "value"))
    before = carried(routed, ["mismatch", "key"], written, "before")
    seen = is_get & ~F.col("mismatch") & F.col("before").isNotNull() & ~F.col("before.tombstone")
    value = F.when(seen, F.col("before.value"))
    return before.select("seq", "req_id", response_code(is_get, F.col("mismatch")).alias("code"), F.coalesce(F.octet_length(value), F.lit(0)).cast("bigint").alias("value_len"), value.alias("value"))


def valid_requests(requests: DataFrame) -> DataFrame:
    """Marks the requests that a decoder would accept."""
    known = F.col("op").isin("SET", "GET", "REMOVE") & F.col("key").isNotNull()
    return requests.withColumn("valid", known & ((F.col("op") != "SET") | F.col("value").isNotNull()))


def route(df: DataFrame, shards: int, here: int | None = None, hashed: Column | None = None) -> DataFrame:
    """Adds shard and, given the shard asked, mismatch."""
    out = df.withColumn("shard", shard_of(F.col("key"), shards, hashed))
    return out if here is None else out.withColumn("mismatch", F.col("shard") != here)


def recover(segments: DataFrame) -> DataFrame:
    """A log from segments (segment_order, pos, op, key, value): older segments first, in order inside."""
    return segments.select(F.struct("segment_order", "pos").alias("seq"), "op", "key", "value")

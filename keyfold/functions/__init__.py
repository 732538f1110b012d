"""Column functions: sizes, routing, back-off, response codes, checksums."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from keyfold.config import ACK, SHARD_MISMATCH, VALUE


def entry_size(key: Column, value: Column, tombstone: Column) -> Column:
    """Bytes of an encoded entry: lengths and kind take 5 or 9, beside key and value."""
    body = F.when(tombstone, F.lit(0)).otherwise(F.octet_length(value) + 4)
    return (F.octet_length(key) + 5 + body).cast("bigint")


def shard_of(key: Column, shards: int, hashed: Column | None = None) -> Column:
    """1 to shards, by a 64-bit hash of the key (Spark's own, unless another is given)."""
    return (F.pmod(F.xxhash64(key) if hashed is None else hashed, F.lit(shards)) + 1).cast("int")


def md5_hash(key: Column) -> Column:
    """A hash of 60 bits that other engines have too."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("bigint")


def backoff_cap(attempt: Column, base_ms: int = 100, most_ms: int = 5_000) -> Column:
    """The longest delay of a retry, doubling up to a limit."""
    return F.least(F.lit(base_ms) * F.pow(F.lit(2.0), F.least(attempt, F.lit(32))), F.lit(float(most_ms))).cast("bigint")


def backoff_delay(attempt: Column, base_ms: int = 100, most_ms: int = 5_000, seed: int | None = None) -> Column:
    """A delay between 0 and the cap, drawn evenly."""
    return F.floor(F.rand(seed) * (backoff_cap(attempt, base_ms, most_ms) + 1))


def response_code(is_get: Column, mismatch: Column) -> Column:
    return F.when(mismatch, SHARD_MISMATCH).when(is_get, VALUE).otherwise(ACK).cast("tinyint")


def xxh3_shard(shards: int):
    """Exact routing by XXH3-64: a pandas UDF from keys to 1 to shards."""
    @F.pandas_udf("int")
    def route(keys: pd.Series) -> pd.Series:
        from xxhash import xxh3_64_intdigest

        return pd.Series([xxh3_64_intdigest(bytes(k)) % shards + 1 for k in keys], dtype="int32")

    return route


def crc32c():
    """CRC-32C, which Spark's crc32 is not: a pandas UDF from bytes to a number."""
    @F.pandas_udf("bigint")
    def check(data: pd.Series) -> pd.Series:
        from keyfold.sources import codecs

        return pd.Series([None if x is None else codecs.crc32c(bytes(x)) for x in data], dtype="Int64")

    return check

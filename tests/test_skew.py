"""Keys cut into stretches give the same answers."""

from pyspark.sql import functions as F

from keyfold.operators import log


def test_carried_over_stretches(spark):
    rows = [(i, b"hot" if i % 3 else b"k%d" % (i % 7), i if i % 5 == 0 else None) for i in range(200)]
    frame = spark.createDataFrame(rows, "seq bigint, key binary, v bigint")
    want, last = {}, {}
    for seq, key, v in rows:
        want[seq] = last.get(key)
        last[key] = v if v is not None else last.get(key)
    for stretch in (1, 7, 1000):
        got = {r["seq"]: r["before"] for r in log.carried(frame, ["key"], F.col("v"), "before", stretch).collect()}
        assert got == want

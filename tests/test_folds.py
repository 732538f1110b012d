"""Sequential folds against plain loops."""

import pytest

from keyfold import catalogue, errors
from keyfold.operators import log, runs


def test_rotation(spark, sf):
    rows = log.entries(catalogue.events_log(spark, sf)).orderBy("seq").collect()
    got = {r["seq"]: (r["run_id"], r["used"]) for r in runs.rotate(catalogue.events_log(spark, sf), 300).collect()}
    table, used, run = {}, 0, 0
    for r in rows:
        size = len(r["key"]) + 5 + (0 if r["tombstone"] else 4 + len(r["value"]))
        delta = size - table.get(bytes(r["key"]), 0)
        if delta > 0 and used + delta > 300:
            table, used, run, delta = {}, 0, run + 1, size
        table[bytes(r["key"])] = size
        used += delta
        assert got[r["seq"]] == (run, used)
    assert run > 0


def test_rotation_refuses_what_no_table_holds(spark, sf):
    with pytest.raises(Exception, match="OversizedEntry"):
        runs.rotate(catalogue.events_log(spark, sf), 10).collect()


def test_group_commits(spark):
    times = [0, 1, 2, 3, 50, 120, 121, 400, 401]
    frame = spark.createDataFrame(list(enumerate(times)), "seq bigint, at_ms bigint")
    got = [r["batch"] for r in runs.group_commits(frame, 3, 100).orderBy("seq").collect()]
    # 0-2 fill a batch at 2; the window then ends at 102, 202, 302, 402.
    assert got == [0, 0, 0, 1, 1, 2, 2, 3, 3]


def test_overlap_needs_a_deeper_level(spark):
    from pyspark.sql import functions as F

    meta = spark.createDataFrame([(1, 1, b"a", b"c"), (2, 1, b"d", b"e"), (3, 1, b"g", b"h")], "run_id bigint, level int, min_key binary, max_key binary")
    assert sorted(r["run_id"] for r in runs.overlapping(meta, 1, F.lit(b"c"), F.lit(b"f")).collect()) == [1, 2]
    with pytest.raises(ValueError):
        runs.overlapping(meta, 0, F.lit(b"c"), F.lit(b"f"))


def test_jvm_errors_have_kinds(spark):
    from py4j.protocol import Py4JJavaError

    io = spark._jvm.java.io
    for made, kind in ((spark._jvm.java.net.SocketTimeoutException("x"), "timed out"), (io.IOException("x"), "io"), (spark._jvm.java.lang.RuntimeException("x", io.InterruptedIOException("y")), "interrupted"), (spark._jvm.java.lang.RuntimeException("x"), "other")):
        error = Py4JJavaError("failed", made)
        assert errors.kind_of(error) == kind and errors.is_transient(error) == (kind in ("timed out", "interrupted"))


def test_split_outputs_in_blocks(spark):
    rows = [(b"%06d" % i, False, b"v" * (i * 7 % 40), 0) for i in range(3000)]
    frame = spark.createDataFrame(rows, "key binary, tombstone boolean, value binary, seq bigint")
    got = {bytes(r["key"]): (r["output"], r["bytes"]) for r in runs.split_outputs(frame, 500).collect()}
    output, held = 0, 2
    for key, _, value, _ in rows:
        held += len(key) + 9 + len(value)
        assert got[key] == (output, held)
        if held >= 500:
            output, held = output + 1, 2


def test_retry():
    policy, calls = errors.RetryPolicy(3, 1, 4), []

    def act():
        calls.append(1)
        raise TimeoutError

    with pytest.raises(TimeoutError):
        errors.retry_if(policy, act, sleep=lambda s: None)
    assert len(calls) == 3
    assert [errors.RetryPolicy().cap_ms(a) for a in range(7)] == [100, 200, 400, 800, 1600, 3200, 5000]
    with pytest.raises(KeyError):
        errors.retry_if(policy, lambda: {}[1], sleep=lambda s: None)

"""Random sequences of commands against a dict."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from keyfold.config import StorageConfig
from keyfold.operators import compaction, log, runs
from keyfold.plans.store import Store

LOG = "seq bigint, op string, key binary, value binary"
COMMANDS = st.lists(st.tuples(st.sampled_from(["SET", "REMOVE"]), st.sampled_from([b"", b"a", b"b", b"\x7f", b"\x7f\x00", b"\x80"]), st.binary(max_size=3)), max_size=30)


def rows_of(commands):
    return [(i, op, k, v if op == "SET" else None) for i, (op, k, v) in enumerate(commands)]


def state_of(commands):
    state = {}
    for op, k, v in commands:
        state.pop(k, None)
        if op == "SET":
            state[k] = v
    return state


def found(df):
    return {bytes(r["key"]): bytes(r["value"]) for r in df.collect()}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(COMMANDS, st.integers(1, 7))
def test_live_tiers_and_merges_agree(spark, commands, every):
    frame = spark.createDataFrame(rows_of(commands), LOG)
    want = state_of(commands)
    assert found(log.live(frame)) == want
    r = runs.runs_by_count(frame, every).withColumn("level", __import__("pyspark").sql.functions.lit(0))
    assert found(runs.tiered_latest(r).where("not tombstone")) == want
    once = compaction.merge(r)
    assert found(once.where("not tombstone")) == want
    assert sorted(map(tuple, compaction.merge(once).select("key", "tombstone").collect())) == sorted(map(tuple, once.select("key", "tombstone").collect()))
    cut = len(commands) // 2
    assert found(log.as_of(frame, cut - 1)) == state_of(commands[:cut])


def test_key_order_is_unsigned(spark):
    keys = [b"\x80", b"", b"\x7f\x00", b"\x7f"]
    frame = spark.createDataFrame([(i, "SET", k, b"v") for i, k in enumerate(keys)], LOG)
    assert [bytes(r["key"]) for r in log.scan(log.live(frame)).collect()] == sorted(keys)


def test_missing_deleted_and_empty_differ_inside_only(spark):
    frame = spark.createDataFrame([(0, "SET", b"e", b""), (1, "SET", b"d", b"x"), (2, "REMOVE", b"d", None)], LOG)
    got = {k: log.get(frame, k).first() for k in (b"e", b"d", b"m")}
    assert all((r["code"], r["value_len"]) == (1, 0) for r in got.values())
    assert [(got[k]["found"], got[k]["deleted"]) for k in (b"e", b"d", b"m")] == [(True, False), (False, True), (False, False)]


@pytest.mark.parametrize("seed", range(3))
def test_store_reads_what_was_written(spark, tmp_path, seed):
    rng = random.Random(seed)
    store = Store(spark, str(tmp_path / "s"), StorageConfig(memtable_bytes=120, run_bytes=100, level_0_runs=2, level_1_bytes=200, level_growth=2))
    commands = []
    for _ in range(3):
        batch = [(rng.choice(["SET", "SET", "REMOVE"]), b"k%d" % rng.randrange(12), b"v" * rng.randrange(9)) for _ in range(15)]
        start = len(commands)
        commands += batch
        store.apply(spark.createDataFrame([(start + i, op, k, v if op == "SET" else None) for i, (op, k, v) in enumerate(batch)], LOG))
        before = store.version()
        store.compact()
        assert found(store.scan()) == found(store.scan(version=before)) == state_of(commands)
    listed = store.live_runs()
    for level in {r["level"] for r in listed} - {0}:
        spans = sorted((r["min_key"], r["max_key"]) for r in listed if r["level"] == level)
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    assert not store.broken_levels
    row = store.get(commands[-1][1]).first()
    assert (row["found"], row["value"] and bytes(row["value"])) == ((commands[-1][1] in state_of(commands)), state_of(commands).get(commands[-1][1]) or (row["value"] and b""))
    store.vacuum()
    assert found(store.scan()) == state_of(commands)

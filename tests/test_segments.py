import pytest

from keyfold.config import StorageConfig
from keyfold.errors import CommitConflict, ExhaustedSegments, RetryPolicy
from keyfold.operators import log
from keyfold.plans.node import Node
from keyfold.plans.segments import SegmentLog, SegmentPool
from keyfold.plans.store import Files, Store


def test_pool_reuses_the_lowest_id_and_orders_rise():
    pool = SegmentPool(2)
    assert [pool.take(), pool.take()] == [(0, 0), (1, 1)]
    with pytest.raises(ExhaustedSegments):
        pool.take()
    pool.give_back(1)
    pool.give_back(0)
    assert pool.take() == (0, 2)


def test_log_rotates_frees_and_recovers(spark, tmp_path):
    wal = SegmentLog(spark, str(tmp_path / "wal"), segments=3)
    wal.append([("SET", b"a", b"1"), ("SET", b"b", b"1")])
    full = wal.rotate()
    wal.append([("REMOVE", b"a", None)])
    wal.append([("SET", b"c", b"2")])
    state = lambda w: {bytes(r["key"]): bytes(r["value"]) for r in log.live(log.recover(w.recover())).collect()}
    assert state(wal) == {b"b": b"1", b"c": b"2"}
    again = SegmentLog(spark, str(tmp_path / "wal"), segments=3)
    assert again.active == (2, 2) and state(again) == {b"b": b"1", b"c": b"2"}
    wal.free_up(full)
    assert state(wal) == {b"c": b"2"}


def test_a_version_is_taken_once(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store._commit(set(), [], 0)
    with pytest.raises(CommitConflict):
        store._commit(set(), [], 0)
    assert store.version() == 1 and Files(spark).names(str(tmp_path / "none")) == []


def test_a_numbered_batch_is_applied_once(spark, tmp_path):
    store = Store(spark, str(tmp_path / "b"))
    frame = spark.createDataFrame([(0, "SET", b"a", b"1")], "seq bigint, op string, key binary, value binary")
    store.apply(frame, 4)
    store.apply(frame, 4)
    store.apply(frame, 3)
    assert store.version() == 1 and store.last_batch() == 4 and len(store.live_runs()) == 1
    store.compact()
    assert store.last_batch() == 4


LOG = "seq bigint, op string, key binary, value binary"


def test_two_writers_and_the_loser_leaves_no_rows(spark, tmp_path):
    """The second writer commits between the first one's read of the version and its commit."""
    path = str(tmp_path / "two")
    one, other = Store(spark, path), Store(spark, path)
    commit, tries = one._commit, []

    def late(*args, **kwargs):
        tries.append(1)
        if len(tries) == 1:
            other.apply(spark.createDataFrame([(0, "SET", b"a", b"other")], LOG))
        return commit(*args, **kwargs)

    one._commit = late
    one.apply(spark.createDataFrame([(1, "SET", b"b", b"one")], LOG), policy=RetryPolicy(base_ms=1))
    assert len(tries) == 2 and one.version() == 2
    assert {bytes(r["key"]): bytes(r["value"]) for r in one.scan().collect()} == {b"a": b"other", b"b": b"one"}
    assert len({r["run_id"] for r in one.live_runs()}) == 2
    assert len(one.files.names(f"{path}/runs")) == 2


def test_a_failed_attempt_leaves_no_folder(spark, tmp_path):
    store = Store(spark, str(tmp_path / "f"))
    store.files.create(f"{store.path}/catalogue/{1:012d}.edits", '{"removed": [], "added": [], "batch": null}')
    store.version = lambda: 0
    with pytest.raises(CommitConflict):
        store.apply(spark.createDataFrame([(0, "SET", b"a", b"1")], LOG), policy=RetryPolicy(attempts=1))
    assert store.files.names(f"{store.path}/runs") == []


def test_checkpoints_and_edits_give_every_version(spark, tmp_path):
    store = Store(spark, str(tmp_path / "c"))
    meta = lambda k: {"run_id": k, "level": 0, "attempt": "attempt=x", "entry_count": 1, "size_bytes": 1, "min_key": "", "max_key": ""}
    for k in range(1, 41):
        store._commit({k - 3} if k > 3 else set(), [meta(k)], k - 1, k if k % 2 else None)
    assert sorted(n for n in store.files.names(f"{store.path}/catalogue") if n.endswith("checkpoint")) == [f"{k:012d}.checkpoint" for k in (16, 32)]
    for k in (1, 2, 15, 16, 17, 33, 40):
        assert sorted(r["run_id"] for r in store.live_runs(k)) == list(range(max(1, k - 2), k + 1))
    assert store.last_batch() == 39
    assert len(store.files.read(f"{store.path}/catalogue/{40:012d}.edits")) < 300


def test_vacuum_keeps_what_is_listed(spark, tmp_path):
    store = Store(spark, str(tmp_path / "v"), StorageConfig(level_0_runs=2))
    for k in range(3):
        store.apply(spark.createDataFrame([(k, "SET", b"k%d" % k, b"v")], LOG))
    assert store.compact() == 1 and store.vacuum() == 3
    assert store.scan().count() == 3 and store.next_run_id() > max(r["run_id"] for r in store.live_runs())


def test_thousands_of_runs_share_files(spark, tmp_path):
    """A part for each run overflowed a 32-bit number from the 2,048th on, and was a folder, a file and a task."""
    store = Store(spark, str(tmp_path / "p"), StorageConfig(memtable_bytes=60))
    store.apply(spark.range(5000).selectExpr("id AS seq", "'SET' AS op", "CAST(lpad(CAST(id % 4000 AS STRING), 8, '0') AS BINARY) AS key", "CAST(lpad(CAST(id AS STRING), 20, '0') AS BINARY) AS value"))
    listed = store.live_runs()
    assert len(listed) > 2048 and len({r["run_id"] for r in listed}) == len(listed) and len({r["part"] for r in listed}) == 1
    assert all(r["size_bytes"] <= 2 * 60 for r in listed) and sum(r["entry_count"] for r in listed) == 5000
    assert store.scan().count() == 4000 and bytes(store.get(b"00000007").first()["value"]) == b"%020d" % 4007
    assert store.next_run_id() > max(r["run_id"] for r in listed)


def test_merges_follow_levels_not_runs(spark, tmp_path):
    store = Store(spark, str(tmp_path / "m"), StorageConfig(memtable_bytes=1000, run_bytes=40, level_0_runs=1, level_1_bytes=200, level_growth=4))
    store.apply(spark.range(300).selectExpr("id AS seq", "'SET' AS op", "CAST(lpad(CAST(id AS STRING), 8, '0') AS BINARY) AS key", "CAST('v' AS BINARY) AS value"))
    assert store.compact() <= 5 and not store.broken_levels and store._due(set()) is None
    assert len(store.live_runs()) > 60 and store.scan().count() == 300


def test_a_node_recovers_what_a_crash_left(spark, tmp_path):
    config = StorageConfig(memtable_bytes=60, wal_segments=6, level_0_runs=2)
    node = Node(spark, str(tmp_path / "n"), config)
    node.write([("SET", b"a", b"1"), ("SET", b"b", b"2"), ("REMOVE", b"a", None)])
    node.write([("SET", b"c%d" % k, b"x" * 10) for k in range(6)])
    assert len(node.waiting) == 2 and node.get(b"a") is None and node.get(b"b") == b"2" and node.get(b"c5") == b"x" * 10 and node.get(b"zz") is None
    want = {b"b": b"2", **{b"c%d" % k: b"x" * 10 for k in range(6)}}
    live = lambda n: {bytes(r["key"]): bytes(r["value"]) for r in n.latest().collect()}
    assert live(node) == want
    # The node is gone; part of its log was flushed already, and the flush is not repeated.
    first = next(iter(node.waiting))
    Store(spark, str(tmp_path / "n" / "store"), config).apply(node.wal.recover(order=first).selectExpr("segment_order * 1048576 + pos as seq", "op", "key", "value"), first)
    again = Node(spark, str(tmp_path / "n"), config)
    assert live(again) == want and not again.waiting and len(again.wal.waiting) == 0
    again.write([("REMOVE", b"b", None), ("SET", b"c0", b"")])
    again.flush()
    assert again.get(b"b") is None and again.get(b"c0") == b"" and again.compaction_due is False
    assert live(Node(spark, str(tmp_path / "n"), config)) == {**{k: v for k, v in want.items() if k != b"b"}, b"c0": b""}


def test_a_table_is_loaded_by_tasks_and_recovered(spark, tmp_path, monkeypatch):
    """Loaded rows never pass the driver, come after what was written before, and are read by this node and the next."""
    from keyfold.sources import raw

    monkeypatch.setattr(raw, "PART_BYTES", 8 << 10)
    node = Node(spark, str(tmp_path / "l"))
    node.write([("SET", b"00000001", b"old"), ("SET", b"kept", b"1")])
    log_ = spark.range(3000).selectExpr("id AS seq", "IF(id % 7 = 0, 'REMOVE', 'SET') AS op", "CAST(lpad(CAST(id % 1000 AS STRING), 8, '0') AS BINARY) AS key", "CAST(IF(id % 7 = 0, NULL, CAST(id AS STRING)) AS BINARY) AS value")
    node.load(log_.repartition(5))
    node.write([("SET", b"00000002", b"new")])
    want = {b"%08d" % (k % 1000): b"%d" % k for k in range(2000, 3000) if k % 7} | {b"kept": b"1", b"00000002": b"new"}
    live = lambda n: {bytes(r["key"]): bytes(r["value"]) for r in n.latest().collect()}
    parts = [n for n in node.wal.files.names(node.wal.path) if n.startswith("WAL_1_1.1.")]
    assert len(parts) > 3 and not [n for n in node.wal.files.names(node.wal.path) if n.startswith("load")]
    again = Node(spark, str(tmp_path / "l"))
    assert live(again) == want and len(again.wal.waiting) == 0
    again.load(spark.createDataFrame([(0, "REMOVE", b"kept", None), (1, "SET", b"x", b"")], LOG))
    assert again.get(b"kept") is None and again.get(b"x") == b"" and not again.waiting


def test_a_load_that_fails_leaves_nothing(spark, tmp_path):
    node = Node(spark, str(tmp_path / "e"))
    with pytest.raises(Exception, match="is no mutation"):
        node.load(spark.createDataFrame([(0, "SET", b"a", b"1"), (1, "GET", b"a", None)], LOG))
    assert node.wal.files.names(node.wal.path) == [] and node.get(b"a") is None


def test_relaxed_writes_are_durable_with_their_batch(spark, tmp_path):
    now = [0.0]
    node = Node(spark, str(tmp_path / "r"), StorageConfig(batch_commands=3, batch_window_ms=1000), relaxed=True, clock=lambda: now[0])
    parts = lambda: len([n for n in node.wal.files.names(node.wal.path) if n.startswith("WAL")])
    node.write([("SET", b"a", b"1")])
    assert parts() == 0 and node.get(b"a") == b"1"
    node.write([("SET", b"b", b"1"), ("SET", b"c", b"1"), ("SET", b"d", b"1")])
    assert parts() == 1
    now[0] = 2.0
    node.write([("SET", b"e", b"1")])
    assert parts() == 2 and node.pending == []


def test_flushes_are_tried_again(spark, tmp_path):
    node = Node(spark, str(tmp_path / "t"), StorageConfig(memtable_bytes=30), policy=RetryPolicy(base_ms=1))
    node.write([("SET", b"a", b"1" * 10), ("SET", b"b", b"1" * 10)])
    write, calls = node.store._write, []

    def shaky(*args):
        calls.append(1)
        if len(calls) < 3:
            raise TimeoutError
        return write(*args)

    node.store._write = shaky
    node.flush()
    assert len(calls) == 3 and not node.waiting and node.get(b"a") == b"1" * 10 and node.compaction_due
    assert node.maintain() == 0 and not node.compaction_due


def test_segments_have_bounds_and_sizes(spark, tmp_path):
    wal = SegmentLog(spark, str(tmp_path / "w"), file_bytes=4096)
    wal.append([("SET", b"a", b"1")])
    assert [f.stat().st_size for f in (tmp_path / "w").iterdir() if f.name.startswith("WAL")] == [4096] and wal.recover().count() == 1
    wal.parts = 1 << 20
    with pytest.raises(ExhaustedSegments):
        wal.append([("SET", b"a", b"1")])

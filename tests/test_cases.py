"""Small semantic cases: precedence, merges, scores, picks."""

from pyspark.sql import functions as F

from keyfold.config import StorageConfig
from keyfold.operators import compaction, log, runs

RUN = "run_id bigint, level int, key binary, tombstone boolean, value binary, seq bigint"
META = "run_id bigint, level int, entry_count bigint, size_bytes bigint, min_key binary, max_key binary"


def test_newer_runs_and_tombstones_win(spark, tmp_path):
    rows = [(5, 0, b"a", False, b"old", 1), (6, 0, b"a", False, b"new", 2), (7, 0, b"b", True, None, 3), (3, 1, b"b", False, b"1", 0), (3, 1, b"c", False, b"z", 0)]
    frame = spark.createDataFrame(rows, RUN)
    got = {bytes(r["key"]): (r["tombstone"], r["value"] and bytes(r["value"])) for r in compaction.merge(frame).collect()}
    assert got == {b"a": (False, b"new"), b"b": (True, None), b"c": (False, b"z")}
    assert sorted((r["run_id"], bytes(r["key"])) for r in compaction.stale(frame).collect()) == [(3, b"b"), (5, b"a")]
    probes = spark.createDataFrame([(1, b"a"), (2, b"b"), (3, b"c"), (4, b"d")], "req_id int, key binary")
    cost = {r["req_id"]: r["runs_visited"] for r in runs.read_cost(frame, runs.describe(frame), probes, str(tmp_path / "cost")).collect()}
    assert cost == {1: 2, 2: 1, 3: 4, 4: 3}
    assert {r["req_id"]: r["found"] for r in log.lookup(runs.tiered_latest(frame), probes).collect()} == {1: True, 2: False, 3: True, 4: False}


def test_entry_sizes(spark):
    frame = spark.createDataFrame([(1, 0, b"a", False, b"1", 0), (1, 0, b"b", True, None, 1)], RUN)
    assert sorted(r["size"] for r in runs.sized(frame).collect()) == [6, 11]
    meta = runs.describe(frame).first()
    assert (meta["entry_count"], meta["size_bytes"]) == (2, 19)


def test_the_deeper_level_wins_a_tie(spark):
    config = StorageConfig()
    meta = spark.createDataFrame([(i, 0, 1, 1, b"a", b"c") for i in range(4)] + [(9, 1, 1, 256 << 20, b"b", b"d")], META)
    assert {r["level"]: r["score"] for r in compaction.level_scores(meta, config).collect()} == {0: 1.0, 1: 1.0}
    assert compaction.due_level(meta, config).first()["level"] == 1
    assert compaction.due_level(meta, config, broken=(1,)).first()["level"] == 0
    assert sorted(r["run_id"] for r in compaction.pick_level_0(meta).collect()) == [0, 1, 2, 3, 9]


def test_requests_see_earlier_writes_and_foreign_keys_are_refused(spark):
    rows = [(0, 1, "GET", b"a", None), (1, 2, "SET", b"a", b"x"), (2, 3, "GET", b"a", None), (3, 4, "REMOVE", b"a", None), (4, 5, "GET", b"a", None), (5, 6, "REMOVE", b"zz", None)]
    frame = spark.createDataFrame(rows, "seq bigint, req_id int, op string, key binary, value binary")
    got = {r["req_id"]: (r["code"], r["value_len"]) for r in log.execute(frame).collect()}
    assert got == {1: (1, 0), 2: (0, 0), 3: (1, 1), 4: (0, 0), 5: (1, 0), 6: (0, 0)}
    assert {r["code"] for r in log.execute(frame, shards=1, here=2).collect()} == {2}


def test_streaming_aggregate_matches_batch(spark, sf, tmp_path):
    from keyfold import catalogue
    from keyfold.streaming.ingest import fold_latest

    spark.read.parquet(f"{sf}/events.parquet").repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    rows = log.mutations(stream, F.lpad(F.col("user_id").cast("string"), 10, "0"), F.col("event_id"), F.col("props"), F.col("event_type") == "error")
    query = fold_latest(rows).writeStream.outputMode("complete").format("memory").queryName("folded").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {bytes(r["key"]): r["seq"] for r in spark.table("folded").where("not tombstone").collect()}
    assert got == {bytes(r["key"]): r["seq"] for r in log.live(catalogue.events_log(spark, sf)).collect()}

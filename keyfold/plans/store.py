"""A key-value store of Parquet runs with a versioned catalogue.

A batch of mutations is de-duplicated, cut into runs of about a memtable's size
and written as level 0; the catalogue's next version lists the new runs.
Compaction merges runs level by level.  Readers see one version: all of a commit
or nothing of it.

A version is one small file of edits: what it removes, what it adds, and the
batch it comes from.  Every ``CHECKPOINT_EVERY`` versions the whole listing is
written beside it, so a commit costs what it changes and a reader replays few
edits.  A version's file is created only if absent, in one step, so two writers
can't both take a number.  Each attempt to write runs has a folder of its own,
which only the version that commits it lists; a writer that loses removes its
folder and tries again on the new version.  Files that a version no longer lists
stay until ``vacuum``.

Runs that follow each other share a file: a part of some ``PART_BYTES``, or of
one run where runs are larger, sorted by run and key.  So the files, folders and
tasks of a batch follow its bytes and not the number of its runs.

Run metadata (one row a run, some 100 bytes) is the only data on the driver.
"""

from __future__ import annotations

import atexit
import json
import os
import tempfile
import uuid

import numpy as np
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyfold.config import StorageConfig
from keyfold.errors import CommitConflict, RetryPolicy, is_transient, retry_if
from keyfold.operators import compaction, runs
from keyfold.operators.log import entries, lookup, newest, scan

ENTRY = "key binary, tombstone boolean, value binary, seq bigint"
CHECKPOINT_EVERY = 16
PART_BYTES = 16 << 20
#: Run ids of one part: its own number, which is that of its first run, and those up to the next.
PART_IDS = 1 << 20


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in the store all executors share; removed when Python ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="keyfold-")
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove_quietly, spark, path)
    return path


def _remove_quietly(spark: SparkSession, path: str) -> None:
    try:
        Files(spark).remove(path)
    except Exception:  # noqa: BLE001  the JVM may have ended already
        pass


class Files:
    """Small files through Hadoop's file system, wherever the store is."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.jvm, self.conf = spark, spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.conf)

    def create(self, path: str, text: str) -> None:
        self.create_bytes(path, text.encode())

    def create_bytes(self, path: str, data: bytes) -> None:
        """Writes a file aside and gives it its name in one step; a file of that name is a conflict.

        Local files: a hard link, which fails if the name is taken.  Others: a rename that doesn't
        overwrite, which is one step where the file system has it so (HDFS); a store without it
        allows one writer at a time.
        """
        p, fs = self._at(path)
        aside = self.jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
        out = fs.create(aside, True)
        out.write(bytearray(data))
        out.close()
        try:
            if fs.getUri().getScheme() == "file":
                os.link(aside.toUri().getPath(), p.toUri().getPath())
            else:
                hadoop = self.jvm.org.apache.hadoop.fs
                none = self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)
                hadoop.FileContext.getFileContext(fs.getUri(), self.conf).rename(aside, p, none)
        except FileExistsError:
            raise CommitConflict(path) from None
        except Py4JJavaError as error:
            if "FileAlreadyExists" in error.java_exception.getClass().getName():
                raise CommitConflict(path) from None
            raise
        finally:
            fs.delete(aside, False)

    def read(self, path: str) -> str:
        p, fs = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def names(self, path: str) -> list[str]:
        p, fs = self._at(path)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def matching(self, pattern: str) -> list[str]:
        """Paths below the pattern's plain beginning, from its first wildcard's folder on."""
        p, fs = self._at(pattern)
        depth = pattern.count("/", pattern.index("*"))
        return ["/".join(s.getPath().toString().rsplit("/", depth + 1)[1:]) for s in fs.globStatus(p) or []]

    def remove(self, path: str) -> None:
        p, fs = self._at(path)
        fs.delete(p, True)

    def move(self, path: str, to: str) -> None:
        p, fs = self._at(path)
        if not fs.rename(p, self._at(to)[0]):
            raise CommitConflict(to)

    def local_folder(self, path: str) -> str | None:
        """A folder's path for tasks that write into it, made if absent; None if the store isn't of local (or mounted) files."""
        p, fs = self._at(path)
        if fs.getUri().getScheme() != "file":
            return None
        fs.mkdirs(p)
        return p.toUri().getPath()


class Store:
    def __init__(self, spark: SparkSession, path: str, config: StorageConfig = StorageConfig()) -> None:
        self.spark, self.path, self.config, self.files = spark, path.rstrip("/"), config, Files(spark)

    # The catalogue.

    def version(self) -> int:
        return self._versions()[0]

    def _versions(self) -> tuple[int, list[int]]:
        """The last version, and the versions that have a checkpoint."""
        names = self.files.names(f"{self.path}/catalogue")
        return max([int(n[:-6]) for n in names if n.endswith(".edits")], default=0), sorted(int(n[:-11]) for n in names if n.endswith(".checkpoint"))

    def _listing(self, version: int | None = None) -> dict:
        """The live runs and the last numbered batch: a checkpoint and the edits after it."""
        last, checkpoints = self._versions()
        version = last if version is None else version
        start = max([c for c in checkpoints if c <= version], default=0)
        listing = json.loads(self.files.read(f"{self.path}/catalogue/{start:012d}.checkpoint")) if start else {"runs": [], "batch": None}
        live = {r["run_id"]: r for r in listing["runs"]}
        for k in range(start + 1, version + 1):
            edits = json.loads(self.files.read(f"{self.path}/catalogue/{k:012d}.edits"))
            for run_id in edits["removed"]:
                live.pop(run_id, None)
            live |= {r["run_id"]: r for r in edits["added"]}
            listing["batch"] = listing["batch"] if edits["batch"] is None else edits["batch"]
        return {"runs": list(live.values()), "batch": listing["batch"]}

    def live_runs(self, version: int | None = None) -> list[dict]:
        return self._listing(version)["runs"]

    def last_batch(self) -> int | None:
        """The number of the last batch applied with one."""
        return self._listing()["batch"]

    def _commit(self, removed: set[int], added: list[dict], base: int, batch: int | None = None) -> None:
        """One version: removals and additions together, and the batch they come from."""
        version = base + 1
        self.files.create(f"{self.path}/catalogue/{version:012d}.edits", json.dumps({"removed": sorted(removed), "added": added, "batch": batch}))
        if version % CHECKPOINT_EVERY == 0:
            try:
                self.files.create(f"{self.path}/catalogue/{version:012d}.checkpoint", json.dumps(self._listing(version)))
            except CommitConflict:
                pass  # another process wrote the same listing

    def _attempt(self, act) -> None:
        """act(folder) writes runs into a folder of its own and commits them; without a commit, nothing stays."""
        folder = f"attempt={uuid.uuid4().hex}"
        try:
            act(folder)
        except BaseException:
            self.files.remove(f"{self.path}/runs/{folder}")
            raise

    def next_run_id(self) -> int:
        """Above all runs ever written, listed or not."""
        on_disk = [int(n.split("part=")[1]) + PART_IDS - 1 for n in self.files.matching(f"{self.path}/runs/attempt=*/part=*")]
        return max([r["run_id"] for r in self.live_runs()] + on_disk, default=0) + 1

    # Runs.

    def _read(self, listed: list[dict], schema: str = ENTRY) -> DataFrame:
        """The entries of runs, each with run_id and level."""
        if not listed:
            return self.spark.createDataFrame([], f"{schema}, run_id bigint, level int")
        frame = self.spark.read.schema(f"{schema}, run_id bigint").parquet(*sorted({self._part(r) for r in listed}))
        levels = self.spark.createDataFrame([(r["run_id"], r["level"]) for r in listed], "run_id bigint, level int")
        # A part may hold other runs too.  One short row a run: far below any broadcast limit for the runs that one plan can list.
        return frame.join(F.broadcast(levels), "run_id")

    def _part(self, run: dict) -> str:
        return f"{self.path}/runs/{run['attempt']}/part={run['part']}"

    def _write(self, frame: DataFrame, level: int, folder: str) -> list[dict]:
        """Writes cut entries (with a part and a run_id) into a new folder, sorted by key inside each run, and describes the runs."""
        # Dealt by part already, for the cut: no shuffle comes here.
        frame.select("key", "tombstone", "value", "seq", "run_id", "part").sortWithinPartitions("part", "run_id", "key").write.partitionBy("part").parquet(f"{self.path}/runs/{folder}")
        parts = [n for n in self.files.names(f"{self.path}/runs/{folder}") if n.startswith("part=")]
        if not parts:
            return []
        written = self.spark.read.schema(f"{ENTRY}, run_id bigint").parquet(*[f"{self.path}/runs/{folder}/{n}" for n in parts])
        meta = runs.describe(written.withColumn("level", F.lit(level))).collect()
        firsts = np.sort([int(n.split("=")[1]) for n in parts])
        part = lambda run_id: int(firsts[np.searchsorted(firsts, run_id, "right") - 1])
        return [{"run_id": r["run_id"], "level": level, "attempt": folder, "part": part(r["run_id"]), "entry_count": r["entry_count"], "size_bytes": r["size_bytes"], "min_key": bytes(r["min_key"]).hex(), "max_key": bytes(r["max_key"]).hex()} for r in meta]

    def _cut(self, rows: DataFrame, first_id: int, target: int, order: str) -> DataFrame:
        """Numbers runs of about ``target`` bytes along an order, in parallel: by range partitions (parts) and running sums inside them.

        Numbers rise along the order but have gaps.
        """
        sized = runs.sized(rows)
        total = sized.agg(F.sum("size").alias("b")).first()["b"] or 0
        # Far fewer runs a part than it has ids, however small they are.
        bytes_ = max(target, min(PART_BYTES, target * (PART_IDS >> 4)))
        ranged = sized.repartitionByRange(max(1, -(-total // bytes_)), order).withColumn("part", F.lit(first_id) + F.spark_partition_id().cast("bigint") * F.lit(PART_IDS))
        inside = Window.partitionBy("part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        file = F.floor(F.coalesce(F.sum("size").over(inside), F.lit(0)) / target)
        return ranged.withColumn("run_id", (F.col("part") + file).cast("bigint"))

    def apply(self, log: DataFrame, batch: int | None = None, policy: RetryPolicy = RetryPolicy()) -> None:
        """Writes a batch of mutations as runs of level 0.  Its seq must be above all earlier ones.

        A numbered batch is applied once: its number is part of the version, and numbers only rise.
        Transient errors, and conflicts with another writer, are tried again from the new version.
        """

        def flush(folder: str) -> None:
            if batch is not None and (last := self.last_batch()) is not None and batch <= last:
                return
            base, first_id = self.version(), self.next_run_id()
            cut = self._cut(entries(log), first_id, self.config.memtable_bytes, "seq")
            added = self._write(newest(cut, F.col("seq").desc(), within=("part", "run_id")), 0, folder)
            self._commit(set(), added, base, batch)

        retry_if(policy, lambda: self._attempt(flush), lambda e: is_transient(e) or isinstance(e, CommitConflict))

    def compact(self, policy: RetryPolicy = RetryPolicy()) -> int:
        """Compacts until no level is due; levels that fail for good are left out.  Returns the merges made."""
        merges, broken = 0, set()
        while (level := self._due(broken)) is not None:
            try:
                retry_if(policy, lambda: self._attempt(lambda folder: self._merge(level, folder)), lambda e: is_transient(e) or isinstance(e, CommitConflict))
                merges += 1
            except Exception:  # noqa: BLE001  this level waits for the next call
                broken.add(level)
                if len(broken) > 20:
                    raise
        self.broken_levels = broken
        return merges

    def _due(self, broken: set[int]) -> int | None:
        """The level with the highest score of at least 1, in 32-bit floats; the deepest of equals."""
        levels: dict[int, list[dict]] = {}
        for r in self.live_runs():
            levels.setdefault(r["level"], []).append(r)
        scored = []
        for level, listed in levels.items():
            amount = len(listed) if level == 0 else sum(r["size_bytes"] for r in listed)
            if (score := self._score(level, amount)) >= 1 and level not in broken:
                scored.append((score, level))
        return max(scored)[1] if scored else None

    def _score(self, level: int, amount: int) -> np.float32:
        """Runs of level 0, bytes of others, over their target."""
        return np.float32(amount) / np.float32(self.config.level_0_runs if level == 0 else self.config.level_target(level))

    def pick(self, level: int) -> list[dict]:
        """What a merge from this level into the next takes: of a level of 1 or more, the first runs by keys.

        As many as bring the level below its target, one at least, so the merges of
        a compaction follow the number of levels and not that of runs.
        """
        listed = self.live_runs()
        chosen = [r for r in listed if r["level"] == level]
        if level > 0:
            chosen.sort(key=lambda r: (r["min_key"], r["max_key"], r["run_id"]))
            left, n = sum(r["size_bytes"] for r in chosen), 0
            while n == 0 or (n < len(chosen) and self._score(level, left) >= 1):
                left, n = left - chosen[n]["size_bytes"], n + 1
            chosen = chosen[:n]
        low, high = min(r["min_key"] for r in chosen), max(r["max_key"] for r in chosen)
        return chosen + [r for r in listed if r["level"] == level + 1 and r["min_key"] <= high and r["max_key"] >= low]

    def _merge(self, level: int, folder: str) -> None:
        base, chosen, first_id = self.version(), self.pick(level), self.next_run_id()
        merged = compaction.merge(self._read(chosen))
        added = self._write(self._cut(merged, first_id, self.config.run_bytes, "key"), level + 1, folder)
        self._commit({r["run_id"] for r in chosen}, added, base)

    # Reads.

    def latest(self, version: int | None = None) -> DataFrame:
        return runs.tiered_latest(self._read(self.live_runs(version)))

    def scan(self, low: bytes | None = None, high: bytes | None = None, version: int | None = None) -> DataFrame:
        """key, value, seq in key order."""
        return scan(self.latest(version).where(~F.col("tombstone")), low, high).select("key", "value", "seq")

    def get(self, key: bytes) -> DataFrame:
        """The response for one key; only runs whose range holds it are read."""
        listed = [r for r in self.live_runs() if r["min_key"] <= key.hex() <= r["max_key"]]
        state = runs.tiered_latest(self._read(listed).where(F.col("key") == F.lit(key)))
        return lookup(state, self.spark.range(1).select(F.lit(0).alias("req_id"), F.lit(key).alias("key")))

    def multi_get(self, probes: DataFrame) -> DataFrame:
        return lookup(self.latest(), probes)

    def vacuum(self) -> int:
        """Removes the parts of which the present version lists no run, and returns their number.  No other writer may be at work."""
        keep = {f"{r['attempt']}/part={r['part']}" for r in self.live_runs()}
        gone = [n for n in self.files.matching(f"{self.path}/runs/attempt=*/part=*") if n not in keep]
        for name in gone:
            self.files.remove(f"{self.path}/runs/{name}")
        for folder in {n.split("/")[0] for n in gone} - {n.split("/")[0] for n in keep}:
            self.files.remove(f"{self.path}/runs/{folder}")
        return len(gone)

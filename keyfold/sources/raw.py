"""Raw files as DataFrames, through Spark's binary file source: any store that Spark reads.

A file is decoded by one task; files are the unit of parallelism, as segments
and runs are of bounded size.  Its rows leave the task in blocks.  Each reader
has a form that decodes a column of contents, and runs, segments and catalogues
are encoded into such a column; ``write_files`` puts contents into files.

Tasks write files themselves where the store is of local files, on one machine or
mounted on all; to other stores, the driver writes them one by one.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from itertools import groupby, islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfold.errors import CommitConflict, ExhaustedSegments
from keyfold.sources import codecs

#: A part of a log that tasks write ends after so many bytes.
PART_BYTES = 16 << 20


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).where(F.col("length") > 0).select("path", "content")


def _blocks(rows, columns: list[str], size: int = 8192) -> Iterator[pd.DataFrame]:
    while block := list(islice(rows, size)):
        yield pd.DataFrame(block, columns=columns)


def decode_segments(files: DataFrame, tolerant: bool = False) -> DataFrame:
    """segment_order, pos, op, key, value of segments' contents; empty ones are skipped."""

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                yield from _blocks(codecs.segment_rows(bytes(content), tolerant), ["segment_order", "pos", "op", "key", "value"])

    return files.where(F.octet_length("content") > 0).select("content").mapInPandas(decode, "segment_order bigint, pos bigint, op string, key binary, value binary")


def read_segments(spark: SparkSession, path: str, tolerant: bool = False) -> DataFrame:
    """segment_order, pos, op, key, value of all log segments under a path; empty files are skipped."""
    return decode_segments(_files(spark, path), tolerant)


def decode_runs(files: DataFrame) -> DataFrame:
    """run_id, level, key, tombstone, value of runs' contents (run_id, content)."""

    # Blocks go across runs, which may be small.
    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for frame in frames:
            for run_id, content in zip(frame["run_id"], frame["content"]):
                level, entries = codecs.decode_run(bytes(content))
                yield from ((run_id, level, k, v is None, v) for k, v in entries)

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _blocks(rows(frames), ["run_id", "level", "key", "tombstone", "value"])

    return files.select("run_id", "content").mapInPandas(decode, "run_id bigint, level int, key binary, tombstone boolean, value binary")


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """run_id (the last number of the file's name), level, key, tombstone, value of all runs under a path."""
    name = F.element_at(F.regexp_extract_all("path", F.lit(r"\d+"), F.lit(0)), -1).cast("bigint")
    return decode_runs(_files(spark, path).select(name.alias("run_id"), "content"))


def decode_catalogue(files: DataFrame) -> DataFrame:
    """edit_seq (the frame's number), action, run_id and metadata of a catalogue's content, up to a torn tail."""
    columns = ["edit_seq", "action", "run_id", "entry_count", "size_bytes", "level", "min_key", "max_key"]

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                rows = []
                for seq, edits in enumerate(codecs.decode_edits(bytes(content))):
                    rows += [(seq, "REMOVE", e, None, None, None, None, None) if isinstance(e, int) else (seq, "ADD", e.run_id, e.entry_count, e.size_bytes, e.level, e.min_key, e.max_key) for e in edits]
                yield pd.DataFrame(rows, columns=columns).astype({"entry_count": "Int64", "size_bytes": "Int64", "level": "Int64"})

    return files.select("content").mapInPandas(decode, "edit_seq bigint, action string, run_id bigint, entry_count bigint, size_bytes bigint, level int, min_key binary, max_key binary")


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """edit_seq (the frame's number), action, run_id and metadata of a catalogue's edits."""
    return decode_catalogue(_files(spark, path))


def encode_run(run: DataFrame, level: int = 0) -> DataFrame:
    """run_id, content: the raw bytes of each run's entries (of their level, if they have one).  A run must fit in a task, as a memtable does."""

    return _sorted_runs(run, level).mapInPandas(_encode_runs, "run_id bigint, content binary")


def _sorted_runs(run: DataFrame, level: int) -> DataFrame:
    held = F.col("level") if "level" in run.columns else F.lit(level)
    rows = run.select("run_id", held.alias("level"), "key", "tombstone", "value")
    return rows.repartition("run_id", "level").sortWithinPartitions("run_id", "level", "key")


def _each_run(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[int, bytes]]:
    """run_id, content of each run of sorted rows; runs are many and small, or few and large."""
    rows = (row for frame in frames for row in zip(*(frame[c].tolist() for c in ("run_id", "level", "key", "tombstone", "value"))))
    for (run_id, level), own in groupby(rows, key=lambda r: r[:2]):
        yield run_id, codecs.encode_run(level, [(bytes(k), None if t else bytes(v)) for _, _, k, t, v in own])


def _encode_runs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    block, size = [], 0
    for row in _each_run(frames):
        block.append(row)
        size += len(row[1])
        if size >= 1 << 20 or len(block) >= 1024:
            yield pd.DataFrame(block, columns=["run_id", "content"])
            block, size = [], 0
    if block:
        yield pd.DataFrame(block, columns=["run_id", "content"])


def write_runs(run: DataFrame, files, path: str, prefix: str, level: int = 0) -> int:
    """Writes each run, as ``encode_run`` has it, as path/prefix_run_id, by the task that encodes it; returns their number."""
    if (folder := files.local_folder(path)) is None:
        return write_files(encode_run(run, level), files, path, prefix)

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = 0
        for run_id, content in _each_run(frames):
            with _Whole(f"{folder}/{prefix}_{run_id}") as out:
                out.write(content)
            n += 1
        yield pd.DataFrame({"n": [n]})

    return _sorted_runs(run, level).mapInPandas(write, "n bigint").agg(F.sum("n")).first()[0] or 0


def write_segments(log: DataFrame, files, path: str, prefix: str) -> int:
    """Writes each segment of a log (segment_order, pos, op, key, value) as path/prefix_segment_order; returns their number.

    A segment streams through one task, in order of pos, and is never whole in memory.
    """
    if (folder := files.local_folder(path)) is None:
        return write_files(encode_segments(log), files, path, prefix)

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, blocks = 0, ((int(own), block) for frame in frames for own, block in frame.groupby("segment_order", sort=False))
        for order, own in groupby(blocks, key=lambda b: b[0]):
            with _Whole(f"{folder}/{prefix}_{order}") as out:
                out.write(codecs.encode_order(order))
                for _, block in own:
                    out.write(codecs.encode_mutations(_commands(block)))
            n += 1
        yield pd.DataFrame({"n": [n]})

    rows = log.select("segment_order", "pos", "op", "key", "value").repartition("segment_order").sortWithinPartitions("segment_order", "pos")
    return rows.mapInPandas(write, "n bigint").agg(F.sum("n")).first()[0] or 0


def encode_segments(log: DataFrame) -> DataFrame:
    """segment_order, content of each segment of a log (segment_order, pos, op, key, value).  A segment must fit in a task."""

    def encode(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        commands = [(op, bytes(k), None if v is None else bytes(v)) for op, k, v in zip(rows["op"], rows["key"], rows["value"])]
        return pd.DataFrame({"segment_order": [key[0]], "content": [codecs.encode_segment(int(key[0]), commands)]})

    return log.groupBy("segment_order").applyInPandas(encode, "segment_order bigint, content binary")


def encode_catalogue(edits: DataFrame) -> bytes:
    """A catalogue's bytes: one frame for all edits with the same edit_seq, removals first.  Edits are some 100 bytes a run."""
    rows = edits.orderBy("edit_seq", F.col("action").desc(), "run_id").toLocalIterator()
    frames = groupby(rows, key=lambda r: r["edit_seq"])
    return b"".join(codecs.encode_edits([r["run_id"] if r["action"] == "REMOVE" else codecs.RunMeta(r["run_id"], r["entry_count"], r["size_bytes"], r["level"], bytes(r["min_key"]), bytes(r["max_key"])) for r in own]) for _, own in frames)


def respond(requests: DataFrame, answer) -> DataFrame:
    """req_id, content: the encoded response to each encoded request (seq, content).

    answer: from requests (seq, req_id, op, key, value) to responses (seq, req_id, code, value), such as ``execute``.
    """

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = ((seq, req_id, op, key, value) for seq, content in zip(frame["seq"], frame["content"]) for op, req_id, key, value in codecs.decode_requests(bytes(content)))
            yield from _blocks(rows, ["seq", "req_id", "op", "key", "value"])

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            content = [codecs.encode_response(int(i), int(c), None if v is None else bytes(v)) for i, c, v in zip(frame["req_id"], frame["code"], frame["value"])]
            yield pd.DataFrame({"seq": frame["seq"], "req_id": frame["req_id"], "content": content})

    asked = requests.select("seq", "content").mapInPandas(decode, "seq bigint, req_id bigint, op string, key binary, value binary")
    return answer(asked).select("seq", "req_id", "code", "value").mapInPandas(encode, "seq bigint, req_id bigint, content binary")


def encode_requests(requests: DataFrame) -> DataFrame:
    """seq, content: the bytes of each request (seq, req_id, op, key, value)."""

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            content = [codecs.encode_request(op, int(i), bytes(k), None if v is None else bytes(v)) for op, i, k, v in zip(frame["op"], frame["req_id"], frame["key"], frame["value"])]
            yield pd.DataFrame({"seq": frame["seq"], "content": content})

    return requests.select("seq", "req_id", "op", "key", "value").mapInPandas(encode, "seq bigint, content binary")


def write_files(contents: DataFrame, files, path: str, prefix: str) -> int:
    """Writes each row (a number, content) as path/prefix_number, each in one step; one file is in memory at a time.

    Tasks write to local files; to other stores the driver does, and all contents pass it.
    """
    if (folder := files.local_folder(path)) is not None:

        def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            n = 0
            for frame in frames:
                for number, content in zip(frame.iloc[:, 0], frame.iloc[:, 1]):
                    with _Whole(f"{folder}/{prefix}_{number}") as out:
                        out.write(bytes(content))
                    n += 1
            yield pd.DataFrame({"n": [n]})

        return contents.mapInPandas(write, "n bigint").agg(F.sum("n")).first()[0] or 0
    n = 0
    for number, content in contents.toLocalIterator():
        files.create_bytes(f"{path.rstrip('/')}/{prefix}_{number}", bytes(content))
        n += 1
    return n


class _Whole:
    """A local file that gets its name in one step, when it is whole; a file of that name with other bytes is a conflict."""

    def __init__(self, path: str) -> None:
        folder, name = os.path.split(path)
        self.path, self.aside, self.size = path, f"{folder}/.{name}.{uuid.uuid4().hex}", 0
        self.out = open(self.aside, "wb")

    def __enter__(self) -> _Whole:
        return self

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def __exit__(self, kind, *_) -> None:
        self.out.close()
        try:
            if kind is None:
                os.link(self.aside, self.path)
        except FileExistsError:
            # A task that is tried again finds what it wrote.
            if not _same(self.aside, self.path):
                raise CommitConflict(self.path) from None
        finally:
            os.remove(self.aside)


def _same(one: str, other: str, size: int = 1 << 20) -> bool:
    with open(one, "rb") as a, open(other, "rb") as b:
        while (block := a.read(size)) == b.read(size):
            if not block:
                return True
    return False


def _commands(frame: pd.DataFrame) -> list[tuple[str, bytes, bytes | None]]:
    return [(op, bytes(k), None if v is None else bytes(v)) for op, k, v in zip(frame["op"], frame["key"], frame["value"])]


def write_parts(log: DataFrame, folder: str, first: int, stride: int, ranges: int) -> list[int]:
    """Writes a log (seq, op, key, value), in order of seq, as segments into a local folder; returns their orders, which name the files.

    Each of so many ranges of seq is written by one task, as files of some PART_BYTES,
    whose orders start at first plus the range's number times stride.
    """

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = ((int(own), block) for frame in frames for at in range(0, len(frame), 8192) for own, block in frame[at : at + 8192].groupby("range", sort=False))
        for own, blocks in groupby(rows, key=lambda r: r[0]):
            blocks, n, held = (b for _, b in blocks), 0, None
            while (held := next(blocks, None)) is not None:
                if n == stride:
                    raise ExhaustedSegments("a range has more parts than orders")
                order, n, count = first + own * stride + n, n + 1, 0
                with _Whole(f"{folder}/{order}") as part:
                    part.write(codecs.encode_order(order))
                    while held is not None:
                        part.write(codecs.encode_mutations(_commands(held)))
                        count += len(held)
                        # Blocks are far smaller than the half of 2^20 commands that a part may have.
                        held = next(blocks, None) if part.size < PART_BYTES and count < 1 << 19 else None
                yield pd.DataFrame({"order": [order]})

    ranged = log.select("seq", "op", "key", "value").repartitionByRange(ranges, "seq").withColumn("range", F.spark_partition_id())
    return sorted(r["order"] for r in ranged.sortWithinPartitions("seq").mapInPandas(write, "order bigint").collect())

"""Line dedup over levelled sorted runs of line hashes.

A line's key is the line without ASCII white space at both ends, A-Z
lower-cased; keys under ``min_chars`` code points are left alone.  A key that at
least ``min_docs`` documents hold keeps its lines in the largest doc_id only.

``LineRuns`` is the store: runs of (hash, documents, keeper), each bucketed by
hash and sorted inside its buckets, in the shared folder.  A batch of documents
is dealt by hash once and merge-anti-joined with each run in turn: no run is ever
shuffled again, as its buckets are the batch's partitions.  Hashes that no run
has are fresh, and the batch's largest doc_id is their keeper; known hashes only
add documents.  The batch's own entries become a run of level 0.  When a level
holds ``fanout`` runs, they are merged into one of the next level, bucket by
bucket.  Batches hold about as many documents each and arrive by falling doc_id,
so the first keeper of a hash is its largest doc_id, and dropping is decided by
the merged run.

A hash has 128 bits (XXH3), so two keys share one with negligible odds even
among 10^12 lines.  Only entries of 16 bytes and two numbers are shuffled, after
a map-side combine; a very common line is one entry for each task.  Entries of
lines that fewer than ``min_docs`` documents hold never meet the texts again.

Null and empty texts are one empty line.  Rows without a doc_id keep all lines
and don't count.  Rows that repeat a doc_id are one document when counting, and
all keep the lines that it keeps.  Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remove, shared_folder, ship, temporary, written

_SPACE = b" \t\n\x0b\x0c\r"


def line_keys(text: str | None, min_chars: int) -> list[bytes | None]:
    """The key of each line, None for those too short."""
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    out: list[bytes | None] = []
    for line in raw.lower().split(b"\n"):
        line = line.strip(_SPACE)
        long = len(line) >= min_chars and (line.isascii() or len(line.decode("utf-8", "surrogatepass")) >= min_chars)
        out.append(line if long else None)
    return out


def postings(docs: DataFrame, min_chars: int) -> DataFrame:
    """h, doc_id: once for each row and key."""

    def emit(records):
        from xxhash import xxh3_128_digest

        for record in records:
            hashes, ids = [], []
            for doc_id, text in zip(record.column(0).to_pylist(), record.column(1)):
                own = {xxh3_128_digest(k) for k in line_keys(text.as_py(), min_chars) if k is not None}
                hashes += own
                ids += [doc_id] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.binary()), pa.array(ids, pa.int64())], names=["h", "doc_id"])

    return docs.where("doc_id is not null").selectExpr("cast(doc_id as bigint) as doc_id", "text").mapInArrow(emit, "h binary, doc_id bigint")


class LineRuns:
    """Levelled sorted runs of line hashes in the shared folder.

    A run is a table of this session over files of its own; all have ``buckets`` buckets.
    """

    def __init__(self, spark: SparkSession, fanout: int = 3, buckets: int = 8) -> None:
        self.spark, self.fanout, self.buckets = spark, fanout, buckets
        self.levels: list[list[str]] = [[]]

    def __enter__(self) -> LineRuns:
        return self

    def __exit__(self, *_) -> None:
        for level in self.levels:
            for name in level:
                self._drop(name)

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(self.spark, self._path(name))

    def _path(self, name: str) -> str:
        return f"{shared_folder(self.spark)}/{name}"

    def _names(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def _add(self, entries: DataFrame, level: int) -> None:
        name = f"line_run_{level}_{uuid.uuid4().hex}"
        entries.write.bucketBy(self.buckets, "h").sortBy("h").option("path", self._path(name)).format("parquet").saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def ingest(self, entries: DataFrame) -> None:
        """entries: h, n, keeper of a batch whose documents all come before those of later batches."""
        rows, seen = entries.repartition(self.buckets, "h"), []
        for k, name in enumerate(self._names()):
            # The anti-join's two sides: fresh hashes bring a keeper, known ones don't.
            run = self.spark.table(name).select(F.col("h").alias(f"h{k}"))
            rows = rows.join(run.hint("merge"), F.col("h") == F.col(f"h{k}"), "left")
            seen.append(F.col(f"h{k}"))
        fresh = F.coalesce(*seen).isNull() if seen else F.lit(True)
        self._add(rows.select("h", "n", F.when(fresh, F.col("keeper")).alias("keeper")), 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            self._compact(level)
            level += 1

    def _compact(self, level: int) -> None:
        names, self.levels[level] = self.levels[level], []
        self._add(self._merged(names), level + 1)
        for name in names:
            self._drop(name)

    def _merged(self, names: list[str]) -> DataFrame:
        """One entry for each hash of the runs, which have it once each: their buckets side by side."""
        merged = self.spark.table(names[0])
        for name in names[1:]:
            more = self.spark.table(name).select(F.col("h").alias("g"), F.col("n").alias("m"), F.col("keeper").alias("other"))
            merged = merged.join(more.hint("merge"), F.col("h") == F.col("g"), "full").select(
                F.coalesce("h", "g").alias("h"), (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"), F.greatest("keeper", "other").alias("keeper")
            )
        return merged

    def entries(self) -> DataFrame:
        """One entry for each hash."""
        return self._merged(self._names())


def dropped_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 4, fanout: int = 3, bucket_rows: int = 1_000_000) -> DataFrame:
    """gone_id, gone: the hashes whose lines a document loses, for each document that loses any.

    batches: of about as many documents each; bucket_rows: postings for each bucket of the runs.
    """
    spark = docs.sparkSession
    cuts = docs.agg(F.percentile_approx(F.col("doc_id").cast("bigint"), [k / batches for k in range(1, batches)], 10_000)).first()[0] or []
    # From the top down: above the last cut, between cuts, up to the first one.
    bounds = [None, *sorted(set(cuts), reverse=True), None]
    with temporary(spark) as keep:
        keys, _ = written(postings(docs, min_chars), "line-postings")
        with LineRuns(spark, fanout, max(1, -(-keys.count() // bucket_rows))) as runs:
            for high, low in zip(bounds, bounds[1:]):
                batch = keys if high is None else keys.where(F.col("doc_id") <= high)
                batch = batch if low is None else batch.where(F.col("doc_id") > low)
                runs.ingest(batch.groupBy("h").agg(F.countDistinct("doc_id").alias("n"), F.max("doc_id").alias("keeper")))
            # A table of its own, so that the join's sides are plain exchanges and a very common line's postings can be split.
            frequent, _ = written(runs.entries().where(F.col("n") >= min_docs).select("h", "keeper"), "frequent-lines")
        gone = keys.join(frequent, "h").where(F.col("doc_id") < F.col("keeper")).groupBy(F.col("doc_id").alias("gone_id")).agg(F.collect_set("h").alias("gone"))
        return keep(gone, "dropped-lines")[0]


def cut_lines(text: str, gone: list[bytes] | None, min_chars: int) -> tuple[list[str], int]:
    """The lines that stay, and how many there were."""
    from xxhash import xxh3_128_digest

    lines = text.split("\n")
    if not gone:
        return lines, len(lines)
    lost = set(gone)
    return [line for line, k in zip(lines, line_keys(text, min_chars)) if k is None or xxh3_128_digest(k) not in lost], len(lines)


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 4, fanout: int = 3) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept (the text that stays) of each row of docs."""
    dropped = dropped_lines(docs, min_chars, min_docs, batches, fanout)
    rows = docs.selectExpr("cast(doc_id as bigint) as doc_id", "text").join(dropped.hint("shuffle_hash"), F.col("doc_id") == F.col("gone_id"), "left").select("doc_id", "text", "gone")

    def cut(records):
        for record in records:
            out: list[list] = [[], [], []]
            for text, gone in zip(record.column(1), record.column(2).to_pylist()):
                kept, n = cut_lines(text.as_py() or "", gone, min_chars)
                for column, value in zip(out, (n, n - len(kept), "\n".join(kept))):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([record.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept"])

    return rows.mapInArrow(cut, "doc_id bigint, n_lines bigint, n_dropped bigint, kept string")


def replace_texts(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 4, fanout: int = 3) -> DataFrame:
    """docs with the lines gone: all rows and columns stay; text, and n_chars if there is one, are the rest's."""
    dropped = dropped_lines(docs.select("doc_id", "text"), min_chars, min_docs, batches, fanout)
    names = [c.lower() for c in docs.columns]
    at, count_at = names.index("text"), names.index("n_chars") if "n_chars" in names else None
    # Positions, not names: docs may have columns of any name.
    columns = [F.col(f"d.`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    rows = docs.alias("d").join(dropped.hint("shuffle_hash").alias("x"), F.col("d.doc_id").cast("bigint") == F.col("x.gone_id"), "left").select(*columns, F.col("x.gone").alias("gone"))
    schema = docs.schema

    def cut(records):
        for record in records:
            arrays = record.columns[:-1]
            texts, sizes = [], []
            for text, gone in zip(record.column(at), record.column(len(arrays)).to_pylist()):
                text = text.as_py()
                texts.append("\n".join(cut_lines(text, gone, min_chars)[0]) if text and gone else text)
                sizes.append(None if texts[-1] is None else len(texts[-1]))
            touched = pa.array([bool(g) for g in record.column(len(arrays)).is_valid().to_pylist()], pa.bool_())
            arrays[at] = pa.array(texts, pa.string())
            if count_at is not None:
                import pyarrow.compute as pc

                arrays[count_at] = pc.if_else(touched, pa.array(sizes, pa.int64()).cast(arrays[count_at].type), arrays[count_at])
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return rows.mapInArrow(cut, schema)


def digest(found: DataFrame) -> DataFrame:
    """The columns of the standard query."""
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(docs: list[tuple], min_chars: int = 40, min_docs: int = 5) -> dict:
    """doc_id to (n_lines, n_dropped, sha256 of the rest), for tests."""
    holders: dict[str, set] = {}

    def key(line: str) -> str:
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    for doc_id, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders.setdefault(key(line), set()).add(doc_id)
    out = {}
    for doc_id, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < min_chars or len(holders[key(x)]) < min_docs or doc_id == max(holders[key(x)])]
        out[doc_id] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


ship(__name__)

"""Mutation streams folded into state.

``stream_into`` applies each micro-batch of a stream to a store: a batch is one
catalogue version that holds the batch's number, so a batch that is replayed
after a failure is skipped.  ``fold_latest`` is the plain form: the newest entry of each
key as the stream's own state, tombstones included, kept without a time limit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from keyfold.config import StorageConfig
from keyfold.operators.log import mutations
from keyfold.plans.store import Store, scratch_folder


def stream_into(store: Store, stream: DataFrame, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Starts a query that applies a stream of log rows (seq, op, key, value) to the store."""

    def apply(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            store.apply(batch, number)

    options = trigger or {"processingTime": f"{store.config.batch_window_ms} milliseconds"}
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**options).start()


def fold_latest(log_stream: DataFrame) -> DataFrame:
    """A streaming aggregate: the newest entry of each key so far."""
    newest = F.max_by(F.struct((F.col("op") == "REMOVE").alias("tombstone"), "value", "seq"), "seq")
    return log_stream.groupBy("key").agg(newest.alias("e")).select("key", "e.tombstone", "e.value", "e.seq")


def fold_events(spark: SparkSession, path: str) -> DataFrame:
    """The live state of the events log, read as a stream to its end."""
    folder = scratch_folder(spark, "stream")
    store = Store(spark, f"{folder}/store", StorageConfig())
    schema = spark.read.parquet(path).schema
    folder_of, name = path.rsplit("/", 1)
    # A stream reads folders: of a single file, its own with a filter for exactly that name.
    reader = spark.readStream.schema(schema)
    stream = reader.parquet(path) if _is_folder(spark, path) else reader.option("pathGlobFilter", name).parquet(folder_of)
    log = mutations(stream, F.lpad(F.col("user_id").cast("string"), 10, "0"), F.col("event_id"), F.col("props"), F.col("event_type") == "error")
    stream_into(store, log, f"{folder}/checkpoint", {"availableNow": True}).awaitTermination()
    return store.scan()


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()

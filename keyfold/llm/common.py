"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import sys
import tempfile
import uuid
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: SQL literal of the ASCII white space that separates words: \x20 and \x09-\x0D.
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def ship(module_name: str) -> None:
    """Pickle a module's functions by value, so executors need not have the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column | str) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def blank_if_null(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application in the store that driver and executors share.

    The store is ``spark.checkpoint.dir``.  Only a local master may lack the
    setting; then a temporary folder stands in.  The application's folder goes
    when Python ends, since tables in it can be part of any result's plan.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="keyfold-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/keyfold-{spark.sparkContext.applicationId}"
    if path not in _registered:
        _registered.add(path)
        atexit.register(_remove_quietly, spark, path)
    return path


_registered: set[str] = set()


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _remove_quietly(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # noqa: BLE001  the JVM may have ended already
        pass


#: For each open ``temporary``, the paths written inside.
_open: list[list[str]] = []


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write a table to the shared folder and read it again: cuts the lineage and outlives executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


@contextmanager
def temporary(spark: SparkSession):
    """Tables written inside go at the end, but for those that ``keep`` writes."""
    _open.append([])
    kept: list[tuple[DataFrame, str]] = []

    def keep(df: DataFrame, name: str) -> tuple[DataFrame, str]:
        kept.append(written(df, name))
        return kept[-1]

    try:
        yield keep
    finally:
        paths = _open.pop()
        for path in paths:
            if path not in {p for _, p in kept}:
                remove(spark, path)
        if _open:
            _open[-1] += [p for _, p in kept]


def running_sums(rows: DataFrame, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """rows with the sums of all rows up to each along an order without ties.

    Rows are dealt by ranges of the order, and each range's totals handed on (one
    row for each range), so no task has all rows.
    """
    # Written: ranges are drawn anew each time that a plan runs.
    dealt, _ = written(rows.withColumns({f"own_{k}": c for k, c in sums.items()}).repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "dealt")
    inside = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("range").agg(*[F.sum(f"own_{k}").alias(f"all_{k}") for k in sums])
    before = totals.select("range", *[F.coalesce(F.sum(f"all_{k}").over(earlier), F.lit(0)).alias(f"before_{k}") for k in sums])
    own = dealt.withColumns({f"inside_{k}": F.sum(f"own_{k}").over(inside) for k in sums}).join(before, "range")
    return own.select(*rows.columns, *[(F.col(f"inside_{k}") + F.col(f"before_{k}")).alias(k) for k in sums])


def keep_rows(docs: DataFrame, keep) -> DataFrame:
    """The rows of docs that ``keep`` marks, all columns as they are.

    keep() is called once in each task and gives a function from a list of texts to a list of booleans.
    """
    at = [c.lower() for c in docs.columns].index("text")

    def select(batches):
        import pyarrow as pa

        marks = keep()
        for record in batches:
            for low in range(0, record.num_rows, 2048):
                part = record.slice(low, 2048)
                yield part.filter(pa.array(marks(part.column(at).to_pylist()), pa.bool_()))

    return docs.mapInArrow(select, docs.schema)


ship(__name__)

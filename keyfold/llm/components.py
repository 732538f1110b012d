"""Connected components of a distributed edge list by alternating stars.

Each round hangs a node's larger neighbours on its smallest one (large star),
then its smaller neighbours (small star), until the edges stay the same: every
node then hangs on its component's smallest node.  Rounds grow with the
logarithm of the nodes.  A round is aggregates and equi-joins, so a node of very
many edges is split like any skewed join key.  Each round's edges are a table in the
shared folder: lineage stays short and a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, ship, temporary, written


def _fingerprint(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], r["s"]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # Written, so that the join's sides are plain exchanges and a node of very many edges can be split.
    least, _ = written(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("m", "u").alias("m")), "least")
    return both.join(least, F.col("u") == F.col("c")).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least.withColumnRenamed("u", "c"), F.col("u") == F.col("c")).where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.withColumnRenamed("m", "v")).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root (the component's smallest node) of each node with an edge to another.

    edges: a and b, of any ordered type, in any direction, repeats and loops allowed.
    """
    spark = edges.sparkSession
    edges = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    now, path = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = _fingerprint(now)
    for _ in range(most_rounds if before[0] else 0):
        with temporary(spark) as keep:
            after, after_path = keep(_small_star(_large_star(now)), "edges")
        remove(spark, path)
        now, path, last = after, after_path, before
        before = _fingerprint(now)
        if before == last:
            break
    else:
        if before[0]:
            raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))


ship(__name__)

"""Approximate nearest neighbours by inner product: a robust-pruned directed graph for each shard.

Vectors are cut into shards of about ``shard_bytes`` (in 32-bit floats) by a hash of their
smallest id.  In a shard, points are inserted in batches: a greedy beam search
over the graph so far proposes neighbours, and relaxed distance pruning keeps the
near and diverse ones: a candidate goes if a kept neighbour is nearer to it, by
the factor ``alpha``, than the point is.  Edges are mirrored and full nodes
pruned again.  All points are inserted twice, and nodes that no start reaches get
an edge from the nearest that one does.  Searches start at 64 nodes of the shard.
Inner products become distances by one more coordinate that gives all vectors of
a shard the same length; graphs are built on 32-bit floats scaled to the shard's
largest component.

Queries are cut into blocks of up to ``block_size``; each block meets each shard's
graph once.  A block's task gets the graph first and then streams its queries.  A
beam search finds candidates, scored exactly (double precision, in order of the
coordinates) on the original vectors.  Then the best of all shards are merged.

Every row is a candidate, also of repeated ids.  Equal vectors are one node with
its smallest ids, two more than a result has ranks, which is all that ties can
show; so a vector that a third of all rows share neither fills a shard nor hides
others.  Vectors that are null, empty, zero, or hold nulls or non-finite numbers
take no part, nor do rows without id.  Vectors of unlike lengths don't meet.  A
query row is never its own neighbour, but another row with its id can be.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, temporary, written

DEGREE, BUILD_BEAM, BEAM, ALPHA, STARTS = 24, 80, 256, 1.2, 64


def usable(v: str = "embedding") -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def scaled(x: np.ndarray) -> np.ndarray:
    """The same directions and proportions with components of up to 1, which 32-bit floats can hold."""
    most = np.abs(x).max() if x.size else 0
    return (x / most if most > 0 else x).astype(np.float32)


class Graph:
    """The graph of one shard.  x: vectors of the same length."""

    def __init__(self, x: np.ndarray, edges: np.ndarray | None = None) -> None:
        self.raw = x
        x = scaled(x)
        squares = (x.astype(np.float64) ** 2).sum(axis=1)
        last = np.sqrt(np.maximum(squares.max() - squares, 0))
        self.x = np.concatenate([x, last[:, None].astype(np.float32)], axis=1)
        self.sq = (self.x**2).sum(axis=1)
        #: Where searches start: a tight cluster is easily entered but not left, so they start all over the shard.
        self.starts = np.unique(np.linspace(0, len(x) - 1, STARTS).astype(np.int32))
        self.edges = self._build() if edges is None else edges

    def _build(self, batch: int = 256) -> np.ndarray:
        n = len(self.x)
        rng = np.random.default_rng(7)
        #: Neighbours of each node, filled up with the node itself.
        self.edges = np.repeat(np.arange(n, dtype=np.int32)[:, None], DEGREE, axis=1)
        order = np.concatenate([self.starts, np.setdiff1d(rng.permutation(n), self.starts)])
        order[len(self.starts) :] = rng.permutation(order[len(self.starts) :])
        done = len(self.starts)
        self.edges[self.starts] = self.prune(self.starts, np.repeat(self.starts[None, :], done, axis=0))
        while done < n:
            new = order[done : done + batch]
            self._insert(new)
            done += len(new)
        # Once more, now that every point has all the others to choose from.
        self._connect()
        for at in range(0, n, batch):
            self._insert(order[at : at + batch])
        self._connect()
        return self.edges

    def _insert(self, new: np.ndarray) -> None:
        ids, _ = self.beam(self.x[new], BUILD_BEAM)
        self.edges[new, :DEGREE] = self.prune(new, np.concatenate([ids, self.edges[new]], axis=1))
        self._mirror(new)

    def _connect(self) -> None:
        """Gives every node that no start reaches an edge from the nearest that one does: a tight cluster can lose its last one."""
        self.edges = self.edges[:, :DEGREE]
        n = len(self.x)
        reached = np.zeros(n, bool)
        self._reach(self.starts, reached)
        bridges: dict[int, list[int]] = {}
        while not reached.all():
            node = int(np.flatnonzero(~reached)[0])
            inside = np.flatnonzero(reached)
            gap = self.sq[inside] - 2 * self.x[inside] @ self.x[node]
            bridges.setdefault(int(inside[gap.argmin()]), []).append(node)
            self._reach(np.array([node]), reached)
        if bridges:
            more = np.repeat(np.arange(n, dtype=np.int32)[:, None], max(map(len, bridges.values())), axis=1)
            for node, far in bridges.items():
                more[node, : len(far)] = far
            self.edges = np.concatenate([self.edges, more], axis=1)

    def _reach(self, front: np.ndarray, reached: np.ndarray) -> None:
        while len(front):
            reached[front] = True
            front = np.unique(self.edges[front])
            front = front[~reached[front]]

    def _mirror(self, new: np.ndarray) -> None:
        target = self.edges[new, :DEGREE].ravel()
        source = np.repeat(new, DEGREE).astype(np.int32)
        real = target != source
        target, source = target[real], source[real]
        if not len(target):
            return
        order = np.argsort(target, kind="stable")
        target, source = target[order], source[order]
        nodes, first, counts = np.unique(target, return_index=True, return_counts=True)
        pool = np.repeat(nodes.astype(np.int32)[:, None], counts.max(), axis=1)
        pool[np.repeat(np.arange(len(nodes)), counts), np.arange(len(target)) - np.repeat(first, counts)] = source
        pool = np.concatenate([self.edges[nodes], pool], axis=1)
        for at in range(0, len(nodes), 512):
            part = slice(at, at + 512)
            self.edges[nodes[part], :DEGREE] = self.prune(nodes[part], pool[part])

    def prune(self, points: np.ndarray, pool: np.ndarray, widest: int = 96) -> np.ndarray:
        """Of each row's candidates, the near and diverse ones; candidates may repeat or be the point itself."""
        own = self.x[points]
        pool = np.sort(pool, axis=1)
        gap = self.sq[pool] + self.sq[points][:, None] - 2 * np.einsum("pd,pkd->pk", own, self.x[pool])
        gap[(pool == points[:, None]) | np.concatenate([np.zeros((len(pool), 1), bool), pool[:, 1:] == pool[:, :-1]], axis=1)] = np.inf
        order = np.argsort(gap, axis=1, kind="stable")[:, :widest]
        pool, gap = np.take_along_axis(pool, order, 1), np.take_along_axis(gap, order, 1)
        near = self.x[pool]
        between = self.sq[pool][:, :, None] + self.sq[pool][:, None, :] - 2 * near @ near.transpose(0, 2, 1)
        alive, rows = np.isfinite(gap), np.arange(len(points))
        out = np.repeat(points.astype(np.int32)[:, None], DEGREE, axis=1)
        for k in range(DEGREE):
            some = alive.any(axis=1)
            if not some.any():
                break
            pick = alive.argmax(axis=1)
            out[some, k] = pool[rows, pick][some]
            alive &= ~(ALPHA * ALPHA * between[rows, pick] <= gap)
            alive[rows, pick] = False
        return out

    def beam(self, queries: np.ndarray, width: int, wide: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """The ids and distances of each query's nearest nodes met; ids repeat the last where fewer were met."""
        n, q = len(self.x), len(queries)
        seen = np.zeros((q, n), bool)
        k = min(width, len(self.starts))
        first = self.sq[self.starts] - 2 * queries @ self.x[self.starts].T
        order = np.argsort(first, axis=1, kind="stable")[:, :k]
        ids = np.full((q, width), self.starts[0], np.int32)
        far = np.full((q, width), np.inf, np.float32)
        ids[:, :k], far[:, :k] = self.starts[order], np.take_along_axis(first, order, 1)
        seen[:, self.starts] = True
        open_ = np.isfinite(far)
        rows = np.arange(q)
        while True:
            active = open_.any(axis=1)
            if not active.any():
                return ids, far
            own = rows[active]
            # The first open ones of each beam, which is in order of distance.
            pick = np.argsort(~open_[own], axis=1, kind="stable")[:, :wide]
            chosen = np.take_along_axis(open_[own], pick, 1)
            nodes = np.take_along_axis(ids[own], pick, 1)
            open_[own[:, None], pick] = False
            reach = self.edges[nodes].reshape(len(own), -1)
            reach = np.where(np.repeat(chosen, self.edges.shape[1], axis=1), reach, nodes[:, :1])
            reach.sort(axis=1)
            fresh = ~seen[own[:, None], reach]
            fresh[:, 1:] &= reach[:, 1:] != reach[:, :-1]
            seen[own[:, None], reach] = True
            gap = self.sq[reach] - 2 * np.matmul(self.x[reach], queries[own][:, :, None])[:, :, 0]
            gap[~fresh] = np.inf
            all_ids, all_far = np.concatenate([ids[own], reach], axis=1), np.concatenate([far[own], gap], axis=1)
            all_open = np.concatenate([open_[own], fresh], axis=1)
            order = np.argsort(all_far, axis=1, kind="stable")[:, :width]
            ids[own], far[own] = np.take_along_axis(all_ids, order, 1), np.take_along_axis(all_far, order, 1)
            open_[own] = np.take_along_axis(all_open, order, 1) & np.isfinite(far[own])

    def nearest(self, queries: np.ndarray, width: int = BEAM) -> list[np.ndarray]:
        """Candidates for each query."""
        # A query's own length doesn't change which inner products are largest.
        queries = np.stack([scaled(q) for q in queries]) if len(queries) else queries
        padded = np.concatenate([queries, np.zeros((len(queries), 1), np.float32)], axis=1)
        out = []
        for at in range(0, len(padded), 256):
            ids, far = self.beam(padded[at : at + 256], width)
            out += [i[np.isfinite(f)] for i, f in zip(ids, far)]
        return out


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of q with each row of x, summed in order of the coordinates."""
    total = np.zeros(len(x))
    for k in range(len(q)):
        total += float(q[k]) * x[:, k].astype(np.float64)
    return total


def _floats(column: pd.Series) -> np.ndarray:
    """A column of vectors of the same length as rows: 32-bit if they all are, else double."""
    return np.stack(column.to_list())


def build_index(vectors: DataFrame, top: int = 20, shard_bytes: int = 4 << 20) -> tuple[DataFrame, DataFrame]:
    """The shards' graphs (dim, shard, graph), and the clean vectors (vec_id, embedding)."""
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    clean = vectors.where(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding")).where(usable())
    with temporary(vectors.sparkSession) as keep:
        ranked = clean.withColumn("k", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))).where(F.col("k") <= top + 2)
        nodes = ranked.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("members"))
        nodes, _ = written(nodes.withColumn("dim", F.size("embedding")), "vector-nodes")
        # One number for each length of vectors.
        shards = {r["dim"]: max(1, -(-r["n"] * r["dim"] * 4 // shard_bytes)) for r in nodes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
        placed = nodes.withColumn("shard", F.pmod(F.xxhash64(F.element_at("members", 1)), _shards_of(shards)).cast("int"))

        def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.assign(first=[m[0] for m in pdf["members"]]).sort_values("first", kind="stable")
            graph = Graph(_floats(pdf["embedding"]))
            counts = np.array([len(m) for m in pdf["members"]], np.int32)
            np.savez(out := io.BytesIO(), raw=graph.raw, edges=graph.edges, counts=counts, members=np.concatenate(pdf["members"].to_list()).astype(np.int64))
            return pd.DataFrame({"dim": [key[0]], "shard": [key[1]], "graph": [out.getvalue()]})

        graphs = placed.select("dim", "shard", "embedding", "members").groupBy("dim", "shard").applyInPandas(build, "dim int, shard int, graph binary")
        return keep(graphs, "vector-graphs")[0], clean


def _shards_of(shards: dict[int, int]) -> Column:
    """The number of shards of vectors of a length; 1 of a length that no vector has."""
    if not shards:
        return F.lit(1)
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in sorted(shards.items()) for x in pair]), F.col("dim")), F.lit(1))


class _Served:
    """A shard's graph as it is sent."""

    def __init__(self, data: bytes) -> None:
        z = np.load(io.BytesIO(data))
        self.graph, self.counts, self.members = Graph(z["raw"], z["edges"]), z["counts"], z["members"]
        self.starts = np.cumsum(self.counts) - self.counts

    def answer(self, numbers: list[int], own_ids: list[int], vectors: np.ndarray, top: int):
        for number, own_id, vector, near in zip(numbers, own_ids, vectors, self.graph.nearest(vectors)):
            s = exact_scores(vector, self.graph.raw[near])
            ids = np.concatenate([self.members[self.starts[i] : self.starts[i] + self.counts[i]] for i in near])
            of = np.repeat(np.arange(len(near)), self.counts[near])
            # One row with the query's id and vector is the query itself.
            itself = np.flatnonzero((ids == own_id) & (self.graph.raw[near] == vector).all(axis=1)[of])[:1]
            ids, s = np.delete(ids, itself), np.delete(s[of], itself)
            best = np.lexsort((ids, -s))[:top]
            yield from ((number, int(i), float(x)) for i, x in zip(ids[best], s[best]))


def search(graphs: DataFrame, queries: DataFrame, top: int = 20, block_size: int = 16384) -> DataFrame:
    """query_id, rank, vec_id, score of the ``top`` nearest found of each query (vec_id, embedding)."""
    # Numbered, since ids can repeat; written, so that numbers stay.
    asked, _ = written(queries.select(F.monotonically_increasing_id().alias("q"), "vec_id", "embedding", F.size("embedding").alias("dim")), "vector-queries")
    blocks = max(1, -(-asked.count() // block_size))
    shards = {r["dim"]: r["last"] + 1 for r in graphs.groupBy("dim").agg(F.max("shard").alias("last")).collect()}
    block = F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int")
    nothing = F.lit(None)
    each = asked.select("dim", F.explode(F.sequence(F.lit(0), _shards_of(shards) - 1)).alias("shard"), block.alias("block"), "q", "vec_id", "embedding", nothing.cast("binary").alias("graph"))
    served = graphs.select("dim", "shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(-1).cast("bigint").alias("q"), nothing.cast("bigint").alias("vec_id"), nothing.cast(asked.schema["embedding"].dataType).alias("embedding"), "graph")
    # In each block the graph comes first, then its queries stream past it.
    dealt = served.unionByName(each).repartition("dim", "shard", "block").sortWithinPartitions("dim", "shard", "block", "q")

    def answer(frames):
        held, key = None, None
        for frame in frames:
            rows = []
            for own, part in frame.groupby(["dim", "shard", "block"], sort=False):
                if own != key:
                    held, key = None, own
                if part["graph"].iloc[0] is not None:
                    held, part = _Served(part["graph"].iloc[0]), part.iloc[1:]
                if held is not None and len(part):
                    rows += held.answer(part["q"].tolist(), part["vec_id"].tolist(), _floats(part["embedding"]), top)
            yield pd.DataFrame(rows, columns=["q", "vec_id", "score"])

    near = dealt.mapInPandas(answer, "q bigint, vec_id bigint, score double")
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), "vec_id")
    best = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(asked.select("q", F.col("vec_id").alias("query_id")), "q").select("query_id", "rank", "vec_id", "score")


ship(__name__)

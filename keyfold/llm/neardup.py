"""MinHash near-dedup by a signature-coordinate inverted join.

A document's set is its distinct shingles of ``words`` words.  Equal sets are one
node, named by a 128-bit digest, so a group of exact copies is one node however
large.  A node's signature has 64 coordinates; nodes are posted under
(coordinate, value) pairs, called tokens, and two nodes can only be linked if
they collide in at least ``match`` coordinates (at the limit of 0.85, 54 are
expected and under 42 come about once in 33,000 pairs).

Prefix: with tokens in one order for all nodes, rare ones first, two nodes with
42 common tokens share one among their first 64 - 42 + 1; only these are posted.
Rarity is read from a histogram of 2^20 hashed counters, a fixed size.  So the
long lists of shared passages are skipped, and only looked up when the collisions
of a candidate pair are counted over all coordinates.

A list of near copies would still give all its pairs, and so would one of pages
of a template that are all a little too unlike.  So lists are merged in two
steps.  First every node of a list meets only the list's hub, its most central
node (see ``hubbed_lists``), and their overlap is counted on the full sets.
Overlaps also give the centre of a hub's near candidates (a similarity of NEAR
per cent with the hub), the shingles that most of them have.  A candidate misses
m of the centre's and has p beyond it.  If two have nothing in common beyond the
centre and miss nothing both, they are linked if and only if w(x) + w(y) >= 0,
for w = (100 - percent) / 2 * size - 100 m - percent * p.  So both are linked
to the candidate of the greatest w, and one star for each hub stands for all
these pairs.  The stars make first components.  What is left:
  - candidates that share a shingle beyond the centre, or miss one both, meet
    under these shingles, rare ones first; only under those that several
    components of a hub's candidates have.  Each such place bounds what a
    candidate can share from there on; like w, the bounds of two add up, so
    candidates that can't reach any partner go before pairs are formed, and one
    of a pair has a bound of 0 or more;
  - nodes of a list that aren't near its hub meet those under CLEAR per cent.
    Distances of sets obey the triangle inequality, so a node linked with one of
    CLEAR has 40 per cent with the hub, is near, and falls under GLIMPSE collisions,
    which decide whether a node is compared with the hub at all, about three times
    in a million.  Pairs are formed if coordinates before the common token, in either
    order, which can't match, leave room for 42, sizes are within the ratio, and
    overlaps with the hub don't rule it out.  Collisions are counted for these pairs,
    and those retained are confirmed on the full sets.
Pairs are only formed between different components.  These drop no pair that
could be linked, so components are those of all links (but for the odds above).

Null texts, texts without words and rows without doc_id are linked with nothing.
Repeated rows each get the result of their text.  With fewer words than a
shingle, the whole sequence is one.  Empty tables give no rows.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, temporary, written
from .components import components

COORDINATES, COUNTERS = 64, 1 << 20
#: The least similarity with a hub, in per cent, of its near candidates, and of those that its centre is made of.
NEAR, CORE = 25, 60
#: Nodes that collide with a hub in fewer coordinates aren't compared with it on full sets; nodes of a higher similarity
#: with the hub than CLEAR per cent aren't sought for them.
GLIMPSE, CLEAR = 8, 55
#: A hub of more candidates or more items than these is wide: its candidates are dealt to parts of about as many.
WIDE = 256, 1 << 18
_U = np.uint64
_rng = np.random.default_rng(20_240_501)
_A = _rng.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * _U(2) + _U(1)
_B = _rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)
_STEP = _U(0x9E3779B97F4A7C15)


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit fingerprints of a text's shingles."""
    from xxhash import xxh3_64_intdigest

    tokens = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not tokens:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, tokens), np.uint64, len(tokens))
    k = min(words, len(h))
    total = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        total = (total ^ (total >> _U(29))) * _STEP + h[i : len(h) - k + 1 + i]
    total = (total ^ (total >> _U(32))) * _STEP
    return np.unique(total ^ (total >> _U(29)))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least value of each coordinate's hash, 32 bits each."""
    least = np.full(COORDINATES, (1 << 32) - 1, np.uint64)
    for at in range(0, len(shingles), 1024):
        part = shingles[at : at + 1024, None] * _A[None, :]
        part += _B[None, :]
        part >>= _U(32)
        np.minimum(least, part.min(axis=0), out=least)
    return least.astype(np.uint32)


def _signatures(column: pa.Array) -> np.ndarray:
    """Rows of coordinates from a column of packed signatures."""
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(len(column), COORDINATES)


def _tokens(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each coordinate's token and its counter."""
    token = (np.arange(COORDINATES, dtype=np.uint64)[None, :] << _U(32)) | sig.astype(np.uint64)
    mixed = (token ^ (token >> _U(31))) * _STEP
    return token, (mixed >> _U(44)).astype(np.int64)


def document_sets(docs: DataFrame, words: int = 5) -> DataFrame:
    """doc_id, n (shingles), node (digest of the set, null if empty), sig of each row."""

    def emit(batches):
        from xxhash import xxh3_128_digest

        for record in batches:
            n, node, sig = [], [], []
            for text in record.column(1):
                s = shingle_set(text.as_py(), words)
                n.append(len(s))
                node.append(xxh3_128_digest(s.tobytes()) if len(s) else None)
                sig.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([record.column(0), pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(sig, pa.binary())], names=["doc_id", "n", "node", "sig"])

    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "text").mapInArrow(emit, "doc_id bigint, n bigint, node binary, sig binary")


def _counted(batches_to_counters, rows: DataFrame) -> np.ndarray:
    """2^20 sums over all rows, whatever the input: batches_to_counters gives arrays of counters."""

    def count(batches):
        total = np.zeros(COUNTERS, np.int64)
        for record in batches:
            for counters in batches_to_counters(record):
                np.add.at(total, counters, 1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["c", "n"])

    out = np.zeros(COUNTERS, np.int64)
    found = rows.mapInArrow(count, "c int, n bigint").groupBy("c").agg(F.sum("n").alias("n")).toArrow()
    out[found.column("c").to_numpy()] = found.column("n").to_numpy()
    return out


def token_counters(nodes: DataFrame) -> np.ndarray:
    """How often each counter's tokens occur."""
    return _counted(lambda record: [_tokens(_signatures(record.column(0)))[1].ravel()] if record.num_rows else [], nodes.select("sig"))


def postings(nodes: DataFrame, counters: np.ndarray, match: int) -> DataFrame:
    """token, node, n, mask (coordinates before it in the node's order) of each prefix token."""
    shared = nodes.sparkSession.sparkContext.broadcast(counters)
    prefix = COORDINATES - match + 1

    def post(batches):
        counts = shared.value
        for record in batches:
            for at in range(0, record.num_rows, 4096):
                part = record.slice(at, 4096)
                token, counter = _tokens(_signatures(part.column(2)))
                often = counts[counter]
                rank = (np.minimum(often, (1 << 31) - 1).astype(np.uint64) << _U(32)) | ((token * _STEP) >> _U(32))
                order = np.argsort(rank, axis=1, kind="stable")
                bits = _U(1) << order.astype(np.uint64)
                before = np.cumsum(bits, axis=1, dtype=np.uint64) - bits
                first = order[:, :prefix]
                rows = np.repeat(np.arange(part.num_rows), prefix)
                # A token that fills its counter alone collides with nothing.
                real = (np.take_along_axis(often, first, 1) > 1).ravel()
                rows = pa.array(rows[real])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.take_along_axis(token, first, 1).astype(np.int64).ravel()[real]), part.column(0).take(rows), part.column(1).take(rows), pa.array(before[:, :prefix].astype(np.int64).ravel()[real])],
                    names=["token", "node", "n", "mask"],
                )

    return nodes.select("node", "n", "sig").mapInArrow(post, "token bigint, node binary, n bigint, mask bigint")


def colliding(pairs: DataFrame, nodes: DataFrame, match: int) -> DataFrame:
    """The pairs (a, b) with at least ``match`` equal coordinates."""
    sig = lambda side: nodes.select(F.col("node").alias(side), F.col("sig").alias(f"sig_{side}"))
    both = pairs.select("a", "b").join(sig("a"), "a").join(sig("b"), "b").select("a", "b", "sig_a", "sig_b")

    def count(batches):
        for record in batches:
            if record.num_rows:
                equal = (_signatures(record.column(2)) == _signatures(record.column(3))).sum(axis=1)
                yield pa.RecordBatch.from_arrays([record.column(0), record.column(1)], names=["a", "b"]).filter(pa.array(equal >= match))

    return both.mapInArrow(count, "a binary, b binary")


def full_texts(needed: DataFrame, nodes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """node, text: one row for each needed node, however many rows repeat its document."""
    holders = nodes.join(needed, "node").select("node", F.col("rep").alias("holder"))
    # One plan at all sizes: holders grow with the documents, so texts are dealt to them.
    texts = holders.hint("merge").join(docs.selectExpr("cast(doc_id as bigint) as holder", "text"), "holder").select("node", "text")

    def own(batches):
        from xxhash import xxh3_128_digest

        for record in batches:
            # Another row's text with the same doc_id is another node's.
            same = [xxh3_128_digest(shingle_set(text.as_py(), words).tobytes()) == node for node, text in zip(record.column(0).to_pylist(), record.column(1))]
            yield record.filter(pa.array(same, pa.bool_()))

    return texts.mapInArrow(own, "node binary, text string").dropDuplicates(["node"])


def confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, percent: int, near: int = NEAR) -> DataFrame:
    """a, b, n_a, n_b, common, linked, near, more and less of each pair, from the whole texts.

    near: a similarity of ``near`` per cent; such pairs have the fingerprints that only b (more) and only a (less) has.
    """
    pairs = pairs.select("a", "b")
    needed = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    texts, _ = written(full_texts(needed, nodes, docs, words), "pair-texts")
    side = lambda s: texts.select(F.col("node").alias(s), F.col("text").alias(f"text_{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "text_a", "b", "text_b")

    def compare(batches):
        kept: OrderedDict[bytes, np.ndarray] = OrderedDict()
        held = 0

        def of(node: bytes, text) -> np.ndarray:
            nonlocal held
            if node in kept:
                kept.move_to_end(node)
                return kept[node]
            kept[node] = s = shingle_set(text.as_py(), words)
            held += len(s)
            while held > 2_000_000 and len(kept) > 1:
                held -= len(kept.popitem(last=False)[1])
            return s

        for record in batches:
            for low in range(0, record.num_rows, 512):
                part = record.slice(low, 512)
                out: list[list] = [[] for _ in range(9)]
                for a, text_a, b, text_b in zip(part.column(0).to_pylist(), part.column(1), part.column(2).to_pylist(), part.column(3)):
                    x, y = of(a, text_a), of(b, text_b)
                    at = np.searchsorted(x, y)
                    shared = x[np.minimum(at, len(x) - 1)] == y
                    common = int(shared.sum())
                    union = len(x) + len(y) - common
                    close = 100 * common >= near * union
                    left = np.ones(len(x), bool)
                    left[at[shared]] = False
                    row = (a, b, len(x), len(y), common, 100 * common >= percent * union, close, y[~shared].astype(np.int64) if close else [], x[left].astype(np.int64) if close else [])
                    for column, value in zip(out, row):
                        column.append(value)
                kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["a", "b", "n_a", "n_b", "common", "linked", "near", "more", "less"])

    found = both.mapInArrow(compare, "a binary, b binary, n_a bigint, n_b bigint, common bigint, linked boolean, near boolean, more array<bigint>, less array<bigint>")
    return written(found, "pairs")[0]


def _like_sizes(a: str, b: str, percent: int):
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def hubbed_lists(posted: DataFrame) -> DataFrame:
    """token, node, n, mask, hub, hub_n of each posting in a list of two or more.

    A posting is central if most of its node's postings stand in lists at least
    half as long as its own: an edited or extended copy has postings in short
    lists, its family's original none.  A list's first hub is its most central
    node.  But an original may have other tokens in its prefix, so a hub gives way
    to the most central hub of all the lists that it is in itself.
    """
    sizes, _ = written(posted.groupBy("token").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 1), "list-sizes")
    shared = posted.join(sizes, "token").groupBy("node", "n").agg(F.collect_list(F.struct("token", "mask", "size")).alias("own"))
    central = lambda x: F.size(F.filter("own", lambda y: 2 * y["size"] >= x["size"]))
    shared = shared.select("node", "n", F.explode(F.transform("own", lambda x: F.struct(x["token"].alias("token"), x["mask"].alias("mask"), central(x).alias("central")))).alias("p"))
    shared, _ = written(shared.select("p.token", "node", "n", "p.mask", "p.central"), "shared-lists")
    hubs, _ = written(shared.groupBy("token").agg(F.max(F.struct("central", "node", "n")).alias("hub")), "hubs")
    lists, _ = written(shared.drop("central").join(hubs, "token"), "lists")
    own = hubs.select(F.col("hub.node").alias("node")).distinct()
    better, _ = written(lists.join(own, "node", "left_semi").groupBy(F.col("node").alias("old")).agg(F.max("hub").alias("better")), "better-hubs")
    moved = lists.join(better, F.col("hub.node") == F.col("old"), "left").withColumn("hub", F.coalesce("better", "hub"))
    return written(moved.select("token", "node", "n", "mask", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n")), "hubbed-lists")[0]


def around_centres(known: DataFrame) -> DataFrame:
    """hub, node, n, size, more, miss: each candidate against the centre of its hub's candidates.

    The centre holds the shingles that most candidates with a similarity of CORE
    per cent have (any set would do; this one is close to most); size is its size,
    more and miss are the fingerprints that only the candidate and only the centre
    has.  (If a family's original is not in the table, its hub is an edited copy,
    and all others share what the hub lacks.)  The hub is a candidate as well.
    """
    core = known.where(100 * F.col("common") >= CORE * (F.col("n_a") + F.col("n_b") - F.col("common")))
    sided = core.select("a", F.posexplode(F.array("more", "less")).alias("side", "list")).select("a", "side", F.explode("list").alias("shingle"))
    sizes = core.groupBy("a").agg(F.count(F.lit(1)).alias("k"))
    usual = sided.groupBy("a", "side", "shingle").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") > 1).join(sizes, "a").where(2 * F.col("df") > F.col("k"))
    pick = lambda side: F.collect_list(F.when(F.col("side") == side, F.col("shingle")))
    centres, _ = written(usual.groupBy("a").agg(pick(0).alias("usual"), pick(1).alias("odd")), "centres")
    nothing = F.array().cast("array<bigint>")
    hubs = known.groupBy("a").agg(F.max("n_a").alias("n_a")).select("a", F.col("a").alias("b"), "n_a", F.col("n_a").alias("n_b"), nothing.alias("more"), nothing.alias("less"))
    both = known.select("a", "b", "n_a", "n_b", "more", "less").unionByName(hubs).join(centres, "a", "left")
    both = both.withColumns({"usual": F.coalesce("usual", nothing), "odd": F.coalesce("odd", nothing)})
    more = F.concat(F.array_except("more", "usual"), F.array_except("odd", "less"))
    miss = F.concat(F.array_except("less", "odd"), F.array_except("usual", "more"))
    size = F.col("n_a") - F.size("odd") + F.size("usual")
    out = both.select(F.col("a").alias("hub"), F.col("b").alias("node"), F.col("n_b").alias("n"), size.cast("bigint").alias("size"), more.alias("more"), miss.alias("miss"))
    return written(out, "around-centres")[0]


def _enough(common, n_x, n_y, percent: int):
    return 100 * common >= percent * (n_x + n_y - common)


def _far(percent: int):
    """How far a candidate is from a w of its size."""
    return (100 * F.size("miss") + percent * F.size("more")).alias("far")


def central_links(around: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of each hub's candidates to the one with the greatest w, from exact overlaps.

    x and y have the centre less what either misses in common, and what they
    have beyond it both: size - |miss| - |miss| + shared of miss and of more.
    """
    nearest = around.groupBy("hub").agg(F.min(F.struct(_far(percent), "node", "n", "more", "miss")).alias("z"))
    nearest, _ = written(nearest, "nearest")
    both = around.join(nearest, "hub").where(F.col("node") != F.col("z.node"))
    common = F.col("size") - F.size("miss") - F.size("z.miss") + F.size(F.array_intersect("miss", "z.miss")) + F.size(F.array_intersect("more", "z.more"))
    return both.where(_enough(common, F.col("n"), F.col("z.n"), percent)).select(F.col("z.node").alias("a"), F.col("node").alias("b"))


def _mixed(rows: DataFrame, *keys: str) -> DataFrame:
    """The keys under which several components meet, the component with most rows (``main``), and the greatest reach."""
    each = rows.groupBy(*keys, "root").agg(F.count(F.lit(1)).alias("k"), F.max("reach").alias("reach"))
    main = each.groupBy(*keys).agg(F.count(F.lit(1)).alias("roots"), F.max_by("root", F.struct("k", "root")).alias("main"), F.max("reach").alias("furthest"))
    # Written, so that joins with it have plain exchanges on both sides.
    return written(main.where((F.col("roots") > 1) & (F.col("furthest") >= 0)).drop("roots"), "mixed")[0]


def _meet(rows: DataFrame, keys: tuple, condition, percent: int) -> DataFrame:
    """Pairs (x, y) of rows with equal keys, unlike components, like sizes and reaches that add up to 0 or more, each once.

    One of a pair is outside the keys' main component, so a family that is one
    component already is never paired with itself, and one has a reach of 0 or
    more, so rows of less are never paired with each other.
    """
    rows = rows.join(_mixed(rows, *keys), list(keys)).where(F.col("reach") + F.col("furthest") >= 0)
    kind = F.when(F.col("reach") < 0, 2).otherwise(0) + F.when(F.col("root") != F.col("main"), 1).otherwise(0)
    rows, _ = written(rows.withColumn("kind", kind), "meeting")
    # Whom a row outside the main component looks for: all if it reaches far, else those of the main one that do.
    wanted = F.when(F.col("reach") >= 0, F.array(*map(F.lit, range(4)))).otherwise(F.array(F.lit(0)))
    x, y = rows.where("kind % 2 = 1").withColumn("wanted", F.explode(wanted)).alias("x"), rows.alias("y")
    same = (F.col("x.wanted") == F.col("y.kind")) & (F.col("x.root") != F.col("y.root")) & ((F.col("y.kind") != 1) | (F.col("x.node") < F.col("y.node")))
    for k in keys:
        same &= F.col(f"x.{k}") == F.col(f"y.{k}")
    return x.join(y, same & (F.col("x.reach") + F.col("y.reach") >= 0) & _like_sizes("x.n", "y.n", percent) & condition)


def far_pairs(lists: DataFrame, known: DataFrame, roots: DataFrame, match: int, percent: int) -> DataFrame:
    """Pairs (a, b) of lists, of different components, that may be linked though one isn't near the hub."""
    overlap = known.select(F.col("a").alias("hub"), F.col("b").alias("node"), "common")
    own = lists.where(F.col("node") != F.col("hub")).join(overlap, ["hub", "node"], "left")
    below = lambda limit: F.col("common").isNull() | (100 * F.col("common") < limit * (F.col("n") + F.col("hub_n") - F.col("common")))
    own = own.where(below(CLEAR)).withColumn("reach", F.when(below(NEAR), 1).otherwise(-1))
    own = _rooted(own, roots).select("token", "node", "n", "mask", "root", "common", "reach")
    room = F.bit_count(F.col("x.mask").bitwiseOR(F.col("y.mask"))) <= COORDINATES - match
    by_hub = F.least("x.common", "y.common") + F.least(F.col("x.n") - F.col("x.common"), F.col("y.n") - F.col("y.common"))
    free = F.col("x.common").isNull() | F.col("y.common").isNull() | _enough(by_hub, F.col("x.n"), F.col("y.n"), percent)
    return _meet(own, ("token",), room & free, percent).select(*_ends()).distinct()


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _ends():
    return F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")


def _counters_of(hub: bytes, items: np.ndarray, side: int) -> np.ndarray:
    mixed = (items.view(np.uint64) ^ _U(int.from_bytes(hub[:8], "little")) ^ _U(side)) * _STEP
    return (mixed >> _U(44)).astype(np.int64)


def _lists(column: pa.Array) -> list[np.ndarray]:
    """The lists of a column without nulls, as arrays."""
    values, ends = column.flatten().to_numpy(), np.cumsum(column.value_lengths().to_numpy())
    return np.split(values, ends[:-1]) if len(ends) else []


def undecided(around: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """around, root, main, best_0, best_1, parts of the candidates that may have a link of which nothing is known yet.

    All overlaps with the hub are known, and all with the candidate of the
    greatest w, so neither has to be met again; nor do candidates of one
    component.  So a hub whose others are one component, or a single one, has
    nothing left.  main is the component that most of a hub's others are in, best
    the greatest reach of one of them for each side, parts the number of parts if
    the hub is wide, else 0.
    """
    nearest = around.groupBy("hub").agg(F.min(F.struct(_far(percent), "node"))["node"].alias("z"))
    rows = around.join(written(nearest, "nearest-nodes")[0], "hub").where((F.col("node") != F.col("hub")) & (F.col("node") != F.col("z"))).drop("z")
    rows, _ = written(_rooted(rows, roots), "others")
    tops = [F.max(top).alias(f"best_{side}") for side, top in enumerate(_tops(percent, F.col("n"), F.col("size"), F.size("miss"), F.size("more")))]
    each = rows.groupBy("hub", "root").agg(F.count(F.lit(1)).alias("k"), F.sum(F.size("more") + F.size("miss")).alias("items"), *tops)
    fill = F.greatest(F.sum("k") / WIDE[0], F.sum("items") / WIDE[1])
    hubs = each.groupBy("hub").agg(F.count(F.lit(1)).alias("roots"), F.max_by("root", F.struct("k", "root")).alias("main"), F.max("best_0").alias("best_0"), F.max("best_1").alias("best_1"), F.when(fill > 1, F.ceil(2 * fill)).otherwise(0).cast("bigint").alias("parts"))
    return written(rows.join(written(hubs.where("roots > 1").drop("roots"), "open-hubs")[0], "hub"), "undecided")[0]


def _tops(percent: int, n, size, m, p):
    """For each side, twice what a candidate has over the limit if its partner has the same.

    Shared beyond the centre, all else may be in common; if nothing is, what both
    miss gives back half of what each misses.
    """
    return (100 - percent) * n, (100 - percent) * (size - m) - 2 * percent * p


def item_postings(open_rows: DataFrame, percent: int) -> DataFrame:
    """hub, node, n, size, m, p, root, side, item, place, reach: the items of each candidate under which partners may be found.

    side 0: what it has beyond the centre; side 1: what it misses.  Rare items
    first: what two candidates share can't be before the first that they share.
    Only places from which the likeliest partner could still be reached are posted.
    A hub's candidates are counted together, so only items that several components
    have there are posted, however large the table.  A wide hub's are dealt to
    many tasks, and hashed counters tell which items others may have, and which
    ones outside the main component.
    """

    def counters(record):
        for hub, more, miss in zip(record.column(0).to_pylist(), _lists(record.column(1)), _lists(record.column(2))):
            yield np.concatenate([_counters_of(hub, more, 0), _counters_of(hub, miss, 1)])

    wide = open_rows.where("parts > 0")
    told = [_counted(counters, rows.select("hub", "more", "miss")) for rows in (wide, wide.where(F.col("root") != F.col("main")))]
    shared = open_rows.sparkSession.sparkContext.broadcast(told)
    names = ["hub", "node", "n", "size", "m", "p", "root", "side", "item", "place", "reach"]

    def post(group):
        part = group.select(["hub", "node", "n", "size", "root", "main", "best_0", "best_1", "parts", "more", "miss"]).combine_chunks().to_batches()[0]
        hub, alone = part.column(0)[0].as_py(), part.column(8)[0].as_py() == 0
        n, size = part.column(2).to_numpy(), part.column(3).to_numpy()
        p, m = (part.column(k).value_lengths().to_numpy().astype(np.int64) for k in (9, 10))
        roots = part.column(4).dictionary_encode().indices.to_numpy()
        outside = np.array([root != main for root, main in zip(part.column(4).to_pylist(), part.column(5).to_pylist())])
        out: list[tuple] = []
        for side, top in enumerate(_tops(percent, n, size, m, p)):
            items, of = part.column(9 + side).flatten().to_numpy(), np.repeat(np.arange(len(n)), (p, m)[side])
            limit = (100 - percent) * (n * 100 // percent + 1 if side == 0 else size)
            best = np.minimum(limit, part.column(6 + side).to_numpy())
            if alone:
                _, back, count = np.unique(items, return_inverse=True, return_counts=True)
                often = count[back]
                wanted = often > 1
            else:
                at = _counters_of(hub, items, side)
                often = shared.value[0][at]
                wanted = (often > 1) & (outside[of] | (shared.value[1][at] > 0))
            order = np.lexsort((items, often, of))
            place = np.arange(len(of)) - np.searchsorted(of, np.arange(len(n)))[of]
            reach = top[of] - (100 + percent) * place
            near = wanted[order] & (reach + best[of] >= 0)
            items, of, place, reach = items[order][near], of[near], place[near], reach[near]
            if alone and len(items):
                _, back = np.unique(items, return_inverse=True)
                first, last, most = np.full(back.max() + 1, len(n)), np.full(back.max() + 1, -1), np.full(back.max() + 1, -(1 << 62))
                np.minimum.at(first, back, roots[of])
                np.maximum.at(last, back, roots[of])
                np.maximum.at(most, back, reach)
                some = (first < last)[back] & (reach + most[back] >= 0) & (most[back] >= 0)
                items, of, place, reach = items[some], of[some], place[some], reach[some]
            out.append((of, np.full(len(of), side), items, place, reach))
        rows, *tail = (np.concatenate(c).astype(np.int64) for c in zip(*out))
        head = [part.column(i).take(pa.array(rows)) for i in range(4)] + [pa.array(m[rows]), pa.array(p[rows]), part.column(4).take(pa.array(rows))]
        return pa.Table.from_arrays(head + [pa.array(c) for c in tail], names=names)

    dealt = open_rows.withColumn("part", F.when(F.col("parts") > 0, F.pmod(F.xxhash64("node"), "parts")).otherwise(0))
    return dealt.groupBy("hub", "part").applyInArrow(post, "hub binary, node binary, n bigint, size bigint, m bigint, p bigint, root binary, side bigint, item bigint, place bigint, reach bigint")


def near_links(around: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of a hub's candidates, of different components, that share or miss something besides the centre."""
    around = undecided(around, roots, percent)
    items, _ = written(item_postings(around, percent), "beyond-centres")
    base = F.col("x.size") - F.col("x.m") - F.col("y.m")
    left = lambda total: F.least(F.col(f"x.{total}") - F.col("x.place"), F.col(f"y.{total}") - F.col("y.place"))
    # With a common item beyond the centre, what they miss both is only bounded; without one, it is all.
    bound = F.when(F.col("x.side") == 0, base + F.least("x.m", "y.m") + left("p")).otherwise(base + left("m"))
    met = _meet(items, ("hub", "side", "item"), _enough(bound, F.col("x.n"), F.col("y.n"), percent), percent)
    met, _ = written(met.select(F.col("x.hub").alias("hub"), *_ends()).distinct(), "met")
    # The two candidates' lists give their whole overlap.
    asked = met.select("hub", F.col("a").alias("node")).unionByName(met.select("hub", F.col("b").alias("node"))).distinct()
    told, _ = written(around.join(written(asked, "asked")[0], ["hub", "node"], "left_semi"), "told")
    side = lambda s: told.select("hub", F.col("node").alias(s), F.struct("n", "size", "more", "miss").alias(f"at_{s}"))
    both = met.join(side("a"), ["hub", "a"]).join(side("b"), ["hub", "b"])
    common = F.col("at_a.size") - F.size("at_a.miss") - F.size("at_b.miss") + F.size(F.array_intersect("at_a.miss", "at_b.miss")) + F.size(F.array_intersect("at_a.more", "at_b.more"))
    return both.where(_enough(common, F.col("at_a.n"), F.col("at_b.n"), percent)).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 85, match: int = 42) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of docs."""
    sets, _ = written(document_sets(docs, words), "document-sets")
    with temporary(docs.sparkSession) as keep:
        full = sets.where(F.col("node").isNotNull() & F.col("doc_id").isNotNull())
        nodes, _ = written(full.groupBy("node").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.min("sig").alias("sig")), "nodes")
        posted, _ = written(postings(nodes, token_counters(nodes), match), "postings")
        lists = hubbed_lists(posted)
        spokes = lists.where((F.col("node") != F.col("hub")) & _like_sizes("n", "hub_n", NEAR)).select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
        spokes, _ = written(colliding(spokes, nodes, GLIMPSE), "spokes")
        known = confirmed(spokes, nodes, docs, words, percent)
        around = around_centres(known.where("near"))
        links = known.where("linked").select("a", "b").unionByName(central_links(around, percent))
        first = written(components(links), "first-roots")[0]
        links = links.unionByName(written(near_links(around, first, percent), "near-links")[0])
        far = written(colliding(far_pairs(lists, known, first, match, percent), nodes, match), "far-pairs")[0]
        links = links.unionByName(confirmed(far, nodes, docs, words, percent, near=101).where("linked").select("a", "b"))
        roots = components(links)
        placed = nodes.select("node", "rep").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        ids = placed.groupBy("root").agg(F.min("rep").alias("component_id"))
        named, _ = keep(placed.join(ids, "root").select("node", "component_id"), "named")
    out = sets.select("doc_id", F.col("n").alias("n_shingles"), "node").join(named, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def brute_force(docs: list[tuple], words: int = 5, percent: int = 85) -> dict:
    """doc_id to (n_shingles, component_id) by comparing all pairs; for tests."""

    def shingles(text):
        w = (text or "").encode().lower().split()
        return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())

    rows = [(i, shingles(t)) for i, t in docs]
    parent = {i: i for i, _ in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (i, s) in enumerate(rows):
        for j, t in rows[:k]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in rows}


ship(__name__)

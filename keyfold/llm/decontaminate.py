"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

Patterns are the windows of ``window`` consecutive words of the benchmark items
(an item of fewer words, but not none, is one shorter window).  The patterns of
one length share three tables.  ``shift`` says for a block of two words how far
the search may jump (a block in no pattern: past itself), ``buckets`` lists the
patterns that end with a block, and a direct comparison confirms.  Words of
ordinary text are mostly in no pattern, so the search reads about one block in
``window - 1`` words.

The driver reads the benchmark item by item and builds the tables of a block of
at most ``max_windows`` (window, item) pairs, some 400 bytes each; they are sent
to the tasks, and all rows are searched.  A larger benchmark has further blocks,
each a pass over the rows, which carry what they hit from pass to pass as a
table in the shared folder.  So no table outgrows its bound, on the driver or in
a task, and none of the benchmark is left out.

Null or wordless texts have no words and are never contaminated; null or
wordless items have no windows.  An item without an id still marks words, but
is not listed.  Repeated rows and items each get the same result.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_rows, remove, ship, written

#: Bytes that end a word: all of ASCII but digits and lower-case letters, after lower-casing.
_BLANK = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().translate(_BLANK).split() if text else []


class WuManber:
    """Occurrences of word patterns of one length."""

    def __init__(self, patterns: dict[tuple[bytes, ...], set], length: int) -> None:
        self.length, self.block = length, min(2, length)
        self.far = length - self.block + 1
        self.shift: dict = {}
        self.buckets: dict = {}
        for pattern in patterns:
            for end in range(self.block, length + 1):
                key, jump = self._key(pattern, end), length - end
                if jump < self.shift.get(key, self.far):
                    self.shift[key] = jump
            self.buckets.setdefault(self._key(pattern, length), {})[pattern] = patterns[pattern]

    def _key(self, words, end: int):
        return (words[end - 2], words[end - 1]) if self.block == 2 else words[end - 1]

    def search(self, words: list[bytes]):
        """Yields (end, ids) of each occurrence, by end."""
        shift, buckets, far, length, n = self.shift, self.buckets, self.far, self.length, len(words)
        end = length
        if self.block == 2:
            while end <= n:
                key = (words[end - 2], words[end - 1])
                jump = shift.get(key, far)
                if jump:
                    end += jump
                    continue
                ids = buckets[key].get(tuple(words[end - length : end]))
                if ids is not None:
                    yield end, ids
                end += 1
        else:
            for end, word in enumerate(words, 1):
                ids = buckets[word].get((word,)) if word in buckets else None
                if ids is not None:
                    yield end, ids


def pattern_blocks(items, window: int, max_windows: int):
    """Yields the matchers of each block of the items (id, text); one without patterns if there are none."""
    by_length: dict[int, dict] = {}
    n = blocks = 0
    for item_id, text in items:
        words = words_of(text)
        length = min(window, len(words))
        for at in range(len(words) - length + 1 if length else 0):
            if n >= max_windows:
                yield [WuManber(patterns, k) for k, patterns in sorted(by_length.items())]
                by_length, n, blocks = {}, 0, blocks + 1
            ids = by_length.setdefault(length, {}).setdefault(tuple(words[at : at + length]), set())
            n += item_id not in ids
            ids.add(item_id)
    if n or not blocks:
        yield [WuManber(patterns, k) for k, patterns in sorted(by_length.items())]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same positions as disjoint spans in order."""
    out: list[list[int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [tuple(x) for x in out]


def scan(words: list[bytes], matchers: list[WuManber]) -> tuple[list[tuple[int, int]], set]:
    """The spans of words hit, merged, and the ids with an occurring window."""
    spans, ids = [], set()
    for m in matchers:
        for end, found in m.search(words):
            spans.append((end - m.length, end))
            ids |= found
    return merged(spans), ids


def _passes(rows: DataFrame, benchmark: DataFrame, window: int, max_windows: int, one_pass, name: str) -> DataFrame:
    """rows after one_pass(rows, matchers as a broadcast variable) with each block of the benchmark."""
    blocks = pattern_blocks((tuple(r) for r in benchmark.select("item_id", "text").toLocalIterator()), window, max_windows)
    path = shared = None
    for k, matchers in enumerate(blocks):
        if k:
            # The pass before, so that its tables can go.
            rows, at = written(rows, name)
            shared.destroy()
            if path:
                remove(rows.sparkSession, path)
            path = at
        shared = rows.sparkSession.sparkContext.broadcast(matchers)
        rows = one_pass(rows, shared)
    return rows


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, max_windows: int = 200_000, share: int = 20) -> DataFrame:
    """doc_id, n_words, n_hit, spans (word offsets), item_ids, contaminated of each document.

    contaminated: at least one word in ``share`` is hit.
    """
    carried = "doc_id bigint, text string, n_words bigint, spans array<struct<low:bigint,high:bigint>>, item_ids array<string>"
    span_type = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))

    def search(rows: DataFrame, shared) -> DataFrame:
        def one(batches):
            matchers = shared.value
            for batch in batches:
                out: list[list] = [[], [], []]
                for text, spans, ids in zip(batch.column(1), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                    words = words_of(text.as_py())
                    found, hit = scan(words, matchers)
                    every = merged([(s["low"], s["high"]) for s in spans] + found)
                    row = (len(words), [{"low": a, "high": b} for a, b in every], sorted({*ids, *(str(x) for x in hit if x is not None)}))
                    for column, value in zip(out, row):
                        column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(out[0], pa.int64()), pa.array(out[1], span_type), pa.array(out[2], pa.list_(pa.string()))],
                    names=["doc_id", "text", "n_words", "spans", "item_ids"],
                )

        return rows.mapInArrow(one, carried)

    start = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.lit(0).cast("bigint").alias("n_words"), F.array().cast("array<struct<low:bigint,high:bigint>>").alias("spans"), F.array().cast("array<string>").alias("item_ids"))
    found = _passes(start, benchmark, window, max_windows, search, "benchmark-pass")
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["high"] - s["low"])
    found = found.select("doc_id", "n_words", n_hit.alias("n_hit"), "spans", "item_ids")
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def clean_rows(docs: DataFrame, benchmark: DataFrame, window: int = 13, max_windows: int = 200_000) -> DataFrame:
    """The rows of docs in which no window occurs, however long the text around it."""

    def search(rows: DataFrame, shared) -> DataFrame:
        def keep():
            matchers = shared.value

            def clean(text):
                words = words_of(text)
                return next((False for m in matchers for _ in m.search(words)), True)

            return lambda texts: list(map(clean, texts))

        return keep_rows(rows, keep)

    return _passes(docs, benchmark, window, max_windows, search, "clean-pass")


def digest(found: DataFrame) -> DataFrame:
    """The columns of the standard query."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated",
    )


def brute_force(docs: list[tuple], items: list[tuple], window: int = 13) -> dict:
    """doc_id to (n_words, n_hit, ids) by comparing every window; for tests."""
    windows: dict[tuple, set] = {}
    for item_id, text in items:
        w = words_of(text)
        k = min(window, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[i : i + k]), set()).add(item_id)
    lengths, out = {len(x) for x in windows}, {}
    for doc_id, text in docs:
        w, hit, ids = words_of(text), set(), set()
        for k in lengths:
            for i in range(len(w) - k + 1):
                if (found := windows.get(tuple(w[i : i + k]))) is not None:
                    hit.update(range(i, i + k))
                    ids |= found
        out[doc_id] = (len(w), len(hit), sorted(str(x) for x in ids if x is not None))
    return out


ship(__name__)

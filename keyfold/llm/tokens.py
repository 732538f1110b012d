"""Token counts of whole texts, exactly as the tokenizer's library gives them.

A piece here is a pre-token: a run of non-white characters with the one space
before it, or a run of white space.  A byte-level BPE never merges across these
borders (its own pattern only splits pieces further), so a text's count is the
sum of its pieces' counts.  Each task keeps a table from distinct piece to
count; new pieces of a batch are encoded together once, and a document's count
is the sum of its piece frequencies times the table.  Token ids are never kept.

The table is joined inside the task, not through a shuffle: a distributed join
would move one row for each document and distinct piece, which is more bytes
than the texts themselves.  The table is emptied beyond ``max_pieces`` entries,
so memory is bounded; the counts don't depend on it.

The special string is one token wherever it stands, as the library's default
handles it: it cuts the text, and its sides are split on their own.  Null texts
count as empty.  Rows are independent, so ties and repeated rows need no rule.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ship

#: The Unicode White_Space characters, as the tokenizer's pattern has them.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


class PieceCounter:
    """Counts tokens by way of distinct pieces."""

    def __init__(self, vocabulary: bytes, max_pieces: int = 400_000) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.specials = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.cut = re.compile("|".join(map(re.escape, self.specials))) if self.specials else None
        self.pieces = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+").findall
        self.counts: dict[str, int] = {}
        self.max_pieces = max_pieces

    def many(self, texts: list[str]) -> list[int]:
        frequencies, specials, new = [], [], {}
        for text in texts:
            if self.cut is not None and any(s in text for s in self.specials):
                parts = self.cut.split(text)
                frequency = Counter(p for part in parts for p in self.pieces(part))
                specials.append(len(parts) - 1)
            else:
                frequency = Counter(self.pieces(text))
                specials.append(0)
            frequencies.append(frequency)
            new.update(dict.fromkeys(p for p in frequency if p not in self.counts))
        fresh = list(new)
        for at in range(0, len(fresh), 20_000):
            block = fresh[at : at + 20_000]
            self.counts.update(zip(block, map(len, self.tokenizer.encode_batch_fast(block, add_special_tokens=False))))
        counts = self.counts
        out = [n + sum(counts[p] * k for p, k in f.items()) for f, n in zip(frequencies, specials)]
        if len(counts) > self.max_pieces:
            counts.clear()
        return out


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 1024, batch: int = 256) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each document.

    The tokenizer's file is read on the driver and sent to the tasks, which need not have it; it has the size of a vocabulary.
    """
    with open(tokenizer_path, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())

    def count(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        counter = PieceCounter(shared.value)
        for record in batches:
            texts = [t or "" for t in record.column(1).to_pylist()]
            n = [x for at in range(0, len(texts), batch) for x in counter.many(texts[at : at + batch])]
            yield pa.RecordBatch.from_arrays(
                [record.column(0), pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "text").mapInArrow(count, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")


ship(__name__)

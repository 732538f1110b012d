"""Language identification by cross-parsing against labelled text.

For each language, a bounded sample of labelled text becomes a suffix
automaton.  A text is parsed against it greedily: each phrase is the longest
match in the sample from where the last phrase ended, and one letter where
nothing matches.  Related text needs few, long phrases.

Phrases are normalised: by the text's length, and by the phrases a letter that
other labelled text of the language needs (a fifth of the sample, which is not
in the automaton; the second half of a language's only text).  So a language
with little labelled text, which needs more phrases for anything, isn't beaten
by one with much.  The language with the fewest normalised phrases wins.

The automaton is flattened to one table, next[state, letter], in which a letter
that ends phrases leads to the state that the next phrase starts in, and carries
how many it ends.  So parsing is a walk, and all texts of a batch walk a
language's table together in numpy.  Long texts are walked in blocks at once, as
if each began a phrase, and then again from the state that the block before ends
in, until the states agree with those of the first walk: the parse is that of
the whole text.  Each letter of a language's sample has a class of its own; a
language of many letters has its transitions as a sorted list, searched at each
step, since a table of all states and letters would be too large.

Bounds of the fit: ``max_langs`` languages (those with most labelled documents),
``sample_docs`` texts and ``sample_chars`` characters of each, evenly from all
its texts, and ``all_chars`` of all.  The sample only depends on the set of
labelled rows.  Predictions never see lang, source or doc_id.

Null texts and texts without a letter are ``und`` with score 0.  If nothing is
labelled, all are.  Ties go to the language that sorts first.  Labelled rows
that repeat a doc_id give the least of their texts.  Rows are judged alone; a
table without rows gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep_rows, ship

UNKNOWN = "und"
_LIMIT = 0x110000
_cache: dict = {}


def _letters() -> np.ndarray:
    if "letters" not in _cache:
        _cache["letters"] = np.fromiter((chr(c).isalpha() for c in range(_LIMIT)), bool, _LIMIT)
    return _cache["letters"]


def held_out(doc_id: Column) -> Column:
    """The rows that training never sees: crc32(doc_id as text) mod 4 is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def normal_codes(text: str) -> np.ndarray:
    """Lower-cased code points; each run of other characters than letters becomes one space, and none at the beginning."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    return np.where(letter, codes, 32)[keep]


def suffix_automaton(letters: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that knows each factor of the text."""
    nexts: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in letters:
        new = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and c not in nexts[at]:
            nexts[at][c] = new
            at = link[at]
        if at >= 0:
            target = nexts[at][c]
            if length[at] + 1 == length[target]:
                link[new] = target
            else:
                twin = len(nexts)
                nexts.append(dict(nexts[target]))
                length.append(length[at] + 1)
                link.append(link[target])
                while at >= 0 and nexts[at].get(c) == target:
                    nexts[at][c] = twin
                    at = link[at]
                link[target] = link[new] = twin
        last = new
    return nexts


class Model:
    """The languages' tables.  samples: text of each; rates: phrases a letter that its own text needs (1 if not given)."""

    def __init__(self, samples: dict[str, str], rates: dict[str, float] | None = None, symbols: int = 63) -> None:
        """A language of more than ``symbols`` letters has a sorted list for its table."""
        self.langs, self.samples = sorted(samples), samples
        self.rates = np.array([(rates or {}).get(lang, 1.0) for lang in self.langs])
        coded = {lang: normal_codes(samples[lang]) for lang in self.langs}
        letters = np.unique(np.concatenate([*coded.values(), np.array([], "<u4")]))
        #: Class of each code point; 0 is a letter that no sample has.
        self.classes = np.zeros(_LIMIT, np.uint16 if len(letters) < 1 << 16 else np.int32)
        self.classes[letters] = np.arange(1, len(letters) + 1)
        #: For each language: class in the language of each class (0: not in its sample), the table, and the list's keys or None.
        self.tables = []
        for lang in self.langs:
            own = np.unique(coded[lang])
            width = len(own) + 1
            local = np.zeros(len(letters) + 1, np.int32)
            local[self.classes[own]] = np.arange(1, width)
            nexts = suffix_automaton(local[self.classes[coded[lang]]].tolist())
            # A letter that ends a phrase starts the next one, from the root.  One that no phrase has is a phrase itself.
            root = np.zeros(width, np.int64)
            for c, to in nexts[0].items():
                root[c] = to
            fresh = ((root * width) << 2) | np.where(root > 0, 1, 2)
            if width <= symbols + 1:
                if len(nexts) * width >= 1 << 29:
                    raise ValueError("the sample is too large for the table")
                step = np.tile(fresh, (len(nexts), 1))
                for state, known in enumerate(nexts):
                    for c, to in known.items():
                        step[state, c] = (to * width) << 2
                step[0, root == 0] = 1
                self.tables.append((local, step.ravel().astype(np.int32), None))
            else:
                # The keys are in order by state and letter; what isn't among them is fresh, at the end.
                pairs = [(state * width + c, (to * width) << 2) for state, known in enumerate(nexts) for c, to in sorted((known if state else {c: 0 for c in range(width)} | known).items())]
                keys, to = np.array(pairs, np.int64).T.copy()
                to[:width][root == 0] = 1
                self.tables.append((local, np.concatenate([to, fresh]), np.ascontiguousarray(keys)))

    def phrases(self, texts: list[str | None], block: int = 1024, lanes: int = 4096) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each text (rows) by language (columns), and the texts' lengths in normal characters, 0 without letters."""
        sizes = np.zeros(len(texts), np.int64)
        found = np.zeros((len(texts), len(self.langs)), np.int64)
        pieces: list[np.ndarray] = []
        owners: list[int] = []
        ends: list[bool] = []
        entry: list[int] = [0] * len(self.langs)
        letter = _letters()
        for i, text in enumerate(texts):
            codes = normal_codes(text) if text else np.zeros(0, "<u4")
            if not len(codes) or not letter[codes].any():
                continue
            sizes[i] = len(codes)
            classes = self.classes[codes]
            for at in range(0, len(classes), block):
                pieces.append(classes[at : at + block])
                owners.append(i)
                ends.append(at + block >= len(classes))
                if len(pieces) >= lanes:
                    entry = self._walk(pieces, owners, ends, found, entry)
                    pieces, owners, ends = [], [], []
        if pieces:
            self._walk(pieces, owners, ends, found, entry)
        return found, sizes

    def _walk(self, pieces: list[np.ndarray], owners: list[int], ends: list[bool], found: np.ndarray, entry: list[int], together: int = 64) -> list[int]:
        """Adds the phrases of the pieces to found.  entry: for each language, the state in which the first piece starts; returns that of a next one."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        order = np.argsort(-lengths, kind="stable")
        lengths = lengths[order]
        columns = np.zeros((lengths[0], len(pieces)), self.classes.dtype)
        for row, k in enumerate(order):
            columns[: lengths[row], row] = pieces[k]
        alive = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")  # pieces longer than each position
        owner, last = np.asarray(owners)[order], np.asarray(ends)[order]
        place = np.empty(len(pieces), np.int64)
        place[order] = np.arange(len(pieces))
        # The rows of the pieces before and after, of the same text; -1 for none in this batch.
        before, after = np.full(len(pieces), -1), np.full(len(pieces), -1)
        before[place[1:]] = np.where(np.asarray(ends)[:-1], -1, place[:-1])
        after[place[:-1]] = np.where(np.asarray(ends)[:-1], -1, place[1:])
        out = []
        for k, (local, table, keys) in enumerate(self.tables):

            def step(state, letters, keys=keys, table=table):
                at = state + letters
                if keys is not None:
                    found_at = np.minimum(np.searchsorted(keys, at), len(keys) - 1)
                    at = np.where(keys[found_at] == at, found_at, len(keys) + letters)
                return table[at]

            letters = local[columns]
            started = np.zeros(len(pieces), table.dtype)
            started[place[0]] = entry[k]
            state = started.copy()
            walked = np.zeros(columns.shape, table.dtype)
            for t in range(lengths[0]):
                n = alive[t]
                walked[t, :n] = step(state[:n], letters[t, :n])
                np.right_shift(walked[t, :n], 2, out=state[:n])
            # Again from the state that the piece before ends in, until the states agree: first some steps of all together ...
            true = np.where(before >= 0, state[before], started)
            wrong = np.flatnonzero(true != started)
            started, now = true, true[wrong]
            open_: dict[int, tuple[int, int]] = {}
            for t in range(together):
                ended = lengths[wrong] <= t
                open_ |= {int(w): (t, int(s)) for w, s in zip(wrong[ended], now[ended])}
                wrong, now = wrong[~ended], now[~ended]
                if not len(wrong):
                    break
                to = step(now, letters[t, wrong])
                differs = (to >> 2) != (walked[t, wrong] >> 2)
                walked[t, wrong] = to
                wrong, now = wrong[differs], to[differs] >> 2
            open_ |= {int(w): (together, int(s)) for w, s in zip(wrong, now)}
            # ... then one by one, in order, on into the pieces after.
            for row in sorted(open_, key=lambda row: order[row]):
                if row not in open_:
                    continue
                t, s = open_.pop(row)
                while row >= 0:
                    for t in range(t, lengths[row]):
                        if row in open_ and open_[row][0] == t:
                            del open_[row]
                        to = step(s, letters[t, row])
                        agrees, walked[t, row], s = (to >> 2) == (walked[t, row] >> 2), to, to >> 2
                        if agrees:
                            row = -1
                            break
                    else:
                        open_.pop(row, None)
                        state[row], row, t = s, after[row], 0
                        if row >= 0 and started[row] == s:
                            break
                        started[row] = s if row >= 0 else started[row]
            # What ended in each piece, and the phrase that a text ends in.
            np.add.at(found[:, k], owner, (walked & 3).sum(axis=0, dtype=np.int64) + (last & (state != 0)))
            out.append(0 if ends[-1] else int(state[place[-1]]))
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float], list[int]]:
        """Language, score, normalised phrases and length in normal characters of each text.

        The score is the runner-up's share of the normalised phrases of the best two: 0.5
        if they tie, 1 with one language only.
        """
        if not self.langs:
            return [UNKNOWN] * len(texts), [0.0] * len(texts), [0.0] * len(texts), [0] * len(texts)
        found, sizes = self.phrases(texts)
        cost = found / np.maximum(sizes, 1)[:, None] / self.rates[None, :]
        best = cost.argmin(axis=1)
        ordered = np.sort(cost, axis=1)
        known = sizes > 0
        score = ordered[:, 1] / np.where(known, ordered[:, :2].sum(axis=1), 1.0) if len(self.langs) > 1 else np.ones(len(texts))
        return [self.langs[b] if k else UNKNOWN for b, k in zip(best, known)], np.where(known, score, 0.0).tolist(), np.where(known, ordered[:, 0], 0.0).tolist(), sizes.tolist()


def _evenly(texts: list[str], most: int) -> str:
    """At most ``most`` characters: the beginnings of all texts, as long as fits."""
    level, left = 0, most
    for k, n in enumerate(sorted(map(len, texts))):
        level = left // (len(texts) - k)
        if n > level:
            break
        left -= n
    return "\n".join(t[: max(1, level)] for t in texts)[:most]


def fit(texts: dict[str, list[str]], sample_chars: int) -> Model:
    """The model of each language's texts."""
    samples, held = {}, {}
    for lang, own in texts.items():
        if len(own) > 1:
            inside, outside = [t for k, t in enumerate(own) if k % 5], [t for k, t in enumerate(own) if k % 5 == 0]
        else:
            cut = (len(own[0]) + 1) // 2
            inside, outside = [own[0][:cut]], [own[0][cut:]]
        samples[lang], held[lang] = _evenly(inside, sample_chars), _evenly(outside, sample_chars // 4)
    model = Model(samples)
    if held:
        found, sizes = model.phrases([held[lang] for lang in model.langs])
        own = np.diagonal(found) / np.maximum(sizes, 1)
        model.rates = np.where(sizes > 0, own, 1.0)
    return model


def train(docs: DataFrame, sample_chars: int = 30_000, all_chars: int = 240_000, sample_docs: int = 200, max_langs: int = 250) -> Model:
    """Fit on at most ``sample_docs`` labelled texts and ``sample_chars`` characters of each language."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    langs = [r["lang"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "lang").limit(max_langs).collect()]
    if not langs:
        return Model({})
    most = min(sample_chars, all_chars // len(langs))
    # The ids first: so texts are neither sorted nor shuffled.  Ranks within parts of a language come before ranks in
    # it, so a language of most rows isn't gathered in one task.
    rows = labelled.where(F.col("lang").isin(langs)).select("lang", "doc_id", F.xxhash64("doc_id").alias("h"))
    rows = rows.distinct().withColumn("part", F.pmod("h", F.lit(64)))
    order = Window.partitionBy("lang").orderBy("h", "doc_id")
    in_part = Window.partitionBy("lang", "part").orderBy("h", "doc_id")
    rows = rows.withColumn("k", F.row_number().over(in_part)).where(F.col("k") <= sample_docs // 8 + 1)
    rank = {(r["lang"], r["doc_id"]): r["k"] for r in rows.withColumn("k", F.row_number().over(order)).where(F.col("k") <= sample_docs).select("lang", "doc_id", "k").collect()}
    ids = sorted({doc_id for _, doc_id in rank if doc_id is not None})
    begun = labelled.where(F.col("lang").isin(langs) & (F.col("doc_id").isin(ids) | F.col("doc_id").isNull()))
    # One bounded text for each language and id: rows may repeat an id.
    taken = begun.groupBy("lang", "doc_id").agg(F.min(F.substring("text", 1, max(200, most // 10))).alias("text"))
    drawn = [(r["lang"], rank[r["lang"], r["doc_id"]], r["text"]) for r in taken.collect() if (r["lang"], r["doc_id"]) in rank]
    texts: dict[str, list[str]] = {}
    for lang, _, text in sorted(drawn):
        texts.setdefault(lang, []).append(text)
    return fit(texts, most)


def identify(docs: DataFrame, model: Model, batch: int = 2048) -> DataFrame:
    """doc_id, lang_pred, score, phrase_rate (normalised phrases) of each document, from its text only."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches):
        own = shared.value
        for record in batches:
            for at in range(0, record.num_rows, batch):
                part = record.slice(at, batch)
                lang, score, rate, _ = own.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rate, pa.float64())], names=["doc_id", "lang_pred", "score", "phrase_rate"])

    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "text").mapInArrow(predict, "doc_id bigint, lang_pred string, score double, phrase_rate double")


def known_rows(docs: DataFrame, model: Model, most_phrases: float, judged: int = 0) -> DataFrame:
    """The rows in a learned language: their text has letters, and at most ``most_phrases`` normalised phrases if it has ``judged`` normal characters or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep():
        def marks(texts):
            lang, _, rate, size = shared.value.predict(texts)
            return [x != UNKNOWN and (n < judged or r <= most_phrases) for x, r, n in zip(lang, rate, size)]

        return marks

    return keep_rows(docs, keep)


def brute_force(sample: str, text: str) -> int:
    """Phrases of a text by searching the sample for each; for tests."""

    def normal(t: str) -> str:
        out = ""
        for c in t.lower():
            if c.isalpha():
                out += c
            elif out and out[-1] != " ":
                out += " "
        return out

    known, rest, phrases = normal(sample), normal(text), 0
    at = 0
    while at < len(rest):
        n = 1
        while at + n < len(rest) and rest[at : at + n + 1] in known:
            n += 1
        at, phrases = at + n, phrases + 1
    return phrases


ship(__name__)

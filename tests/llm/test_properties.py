"""Pure parts against plain versions."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from keyfold.llm import decontaminate, langid, neardup

WORD = st.sampled_from(["a", "b", "c", "dd", "É"])
TEXT = st.lists(WORD, max_size=14).map(" ".join)


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=4), st.lists(TEXT, min_size=1, max_size=4), st.integers(1, 5), st.integers(1, 3))
def test_multi_pattern_search(texts, items, window, most):
    docs, bench = list(enumerate(texts)), list(enumerate(items))
    blocks = list(decontaminate.pattern_blocks(bench, window, most))
    want = decontaminate.brute_force(docs, bench, window)
    for i, text in docs:
        found = [decontaminate.scan(decontaminate.words_of(text), matchers) for matchers in blocks]
        spans, ids = decontaminate.merged([s for spans, _ in found for s in spans]), {x for _, ids in found for x in ids}
        assert (sum(b - a for a, b in spans), sorted(map(str, ids))) == want[i][1:]


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abc", max_size=30), st.text(alphabet="abcd", max_size=12))
def test_automaton_knows_all_factors_and_no_others(sample, probe):
    nexts, state = langid.suffix_automaton([ord(c) for c in sample]), 0
    for c in probe:
        state = nexts[state].get(ord(c), -1) if state >= 0 else -1
    assert (state >= 0) == (probe in sample)
    assert len(nexts) <= max(2, 2 * len(sample))


@settings(max_examples=50, deadline=None)
@given(st.text(alphabet="ab \t\n\u00a0\u00c9", max_size=40))
def test_shingles_are_those_of_ascii_words(text):
    plain = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode().split()
    n = max(0, len(plain) - 4) if len(plain) >= 5 else min(1, len(plain))
    distinct = len({tuple(plain[i : i + min(5, len(plain))]) for i in range(n)})
    assert len(neardup.shingle_set(text)) == distinct


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 2000, dtype=np.uint64)
    other = np.concatenate([base[:1840], rng.integers(0, 1 << 62, 160, dtype=np.uint64)])
    equal = (neardup.signature(np.unique(base)) == neardup.signature(np.unique(other))).sum()
    assert 42 <= equal <= 64


@pytest.mark.parametrize("unit, longer, least", [(True, 1, 0.97), (False, 1, 0.9), (True, 3, 0.95)])
def test_tight_clusters_don_t_trap_the_search(unit, longer, least):
    from keyfold.llm.vectors import Graph

    rng = np.random.default_rng(5)
    spread = rng.normal(size=(1200, 32))
    tight = rng.normal(size=32) + rng.normal(size=(400, 32)) * 0.05
    x = np.concatenate([spread, tight]).astype(np.float32)
    x = x / np.linalg.norm(x, axis=1, keepdims=True) if unit else x
    x[1200:] *= longer
    x = x[rng.permutation(len(x))]
    q = x[::16]
    near = Graph(x).nearest(q)
    best = np.argsort(-(q.astype(np.float64) @ x.T.astype(np.float64)), axis=1, kind="stable")[:, :20]
    assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(best, near)]) >= least


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab0", min_size=1, max_size=4), min_size=1, max_size=8), st.text(alphabet="ab0 -", max_size=12))
def test_one_pattern_for_many_words(words, text):
    import re

    from keyfold.llm.licenses import any_of

    plain = re.search(rf"(?<![a-z0-9])({'|'.join(words)})(?![a-z0-9])", text)
    assert bool(re.search(any_of(words), text)) == bool(plain)

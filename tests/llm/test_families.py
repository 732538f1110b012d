"""Near-dedup of families of edited copies against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from keyfold.llm import neardup


def family(rng, words, copies, most_edits, passage=None, tag=""):
    base = [f"{tag}{rng.randrange(10**6)}" for _ in range(words)]
    for _ in range(copies):
        text = list(base)
        for _ in range(rng.randrange(1, most_edits + 1)):
            at, kind = rng.randrange(len(text)), rng.randrange(3)
            if kind == 0:
                text[at] = f"e{rng.randrange(50)}"
            elif kind == 1:
                del text[at]
            else:
                text.insert(at, f"e{rng.randrange(50)}")
        if passage and rng.random() < 0.3:
            at = rng.randrange(len(text))
            text[at:at] = passage
        if rng.random() < 0.15:
            text = text[: int(len(text) * rng.uniform(0.8, 1))]
        yield " ".join(text)


@pytest.mark.parametrize("seed", [1, 2])
def test_components_are_those_of_all_links(spark, seed):
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(30)]
    texts = []
    for k in range(6):
        texts += family(rng, rng.randrange(30, 160), rng.randrange(10, 60), rng.randrange(1, 6), passage, f"f{k}_")
    # A second version of the first family, and short texts around the passage.
    texts += [t.replace("f0_", "g0_", 12) for t in texts[:25]]
    texts += [" ".join([f"s{rng.randrange(999)}" for _ in range(rng.randrange(12))] + passage) for _ in range(40)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(frame).collect()}
    assert got == neardup.brute_force(rows)
    assert len({c for _, c in got.values()}) < len(rows)


def templated(rng, shared, own, n, groups=1, sub=0, pool=10**9):
    """Pages of a template: words that all share, some of their group, and their own ones."""
    base = [f"s{i}" for i in range(shared)]
    return [" ".join(base + [f"g{i % groups}_{k}" for k in range(sub)] + [f"o{rng.randrange(pool)}" for _ in range(own + rng.randrange(4))]) for i in range(n)]


@pytest.mark.parametrize("seed", [3, 4])
def test_pages_of_templates_match_all_pairs(spark, seed):
    rng = random.Random(seed)
    texts = []
    for k in range(6):
        # From linked ones (few own words) to hopeless ones; small pools make own words repeat.
        part = templated(rng, rng.randrange(40, 90), rng.choice([2, 4, 6, 8, 12, 20]), 45, rng.choice([1, 3]), rng.choice([0, 6, 12]), rng.choice([4, 30, 10**9]))
        texts += [" ".join(f"t{k}{w}" for w in text.split()) for text in part]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == neardup.brute_force(rows)


def test_no_pairs_within_a_hopeless_list(spark):
    """Unlinked pages of one template are judged one by one: what meets grows with the pages, not with their pairs."""
    made = {}
    for n in (300, 1200):
        rows = list(enumerate(templated(random.Random(5), 80, 22, n)))
        docs = spark.createDataFrame(rows, "doc_id bigint, text string")
        nodes = neardup.document_sets(docs).groupBy("node").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.min("sig").alias("sig")).cache()
        lists = neardup.hubbed_lists(neardup.postings(nodes, neardup.token_counters(nodes), 42))
        spokes = lists.where("node <> hub").selectExpr("hub as a", "node as b").distinct()
        known = neardup.confirmed(spokes, nodes, docs, 5, 85)
        around = neardup.around_centres(known.where("near"))
        roots = spark.createDataFrame([], "node binary, root binary")
        made[n] = neardup.near_links(around, roots, 85).count() + neardup.far_pairs(lists, known, roots, 42, 85).count()
        assert known.count() <= 23 * n
    assert made[1200] <= 4 * made[300] + 100


def test_nothing_is_posted_for_what_is_known(spark, monkeypatch):
    """Links with a hub, and within a component, are known: items are posted only where several components share them."""
    rng = random.Random(7)
    posted, plain = [], neardup.written

    def watched(df, name):
        out = plain(df, name)
        posted.extend([out[0].count()] if name == "beyond-centres" else [])
        return out

    monkeypatch.setattr(neardup, "written", watched)
    # One linked family, each copy with a word of its own, and families of three unlinked pages.
    base = [f"a{i}" for i in range(150)]
    texts = [" ".join(base[:at] + [f"e{at}"] + base[at + 1 :]) for at in rng.sample(range(150), 60)]
    for k in range(20):
        texts += [" ".join(f"b{k}{w}" for w in text.split()) for text in templated(rng, 80, 30, 3)]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == neardup.brute_force(rows)
    assert posted == [0]


@pytest.mark.parametrize("wide", [(1, 1), (8, 1 << 18), (256, 100)])
def test_wide_hubs_match_all_pairs(spark, monkeypatch, wide):
    monkeypatch.setattr(neardup, "WIDE", wide)
    rng = random.Random(8)
    texts = [t for k in range(3) for t in family(rng, 90, 40, 5, [f"p{i}" for i in range(30)], f"f{k}_")]
    for k, (shared, own, groups, sub, pool) in enumerate([(60, 6, 3, 6, 30), (80, 8, 3, 12, 4), (50, 4, 1, 0, 30)]):
        texts += [" ".join(f"t{k}{w}" for w in text.split()) for text in templated(rng, shared, own, 40, groups, sub, pool)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == neardup.brute_force(rows)


def test_many_repeats_of_a_row(spark):
    texts = templated(random.Random(6), 90, 1, 2)
    rows = [(k % 2, texts[k % 2]) for k in range(2000)] + [(7, texts[0]), (0, "another text with the same number")]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert {(r["doc_id"], r["n_shingles"], r["component_id"], r["count"]) for r in got.groupBy("doc_id", "n_shingles", "component_id").count().collect()} == {
        (0, len(neardup.shingle_set(texts[0])), 0, 1000), (1, len(neardup.shingle_set(texts[1])), 0, 1000), (7, len(neardup.shingle_set(texts[0])), 0, 1), (0, 2, 0, 1)}

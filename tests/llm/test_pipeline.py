"""The pipeline against a plain version of it."""

import hashlib
import re

import corpus_pipeline as cp
from keyfold.llm import decontaminate, langid, neardup


def plain_mix(rows):
    """doc_id to copies: weights 5, 2, 1 by source, 150 % of all words, at most twice each source."""
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for i, r in rows.items()}
    order = sorted({r["source"] for r in rows.values()}, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total = {s: sum(size[i] for i, r in rows.items() if r["source"] == s) for s in order}
    left, open_, target = 1.5 * sum(total.values()), set(order), {}
    while open_:
        w = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / w > 2 * total[s]}
        target |= {s: 2 * total[s] for s in over} if over else {s: left * weight[s] / w for s in open_}
        left -= sum(2 * total[s] for s in over)
        open_ = open_ - over if over else set()
    copies = {}
    for s in order:
        own = sorted((hashlib.md5(str(i).encode()).hexdigest()[:9], i) for i, r in rows.items() if r["source"] == s)
        whole = int(target[s] // total[s]) if total[s] else 0
        budget, so_far = target[s] - whole * total[s], 0
        for _, i in own:
            copies[i] = whole + (so_far + size[i] / 2 <= budget)
            so_far += size[i]
    return copies


def in_a_language(model, text):
    """By plain searches in the model's samples."""
    normal = re.sub(r"[\W\d_]+", " ", (text or "").lower()).lstrip(" ")
    if not normal:
        return False
    return len(normal) < cp.JUDGED or any(langid.brute_force(model.samples[x], text) / len(normal) / rate <= cp.MOST_PHRASES for x, rate in zip(model.langs, model.rates))


def test_pipeline_matches_a_plain_version(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    rows = {r["doc_id"]: r.asDict() for r in docs.collect()}
    model = langid.train(docs)
    assert model.langs == ["de", "en", "es", "fr"]
    rows = {i: r for i, r in rows.items() if in_a_language(model, r["text"])}
    holders: dict = {}
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    for i, r in rows.items():
        for line in (r["text"] or "").split("\n"):
            holders.setdefault(key(line), set()).add(i)
    for i, r in rows.items():
        lines = (r["text"] or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 40 or len(holders[key(x)]) < 5 or i == max(holders[key(x)])]
        if len(kept) < len(lines):
            r["text"] = "\n".join(kept)
            r["n_chars"] = len(r["text"])
    found = neardup.brute_force([(i, r["text"]) for i, r in rows.items()])
    rows = {i: r for i, r in rows.items() if found[i][1] == i}
    items = [tuple(x) for x in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    hit = decontaminate.brute_force([(i, r["text"]) for i, r in rows.items()], items)
    rows = {i: r for i, r in rows.items() if not hit[i][1]}
    copies = plain_mix(rows)
    want = {i: (r["text"], r["n_chars"], copies[i]) for i, r in rows.items() if copies[i]}
    got = cp.run(spark, sf)
    assert got.columns == [*columns, "copies"]
    assert {r["doc_id"]: (r["text"], r["n_chars"], r["copies"]) for r in got.collect()} == want


def test_stages_take_an_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("false")
    for name, stage in cp.STAGES:
        assert stage(spark, docs, sf).count() == 0, name

"""Ranked search against scoring every document."""

import math
import re

import numpy as np
import pytest

from judgeloom.llm import search
from judgeloom.llm.common import written

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return PATTERN.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=10):
    """Every document scored for every item."""
    held = [(d, terms(t)) for d, t in docs]
    held = [(d, w) for d, w in held if w]
    n, length = len(held), sum(len(w) for _, w in held)
    df = {}
    for _, w in held:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for i, text in items:
        own = [t for t in dict.fromkeys(terms(text)) if t in df]
        scores = []
        for d, w in held:
            m = 10 + (90 * len(w) * n) // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * w.count(t)) // (1000 * w.count(t) + 8 * m)) for t in own if t in w)
            if s > 0:
                scores.append((-s, d is not None, d or 0))
        out += [(i, r + 1, d if known else None, -s) for r, (s, known, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def found(spark, docs, items, most=search.MOST, terms_at_once=search.TERMS):
    d = spark.createDataFrame([(*x, "clash") for x in docs], "doc_id long, text string, item_id string").repartition(3)
    q = spark.createDataFrame([(*x, "clash") for x in items], "item_id long, text string, doc_id string")
    documents, length = search.sizes(d)
    segments = written(search.index(d, documents, length, most=most), "segments")
    got = search.search(segments, documents, q, most=terms_at_once)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got.collect()), key=str), segments


def corpus(seed, n):
    rng = np.random.RandomState(seed)
    vocabulary = [f"w{int(x)}" for x in range(400)]
    zipf = 1 / np.arange(1, 401)
    return [(i, " ".join(rng.choice(vocabulary, rng.randint(1, 60), p=zipf / zipf.sum()))) for i in range(n)]


@pytest.mark.parametrize("most,at_once", [(search.MOST, search.TERMS), (2000, 20)])
def test_against_every_document(spark, most, at_once):
    docs = corpus(1, 900)
    items = [(i, t) for i, t in corpus(2, 12)] + [(100, "W1 w1, W2?"), (101, "w399"), (102, "unknown words alone"), (103, None), (104, "")]
    got, segments = found(spark, docs, items, most, at_once)
    assert got == plain(docs, items)
    assert segments.select("segment").distinct().count() == 3 if most == search.MOST else segments.select("segment").distinct().count() > 6


def test_odd_texts_ties_copies_and_long_ones(spark):
    docs = [
        (1, "Émile ÉMILE straße_x x-ray 12.5kg"), (2, None), (3, ""), (4, "!!! ???"), (5, "same text here"), (5, "same text here"), (3000, "same text here"), (None, "same text here"), (-7, "same text here"),
        (8, "long " * 70_000 + "needle"), (9, "needle and same"), (10, "漢字 and 𝒳 emoji😀here"), (11, "a\x00b c\x7fd"),
    ]
    items = [(1, "émile"), (2, "ÉMILE straße"), (3, "same"), (4, "needle LONG"), (5, "漢字 emoji😀here 12 5kg"), (5, "x ray"), (6, "b c d a"), (7, "same text here needle")]
    assert found(spark, docs, items)[0] == plain(docs, items)
    many = [(i, "one two" if i % 2 else "two") for i in range(400)]
    assert found(spark, many, [(1, "one"), (2, "two")])[0] == plain(many, [(1, "one"), (2, "two")])


def test_blocks_round_trip_and_bound_their_impacts():
    rng = np.random.RandomState(3)
    lists = [np.sort(rng.choice(1 << 20, n, replace=False)) for n in (1, 127, 128, 129, 1000)]
    term = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    doc, tf = np.concatenate(lists), np.concatenate([rng.choice([1, 2, 300, 70_000], len(x)) for x in lists])
    gain = search.impact(tf.astype(np.int64), np.full(len(tf), 50))
    made = search.blocks(term, doc, tf.astype(np.int64), gain)
    for k, want in enumerate(lists):
        a, b = made["lists"][k : k + 2]
        data = made["data"][made["bytes"][k] : made["bytes"][k + 1]]
        held = search.Postings(made["last"][a:b].tolist(), made["most"][a:b].tolist(), made["end"][a:b].tolist(), data.tobytes(), np.full(1 << 20, 50))
        docs, gains = zip(*(held.block(x) for x in range(b - a)), strict=True)
        assert np.concatenate(docs).tolist() == want.tolist() and np.concatenate(gains).tolist() == gain[term == k].tolist()
        assert all(len(d) <= search.BLOCK for d in docs) and [g.max() for g in gains] == made["most"][a:b].tolist()
    assert len(made["data"]) < 8 * len(doc)


def test_blocks_below_the_threshold_stay_closed():
    """A list whose blocks can't reach the threshold isn't decompressed."""
    n, norms = 128 * 50, np.full(128 * 50, 100)
    tf = np.ones(n, np.int64)
    tf[:10] = 40
    made = search.blocks(np.zeros(n, np.int64), np.arange(n), tf, search.impact(tf, norms))
    held = search.Postings(made["last"].tolist(), made["most"].tolist(), made["end"].tolist(), made["data"].tobytes(), norms)
    best = []
    search.best_of([(held, 1000)], n, 0, best, list(range(n)), 10)
    assert sorted(-i for _, _, i in best) == list(range(10)) and len(held.open) < 10


def test_no_rows(spark):
    assert found(spark, [], [(1, "x")])[0] == [] and found(spark, [(1, "x"), (2, None)], [])[0] == [] and found(spark, [(1, None)], [(1, "x")])[0] == []

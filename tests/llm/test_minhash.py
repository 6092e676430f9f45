from collections import Counter

import numpy as np
import pytest

from judgeloom.llm import minhash


def words(seed, n=60):
    return [f"w{x}" for x in np.random.RandomState(seed).randint(0, 5000, n)]


def test_registers_agree_as_often_as_probability_jaccard():
    draw = np.random.RandomState(1)
    a = (np.sort(draw.randint(1, 2**62, 300).astype(np.uint64)), draw.randint(1, 9, 300))
    keep = draw.rand(300) < 0.8
    b = (np.sort(np.concatenate([a[0][keep], draw.randint(1, 2**62, 60).astype(np.uint64)])), draw.randint(1, 9, keep.sum() + 60))
    wa, wb = dict(zip(*map(list, a))), dict(zip(*map(list, b)))
    exact = sum(1 / sum(max(wa.get(d, 0) / wa[s], wb.get(d, 0) / wb[s]) for d in wa.keys() | wb.keys()) for s in wa.keys() & wb.keys())
    assert np.isclose(minhash.similarity(a, b), exact)
    hits = []
    for salt in range(60):
        move = lambda x: minhash.mix(x ^ np.uint64(salt * 7919))
        one, two = minhash.signatures([(move(a[0]), a[1]), (move(b[0]), b[1])])
        hits.append((one == two).mean())
    assert abs(np.mean(hits) - exact) < 0.02


def test_sketches_agree_as_registers_do(spark):
    draw = np.random.RandomState(2)
    a = draw.randint(1, 2**62, (1, minhash.REGISTERS)).astype(np.uint64)
    b = np.where(draw.rand(*a.shape) < 0.7, a, draw.randint(1, 2**62, a.shape).astype(np.uint64))
    four = lambda x: minhash.mix(x ^ minhash._C3) >> np.uint64(60)
    rows = [dict(zip([f"s{k}" for k in range(minhash.SKETCH)], minhash.sketches(x)[0].tolist())) for x in (a, b)]
    x, y = (spark.createDataFrame([r]) for r in rows)
    got = x.alias("x").crossJoin(y.alias("y")).select(minhash._agreeing("x", "y").alias("n")).first()["n"]
    assert got == int((four(a) == four(b)).sum())


def test_small_and_large_documents_sign_alone_and_together():
    docs = [minhash.shingles(t) for t in ["one", "", "two words", " ".join(words(1, 3000)), "a a a a a a a a a"]]
    together = minhash.signatures(docs)
    for d, row in zip(docs, together, strict=True):
        assert (minhash.signatures([d])[0] == row).all() and ((row != 0).all() or not len(d[0]))


def brute(rows):
    """Classes by comparing every pair."""
    cut = [None if t is None else minhash.shingles(t) for _, t in rows]
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if cut[i] is not None and cut[j] is not None and (rows[i][1] == rows[j][1] or minhash.similarity(cut[i], cut[j]) >= minhash.THRESHOLD):
                a, b = sorted((find(i), find(j)))
                group[b] = a
    return {d: min(rows[k][0] for k in range(len(rows)) if find(k) == find(i)) for i, (d, _) in enumerate(rows)}


@pytest.fixture(scope="module")
def rows():
    out, draw = [], np.random.RandomState(5)
    for base in range(6):
        w = words(base, 80)
        for _ in range(12):  # drifting copies: neighbours are alike, the ends are not
            w = list(w)
            w[draw.randint(len(w))] = f"n{draw.randint(10**6)}"
            out.append(" ".join(w))
    out += [" ".join(words(100 + i)) for i in range(40)] + ["short one", "Short, one!", "", "", "...", "!!!", None, None, "x " * 3000, "x " * 3000 + "y"]
    out += [out[3]] * 20 + [out[80]] * 3
    return list(enumerate(out))


def test_classes_equal_brute_force(spark, rows):
    docs = spark.createDataFrame([(*r, b"clash") for r in rows], "doc_id long, text string, node binary")
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs).collect()}
    assert got == brute(rows)
    kept = minhash.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(got.values()))


def test_repeated_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "other words here now then"), (None, "other words here now then"), (2, None)], "doc_id long, text string")
    assert Counter((r["doc_id"], r["class_id"]) for r in minhash.near_duplicates(docs).collect()) == Counter({(1, 1): 2, (None, None): 2, (2, 2): 1})
    assert minhash.deduplicated(docs).count() == 3


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(docs).count() == 0 and minhash.deduplicated(docs).count() == 0


def test_differences_lose_no_pair(spark, monkeypatch):
    """Every pair of THRESHOLD or more in a cell shares an early element or is close; far pairs mostly don't meet."""
    draw, cut = np.random.RandomState(9), []
    base = draw.randint(1, 2**62, 90)
    for k in range(120):
        h = base.copy()
        # runs of replaced shingles as edits of words make them, some texts with repeated shingles, some longer or shorter
        for at in draw.randint(0, 90, draw.randint(0, 6)):
            h[at : at + 5] = draw.randint(1, 2**62, len(h[at : at + 5]))
        h = np.unique(np.concatenate([h[draw.randint(0, 12) :], draw.randint(1, 2**62, draw.choice([0, 0, 4, 12]))]))
        c = draw.randint(1, 4, len(h)) if k % 3 == 0 else np.ones(len(h), int)
        cut.append((h.astype(np.uint64), c.astype(np.int64)))
    cut += [(cut[3][0], cut[3][1] * 2), (cut[5][0][:-1], cut[5][1][:-1])]
    names = [k.to_bytes(16, "big") for k in range(len(cut))]
    open_ = spark.createDataFrame([(1, n, n) for n in names], "bucket long, node binary, label binary")
    table = spark.createDataFrame([(n, h.view(np.int64).tolist(), c.tolist()) for n, (h, c) in zip(names, cut, strict=True)], "node binary, hashes array<long>, counts array<int>")
    alike = spark.createDataFrame([(n, *[0] * minhash.SKETCH) for n in names], "node binary, " + ", ".join(f"s{k} long" for k in range(minhash.SKETCH)))
    apart = minhash._differences(open_, table)
    pair = lambda r: (int.from_bytes(r["a"], "big"), int.from_bytes(r["b"], "big"))
    sharing, close = ({pair(r) for r in x.collect()} for x in (minhash._sharing(apart), minhash._close(apart, alike)))
    want = {(i, j) for i in range(len(cut)) for j in range(i + 1, len(cut)) if minhash.similarity(cut[i], cut[j]) >= minhash.THRESHOLD}
    assert len(want) > 100 and want <= sharing | close
    assert len(sharing | close) < len(cut) * (len(cut) - 1) / 2 * 0.8


def test_a_hot_group_of_far_copies_makes_few_pairs(spark):
    """Copies with many own edits: all share buckets, few are alike, and the classes are those of brute force."""
    draw, base, out = np.random.RandomState(11), words(77, 120), []
    for k in range(150):
        w = list(base)
        for at in draw.choice(120, 1 + k % 4, replace=False):
            w[at] = f"n{draw.randint(10**6)}"
        out.append((k, " ".join(w)))
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(spark.createDataFrame(out, "doc_id long, text string")).collect()}
    assert got == brute(out)

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from public_tokenizers import path

from judgeloom.llm import lmscore

WHERE = path(lmscore.VOCABULARY)


def all_ways(model, word):
    """Probability of a word by listing every segmentation into pieces and spelled characters."""
    text = lmscore.MARK + word

    def rest(i):
        if i == len(text):
            return 1.0
        p = math.exp(sum(model.bytes[b] for b in text[i].encode())) * rest(i + 1)
        for j in range(i + 1, len(text) + 1):
            k = model.index.get(text[i:j])
            if k is not None:
                p += math.exp(model.logp[k]) * rest(j)
        return p

    return math.log(rest(0))


def test_forward_equals_all_segmentations():
    names, logp, byte_logp = lmscore.pieces(WHERE)
    model = lmscore.Lattice(names, logp, byte_logp)
    words = ["the", "there", "", "a", "zürich", "日本", "x\U0001f600y", "thntaten", "reed***"]
    got = model.forward(words)
    for w, g in zip(words, got, strict=True):
        assert math.isclose(g, all_ways(model, w), rel_tol=1e-9), w
        assert math.isclose(model._alone(w), g, rel_tol=1e-9)
    long = "the" * 2000
    assert math.isfinite(model.forward([long])[0]) and model.forward([long])[0] < model.forward(["the" * 5])[0]


def test_em_raises_the_likelihood():
    words, counts = ["there", "thing", "ering", "tion"], np.array([50.0, 30, 20, 10])
    names, logp, byte_logp = lmscore.pieces(WHERE)
    before = lmscore.Lattice(names, logp, byte_logp)
    after, end = lmscore.fitted(WHERE, words, counts, 5)
    assert (counts * after.forward(words)).sum() > (counts * before.forward(words)).sum()
    total = np.exp(after.logp).sum() + np.exp(after.bytes).sum() + math.exp(end)
    assert math.isclose(total, 1, rel_tol=1e-6)


@pytest.mark.parametrize("head", [3, 65_536])
def test_scores_against_counting(spark, monkeypatch, head):
    monkeypatch.setattr(lmscore, "HEAD", head)
    rows = [(i, f"The cat{i % 5} SAT on\tthe\nmat {'x' * (i % 4)} Ünter einem") for i in range(60)]
    rows += [(100, None), (101, ""), (102, "▁odd ▁"), (103, "w" * 3000), (103, "w" * 3000), (None, "the null id")]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double")
    got = lmscore.score(docs, WHERE).collect()
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    toks = lambda t: [*(t or "").encode().lower().split(), None]
    c = Counter(w for d, t in rows if not held(d) for w in toks(t))
    n, v = sum(c.values()), len(c)
    want = sorted((-1 if d is None else d, held(d), len(toks(t)), sum(c[w] > 0 for w in toks(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in toks(t)), 6)) for d, t in rows)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    same = {r["score"] for r in got if r["doc_id"] in (0, 20, 40)}
    assert len({round(s, 9) for s in same}) == 1


def test_every_word_teaches_the_pieces(spark, monkeypatch):
    """The model is that of a plain EM over all training words, long ones too, whatever is shipped."""
    rows = [(i, f"there thing rare{i} {'tion' * (i % 9 + 3)} od▁d") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [t for d, t in rows if zlib.crc32(str(d).encode()) % 7 != 2]
    c = Counter(w for t in kept for w in t.split())
    model, end = lmscore.fitted(WHERE, list(c), np.array([float(n) for n in c.values()]), len(kept))
    want = {d: (model.forward(t.split()).sum() + end) / math.log(10) for d, t in rows}
    for head in (0, 3, 65_536):
        monkeypatch.setattr(lmscore, "HEAD", head)
        got = {r["doc_id"]: r["score"] for r in lmscore.score(docs, WHERE).collect()}
        assert all(math.isclose(got[d], want[d], rel_tol=1e-9) for d in want), head


def test_long_words_count_as_short_ones_do(monkeypatch):
    names, logp, byte_logp = lmscore.pieces(WHERE)
    model = lmscore.Lattice(names, logp, byte_logp)
    words, counts = ["there", "x😀y", "tion" * 8, "", "ü" * 30], np.array([5.0, 2, 3, 1, 4])
    alone = np.zeros(len(names))
    spelled = sum(model._expected_alone(w, n, alone) for w, n in zip(words, counts, strict=True))
    got = model.expected(words, counts)
    monkeypatch.setattr(lmscore, "WIDE", 100)
    want = model.expected(words, counts)
    for uses, bytes_ in ((alone, spelled), got):
        assert np.allclose(uses, want[0], rtol=1e-9, atol=1e-12) and math.isclose(bytes_, want[1], rel_tol=1e-9)
    once = model.expected(["tion" * 8], np.array([1.0]))
    assert once[0].sum() + once[1] > 1


def test_no_rows(spark):
    assert lmscore.score(spark.createDataFrame([], "doc_id long, text string"), WHERE).count() == 0


def test_the_vocabulary_alone_or_fitted(spark):
    """Without rounds the vocabulary's own scores weight the segmentations; a large weight keeps near them; fitting raises the likelihood of held-out texts."""
    rng = np.random.RandomState(4)
    words = [f"{a}{b}" for a in ("thero", "ansha", "ingle", "ertio") for b in ("n", "ts", "ble", "ou")]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(words, 30))) for i in range(300)], "doc_id long, text string")
    total = lambda **form: {r["held_out"]: r["s"] for r in lmscore.score(docs, WHERE, **form).groupBy("held_out").agg({"score": "sum"}).withColumnRenamed("sum(score)", "s").collect()}
    alone, heavy, fitted = total(rounds=0), total(weight=1000.0), total()
    names, logp, byte_logp = lmscore.pieces(WHERE)
    model = lmscore.Lattice(names, logp + math.log(0.99), byte_logp + math.log(0.99))
    text = docs.where("doc_id = 0").first()["text"].split()
    one = {r["doc_id"]: r["score"] for r in lmscore.score(docs, WHERE, rounds=0).where("doc_id = 0").collect()}[0]
    assert one == pytest.approx((sum(all_ways(model, w) for w in text) + math.log(0.01)) / math.log(10), rel=1e-9)
    assert fitted[True] > heavy[True] and fitted[False] > heavy[False] and abs(heavy[True] - alone[True]) < 0.05 * abs(alone[True])

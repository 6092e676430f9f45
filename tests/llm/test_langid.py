import numpy as np
import pytest

from judgeloom.llm import langid

WORDS = {"en": "the of and that with this from", "fr": "le de et que avec cette dans", "de": "der und ist nicht mit diese auf"}


def rows(n=300):
    draw = np.random.RandomState(3)
    return [(i, " ".join(draw.choice(WORDS[lang].split(), 12)), lang, "clash") for i in range(n) for lang in [list(WORDS)[i % 3]]]


def test_held_out_accuracy_and_edge_cases(spark):
    odd = [(1000, None, "en", "x"), (1001, "", "en", "x"), (1002, "12 + 3!", "en", "x"), (1003, "the of and " * 60_000, None, "x"), (1003, "the of and " * 60_000, None, "x"), (None, "le de et que", "fr", "x")]
    docs = spark.createDataFrame(rows() + odd, "doc_id long, text string, lang string, score string")
    model = langid.train(docs)
    got = langid.identify(docs, model).collect()
    assert len(got) == len(rows()) + len(odd)
    by = {r["doc_id"]: r for r in got}
    want = {r[0]: r[2] for r in rows()}
    held = [d for d in want if by[d]["held_out"]]
    assert len(held) > 30 and np.mean([by[d]["lang_pred"] == want[d] for d in held]) > 0.98
    assert all(by[d]["lang_pred"] == "und" and by[d]["score"] == 0 for d in (1000, 1001, 1002))
    assert by[1003]["lang_pred"] == "en" and by[None]["lang_pred"] == "fr" and 0 < by[1003]["score"] <= 1
    kept = langid.keep_identified(docs, model)
    assert kept.columns == docs.columns and kept.count() == len(got) - 3


def test_prediction_equals_tfidf_by_hand():
    codes, _ = langid.codes_of("Das ist, 7 gut")
    ids, n = langid.counts(codes)
    weights = np.random.RandomState(0).rand(langid.BUCKETS, 3).astype(np.float32)
    assert np.allclose(langid.scores(codes, weights), (n[:, None] / n.sum() * weights[ids]).sum(axis=0))
    whole = langid.scores(codes, weights)
    langid.SLICE, was = 4, langid.SLICE
    assert np.allclose(langid.scores(codes, weights), whole)
    langid.SLICE = was


@pytest.mark.parametrize("lang", [None, "en"])
def test_nothing_to_learn(spark, lang):
    docs = spark.createDataFrame([(5, "text", lang)] * 2 if lang is None else [], "doc_id long, text string, lang string")
    assert all(r["lang_pred"] == "und" for r in langid.identify(docs, langid.train(docs)).collect())


@pytest.mark.parametrize("doc_id", range(1, 9))
def test_rows_of_one_id(spark, doc_id):
    docs = spark.createDataFrame([(doc_id, "the of and that with this", "en")] * 3000 + [(doc_id, "le de et que avec cette", "fr")] * 30, "doc_id long, text string, lang string")
    got = langid.identify(docs, langid.train(docs)).groupBy("held_out", "lang_pred").count().collect()
    assert {(r["lang_pred"], r["count"]) for r in got} == ({("und", 3030)} if got[0]["held_out"] else {("en", 3000), ("fr", 30)})


def test_many_languages_and_labels_without_letters(spark):
    docs = spark.createDataFrame([(k, chr(0x4E00 + k % 100) * 3, f"l{k % 100:02d}") for k in range(2000)], "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert len(model.languages) == 100
    assert np.mean([model.predict(chr(0x4E00 + k) * 3)[0] == f"l{k:02d}" for k in range(100)]) > 0.9
    bare = spark.createDataFrame([(k, "12 34", "en" if k < 30 else "fr") for k in range(40)], "doc_id long, text string, lang string")
    assert langid.train(bare).predict("a word")[0] == "en"


def test_training_equals_a_plain_loop():
    """FTRL-proximal and the temperature against their definitions, coordinate by coordinate."""
    draw = np.random.RandomState(4)
    examples = [(np.unique(draw.randint(0, 12, 4)), None, int(draw.randint(3))) for _ in range(25)]
    examples = [(ids, draw.rand(len(ids)), y) for ids, _, y in examples]
    z, n = np.zeros((langid.BUCKETS + 1, 3)), np.zeros((langid.BUCKETS + 1, 3))

    def weight(i, c):
        if abs(z[i, c]) <= langid.L1:
            return 0.0
        return -(z[i, c] - np.sign(z[i, c]) * langid.L1) / ((langid.BETA + np.sqrt(n[i, c])) / langid.ALPHA + langid.L2)

    order = np.random.RandomState(11)
    for _ in range(langid.EPOCHS):
        for k in order.permutation(len(examples)):
            ids, x, y = examples[k]
            w = {(i, c): weight(i, c) for i in ids for c in range(3)}
            p = np.exp([sum(v * w[i, c] for i, v in zip(ids, x, strict=True)) for c in range(3)])
            p /= p.sum()
            for i, v in zip(ids, x, strict=True):
                for c in range(3):
                    g = v * (p[c] - (c == y))
                    z[i, c] += g - (np.sqrt(n[i, c] + g * g) - np.sqrt(n[i, c])) / langid.ALPHA * w[i, c]
                    n[i, c] += g * g
    got = langid.ftrl(examples, 3)
    assert np.allclose(got[:12], [[weight(i, c) for c in range(3)] for i in range(12)]) and not got[12:].any()
    logits, y = draw.randn(50, 3) * 4, draw.randint(0, 3, 50)
    loss = lambda t: -np.mean([np.log(np.exp(a[b] / t) / np.exp(a / t).sum()) for a, b in zip(logits, y, strict=True)])
    best = langid.temperature(logits, y)
    assert all(loss(best) <= loss(t) + 1e-9 for t in np.exp(np.linspace(np.log(0.2), np.log(5), 65)))

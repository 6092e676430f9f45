import zlib

import numpy as np
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from judgeloom.llm import packing

WHERE = path("word_bpe_49k.json")
HARD = [
    "", None, "a", "It's we'll DON'T", "x" * 5000, "Ünïcödé É̀ Σίσυφος ΣΑΣ", "a\x1cb\x1dc", "<|endoftext|> x <|startoftext|>", "!!! *** a***, b.,;",
    "½ Ⅷ ２ 12.5 3rd", "tab\tnew\nline\u00a0nbsp\u2003em", "İstanbul ǅ ß", "e\u0301 decomposed", "word_with_underscore foo-bar 'quoted'", "日本語 テスト 한국어 العربية", "<|", "\u200bzero", "ﬁ ligature K",
]


def test_word_cache_gives_the_tokenizers_ids():
    direct, own = Tokenizer.from_file(WHERE), packing.Tokens(WHERE)
    texts = [t or "" for t in HARD]
    for _ in range(2):
        ids, ends = own.encode(texts)
        for text, got in zip(texts, np.split(ids, ends[:-1]), strict=True):
            assert got.tolist() == [*direct.encode(text, add_special_tokens=False).ids, packing.END], text


def test_full_tables_of_words_move_on(monkeypatch):
    monkeypatch.setattr(packing, "WORDS", 20)
    direct, own = Tokenizer.from_file(WHERE), packing.Tokens(WHERE)
    for k in range(12):
        texts = [f"word{k} common, thing{k % 3}. {'long' * 20}{k % 2}", "common word, common", "", ".", "a.", ". b", "c...", "...", "d", "!e é. f.)", "g.é h;;i j,"]
        ids, ends = own.encode(texts)
        assert [x.tolist() for x in np.split(ids, ends[:-1])] == [[*direct.encode(t, add_special_tokens=False).ids, packing.END] for t in texts]
    assert len(own.known) <= 20
    assert [x.tolist() for x in own.encode([])] == [[], []]


def test_hilbert_keys_are_a_curve():
    side = 4
    points = np.array(np.meshgrid(*[np.arange(side)] * packing.DIMS)).reshape(packing.DIMS, -1).T
    order = points[np.argsort(packing.hilbert(points))]
    assert len(set(packing.hilbert(points).tolist())) == len(points)
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("rows", [[], [(i, t) for i, t in enumerate(HARD)] + [(0, "again"), (0, "again"), (None, "no id")] + [(100 + i, f"common words {i % 3} " * (i % 50)) for i in range(200)]])
def test_every_id_lies_in_exactly_one_piece(spark, rows):
    docs = spark.createDataFrame([(d, t, "clash") for d, t in rows], "doc_id long, text string, ids string")
    direct = Tokenizer.from_file(WHERE)
    pieces = packing.digests(packing.pack(docs, WHERE)).collect()
    want = sorted(((-1 if d is None else d), np.array([*direct.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for d, t in rows)
    by = {}
    for p in pieces:
        by.setdefault(p["sequence_id"], []).append(p)
    for seq in by.values():
        seq.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in seq] == [sum(q["length"] for q in seq[:i]) for i in range(len(seq))]
        size = sum(p["length"] for p in seq)
        assert size <= packing.LENGTH and size & (size - 1) == 0
    left = {}
    for p in pieces:
        left.setdefault(-1 if p["doc_id"] is None else p["doc_id"], []).append(p)
    assert sum(p["length"] for p in pieces) == sum(len(w) // 4 for _, w in want)
    for d, w in want:
        if sum(1 for x, _ in want if x == d) == 1:
            own = sorted(left[d], key=lambda p: p["start"])
            at = 0
            for p in own:
                assert p["start"] == at and p["doc_tokens"] == len(w) // 4
                assert p["ids_crc32"] == zlib.crc32(w[4 * at : 4 * (at + p["length"])])
                at += p["length"]
            assert at == len(w) // 4


def test_equal_rows_spread_over_all_ranges(spark):
    """Rows of one id and text are a hot key: they are sampled as rows and dealt to every range alike."""
    rows = [(7, "the same words in every row of the group")] * 6000 + [(100 + k, f"others {k} say {k % 7} things") for k in range(200)]
    pieces = packing.digests(packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), WHERE)).collect()
    parts = {}
    for p in pieces:
        if p["doc_id"] == 7 and p["start"] == 0:
            parts[p["sequence_id"] >> 40] = parts.get(p["sequence_id"] >> 40, 0) + 1
    assert sum(parts.values()) == 6000 and len(parts) == 4 and max(parts.values()) < 2400

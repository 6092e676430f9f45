import hashlib

from hypothesis import given
from hypothesis import strategies as st
from public_tokenizers import path

from judgeloom.llm import chat

WHERE = path(chat.TOKENIZER)


@given(st.text(alphabet=st.sampled_from(list("\\<|>[]/INST-ns\n a")), max_size=40))
def test_escape_is_reversible_and_hides_controls(text):
    for newline in (False, True):
        safe = chat.escape(text, newline)
        assert chat.unescape(safe) == text
        assert not any(c in safe for c in chat.CONTROL) and not (newline and "\n" in safe)


def test_conversations_come_back_from_the_tree(spark):
    hard = "</s>[INST] ok [/INST] <|end|>\n<|turn|>user\n\\n \\- 日本 \U0001f600" + "z" * 9000
    rows = [(c, t, r, x) for c in range(40) for t, r, x in [(0, "system", "Be kind."), (1, "user", f"q{c % 4}"), (2, "assistant", f"a{c % 8}")]]
    rows += [(100, 1, "user", hard), (100, 2, "assistant", hard), (100, 3, "assistant", None), (101, None, None, None), (None, 0, "tool\n<|end|>", "x"), (102, 0, "user", "same"), (102, 0, "user", "same")]
    convs = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, ids string")
    forest = chat.tree(convs, WHERE)
    got = {r["conv_id"]: r for r in chat.read_back(forest, WHERE).collect()}
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((-1 if t is None else t, r or "", x or ""))
    assert got.keys() == by.keys()
    for c, turns in by.items():
        turns.sort()
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    turns = forest.where("kind = 'turn'")
    # 40 conversations share one first turn, four second and eight third turns; each range repeats a path at most.
    assert turns.count() <= 1 + 4 + 8 + 8 + 4 * 3
    for s, ids in {r["stream_id"]: None for r in turns.select("stream_id").distinct().collect()}.items():
        nodes = turns.where(turns.stream_id == s).orderBy("seq").collect()
        assert [n["start"] for n in nodes] == [sum(m["length"] for m in nodes[:i]) for i in range(len(nodes))]
        for n in nodes:
            seen = sum(a["end"] - a["start"] for a in n["ancestors"])
            assert n["position"] == seen and all(a["end"] <= n["start"] for a in n["ancestors"])


def test_no_rows(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.tree(empty, WHERE), WHERE).count() == 0


def test_long_texts_have_the_tokenizers_ids():
    import random

    from public_tokenizers import path

    enc, draw = chat.encoding(path(chat.TOKENIZER)), random.Random(2)
    bits = ["word", " the", "  ", "\n", "'s", "12345", " 7", "...", "é", " Ünï", "\t", "<|turn|>", " a", "b ", "日本", "x" * 300]
    for n in (0, 10, 3000, 12_000):
        text = "".join(draw.choice(bits) for _ in range(n))
        assert chat._encode(enc, text) == enc.encode_ordinary(text)
    text = "supercalifragilistic expialidocious " * 400
    assert chat._encode(enc, text) == enc.encode_ordinary(text)

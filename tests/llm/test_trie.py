"""The trie of conversations against a plain one."""

import hashlib
import re
import zlib

import numpy as np

from judgeloom.llm import trie


def plain(seqs):
    """seqs: conv_id -> list of (role, text)."""
    members = {}
    for c, turns in seqs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    children, leaves, saved = {}, {}, {}
    for path in sorted(members, key=len, reverse=True):
        kids = children.get(path, [])
        leaves[path] = sum(leaves[k] for k in kids) or 1
        saved[path] = sum(saved[k] for k in kids) + ((len(members[path]) - 1) * words(path[-1][1]) if path else 0)
        if path:
            children.setdefault(path[:-1], []).append(path)
    sha = lambda path: hashlib.sha256(",".join(str(c) for c in sorted(c for c in members[path] if len(seqs[c]) == len(path))).encode()).hexdigest()
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children.get(p, [])), leaves[p], saved[p], sha(p)) for p, m in members.items()), key=str)


def rows_of(seqs):
    return [(c, k, r, t, "clash") for c, turns in seqs.items() for k, (r, t) in enumerate(turns)]


def table(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, depth string").repartition(3)


def found(df):
    return sorted(((r["conv_id"], r["depth"], r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in df.collect()), key=str)


def test_branches_copies_prefixes_and_long_chains(spark):
    rng = np.random.RandomState(5)
    said = lambda k: ("user" if k % 2 else "assistant", f"turn {k} of  words\tand more" * (k % 3))
    long = [said(k) for k in range(300)]
    seqs = {i: [said(int(x)) for x in rng.randint(0, 3, rng.randint(1, 6))] for i in range(200)}
    seqs |= {1000 + i: list(long) for i in range(40)} | {2000: long[:120], 2001: [*long[:120], ("user", "else")], 2002: long[:299], -5: long[:1], 3000: [("user", "alone")] * 50}
    assert found(trie.trie(trie.sequences(table(spark, rows_of(seqs))))) == plain(seqs)


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = convs.get(c - c % 20, [])
        out[c] = base[:h] + own[h:]
    return out


def test_rebuilt_from_the_family_with_odd_rows(spark):
    """Null turns, roles, texts and ids, repeated rows, families without their first, conversations that end up turnless."""
    rng = np.random.RandomState(6)
    rows = [(int(c), None if t == 3 else int(t), [None, "user", "assistant"][int(r)], [None, "", "a b", "c", "a  b"][int(x)], "clash") for c, t, r, x in zip(rng.randint(0, 90, 400), rng.randint(0, 5, 400), rng.randint(0, 3, 400), rng.randint(0, 5, 400), strict=True) if c // 20 != 2 or c % 20]
    rows += [(45, 0, "user", "lone", "x"), (None, 0, "user", "nobody", "x"), (41, 9, "user", "z" * 300_000 + " end", "x")]
    convs = {}
    name = lambda r, t: hashlib.sha256(f"{len(r or '')}:{r or ''}{t or ''}".encode()).digest()[:16]
    for c, t, r, x, _ in rows:
        if c is not None:
            convs.setdefault(c, []).append(((t is not None, t or 0, r or "", name(r, x)), (r or "", x or "")))
    convs = {c: [turn for _, turn in sorted(held)] for c, held in convs.items()}
    want = rebuilt(convs)
    assert any(not x for x in want.values())
    assert found(trie.trie(trie.rebuilt(trie.sequences(table(spark, rows))))) == plain(want)


def test_hashes_of_many_members_go_over_pieces(spark):
    import pytest

    mp = pytest.MonkeyPatch()
    mp.setattr(trie, "PIECE", 7)
    try:
        members = spark.createDataFrame([(bytearray(b"a"), i) for i in range(-50, 150)] + [(bytearray(b"b"), 5)], "key binary, conv_id long").repartition(4)
        got = {bytes(r["key"]): r["ends_sha256"] for r in trie.digests(members).collect()}
    finally:
        mp.undo()
    assert got == {b"a": hashlib.sha256(",".join(map(str, range(-50, 150))).encode()).hexdigest(), b"b": hashlib.sha256(b"5").hexdigest()}


def test_no_conversations_and_turnless_ones(spark):
    none = table(spark, [])
    assert found(trie.trie(trie.rebuilt(trie.sequences(none)))) == [] and found(trie.trie(trie.sequences(table(spark, [(None, 0, "user", "x", "y")])))) == []
    empty = spark.createDataFrame([(3, []), (4, [])], trie.sequences(none).schema)
    assert found(trie.trie(empty)) == plain({3: [], 4: []})

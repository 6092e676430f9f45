"""Chat formatting as a prefix tree.

Conversations are sorted by their sequences of turns, so that those with equal initial turns are
neighbours; one pass over each sorted range emits every shared turn once, depth first, with position
ids (tokens from the conversation's start) and the intervals of the token stream that the turn may
attend to: its ancestors. The sorted ranges are the streams. Copies of a hot conversation, or
conversations with a hot first turn, spread over several ranges; each range starts its own tree, so that a
path is emitted again at most once per range boundary and no task depends on one key's size.

Cases: a null role or text is empty; a null turn sorts first; turns that tie are ordered by role and
text, and repeated rows count as turns of their own; a null conv_id is a conversation; an empty table
gives an empty tree; other columns are ignored. One conversation is one record and has to fit a task.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, small_batches

#: The template: what opens a turn, what ends its role, what closes it.
OPEN, BODY, CLOSE = "<|turn|>", "\n", "<|end|>\n"
#: Strings that act as control strings in this or other common templates.
CONTROL = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TOKENIZER = "byte_bpe_50k.tiktoken"
#: Longer texts are tokenized in slices of at least so many characters, cut where the tokenizer's pattern parts them anyway.
SLICE = 4096
_cut = re.compile(r"(?<=[A-Za-z])(?= [A-Za-z])")

_escape = re.compile(r"(\\)|(?=" + "|".join(map(re.escape, CONTROL)) + r")(.)|(\n)")


def escape(text: str, newline: bool = False) -> str:
    """A break follows the first character of every control string; backslashes are doubled; newlines on request."""
    return _escape.sub(lambda m: "\\\\" if m[1] else m[2] + "\\-" if m[2] else "\\n" if newline else "\n", text)


def unescape(text: str) -> str:
    return re.sub(r"\\([\\n-])", lambda m: {"\\": "\\", "n": "\n", "-": ""}[m[1]], text)


@lru_cache(4)
def encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _encode(enc, text: str) -> list[int]:
    """The tokenizer's ids of the whole text."""
    ids, at = [], 0
    while at < len(text):
        cut = _cut.search(text, at + SLICE)
        end = cut.start() if cut else len(text)
        ids += enc.encode_ordinary(text[at:end])
        at = end
    return ids


TREE = "stream_id long, seq long, kind string, {id}, depth long, role string, start long, length long, position long, ancestors array<struct<start:long,end:long>>, loss_start long, loss_end long, ids binary"


def tree(conversations: DataFrame, tokenizer_path: str) -> DataFrame:
    """The forest of turns, in streams.

    kind ``turn``: one emitted turn; its tokens ids (unsigned 16-bit) lie at [start, start + length) of the
    stream, have position ids position, position + 1, ..., and see ancestors plus themselves causally;
    [loss_start, loss_end) of the stream is under the loss mask. kind ``leaf``: conversation conv_id ends
    at the turn above it, at this depth.
    """
    spark = conversations.sparkSession
    small_batches(spark)
    rows = conversations.selectExpr("conv_id", "turn", "coalesce(cast(role as string), '') AS role", "coalesce(cast(text as string), '') AS text")
    per_conv = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    keyed = per_conv.select("conv_id", F.transform("turns", lambda t: F.xxhash64(t["role"], t["text"])).alias("path"), F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    dealt = keyed.repartitionByRange(partitions(spark), "path", "conv_id").sortWithinPartitions("path", "conv_id").select("conv_id", "turns")
    id_type = rows.schema["conv_id"].dataType.simpleString()
    schema = TREE.format(id=f"conv_id {id_type}")

    def walk(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        enc = encoding(tokenizer_path)
        stream, seq, at = TaskContext.get().partitionId(), 0, 0
        stack: list[tuple] = []  # (role, text, start, end, position after it)
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        kinds = None
        for b in batches:
            ids_type = b.column("conv_id").type
            kinds = [pa.int64(), pa.int64(), pa.string(), ids_type, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(span), pa.int64(), pa.int64(), pa.binary()]
            out: list[tuple] = []
            for conv, turns in zip(b.column("conv_id").to_pylist(), b.column("turns").to_pylist(), strict=True):
                depth = 0
                while depth < min(len(stack), len(turns)) and stack[depth][0] == turns[depth]["role"] and stack[depth][1] == turns[depth]["text"]:
                    depth += 1
                del stack[depth:]
                for t in turns[depth:]:
                    head = _encode(enc, OPEN + escape(t["role"], True) + BODY)
                    body = _encode(enc, escape(t["text"]))
                    ids = head + body + _encode(enc, CLOSE)
                    above: list[dict] = []
                    for _, _, a, z, _ in stack:
                        if above and above[-1]["end"] == a:
                            above[-1]["end"] = z
                        else:
                            above.append({"start": a, "end": z})
                    position = stack[-1][4] if stack else 0
                    first = at + len(head)
                    loss = (first, first + len(body)) if t["role"] == "assistant" else (first, first)
                    out.append((stream, seq, "turn", None, len(stack), t["role"], at, len(ids), position, above, *loss, np.array(ids, "<u2").tobytes()))
                    stack.append((t["role"], t["text"], at, at + len(ids), position + len(ids)))
                    seq, at = seq + 1, at + len(ids)
                out.append((stream, seq, "leaf", conv, len(turns), None, at, 0, None, None, at, at, None))
                seq += 1
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds], [f.split()[0] for f in re.split(r",\s+", schema)])

    return dealt.mapInArrow(walk, schema)


BACK = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, loss_text_bytes long"


def read_back(forest: DataFrame, tokenizer_path: str) -> DataFrame:
    """One row per conversation, decoded from the tree's tokens along each path. Shared turns are read once."""
    spark = forest.sparkSession
    n = partitions(spark)
    dealt = forest.repartitionById(n, (F.col("stream_id") % n).cast("int")).sortWithinPartitions("stream_id", "seq")
    id_type = forest.schema["conv_id"].dataType.simpleString()

    def walk(batches: Iterator) -> Iterator:
        import pyarrow as pa

        enc = encoding(tokenizer_path)
        stack: list[tuple] = []  # start, end, states after this turn
        stream = None
        for b in batches:
            out = []
            for r in b.to_pylist():
                if r["stream_id"] != stream:
                    stream, stack = r["stream_id"], []
                del stack[r["depth"] :]
                if r["kind"] == "turn":
                    ids = np.frombuffer(r["ids"], "<u2")
                    spans = [(s["start"], s["end"]) for s in r["ancestors"]]
                    if sum(z - a for a, z in spans) != sum(x[1] - x[0] for x in stack) or not all(any(a <= x[0] and x[1] <= z for a, z in spans) for x in stack[:1] + stack[-1:]):
                        raise ValueError("a turn's attention intervals don't cover its ancestors")
                    whole = enc.decode_bytes(ids.tolist()).decode()
                    under = unescape(enc.decode_bytes(ids[r["loss_start"] - r["start"] : r["loss_end"] - r["start"]].tolist()).decode())
                    role, _, text = whole.removeprefix(OPEN).removesuffix(CLOSE).partition(BODY)
                    role, text = unescape(role), unescape(text)
                    turns, loss, chars, loss_chars, size = stack[-1][2] if stack else (hashlib.sha256(), hashlib.sha256(), 0, 0, 0)
                    turns, loss = turns.copy(), loss.copy()
                    turns.update(f"{role}\n{text}\n".encode())
                    loss.update(under.encode())
                    stack.append((r["start"], r["start"] + r["length"], (turns, loss, chars + len(whole), loss_chars + len(under), size + len(under.encode()))))
                else:
                    turns, loss, chars, loss_chars, size = stack[-1][2]
                    out.append((r["conv_id"], len(stack), turns.hexdigest(), loss_chars, loss.hexdigest(), chars, size))
            kinds = [b.column("conv_id").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            if out:
                yield pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["conv_id", *(x.split()[0] for x in BACK.split(", "))])

    return dealt.mapInArrow(walk, f"conv_id {id_type}, {BACK}")

"""Sequence packing along a Hilbert curve.

Each document's hashed token vector is projected to DIMS dimensions; the Hilbert key of that point orders
documents so that neighbours on the curve are alike. Documents are dealt to key ranges and packed one
after the other, cut wherever a sequence is full. The rest of a range is cut into sequences whose lengths
are powers of two, so that nothing is padded. Ranges come from a sample of keys and only balance the
work; equal keys (copies, repeated rows) are spread by a hash of the row's place in its task, so a hot group splits over ranges.

Cases: a null text is empty and packs as its end token alone; very long texts are cut into as many
pieces as they need; equal keys are ordered by the hash of their place, then by id; repeated rows are packed each; an empty table gives no
piece; other columns are ignored.
"""

from __future__ import annotations

import re
import string
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import giving_back, mix, partitions, small_batches

LENGTH = 2048
END = 1
DIMS, BITS = 4, 11
HASHED = 4096
#: Sampled keys for each range.
SAMPLE = 60
#: Rows and bytes of a batch: a word is encoded once for each batch that has it.
BATCH_ROWS, BATCH_BYTES = 4000, 4 << 20
#: Words encoded at once.
CHUNK = 2000
#: Remembered words of a worker that aren't all letters, and the longest that is remembered.
WORDS, WORD_CHARS = 50_000, 48
VOCABULARY = 49_408

_odd = re.compile("[\x1c-\x1fΣ]|<\\|")
_odd_bytes = [b"\x1c", b"\x1d", b"\x1e", b"\x1f", "Σ".encode(), b"<|"]
_tail = "".join(c for c in string.punctuation if c != "'")


class Tokens:
    """Token ids of whole texts by the word-level tokenizer, with each distinct word of a batch encoded once.

    The tokenizer drops white space, never joins across it and parts letters and digits from punctuation, so a text's ids are those of its
    words. Texts with anything that makes this unsafe (special-token strings, text that isn't normalised,
    context-dependent lower case) go through the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.full = Tokenizer.from_file(path)
        self.bare = Tokenizer.from_file(path)  # for words of letters, already lower case
        self.bare.normalizer = None
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocab = self.full.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.byte = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)} | {32: " "}
        self.known: dict[str, np.ndarray] = {}

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u2")

    def _letters(self, words) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of words that are all letters (an Arrow array) and their numbers, in lists to concatenate."""
        ids, sizes = [], []
        _, offsets, data = words.buffers()
        offsets = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64)
        # all words in one text, a space after each
        raw = np.insert(np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets[1:] - offsets[0], 32).tobytes() if len(words) else b""
        starts = offsets - offsets[0] + np.arange(len(words) + 1)
        for at in range(0, len(words), CHUNK):
            part = words[at : at + CHUNK]
            text = raw[starts[at] : starts[at + len(part)] - 1]
            shown = text.decode("latin-1") if text.isascii() else text.decode("latin-1").translate(self.byte)
            got = np.array(self.bare.encode_batch_fast([shown], add_special_tokens=False)[0].ids, "<u2")
            cuts = np.flatnonzero(self.ends[got]) + 1
            if len(cuts) == len(part):
                ids.append(got)
                sizes.append(np.diff(cuts, prepend=0))
            else:
                each = [self._whole(w) for w in part.to_pylist()]
                ids += each
                sizes.append(np.array([len(x) for x in each], np.int64))
        return ids, sizes

    def _mixed(self, words: list[str]) -> list[np.ndarray]:
        """Ids of words that aren't all letters: letters and a tail of punctuation part, the rest is encoded and remembered."""
        import pyarrow as pa

        bases = {b for b in (w.rstrip(_tail) for w in words) if b.isalpha()}
        order = sorted(bases)
        ids, sizes = self._letters(pa.array(order, pa.large_string()))
        found = dict(zip(order, np.split(np.concatenate(ids), np.cumsum(np.concatenate(sizes))[:-1]), strict=True)) if order else {}
        out = []
        for w in words:
            base = w.rstrip(_tail)
            rest, first = (w[len(base) :], found[base]) if base in found else (w, None)
            tail = self.known.get(rest)
            if tail is None:
                tail = self._whole(rest)
                if len(rest) <= WORD_CHARS:
                    if len(self.known) >= WORDS:
                        self.known.clear()
                    self.known[rest] = tail
            out.append(tail if first is None else np.concatenate([first, tail]))
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Unsigned 16-bit ids of the texts one after the other, END after each, and where each text's ids end."""
        import pyarrow as pa
        import pyarrow.compute as pc

        whole = {}  # texts that only the tokenizer itself may cut
        raw = "\n".join(texts).encode("utf-8", "surrogatepass")
        suspect = any(x in raw for x in _odd_bytes)
        lows = []
        for k, t in enumerate(texts):
            low = None
            if not (suspect and _odd.search(t)) and (t.isascii() or unicodedata.is_normalized("NFC", t)):
                low = t.lower()
                if not low.isascii() and not unicodedata.is_normalized("NFC", low):
                    low = None
            if low is None:
                whole[k], low = self._whole(t), ""
            lows.append(low if _classes_agree() else " ".join(low.split()))
        parts = pc.utf8_split_whitespace(_parted(pa.array(lows, pa.large_string())))
        coded = parts.flatten().dictionary_encode()
        words = coded.dictionary
        narrow = _classes_agree() and not any(max(x.encode(), default=0) >= 0xE0 for x in lows if not x.isascii())
        alpha = pc.utf8_is_alpha(words) if narrow else pa.array([w.isalpha() for w in words.to_pylist()], pa.bool_())
        ids, sizes = self._letters(words.filter(alpha))
        mixed = self._mixed(words.filter(pc.invert(alpha)).to_pylist())
        table = np.concatenate([np.zeros(0, "<u2"), *ids, *mixed])
        many = np.concatenate([np.zeros(0, np.int64), *sizes, np.array([len(x) for x in mixed], np.int64)])
        first = np.cumsum(many) - many
        # words of letters come first in the table
        place = np.empty(len(words), np.int64)
        held = alpha.to_numpy(zero_copy_only=False)
        place[np.concatenate([np.flatnonzero(held), np.flatnonzero(~held)])] = np.arange(len(words))
        at = place[coded.indices.to_numpy()]
        many = many[at]
        before = np.cumsum(many) - many
        flat = table[np.repeat(first[at] - before, many) + np.arange(int(many.sum()))]
        cuts = np.concatenate([before, [len(flat)]])[parts.offsets.to_numpy() - parts.offsets[0].as_py()]
        if whole:
            split = [whole.get(k, flat[cuts[k] : cuts[k + 1]]) for k in range(len(texts))]
            flat, cuts = np.concatenate(split), np.concatenate([[0], np.cumsum([len(x) for x in split])])
        out = np.full(len(flat) + len(texts), END, "<u2")
        out[np.arange(len(flat)) + np.repeat(np.arange(len(texts)), np.diff(cuts))] = flat
        return out, cuts[1:] + np.arange(1, len(texts) + 1)


def _parted(texts):
    """The texts (an Arrow array) with a space between an ASCII letter or digit and the punctuation that ends its word: fewer words differ."""
    import pyarrow as pa

    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[1 : len(texts) + 1] if len(texts) else np.zeros(0, np.int64)
    if data is None or not data.size or not len(ends) or not ends[-1]:
        return texts
    raw = np.frombuffer(data, np.uint8)[: ends[-1]]
    kind = _KIND[raw]
    mark = kind == 2
    first, last = np.flatnonzero(mark[1:] & ~mark[:-1]) + 1, np.flatnonzero(mark & ~np.append(mark[1:], False))
    if mark[0]:
        last = last[1:]
    closing = np.append(kind == 3, True)
    closing[ends] = True
    opening = np.zeros(len(raw), bool)
    opening[ends[:-1][ends[:-1] < len(raw)]] = True  # a text that begins with punctuation has no word before it
    cut = first[(kind[first - 1] == 1) & closing[last + 1] & ~opening[first]]
    # a run of punctuation that crosses into the next text is left as it is
    cut = cut[np.searchsorted(ends, cut, side="right") == np.searchsorted(ends, last[np.searchsorted(last, cut)], side="right")]
    moved = np.insert(raw, cut, 32)
    shifted = np.concatenate([[0], ends + np.searchsorted(cut, ends, side="left")])
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(shifted.astype(np.int64)), pa.py_buffer(moved))


#: Of a byte: 1 an ASCII letter or digit, 2 punctuation, 3 white space, 0 anything else.
_KIND = np.zeros(256, np.uint8)
_KIND[[*(string.ascii_lowercase + string.digits).encode()]] = 1
_KIND[[*_tail.encode()]] = 2
_KIND[[9, 10, 11, 12, 13, 32]] = 3


@lru_cache(1)
def _classes_agree() -> bool:
    """Whether Arrow and Python hold the same characters for white space (all lie below U+3001), and for letters of at most two bytes."""
    import pyarrow as pa
    import pyarrow.compute as pc

    every = [chr(c) for c in range(0x3100)]
    two = every[:0x800]
    return pc.utf8_is_space(pa.array(every)).to_pylist() == [c.isspace() for c in every] and pc.utf8_is_alpha(pa.array(two)).to_pylist() == [c.isalpha() for c in two]


@lru_cache(2)
def tokens_of(path: str) -> Tokens:
    return Tokens(path)


@lru_cache(1)
def _projection() -> np.ndarray:
    """Token id -> point: its hashed bucket's row of a random projection, with a hashed sign."""
    h = mix(np.arange(VOCABULARY + 128, dtype=np.uint64) + np.uint64(1))
    rows = np.random.RandomState(7).standard_normal((HASHED, DIMS)).astype(np.float32)
    sign = np.where(h >> np.uint64(63), 1, -1).astype(np.float32)
    return rows[(h % np.uint64(HASHED)).astype(np.int64)] * sign[:, None]


def hilbert(points: np.ndarray) -> np.ndarray:
    """Hilbert index of integer points (rows of DIMS coordinates below 2**BITS)."""
    x = points.astype(np.int64).T.copy()
    top = 1 << (BITS - 1)
    q = top
    while q > 1:
        p = q - 1
        for i in range(DIMS):
            on = (x[i] & q) != 0
            flip = np.where(on, p, 0)
            swap = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] ^= flip ^ swap
            x[i] ^= swap
        q >>= 1
    for i in range(1, DIMS):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = top
    while q > 1:
        turn ^= np.where((x[DIMS - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros(x.shape[1], np.int64)
    for bit in range(BITS - 1, -1, -1):
        for i in range(DIMS):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def keys(ids: np.ndarray, ends: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Sort keys: the Hilbert key of each document's projected vector, then 16 bits of spread."""
    if not len(ends):
        return np.zeros(0, np.int64)
    table = _projection()
    starts = np.concatenate([[0], ends])
    sums = np.zeros((len(ends), DIMS), np.float64)
    for i in range(0, len(ends), 64):
        j = min(i + 64, len(ends))
        sums[i:j] = np.add.reduceat(table[ids[starts[i] : starts[j]]], starts[i:j] - starts[i], axis=0, dtype=np.float64)
    unit = 0.5 + 0.5 * np.tanh(4 * sums / np.diff(starts)[:, None])
    points = np.minimum((unit * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)
    return (hilbert(points) << 16) | (spread.astype(np.int64) & 0xFFFF)


class Places:
    """Hashes of the places of a task's rows, batch by batch."""

    def __init__(self):
        from pyspark import TaskContext

        self.next = TaskContext.get().partitionId() << 33

    def of(self, n: int) -> np.ndarray:
        places = np.arange(self.next, self.next + n, dtype=np.uint64)
        self.next += n
        return mix(places * np.uint64(0x9E3779B97F4A7C15))


def _texts(b) -> list[str]:
    return [t or "" for t in b.column("text").to_pylist()]


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, doc_tokens, sequence_id, offset, ids (unsigned 32-bit, little-endian): one row per piece."""
    spark = docs.sparkSession
    small_batches(spark, BATCH_ROWS, BATCH_BYTES)
    n = partitions(spark)
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()

    @giving_back
    def key_only(batches: Iterator) -> Iterator:
        import pyarrow as pa

        places = Places()
        for b in batches:
            ids, ends = tokens_of(tokenizer_path).encode(_texts(b))
            yield pa.record_batch([pa.array(keys(ids, ends, places.of(b.num_rows)), pa.int64()), pa.array(np.diff(ends, prepend=0))], ["key", "n"])

    total = max(1, source.count())
    # rows are sampled, not ids or texts: of a hot group its share comes
    sample = source.select("text").where(F.rand(SAMPLE) < SAMPLE * n / total)
    seen = np.array([(r["key"], r["n"]) for r in sample.mapInArrow(key_only, "key long, n long").collect()], np.int64).reshape(-1, 2)
    seen = seen[np.argsort(seen[:, 0], kind="stable")]
    weight = np.cumsum(seen[:, 1])
    cuts = np.searchsorted(weight, np.arange(1, n) * (weight[-1] / n if len(weight) else 0))
    bounds = np.unique(seen[np.minimum(cuts, len(seen) - 1), 0]) if len(seen) else np.zeros(0, np.int64)

    @giving_back
    def tokenize(batches: Iterator) -> Iterator:
        import pyarrow as pa

        places = Places()
        for b in batches:
            ids, ends = tokens_of(tokenizer_path).encode(_texts(b))
            k = keys(ids, ends, places.of(b.num_rows))
            offsets = np.concatenate([[0], 2 * ends]).astype(np.int32)
            raw = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
            yield pa.record_batch([pa.array(np.searchsorted(bounds, k, side="right").astype(np.int32)), pa.array(k), b.column("doc_id"), raw], ["part", "key", "doc_id", "ids"])

    tokenized = source.mapInArrow(tokenize, f"part int, key long, doc_id {id_type}, ids binary")
    dealt = tokenized.repartitionById(n, F.col("part")).sortWithinPartitions("key", "doc_id").select("part", "doc_id", "ids")

    @giving_back
    def fill(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        open_, used, number, part, doc_type = [], 0, 0, 0, None

        def batch(out):
            cols = list(zip(*out, strict=True)) if out else [[]] * 7
            return pa.record_batch([pa.array(list(cols[0]), doc_type), *(pa.array(list(c), k) for c, k in zip(cols[1:], kinds, strict=True))], names)

        def piece(doc, start, ids, size, offset):
            return (doc, start, len(ids), size, (part << 40) | number, offset, ids.astype("<u4").tobytes())

        for b in batches:
            out = []
            doc_type = b.column("doc_id").type
            for p, doc, raw in zip(b.column("part").to_pylist(), b.column("doc_id").to_pylist(), b.column("ids").to_pylist(), strict=True):
                part, ids, at = p, np.frombuffer(raw, "<u2"), 0
                while at < len(ids):
                    take = min(LENGTH - used, len(ids) - at)
                    open_.append((doc, at, ids[at : at + take], len(ids)))
                    at, used = at + take, used + take
                    if used == LENGTH:
                        offset = 0
                        for d, s, x, size in open_:
                            out.append(piece(d, s, x, size, offset))
                            offset += len(x)
                        open_, used, number = [], 0, number + 1
            yield batch(out)
        out, size, offset = [], 1 << max(0, used.bit_length() - 1), 0
        while used:
            doc, s, x, whole = open_.pop(0)
            if len(x) > size - offset:
                open_.insert(0, (doc, s + size - offset, x[size - offset :], whole))
                x = x[: size - offset]
            out.append(piece(doc, s, x, whole, offset))
            offset += len(x)
            if offset == size:
                used, number, offset = used - size, number + 1, 0
                size = 1 << max(0, used.bit_length() - 1)
        if out:
            yield batch(out)

    return dealt.mapInArrow(fill, f"doc_id {id_type}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")

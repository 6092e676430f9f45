"""Language-model scores of whole documents from a subword lattice.

The pieces and their ranks come from an existing vocabulary file. A document's model is one unigram
distribution over pieces and a document end: the probability of a text is the product over its words of the word's
marginal probability, summed over all its segmentations into pieces (log-space forward recursion),
times the end's. Piece probabilities start from the vocabulary's own scores (ranks, read as a
Zipf-Mandelbrot law) and are re-estimated by expectation-maximisation on every distinct word of the training
documents with its count: each pass runs over the table of counts, and only sums by piece come back.

Counts of every distinct word are gathered from all documents as a table that grows with the corpus. The scores of the
HEAD most frequent short words (a bound on size) are shipped to the workers, which changes no score; all other occurrences
meet their counts in a join on the word.

Cases: a null text is empty and is its end token alone; words of any length are scored whole; a vocabulary
miss falls back to byte pieces, so every text has a finite score; repeated rows are scored each and
count each; an empty training set gives counts of zero; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_of, small_batches, texts, written

VOCABULARY = "piece_bpe_32k.model"
#: Most frequent training words that are shipped to the workers, and their longest: a bound of HEAD * (HEAD_BYTES + 32) bytes.
HEAD, HEAD_BYTES = 65_536, 256
#: EM passes over the counts, and the weight of the vocabulary's own scores as pseudo-counts (share of all).
ROUNDS, PRIOR = 3, 0.02
#: Zipf-Mandelbrot reading of ranks.
SHIFT, POWER = 10.0, 1.0
#: Distinct words a task holds before it passes their counts on.
HELD = 200_000
#: Distinct words whose lattices a task builds at once.
TOGETHER = 32_768
#: Words of at most so many characters are scored and counted together, longer ones one by one.
WIDE = 24
#: Bits of a hash that say whether any piece begins so.
PREFIX_BITS = 21
MARK = "▁"


@lru_cache(2)
def pieces(path: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Pieces usable inside words, their log scores as given by the vocabulary, and 256 byte pieces' log scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found, ranks, bytes_ = [], [], np.zeros(256)
    for i in range(model.vocab_size()):
        piece, score = model.id_to_piece(i), model.get_score(i)
        if model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or MARK in piece[1:] or piece == MARK + MARK:
            continue
        found.append(piece)
        ranks.append(min(-score, 10.0 * model.vocab_size()))
    p = 1 / (np.array(ranks) + SHIFT) ** POWER
    rare = p.min() / 64
    whole = p.sum() + 256 * rare
    return found, np.log(p / whole), bytes_ + np.log(rare / whole)


class Lattice:
    """Marginal log probabilities of words under a unigram distribution over pieces."""

    def __init__(self, names: list[str], logp: np.ndarray, byte_logp: np.ndarray):
        self.names, self.logp, self.bytes = names, logp, byte_logp
        self.index = {p: i for i, p in enumerate(names)}
        self.longest = max(map(len, names), default=1)
        #: Whether a piece may begin with a hash of these leading bits: false is certain.
        self.begins = np.zeros(1 << PREFIX_BITS, bool)
        hashes = self._hash(names)
        self.bits = max(4, (4 * max(1, len(names)) - 1).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int64)
        self.keys = hashes
        place = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        for i, at in enumerate(place.tolist()):
            while self.slots[at] >= 0:
                at = (at + 1) & (len(self.slots) - 1)
            self.slots[at] = i
        self.probes = self._longest_probe()

    def _longest_probe(self) -> int:
        run = most = 0
        for used in np.concatenate([self.slots, self.slots[:64]]) >= 0:
            run = run + 1 if used else 0
            most = max(most, run)
        return most

    @staticmethod
    def _step(h, c):
        return (h ^ c) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)

    def _hash(self, names: list[str]) -> np.ndarray:
        out = np.zeros(len(names), np.uint64)
        sizes = np.array([len(name) for name in names], np.int64)
        for size in set(sizes.tolist()) - {0}:
            at = np.flatnonzero(sizes == size)
            codes = np.array([names[k] for k in at], f"<U{size}").view(np.uint32).reshape(len(at), size).astype(np.uint64)
            h = np.zeros(len(at), np.uint64)
            for j in range(size):
                h = self._step(h, codes[:, j])
                h = h ^ (h >> np.uint64(29))
                self.begins[h >> np.uint64(64 - PREFIX_BITS)] = True
            out[at] = h
        return out

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Piece number of each hash, or -1."""
        at = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        out = np.full(len(h), -1, np.int64)
        open_ = np.arange(len(h))
        for _ in range(self.probes + 1):
            got = self.slots[at]
            hit = (got >= 0) & (self.keys[got] == h[open_])
            out[open_[hit]] = got[hit]
            on = (got >= 0) & ~hit
            if not on.any():
                break
            open_, at = open_[on], (at[on] + 1) & (len(self.slots) - 1)
        return out

    def _char(self, c: str) -> float:
        """Log score of one character spelled in byte pieces."""
        return float(self.bytes[list(c.encode("utf-8", "surrogatepass"))].sum())

    def _trellis(self, codes: np.ndarray) -> tuple[list[list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]], list[np.ndarray]]:
        """For words of one length (rows, the mark first): edges into each position (from where, rows, pieces, log scores), and the byte spelling of each character."""
        n, size = codes.shape
        into: list[list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]] = [[] for _ in range(size + 1)]
        for i in range(size):
            h, rows = np.zeros(n, np.uint64), np.arange(n)
            for j in range(i, min(size, i + self.longest)):
                h = self._step(h, codes[rows, j])
                h = h ^ (h >> np.uint64(29))
                on = self.begins[h >> np.uint64(64 - PREFIX_BITS)]
                h, rows = h[on], rows[on]
                if not len(rows):
                    break
                found = self._find(h)
                hit = found >= 0
                if hit.any():
                    into[j + 1].append((i, rows[hit], found[hit], self.logp[found[hit]]))
        spelled = []
        for j in range(size):
            kinds, back = np.unique(codes[:, j], return_inverse=True)
            spelled.append(np.array([self._char(chr(int(c))) for c in kinds])[back])
        return into, spelled

    @cached_property
    def prefixes(self) -> frozenset[str]:
        return frozenset(p[:k] for p in self.names for k in range(1, len(p) + 1))

    def _onward(self, text: str, i: int) -> Iterator[tuple[int, int]]:
        """End and number of each piece of a marked word that starts at i; the mark stands for itself only there."""
        for j in range(i + 1, min(len(text), i + self.longest) + 1):
            part = text[i:j]
            if part not in self.prefixes or (i and part[-1] == MARK):
                return
            k = self.index.get(part)
            if k is not None:
                yield j, k

    def _forward_alone(self, text: str) -> list[float]:
        alpha = [0.0] + [-math.inf] * len(text)
        for i, c in enumerate(text):
            alpha[i + 1] = _plus(alpha[i + 1], alpha[i] + self._char(c))
            for j, k in self._onward(text, i):
                alpha[j] = _plus(alpha[j], alpha[i] + self.logp[k])
        return alpha

    def _alone(self, word: str) -> float:
        """One word of any length: the same recursion with a window of the longest piece."""
        return float(self._forward_alone(MARK + word)[-1])

    def _expected_alone(self, word: str, count: float, uses: np.ndarray) -> float:
        """Adds one word's expected uses of pieces to uses; its byte pieces' are returned."""
        text, spelled_uses = MARK + word, 0.0
        alpha = self._forward_alone(text)
        beta = [-math.inf] * len(text) + [0.0]
        for i in range(len(text) - 1, -1, -1):
            spelled = self._char(text[i]) + beta[i + 1]
            spelled_uses += count * math.exp(alpha[i] + spelled - alpha[-1])
            beta[i] = spelled
            for j, k in self._onward(text, i):
                there = self.logp[k] + beta[j]
                uses[k] += count * math.exp(alpha[i] + there - alpha[-1])
                beta[i] = _plus(beta[i], there)
        return spelled_uses

    @staticmethod
    def _by_length(words: list[str]) -> dict[int, list[int]]:
        out: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            out.setdefault(len(w) if len(w) <= WIDE and MARK not in w else -1, []).append(i)
        return out

    @staticmethod
    def _codes(words: list[str], size: int) -> np.ndarray:
        raw = np.array([MARK + w for w in words], f"<U{size + 1}")
        return raw.view(np.uint32).reshape(len(words), size + 1).astype(np.uint64)

    def forward(self, words: list[str]) -> np.ndarray:
        """Natural-log marginal probability of each word."""
        out = np.zeros(len(words))
        for size, at in self._by_length(words).items():
            if size < 0:
                out[at] = [self._alone(words[i]) for i in at]
                continue
            for k in range(0, len(at), 8192):
                part = at[k : k + 8192]
                out[part] = self._sum(*self._trellis(self._codes([words[i] for i in part], size)))[-1]
        return out

    @staticmethod
    def _sum(into, spelled) -> list[np.ndarray]:
        alpha = [np.zeros(len(spelled[0]))]
        for j in range(1, len(spelled) + 1):
            a = alpha[j - 1] + spelled[j - 1]
            for i, rows, _, logp in into[j]:
                a[rows] = np.logaddexp(a[rows], alpha[i][rows] + logp)
            alpha.append(a)
        return alpha

    def expected(self, words: list[str], counts: np.ndarray) -> tuple[np.ndarray, float]:
        """Expected uses of each piece over words with counts, and of byte pieces together."""
        uses, spelled_uses = np.zeros(len(self.names)), 0.0
        for size, at in self._by_length(words).items():
            if size < 0:
                spelled_uses += sum(self._expected_alone(words[i], float(counts[i]), uses) for i in at)
                continue
            for k in range(0, len(at), 8192):
                part = at[k : k + 8192]
                weight = counts[part]
                into, spelled = self._trellis(self._codes([words[i] for i in part], size))
                alpha = self._sum(into, spelled)
                beta = [np.full(len(part), -np.inf) for _ in range(size + 2)]
                beta[size + 1] = np.zeros(len(part))
                used, shares = [np.zeros(0, np.int64)], [np.zeros(0)]
                for j in range(size + 1, 0, -1):
                    for i, rows, found, logp in into[j]:
                        there = logp + beta[j][rows]
                        used.append(found)
                        shares.append(np.exp(alpha[i][rows] + there - alpha[-1][rows]) * weight[rows])
                        beta[i][rows] = np.logaddexp(beta[i][rows], there)
                    spelled_uses += float((np.exp(alpha[j - 1] + spelled[j - 1] + beta[j] - alpha[-1]) * weight).sum())
                    beta[j - 1] = np.logaddexp(beta[j - 1], spelled[j - 1] + beta[j])
                uses += np.bincount(np.concatenate(used), np.concatenate(shares), len(uses))
        return uses, spelled_uses


def _plus(a: float, b: float) -> float:
    """log(exp(a) + exp(b)) of numbers of which one at least is finite."""
    return a + math.log1p(math.exp(b - a)) if a >= b else b + math.log1p(math.exp(a - b))


def fitted(path: str, words: list[str], counts: np.ndarray, documents: int) -> tuple[Lattice, float]:
    """Piece probabilities after EM on words with counts, and the end's natural-log probability."""
    return estimated(path, lambda model: model.expected(words, counts), documents, ROUNDS if len(words) else 0)


def estimated(path: str, expected: Callable[[Lattice], tuple[np.ndarray, float]], documents: int, rounds: int, weight: float = PRIOR) -> tuple[Lattice, float]:
    """The same, with the expected uses of pieces and of byte pieces under a model from a function.

    weight: pseudo-counts of the vocabulary's own scores, as a share of all uses. Without rounds these scores alone weight the segmentations."""
    names, logp, byte_logp = pieces(path)
    prior, byte_prior = np.exp(logp), np.exp(byte_logp)
    model = Lattice(names, logp, byte_logp)
    end = np.log(0.01)
    for _ in range(rounds):
        uses, spelled = expected(model)
        mass = uses.sum() + spelled
        uses, byte_uses = uses + weight * mass * prior, spelled / 256 + weight * mass * byte_prior
        whole = uses.sum() + byte_uses.sum() + documents
        model.logp, model.bytes, end = np.log(uses / whole), np.log(byte_uses / whole), np.log(max(documents, 1) / whole)
    if not rounds:
        model.logp, model.bytes = logp + math.log(0.99), byte_logp + math.log(0.99)
    return model, float(end)


def together(batches: Iterator) -> Iterator:
    """Tables of TOGETHER rows or more: the trellis runs over many words of one length at once."""
    import pyarrow as pa

    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.num_rows
        if size >= TOGETHER:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _decoded(words) -> list[str]:
    return [w.decode("utf-8", "surrogateescape") for w in words.to_pylist()]


def expected_uses(counts: DataFrame, model: Lattice) -> tuple[np.ndarray, float]:
    """Lattice.expected over a table of words with counts: every task sums by piece, so the vocabulary bounds what is shuffled and collected."""
    parts = (model.names, model.logp, model.bytes)

    def expect(batches: Iterator) -> Iterator:
        import pyarrow as pa

        lattice = Lattice(*parts)
        uses, spelled = np.zeros(len(lattice.names)), 0.0
        for table in together(batches):
            more, bytes_ = lattice.expected(_decoded(table.column("word")), table.column("trained").to_numpy().astype(np.float64))
            uses, spelled = uses + more, spelled + bytes_
        at = np.flatnonzero(uses)
        yield pa.record_batch([pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(uses[at], spelled), pa.float64())], ["piece", "uses"])

    got = counts.select("word", "trained").mapInArrow(expect, "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).toArrow()
    out = np.zeros(len(model.names) + 1)
    out[got.column("piece").to_numpy()] = got.column("uses").to_numpy()
    return out[:-1], float(out[-1])


def words_of(raw: bytes) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return raw.lower().split()


def word_counts(docs: DataFrame) -> DataFrame:
    """word (binary), trained (occurrences where ``train``): every distinct word of the documents."""

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: dict[bytes, int] = {}

        def flush():
            yield pa.record_batch([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "trained"])
            held.clear()

        for b in batches:
            for raw, train in zip(texts(b), b.column("train").to_pylist(), strict=True):
                if train:
                    for w in words_of(raw):
                        held[w] = held.get(w, 0) + 1
                else:
                    for w in words_of(raw):
                        held.setdefault(w, 0)
            if len(held) > HELD:
                yield from flush()
        if held:
            yield from flush()

    return docs.mapInArrow(count, "word binary, trained long").groupBy("word").agg(F.sum("trained").alias("trained"))


def _in_head(counts: DataFrame) -> Column:
    """Which words are in the head: the most frequent short ones, down to a count that keeps them within HEAD.

    A histogram of counts, of some hundred rows whatever the corpus, gives that count; so HEAD rows at most are
    collected, and not HEAD rows of every task.
    """
    short = (F.col("trained") > 0) & (F.length("word") <= HEAD_BYTES)
    level = F.floor(F.log2(F.greatest(F.col("trained"), F.lit(1))) * 32)
    held, least = 0, None
    for r in counts.where(short).groupBy(level.alias("level")).agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect():
        held += r["n"]
        if held > HEAD:
            break
        least = r["level"]
    return F.lit(False) if least is None else short & (level >= least)


def score(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_fold: int = 2, rounds: int = ROUNDS, weight: float = PRIOR) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    rounds and weight choose between the vocabulary's own scores (no rounds, or a large weight) and scores fitted to the training documents."""
    spark = docs.sparkSession
    small_batches(spark)
    held_out = crc_of(f"`{id_col}`") % folds == held_fold
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), (~held_out).alias("train"))
    counts = written(word_counts(source), "words")
    documents = source.where("train").count()
    sums = counts.agg(F.sum("trained").alias("n"), F.count(F.when(F.col("trained") > 0, 1)).alias("v")).first()
    tokens, distinct = (sums["n"] or 0) + documents, sums["v"] + (documents > 0)
    head_only = _in_head(counts)
    head = counts.where(head_only).collect()
    floor = -np.log10(tokens + distinct + 1)
    words = [bytes(r["word"]).decode("utf-8", "surrogateescape") for r in head]
    trained = counts.where("trained > 0")
    model, end = estimated(vocabulary_path, lambda m: expected_uses(trained, m), documents, rounds if sums["n"] else 0, weight)
    to10 = 1 / np.log(10)
    shipped = {bytes(r["word"]): (float(np.log10(r["trained"] + 1) + floor), s) for r, s in zip(head, (model.forward(words) * to10).tolist(), strict=True)}
    parts = (model.names, model.logp, model.bytes)
    end_base, end_known, end_score = float(np.log10(documents + 1) + floor), int(documents > 0), end * to10

    def marginal(batches: Iterator) -> Iterator:
        import pyarrow as pa

        lattice = Lattice(*parts)
        for table in together(batches):
            yield from table.append_column("score", pa.array(lattice.forward(_decoded(table.column("word"))) * to10, pa.float64())).to_batches()

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part, row = TaskContext.get().partitionId(), 0
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_()]
        names = ["part", "row", "word", "n", "n_tokens", "n_known", "base", "score", "held_out"]
        for b in batches:
            firsts, rest = [], ([], [], [])
            for raw, train in zip(texts(b), b.column("train").to_pylist(), strict=True):
                own, base, marginal_, n_known, tail = words_of(raw), end_base, end_score, end_known, {}
                for w in own:
                    got = shipped.get(w)
                    if got is None:
                        tail[w] = tail.get(w, 0) + 1
                    else:
                        base += got[0]
                        marginal_ += got[1]
                        n_known += 1
                firsts.append((part, row, b" %d %d" % (part, row), 1, len(own) + 1, n_known, base, marginal_, not train))
                rest[0].extend([row] * len(tail))
                rest[1].extend(tail)
                rest[2].extend(tail.values())
                row += 1
            if not firsts:
                continue
            first = pa.record_batch([b.column("doc_id"), *(pa.array(list(c), k) for c, k in zip(zip(*firsts, strict=True), kinds, strict=True))], ["doc_id", *names])
            yield first
            n = len(rest[0])
            yield pa.record_batch([pa.nulls(n, b.column("doc_id").type), pa.array([part] * n, pa.int64()), pa.array(rest[0], pa.int64()), pa.array(rest[1], pa.binary()), pa.array(rest[2], pa.int64()), *(pa.nulls(n, k) for k in kinds[4:])], ["doc_id", *names])

    id_type = source.schema["doc_id"].dataType.simpleString()
    rows = source.mapInArrow(read, f"doc_id {id_type}, part long, row long, word binary, n long, n_tokens long, n_known long, base double, score double, held_out boolean")
    # what isn't in the head: every other distinct word with its count and its marginal, once
    beyond = counts.where(~head_only)
    marginals = beyond.mapInArrow(marginal, "word binary, trained long, score double").select("word", "trained", F.col("score").alias("word_score"))
    # A document's own row carries a key with a space in it, which no word has: it meets nothing, in no common partition.
    met = rows.join(marginals, "word", "left")
    tail = F.col("n_tokens").isNull()
    known_n = F.when(tail, F.when(F.col("trained") > 0, F.col("n")).otherwise(0)).otherwise(F.col("n_known"))
    base = F.when(tail, F.col("n") * (F.log10(F.coalesce("trained", F.lit(0)) + F.lit(1.0)) + F.lit(float(floor)))).otherwise(F.col("base"))
    total = F.when(tail, F.col("n") * F.col("word_score")).otherwise(F.col("score"))
    sums = met.groupBy("part", "row").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"), F.sum(known_n).alias("n_known"), F.sum(base).alias("base_score"), F.sum(total).alias("score"))
    return sums.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(tokens)).cast("long").alias("train_tokens"), "base_score", "score")

"""Benchmark decontamination by templates.

Texts become sequences of template tokens: numbers, names (capitalised words inside a sentence, runs of
them together) and units after numbers are typed placeholders, any other word is itself in lower case. An item is all its windows of WIDTH
tokens: template windows, or, where too few of a window's tokens are literal words (arithmetic, lists of numbers), windows of the exact words, numbers and operators.
They meet the documents' windows in a hash join.

Items of one template are one family and are joined once, however many they are: a result row is a document and a family, and `families` has the members.
A leak has half of a family's windows on one alignment, or MIN_HITS of them that are LEAST_SHARE at least; so it has one of any total - needed + 1 of them, and
only that many, the ones that fewest families share, are joined with the documents. So an opening that many items have in common brings no pairs by itself.
The other windows of such a candidate are looked up where they should be.

Slots have to be consistent: the last placeholder before one with the same filling has to be the same one as in an item of the family (or to lie before what the document
quotes). A leak has more than MOST_SLOTS of its slots so, or enough windows as an item has them. So a question with other names
and numbers is still found, also where some of them coincide, and a text that merely has numbers in the same places is not.

Cases: null and empty texts have no windows; items of fewer than WIDTH tokens are one window of their own length, those of fewer than MIN_WORDS an exact one; items of one or
two tokens are found only in documents that say just the same and nothing else; items without a word or number
are not searched; repeated rows are judged each; very long texts are read whole; an empty
table on either side gives no leak; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bitmap, giving_back, mix, small_batches, without, written

WIDTH, MIN_WORDS, MIN_LITERAL, MIN_EXACT = 8, 5, 4, 3
#: A leak has this share of the item's windows on one alignment, or so many of them if they are a lesser share at least.
MIN_SHARE, MIN_HITS, LEAST_SHARE = 0.5, 8, 0.25
#: More than this share of its slots is filled as consistently as in an item.
MOST_SLOTS = 0.5
#: The filter over benchmark windows has about 32 bits a window, between these powers of two.
LEAST_BITS, MOST_BITS = 18, 25
UNITS = frozenset(
    "mm cm m km in ft mi mg g kg t lb lbs oz ml l s sec secs min mins h hr hrs ms hz khz mhz ghz v w kw j kj n pa kpa mol ha "
    "meter meters metre metres kilometer kilometers kilometre kilometres mile miles foot feet inch inches yard yards gram grams kilogram kilograms "
    "pound pounds ounce ounces ton tons tonne tonnes liter liters litre litres second seconds minute minutes hour hours day days week weeks month months "
    "year years percent degree degrees dollar dollars euro euros cent cents".split()
)
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED02)
LITERAL, NUMBER, NAME, UNIT = 0, 1, 2, 3
_KINDS = mix(np.arange(4, dtype=np.uint64))
# flags of a chunk between white space
_CAP, _NUM, _UNIT, _ENDS, _EMPTY = 1, 2, 4, 8, 16
_inner = re.compile(r"[^\w]+|_+")
_operator = re.compile(r"[-+*/=<>^%×÷−]")
_number = re.compile(r"[0-9]+(st|nd|rd|th)?")


class Chunks(dict):
    """chunk -> 64 bits: a hash of its word in the upper 59, flags below. Forgets everything at a bound."""

    def __missing__(self, chunk: str) -> int:
        if len(self) > 250_000:
            self.clear()
        # most chunks are letters alone, or with one mark behind them
        if chunk.isalpha():
            word = chunk
        elif chunk[-1] in ".,;:!?" and chunk[:-1].isalpha():
            word = chunk[:-1]
        else:
            word = _inner.sub("", chunk)
        low = word.lower()
        flags = (0 if low else _EMPTY) | (_NUM if low[:1].isdecimal() and _number.fullmatch(low) else 0) | (_UNIT if low in UNITS else 0)
        if word[:1].isupper() and word[1:] == low[1:]:
            flags |= _CAP
        if chunk[-1] in ".!?:" or chunk[-2:-1] in ".!?":
            flags |= _ENDS
        # a chunk without a letter or digit counts only in exact windows, and there only as operators
        said = low or "".join(_operator.findall(chunk))
        self[chunk] = out = ((xxhash.xxh3_64_intdigest(said.encode("utf-8", "surrogatepass")) & ~31) if said else 0) | flags
        return out


_chunks = Chunks()


def template(chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Kinds and hashes of the template tokens, the number of the first chunk of each, and what all chunks say (hashes)."""
    every = np.fromiter(map(_chunks.__getitem__, chunks), np.uint64, len(chunks))
    said = every & ~np.uint64(31)
    flags = (every & np.uint64(31)).astype(np.uint8)
    at = np.flatnonzero((flags & _EMPTY) == 0)
    if len(at) < len(flags):
        flags = flags[at]
    value = said[at]
    kind = np.zeros(len(flags), np.int64)
    if (flags & (_NUM | _CAP)).any():
        starts = np.ones(len(flags), bool)
        starts[1:] = (flags[:-1] & _ENDS) != 0
        number, name = (flags & _NUM) != 0, ((flags & _CAP) != 0) & ~starts
        name &= ~number
        kind[number], kind[name] = NUMBER, NAME
        if number.any():
            unit = np.zeros(len(flags), bool)
            unit[1:] = number[:-1] & ((flags[1:] & _UNIT) != 0)
            kind[unit] = UNIT
        value = np.where(kind == LITERAL, value, _KINDS[kind])
        keep = np.ones(len(kind), bool)
        keep[1:] = ~((kind[1:] == NAME) & (kind[:-1] == NAME) & ~starts[1:])
        if not keep.all():
            kind, value, at = kind[keep], value[keep], at[keep]
    return kind, value, at, said


_base, _inverse = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of them."""
    while len(_powers[0]) < n:
        for k, b in enumerate((0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64))):
            have = _powers[k]
            _powers[k] = np.concatenate([have, have * np.uint64(pow(b, len(have), 1 << 64))])
    return _powers[0][:n], _powers[1][:n]


def rolled(first: np.ndarray, rest: np.ndarray, width: int) -> np.ndarray:
    """Hash of the window that starts at each token: its first value is from first, the others from rest. A polynomial, by running sums."""
    n = len(first) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, inverse = _grown(len(rest) + 1)
    total = np.zeros(len(rest) + 1, np.uint64)
    np.cumsum(rest * power[:-1], out=total[1:])
    h = (total[width:] - total[:n]) * inverse[:n]
    if first is not rest:
        h += first[:n] - rest[:n]
    return mix(h ^ np.uint64(width))


def enough_literal(kind: np.ndarray, width: int) -> np.ndarray:
    """Whether the window that starts at each token has enough literal words."""
    n = max(0, len(kind) - width + 1)
    literal = kind == LITERAL
    if literal.all():
        return np.ones(n, bool)
    total = np.concatenate([[0], np.cumsum(literal)])
    return total[len(total) - n :] - total[:n] >= min(MIN_LITERAL, width - 1)


def windows(kind: np.ndarray, value: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the template window that starts at each token, and whether it has enough literal words."""
    return rolled(value, value, width), enough_literal(kind, width)


def exact_windows(said: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Hash of the window of words, numbers and operators as they stand, from each template token on.

    What stands between two tokens (operators, the rest of a name) counts with the second; before the first and behind the last it doesn't."""
    if len(at) < width or not len(at):
        return np.zeros(0, np.uint64)
    if len(at) == len(said):
        return rolled(said, said, width) ^ _C1
    starts = np.concatenate([[0], at[:-1] + 1])
    behind = (np.repeat(at, at - starts + 1) - np.arange(at[-1] + 1)).astype(np.uint64)
    inner = said[: at[-1] + 1]
    full = np.add.reduceat(inner * (_C2 * behind + np.uint64(1)), starts)
    return rolled(said[at], full, width) ^ _C1


def slots(kind: np.ndarray, at: np.ndarray, chunks: list[str], start: int, width: int) -> list[tuple[int, int]]:
    """Token number and hash of what fills it (its kind first) of each placeholder of a window."""
    out = []
    for k in range(start, start + width):
        if kind[k] != LITERAL:
            end = at[k + 1] if k + 1 < len(at) else len(chunks)
            run = chunks[at[k] : end] if kind[k] == NAME else chunks[at[k] : at[k] + 1]
            said = f"{kind[k]} " + " ".join(filter(None, (_inner.sub("", c) for c in run)))
            out.append((k, xxhash.xxh3_64_intdigest(said.encode("utf-8", "surrogatepass")) - (1 << 63)))
    return out


def _signed(h: np.ndarray) -> list[int]:
    return h.view(np.int64).tolist()


def needed(total: Column) -> Column:
    """Windows of an item that a leak has on one alignment."""
    return F.least(F.ceil(MIN_SHARE * total), F.greatest(F.lit(MIN_HITS), F.ceil(LEAST_SHARE * total))).cast("long")


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, item (its row), family (a hash of its template), total, pos, window, exact, width, slots: one row per window of an item.

    window is that of the template, or the exact one where there are too few literal words; these have negative widths, whole texts -1 and -2. slots: of a
    template window, the token number of each placeholder and that of the one before it with the same filling (-1 without)."""
    small_batches(benchmark.sparkSession)
    source = benchmark.select(F.col(f"`{id_col}`").alias("item_id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    @giving_back
    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part, row = TaskContext.get().partitionId(), 0
        names = ["item", "family", "total", "pos", "window", "exact", "width", "slots"]
        kinds = [*[pa.int64()] * 7, pa.list_(pa.struct([("i", pa.int64()), ("prev", pa.int64())]))]
        for b in batches:
            ids, out = [], []
            for k, text in enumerate(b.column("text").to_pylist()):
                row += 1
                chunks = (text or "").split()
                kind, value, at, said = template(chunks)
                n = len(kind)
                if not n:
                    continue
                width = min(WIDTH, n)
                plain, good = windows(kind, value, width)
                good = good & (n >= MIN_WORDS)
                stand = exact_windows(said, at, width)
                whole = n < MIN_EXACT
                shown = np.where(good, plain, mix(stand ^ ~_C1) if whole else stand)
                family = _signed(mix(np.bitwise_xor.reduce(mix(plain + np.arange(len(plain), dtype=np.uint64) * _C1), keepdims=True) ^ np.uint64(n)))[0]
                seen: dict[int, int] = {}
                before = {}
                for i, v in slots(kind, at, chunks, 0, n):
                    before[i] = seen.get(v, -1)
                    seen[v] = i
                for p, (w, e, g) in enumerate(zip(_signed(shown), _signed(stand), good.tolist(), strict=True)):
                    held = [{"i": i, "prev": before[i]} for i in range(p, p + width) if i in before] if g else []
                    ids.append(k)
                    out.append(((part << 33) + row, family, len(plain), p, w, e, width if g else -width, held))
            cols = list(zip(*out, strict=True)) if out else [[]] * 8
            yield pa.record_batch([b.column("item_id").take(pa.array(ids, pa.int64())), *(pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True))], ["item_id", *names])

    kind = source.schema["item_id"].dataType.simpleString()
    return source.mapInArrow(cut, f"item_id {kind}, item long, family long, total long, pos long, window long, exact long, width long, slots array<struct<i: long, prev: long>>")


def _members(items: DataFrame) -> DataFrame:
    rows = items.groupBy("item").agg(F.first("item_id").alias("item_id"), F.first("family").alias("family"), F.bit_xor(F.xxhash64("pos", "exact")).alias("signature"))
    return rows


def families(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, family, same: the items that leaks stands representatives for: the least id of an item's template, and of equal items."""
    rows = _members(written(benchmark_windows(benchmark, id_col, text_col), "items"))
    first = rows.groupBy("family").agg(F.min("item_id").alias("least"))
    same = rows.groupBy("family", "signature").agg(F.min("item_id").alias("same"))
    return rows.join(first, "family").join(same, ["family", "signature"]).select("item_id", F.col("least").alias("family"), "same")


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, family, hits, share, reparameterised: one row for each document and template of items found in it.

    item_id: the least id of the items that stand in the document as they are, or of the family; `families` has the members of both."""
    spark = docs.sparkSession
    small_batches(spark)
    items = written(benchmark_windows(benchmark, item_col, item_text_col), "items")
    size = items.agg(F.count_distinct("window").alias("n"), F.collect_set("width").alias("widths")).first()
    bits = min(MOST_BITS, max(LEAST_BITS, (32 * max(1, size["n"])).bit_length()))
    filter_ = bitmap(items.select(F.pmod(F.col("window"), F.lit(1 << bits)).alias("bit")), 1 << bits)
    shared, widths = spark.sparkContext.broadcast(filter_), sorted(size["widths"] or [])
    mask = np.uint64((1 << bits) - 1)
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    @giving_back
    def find(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        table, part, row = shared.value, TaskContext.get().partitionId(), 0
        names = ["row", "pos", "window", "exact", "slots"]
        kinds = [*[pa.int64()] * 4, pa.list_(pa.struct([("o", pa.int64()), ("v", pa.int64())]))]
        for b in batches:
            ids, out = [], []
            for k, text in enumerate(b.column("text").to_pylist()):
                row += 1
                chunks = (text or "").split()
                if not chunks:
                    continue
                kind, value, at, said = template(chunks)
                stands: dict[int, np.ndarray] = {}
                for width in widths:
                    span = abs(width)
                    if span > len(kind) or (span < MIN_EXACT and span != len(kind)):
                        continue
                    if width > 0:
                        h, good = windows(kind, value, span)
                    else:
                        # an exact window has its item's template: it has too few literal words there as well
                        poor = ~enough_literal(kind, span) if span >= MIN_WORDS else np.ones(len(kind) - span + 1, bool)
                        if not poor.any():
                            continue
                        stands[span] = exact_windows(said, at, span)
                        h, good = mix(stands[span] ^ ~_C1) if span < MIN_EXACT else stands[span], poor
                    bit = (h & mask).astype(np.int64)
                    hit = np.flatnonzero(((table[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1) & good)
                    if len(hit) and span not in stands:
                        stands[span] = exact_windows(said, at, span)
                    for p, w, e in zip(hit.tolist(), _signed(h[hit]), _signed(stands[span][hit]) if len(hit) else [], strict=True):
                        ids.append(k)
                        out.append(((part << 33) + row, p, w, e, [{"o": i - p, "v": v} for i, v in slots(kind, at, chunks, p, span)] if width > 0 else []))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.record_batch([b.column("doc_id").take(pa.array(ids, pa.int64())), *(pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True))], ["doc_id", *names])

    kind = source.schema["doc_id"].dataType.simpleString()
    found = source.mapInArrow(find, f"doc_id {kind}, row long, pos long, window long, exact long, slots array<struct<o: long, v: long>>")
    known = items.groupBy("family", "total", "pos", "window").agg(F.lit(1).alias("known")).withColumnRenamed("pos", "item_pos")
    # what the bit filter let through by chance goes at once
    hits = written(found.join(known.select("window").distinct(), "window", "left_semi"), "hits")
    # A leak has so many of an item's windows that it has one of its rarest: these alone are searched for in documents.
    common = known.groupBy("window").agg(F.count_distinct("family").alias("families"))
    places = known.join(common, "window").groupBy("family", "total", "item_pos").agg(F.max("families").alias("families"))
    rarest = places.withColumn("place", F.row_number().over(Window.partitionBy("family").orderBy("families", "item_pos"))).where(F.col("place") <= F.col("total") - needed(F.col("total")) + 1)
    probes = known.join(rarest.select("family", "item_pos"), ["family", "item_pos"]).select("window", "family", "total", "item_pos")
    at = ["row", "family", "shift"]
    candidates = hits.select("row", "pos", "window").join(probes, "window").select("row", "family", "total", (F.col("pos") - F.col("item_pos")).alias("shift")).distinct()
    # then all windows of a candidate, at the places where they should be
    expected = candidates.withColumn("item_pos", F.explode(F.sequence(F.lit(0).cast("long"), F.col("total") - 1))).withColumn("pos", F.col("item_pos") + F.col("shift"))
    met = expected.join(hits, ["row", "pos"]).join(known.drop("total"), ["family", "item_pos", "window"])
    own = items.groupBy("family", F.col("pos").alias("item_pos"), "exact").agg(F.lit(True).alias("own"))
    aligned = written(met.join(own, ["family", "item_pos", "exact"], "left").select(*at, "total", "doc_id", "item_pos", "exact", "own", "slots"), "aligned")
    sums = aligned.groupBy(*at).agg(
        F.first("doc_id").alias("doc_id"), F.first("total").alias("total"), F.count_distinct("item_pos").alias("hits"),
        F.count_distinct(F.when(F.col("own"), F.col("item_pos"))).alias("standing"), F.bit_xor(F.xxhash64("item_pos", "exact")).alias("signature"),
    )
    enough = sums.where(F.col("hits") >= needed(F.col("total")))
    # slots: the one before with the same filling has to be the one before in an item of the family too
    filled = aligned.select(*at, "item_pos", F.explode("slots").alias("s")).select(*at, (F.col("item_pos") + F.col("s.o")).alias("i"), F.col("s.v").alias("v")).distinct()
    before = F.coalesce(F.lag("i").over(Window.partitionBy(*at, "v").orderBy("i")), F.lit(-1))
    linked = filled.withColumn("prev", before).withColumn("first", F.min("i").over(Window.partitionBy(*at)))
    attested = items.select("family", F.explode("slots").alias("s")).groupBy("family", F.col("s.i").alias("i")).agg(F.collect_set("s.prev").alias("prevs"))
    fits = F.array_contains("prevs", F.col("prev")) | ((F.col("prev") == -1) & F.exists("prevs", lambda p: p < F.col("first")))
    judged = linked.join(attested, ["family", "i"]).groupBy(*at).agg(F.count("*").alias("filled"), F.count_if(fits).alias("fitting"))
    good = enough.join(judged, at, "left").where(F.col("filled").isNull() | (F.col("fitting") > MOST_SLOTS * F.col("filled")) | (F.col("standing") >= needed(F.col("total"))))
    share, stands = F.col("hits") / F.col("total"), F.col("standing") == F.col("hits")
    best = good.groupBy("row", "family").agg(F.first("doc_id").alias("doc_id"), F.max(F.struct("hits", share.alias("share"), stands.alias("same"), "signature")).alias("best"))
    members = _members(items)
    same = members.groupBy("family", "signature").agg(F.min("item_id").alias("same"))
    least = members.groupBy("family").agg(F.min("item_id").alias("least"))
    named = best.withColumn("signature", F.col("best.signature")).join(same, ["family", "signature"], "left").join(least, "family")
    return named.select("doc_id", F.coalesce("same", "least").alias("item_id"), F.col("least").alias("family"), F.col("best.hits").alias("hits"), F.col("best.share").alias("share"), (~F.col("best.same")).alias("reparameterised"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents in which no benchmark item was found, with all their columns."""
    found = written(leaks(docs, benchmark, id_col).select("doc_id").distinct(), "leaks")
    return without(docs, found.select(F.col("doc_id").alias(id_col)), [id_col])

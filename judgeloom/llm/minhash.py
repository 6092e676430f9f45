"""Near-duplicate detection: ProbMinHash over weighted word shingles, banding, verification.

A document's shingles are WIDTH normalised words (lower case, runs of letters and digits), weighted by
their counts. Each shingle is a Poisson process of rate weight whose arrivals fall on random
registers; a register keeps its earliest arrival, and a shingle stops once no later arrival can win. Two
documents agree in a register with their probability Jaccard similarity.

Texts are first reduced to distinct ones. Bands of registers name buckets. In each bucket a leader is compared with
the others, over two rounds with finer buckets (two bands together) first - leaders are the texts that meet most texts of
other components, the middles of groups - which contracts groups of near copies into components. Before an exact
comparison a pair has to agree in so many registers (four bits of each) as all but one in some ten thousand pairs
of THRESHOLD would.

Texts of buckets that still hold several components are compared by their differences. Texts that such buckets connect
form a cell; a cell's support are the shingles of most texts of a sample of it, and a text's difference D are the shingles that it
has outside the support or lacks of it. With T the count of all shingles of a text, probability Jaccard of THRESHOLD or more implies that
|D(x) xor D(y)| is at most SPREAD * max(T(x), T(y)): if a is the weight of x outside y and b that of y outside x, it is
(1 - a)(1 - b) / (1 - ab) at most, so a + b <= SPREAD, and each shingle of x outside y weighs 1 / T(x) or more. Sorted from
rare to frequent (by the sample; any fixed order is exact), two such differences share an element whose places leave room for that, or both are so short that they
needn't share one (`_close`). Copies that drift from one original differ from each other in rare shingles, so few pairs meet. The sample
steers the work and not the result; no candidate is dropped and no group of copies is expanded into all pairs.

A pair is linked if its exact probability Jaccard is THRESHOLD or more; texts without repeated shingles have the plain Jaccard
of their sets. Classes are the connected components, found by contraction of tables.

Cases: a null text is a class of its own; equal texts (empty ones too) are one class; a text of fewer than WIDTH
words is one shingle; a text without words meets equal texts only; repeated rows are copies; an
empty table gives no rows; very long texts are shingled whole; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bit_column, bit_filter, giving_back, hashed, maybe, mix, small_batches, without, written

WIDTH, THRESHOLD = 5, 0.8
BANDS, ROWS = 25, 5
REGISTERS = BANDS * ROWS
#: Registers, by four bits each, that a pair has to agree in: four standard deviations below what THRESHOLD gives.
_CHANCE = THRESHOLD + (1 - THRESHOLD) / 16
AGREE = int(REGISTERS * _CHANCE - 4 * (REGISTERS * _CHANCE * (1 - _CHANCE)) ** 0.5)
SKETCH = 8  # words of 64 bits
#: Two texts of THRESHOLD differ in at most so large a part of their shingles, counted on both sides.
SPREAD = 2 * (1 - THRESHOLD) / (1 + THRESHOLD) + 1e-9
#: Texts of a cell that tell its support and how frequent differences are.
SAMPLE = 64
#: Texts of one part of a cell: a cell has as many parts as that takes, so that no task takes a hot cell alone.
PART = 4096

_word = re.compile(r"\w+")
_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03), np.uint64(0x8CB92BA72F3D8DD7)


def shingles(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes in order, and their counts."""
    w = hashed(_word.findall(text.lower()))
    if not len(w):
        return w, np.zeros(0, np.int64)
    span = min(WIDTH, len(w))
    h = np.full(len(w) - span + 1, np.uint64(span))
    for j in range(span):
        h = (h ^ w[j : len(w) - span + 1 + j]) * _C1
        h ^= h >> np.uint64(32)
    return np.unique(mix(h), return_counts=True)


def signatures(documents: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """REGISTERS winning shingles of each document (documents without shingles keep zeros)."""
    n = len(documents)
    sizes = np.array([len(h) for h, _ in documents], np.int64)
    best, winner = np.full(n * REGISTERS, np.inf), np.zeros(n * REGISTERS, np.uint64)
    limit = np.where(sizes > 0, np.inf, -1.0)
    if not sizes.sum():
        return winner.reshape(n, REGISTERS)
    element = np.concatenate([h for h, _ in documents])
    rate = 1 / np.concatenate([c for _, c in documents]).astype(np.float64)
    doc = np.repeat(np.arange(n), sizes)
    time, arrival = np.zeros(len(element)), 0
    while len(element):
        # one arrival of each process, or several at once when few processes are left
        block = 1 if len(element) > 4096 else 8
        numbers = (np.arange(arrival + 1, arrival + block + 1, dtype=np.uint64) * _C2)[None, :]
        r = mix(element[:, None] ^ numbers)
        gap = -np.log(((r >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) * rate[:, None]
        times = time[:, None] + np.cumsum(gap, axis=1)
        slot = doc[:, None] * REGISTERS + ((mix(r ^ _C3) >> np.uint64(32)) * np.uint64(REGISTERS) >> np.uint64(32)).astype(np.int64)
        useful = times < limit[doc][:, None]
        t, s, e = times[useful], slot[useful], np.broadcast_to(element[:, None], times.shape)[useful]
        np.minimum.at(best, s, t)
        won = best[s] == t
        winner[s[won]] = e[won]
        limit = np.where(sizes > 0, best.reshape(n, REGISTERS).max(axis=1), -1.0)
        time, arrival = times[:, -1], arrival + block
        open_ = time < limit[doc]
        element, rate, doc, time = element[open_], rate[open_], doc[open_], time[open_]
    return winner.reshape(n, REGISTERS)


def bands(signature: np.ndarray) -> np.ndarray:
    """BANDS bucket names of each signature."""
    parts = signature.reshape(len(signature), BANDS, ROWS)
    h = np.broadcast_to((np.arange(1, BANDS + 1, dtype=np.uint64) * _C2)[None, :], parts.shape[:2])
    for j in range(ROWS):
        h = mix(h * _C1 ^ parts[:, :, j])
    return h.view(np.int64)


def sketches(signature: np.ndarray) -> np.ndarray:
    """Four bits of each register, 16 registers a 64-bit word; unused places stay zero."""
    four = mix(signature ^ _C3) >> np.uint64(60)
    wide = np.zeros((len(signature), SKETCH * 16), np.uint64)
    wide[:, :REGISTERS] = four
    shift = np.arange(16, dtype=np.uint64) * np.uint64(4)
    return np.bitwise_or.reduce(wide.reshape(len(signature), SKETCH, 16) << shift, axis=2).view(np.int64)


def _agreeing(x: str, y: str) -> Column:
    """Registers whose four bits agree, of the sketch columns s0, s1, ... of two aliases."""
    ones = F.lit(0x1111111111111111)
    total = F.lit(REGISTERS)
    for k in range(SKETCH):
        d = F.col(f"{x}.s{k}").bitwiseXOR(F.col(f"{y}.s{k}"))
        folded = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        folded = folded.bitwiseOR(F.shiftrightunsigned(folded, 2))
        total = total - F.bit_count(folded.bitwiseAND(ones))
    return total


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact probability Jaccard of two weighted shingle sets (hashes ascending)."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if len(a[0]) == a[1].sum() and len(b[0]) == b[1].sum() or not len(i):
        return len(i) / (len(a[0]) + len(b[0]) - len(i))
    wa, wb = a[1][i].astype(np.float64), b[1][j].astype(np.float64)
    order = np.argsort(wa / wb)
    wa, wb = wa[order], wb[order]
    only_a, only_b = a[1].sum() - wa.sum(), b[1].sum() - wb.sum()
    # shared shingles of a larger ratio count by their weight in a, the others by their weight in b
    above = only_a + np.cumsum(wa[::-1])[::-1] - wa
    below = only_b + np.cumsum(wb)
    return float((1 / (above / wa + below / wb)).sum())


def node_of(text: Column) -> Column:
    """128-bit name of a text."""
    return F.unhex(F.md5(text))


def _sources(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(f"`{text_col}`").cast("string")
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), node_of(text).alias("node"), text.alias("text"))


#: Shingles that are signed at once.
PART = 100_000


def _parts(cut: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[list[tuple[np.ndarray, np.ndarray]]]:
    """Shingled documents in lists of PART shingles, or of one document."""
    part, size = [], 0
    for found in cut:
        if part and size + len(found[0]) > PART:
            yield part
            part, size = [], 0
        part.append(found)
        size += len(found[0])
    if part:
        yield part


def _banded(rows: DataFrame) -> DataFrame:
    @giving_back
    def sign(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            named, drawn = [], []
            for part in _parts(shingles(t.as_py()) for t in b.column("text")):
                signed = signatures(part)
                named += [x if len(f[0]) else [] for x, f in zip(bands(signed).tolist(), part, strict=True)]
                drawn += sketches(signed).tolist()
            yield pa.record_batch([b.column("doc_id"), b.column("node"), pa.array(named, pa.list_(pa.int64())), pa.array(drawn, pa.list_(pa.int64()))], ["doc_id", "node", "bands", "sketch"])

    return rows.mapInArrow(sign, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, node binary, bands array<long>, sketch array<long>")


def _shingled(rows: DataFrame, bits: np.ndarray) -> DataFrame:
    """The shingles of the rows whose node may be in the bitmap."""

    @giving_back
    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            at = b.column("bit").to_numpy()
            b = b.filter(pa.array((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1))
            found = [shingles(t.as_py()) for t in b.column("text")]
            yield pa.record_batch([b.column("doc_id"), b.column("node"), pa.array([h.view(np.int64) for h, _ in found], pa.list_(pa.int64())), pa.array([c.astype(np.int32) for _, c in found], pa.list_(pa.int32()))], ["doc_id", "node", "hashes", "counts"])

    return rows.withColumn("bit", bit_column(["node"], bits)).mapInArrow(cut, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, node binary, hashes array<long>, counts array<int>")


def _alike(pairs: DataFrame, sketched: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sketches agree in AGREE registers or more."""
    met = pairs.join(sketched.alias("x"), F.col("a") == F.col("x.node")).join(sketched.alias("y"), F.col("b") == F.col("y.node"))
    return met.where(_agreeing("x", "y") >= AGREE).select("a", "b")


def _verified(pairs: DataFrame, cut: DataFrame, name: str) -> DataFrame:
    """The pairs (a, b) of nodes that are similar enough, with their similarity."""
    one = cut.select(F.col("node").alias("a"), F.col("hashes").alias("ha"), F.col("counts").alias("ca"))
    two = cut.select(F.col("node").alias("b"), F.col("hashes").alias("hb"), F.col("counts").alias("cb"))

    @giving_back
    def compare(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            values = [batch.column(c) for c in ("ha", "ca", "hb", "cb")]
            out = []
            for k in range(batch.num_rows):
                ha, ca, hb, cb = (v[k].values.to_numpy() for v in values)
                out.append(similarity((ha.view(np.uint64), ca), (hb.view(np.uint64), cb)))
            keep = pa.array([s >= THRESHOLD for s in out], pa.bool_())
            yield pa.record_batch([batch.column("a"), batch.column("b"), pa.array(out, pa.float64())], ["a", "b", "similarity"]).filter(keep)

    met = pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "ha", "ca", "hb", "cb")
    return written(met.mapInArrow(compare, "a binary, b binary, similarity double"), name, few=True)


def merged(labels: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """labels (node, label) after joining the components that links (a, b) connect: repeated contraction to the least neighbour."""
    ends = lambda c, to: labels.select(F.col("node").alias(c), F.col("label").alias(to))
    between = links.select("a", "b").join(ends("a", "x"), "a").join(ends("b", "y"), "b").where("x != y").select("x", "y").distinct()
    between = written(between, f"{name}-edges", few=True)
    jumps, held = None, []
    while not between.isEmpty():
        both = between.unionByName(between.select(F.col("y").alias("x"), F.col("x").alias("y")))
        parent = both.groupBy("x").agg(F.min("y").alias("least")).select("x", F.least("x", "least").alias("up"))
        # two jumps a step shorten chains of components
        far = parent.alias("p").join(parent.select(F.col("x").alias("via"), F.col("up").alias("top")), F.col("p.up") == F.col("via"), "left").select("x", F.coalesce("top", "up").alias("up")).persist()
        held.append(far)
        up = lambda c: far.select(F.col("x").alias(c), F.col("up").alias(f"up_{c}"))  # noqa: B023, E731
        between = written(between.join(up("x"), "x").join(up("y"), "y").where("up_x != up_y").select(F.col("up_x").alias("x"), F.col("up_y").alias("y")).distinct(), f"{name}-edges{len(held)}", few=True)
        # a later label is an image of an earlier one
        jumps = far if jumps is None else jumps.join(far.select(F.col("x").alias("up"), F.col("up").alias("on")), "up", "left").select("x", F.coalesce("on", "up").alias("up"))
    if held:
        labels = written(labels.join(jumps.withColumnRenamed("x", "label"), "label", "left").select("node", F.coalesce("up", "label").alias("label")), f"{name}-labels", few=True)
    for far in held:
        far.unpersist()
    return labels


def _shared(dealt: DataFrame) -> DataFrame:
    """The rows (node, bucket) of buckets with several nodes."""
    several = dealt.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    return dealt.join(several, "bucket").select("bucket", "node")


def _differences(open_: DataFrame, cut: DataFrame) -> DataFrame:
    """node, label, cell, size, total, top, elements of every text of open_ (bucket, node, label): its difference from its cell's support, rare elements first."""
    hub = open_.groupBy("bucket").agg(F.min("node").alias("b"))
    edges = open_.join(hub, "bucket").where("node != b").select(F.col("node").alias("a"), "b").distinct()
    nodes = written(open_.select("node", "label").distinct(), "open-nodes", few=True)
    cells = merged(nodes.select("node", F.col("node").alias("label")), edges, "cells").withColumnRenamed("label", "cell")
    parts = cells.groupBy("cell").agg(F.ceil(F.count("*") / PART).cast("long").alias("parts"))
    salt = F.pmod(F.xxhash64("node"), F.col("parts")).alias("salt")
    dealt = written(nodes.join(cells, "node").join(parts, "cell").join(cut, "node").select("node", "label", "cell", salt, "hashes", "counts", F.aggregate("counts", F.lit(0).cast("long"), lambda s, c: s + c).alias("total")), "cells-dealt", few=True)
    place = F.row_number().over(Window.partitionBy("cell").orderBy(F.md5("node")))
    sample = dealt.select("cell", "node").withColumn("place", place).where(F.col("place") <= SAMPLE).select("node")
    seen = dealt.join(sample, "node").select("cell", F.explode("hashes").alias("hash")).groupBy("cell", "hash").agg(F.count("*").cast("int").alias("times"))
    seen = seen.where("times > 1").groupBy("cell").agg(F.collect_list(F.struct("hash", "times")).alias("seen"))
    tops = dealt.groupBy("cell").agg(F.max("total").alias("top"), F.least(F.count("*"), F.lit(SAMPLE)).cast("int").alias("drawn"))
    about = tops.join(seen, "cell", "left").select("cell", "top", "drawn", F.col("seen.hash").alias("known"), F.col("seen.times").alias("times"))
    # a cell's support is sent to the parts of the cell that exist
    about = dealt.select("cell", "salt").distinct().join(about, "cell")

    @giving_back
    def differ(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            out = []
            for k in range(b.num_rows):
                own = np.sort(b.column("hashes")[k].values.to_numpy().view(np.uint64))
                known, times = b.column("known")[k].values, b.column("times")[k].values
                known, times = (np.zeros(0, np.uint64), np.zeros(0, np.int32)) if known is None else (known.to_numpy().view(np.uint64), times.to_numpy())
                out.append(difference(own, known, times, b.column("drawn")[k].as_py()).view(np.int64))
            made = pa.array(out, pa.list_(pa.int64()))
            yield pa.record_batch([*(b.column(c) for c in ("node", "label", "cell", "total", "top")), pa.array([len(d) for d in out], pa.int32()), made], ["node", "label", "cell", "total", "top", "size", "elements"])

    met = dealt.join(about, ["cell", "salt"]).select("node", "label", "cell", "total", "top", "drawn", "hashes", "known", "times")
    return written(met.mapInArrow(differ, "node binary, label binary, cell binary, total long, top long, size int, elements array<long>"), "differences", few=True)


def difference(own: np.ndarray, known: np.ndarray, times: np.ndarray, drawn: int) -> np.ndarray:
    """Elements of own outside the support and of the support outside own, from rare to frequent: known shingles occur times in drawn texts."""
    order = np.argsort(known)
    known, times = known[order], times[order]
    found = np.setxor1d(own, known[2 * times > drawn], assume_unique=True)
    if not len(known):
        return found
    at = np.minimum(np.searchsorted(known, found), len(known) - 1)
    often = np.where(known[at] == found, times[at], 0)
    return found[np.lexsort((found, np.where(2 * often > drawn, drawn - often, often)))]


def _sharing(differences: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components whose differences share an element early enough."""
    dealt = differences.select("node", "label", "size", "total", "top", F.posexplode("elements").alias("place", "element"), "cell").select("*", F.xxhash64("cell", "element").alias("key")).drop("cell", "element")
    room = F.lit(SPREAD) * F.greatest("x.total", "y.total")
    # the longer difference is read as far as any shorter one may ask, the shorter one to half the room
    long = dealt.where(2 * F.col("place") <= F.col("size") + SPREAD * F.col("top")).drop("top").alias("x")
    short = dealt.where(2 * F.col("place") <= SPREAD * F.col("top")).drop("top").alias("y")
    longer = (F.col("x.size") > F.col("y.size")) | (F.col("x.size") == F.col("y.size")) & (F.col("x.node") > F.col("y.node"))
    early = (2 * F.col("x.place") <= F.col("x.size") - F.col("y.size") + room) & (2 * F.col("y.place") <= F.col("y.size") - F.col("x.size") + room)
    met = long.join(short, (F.col("x.key") == F.col("y.key")) & (F.col("x.label") != F.col("y.label")) & longer & early)
    return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def _close(differences: DataFrame, sketched: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components that are so short together that they need not share an element."""
    short = differences.where(F.col("size") <= SPREAD * F.col("top")).select("node", "label", "cell", "size", "total")
    sizes = short.groupBy("cell", "label").agg(F.count("*").alias("n"))
    main = sizes.groupBy("cell").agg(F.max(F.struct("n", "label")).alias("main"), F.count("*").alias("kinds"), F.ceil(F.sum("n") / PART).cast("long").alias("parts")).where("kinds > 1").select("cell", F.col("main.label").alias("main"), "parts")
    rows = short.join(main, "cell").join(sketched, "node").withColumn("minor", F.col("label") != F.col("main")).drop("main")
    # one of the two is outside the component that most texts of the cell are in
    # these few are sent to every part of their cell, and all are dealt to one
    x = rows.where("minor").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).alias("x")
    y = rows.withColumn("salt", F.pmod(F.xxhash64("node"), F.col("parts"))).alias("y")
    room = F.lit(SPREAD) * F.greatest("x.total", "y.total")
    both = (F.col("x.cell") == F.col("y.cell")) & (F.col("x.salt") == F.col("y.salt")) & (F.col("x.label") != F.col("y.label")) & (F.col("x.size") + F.col("y.size") <= room)
    once = ~F.col("y.minor") | (F.col("x.node") < F.col("y.node"))
    return x.join(y, both & once & (_agreeing("x", "y") >= AGREE)).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Tables node, doc_id (its least), class_node, class_id; and the verified links between different texts."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = _sources(docs, id_col, text_col).where(F.col("node").isNotNull())
    distinct = written(_banded(rows).groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("bands").alias("bands"), F.max("sketch").alias("sketch")), "distinct", few=True)
    multi = written(_shared(distinct.select("node", F.explode("bands").alias("bucket"))), "buckets", few=True)
    nodes = multi.select("node").distinct()
    labels = nodes.select("node", F.col("node").alias("label"))
    needed = labels.select("node").join(distinct.select("node", "doc_id", "bands", "sketch"), "node")
    needed = written(needed.select("node", "doc_id", "bands", *(F.col("sketch")[k].alias(f"s{k}") for k in range(SKETCH))), "candidates", few=True)
    # the bit filter keeps documents without any candidate out of the shuffle; the join settles the rest
    cut = _shingled(rows, bit_filter(labels, ["node"]))
    cut = written(cut.alias("c").join(needed.select("node", "doc_id").alias("n"), (F.col("c.node") == F.col("n.node")) & F.col("c.doc_id").eqNullSafe(F.col("n.doc_id"))).select("c.node", "hashes", "counts").dropDuplicates(["node"]), "shingles", few=True)
    sketched = needed.drop("doc_id", "bands")
    # buckets of two bands together hold closer texts
    double = F.transform("bands", lambda x, i: F.xxhash64(x, F.element_at("bands", F.pmod(i + 1, F.lit(BANDS)) + 1), i))
    fine = written(_shared(needed.select("node", F.explode(double).alias("bucket"))), "fine", few=True)
    links = None
    for step, buckets in enumerate((fine, multi)):
        held = buckets.join(labels, "node")
        # the text that meets most others of other components over all its buckets is the likeliest middle of a group
        sizes = held.groupBy("bucket", "label").agg(F.count("*").alias("own"))
        whole = sizes.groupBy("bucket").agg(F.sum("own").alias("all"), F.count("*").alias("kinds")).where("kinds > 1")
        others = sizes.join(whole, "bucket").select("bucket", "label", (F.col("all") - F.col("own")).alias("others"))
        held = held.join(others, ["bucket", "label"]).persist()
        meets = held.groupBy("node").agg(F.sum("others").alias("meets"))
        order = F.unhex(F.md5(F.concat(F.lit(f"{step}").cast("binary"), "node")))
        lead = F.max(F.struct("meets", order.alias("o"), "node", "label")).alias("lead")
        lead = held.join(meets, "node").groupBy("bucket").agg(lead).select("bucket", F.col("lead.node").alias("leader"), F.col("lead.label").alias("leader_label"))
        met = held.join(lead, "bucket").where("label != leader_label")
        found = _verified(_alike(met.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct(), sketched), cut, f"links{step}")
        held.unpersist()
        labels = merged(labels, found, f"merge{step}")
        links = found if links is None else links.unionByName(found)
    held = multi.join(labels, "node")
    several = held.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select("bucket")
    apart = _differences(written(held.join(several, "bucket").select("bucket", "node", "label"), "open", few=True), cut)
    pairs = _alike(_sharing(apart), sketched).unionByName(_close(apart, sketched))
    found = _verified(pairs.distinct(), cut, "links")
    labels, links = merged(labels, found, "merge"), links.unionByName(found)
    placed = distinct.select("node", "doc_id").join(labels, "node", "left").select("node", "doc_id", F.coalesce("label", "node").alias("label"))
    first = placed.groupBy("label").agg(F.min(F.struct("doc_id", "node")).alias("first")).select("label", F.col("first.doc_id").alias("class_id"), F.col("first.node").alias("class_node"))
    return written(placed.join(first, "label").select("node", "doc_id", "class_id", "class_node"), "classes", few=True), links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id, kept, links of every document: class_id is the least doc_id of its class, kept marks that document.

    links: how many different texts its text was compared with exactly and found alike; these links hold the classes together (`classes` has them with their similarities)."""
    found, linked = classes(docs, id_col, text_col)
    ends = linked.select(F.col("a").alias("node")).unionByName(linked.select(F.col("b").alias("node")))
    degrees = ends.groupBy("node").agg(F.count("*").alias("links"))
    found = found.join(degrees, "node", "left").withColumn("links", F.coalesce("links", F.lit(0).cast("long")))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), node_of(F.col(f"`{text_col}`").cast("string")).alias("node"))
    own = rows.where(F.col("node").isNull()).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("links"))
    placed = rows.join(found.select("node", "class_id", "links"), "node").select("doc_id", "class_id", "links")
    return placed.unionByName(own).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each class, with all its columns; documents with a null text stay."""
    found, _ = classes(docs, id_col, text_col)
    text = F.col(f"`{text_col}`").cast("string")
    named = docs.withColumn("__node", node_of(text)).withColumn("__id", F.col(f"`{id_col}`"))
    copies = _sources(docs, id_col, text_col).select("node", "doc_id").where("node is not null").groupBy("node", "doc_id").agg(F.count("*").alias("n"))
    judged = copies.join(found.select("node", F.col("doc_id").alias("best"), "class_node"), "node")
    wins = (F.col("node") == F.col("class_node")) & F.col("doc_id").eqNullSafe(F.col("best"))
    judged = written(judged.select(F.col("node").alias("__node"), F.col("doc_id").alias("__id"), wins.alias("wins"), "n"), "judged", few=True)
    kept = without(named, judged.where("not wins or n > 1"), ["__node", "__id"])
    # repeated rows of a winner: the largest one, as JSON, comes back
    again = judged.where("wins and n > 1").select(F.col("__node").alias("__again"), F.col("__id").alias("__again_id"))
    near = maybe(named, bit_filter(again.select(F.col("__again").alias("__node"), F.col("__again_id").alias("__id")), ["__node", "__id"]), ["__node", "__id"])
    met = near.join(again, (F.col("__node") == F.col("__again")) & F.col("__id").eqNullSafe(F.col("__again_id")))
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    one = met.groupBy("__again", "__again_id").agg(F.max_by(whole, F.to_json(whole)).alias("__one"))
    return kept.select(*docs.columns).unionByName(one.select("__one.*"))

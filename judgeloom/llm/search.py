"""Ranked lexical search by block-max WAND over an inverted index in segments.

`index` cuts the documents into segments (a task closes one at MOST postings) and writes, per segment and term, one posting list: document
numbers and counts in blocks of BLOCK postings, each block coded with as few bytes a number as its largest gap and count need,
with its last document and its maximum impact beside it. A segment's own row has its documents' ids and length norms. Impacts
are integers that depend on a posting and on the corpus' mean length, which a first pass over all documents finds; a query multiplies them by its
term's weight.

`search` brings the posting lists of the queries' terms together by segment. In a segment, a query's lists move together from document to document: shallow moves
read only the blocks' last documents, the maxima of the blocks they point at add up to a bound for all documents up to the nearest block end, and
where that is below the query's threshold - the k-th best score its task has seen so far, over all its segments - the lists move
on without decompression. Other stretches are decompressed (a block once for all queries) and scored, stretches of one
query at a time in NumPy. Equal scores aren't skipped, so the result is exact: the same as if every document were scored.
Tasks return their k best a query, and a ranking merges them.

Cases: null and empty texts, and documents without a term, rank nowhere and don't count; a query without a known term returns nothing; a term counts
once in a query; very long texts are read whole; repeated rows are ranked each; ties go to the smaller id, null ids first; an empty table on either side gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import giving_back, small_batches, written

K = 10
#: Postings of a block; postings at which a segment is closed; distinct terms of the queries that are searched for at once.
BLOCK, MOST, TERMS = 128, 2_000_000, 200_000
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII: letters in lower case and digits stay, anything else parts terms. Bytes of other characters belong to terms.
_table = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_C = 1_000_000_000


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_table).split()


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (_C * tf) // (1000 * tf + 8 * m)


def norm(n: np.ndarray, documents: int, length: int) -> np.ndarray:
    return 10 + (90 * n * documents) // max(1, length)


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


class Ids(dict):
    """term -> number, in order of appearance."""

    def __missing__(self, term: bytes) -> int:
        self[term] = n = len(self)
        return n


def _width(most: np.ndarray) -> np.ndarray:
    """Bytes that numbers up to most need."""
    return 1 + (most > 0xFF).astype(np.int64) + (most > 0xFFFF) + (most > 0xFFFFFF)


def _packed(values: np.ndarray, width: np.ndarray, at: np.ndarray, out: np.ndarray) -> None:
    """Write each number with its width, little-endian, at its place."""
    for k in range(4):
        some = width > k
        if some.any():
            out[at[some] + k] = (values[some] >> (8 * k)) & 0xFF


def _unpacked(raw: np.ndarray, width: int) -> np.ndarray:
    parts = raw.reshape(-1, width).astype(np.int64)
    return parts @ (1 << (8 * np.arange(width, dtype=np.int64)))


def blocks(term: np.ndarray, doc: np.ndarray, tf: np.ndarray, gain: np.ndarray) -> dict[str, np.ndarray]:
    """Posting lists of (term, doc)-sorted postings: offsets of lists, of blocks and of bytes, and the blocks themselves."""
    first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
    sizes = np.diff(np.append(first, len(term)))
    place = np.arange(len(term)) - np.repeat(first, sizes)
    head = place % BLOCK == 0
    starts = np.flatnonzero(head)
    count = np.diff(np.append(starts, len(term)))
    gap = np.where(place == 0, doc, doc - np.concatenate([[0], doc[:-1]]))
    block = np.cumsum(head) - 1
    wide_gap, wide_tf = _width(np.maximum.reduceat(gap, starts)), _width(np.maximum.reduceat(tf, starts))
    end = np.cumsum(1 + count * (wide_gap + wide_tf))
    begin = np.concatenate([[0], end[:-1]])
    out = np.zeros(end[-1], np.uint8)
    out[begin] = wide_gap * 16 + wide_tf
    inside = np.arange(len(term)) - starts[block]
    _packed(gap, wide_gap[block], begin[block] + 1 + inside * wide_gap[block], out)
    _packed(tf, wide_tf[block], begin[block] + 1 + (count * wide_gap)[block] + inside * wide_tf[block], out)
    lists = np.append(np.searchsorted(starts, first), len(starts))
    return {"term": term[first], "df": sizes, "lists": lists, "last": doc[starts + count - 1], "most": np.maximum.reduceat(gain, starts), "end": end - np.repeat(np.append(0, end)[lists[:-1]], np.diff(lists)), "bytes": np.append(0, end)[lists], "data": out}


def unblocked(data: np.ndarray, before: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents and counts of one block; before: the last document of the block before, or 0."""
    a, b = int(data[0]) >> 4, int(data[0]) & 15
    n = (len(data) - 1) // (a + b)
    return np.cumsum(_unpacked(data[1 : 1 + n * a], a)) + before, _unpacked(data[1 + n * a :], b)


SEGMENT = "segment string, term binary, df long, last array<int>, most array<int>, ends array<int>, data binary"
FIELDS = ["segment", "term", "df", "last", "most", "ends", "data"]
#: Posting lists of one Arrow batch.
ROWS = 20_000


def sizes(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """How many documents have a term, and how many terms all have together."""
    n = F.regexp_count(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), F.lit(TERM)).cast("long")
    got = docs.select(n.alias("n")).agg(F.count_if(F.col("n") > 0).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
    return got["documents"], got["length"]


def index(docs: DataFrame, documents: int, length: int, id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> DataFrame:
    """Posting lists of every term by segment; a segment's row without a term has its documents' ids and norms."""
    small_batches(docs.sparkSession)
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).where("text is not null")

    @giving_back
    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        task, number = TaskContext.get().partitionId(), 0
        ids, lengths, parts, held, known = [], [], [], 0, Ids()

        def close() -> Iterator:
            n = np.array(lengths, np.int64)
            norms = norm(n, documents, length)
            key, tf = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
            order = np.argsort(key, kind="stable")
            key, tf = key[order], tf[order].astype(np.int64)
            term, doc = (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
            made = blocks(term, doc, tf, impact(tf, norms[doc]))
            name, words = f"{task}-{number}", np.array(list(known), object)
            rows = len(made["term"])
            ints = lambda x: pa.ListArray.from_arrays(pa.array(made["lists"], pa.int32()), pa.array(x, pa.int32()))
            data = pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(made["bytes"].astype(np.int32).tobytes()), pa.py_buffer(made["data"].tobytes())])
            columns = [pa.array([name] * rows), pa.array(words[made["term"]].tolist(), pa.binary()), pa.array(made["df"], pa.int64()), ints(made["last"]), ints(made["most"]), ints(made["end"]), data]
            whole = pa.record_batch(columns, FIELDS)
            for a in range(0, rows, ROWS):
                yield whole.slice(a, ROWS)
            none = pa.array([None], pa.list_(pa.int32()))
            yield pa.record_batch([pa.array([name]), pa.array([None], pa.binary()), pa.array([len(n)], pa.int64()), none, none, none, pa.array([documents_row(ids, norms)], pa.binary())], FIELDS)

        for b in batches:
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
                words = terms_of(text)
                if not words:
                    continue
                term, tf = np.unique(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)), return_counts=True)
                parts.append(((term << np.uint64(32)) | np.uint64(len(ids)), tf.astype(np.int32)))
                ids.append(i), lengths.append(len(words))
                held += len(term)
                if held >= most:
                    yield from close()
                    number += 1
                    ids, lengths, parts, held, known = [], [], [], 0, Ids()
        if ids:
            yield from close()

    return source.mapInArrow(cut, SEGMENT)


def documents_row(ids: list[int | None], norms: np.ndarray) -> bytes:
    """A segment's documents: whether there is an id, ids, norms."""
    return bytes(i is not None for i in ids) + np.array([i or 0 for i in ids], np.int64).tobytes() + norms.astype(np.int64).tobytes()


def documents_of(data: bytes) -> tuple[list[int | None], np.ndarray]:
    n = len(data) // 17
    numbers = np.frombuffer(data[n:], np.int64)
    return [i if known else None for known, i in zip(data[:n], numbers[:n].tolist(), strict=True)], numbers[n:]


class Postings:
    """One term's list in a segment: blocks are decompressed when they are asked for, and kept while the segment lasts."""

    def __init__(self, last: list[int], most: list[int], ends: list[int], data: bytes, norms: np.ndarray):
        self.last, self.most = np.array(last, np.int64), np.array(most, np.int64)
        self.starts, self.data, self.norms = [0, *ends], np.frombuffer(data, np.uint8), norms
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of block k."""
        if k not in self.open:
            doc, tf = unblocked(self.data[self.starts[k] : self.starts[k + 1]], int(self.last[k - 1]) if k else 0)
            self.open[k] = doc, impact(tf, self.norms[doc])
        return self.open[k]


def best_of(lists: list[tuple[Postings, int]], n: int, threshold: int, found: list[tuple], names: list[int | None], k: int) -> int:
    """Offer a segment's documents for one query to found, a heap of the k best; returns the threshold after it.

    lists: posting lists of the query's terms with the terms' weights; n: documents of the segment."""
    if not lists:
        return threshold
    # shallow moves: where any list's block ends, the sum of the blocks' maxima changes
    ends = np.unique(np.concatenate([p.last for p, _ in lists]))
    at = [np.searchsorted(p.last, ends) for p, _ in lists]
    bound = np.zeros(len(ends), np.int64)
    for (p, w), a in zip(lists, at, strict=True):
        inside = a < len(p.last)
        bound[inside] += w * p.most[a[inside]]
    scores = np.zeros(n, np.int64)
    done = 0
    while done < len(ends):
        # the next stretches that can reach the threshold, a few more each time
        going = np.flatnonzero(bound[done:] >= max(1, threshold))[: 64 if threshold else 8] + done
        if not len(going):
            break
        done = int(going[-1]) + 1
        low, high = int(ends[going[0] - 1]) + 1 if going[0] else 0, int(ends[going[-1]]) + 1
        for (p, w), a in zip(lists, at, strict=True):
            for b in np.unique(a[going]).tolist():
                if b < len(p.last):
                    doc, gain = p.block(b)
                    x, y = np.searchsorted(doc, [low, high])
                    scores[doc[x:y]] += w * gain[x:y]
        # documents between the stretches have parts of scores below the threshold
        here = scores[low:high]
        for d in np.flatnonzero(here >= max(1, threshold)).tolist():
            i = names[low + d]
            offered = (int(here[d]), i is None, -i if i is not None else 0)
            if len(found) < k:
                heapq.heappush(found, offered)
            elif offered > found[0]:
                heapq.heapreplace(found, offered)
        if len(found) == k:
            threshold = max(threshold, found[0][0])
    return threshold


def search(segments: DataFrame, documents: int, queries: DataFrame, k: int = K, id_col: str = "item_id", text_col: str = "text", most: int = TERMS) -> DataFrame:
    """The id, rank, doc_id, score of the k best documents of every query, over segments written by index for so many documents with a term.

    Queries go to the tasks in groups with at most so many distinct terms together (one query at least)."""
    spark = segments.sparkSession
    small_batches(spark, ROWS)
    said = F.translate(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), _UPPER, _LOWER)
    terms = F.transform(F.array_distinct(F.regexp_extract_all(said, F.lit(TERM), F.lit(0))), lambda t: t.cast("binary"))
    asked = written(queries.select(F.col(f"`{id_col}`").alias("__id"), terms.alias("terms"), F.monotonically_increasing_id().alias("query")), "queries")
    held: list[tuple[int, list[bytes]]] = []
    distinct: set[bytes] = set()
    found = None
    for row in asked.where(F.size("terms") > 0).select("query", "terms").toLocalIterator():
        own = [bytes(t) for t in row["terms"]]
        if held and len(distinct.union(own)) > most:
            part = written(_search(segments, documents, held, distinct, k), "found")
            found = part if found is None else found.unionByName(part)
            held, distinct = [], set()
        held.append((row["query"], own))
        distinct.update(own)
    part = _search(segments, documents, held, distinct, k)
    found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(asked.select("query", "__id"), "query").select(F.col("__id").alias(id_col), "rank", "doc_id", "score")


def _search(segments: DataFrame, documents: int, queries: list[tuple[int, list[bytes]]], distinct: set[bytes], k: int) -> DataFrame:
    """query, doc_id, score: the best documents of every task, for queries with their terms."""
    spark = segments.sparkSession
    wanted = spark.createDataFrame([(bytearray(t),) for t in sorted(distinct)], "term binary")
    hits = segments.where("term is not null").join(F.broadcast(wanted), "term", "left_semi").select(*FIELDS)
    df = {bytes(r["term"]): weight(documents, r["df"]) for r in hits.groupBy("term").agg(F.sum("df").alias("df")).collect()}
    weighed = [(q, [(t, df[t]) for t in terms if df.get(t, 0) > 0]) for q, terms in queries]
    shared = spark.sparkContext.broadcast([(q, terms) for q, terms in weighed if terms])

    @giving_back
    def find(batches: Iterator) -> Iterator:
        import pyarrow as pa

        best: dict[int, list[tuple]] = {q: [] for q, _ in shared.value}
        threshold = dict.fromkeys(best, 0)
        names, norms, lists = [], None, {}

        def close() -> None:
            for q, terms in shared.value:
                own = [(lists[t], w) for t, w in terms if t in lists]
                threshold[q] = best_of(own, len(names), threshold[q], best[q], names, k)

        for b in batches:
            for row in b.to_pylist():
                if row["term"] is None:
                    close()
                    (names, norms), lists = documents_of(row["data"]), {}
                else:
                    lists[row["term"]] = Postings(row["last"], row["most"], row["ends"], row["data"], norms)
        close()
        rows = [(q, None if no_id else -i, s) for q, heap in best.items() for s, no_id, i in heap]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 3
        yield pa.record_batch([pa.array(list(c), pa.int64()) for c in cols], ["query", "doc_id", "score"])

    # a segment's own row comes first
    together = hits.unionByName(segments.where("term is null")).repartition("segment").sortWithinPartitions("segment", F.asc_nulls_first("term"))
    return together.mapInArrow(find, "query long, doc_id long, score long")

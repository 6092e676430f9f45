"""Approximate nearest neighbours by hierarchical navigable small-world graphs, one per shard.

Equal vectors are one node, which keeps its smallest ids: as many as a result can hold, so a group of copies of any size loses none
that a result could name. Nodes are dealt by hash into shards of about SHARD, and each shard's graph is built in one task: node levels come from a
hash, a layer holds the nodes of its level or more, and is filled in batches that double up to BATCH. A batch's nodes are searched for
at once in the layer so far (a beam over flat neighbour arrays, from where the layers above lead) and among themselves, keep
diverse neighbours, and are linked back. A shard is one row: node ids, vectors, and one flat array of neighbours a layer.

Nearness is the inner product. Between nodes the graph uses vectors with one more component that gives all of a shard the same length, which makes the largest
inner product the smallest distance also where lengths differ. A search sends blocks of distinct query vectors to every shard, ranks each
shard's finds by the inner product of the original vectors, summed in double precision from the first component to the last,
and merges the shards' lists.

Cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows without an id; vectors of another number of
components than a query's don't meet it; rows of equal id and vector are one, a query's id that stands for several vectors is searched for
with each; fewer candidates than k are all returned; ties go to the smaller id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import giving_back, mix, small_batches, written

K = 20
#: Nodes of a shard, about; neighbours of a node in the layers above and in the lowest; beams of building and searching.
SHARD, LINKS, LINKS_LOWEST, BEAM_BUILD, BEAM = 8192, 16, 32, 64, 160
#: Nodes inserted at once; candidates of a beam opened at once; beam of the layers above; distinct query vectors of a block.
BATCH, OPEN, BEAM_ABOVE, BLOCK = 1024, 4, 8, 512
INDEX = "dim int, shard long, counts array<int>, layers array<binary>, vectors binary, starts binary, ids binary"


def beam(vectors: np.ndarray, links: np.ndarray, start: np.ndarray, query: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The width best nodes found for each query and their similarities, best first. Node len(vectors) - 1 is none: it fills what is empty.

    vectors: with a row of zeros for none; links: the neighbours of each node; start: nodes to begin with, for each query."""
    none, n = len(vectors) - 1, len(query)
    seen = np.zeros((n, none + 1), bool)
    seen[:, none] = True
    ids, sims = np.full((n, width), none, np.int32), np.full((n, width), -np.inf, np.float32)
    opened = np.zeros((n, width), bool)
    rows, fresh = np.arange(n), np.sort(start, axis=1)
    while True:
        # what is new to each query, once
        new = ~seen[rows[:, None], fresh]
        new[:, 1:] &= fresh[:, 1:] != fresh[:, :-1]
        seen[rows[:, None], fresh] = True
        near = np.where(new, np.matmul(vectors[fresh], query[rows][:, :, None])[:, :, 0], -np.inf).astype(np.float32)
        all_ids, all_sims = np.concatenate([ids[rows], fresh], axis=1), np.concatenate([sims[rows], near], axis=1)
        all_open = np.concatenate([opened[rows], np.zeros(fresh.shape, bool)], axis=1)
        best = np.argsort(-all_sims, axis=1, kind="stable")[:, :width]
        ids[rows], sims[rows], opened[rows] = (np.take_along_axis(x, best, axis=1) for x in (all_ids, all_sims, all_open))
        # the best that aren't opened yet
        closed = opened[rows] | (sims[rows] == -np.inf)
        place = np.argsort(closed, axis=1, kind="stable")[:, :OPEN]
        usable = ~np.take_along_axis(closed, place, axis=1)
        going = usable.any(axis=1)
        if not going.any():
            return ids, sims
        rows, place, usable = rows[going], place[going], usable[going]
        opened[rows[:, None], place] |= usable
        next_ = np.where(usable, ids[rows[:, None], place], none)
        fresh = np.sort(links[next_].reshape(len(rows), -1), axis=1)


def diverse(vectors: np.ndarray, ids: np.ndarray, sims: np.ndarray, keep: int) -> np.ndarray:
    """keep candidates of each row (sorted, best first): those nearer to the row's node than to any kept before, then the best of the rest."""
    none, (n, width) = len(vectors) - 1, ids.shape
    held = vectors[ids]
    between = np.matmul(held, held.transpose(0, 2, 1))
    real = ids != none
    taken, closest, count = np.zeros((n, width), bool), np.full((n, width), -np.inf, np.float32), np.zeros(n, np.int64)
    for t in range(width):
        ok = real[:, t] & (closest[:, t] < sims[:, t]) & (count < keep)
        taken[:, t] = ok
        count += ok
        closest = np.where(ok[:, None], np.maximum(closest, between[:, t, :]), closest)
    order = np.argsort(np.where(taken, 0, np.where(real, 1, 2)), axis=1, kind="stable")[:, :keep]
    out = np.take_along_axis(ids, order, axis=1)
    return out if width >= keep else np.concatenate([out, np.full((n, keep - width), none, ids.dtype)], axis=1)


def _best(sims: np.ndarray, ids: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(-sims, axis=1, kind="stable")[:, :width]
    return np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)


def _link_back(vectors: np.ndarray, links: np.ndarray, new: np.ndarray) -> None:
    """Link the neighbours of the nodes new to them; whoever gets too many keeps diverse ones."""
    none, keep = len(vectors) - 1, links.shape[1]
    source = np.repeat(new, keep)
    target = links[new].ravel()
    source, target = source[target != none], target[target != none]
    touched = np.unique(target)
    old = links[touched]
    pairs = np.concatenate([np.stack([np.repeat(touched, keep), old.ravel()]), np.stack([target, source])], axis=1)
    pairs = np.unique(pairs[:, pairs[1] != none], axis=1)
    sims = np.einsum("ij,ij->i", vectors[pairs[0]], vectors[pairs[1]])
    order = np.lexsort((-sims, pairs[0]))
    (target, source), sims = pairs[:, order], sims[order]
    place = np.arange(len(target)) - np.searchsorted(target, target)
    # the nearest of very many are enough to choose from
    near = place < 2 * keep
    row = np.searchsorted(touched, target[near])
    ids, close = np.full((len(touched), 2 * keep), none, np.int32), np.full((len(touched), 2 * keep), -np.inf, np.float32)
    ids[row, place[near]], close[row, place[near]] = source[near], sims[near]
    for a in range(0, len(touched), BATCH):
        links[touched[a : a + BATCH]] = diverse(vectors, ids[a : a + BATCH], close[a : a + BATCH], keep)


def _above(vectors: list[np.ndarray], layers: list[np.ndarray], query: np.ndarray) -> np.ndarray:
    """Nodes to begin with in the layer below layers (the highest first)."""
    start = np.zeros((len(query), 1), np.int32)
    for held, links in zip(vectors, layers, strict=True):
        found, sims = beam(held, links, start, query, BEAM_ABOVE)
        start = np.where(sims > -np.inf, found, 0)
    return start


def _with_none(vectors: np.ndarray) -> np.ndarray:
    return np.concatenate([vectors, np.zeros((1, vectors.shape[1]), vectors.dtype)])


def build(vectors: np.ndarray, counts: list[int]) -> list[np.ndarray]:
    """Neighbours of each node in every layer, the highest first; a layer holds the first nodes, counts of them."""
    layers, held = [], []
    for k, n in enumerate(counts):
        keep = LINKS_LOWEST if k == len(counts) - 1 else LINKS
        here = _with_none(vectors[:n])
        links = np.full((n + 1, keep), n, np.int32)
        done, above = 0, counts[k - 1] if k else 0
        while done < n:
            size = min(n - done, BATCH, done or BATCH // 2)
            new = np.arange(done, done + size)
            query = vectors[new]
            among = (query @ query.T).astype(np.float32)
            np.fill_diagonal(among, -np.inf)
            ids, sims = _best(among, np.broadcast_to(new.astype(np.int32), among.shape), BEAM_BUILD)
            if done:
                start = _above(held, layers, query)
                found, near = beam(here, links, np.where(start < done, start, 0), query, BEAM_BUILD)
                ids, sims = _best(np.concatenate([near, sims], axis=1), np.concatenate([found, ids], axis=1), BEAM_BUILD)
            ids = np.where(sims > -np.inf, ids, n).astype(np.int32)
            links[new] = diverse(here, ids, sims, keep)
            _link_back(here, links, new)
            done += size
        layers.append(links)
        held.append(here)
    return layers


def even(vectors: np.ndarray) -> np.ndarray:
    """Vectors with one more component, so that all have the length of the longest."""
    square = np.einsum("ij,ij->i", vectors, vectors)
    return np.concatenate([vectors, np.sqrt(np.maximum(square.max(initial=0.0) - square, 0.0))[:, None]], axis=1).astype(np.float32)


def _levels(ids: np.ndarray) -> np.ndarray:
    part = ((mix(ids.astype(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53
    return np.floor(-np.log(part) / np.log(LINKS)).astype(np.int64)


def _usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, vector (doubles), dim of the rows that take part."""
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where("vec_id is not null and vector is not null").where(finite & F.exists("vector", lambda x: x != 0)).withColumn("dim", F.size("vector"))


def nodes(vectors: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """node (the smallest id), ids (the k + 1 smallest), vector, dim of every distinct vector."""
    rows = _usable(vectors, id_col, vector_col).groupBy("vector", "dim", "vec_id").agg(F.lit(1).alias("one")).drop("one")
    # the limit is applied before the shuffle as well, so that a group of copies stays small
    first = rows.withColumn("place", F.row_number().over(Window.partitionBy("vector", "dim").orderBy("vec_id"))).where(F.col("place") <= k + 1)
    return first.groupBy("vector", "dim").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("node"), "ids", "vector", "dim")


def index(distinct: DataFrame, shard: int = SHARD) -> DataFrame:
    """One row a shard of the nodes: the graph as flat arrays, layer by layer."""
    sizes = distinct.groupBy("dim").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / shard)).cast("long").alias("shards"))
    dealt = distinct.join(sizes, "dim").withColumn("shard", F.pmod(F.xxhash64("node"), F.col("shards")))

    def graph(table):
        import pyarrow as pa

        table = table.combine_chunks()
        ids = table.column("node").to_numpy()
        level = _levels(ids)
        order = np.lexsort((mix(ids.astype(np.uint64)), -level))
        table, level = table.take(pa.array(order)), level[order]
        dim = table.column("dim")[0].as_py()
        vectors = table.column("vector").combine_chunks().flatten().to_numpy().reshape(-1, dim)
        held = table.column("ids").combine_chunks()
        starts = np.concatenate([[0], np.cumsum(held.value_lengths().to_numpy())])
        counts = [int((level >= x).sum()) for x in sorted(set(level.tolist()) | {0}, reverse=True)]
        layers = build(even(vectors), counts)
        data = [[dim], [table.column("shard")[0].as_py()], [counts], [[x.tobytes() for x in layers]], [vectors.tobytes()], [starts.astype(np.int64).tobytes()], [held.flatten().to_numpy().astype(np.int64).tobytes()]]
        kinds = [pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.binary(), pa.binary(), pa.binary()]
        return pa.table([pa.array(d, t) for d, t in zip(data, kinds, strict=True)], names=["dim", "shard", "counts", "layers", "vectors", "starts", "ids"])

    return dealt.select("dim", "shard", "node", "ids", "vector").groupBy("dim", "shard").applyInArrow(graph, INDEX)


class Shard:
    """A shard's row, read back."""

    def __init__(self, dim: int, counts: list[int], layers: list[bytes], vectors: bytes, starts: bytes, ids: bytes):
        self.vectors = np.frombuffer(vectors, np.float64).reshape(-1, dim)
        wide = even(self.vectors)
        self.held = [_with_none(wide[:n]) for n in counts]
        self.layers = [np.frombuffer(x, np.int32).reshape(n + 1, -1) for x, n in zip(layers, counts, strict=True)]
        self.starts, self.ids = np.frombuffer(starts, np.int64), np.frombuffer(ids, np.int64)

    def find(self, query: np.ndarray, k: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of queries, ids and exact scores of the k best of each."""
        wide = np.concatenate([query, np.zeros((len(query), 1))], axis=1).astype(np.float32)
        n = len(self.vectors)
        if n <= width:
            found = np.broadcast_to(np.arange(n), (len(query), n))
        else:
            found, _ = beam(self.held[-1], self.layers[-1], _above(self.held[:-1], self.layers[:-1], wide), wide, max(width, 2 * k))
            found = found[:, : 2 * k]
        of, node = np.nonzero(found < n)[0], found[found < n]
        scores = np.zeros(len(of))
        for j in range(query.shape[1]):
            scores += query[of, j] * self.vectors[node, j]
        # every id of a node, then the best of each query
        many = self.starts[node + 1] - self.starts[node]
        of, scores = np.repeat(of, many), np.repeat(scores, many)
        ids = self.ids[np.repeat(self.starts[node] - np.cumsum(many) + many, many) + np.arange(many.sum())]
        order = np.lexsort((ids, -scores, of))
        of, ids, scores = of[order], ids[order], scores[order]
        best = np.arange(len(of)) - np.searchsorted(of, of) < k
        return of[best], ids[best], scores[best]


def search(shards: DataFrame, queries: DataFrame, k: int = K, width: int = BEAM, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of every query that the graphs find, the query's own id left out."""
    spark = queries.sparkSession
    small_batches(spark)
    asked = written(_usable(queries, id_col, vector_col).groupBy("vec_id", "vector", "dim").agg(F.lit(1).alias("one")).drop("one"), "queries")
    named = asked.withColumn("name", F.sha2(F.array_join(F.col("vector").cast("array<string>"), ","), 256))
    distinct = named.groupBy("vector", "dim", "name").agg(F.lit(1).alias("one")).drop("one")
    blocks = distinct.groupBy("dim").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / block)).cast("long").alias("blocks"))
    dealt = distinct.join(blocks, "dim").withColumn("block", F.pmod(F.xxhash64("name"), F.col("blocks")))

    def pack(table):
        import pyarrow as pa

        table = table.combine_chunks()
        flat = table.column("vector").combine_chunks().flatten().to_numpy()
        return pa.table([pa.array([table.column("dim")[0].as_py()], pa.int32()), pa.array([table.column("name").to_pylist()], pa.list_(pa.string())), pa.array([flat.tobytes()], pa.binary())], names=["dim", "names", "queries"])

    packed = dealt.select("dim", "block", "name", "vector").groupBy("dim", "block").applyInArrow(pack, "dim int, names array<string>, queries binary")
    # every block of queries meets every shard of its dimension
    places = shards.groupBy("dim").agg(F.max("shard").alias("last"))
    sent = packed.join(places, "dim").withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last")))).drop("last")
    met = shards.join(sent, ["dim", "shard"])

    @giving_back
    def find(batches: Iterator) -> Iterator:
        import pyarrow as pa

        name, held = None, None
        for b in batches:
            for row in b.to_pylist():
                if (row["dim"], row["shard"]) != name:
                    name, held = (row["dim"], row["shard"]), Shard(*(row[c] for c in ("dim", "counts", "layers", "vectors", "starts", "ids")))
                of, ids, scores = held.find(np.frombuffer(row["queries"], np.float64).reshape(-1, row["dim"]), k + 1, width)
                yield pa.record_batch([pa.array(row["names"], pa.string()).take(pa.array(of)), pa.array(ids), pa.array(scores)], ["name", "vec_id", "score"])

    found = met.mapInArrow(find, "name string, vec_id long, score double")
    order = Window.partitionBy("name").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    lists = best.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))).alias("found"))
    own = named.join(lists, "name").withColumn("query_id", F.col("vec_id"))
    kept = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    at = own.select("query_id", F.posexplode(kept).alias("at", "x"))
    return at.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))

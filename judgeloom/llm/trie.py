"""Prefix trie of conversations, built level by level.

A conversation is a sequence of turns; a turn counts as the hash of its role and text. Equal sequences are one, with their number and
smallest id. Then, per level, the live sequences - those that share their node with a different one - are grouped by (parent node, next
turn): the smallest conv_id names the node. The members of a group have more turns in common than that one where the least and the greatest
of them have, so a group descends as far at once and what lies between is a chain of nodes with equal members: the rounds are the
branchings of a path, not its depth. A sequence alone in its group is a chain to its end and leaves the loop. Then the levels are joined in reverse,
from the last round to the first, and roll up leaves and saved words.

A level's group is reduced by partial aggregates; only members of groups that branch are joined with their new node, by keys that adaptive
execution can split. The hash of a node's members streams over their sorted ids, in pieces cut by range partitions; so no task holds a group of copies.
A conversation's hashes (24 bytes a turn, no text) are one row.

Cases: turns are ordered by turn (null first), then role, then hash; a null role or text is empty; rows without conv_id belong to no
conversation and are left out; repeated rows are turns like others; very long texts count whole; an empty table has no node, not even a root;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import giving_back, small_batches, written

WORD = r"[^\x20\x09-\x0D]+"
#: Ids in one piece of a node's members, and bytes of a turn's hash.
PIECE, HASH = 8192, 16
#: A conversation takes the beginning of the one whose id is the last multiple of FAMILY, fewer than HEADS turns of it.
FAMILY, HEADS = 20, 4
_EMPTY = hashlib.sha256(b"").hexdigest()


def sequences(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turns: the hash and the words of each turn of a conversation, in order."""
    said = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = conversations.select(F.col(f"`{id_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"), said(role_col).alias("role"), said(text_col).alias("text")).where("conv_id is not null")
    name = F.substring(F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)), 1, HASH)
    turns = rows.select("conv_id", F.struct(F.col("turn").isNotNull().alias("known"), "turn", "role", name.alias("name"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words")).alias("t"))
    held = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return held.select("conv_id", F.transform("t", lambda t: F.struct(t["name"].alias("name"), t["words"].alias("words"))).alias("turns"))


def rebuilt(seqs: DataFrame) -> DataFrame:
    """Every conversation with its beginning, of fewer than HEADS turns by its id's checksum, taken from the first of its family."""
    heads = seqs.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("family"), F.slice("turns", 1, HEADS - 1).alias("head"))
    own = seqs.withColumn("family", F.col("conv_id") - F.col("conv_id") % FAMILY).withColumn("h", (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("int"))
    met = own.join(heads, "family", "left")
    none = F.slice("turns", 1, 0)
    return met.select("conv_id", F.concat(F.slice(F.coalesce("head", none), F.lit(1), F.col("h")), F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))


@F.arrow_udf(T.ArrayType(T.LongType()))
def _running(words):
    """Running totals inside each list."""
    import numpy as np
    import pyarrow as pa

    flat, starts = words.flatten().to_numpy(zero_copy_only=False), words.offsets.to_numpy(zero_copy_only=False)
    starts = starts - starts[0]
    total = np.concatenate([[0], np.cumsum(flat)]).astype(np.int64)
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(total[1:] - np.repeat(total[starts[:-1]], np.diff(starts)), pa.int64()))


def _common(a: Column, b: Column) -> Column:
    """How many turns two sequences begin with alike."""
    same = F.zip_with(a, b, lambda x, y: x["name"].eqNullSafe(y["name"]))
    return F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.size(same)).cast("int")


def digests(members: DataFrame) -> DataFrame:
    """key, ends_sha256 of the ids of every key of members (key, conv_id): pieces of sorted ids, then one hash over a key's pieces."""
    small_batches(members.sparkSession, 20_000)

    @giving_back
    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held, of = [], None

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array([of], pa.binary()), pa.array([held[0]], pa.int64()), pa.array([",".join(map(str, held))])], ["key", "first", "ids"])

        for b in batches:
            for key, c in zip(b.column("key").to_pylist(), b.column("conv_id").to_pylist(), strict=True):
                if held and (key != of or len(held) >= PIECE):
                    yield out()
                    held = []
                of = key
                held.append(c)
        if held:
            yield out()

    @giving_back
    def hashed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        of, sha = None, None
        for b in batches:
            keys, shas = [], []
            for key, ids in zip(b.column("key").to_pylist(), b.column("ids").to_pylist(), strict=True):
                if sha is None or key != of:
                    if sha is not None:
                        keys.append(of), shas.append(sha.hexdigest())
                    of, sha = key, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield pa.record_batch([pa.array(keys, pa.binary()), pa.array(shas, pa.string())], ["key", "ends_sha256"])
        if sha is not None:
            yield pa.record_batch([pa.array([of], pa.binary()), pa.array([sha.hexdigest()])], ["key", "ends_sha256"])

    pieces = members.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(cut, "key binary, first long, ids string")
    return pieces.repartition("key").sortWithinPartitions("key", "first").mapInArrow(hashed, "key binary, ends_sha256 string")


def trie(seqs: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: one row per node of the sequences (conv_id, turns)."""
    words = _running(F.transform("turns", lambda t: t["words"]))
    rest = F.zip_with("turns", "total", lambda t, n: F.struct(t["name"].alias("name"), n.alias("total")))
    key = F.unhex(F.sha2(F.array_join(F.transform("turns", lambda t: F.hex(t["name"])), ""), 256))
    every = written(seqs.select("conv_id", key.alias("key"), "turns").withColumn("total", words).select("conv_id", "key", rest.alias("rest")), "sequences")
    distinct = every.groupBy("key").agg(F.min("conv_id").alias("c"), F.count("*").alias("copies"), F.any_value("rest").alias("rest"))
    distinct = written(distinct, "distinct")
    top = distinct.agg(F.min("c").alias("conv_id"), F.sum("copies").alias("n"), F.max(F.when(F.size("rest") == 0, F.col("key"))).alias("end")).first()
    zero = F.lit(0).cast("long")
    live = distinct.where(F.size("rest") > 0).select("c", "copies", "key", F.lit(top["conv_id"]).cast("long").alias("parent"), zero.alias("depth"), zero.alias("before"), "rest")
    levels: list[DataFrame] = []
    while True:
        first = F.col("rest")[0]["name"]
        sums = live.groupBy("parent", "depth", "before", first.alias("step")).agg(
            F.min("c").alias("node"), F.sum("copies").alias("n"), F.count("*").alias("members"), F.min(F.struct("rest", "key")).alias("low"), F.max("rest").alias("high")
        )
        held = sums.withColumn("span", _common(F.col("low.rest"), F.col("high")))
        chain = F.transform(F.slice("low.rest", F.lit(1), F.col("span")), lambda t: t["total"])
        level = held.select("parent", "depth", "before", "step", "node", "n", "members", "span", chain.alias("chain"), F.when(F.size("low.rest") == F.col("span"), F.col("low.key")).alias("end"))
        levels.append(written(level, "level"))
        split = levels[-1].where("members > 1").select("parent", "depth", "step", "node", "span", F.element_at("chain", -1).alias("reached"))
        if split.isEmpty():
            break
        met = live.withColumn("step", first).join(split, ["parent", "depth", "step"]).where(F.size("rest") > F.col("span"))
        further = F.slice("rest", F.col("span") + 1, F.size("rest"))
        live = written(met.select("c", "copies", "key", F.col("node").alias("parent"), (F.col("depth") + F.col("span")).alias("depth"), F.col("reached").alias("before"), further.alias("rest")), "live")

    # from the last level to the first: what each node's children have together
    below, done = None, []
    for level in reversed(levels):
        bottom = level.withColumn("reach", F.col("depth") + F.col("span"))
        if below is None:
            rolled = bottom.select("*", zero.alias("children"), F.lit(1).cast("long").alias("leaves"), zero.alias("under"))
        else:
            kids = below.groupBy(F.col("parent").alias("node"), F.col("depth").alias("reach")).agg(F.count("*").alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("under"))
            met = bottom.join(kids, ["node", "reach"], "left")
            rolled = met.withColumns({"children": F.coalesce("children", zero), "leaves": F.coalesce("leaves", F.lit(1).cast("long")), "under": F.coalesce("under", zero)})
        saved = (F.col("n") - 1) * (F.element_at("chain", -1) - F.col("before")) + F.col("under")
        below = written(rolled.select("parent", "depth", "before", "node", "n", "span", "chain", "end", "children", "leaves", "under", saved.alias("saved")), "rolled")
        done.append(below)

    every_edge = done[0]
    for more in done[1:]:
        every_edge = every_edge.unionByName(more)
    at = every_edge.select("*", F.posexplode("chain").alias("j", "total"))
    last = F.col("j") == F.col("span") - 1
    earlier = F.when(F.col("j") == 0, F.col("before")).otherwise(F.element_at("chain", F.greatest("j", F.lit(1))))
    nodes = at.select(
        F.col("node").alias("conv_id"),
        (F.col("depth") + F.col("j") + 1).alias("depth"),
        F.when(F.col("j") == 0, F.col("parent")).otherwise(F.col("node")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(last, F.col("children")).otherwise(F.lit(1).cast("long")).alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        ((F.col("n") - 1) * (F.element_at("chain", -1) - earlier) + F.col("under")).alias("saved_tokens"),
        F.when(last, F.col("end")).alias("end"),
    )
    if top["conv_id"] is not None:
        of_root = done[-1].agg(F.count("*").alias("n_children"), F.coalesce(F.sum("leaves"), F.lit(1).cast("long")).alias("n_leaves"), F.coalesce(F.sum("saved"), zero).alias("saved_tokens"))
        root = of_root.select(
            F.lit(top["conv_id"]).cast("long").alias("conv_id"), zero.alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(top["n"]).cast("long").alias("n_convs"),
            "n_children", "n_leaves", "saved_tokens", F.lit(bytes(top["end"]) if top["end"] is not None else None).cast("binary").alias("end"),
        )
        nodes = nodes.unionByName(root)
    ended = nodes.where("end is not null").join(digests(every.select("key", "conv_id")), F.col("end") == F.col("key")).drop("key")
    open_ = nodes.where("end is null").withColumn("ends_sha256", F.lit(_EMPTY))
    return ended.unionByName(open_).drop("end")

"""The prefix trie of conversations, in node tables addressed by minimal perfect hashes.

A conversation's first d turns are named by a 128-bit digest, the exclusive or of hashes of each turn's content and place, so
digests run along a conversation in one window and a turn's own hash leads back from a prefix to its parent. Grouping rows
by digest enumerates the distinct prefixes; every group is held against the SHA-256 of its turn and its parent's digest,
and all digests are drawn anew with another seed should two prefixes share one.

Nodes are dealt over shards by whole subtrees. In a shard a minimal perfect hash gives each digest a slot, which is verified
against the digest stored there; counts are scattered to flat arrays by slot, and summed through the array of parent slots
from the deepest level up. A subtree goes to one shard if at most ``SUBTREE_TURNS`` turns run at or below its node. Nodes
above form the top table, which takes the sums of the subtrees hanging from it: at most turns / ``SUBTREE_TURNS`` nodes a
depth. Below a node whose members all go on alike the trie is a chain; it is cut into pieces of ``SUBTREE_TURNS`` nodes, and
what lies beyond a piece follows from the lengths alone, so one endless conversation, however often repeated, fills no table.

``rebuilt`` gives each conversation the first turns of the one that leads its hundred. Turns go by number, null first, those of
equal number by the SHA-256 of role and text; null role and text are empty; repeated rows are turns of their own. Rows without
a conversation id belong to no conversation and are left out. A table without conversations has no nodes, not even the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from briefloom.llm.common import small, stored

#: Turns at or below a node up to which its whole subtree goes to one shard; wished nodes of a shard.
SUBTREE_TURNS, SHARD_NODES = 50_000, 200_000
#: Conversations of one hundred share turns of the first of them, at most so many less one.
SHARED_TURNS = 6
_EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos, content, chars``: the turns in order from 1, the SHA-256 of role and text standing for them."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    content = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    light = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", content.alias("content"),
                                                                    F.length(text).cast("long").alias("chars"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "content")
    return light.select("conv_id", F.row_number().over(order).alias("pos"), "content", "chars")


def rebuilt(light: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns ``conv_id, depth, content, chars, size`` of the rebuilt conversations, and ``conv_id, size`` of all of them.

    Conversation c takes the first h turns of c - c % 100 (remainder with the sign of c), then its own after its first h.
    """
    own = light.groupBy("conv_id").agg(F.max("pos").alias("own"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED_TURNS).cast("int")
    ids = own.select("conv_id", "own", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % 100).alias("lead"))
    leads = own.where("conv_id % 100 = 0").select(F.col("conv_id").alias("lead"), F.col("own").alias("lead_own"))
    ids = ids.join(leads, "lead", "left").withColumn("taken", F.least("h", F.coalesce("lead_own", F.lit(0))))
    ids = stored(ids.select("conv_id", "h", "lead", "taken", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("size")), "ids")
    heads = light.where((F.col("conv_id") % 100 == 0) & (F.col("pos") < SHARED_TURNS)).select(F.col("conv_id").alias("lead"), "pos", "content", "chars")
    shared = ids.where("taken > 0").join(heads, "lead").where("pos <= taken").select("conv_id", F.col("pos").alias("depth"), "content", "chars", "size")
    rest = light.join(ids, "conv_id").where("pos > h").select("conv_id", (F.col("taken") + F.col("pos") - F.col("h")).alias("depth"), "content", "chars", "size")
    return shared.unionByName(rest), ids.select("conv_id", "size")


def prefixes(rows: DataFrame, seed: int) -> DataFrame:
    """Adds to each turn the digest ``d1, d2`` of the prefix it ends, its parent's ``p1, p2``, and the characters so far, ``run``."""
    along = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = rows.withColumns({"x1": F.xxhash64("content", "depth", F.lit(2 * seed)), "x2": F.xxhash64("content", "depth", F.lit(2 * seed + 1))})
    out = own.withColumns({"d1": F.bit_xor("x1").over(along), "d2": F.bit_xor("x2").over(along), "run": F.sum("chars").over(along)})
    return out.select("conv_id", "depth", "size", "content", "chars", "run", "d1", "d2", F.col("d1").bitwiseXOR(F.col("x1")).alias("p1"), F.col("d2").bitwiseXOR(F.col("x2")).alias("p2"))


def distinct_prefixes(named: DataFrame) -> DataFrame:
    """A row per digest: its least conversation, members, turns at or below it, whether all members go on alike (``alike``),
    and ``clean``, whether all of it is one prefix."""
    ends = named.where("depth = size").select("conv_id", F.col("d1").alias("f1"), F.col("d2").alias("f2"), F.col("run").alias("whole"))
    one = lambda c: F.min(c) == F.max(c)
    first = lambda c: F.min(c).alias(c)
    return named.join(ends, "conv_id").groupBy("d1", "d2").agg(
        first("conv_id"), first("depth"), first("p1"), first("p2"), first("chars"), first("run"), first("size"), first("whole"), F.count("*").alias("n_convs"),
        F.sum(F.col("size") - F.col("depth") + 1).alias("below"), (one("f1") & one("f2")).alias("alike"),
        (one("depth") & one("p1") & one("p2") & one("content") & ~((F.col("d1") == 0) & (F.col("d2") == 0))).alias("clean"))


class Slots:
    """A minimal perfect hash of distinct digests: each level gives slots to the digests that meet no other in it, the rest go on."""

    def __init__(self, k1: np.ndarray, k2: np.ndarray) -> None:
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        self.slot = np.full(len(k1), -1, np.int64)
        rest, filled = np.arange(len(k1)), 0
        while len(rest):
            if len(self.levels) > 200:
                raise ValueError("digests are not distinct")
            size = max(2, len(rest) + len(rest) // 3) | 1
            h = self._hash(k1[rest], k2[rest], len(self.levels), size)
            alone = np.bincount(h, minlength=size) == 1
            rank = filled + np.cumsum(alone) - 1
            got = alone[h]
            self.slot[rest[got]] = rank[h[got]]
            self.levels.append((size, alone, rank))
            filled += int(got.sum())
            rest = rest[~got]
        self.k1, self.k2 = np.empty_like(k1), np.empty_like(k2)
        self.k1[self.slot], self.k2[self.slot] = k1, k2

    @staticmethod
    def _hash(k1: np.ndarray, k2: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (k1.view(np.uint64) + np.uint64(level)) * np.uint64(0x9E3779B97F4A7C15) ^ k2.view(np.uint64)
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
            return ((h ^ (h >> np.uint64(32))) % np.uint64(size)).astype(np.int64)

    def find(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        """Slots of digests, -1 for those the table does not hold."""
        out, rest = np.full(len(k1), -1, np.int64), np.arange(len(k1))
        for level, (size, alone, rank) in enumerate(self.levels):
            h = self._hash(k1[rest], k2[rest], level, size)
            hit = alone[h]
            out[rest[hit]] = rank[h[hit]]
            rest = rest[~hit]
        held = out >= 0
        held[held] = (self.k1[out[held]] == k1[held]) & (self.k2[out[held]] == k2[held])
        return np.where(held, out, -1)


TABLE_SCHEMA = "d1 long, d2 long, conv_id long, depth long, p1 long, p2 long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def node_table(rows: pd.DataFrame) -> pd.DataFrame:
    """Children, leaves and saved characters of the nodes of one shard, with what hangs from them outside it (``more_*``);
    nodes ``cut_off`` are linked to no parent in the table."""
    k1, k2 = rows["d1"].to_numpy(np.int64), rows["d2"].to_numpy(np.int64)
    table = Slots(k1, k2)
    at = table.slot
    parent = np.empty(len(rows), np.int64)
    parent[at] = table.find(rows["p1"].to_numpy(np.int64), rows["p2"].to_numpy(np.int64))

    def scatter(values: np.ndarray) -> np.ndarray:
        out = np.empty(len(rows), np.int64)
        out[at] = values
        return out
    depth, conv = scatter(rows["depth"].to_numpy(np.int64)), scatter(rows["conv_id"].to_numpy(np.int64))
    parent[scatter(rows["cut_off"].to_numpy(np.int64)) == 1] = -1
    inside = parent >= 0
    children = scatter(rows["more_children"].to_numpy(np.int64)) + np.bincount(parent[inside], minlength=len(rows))
    leaves = scatter(rows["more_leaves"].to_numpy(np.int64)) + (children == 0)
    saved = scatter(rows["more_saved"].to_numpy(np.int64) + (rows["n_convs"].to_numpy(np.int64) - 1) * rows["chars"].to_numpy(np.int64))
    order = np.argsort(-depth, kind="stable")
    for level in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1):
        level = level[inside[level]]
        np.add.at(leaves, parent[level], leaves[level])
        np.add.at(saved, parent[level], saved[level])
    out = rows[["d1", "d2", "conv_id", "depth", "p1", "p2", "n_convs"]].copy()
    up = parent[at]
    out["parent_conv_id"] = pd.array(np.where(up >= 0, conv[up], 0), dtype="Int64")
    out.loc[up < 0, "parent_conv_id"] = pd.NA
    out["n_children"], out["n_leaves"], out["saved_tokens"] = children[at], leaves[at], saved[at]
    return out[[c.split()[0] for c in TABLE_SCHEMA.split(", ")]]


def end_hashes(ends: DataFrame) -> DataFrame:
    """``d1, d2, ends_sha256`` of ``ends(d1, d2, conv_id)``: a digest's ids are hashed in order as they stream by, never held."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for batch in batches:
            done = []
            for d1, d2, c in zip(batch["d1"], batch["d2"], batch["conv_id"]):
                if (d1, d2) == key:
                    state.update(b",%d" % c)
                    continue
                if key is not None:
                    done.append((*key, state.hexdigest()))
                key, state = (d1, d2), hashlib.sha256(b"%d" % c)
            yield pd.DataFrame(done, columns=["d1", "d2", "ends_sha256"])
        if key is not None:
            yield pd.DataFrame([(*key, state.hexdigest())], columns=["d1", "d2", "ends_sha256"])
    return ends.repartition("d1", "d2").sortWithinPartitions("d1", "d2", "conv_id").mapInPandas(run, "d1 long, d2 long, ends_sha256 string")


def verified_prefixes(rows: DataFrame, tries: int = 5) -> tuple[DataFrame, DataFrame]:
    """Turns with their digests, and the distinct prefixes, under a seed by which no two prefixes share a digest."""
    for seed in range(tries):
        named = stored(prefixes(rows, seed), "prefixes")
        nodes = stored(distinct_prefixes(named), "nodes")
        if nodes.where(~F.col("clean")).isEmpty():
            return named, nodes
    raise RuntimeError("prefixes share digests under every seed")


def trie(conversations: DataFrame, subtree_turns: int = SUBTREE_TURNS, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """A row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``."""
    rows, ids = rebuilt(stored(turns(conversations), "turns"))
    named, nodes = verified_prefixes(rows)
    n_nodes = nodes.count()
    nodes = nodes.withColumn("heavy", ~F.col("alike") & (F.col("below") > subtree_turns))
    heavy = nodes.where("heavy").select("d1", "d2")
    # where each conversation leaves the top table; a node lies in the subtree in which its least member does
    light = named.select("conv_id", "depth", "d1", "d2").join(small(heavy), ["d1", "d2"], "left_anti")
    cuts = light.groupBy("conv_id").agg(F.min(F.struct("depth", "d1", "d2")).alias("cut"))
    left = F.col("size") - F.col("depth")
    piece = F.when(F.col("alike"), F.floor(left / subtree_turns)).otherwise(0)
    open_end = F.col("alike") & (left > 0) & (left % subtree_turns == 0)
    hangs = F.col("depth") == F.col("cut.depth")
    begins = F.col("alike") & ~hangs & ((left + 1) % subtree_turns == 0)
    more = lambda c: F.when(open_end, c).otherwise(0).cast("long")
    sub = nodes.where("NOT heavy").join(cuts, "conv_id").select(
        F.pmod(F.xxhash64("cut.d1", "cut.d2", piece), F.lit(-(-n_nodes // shard_nodes) or 1)).alias("shard"), "d1", "d2", "p1", "p2", "conv_id",
        F.col("depth").cast("long").alias("depth"), "n_convs", "chars", hangs.alias("hangs"), (hangs | begins).cast("long").alias("cut_off"),
        more(F.lit(1)).alias("more_children"), more(F.lit(1)).alias("more_leaves"), more((F.col("n_convs") - 1) * (F.col("whole") - F.col("run"))).alias("more_saved"))
    tables = sub.groupBy("shard").applyInPandas(lambda part: node_table(part).assign(hangs=part["hangs"].to_numpy()), TABLE_SCHEMA + ", hangs boolean")
    tables = stored(tables, "tables")

    hanging = tables.where("hangs").groupBy("p1", "p2").agg(F.count("*").alias("c"), F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
    hanging = hanging.select(F.col("p1").alias("d1"), F.col("p2").alias("d2"), F.col("c").alias("more_children"), F.col("l").alias("more_leaves"), F.col("s").alias("more_saved"))
    zero = F.lit(0).cast("long")
    root = ids.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(
        zero.alias("d1"), zero.alias("d2"), zero.alias("p1"), zero.alias("p2"), "conv_id", zero.alias("depth"), "n_convs", zero.alias("chars"))
    top = nodes.where("heavy").select("d1", "d2", "p1", "p2", "conv_id", F.col("depth").cast("long").alias("depth"), "n_convs", "chars").unionByName(root)
    top = top.withColumn("cut_off", (F.col("depth") == 0).cast("long")).join(hanging, ["d1", "d2"], "left").fillna(0, ["more_children", "more_leaves", "more_saved"])
    top = stored(top.withColumn("table", F.lit(0)).groupBy("table").applyInPandas(node_table, TABLE_SCHEMA), "top")

    above = top.select(F.col("d1").alias("p1"), F.col("d2").alias("p2"), F.col("conv_id").alias("above"))
    # a node without a parent in its table hangs from the top, or goes on a chain, whose nodes have the same members
    low = tables.join(small(above), ["p1", "p2"], "left").withColumn("parent_conv_id", F.when(F.col("hangs"), F.col("above")).otherwise(F.coalesce("parent_conv_id", "conv_id")))
    out = low.select(*top.columns).unionByName(top)
    none = ids.where("size = 0").select(zero.alias("d1"), zero.alias("d2"), "conv_id")
    ends = end_hashes(named.where("depth = size").select("d1", "d2", "conv_id").unionByName(none))
    return out.join(ends, ["d1", "d2"], "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                                                       F.coalesce("ends_sha256", F.lit(_EMPTY_SHA)).alias("ends_sha256"))

"""Nodes that meet in buckets: pairs from small buckets, and all links among the nodes of crowded ones without a row per pair.

Nodes of some bucket of over ``bucket`` nodes form the crowd. The crowd is cut into blocks of bounded size, nodes of one bucket
together. Sets of at least the similarity share a shingle among the first ``n - ceil(similarity * n) + 1`` of each in any order
of shingles; here those of fewest blocks come first. So blocks whose first shingles have none in common, or whose set sizes are
too far apart, hold no link between them, and all other pairs of blocks are compared in full: exact counts of common shingles
for each pair of nodes. What leaves a task is one row per node, not per pair. So no link within the crowd is missed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from briefloom.llm.common import stored

#: Most nodes and about the most shingles of a block, cells in which blocks are counted by shingle, columns multiplied at once.
NODES, SHINGLES, CELL_BITS, COLUMNS = 1024, 1 << 19, 18, 4096


def meetings(places: DataFrame, bucket: int) -> tuple[DataFrame, DataFrame]:
    """From ``places(node, key)``: distinct pairs ``a < b`` of small buckets, not both in the crowd, and the crowd ``(node, key)``."""
    sizes = places.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    met = stored(places.join(sizes, "key"), "met")  # nodes alone in a bucket are gone
    crowd = met.where(F.col("size") > bucket).groupBy("node").agg(F.max(F.struct("size", "key"))["key"].alias("key"))
    crowd = stored(crowd, "crowd")
    small = met.where(F.col("size") <= bucket).join(crowd.select("node", F.lit(True).alias("c")), "node", "left")
    few = small.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("node", F.coalesce("c", F.lit(False)).alias("c")))).alias("m"))
    pairs = few.select(F.explode(F.flatten(F.transform("m", lambda a, i: F.transform(F.slice("m", i + 2, bucket), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("p"))
    return pairs.where("not (p.a.c and p.b.c)").select(F.col("p.a.node").alias("a"), F.col("p.b.node").alias("b")).distinct(), crowd


def _blocks(crowd: DataFrame, sets: DataFrame) -> DataFrame:
    """Written ``block, nodes, copies, vocab, place, lens, low, high``: sets as places in the block's sorted vocabulary."""
    members = stored(crowd.join(sets, "node"), "members")
    number = F.ceil(F.greatest(F.count("*") / NODES, F.sum(F.length("shingles")) / (8 * SHINGLES)))
    parts = members.groupBy("key").agg(number.cast("long").alias("parts"))
    placed = members.join(parts, "key").withColumn("block", F.concat_ws(":", "key", F.pmod(F.xxhash64("node"), F.greatest("parts", F.lit(1)))))
    grouped = placed.groupBy("block").agg(F.collect_list(F.struct("node", "copies", "shingles")).alias("m")).select("block", "m.node", "m.copies", "m.shingles")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for block, nodes, copies, shingles in zip(batch["block"], batch["node"], batch["copies"], batch["shingles"], strict=True):
                lens = np.array([len(s) // 8 for s in shingles], np.int32)
                vocab, place = np.unique(np.frombuffer(b"".join(shingles), np.uint64), return_inverse=True)
                rows.append((block, nodes, copies, vocab.tobytes(), place.astype(np.int32).tobytes(), lens.tobytes(), int(lens.min()), int(lens.max())))
            yield pd.DataFrame(rows, columns=["block", "nodes", "copies", "vocab", "place", "lens", "low", "high"])

    return stored(grouped.mapInPandas(run, "block string, nodes array<binary>, copies array<long>, vocab binary, place binary, lens binary, low long, high long"), "blocks")


def first_shingles(vocab: np.ndarray, place: np.ndarray, lens: np.ndarray, order: np.ndarray, similarity: float) -> np.ndarray:
    """Distinct shingles among the first of some set: those of least ``order``, as many as the similarity asks for."""
    rank = np.empty(len(vocab), np.int64)
    rank[np.lexsort((vocab, order))] = np.arange(len(vocab))
    owner = np.repeat(np.arange(len(lens)), lens)
    sorted_rank = rank[place][np.lexsort((rank[place], owner))]
    wanted = np.array([n - math.ceil(similarity * n - 1e-9) + 1 for n in lens.tolist()], np.int64)
    inside = np.arange(len(place)) - np.repeat(np.cumsum(lens, dtype=np.int64) - lens, lens)
    return vocab[np.isin(rank, sorted_rank[inside < np.repeat(wanted, lens)])]


def _block_pairs(blocks: DataFrame, similarity: float) -> DataFrame:
    """Pairs ``a <= b`` of blocks that may hold a link."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 << CELL_BITS, np.int64)
        for batch in batches:
            for vocab in batch["vocab"]:
                total += np.bincount((np.frombuffer(vocab, np.uint64) >> np.uint64(64 - CELL_BITS)).astype(np.int64), minlength=1 << CELL_BITS)
        cells = np.flatnonzero(total)
        yield pd.DataFrame({"cell": cells, "n": total[cells]})

    held = np.zeros(1 << CELL_BITS, np.int64)  # how many blocks hold a shingle of the cell: at most 2^18 numbers come to the driver
    for cell, n in blocks.select("vocab").mapInPandas(count, "cell long, n long").groupBy("cell").agg(F.sum("n")).collect():
        held[cell] = n
    shared = blocks.sparkSession.sparkContext.broadcast(held)

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block, vocab, place, lens, low, high in batch[["block", "vocab", "place", "lens", "low", "high"]].itertuples(index=False):
                v = np.frombuffer(vocab, np.uint64)
                order = shared.value[(v >> np.uint64(64 - CELL_BITS)).astype(np.int64)]
                found = first_shingles(v, np.frombuffer(place, np.int32), np.frombuffer(lens, np.int32), order, similarity)
                yield pd.DataFrame({"token": found.view(np.int64), "block": block, "low": low, "high": high})

    tokens = blocks.select("block", "vocab", "place", "lens", "low", "high").mapInPandas(first, "token long, block string, low long, high long")
    lists = tokens.groupBy("token").agg(F.sort_array(F.collect_list(F.struct("block", "low", "high"))).alias("l")).where("size(l) > 1").select("l").distinct()
    one = lists.select("l", F.posexplode("l").alias("at", "a"))
    two = one.select("a", F.explode(F.slice("l", F.col("at") + 2, F.size("l"))).alias("b"))
    near = two.where((F.col("a.high") >= similarity * F.col("b.low") - 1e-6) & (F.col("b.high") >= similarity * F.col("a.low") - 1e-6))
    near = near.select(F.col("a.block").alias("a"), F.col("b.block").alias("b")).distinct()
    return near.union(blocks.select(F.col("block").alias("a"), F.col("block").alias("b")))


def common_counts(x: tuple[np.ndarray, np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray, np.ndarray], same: bool) -> np.ndarray:
    """Numbers of common shingles of the sets of two blocks ``(vocab, place, lens)``; of one block, without those held by one set only."""
    shared = np.intersect1d(x[0], y[0], assume_unique=True)
    sides = []
    for vocab, place, lens in (x, y):
        at = np.searchsorted(shared, vocab)
        at[at == len(shared)] = 0
        column = np.where(shared[at] == vocab, at, -1) if len(shared) else np.full(len(vocab), -1)
        column, owner = column[place], np.repeat(np.arange(len(lens)), lens)
        order = np.argsort(column, kind="stable")
        order = order[np.searchsorted(column[order], 0):]
        sides.append((column[order], owner[order]))
    (cx, rx), (cy, ry) = sides
    nx, ny, width = len(x[2]), len(y[2]), len(shared)
    hx, hy = np.bincount(cx, minlength=width), np.bincount(cy, minlength=width)
    out = np.zeros((nx, ny), np.float32)
    # columns of few pairs: pair by pair
    rare = (hx * hy <= max(1, nx * ny // 256)) & ((hx > 1) | (not same))
    start = np.cumsum(hy) - hy
    take = rare[cx]
    c, r = cx[take], rx[take]
    ends = np.cumsum(hy[c])
    at = 0
    while at < len(c):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + (1 << 22), side="right")))
        n = hy[c[at:to]]
        other = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[c[at:to]], n)
        out += np.bincount(np.repeat(r[at:to], n) * ny + ry[other], minlength=nx * ny).reshape(nx, ny)
        at = to
    # the others: matrix products
    dense = ~rare & ((hx > 1) | (not same))
    number = np.cumsum(dense) - 1
    kx, ky = dense[cx], dense[cy]
    dx, dy, rx, ry = number[cx[kx]], number[cy[ky]], rx[kx], ry[ky]
    for low in range(0, int(dense.sum()), COLUMNS):
        parts = []
        for d, r, n in ((dx, rx, nx), (dy, ry, ny)):
            i, j = np.searchsorted(d, (low, low + COLUMNS))
            part = np.zeros((n, COLUMNS), np.float32)
            part[r[i:j], d[i:j] - low] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out


def _roots(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the rows and the columns of a matrix of links the first row of their component, or -1."""
    back = np.ascontiguousarray(links.T)
    rows, columns = np.full(len(links), -1), np.full(len(back), -1)
    for seed in np.flatnonzero(links.any(axis=1)).tolist():
        if rows[seed] >= 0:
            continue
        rows[seed] = seed
        new = np.array([seed])
        while len(new):
            reached = np.flatnonzero(links[new].any(axis=0) & (columns < 0))
            columns[reached] = seed
            new = np.flatnonzero(back[reached].any(axis=0) & (rows < 0))
            rows[new] = seed
    return rows, columns


def crowd_links(crowd: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links among all of ``crowd(node, key, copies)`` by exact similarity of ``sets(node, shingles)``.

    Rows ``node, root, others``, written: ``others`` sums to the copies of all nodes linked to ``node``; edges from node to root have the
    components of the links.
    """
    blocks = _blocks(crowd, sets)
    pairs = _block_pairs(blocks, similarity)
    kept = ("nodes", "copies", "vocab", "place", "lens")
    both = pairs
    for side in "ab":
        both = both.join(blocks.select(F.col("block").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in kept]), side)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                x, y = (tuple(np.frombuffer(getattr(row, f"{s}_{c}"), t) for c, t in (("vocab", np.uint64), ("place", np.int32), ("lens", np.int32))) for s in "ab")
                same = row.a == row.b
                common = common_counts(x, y, same).astype(np.float64)
                links = common / np.maximum(x[2][:, None].astype(np.float64) + y[2][None, :] - common, 1) >= similarity
                if same:
                    np.fill_diagonal(links, False)
                rows, columns = _roots(links)
                a, b = np.flatnonzero(rows >= 0), np.flatnonzero(columns >= 0)
                nodes, others = np.array(row.a_nodes, object), np.array(row.b_nodes, object)
                more = links @ np.asarray(row.b_copies, np.int64)
                less = np.zeros(len(others), np.int64) if same else links.T @ np.asarray(row.a_copies, np.int64)
                yield pd.DataFrame({"node": np.concatenate((nodes[a], others[b])), "root": np.concatenate((nodes[rows[a]], nodes[columns[b]])), "others": np.concatenate((more[a], less[b]))})

    return stored(both.mapInPandas(run, "node binary, root binary, others long"), "crowd-links")

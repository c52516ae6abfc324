"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

The documents of a source are dealt into blocks by hash; a source's quota is the number of block draws its target needs:
whole passes over its blocks in a permuted order, then a prefix of one more pass, the last block and document cut where
the target is met. The quotas are split exactly among the output shards by a binary tree: at each node the left half
draws, without replacement, as many of the node's block draws as it has slots. Shards then take disjoint runs of each
source's permuted draws and are shuffled locally by hash. All choices come from hashes and seeds, so reruns agree.

Null texts have size 0 and are never drawn; null sources form a source of their own, last in order. Rows are told apart
by their place, not by id, so repeated rows are mixed as rows of their own. Empty input gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from briefloom.llm.common import hash60, small, stored, text_of

#: Fixed values of the contract: weights of the sources in code-point order, repeating; a target is at most REPEAT times its source.
WEIGHTS = (5, 2, 1)
REPEAT = 3
#: Words of a block, about; a source has size / BLOCK_WORDS blocks, at least one.
BLOCK_WORDS = 100_000
SHARDS = 16
SEED = 17

WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeat: int = REPEAT, block_words: int = BLOCK_WORDS) -> DataFrame:
    """From ``(source, size)`` one row per source: its place, size, target, number of blocks, whole passes and words left.

    Targets are weight * level, cut at ``repeat`` times the size. With sources ordered by the level at which they are
    cut, the level is the largest of (total - cuts before) / (weights not yet cut). The windows run over sources, one row each.
    """
    places = Window.orderBy(F.col("source").isNull(), F.col("source"))
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("place", (F.row_number().over(places) - 1).cast("int"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cut_at", repeat * F.col("source_size") / F.col("weight"))
    order = Window.orderBy("cut_at", "place")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum(repeat * F.col("source_size")).over(before), F.lit(0))) / F.sum("weight").over(after)
    per = per.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    per = per.withColumn("target", F.least(repeat * F.col("source_size").cast("double"), F.col("weight") * F.col("level")))
    words = F.least(F.floor(F.col("target") + 0.5), repeat * F.col("source_size"))
    per = per.withColumn("words", words)
    some = F.greatest(F.col("source_size"), F.lit(1))
    return per.select("source", "place", "source_size", "target", F.greatest(F.lit(1), F.ceil(F.col("source_size") / block_words)).cast("long").alias("blocks"),
                      F.floor(F.col("words") / some).cast("long").alias("passes"), (F.col("words") % some).cast("long").alias("rest"))


def _split(quotas: np.ndarray, lo: int, hi: int, node: int, seed: int, slots: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """One node: what its left half draws, and the node's halves."""
    mid = (lo + hi) // 2
    rng = np.random.default_rng([seed, node])
    return mid, rng.multivariate_hypergeometric(quotas, int(slots[mid] - slots[lo]), method="marginals")


def shard_runs(quotas: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """From ``(place, quota)`` the runs of draws: ``shard, place, first, draws``, disjoint and covering every quota exactly.

    Each shard walks the tree from the root to its leaf by itself; nodes are seeded by their number, so all shards see
    the same splits. A task holds one number per source.
    """
    def walk(key, rows):
        rows = rows.sort_values("place")
        quota, first = rows["quota"].to_numpy(np.int64), np.zeros(len(rows), np.int64)
        slots = np.array([quota.sum() * i // shards for i in range(shards + 1)], dtype=np.int64)
        lo, hi, node, shard = 0, shards, 1, int(key[0])
        while hi - lo > 1:
            mid, left = _split(quota, lo, hi, node, seed, slots)
            if shard < mid:
                quota, hi, node = left, mid, 2 * node
            else:
                quota, first, lo, node = quota - left, first + left, mid, 2 * node + 1
        return pd.DataFrame({"shard": shard, "place": rows["place"].to_numpy(), "first": first, "draws": quota})

    each = quotas.select("place", "quota", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    return each.groupBy("shard").applyInPandas(walk, "shard int, place int, first long, draws long")


def mix(docs: DataFrame, carry: list[str] | None = None, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id",
        shards: int = SHARDS, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """One row per input row: ``kept`` (struct of the ``carry`` columns), ``source``, ``size``, ``source_size``, ``target`` and
    ``takes``: array of ``shard, pass, position, words``, one entry per time the mix takes the document.

    ``words`` is less than ``size`` for the one document per source at which the target is met. ``position`` orders a shard.
    """
    carry = carry if carry is not None else [id_col]
    rows = docs.select(F.struct(*[F.col(c) for c in carry]).alias("kept"), F.col(id_col).alias("id"), F.col(source_col).alias("source"),
                       word_count(text_of(text_col)).alias("size"))
    if carry == [id_col]:
        rows = stored(rows, "sizes")
        light = rows
    else:
        light = stored(rows.select("id", "source", "size"), "sizes")
    targets = stored(source_targets(light.select("source", "size"), block_words=block_words), "targets")

    def placed(df: DataFrame) -> DataFrame:
        of = small(targets.withColumnRenamed("source", "of"))
        out = df.join(of, df["source"].eqNullSafe(of["of"])).drop("of")
        return out.withColumn("block", F.pmod(hash60(f"{seed}", "block", F.col("id")), F.col("blocks")))

    blocks = (placed(light.where("size > 0")).groupBy("place", "block")
              .agg(F.sum("size").alias("block_size"), F.first("passes").alias("passes"), F.first("rest").alias("rest")))
    permuted = Window.partitionBy("place").orderBy(hash60(f"{seed}", "order", F.col("place"), F.col("block")), "block")
    blocks = blocks.withColumns({
        "nth": F.row_number().over(permuted) - 1, "n_blocks": F.count("*").over(Window.partitionBy("place")),
        "before": F.sum("block_size").over(permuted.rowsBetween(Window.unboundedPreceding, -1))})
    blocks = blocks.withColumn("before", F.coalesce("before", F.lit(0))).withColumn("times", F.col("passes") + (F.col("before") < F.col("rest")).cast("long"))
    blocks = stored(blocks.where("times > 0"), "blocks")
    runs = shard_runs(blocks.groupBy("place").agg(F.sum("times").alias("quota")), shards, seed)
    drawn = (runs.where("draws > 0").select("shard", "place", F.explode(F.sequence("first", F.col("first") + F.col("draws") - 1)).alias("draw")))
    of_block = blocks.select("place", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)).alias("pass"),
                             F.col("nth"), F.col("n_blocks"))
    of_block = of_block.withColumn("draw", F.col("pass") * F.col("n_blocks") + F.col("nth"))
    where = of_block.join(drawn, ["place", "draw"]).groupBy("place", "block").agg(F.sort_array(F.collect_list(F.struct("pass", "shard"))).alias("where"))
    plan = blocks.select("place", "block", "before").join(where, ["place", "block"]).select(F.col("place").alias("p"), F.col("block").alias("b"), "before", "where")

    full = placed(rows.where("size > 0"))
    inside = Window.partitionBy("place", "block").orderBy(hash60(f"{seed}", "inside", F.col("id")), "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    full = full.join(plan, (full["place"] == plan["p"]) & (full["block"] == plan["b"]), "left")
    full = full.withColumn("before", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    words = lambda w: F.when(w["pass"] < F.col("passes"), F.col("size")).otherwise(F.greatest(F.lit(0).cast("long"), F.least("size", F.col("rest") - F.col("before"))))
    takes = F.filter(F.transform("where", lambda w: F.struct(
        w["shard"].alias("shard"), w["pass"].cast("int").alias("pass"),
        F.xxhash64(F.lit(seed), F.col("id"), w["pass"]).alias("position"), words(w).alias("words"))), lambda t: t["words"] > 0)
    none = F.array().cast("array<struct<shard:int,pass:int,position:bigint,words:bigint>>")
    full = full.select("kept", "source", "size", "source_size", "target", F.coalesce(takes, none).alias("takes"))
    of = small(targets.select(F.col("source").alias("of"), "source_size", "target"))
    blank = rows.where("size = 0")
    blank = blank.join(of, blank["source"].eqNullSafe(of["of"])).select("kept", "source", "size", "source_size", "target", none.alias("takes"))
    return full.unionByName(blank)


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its ``n``-th word."""
    skip = F.when(text.rlike(r"^[\x20\x09-\x0D]"), n + 2).otherwise(n + 1)
    rest = F.element_at(F.split(text, SPACES, skip.cast("int")), -1)
    return F.regexp_replace(F.left(text, F.length(text) - F.length(rest)), r"[\x20\x09-\x0D]+$", "")


def mixed_documents(docs: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """The mixed corpus: a row per time a document is taken, columns of ``docs``, ordered by position within each shard.

    A document taken in part keeps its first words; the rows of a shard lie together.
    """
    rows = mix(docs, carry=docs.columns, text_col=text_col, **how)
    rows = rows.select("kept", "size", F.explode("takes").alias("take"))
    cut = F.when(F.col("take.words") < F.col("size"), first_words(F.col(f"kept.{text_col}"), F.col("take.words"))).otherwise(F.col(f"kept.{text_col}"))
    cols = [cut.alias(c) if c == text_col else F.col(f"kept.`{c}`").alias(c) for c in docs.columns]
    return rows.select(*cols, F.col("take.shard").alias("__shard"), F.col("take.position").alias("__position")).repartitionByRange("__shard", "__position").sortWithinPartitions("__shard", "__position").drop("__shard", "__position")

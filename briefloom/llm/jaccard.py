"""Near-duplicate texts by n-gram Jaccard similarity: a MinHash LSH forest, then exact verification.

Every distinct set of five-word shingles is a node, so copies, however many, are one node from the start. A tree of the forest
sorts nodes by their sequence of MinHash values; nodes that share a prefix are candidates. The prefix is shortened from the
longest until the expected recall at the wanted similarity, 1 - (1 - s^depth)^trees, reaches the target. In a bucket of up to
``BUCKET`` nodes all meet each other; each such pair is verified on whole shingle sets. The nodes of larger buckets are compared
by an exact prefix-filter join in blocks (``crowds``), which finds every link among them and needs no row per pair. Links form
components: the classes.

Null texts count as empty; texts without words are all alike. Rows are told apart by id and text, repeated rows share a
class. Empty input gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from briefloom.llm import shingles as sh
from briefloom.llm.common import components, stored, text_of
from briefloom.llm.crowds import crowd_links, meetings

#: Trees of the forest, longest prefix, recall wanted of pairs at the similarity, nodes of a bucket that all meet each other.
TREES, LONGEST, TARGET_RECALL, BUCKET = 16, 8, 0.999, 8


def prefix_depth(similarity: float = sh.SIMILARITY, trees: int = TREES, target: float = TARGET_RECALL) -> int:
    """The longest prefix whose expected recall reaches the target."""
    depth = LONGEST
    while depth > 1 and 1 - (1 - similarity ** depth) ** trees < target:
        depth -= 1
    return depth


def nodes_of(docs: DataFrame, text_col: str, id_col: str, similarity: float = sh.SIMILARITY) -> DataFrame:
    """Written rows ``id, h, node, near``: the node of each text and, per tree, the hash of its prefix."""
    depth, trees = prefix_depth(similarity), TREES

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names, near = [], []
            for text in batch["text"]:
                found = sh.shingle_set(text)
                names.append(sh.set_name(found))
                values = sh.minhash(found, trees * depth).astype(np.uint64).reshape(trees, depth)
                total = np.zeros(trees, np.uint64)
                for i in range(depth):
                    total = sh.mix(total * np.uint64(31) + values[:, i] + np.uint64(i + 1))
                near.append(total.view(np.int64))
            yield pd.DataFrame({"id": batch["id"], "h": batch["h"], "node": names, "near": near})

    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    return stored(rows.mapInPandas(run, f"id {id_type}, h long, node binary, near array<long>"), "nodes")


def candidates(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs and crowd (``crowds.meetings``) of the nodes that the forest brings together, from ``(node, near)``."""
    places = nodes.dropDuplicates(["node"]).select("node", F.posexplode("near").alias("tree", "k"))
    return meetings(places.select("node", F.xxhash64("tree", "k").alias("key")), BUCKET)


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``(a, b)`` whose ``sets(node, shingles)`` have at least the similarity, with it."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = np.array([sh.jaccard(x, y, similarity) for x, y in zip(batch["sa"], batch["sb"], strict=True)], dtype=np.float64)
            yield batch[["a", "b"]].assign(similarity=values)[values >= similarity]

    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    return both.select("a", "b", "sa", "sb").mapInPandas(run, "a binary, b binary, similarity double")


def shingle_sets(docs: DataFrame, wanted: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """Written ``(node, shingles)`` for ``wanted(node, id, h)``, one text per node."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"node": batch["node"], "shingles": [sh.shingle_set(t).tobytes() for t in batch["text"]]})

    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    texts = docs.select(key(id_col).alias("k"), text_of(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    found = texts.join(wanted.select(key("id").alias("k"), "h", "node"), ["k", "h"]).select("node", "text").dropDuplicates(["node"])
    return stored(found.mapInPandas(run, "node binary, shingles binary"), "sets")


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", similarity: float = sh.SIMILARITY) -> DataFrame:
    """One row per input row: ``id, h, class_key, class_id, class_size, n_links``.

    ``class_id`` is the least id of the class. ``n_links`` counts the other rows that the row is linked to directly: those
    with the same shingles and those of nodes with a verified link.
    """
    rows = nodes_of(docs, text_col, id_col, similarity)
    pairs, crowd = candidates(rows.select("node", "near"))
    pairs = stored(pairs, "pairs")
    copies = rows.groupBy("node").agg(F.count("*").alias("copies"), F.min(F.struct("id", "h")).alias("rep"))
    copies = stored(copies.select("node", "copies", F.col("rep.id").alias("id"), F.col("rep.h").alias("h")), "copies")
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).union(crowd.select("node")).distinct()
    sets = shingle_sets(docs, copies.join(ends, "node", "left_semi"), text_col, id_col)
    links = stored(verified(pairs, sets, similarity).select("a", "b"), "links")
    dense = crowd_links(crowd.join(copies.select("node", "copies"), "node"), sets, similarity)
    both = links.union(links.select("b", "a"))
    degree = both.join(copies.select(F.col("node").alias("b"), "copies"), "b").select(F.col("a").alias("node"), F.col("copies").alias("others"))
    degree = degree.union(dense.select("node", "others")).groupBy("node").agg(F.sum("others").alias("others"))
    known = copies.join(components(links.union(dense.select("node", "root"))), "node", "left").join(degree, "node", "left")
    known = stored(known.select("node", "copies", "id", F.coalesce("root", "node").alias("root"), F.coalesce("others", F.lit(0)).alias("others")), "known")
    classes = known.groupBy("root").agg(F.min("id").alias("class_id"), F.sum("copies").alias("class_size"))
    named = known.join(classes, "root").select("node", "root", "class_id", "class_size", (F.col("others") + F.col("copies") - 1).alias("n_links"))
    return rows.select("id", "h", "node").join(named, "node").select("id", "h", F.col("root").alias("class_key"), "class_id", "class_size", "n_links")


def keep_one(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` with one row of each class left: the one of least id, then least text hash."""
    found = near_duplicates(docs, text_col, id_col)
    stays = found.groupBy("class_key").agg(F.min(F.struct("id", "h")).alias("stay")).select(F.col("stay.id").alias("__id"), F.col("stay.h").alias("__h"))
    hashed = docs.withColumn("__text_hash", F.xxhash64(text_of(text_col)))
    left = hashed.join(stays, hashed[id_col].eqNullSafe(stays["__id"]) & (hashed["__text_hash"] == stays["__h"]), "left_semi")
    return left.dropDuplicates([id_col, "__text_hash"]).drop("__text_hash")

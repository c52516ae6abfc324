"""Repeated passages across documents: paragraph MinHash banding, exact verification, removals clustered by components.

Paragraphs are the lines of a text of at least ``MIN_WORDS`` words. Distinct shingle sets are nodes; bands of MinHash values
bring nodes together, tuned for high recall (``BANDS`` bands of ``ROWS`` values: 0.997 at similarity 0.8), and pairs are
verified on whole sets. So that a passage inside a longer line, or across lines, is found too, runs of ``MIN_WORDS`` words are
paragraphs of their own, compared by their exact words: of every ``WINDOW`` neighbouring runs the one of least hash. Equal passages
of ``MIN_WORDS + WINDOW - 1`` = 50 words hold a whole window, so they share a run wherever they stand.

In buckets of up to ``BUCKET`` nodes all lines meet each other; the lines of larger buckets are compared by an exact prefix-filter join
in blocks (``crowds``), which finds every pair among them. A cluster is reported if it reaches
two documents or more; its first paragraph, by id and start, is kept and the others are removals. Null and empty texts have no
paragraphs. A repeated row (same id and text) is one document. Empty input gives no rows.
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
from briefloom.llm.jaccard import verified

#: Words of a paragraph, at least; bands and values per band; nodes of a bucket that all meet each other; neighbouring runs of which one is taken.
MIN_WORDS, BANDS, ROWS, BUCKET, WINDOW = 25, 8, 3, 8, 26
#: Columns that tell where a paragraph stands.
PLACE = ("id", "h", "start", "end")


def _band_keys(shingles: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """One row of ``BANDS`` hashes for each line, whose shingles are ``shingles[first:end]``."""
    a, b = sh.hash_family(BANDS * ROWS)
    least = np.empty((len(first), BANDS * ROWS), np.uint64)
    total = np.concatenate(([0], np.cumsum(end - first)))
    at = 0
    while at < len(first):  # lines of about 4096 shingles in all are hashed at once
        to = int(np.searchsorted(total, total[at] + 4096, side="right")) - 1
        if to <= at:
            least[at] = sh.minhash(shingles[first[at]:end[at]], BANDS * ROWS)
            at += 1
            continue
        values = np.concatenate([shingles[x:y] for x, y in zip(first[at:to].tolist(), end[at:to].tolist(), strict=True)]) * a[:, None]
        values += b[:, None]
        least[at:to] = (np.minimum.reduceat(values, total[at:to] - total[at], axis=1) >> np.uint64(32)).T
        at = to
    least = least.reshape(len(first), BANDS, ROWS)
    keys = np.zeros((len(first), BANDS), np.uint64)
    for r in range(ROWS):
        keys = sh.mix(keys * np.uint64(31) + least[:, :, r] + np.uint64(1))
    return sh.mix(keys + np.arange(BANDS, dtype=np.uint64))


def _run_names(words: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the runs of words ``[first, end)``, from running totals."""
    power, back = sh._powers(max(1 << 16, 1 << len(words).bit_length()))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * power[:len(words)], dtype=np.uint64)))
    return sh.mix((total[end] - total[first]) * back[first] + (end - first).astype(np.uint64))


def _over_window(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` (minimum or maximum) of each ``width`` neighbouring values, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = pick(values[:-step], values[step:])
        have += step
    return values


def chosen_runs(names: np.ndarray) -> np.ndarray:
    """Places of the names that are least among some ``WINDOW`` neighbours (or among all, if there are fewer).

    Of equal names less than ``MIN_WORDS`` words apart, as in a text that repeats itself, the first is taken.
    """
    width = min(WINDOW, len(names))
    least = _over_window(names, width, np.minimum)
    edge = np.zeros(width - 1, np.uint64)
    places = np.flatnonzero(_over_window(np.concatenate((edge, least, edge)), width, np.maximum) == names)
    places = places[np.argsort(names[places], kind="stable")]
    again = np.flatnonzero((names[places[1:]] == names[places[:-1]]) & (np.diff(places) < MIN_WORDS)) + 1
    return np.sort(np.delete(places, again))


def find_paragraphs(text: str) -> list[tuple[str, int, int, bytes, list[int] | None]]:
    """``kind, start, end, name, bands`` of a text's paragraphs; positions are bytes of the lower-cased text in UTF-8."""
    data = sh.text_bytes(text)
    starts, ends, words = sh.word_hashes(data)
    out = []
    breaks = np.searchsorted(starts, np.flatnonzero(data == 10))
    first, last = np.concatenate(([0], breaks)), np.append(breaks, len(words))
    first, last = first[last - first >= MIN_WORDS], last[last - first >= MIN_WORDS]
    if len(first):
        shingles = sh.shingle_hashes(words)
        bands = _band_keys(shingles, first, last - sh.WIDTH + 1).view(np.int64).tolist()
        for i, j, keys in zip(first.tolist(), last.tolist(), bands, strict=True):
            out.append(("line", int(starts[i]), int(ends[j - 1]), sh.set_name(np.unique(shingles[i:j - sh.WIDTH + 1])), keys))
    first = np.arange(len(words) - MIN_WORDS + 1)
    if len(first):
        names = _run_names(words, first, first + MIN_WORDS)
        first = chosen_runs(names)
        last = first + MIN_WORDS
        both = np.stack([names[first], _run_names(sh.mix(words), first, last)], axis=1)
        packed = both.tobytes()
        out += [("run", a, b, packed[k:k + 16], None) for a, b, k in zip(starts[first].tolist(), ends[last - 1].tolist(), range(0, len(packed), 16), strict=True)]
    return out


def paragraphs_of(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """Written rows ``id, h, kind, start, end, node, bands``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at:at + 500]
                rows = [(i, h, *p) for i, h, t in zip(part["id"], part["h"], part["text"], strict=True) for p in find_paragraphs(t)]
                out = pd.DataFrame(rows, columns=["id", "h", "kind", "start", "end", "node", "bands"])
                out["id"] = out["id"].astype(part["id"].dtype)
                yield out

    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    return stored(rows.mapInPandas(run, f"id {id_type}, h long, kind string, start long, end long, node binary, bands array<long>"), "paragraphs")


def _sets(docs: DataFrame, wanted: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """Written ``(node, shingles)`` of ``wanted(node, id, h, start, end)``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [np.unique(sh.shingle_hashes(sh.word_hashes(sh.text_bytes(t)[a:b])[2])).tobytes() for t, a, b in zip(batch["text"], batch["start"], batch["end"], strict=True)]
            yield pd.DataFrame({"node": batch["node"], "shingles": sets})

    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    texts = docs.select(key(id_col).alias("k"), text_of(text_col).alias("text")).withColumn("h", F.xxhash64("text")).dropDuplicates(["k", "h"])
    found = texts.join(wanted.select(key("id").alias("k"), "h", "node", "start", "end"), ["k", "h"]).select("node", "text", "start", "end")
    return stored(found.mapInPandas(run, "node binary, shingles binary"), "sets")


def repeated_passages(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per paragraph that repeats across documents: ``id_col, kind, start, end, class_id, first_doc, kept``.

    ``class_id`` is the least id among the cluster's documents with the place of its first paragraph; ``start`` and ``end`` are
    bytes of the lower-cased text; a row that is not ``kept`` is a removal.
    """
    every = paragraphs_of(docs, text_col, id_col)
    where = F.struct(*PLACE)
    lines = every.where("kind = 'line'")
    nodes = lines.groupBy("node").agg(F.min(where).alias("rep"), F.first("bands").alias("bands"))
    nodes = stored(nodes.select("node", "rep.*", "bands"), "lines")
    pairs, crowd = meetings(nodes.select("node", F.explode("bands").alias("key")), BUCKET)
    pairs = stored(pairs, "pairs")
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).union(crowd.select("node")).distinct()
    sets = _sets(docs, nodes.drop("bands").join(ends, "node", "left_semi"), text_col, id_col)
    dense = crowd_links(crowd.withColumn("copies", F.lit(1).cast("long")), sets, sh.SIMILARITY)
    roots = stored(components(verified(pairs, sets, sh.SIMILARITY).select("a", "b").union(dense.select("node", "root"))), "roots")
    # lines: clusters of linked nodes; one of a single node counts if two documents hold it
    per_node = lines.groupBy("node").agg(F.min(where).alias("first"), F.max("id").alias("high"))
    per_node = stored(per_node.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "per-node")
    clusters = per_node.groupBy("root").agg(F.min("first").alias("keep"), F.max("high").alias("high"))
    clusters = clusters.where(~F.col("keep.id").eqNullSafe(F.col("high")))
    named = per_node.select("node", "root").join(clusters, "root").select("node", "keep")
    found = lines.select(*PLACE, "kind", "node").join(named, "node")
    # runs: equal words are equal nodes
    runs = every.where("kind = 'run'")
    shared = runs.groupBy("node").agg(F.min(where).alias("keep"), F.max("id").alias("high")).where(~F.col("keep.id").eqNullSafe(F.col("high")))
    found = found.union(runs.select(*PLACE, "kind", "node").join(shared.select("node", "keep"), "node"))
    out = found.select(F.col("id").alias(id_col), "kind", "start", "end", F.concat_ws(":", F.col("keep.id"), "kind", F.col("keep.start")).alias("class_id"),
                       F.col("keep.id").alias("first_doc"), F.struct(*PLACE).eqNullSafe(F.col("keep")).alias("kept"))
    return out

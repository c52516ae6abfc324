"""Spelling variants by a frequency-vector trie.

A word is described by how often each group of letters occurs in it. Words are arranged in a trie whose level k branches on
the count of group k. One inserted, deleted or replaced letter changes these counts by at most one more in one group (a
surplus) and one less in another (a deficit), so a depth-first search that may spend one of each reaches every word at
distance one. The words at the leaves it reaches are verified letter by letter.

The upper levels of the trie are the cells by which the words are dealt over tasks. A word looks into all cells its budget
reaches; cells of many words are dealt over several tasks, each of which gets all words that look in. A task holds the
words of one part of a cell, bounded by ``PART_WORDS``, and streams the looking words past them in lots. Every unordered
pair is found once: words of one length from the one of lesser number, others from the shorter word.

``words`` takes maximal runs of letters, lower-cases A-Z only, and leaves out one letter of the runs whose check sum is
divisible by ``EVERY``. Null texts have no words; a null id counts as an empty one; rows of one id and equal text give the
same words, each counted. Of equally frequent near words the smallest in code-point order is the form. Empty tables, and
tables without near words, give no rows or words without forms. Words of any length are searched and verified whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from briefloom.llm.common import small, stored

LETTERS = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Runs whose check sum this divides lose one letter.
EVERY = 199
#: Letter groups, the levels of the trie.
GROUPS = 18
#: Words of one cell that one task holds, and looking words that it searches at once.
PART_WORDS, LOT_WORDS = 20_000, 50_000
#: Most levels that name a cell.
MAX_CELL_LEVELS = 5
#: Below this many words a branch is not opened further: their remaining counts are compared at once.
BRANCH_WORDS = 16
#: Longest word compared in whole arrays; longer ones are compared pair by pair.
ARRAY_LETTERS = 40


def words(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_letters: int = 6, min_count: int = 5) -> DataFrame:
    """``word, n``: the words of all texts with at least ``min_letters`` letters and ``min_count`` occurrences."""
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
                       F.explode(F.regexp_extract_all(F.translate(F.col(text_col), UPPER, LOWER), F.lit(LETTERS), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= min_letters).withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    cut = F.concat(F.left("run", at), F.substr("run", at + 2))
    made = runs.select(F.when(F.col("h") % EVERY == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= min_letters)
    return made.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def letter_groups(counted: DataFrame) -> list[str]:
    """Letters dealt over ``GROUPS`` groups by frequency, so that frequent letters share none. At most 116 letters come to the driver."""
    seen = counted.select(F.explode(F.split("word", "")).alias("letter")).where(F.col("letter") != "").groupBy("letter").count().collect()
    ranked = sorted(seen, key=lambda r: (-r["count"], r["letter"]))
    return ["".join(r["letter"] for r in ranked[g::GROUPS]) for g in range(GROUPS)]


def _count_of(letters: str) -> Column:
    return (F.length("word") - F.length(F.translate("word", letters, ""))).cast("int") if letters else F.lit(0)


def _cell(counts: list[Column], shift: tuple[int, ...]) -> Column:
    """The name of the cell that lies ``shift`` away, null where a count would be negative."""
    moved = [c + s for c, s in zip(counts, shift)]
    ok = F.lit(True)
    for m, s in zip(moved, shift):
        ok = ok & (m >= 0) if s < 0 else ok
    return F.when(ok, F.concat_ws(".", *[m.cast("string") for m in moved]))


def reachable(levels: int) -> list[tuple[int, ...]]:
    """All shifts of ``levels`` counts within a surplus of one and a deficit of one."""
    shifts = {tuple([0] * levels)}
    for up in range(-1, levels):
        for down in range(-1, levels):
            if up != down or up < 0:
                shifts.add(tuple((k == up) - (k == down) for k in range(levels)))
    return sorted(shifts)


def cell_levels(numbered: DataFrame, groups: list[str]) -> int:
    """Fewest levels by which no cell has more than ``PART_WORDS`` words, ``MAX_CELL_LEVELS`` at most."""
    counts = [_count_of(g) for g in groups[:MAX_CELL_LEVELS]]
    names = F.array(*[F.struct(F.lit(p).alias("p"), F.concat_ws(".", *[c.cast("string") for c in counts[:p]]).alias("cell")) for p in range(1, MAX_CELL_LEVELS + 1)])
    largest = numbered.select(F.explode(names).alias("x")).groupBy("x.p", "x.cell").count().groupBy("p").agg(F.max("count").alias("most"))
    most = {r["p"]: r["most"] for r in largest.collect()}
    return next((p for p in range(1, MAX_CELL_LEVELS + 1) if most.get(p, 0) <= PART_WORDS), MAX_CELL_LEVELS)


class Trie:
    """The words of one part of a cell in the order of their count vectors: a node is a run of rows that agree so far."""

    def __init__(self, wid: np.ndarray, n: np.ndarray, texts: list[str], group_of: np.ndarray) -> None:
        self.group_of = group_of
        vectors = self.vectors(texts)
        order = np.lexsort(vectors.T[::-1])
        self.wid, self.n, self.vec = wid[order], n[order], vectors[order]
        self.texts = np.array(texts, dtype=object)[order]
        self.rows, self.size = _letters(self.texts)

    def vectors(self, texts: list[str]) -> np.ndarray:
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        letters = np.frombuffer("".join(texts).encode("latin-1"), np.uint8)
        of = np.repeat(np.arange(len(texts)), sizes) * GROUPS + self.group_of[letters]
        return np.bincount(of, minlength=len(texts) * GROUPS).reshape(-1, GROUPS).astype(np.int32)

    def search(self, texts: list[str], wid: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Index pairs (looking word, held word) at distance one, each unordered pair from one side only."""
        q = self.vectors(texts)
        looking = np.array(texts, dtype=object)
        rows, size = _letters(looking)
        none = np.zeros(len(texts), np.int8)
        todo = [(0, len(self.wid), 0, np.arange(len(texts)), none, none)]
        while todo:
            lo, hi, level, at, plus, minus = todo.pop()
            if hi - lo <= BRANCH_WORDS or level == GROUPS:
                for r in range(lo, hi):
                    gap = self.vec[r, level:] - q[at, level:]
                    up, down = plus + np.maximum(gap, 0).sum(1), minus + np.maximum(-gap, 0).sum(1)
                    fit = (up <= 1) & ((down == up) & (wid[at] < self.wid[r]) | (down == 0) & (up == 1))
                    found = at[fit]
                    if len(found):
                        near = _one_apart(rows, size, looking, found, self.rows[r], int(self.size[r]), self.texts[r])
                        yield found[near], np.full(int(near.sum()), r)
                continue
            column = self.vec[lo:hi, level]
            starts = np.flatnonzero(np.r_[True, column[1:] != column[:-1]])
            mine = q[at, level]
            for a, b in zip(starts, np.r_[starts[1:], hi - lo]):
                gap = column[a] - mine
                p, m = plus + (gap == 1), minus + (gap == -1)
                fit = (np.abs(gap) <= 1) & (p <= 1) & (m <= 1)
                if fit.any():
                    todo.append((lo + a, lo + b, level + 1, at[fit], p[fit], m[fit]))


def _letters(texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters of words up to ``ARRAY_LETTERS`` as rows of bytes padded with zeros, and all sizes."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    width = int(min(size.max(initial=1), ARRAY_LETTERS)) + 1
    fixed = np.array([t.encode("latin-1") if len(t) <= ARRAY_LETTERS else b"" for t in texts], dtype=f"S{width}")
    return fixed.view(np.uint8).reshape(len(texts), width), size


def is_one_apart(a: str, b: str) -> bool:
    """Whether ``a`` and ``b`` differ by exactly one inserted, deleted or replaced letter."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i:] == b[i + 1:] if len(b) > len(a) else a[i + 1:] == b[i + 1:]


def _one_apart(rows: np.ndarray, size: np.ndarray, texts: np.ndarray, at: np.ndarray, held: np.ndarray, held_size: int, held_text: str) -> np.ndarray:
    """Which of the looking words ``at``, as long as the held word or one letter shorter, are one edit from it."""
    if held_size > ARRAY_LETTERS:
        return np.fromiter((is_one_apart(texts[i], held_text) for i in at), bool, len(at))
    other = rows[at, :held_size]
    if other.shape[1] < held_size:
        other = np.pad(other, ((0, 0), (0, held_size - other.shape[1])))
    differs = other != held[:held_size]
    equal_long = size[at] == held_size
    # a shorter word follows the held one up to some place and from there on the held word's next letters
    ahead = np.argmax(differs, axis=1)
    behind = np.cumsum((other[:, :-1] != held[1:held_size])[:, ::-1], axis=1)[:, ::-1]
    tail = np.concatenate([behind, np.zeros((len(at), 1), behind.dtype)], axis=1)
    return np.where(equal_long, differs.sum(1) == 1, tail[np.arange(len(at)), ahead] == 0)


def near_pairs(counted: DataFrame) -> DataFrame:
    """``word, n, near, near_n`` for all ordered pairs of ``counted(word, n)`` at distance one."""
    # numbers are written before they are used, so a task run again sees the same ones
    numbered = stored(counted.select("word", "n", F.monotonically_increasing_id().alias("wid")), "words")
    groups = letter_groups(numbered)
    levels = cell_levels(numbered, groups)
    counts = [_count_of(g) for g in groups[:levels]]
    homes = numbered.withColumn("cell", _cell(counts, tuple([0] * levels)))
    cells = stored(homes.groupBy("cell").count().select("cell", F.ceil(F.col("count") / PART_WORDS).cast("int").alias("parts")), "cells")
    held = homes.join(small(cells), "cell").select("cell", F.pmod(F.xxhash64("wid"), F.col("parts")).cast("int").alias("part"), F.lit(0).alias("looks"), "wid", "word", "n")
    reach = F.array(*[_cell(counts, s) for s in reachable(levels)])
    looking = numbered.withColumn("cell", F.explode(F.filter(reach, lambda c: c.isNotNull()))).join(small(cells), "cell")
    looking = looking.select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("looks"), "wid", "word", "n")
    group_of = np.zeros(256, np.int64)
    for g, letters in enumerate(groups):
        for c in letters:
            group_of[ord(c)] = g

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, rows, lot, trie = None, [], [], None

        def flush() -> Iterator[tuple]:
            nonlocal trie, rows, lot
            if lot and rows:
                home = pd.concat(rows)
                trie, rows = Trie(home["wid"].to_numpy(), home["n"].to_numpy(), list(home["word"]), group_of), []
            if lot and trie:
                ask, lot = pd.concat(lot), []
                texts, times = np.array(list(ask["word"]), dtype=object), ask["n"].to_numpy()
                for i, r in trie.search(list(texts), ask["wid"].to_numpy()):
                    yield texts[i], times[i], trie.texts[r], trie.n[r]
            lot = []
        for batch in batches:
            for key, part in batch.groupby(["cell", "part", "looks"], sort=False):
                if key[:2] != where:
                    yield from _joined(flush())
                    where, rows, lot, trie = key[:2], [], [], None
                if key[2] == 0:
                    rows.append(part)
                else:
                    lot.append(part)
                    if sum(map(len, lot)) >= LOT_WORDS:
                        yield from _joined(flush())
        yield from _joined(flush())

    dealt = held.unionByName(looking).repartition("cell", "part").sortWithinPartitions("cell", "part", "looks")
    found = dealt.mapInPandas(search, "word string, n long, near string, near_n long")
    both = F.array(F.struct("word", "n", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    return found.select(F.explode(both).alias("x")).select("x.*")


def _joined(pieces: Iterator[tuple], rows: int = 20_000) -> Iterator[pd.DataFrame]:
    """Small pieces joined to frames of about ``rows`` rows."""
    def frame() -> pd.DataFrame:
        return pd.DataFrame(dict(zip(("word", "n", "near", "near_n"), map(np.concatenate, zip(*held)))))
    held, size = [], 0
    for piece in pieces:
        held.append(piece)
        size += len(piece[0])
        if size >= rows:
            yield frame()
            held, size = [], 0
    if held:
        yield frame()


def group_variants(counted: DataFrame, times: int = 5) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of every word of ``counted(word, n)``.

    ``form`` is the near word of largest n, if that is at least ``times`` the word's n (``times`` of 2 or more); ``root``
    the last word reached by following forms. A form is ``times`` as frequent as its word, so chains are at most
    log(largest n) long and are followed by doubling; only words that have a form take part in that.
    """
    counted = stored(counted, "counted")
    near = near_pairs(counted).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("near"))).alias("best"))
    out = counted.join(near, "word", "left")
    ok = -F.col("best.m") >= times * F.col("n")
    out = stored(out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(ok, F.col("best.near")).alias("form"),
                            F.when(ok, -F.col("best.m")).cast("long").alias("form_n")), "forms")
    top = out.agg(F.max("n")).first()[0] or 1
    links = out.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    for _ in range(max(1, math.ceil(math.log2(max(2.0, math.log(top, times) + 1))))):
        step = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        links = stored(links.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
    return out.join(links, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))

"""Splitting one text into paragraphs, sentences, chunks and clauses, as array expressions.

Every function maps a text column to an array column. A document is one row, so
its pieces never leave the row until the caller explodes them: no shuffle, and
the work of a document is bounded by its own text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .columns import bind, drop_blank, find_all, squeeze, strip, token_count, words

STRINGS = "array<string>"


def paragraphs(c: Column, min_chars: int = 31) -> Column:
    return F.filter(F.transform(F.split(c, r"(?U)\n\s*\n"), lambda p: strip(p)), lambda p: F.length(p) >= min_chars)


def sentences(c: Column) -> Column:
    """Sentences of the flattened text."""
    return drop_blank(F.split(F.regexp_replace(squeeze(c), r"([.!?])\s+", "$1\n"), "\n"))


def sentences_raw(c: Column) -> Column:
    """Sentences of the text as it is; line breaks inside a sentence stay."""
    return drop_blank(F.split(strip(c), r"(?U)(?<=[.!?])\s+"))


def sentence_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"[.!?]+"), lambda s: F.length(strip(s)) > 0))


def grouped(items: Column, n: int, sep: str = " ") -> Column:
    """Join every ``n`` consecutive items of an array."""
    return bind(items, lambda xs: F.when(F.size(xs) == 0, F.array().cast(STRINGS)).otherwise(F.transform(
        F.sequence(F.lit(1), F.size(xs), F.lit(n)), lambda i: F.array_join(F.slice(xs, i, n), sep))))


def group_sentences(c: Column, n: int = 5) -> Column:
    """The text itself up to ``n`` sentences, else groups of ``n`` sentences."""
    return bind(sentences_raw(c), lambda xs: F.when(F.size(xs) <= n, F.array(c)).otherwise(grouped(xs, n)))


def word_windows(c: Column, size: int) -> Column:
    return grouped(words(c), size)


# --- clauses -----------------------------------------------------------------

def any_phrase(phrases: list[str]) -> str:
    """Pattern of any of ``phrases`` (words joined by blanks), case ignored: each first word is looked for once, by its letter."""
    heads: dict[str, list[str]] = {}
    for p in phrases:
        head, _, rest = p.partition(r"\s+")
        heads.setdefault(head, []).append(rest)
    if not all(re.fullmatch("[a-z]+", h) and all(rs) for h, rs in heads.items()):
        return "(?i)(?:" + "|".join(phrases) + ")"
    each = "|".join(rf"{h}\s+(?:{'|'.join(rs)})" for h, rs in heads.items())
    return f"(?i)(?=[{''.join(sorted({h[0] for h in heads}))}])(?:{each})"


def _cut_points(hits: Column, chunk: Column) -> Column:
    """Where to cut before every trigger but the first: after the nearest separator within 60 characters
    before it (separators in fixed priority), or right at the trigger when that lies behind the last cut."""

    def separator_end(start: Column) -> Column:
        back = F.reverse(F.substring(chunk, F.greatest(start - 60, F.lit(0)) + 1, F.least(start, F.lit(60))))
        return bind(back, lambda b: F.coalesce(*[
            F.when(F.locate(sep[::-1], b) > 0, start - F.locate(sep[::-1], b) + 1)
            for sep in fixed.CUT_BEFORE_TRIGGER], F.lit(0)))

    def step(acc: Column, start: Column) -> Column:
        return bind(separator_end(start), lambda b: bind(
            F.when(b > acc["last"], b).otherwise(start),
            lambda cut: F.struct(F.concat(acc["cuts"], F.array(cut)).alias("cuts"), cut.alias("last"))))

    zero = F.struct(F.array().cast("array<int>").alias("cuts"), F.lit(0).alias("last"))
    return F.aggregate(hits, zero, step, lambda acc: acc["cuts"])


def _split_at_triggers(chunk: Column, trigger: str) -> Column:
    def starts(parts: Column) -> Column:
        def step(acc: Column, p: Column) -> Column:
            start = acc["at"] + F.length(p["piece"])
            return F.when(p["hit"].isNull(), acc).otherwise(F.struct(
                (start + F.length(p["hit"])).alias("at"),
                F.concat(acc["xs"], F.array(start)).alias("xs")))
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("xs"))
        return F.aggregate(parts, zero, step, lambda acc: acc["xs"])

    def cut(hits: Column) -> Column:
        parts = F.zip_with(F.split(chunk, trigger), hits, lambda p, h: F.struct(p.alias("piece"), h.alias("hit")))
        later = bind(starts(parts), lambda xs: F.slice(xs, 2, F.size(xs)))
        cuts = F.concat(F.array(F.lit(0)), _cut_points(later, chunk), F.array(F.length(chunk)))
        return bind(cuts, lambda cs: drop_blank(F.transform(
            F.sequence(F.lit(0), F.size(cs) - 2),
            lambda i: F.substring(chunk, F.get(cs, i) + 1, F.get(cs, i + 1) - F.get(cs, i)))))

    return bind(find_all(chunk, trigger), lambda hits: F.when(F.size(hits) <= 1, F.array(chunk)).otherwise(cut(hits)))


def _split_at_connectives(chunk: Column, max_sentences: int) -> Column:
    """Cut an over-long chunk at connectives; a connective (or any piece under 20 characters) closes the piece
    before it."""
    pattern = r"(?i)(?:(?<=[.;])\s+)?\b(" + fixed.CONNECTIVES + r")\b"

    def pieces(found: Column) -> Column:
        return F.filter(F.flatten(F.zip_with(F.split(chunk, pattern), found, lambda p, w: F.array(p, w))),
                        lambda p: p.isNotNull())

    def step(acc: Column, raw: Column) -> Column:
        return bind(strip(raw), lambda p: F.when(
            F.length(p) < 20, F.struct(acc["out"].alias("out"), strip(F.concat_ws(" ", acc["buf"], p)).alias("buf"))
        ).otherwise(F.struct(
            F.when(F.length(acc["buf"]) > 0, F.concat(acc["out"], F.array(acc["buf"]))).otherwise(acc["out"]).alias("out"),
            p.alias("buf"))))

    zero = F.struct(F.array().cast(STRINGS).alias("out"), F.lit("").alias("buf"))
    close = lambda acc: F.when(F.length(acc["buf"]) > 0, F.concat(acc["out"], F.array(acc["buf"]))).otherwise(acc["out"])
    split = bind(find_all(chunk, pattern, 1), lambda found: F.when(F.size(found) == 0, F.array(chunk)).otherwise(
        F.aggregate(pieces(found), zero, step, close)))
    return F.when(sentence_count(chunk) <= max_sentences, F.array(chunk)).otherwise(split)


def _merge_short(chunks: Column, below: int) -> Column:
    def step(acc: Column, x: Column) -> Column:
        joined = F.when(F.length(acc["buf"]) > 0, strip(F.concat(acc["buf"], F.lit(" "), x))).otherwise(x)
        return F.when(F.length(acc["buf"]) + F.length(x) < below,
                      F.struct(acc["out"].alias("out"), joined.alias("buf"))).otherwise(F.struct(
                          F.when(F.length(acc["buf"]) > 0, F.concat(acc["out"], F.array(acc["buf"])))
                          .otherwise(acc["out"]).alias("out"), x.alias("buf")))

    zero = F.struct(F.array().cast(STRINGS).alias("out"), F.lit("").alias("buf"))
    return F.aggregate(chunks, zero, step, lambda acc: F.when(
        F.length(acc["buf"]) > 0, F.concat(acc["out"], F.array(acc["buf"]))).otherwise(acc["out"]))


def atomic_clauses(c: Column, triggers: list[str] | None = None, max_sentences: int = 5, merge_below: int = 80,
                   min_chars: int = 21) -> Column:
    """Split one paragraph into clauses holding one duty each: boundaries, triggers, connectives, merge, length."""
    trigger = any_phrase(triggers or fixed.TRIGGER_PHRASES)
    parts = drop_blank(F.split(c, rf"(?i)(?=\s)(?:{fixed.CLAUSE_BOUNDARY})"))  # every boundary starts with white space
    parts = F.flatten(F.transform(parts, lambda p: _split_at_triggers(p, trigger)))
    parts = F.flatten(F.transform(parts, lambda p: _split_at_connectives(p, max_sentences)))
    parts = _merge_short(parts, merge_below)
    parts = F.flatten(F.transform(parts, lambda p: F.when(
        sentence_count(p) > max_sentences, group_sentences(p, max_sentences)).otherwise(F.array(p))))
    return F.when(F.length(c) < merge_below, F.array(c)).otherwise(
        F.filter(parts, lambda p: F.length(p) >= min_chars))


# --- chunks --------------------------------------------------------------------

def packed_chunks(c: Column, min_words: int, max_words: int) -> Column:
    """Pack paragraphs into chunks of ``min_words``..``max_words`` words.

    The fold carries paragraph numbers and word counts only; texts are cut once at the end.
    """
    paras = F.transform(drop_blank(F.split(c, "\n\n")),
                        lambda p: F.struct(p.alias("text"), token_count(p).alias("n")))
    runs = "array<struct<a:int,b:int>>"

    def flush(acc: Column) -> Column:
        return F.when(acc["b"] > acc["a"], F.concat(acc["out"], F.array(F.struct(acc["a"].alias("a"), acc["b"].alias("b"))))
                      ).otherwise(acc["out"])

    def state(out: Column, a: Column, b: Column, n: Column) -> Column:
        return F.struct(out.cast(runs).alias("out"), a.cast("int").alias("a"), b.cast("int").alias("b"),
                        n.cast("int").alias("n"))

    def take(acc: Column, p: Column) -> Column:
        total = acc["n"] + p["n"]
        nxt = acc["b"] + 1
        return F.when(total.between(min_words, max_words),
                      state(F.concat(acc["out"], F.array(F.struct(acc["a"].alias("a"), nxt.alias("b")))), nxt, nxt, F.lit(0))
                      ).otherwise(state(acc["out"], acc["a"], nxt, total))

    def step(acc: Column, p: Column) -> Column:
        flushed = state(flush(acc), acc["b"], acc["b"], F.lit(0))
        oversize = state(F.concat(flush(acc), F.array(F.struct(acc["b"].alias("a"), (acc["b"] + 1).alias("b")))),
                         acc["b"] + 1, acc["b"] + 1, F.lit(0))
        return F.when(p["n"] > max_words, oversize).otherwise(F.when(
            (acc["b"] > acc["a"]) & (acc["n"] + p["n"] > max_words), bind(flushed, lambda s: take(s, p))
        ).otherwise(take(acc, p)))

    def cut(ps: Column) -> Column:
        zero = state(F.array().cast(runs), F.lit(0), F.lit(0), F.lit(0))
        ranges = F.aggregate(ps, zero, step, flush)

        def text_of(r: Column) -> Column:
            run = F.slice(ps, r["a"] + 1, r["b"] - r["a"])
            return bind(run, lambda rs: F.when(
                (F.size(rs) == 1) & (F.get(rs, F.lit(0))["n"] > max_words),
                word_windows(F.get(rs, F.lit(0))["text"], max_words)
            ).otherwise(F.array(F.array_join(F.transform(rs, lambda x: x["text"]), "\n\n"))))

        return F.flatten(F.transform(ranges, text_of))

    return bind(paras, cut)


def merge_tail(chunks: Column, min_words: int, max_words: int) -> Column:
    """Join a last chunk under ``min_words`` to the one before it while both together stay within 2 x ``max_words``."""
    def merged(xs: Column) -> Column:
        last, prev = F.element_at(xs, -1), F.element_at(xs, -2)
        fits = (token_count(last) < min_words) & (token_count(prev) + token_count(last) <= 2 * max_words)
        return F.when(fits, F.concat(F.slice(xs, 1, F.size(xs) - 2), F.array(F.concat(prev, F.lit("\n\n"), last)))
                      ).otherwise(xs)
    return bind(chunks, lambda xs: F.when(F.size(xs) < 2, xs).otherwise(merged(xs)))


def with_overlap(chunks: Column, overlap: int) -> Column:
    """Put the last ``overlap`` words of each chunk before the next one."""
    def tail(x: Column) -> Column:
        return bind(words(x), lambda ws: F.when(F.size(ws) > overlap, F.array_join(F.slice(ws, -overlap, overlap), " "))
                    .otherwise(x))
    return bind(chunks, lambda xs: F.transform(xs, lambda x, i: F.when(
        i == 0, x).otherwise(F.concat(tail(F.get(xs, i - 1)), F.lit("\n\n"), x))))


def chunk_text(c: Column, min_words: int = 1200, max_words: int = 1500, overlap: int = 150) -> Column:
    packed = merge_tail(packed_chunks(c, min_words, max_words), min_words, max_words)
    return with_overlap(packed, overlap) if overlap > 0 else packed


def chunk_sequential(c: Column, max_words: int = 3000) -> Column:
    return chunk_text(c, int(max_words * 0.8), max_words, 200)

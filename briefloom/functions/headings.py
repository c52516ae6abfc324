"""Headings and sections of a document, as column expressions over its line array."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .columns import bind, strip, token_count, word_count
from .segmenting import chunk_sequential

SECTION = "array<struct<title:string,content:string>>"


def heading_key(c: Column) -> Column:
    """Heading without markup, label, number and outer punctuation, lower-case."""
    s = F.translate(F.lower(strip(c)), "*#", "")
    s = F.regexp_replace(s, "(?iU)" + fixed.HEADING_LABEL_PREFIX, "")
    s = F.regexp_replace(s, "(?iU)" + fixed.HEADING_NUMBER_PREFIX, "")
    return strip(F.regexp_replace(s, r"(?U)\s+", " "), " :.-")


def heading_slug(c: Column) -> Column:
    s = F.regexp_replace(heading_key(c), r"(?U)[^a-z0-9\s_]", "")
    s = strip(F.regexp_replace(s, r"(?U)\s+", "_"), "_")
    return F.when(F.length(s) == 0, "section").otherwise(s)


def is_noise_heading(line: Column, noise: list[str] | None = None, single: list[str] | None = None) -> Column:
    blank_field = reduce(lambda a, b: a | b, [F.lower(line).contains(w) for w in fixed.BLANK_FIELDS])

    def test(key: Column) -> Column:
        return ((F.length(key) == 0) | key.isin(*(noise or fixed.NOISE_HEADINGS))
                | key.rlike("(?U)" + fixed.HONORIFIC_HEADING) | blank_field
                | ((token_count(key) == 1) & ~key.isin(*(single or fixed.SINGLE_WORD_HEADINGS))))

    return bind(heading_key(line), test)


def _bare(line: Column) -> Column:
    return strip(F.translate(line, "*#", ""))


def is_section_heading(line: Column) -> Column:
    """Heading test of the section splitter, for one trimmed non-blank line."""
    def test(clean: Column) -> Column:
        n = token_count(clean)
        return (line.startswith("#")
                | (line.startswith("**") & line.endswith("**") & n.between(2, 11))
                | clean.rlike("(?iU)" + fixed.NAMED_HEADING)
                | (clean.rlike("(?U)" + fixed.NUMBERED_HEADING) & n.between(2, 10)
                   & ~F.right(clean, F.lit(1)).isin(".", ";", ","))
                | ((F.upper(clean) == clean) & clean.rlike(r"\p{Lu}") & n.between(2, 7)))
    return (F.length(line) < 120) & bind(_bare(line), test)


def section_array(c: Column, min_chars: int = 50) -> Column:
    """array<struct<title, content>> in text order.

    A noise heading disappears without opening a section; text before the first
    heading and sections under ``min_chars`` are left out.
    """
    lines = F.filter(F.transform(F.split(c, "\n"), lambda x: F.struct(x.alias("raw"), strip(x).alias("line"))),
                     lambda x: F.length(x["line"]) > 0)
    marked = F.transform(lines, lambda x: F.struct(x["raw"].alias("raw"), x["line"].alias("line"),
                                                   is_section_heading(x["line"]).alias("heading")))
    kept = F.filter(marked, lambda x: ~x["heading"] | ~is_noise_heading(x["line"]))

    def cut(ls: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(ls) - 1), lambda i: F.get(ls, i)["heading"])

        def section(heads: Column) -> Column:
            return F.transform(heads, lambda i, n: F.struct(
                _bare(F.get(ls, i)["line"]).alias("title"),
                F.array_join(F.transform(
                    F.slice(ls, i + 2, F.coalesce(F.get(heads, n + 1), F.size(ls)) - i - 1),
                    lambda x: x["raw"]), "\n").alias("content")))

        return F.when(F.size(ls) == 0, F.array().cast(SECTION)).otherwise(bind(at, section))

    return F.filter(bind(kept, cut), lambda s: (F.length(strip(s["content"])) >= min_chars)
                    & (strip(s["title"]) != fixed.PREAMBLE_TITLE))


def section_text(s: Column) -> Column:
    return F.concat(s["title"], F.lit("\n"), s["content"])


def selected_text(c: Column, wanted: list[str]) -> Column:
    """Text of the sections whose heading equals, contains or is contained in a wanted heading; else all text."""
    keys = [heading_key(F.lit(w)) for w in wanted]
    hit = lambda k: reduce(lambda a, b: a | b, [k.contains(w) | w.contains(k) for w in keys])
    picked = F.filter(section_array(c), lambda s: bind(heading_key(s["title"]), hit))
    text = F.array_join(F.transform(picked, section_text), "\n\n")
    return bind(text, lambda t: F.when(F.length(strip(t)) == 0, c).otherwise(t))


def section_chunks(c: Column, max_words: int = 3000) -> Column:
    """Pack whole sections greedily up to ``max_words``; a longer section is chunked on its own.

    Fewer than three sections: chunk the text by paragraphs instead.
    """
    runs = "array<struct<a:int,b:int>>"

    def pack(ss: Column) -> Column:
        def state(out: Column, a: Column, b: Column, n: Column) -> Column:
            return F.struct(out.cast(runs).alias("out"), a.cast("int").alias("a"), b.cast("int").alias("b"),
                            n.cast("int").alias("n"))

        def flush(acc: Column) -> Column:
            run = F.array(F.struct(acc["a"].alias("a"), acc["b"].alias("b")))
            return F.when(acc["b"] > acc["a"], F.concat(acc["out"], run)).otherwise(acc["out"])

        def step(acc: Column, s: Column) -> Column:
            nxt = acc["b"] + 1
            alone = F.array(F.struct(acc["b"].alias("a"), nxt.alias("b")))
            return F.when(s["n"] > max_words, state(F.concat(flush(acc), alone), nxt, nxt, F.lit(0))
                          ).otherwise(F.when(acc["n"] + s["n"] > max_words, state(flush(acc), acc["b"], nxt, s["n"])
                                             ).otherwise(state(acc["out"], acc["a"], nxt, acc["n"] + s["n"])))

        ranges = F.aggregate(ss, state(F.array().cast(runs), F.lit(0), F.lit(0), F.lit(0)), step, flush)

        def text_of(r: Column) -> Column:
            return bind(F.slice(ss, r["a"] + 1, r["b"] - r["a"]), lambda rs: F.when(
                (F.size(rs) == 1) & (F.get(rs, F.lit(0))["n"] > max_words),
                chunk_sequential(F.get(rs, F.lit(0))["text"], max_words)
            ).otherwise(F.array(F.array_join(F.transform(rs, lambda x: x["text"]), "\n\n"))))

        return F.flatten(F.transform(ranges, text_of))

    texts = F.transform(section_array(c), section_text)
    counted = F.transform(texts, lambda t: F.struct(t.alias("text"), word_count(t).alias("n")))
    return bind(counted, lambda ss: F.when(F.size(ss) < 3, chunk_sequential(c, max_words)).otherwise(pack(ss)))


def headed_parts(c: Column, headings: Column, keys: Column, opening: Column) -> Column:
    """array<struct<key, content>> of a text with headings.

    ``headings`` are normalised heading texts, ``keys`` their output keys, same
    order. A line is a heading when it equals one of them, else when it contains
    one (first in order). Text before the first heading goes to ``opening``; a
    repeated key keeps its last part; canonical order first, then others.
    """
    pair = "array<struct<key:string,content:string>>"

    def matched(hs: Column, line: Column) -> Column:
        def find(k: Column) -> Column:
            exact = F.array_position(hs, k).cast("int")
            inside = F.get(F.filter(F.sequence(F.lit(1), F.size(hs)), lambda i: k.contains(F.get(hs, i - 1))), F.lit(0))
            return F.when(exact > 0, exact).otherwise(F.coalesce(inside, F.lit(0)))
        return bind(heading_key(F.replace(strip(line), F.lit("**"), F.lit(""))), find)

    def build(hs: Column) -> Column:
        marked = F.transform(F.split(c, "\n"), lambda x: F.struct(x.alias("raw"), matched(hs, x).alias("h")))

        def cut(ls: Column) -> Column:
            at = F.concat(F.array(F.lit(-1)), F.filter(F.sequence(F.lit(0), F.size(ls) - 1),
                                                       lambda i: F.get(ls, i)["h"] > 0))

            def parts(heads: Column) -> Column:
                raw = F.transform(heads, lambda i, n: F.struct(
                    F.when(i < 0, opening).otherwise(F.get(keys, F.get(ls, i)["h"] - 1)).alias("key"),
                    F.slice(ls, i + 2, F.coalesce(F.get(heads, n + 1), F.size(ls)) - i - 1).alias("lines")))
                full = F.transform(F.filter(raw, lambda p: F.size(p["lines"]) > 0), lambda p: F.struct(
                    p["key"].alias("key"),
                    strip(F.array_join(F.transform(p["lines"], lambda x: x["raw"]), "\n")).alias("content")))
                return bind(full, lambda ps: F.filter(ps, lambda p, i: ~F.exists(
                    F.slice(ps, i + 2, F.size(ps)), lambda q: q["key"] == p["key"])))

            return bind(at, parts)

        return bind(marked, cut)

    def order(ps: Column) -> Column:
        known = F.flatten(F.transform(keys, lambda k: F.filter(ps, lambda p: p["key"] == k)))
        extra = F.filter(ps, lambda p: ~F.array_contains(keys, p["key"]))
        return F.filter(F.concat(known, extra), lambda p: F.length(p["content"]) > 0).cast(pair)

    return bind(headings, lambda hs: bind(build(hs), order))



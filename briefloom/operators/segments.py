"""Segmentation operators: one row per document in, one row per unit out (or one array per document).

Units are cut inside the document's row and exploded last, so none of these
operators shuffles and the position column always comes from the text order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed, headings, segmenting
from ..functions.columns import bind, drop_blank, lookup, strip, word_count


def explode_units(df: DataFrame, units: Column, pos: str, unit: str, text: str = "text") -> DataFrame:
    """One row per array element, all other columns kept, ``text`` replaced by the unit."""
    keep = [c for c in df.columns if c != text]
    return df.select(*keep, F.posexplode(units).alias(pos, unit))


def lines(df: DataFrame, text: str = "text") -> DataFrame:
    return explode_units(df, F.split(F.col(text), "\n"), "line_no", "line", text)


def paragraphs(df: DataFrame, min_chars: int = 31, text: str = "text") -> DataFrame:
    return explode_units(df, segmenting.paragraphs(F.col(text), min_chars), "para_no", "paragraph", text)


def sentences(df: DataFrame, text: str = "text") -> DataFrame:
    return explode_units(df, segmenting.sentences(F.col(text)), "pos", "sentence", text)


def sentences_raw(df: DataFrame, text: str = "text") -> DataFrame:
    return explode_units(df, segmenting.sentences_raw(F.col(text)), "pos", "sentence", text)


def sentence_count(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn("sentence_count", segmenting.sentence_count(F.col(text)).cast("long"))


def atomic_clauses(paras: DataFrame, triggers: list[str] | None = None, max_sentences: int = 5,
                   merge_below: int = 80, min_chars: int = 21, paragraph: str = "paragraph") -> DataFrame:
    """One row per single-duty clause; ``full_text`` keeps the paragraph it came from."""
    cut = segmenting.atomic_clauses(F.col(paragraph), triggers, max_sentences, merge_below, min_chars)
    keep = [c for c in paras.columns if c != paragraph]
    return paras.select(*keep, F.col(paragraph).alias("full_text"), F.posexplode(cut).alias("pos", "clause"))


def group_sentences(df: DataFrame, n: int = 5, text: str = "text") -> DataFrame:
    return explode_units(df, segmenting.group_sentences(F.col(text), n), "pos", "group_text", text)


def word_windows(df: DataFrame, size: int, text: str = "text") -> DataFrame:
    return explode_units(df, segmenting.word_windows(F.col(text), size), "pos", "window", text)


def pack_chunks(df: DataFrame, min_words: int = 1200, max_words: int = 1500, text: str = "text") -> DataFrame:
    """Adds ``chunks`` array<string>; no tail merge, no overlap yet."""
    return df.withColumn("chunks", segmenting.packed_chunks(F.col(text), min_words, max_words))


def merge_tail(df: DataFrame, min_words: int = 1200, max_words: int = 1500) -> DataFrame:
    return df.withColumn("chunks", segmenting.merge_tail(F.col("chunks"), min_words, max_words))


def add_overlap(df: DataFrame, words: int = 150) -> DataFrame:
    return df.withColumn("chunks", segmenting.with_overlap(F.col("chunks"), words))


def chunk_sequential(df: DataFrame, max_words: int = 3000, text: str = "text") -> DataFrame:
    return explode_units(df, segmenting.chunk_sequential(F.col(text), max_words), "chunk_index", "chunk_text", text)


def chunk_by_sections(df: DataFrame, max_words: int = 3000, text: str = "text") -> DataFrame:
    return explode_units(df, headings.section_chunks(F.col(text), max_words), "chunk_index", "chunk_text", text)


def sections(df: DataFrame, min_chars: int = 50, text: str = "text") -> DataFrame:
    keep = [c for c in df.columns if c != text]
    rows = df.select(*keep, F.posexplode(headings.section_array(F.col(text), min_chars)).alias("section_no", "s"))
    return rows.select(*keep, "section_no", F.col("s.title").alias("title"), F.col("s.content").alias("content"))


def heading_key(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("heading_key", headings.heading_key(F.col(column)))


def heading_slug(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("heading_slug", headings.heading_slug(F.col(column)))


def is_noise_heading(df: DataFrame, column: str, noise: list[str] | None = None,
                     single: list[str] | None = None) -> DataFrame:
    return df.withColumn("is_noise_heading", headings.is_noise_heading(F.col(column), noise, single))


def select_sections(df: DataFrame, wanted: Sequence[str], text: str = "text") -> DataFrame:
    """Reduce each text to its wanted sections; a text with none of them stays whole."""
    return df.withColumn(text, headings.selected_text(F.col(text), list(wanted)))


def _template(type_col: Column) -> Column:
    templates = F.create_map(*[x for name, hs in fixed.TEMPLATES.items()
                               for x in (F.lit(name), F.array(*[F.lit(h) for h in hs]))])
    return F.coalesce(F.try_element_at(templates, F.lower(type_col)),
                      F.array(*[F.lit(h) for h in fixed.TEMPLATES["general"]]))


def parse_headed_text(df: DataFrame, type_col: str | None = None, wanted: Sequence[str] | None = None,
                      text: str = "text") -> DataFrame:
    """One row per part of a headed text: (…, part_no, key, content).

    Headings come from the template of the row's document type, or from ``wanted``.
    """
    if wanted:
        heads = F.array(*[F.lit(h) for h in wanted])
        keys = F.transform(heads, headings.heading_slug)
        opening = F.get(keys, F.lit(0))
    else:
        heads = _template(F.col(type_col) if type_col else F.lit("general"))
        keys = F.transform(heads, lambda h: F.translate(F.lower(h), " ,", "_"))
        opening = F.lit(fixed.OPENING_KEY)
    parts = bind(keys, lambda ks: headings.headed_parts(
        F.coalesce(F.col(text), F.lit("")), F.transform(heads, headings.heading_key), ks, opening))
    keep = [c for c in df.columns if c != text]
    rows = df.select(*keep, F.posexplode(parts).alias("part_no", "p"))
    return rows.select(*keep, "part_no", F.col("p.key").alias("key"), F.col("p.content").alias("content"))


def template_headings(df: DataFrame, type_col: str) -> DataFrame:
    return df.select("*", F.posexplode(_template(F.col(type_col))).alias("heading_no", "heading"))


def summary_route(df: DataFrame, limit: int = 8000, type_col: str | None = None, text: str = "text") -> DataFrame:
    """``route`` direct or chunked by word count, and the chunker a chunked document would take."""
    n = word_count(F.col(text))
    judgment = F.col(type_col) == "court_judgment" if type_col else F.lit(False)
    return df.withColumn("route", F.when(n <= limit, "direct").otherwise("chunked")).withColumn(
        "chunker", F.when(n <= limit, "whole").when(judgment, "sequential").otherwise("sections"))


def route_chunks(df: DataFrame, limit: int = 8000, max_words: int = 3000, type_col: str | None = None,
                 text: str = "text") -> DataFrame:
    """Chunks of each document by its route."""
    t = F.col(text)
    judgment = F.col(type_col) == "court_judgment" if type_col else F.lit(False)
    chunks = F.when(word_count(t) <= limit, F.array(t)).when(
        judgment, segmenting.chunk_sequential(t, max_words)).otherwise(headings.section_chunks(t, max_words))
    return explode_units(df, chunks, "chunk_index", "chunk_text", text)


def bullets(df: DataFrame, saved: str | None = None, n: int = 12, text: str = "text") -> DataFrame:
    """Stored sentences when there are any, else the text split after sentence ends; first ``n``."""
    pieces = drop_blank(F.split(strip(F.col(text)), r"(?U)[.!?]\s+"))
    if saved:
        kept = drop_blank(F.coalesce(F.col(saved), F.array().cast("array<string>")))
        pieces = bind(kept, lambda k: F.when(F.size(k) > 0, k).otherwise(pieces))
    return df.withColumn("bullets", F.slice(F.coalesce(pieces, F.array().cast("array<string>")), 1, n))


def viewer_bullets(df: DataFrame, n: int = 8, text: str = "text") -> DataFrame:
    return df.withColumn("bullets", F.slice(segmenting.sentences_raw(F.col(text)), 1, n))


def section_rows(df: DataFrame, map_col: str) -> DataFrame:
    """Stored summary map (key -> text, or key -> lines) to display rows: fixed titles, else the key in title case."""
    keep = [c for c in df.columns if c != map_col]
    of_lines = isinstance(df.schema[map_col].dataType.valueType, T.ArrayType)
    rows = df.select(*keep, F.explode(map_col).alias("key", "value"))
    rows = rows.filter(F.col("key") != fixed.HIDDEN_SECTION)
    content = F.array_join(F.col("value"), "\n") if of_lines else strip(F.col("value"))
    title = F.coalesce(lookup(fixed.SECTION_TITLES, F.col("key")), strip(F.initcap(F.replace(
        F.col("key"), F.lit("_"), F.lit(" ")))))
    return rows.select(*keep, "key", title.alias("title"), content.alias("content")).filter(F.length("content") > 0)

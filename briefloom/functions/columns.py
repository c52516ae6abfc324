"""Column helpers shared by every operator: binding, trimming, folding, rounding.

All of them build Catalyst expressions; nothing here runs Python per row.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# the characters str.strip() removes
BLANKS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0          "
          "      　")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times inside ``body``.

    A lambda variable is already evaluated, so the optimizer cannot copy the
    expression behind it into an inner loop.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column, chars: str = BLANKS) -> Column:
    return F.btrim(c, F.lit(chars))


def materialize(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are computed exactly once.

    Exploding a one-element array is a stage the optimizer neither copies nor
    pushes filters through, so costly columns used by later filters, sort keys and
    projections are not evaluated again for each use.
    """
    keep = [c for c in df.columns if c not in columns]
    names = {k: f"_made_{i}" for i, k in enumerate(columns)}
    # evaluated by compiled code below the explode, which itself runs uncompiled next to any array function
    made = df.select(*keep, *[columns[k].alias(n) for k, n in names.items()])
    return made.select(*keep, F.inline(F.array(F.struct(*[F.col(n).alias(k) for k, n in names.items()]))))


def strip_prefixes(c: Column, prefixes: Sequence[str]) -> Column:
    """Remove each listed prefix (case ignored) in list order, trimming after each. One pattern does it all: a prefix behind
    another one ends with a blank that trimming would have taken, had nothing followed."""
    gap, quoted = f"[{BLANKS}]*+", [re.escape(p) for p in prefixes]
    chain = "".join(rf"(?:\A{p}{gap}|{p}{gap}(?!\z))?+" for p in quoted)
    return F.regexp_replace(c, rf"(?is)\A(?={'|'.join(quoted)}){chain}(.*?){gap}\z", "$1")


def drop_blank(pieces: Column) -> Column:
    """Trim every piece and drop the empty ones."""
    return F.filter(F.transform(pieces, lambda p: strip(p)), lambda p: F.length(p) > 0)


def squeeze(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s(?:(?<! )\s*|\s+)", " "))


def count_matches(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def find_all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), group)


def contains_any(c: Column, words: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words])


def first_of(pairs: Sequence[tuple[Column, Column | str]]) -> Column:
    """Value of the first true condition, null when none holds."""
    return F.coalesce(*[F.when(cond, v if isinstance(v, Column) else F.lit(v)) for cond, v in pairs])


def literal_map(mapping: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])


def lookup(mapping: dict, key: Column) -> Column:
    """Value of a small fixed mapping, null when the key is unknown."""
    return F.try_element_at(literal_map(mapping), key)


def words(c: Column) -> Column:
    """Non-blank tokens of a text."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: F.length(w) > 0)


def token_count(c: Column) -> Column:
    return count_matches(c, r"(?U)\S+")


def word_count(c: Column) -> Column:
    """Tokens holding at least one word character: one match per such token."""
    return count_matches(c, r"(?U)\w\S*")


def round_like_ieee(c: Column, digits: int = 2) -> Column:
    """Round a double to ``digits`` by its exact binary value, ties to even.

    ``round`` works on the printed decimal and turns 0.605 into 0.61 although the
    stored value lies below the tie; the product below is split into its rounded
    value and its rounding error, which decides such cases exactly.
    """
    scale = float(10 ** digits)

    def decide(v: Column) -> Column:
        hi = v["x"] * 134217729.0
        head = hi - (hi - v["x"])
        prod = v["x"] * scale
        err = (head * scale - prod) + (v["x"] - head) * scale
        base = F.floor(prod).cast("double")
        rest = prod - base
        up = ((rest > 0.5) | ((rest == 0.5) & (err > 0))
              | ((rest == 0.5) & (err == 0) & (F.pmod(base, F.lit(2.0)) == 1.0)))
        return (base + F.when(up, 1.0).otherwise(0.0)) / scale

    return bind(F.struct(c.cast("double").alias("x")), decide)


def literal_hint(pattern: str) -> str:
    """Letters every match of ``pattern`` must start with (lower-case patterns only)."""
    m = re.match(r"\\b([a-z]+)", pattern)
    if not m:
        return ""
    hint = m.group(1)
    return hint[:-1] if pattern[m.end():m.end() + 1] in ("?", "*", "{") else hint


def letter_first(pattern: str) -> str:
    """A pattern that starts at a word's first letter, with the letter looked for before the start of the word, which is dearer."""
    return re.sub(r"^\\b([a-z])(?![?*+{])", r"\1(?<=\\b\1)", pattern)


def literal_word(pattern: str) -> str:
    """The longest run of letters that every match of a lower-case ``pattern`` without groups or choices must hold."""
    if re.search(r"[|(\[]", pattern):
        return literal_hint(pattern) if "|" not in pattern else ""
    plain = re.sub(r"\\[A-Za-z]", " ", pattern)
    runs = [m[1][:-1] if m[2] else m[1] for m in re.finditer(r"([a-z]+)([?*{]?)", plain)]
    return max(runs, key=len, default="")


def match_spans(c: Column, pattern: str) -> Column:
    """array<struct<start_char int, end_char int, text string>> of all matches, 0-based, end exclusive.

    Built from the pieces between the matches, so each text is scanned twice
    and never per match.
    """
    pieces, hits = F.split(c, pattern), find_all(c, pattern)
    empty = F.array().cast("array<struct<start_char:int,end_char:int,text:string>>")

    def add(acc: Column, part: Column) -> Column:
        start = acc["at"] + F.length(part["piece"])
        end = start + F.length(part["hit"])
        return F.when(part["hit"].isNull(), acc).otherwise(F.struct(
            end.alias("at"),
            F.concat(acc["spans"], F.array(F.struct(start.alias("start_char"), end.alias("end_char"),
                                                    part["hit"].alias("text")))).alias("spans")))

    parts = F.zip_with(pieces, hits, lambda p, h: F.struct(p.alias("piece"), h.alias("hit")))
    return F.aggregate(parts, F.struct(F.lit(0).alias("at"), empty.alias("spans")), add, lambda acc: acc["spans"])

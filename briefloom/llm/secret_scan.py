"""Secrets in texts, told apart by how many owners and repositories hold them.

Spans are found in the row by built-in regex functions: a text is cut at its matches, and the lengths of gaps and
matches add up to code-point positions. Each candidate value is hashed; hashes are counted over the whole corpus by
distinct repositories and owners. A value that several owners hold is a copied example, one that stays with its owner
looks live. Null texts count as empty; an empty input gives no rows; repeated rows give a row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from briefloom.llm.common import stored, text_of

#: Kinds in the order in which spans of one start are listed. Fixed values of the contract (the first three), then added kinds.
#: kind: (pattern, number of the group that holds the value, least length of the value)
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE_KINDS = {"assign": (ASSIGN, 2, 12), "access": (r"AKIA[A-Z0-9]+", 0, 18), "hex": (r"[0-9a-f]+", 0, 16)}
#: Runs that are too short fail as a whole, so for these two the length may stand in the pattern itself.
FAST = {"access": r"AKIA[A-Z0-9]{14,}", "hex": r"[0-9a-f]{16,}"}
ADDED_KINDS = {
    "private": (r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", 0, 1),
    "bearer": (r"Bearer\x20+[A-Za-z0-9_.=-]{20,}", 0, 1),
    "url": (r"[a-z][a-z0-9+]{1,15}://[A-Za-z0-9_.-]{1,64}:[^\s:@/]{6,128}@", 0, 1),
}
#: A text can hold a match of a kind only if it holds one of these; skipping the others saves the regex.
GATE = {"assign": r"(?i:passw|secret|token|api_?key)", "access": "AKIA", "hex": r"[0-9a-f]{16}", "private": "PRIVATE KEY-----", "bearer": "Bearer ", "url": "://"}
#: Values held by at least this many owners are copied examples.
COPIED_OWNERS = 2

SPAN = "struct<start:bigint,rank:int,stop:bigint,kind:string,hash:string>"


def _spans(text: Column, kind: str, rank: int, pattern: str, group: int, least: int) -> Column:
    """Matches of one kind as an array of spans, those with too short a value dropped."""
    pattern = FAST.get(kind, pattern)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.split(text, pattern, -1)
    at = F.aggregate(
        F.arrays_zip(gaps.alias("gap"), found.alias("hit"), values.alias("value")),
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{SPAN}>").alias("got")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["gap"]) + F.coalesce(F.length(x["hit"]), F.lit(0))).alias("at"),
            F.when(F.length(x["value"]) >= least, F.concat(acc["got"], F.array(F.struct(
                (acc["at"] + F.length(x["gap"])).alias("start"), F.lit(rank).alias("rank"),
                (acc["at"] + F.length(x["gap"]) + F.length(x["hit"])).alias("stop"), F.lit(kind).alias("kind"),
                F.md5(x["value"]).alias("hash"))))).otherwise(acc["got"]).alias("got")),
        lambda acc: acc["got"])
    gate = text.contains(GATE[kind]) if kind in ("access", "private", "bearer", "url") else text.rlike(GATE[kind])
    return F.when(gate, at).otherwise(F.array().cast(f"array<{SPAN}>"))


def find_spans(text: Column, kinds: dict[str, tuple[str, int, int]] | None = None) -> Column:
    """All spans of a text ordered by start, then kind. ``start`` and ``stop`` count code points."""
    kinds = kinds or BASE_KINDS | ADDED_KINDS
    return F.sort_array(F.concat(*(_spans(text, k, i, *spec) for i, (k, spec) in enumerate(kinds.items()))))


def span_list(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def ownership(found: DataFrame) -> DataFrame:
    """``found(hash, owner, repository)`` counted over the corpus: ``hash, owners, repositories, uses``.

    Pairs are made distinct with map-side combine first, so a value that a third of all rows repeat is a few rows
    when it reaches its task.
    """
    pairs = found.groupBy("hash", "owner", "repository").agg(F.count("*").alias("uses"))
    by_owner = pairs.groupBy("hash", "owner").agg(F.count("*").alias("repositories"), F.sum("uses").alias("uses"))
    return by_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"), F.sum("uses").alias("uses"))


def scan(docs: DataFrame, text_col: str = "text", owner: Column | None = None, repository: Column | None = None,
         carry: list[str] | None = None) -> DataFrame:
    """One row per input row: the ``carry`` columns, ``spans`` (array), ``copied`` and ``live`` (numbers of spans).

    ``copied`` spans hold a value of ``COPIED_OWNERS`` or more owners; ``live`` ones are owner-specific. Rows are found
    once and written; only values and owners, never texts, are shuffled.
    """
    carry = carry if carry is not None else ["doc_id"]
    owner = F.col("source") if owner is None else owner
    repository = F.concat_ws("/", F.col("source"), F.col("lang")) if repository is None else repository
    rows = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)], text_of(text_col).alias("text"),
                       F.coalesce(owner, F.lit("")).alias("owner"), F.coalesce(repository, F.lit("")).alias("repository"))
    rows = rows.select(*[f"c{i}" for i in range(len(carry))], "owner", "repository", find_spans(F.col("text")).alias("spans"))
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "secrets")
    uses = rows.where(F.size("spans") > 0).select("row", "owner", "repository", F.explode("spans.hash").alias("hash"))
    known = ownership(uses)
    copied = (F.col("owners") >= COPIED_OWNERS).cast("long")
    per_row = uses.join(known, "hash").groupBy("row").agg(F.sum(copied).alias("copied"), F.count("*").alias("all"))
    out = rows.join(per_row, "row", "left")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], "spans", F.coalesce("copied", F.lit(0)).alias("copied"),
                      F.coalesce(F.col("all") - F.col("copied"), F.lit(0)).alias("live"))

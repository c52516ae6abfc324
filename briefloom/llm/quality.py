"""Quality rules as a short-circuit cascade.

Every rule judges a text by one measure. ``estimate`` runs each rule by itself over a bounded sample of documents and
adds up, on Spark, the seconds it took and the texts it rejected; ``cascade`` orders the rules by rejections per second,
so that ``judge`` drops a bad text by the cheapest likely rule and measures nothing more of it. A text is kept if no rule
rejects it, so the order decides the cost and the rule that is named, never which texts are kept.

Null and blank texts have no words and are rejected as too short. Rows of one id are judged each for itself, so repeated
rows give repeated results. Measures of a text are taken from the whole text, in the task that holds it: one pass over the
table, no shuffle but that of the sample's few sums. An empty table gives no rows, and rules in the order they are listed.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACES, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
NOT_LETTERS, CAPITALS = regex.compile(r"\P{L}+"), regex.compile(r"\p{Lu}")
WITH_LETTER = regex.compile(r"[^\x20\x09-\x0D\p{L}]*+\p{L}[^\x20\x09-\x0D]*+")
#: Documents of the sample on which costs and rejections are estimated (expected number, drawn by hash).
SAMPLE_ROWS = 2000


class Measured:
    """A text whose measures are taken when first asked for."""

    def __init__(self, text: str | None) -> None:
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode().split()  # bytes are split at exactly the six characters of SPACES

    @cached_property
    def word_ids(self) -> np.ndarray:
        seen: dict[bytes, int] = {}
        return np.fromiter((seen.setdefault(w, len(seen)) for w in self.words), np.int64, len(self.words))

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(self.text.count(c) for c in SPACES)

    @cached_property
    def n_symbols(self) -> int:
        return sum(self.text.count(c) for c in SYMBOLS)

    @cached_property
    def lines(self) -> list[str]:
        return [line for line in self.text.split("\n") if line.strip(SPACES)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside a window of three words that occurs twice or more."""
        ids = self.word_ids
        if len(ids) < 4:
            return 0
        kinds = int(ids.max()) + 1
        pairs = np.unique(ids[:-2] * kinds + ids[1:-1], return_inverse=True)[1]
        _, window, times = np.unique(pairs * kinds + ids[2:], return_inverse=True, return_counts=True)
        again = times[window] > 1
        inside = np.zeros(len(ids), bool)
        for k in range(3):
            inside[k:len(ids) - 2 + k] |= again
        return int(inside.sum())

    @cached_property
    def top_word(self) -> int:
        return int(np.bincount(self.word_ids).max()) if self.words else 0

    @cached_property
    def lettered_words(self) -> int:
        return sum(1 for _ in WITH_LETTER.finditer(self.text))

    @cached_property
    def letters(self) -> int:
        return len(NOT_LETTERS.sub("", self.text))

    @cached_property
    def capitals(self) -> int:
        return sum(1 for _ in CAPITALS.finditer(self.text))


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Measured], bool]


#: Shares are compared as whole numbers, so any engine decides alike.
BASE_RULES = (
    Rule("too_short", lambda t: len(t.words) < 50),
    Rule("repeated_windows", lambda t: 100 * t.n_repeat_words > 50 * len(t.words)),
)
RULES = (
    *BASE_RULES,
    Rule("symbols", lambda t: 10 * t.n_symbols > len(t.words)),
    Rule("word_length", lambda t: not 2 * len(t.words) <= t.word_chars <= 12 * len(t.words)),
    Rule("words_without_letter", lambda t: 10 * t.lettered_words < 7 * len(t.words)),
    Rule("capitals", lambda t: 10 * t.capitals > 6 * t.letters),
    Rule("one_word", lambda t: 10 * t.top_word > 3 * len(t.words)),
    Rule("repeated_lines", lambda t: 2 * t.n_dup_lines > len(t.lines)),
)


def sample_of(docs: DataFrame, text_col: str, id_col: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """About ``rows`` texts of the table, drawn by a hash of id and text; all of a smaller table."""
    total = docs.count()
    if total > rows:
        h = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)), F.lit(1 << 40))
        docs = docs.where(h < int((1 << 40) * rows / total))
    return docs.select(F.col(text_col).alias("text"))


def estimate(docs: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text", id_col: str = "doc_id", rows: int = SAMPLE_ROWS) -> DataFrame:
    """``rule, seconds, rejected, texts`` of each rule, run by itself over the sample."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for rule in rules:
                began, rejected = time.perf_counter(), 0
                for text in batch["text"]:
                    rejected += rule.rejects(Measured(text))
                out.append((rule.name, time.perf_counter() - began, rejected, len(batch)))
            yield pd.DataFrame(out, columns=["rule", "seconds", "rejected", "texts"])
    parts = sample_of(docs, text_col, id_col, rows).mapInPandas(run, "rule string, seconds double, rejected long, texts long")
    return parts.groupBy("rule").agg(*[F.sum(c).alias(c) for c in ("seconds", "rejected", "texts")])


def cascade(docs: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text", id_col: str = "doc_id", rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejections per second on the sample, best first; those that reject nothing there follow, cheapest first."""
    found = {r["rule"]: r for r in estimate(docs, rules, text_col, id_col, rows).collect()}  # a row per rule

    def place(rule: Rule) -> tuple[float, float]:
        row = found.get(rule.name)
        return (-row["rejected"] / max(row["seconds"], 1e-9), row["seconds"]) if row else (0.0, 0.0)
    return sorted(rules, key=place)


BASE_SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"


def judge(docs: DataFrame, rules: Sequence[Rule], keep: Sequence[str] = ("doc_id",), text_col: str = "text", base: bool = True) -> DataFrame:
    """The columns ``keep`` of every row, then ``rules_run`` and ``failed_rule`` of the cascade ``rules`` and ``kept``.

    With ``base`` also the counts of ``BASE_SCHEMA``, which are then measured for all texts. Columns of these names in
    ``docs`` do no harm: kept ones are carried in a struct and come first under their own names.
    """
    fields = "rules_run int, failed_rule string, kept boolean" + (", " + BASE_SCHEMA if base else "")
    names = [f.split()[0] for f in fields.split(", ")]
    types = [{"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[f.split()[1]] for f in fields.split(", ")]
    carried = docs.select(F.struct(*[F.col(c) for c in keep]).alias("row"), F.col(text_col).alias("text"))
    schema = f"row {carried.schema['row'].dataType.simpleString()}, {fields}"

    def one(text: str | None) -> tuple:
        t, run, failed = Measured(text), 0, None
        for rule in rules:
            run += 1
            if rule.rejects(t):
                failed = rule.name
                break
        out = (run, failed, failed is None)
        if base:
            out += (len(t.words), t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words, any(r.rejects(t) for r in BASE_RULES))
        return out

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [one(x.as_py()) for x in batch.column("text")]
            columns = list(zip(*made)) if made else [[] for _ in names]
            arrays = [pa.array(c, type=t) for c, t in zip(columns, types)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *arrays], names=["row", *names])
    return carried.mapInArrow(work, schema).select(*[F.col("row")[c].alias(c) for c in keep], *names)

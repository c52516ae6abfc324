"""Whole-document plans: from texts to described, ranked and grouped clauses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import clean_text
from ..functions.columns import materialize
from ..operators import clauses as c
from ..operators import segments as s
from .placement import place_by


def cleaned(docs: DataFrame, text: str = "text") -> DataFrame:
    """Documents with cleaned text; empty ones are dropped, as they have no analysis."""
    return materialize(docs, {text: clean_text(F.col(text), for_summarization=True)}).filter(F.length(text) > 0)


def described_clauses(docs: DataFrame, parties: DataFrame | None = None) -> DataFrame:
    """Clauses of every document. Narrow after the input: no shuffle unless ``parties`` is joined."""
    return c.describe_clauses(s.atomic_clauses(s.paragraphs(docs)), parties)


def ranked_clauses(docs: DataFrame, parties: DataFrame | None = None, placed: bool = False) -> DataFrame:
    """Described, deduplicated and ranked clauses.

    The texts are hashed by document once, unless they are ``placed`` so already; dedup, ranking and grouping all work
    inside that partitioning, so no wider clause row is shuffled again.
    """
    docs = docs if placed else place_by(docs, "doc_id")
    return c.rank_clauses(c.dedup_clauses(described_clauses(docs, parties)))


def briefing(docs: DataFrame, parties: DataFrame | None = None, placed: bool = False) -> DataFrame:
    return c.briefing(ranked_clauses(docs, parties, placed))

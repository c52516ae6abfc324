"""Row labels: document types, intents, statuses, severities, scores and their counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.columns import bind, contains_any, count_matches, literal_hint, lookup, materialize, strip


def _key(column: str) -> Column:
    return F.lower(strip(F.coalesce(F.col(column).cast("string"), F.lit(""))))


def normalize_upload_type(df: DataFrame, column: str) -> DataFrame:
    """Adds upload_type (null when unknown) and rejected."""
    kind = lookup(fixed.UPLOAD_TYPES, _key(column))
    return df.withColumn("upload_type", kind).withColumn("rejected", F.col("upload_type").isNull())


def normalize_type(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("analysis_type", F.coalesce(lookup(fixed.ANALYSIS_TYPES, _key(column)), F.lit("general")))


def subtype(df: DataFrame, type_col: str, name: str | None = None, text: str = "text") -> DataFrame:
    """Loan wording first, whatever the type; then the type's own ladder. ``is_loan`` also looks at the name."""
    def ladder(low: Column) -> Column:
        loan = (contains_any(low, ["loan agreement", "facility agreement"])
                | (contains_any(low, ["loan", "facility"]) & contains_any(low, ["borrower", "lender"])))
        kind = F.lower(F.col(type_col))
        out = F.when(loan, "loan_agreement")
        for t, (steps, other) in fixed.SUBTYPES.items():
            for any_words, label in steps:
                out = out.when((kind == t) & contains_any(low, any_words), label)
            out = out.when(kind == t, other)
        return out.otherwise("general")
    df = materialize(df, {"subtype": bind(F.lower(F.col(text)), ladder)})
    named = F.lower(F.col(name)).contains("loan agreement") if name else F.lit(False)
    return df.withColumn("is_loan", (F.col("subtype") == "loan_agreement") | F.coalesce(named, F.lit(False)))


def question_intent(df: DataFrame, column: str) -> DataFrame:
    """greeting, help, off_topic, entity_lookup, entity_query, legal_analysis or document_qa, in that order."""
    q = strip(F.col(column))
    hit = lambda pattern: q.rlike("(?iU)" + pattern)
    return df.withColumn("intent", F.when(hit(fixed.GREETING), "greeting").when(hit(fixed.HELP), "help")
                         .when(hit(fixed.OFF_TOPIC), "off_topic").when(hit(fixed.LOOKUP), "entity_lookup")
                         .when(hit(fixed.ENTITY_LIST), "entity_query")
                         .when(contains_any(F.lower(q), fixed.ANALYSIS_WORDS), "legal_analysis")
                         .otherwise("document_qa"))


def is_final(column: str) -> Column:
    return _key(column).isin(*fixed.FINAL_STATUSES)


def display_status(column: str) -> Column:
    s = F.lower(F.col(column))
    return (F.when(F.coalesce(F.length(F.col(column)), F.lit(0)) == 0, "—").when(s.isin("completed", "analyzed"), "Completed")
            .when(s.isin("processing", "uploaded", "extracted", "processed"), "Processed")
            .when(s == "failed", "Failed").otherwise(F.col(column)))


def status_distribution(df: DataFrame, column: str) -> DataFrame:
    return df.select(display_status(column).alias("status"), is_final(column).alias("final")).groupBy(
        "status", "final").agg(F.count("*").alias("n"))


def type_classes(df: DataFrame, column: str, only: str = "all") -> DataFrame:
    """Adds type_class and contract_subtype; ``only`` filters, and 'contract' covers the whole family."""
    key = F.lower(F.coalesce(F.col(column), F.lit("")))
    if only == "contract":
        df = df.filter(key.isin(*fixed.CONTRACT_FAMILY))
    elif only != "all":
        df = df.filter(key == only)
    return df.withColumns({
        "type_class": F.when(key.isin(*fixed.CONTRACT_FAMILY), "Contracts").when(key == "court_judgment", "Court Judgment")
        .when(key == "general_legal_document", "General Legal Document")
        .otherwise(F.coalesce(F.col(column), F.lit("Legal Document"))),
        "contract_subtype": F.coalesce(lookup(fixed.CONTRACT_SUBTYPE_LABELS, key), F.lit(""))})


def severity_of(column: Column, default: str = "low") -> Column:
    """Exact value, else by substring, else low; ``default`` replaces a missing value."""
    s = F.lower(F.coalesce(F.nullif(column, F.lit("")), F.lit(default)))
    return F.when(s.isin("high", "medium", "low"), s).when(s.contains("high"), "high").when(
        s.contains("med"), "medium").otherwise("low")


def normalize_severity(df: DataFrame, column: str, default: str = "low") -> DataFrame:
    return df.withColumn("severity_class", severity_of(F.col(column), default))


def score_bands(df: DataFrame, column: str) -> DataFrame:
    """Documents per safety band; scores are rounded half up and clamped to 0..100."""
    score = F.expr(f"try_cast(`{column}` AS DOUBLE)")
    score = F.when(score.isNotNull() & ~F.isnan(score), F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.floor(score + 0.5))))
    band = F.when(score.isNull(), "Unknown").when(score >= 70, "Low Risk").when(score >= 40, "Moderate Risk").otherwise("High Risk")
    return df.select(band.alias("band")).groupBy("band").agg(F.count("*").alias("n"))


def confidence_bands(entities: DataFrame) -> DataFrame:
    """Entities per bucket and confidence band (percent at least 90, at least 75, lower)."""
    pct = F.floor(F.col("confidence") * 100 + 0.5)
    band = F.when(pct >= 90, "high").when(pct >= 75, "medium").otherwise("low")
    return entities.filter(F.col("confidence").isNotNull()).groupBy("bucket", band.alias("band")).agg(F.count("*").alias("n"))


def risk_tags(risks: DataFrame) -> DataFrame:
    """Own tags, trimmed, distinct, at most three; without any, the tags of the risk type."""
    own = F.slice(F.array_distinct(F.filter(F.transform(F.col("tags"), lambda t: strip(t)), lambda t: F.length(t) > 0)), 1, 3)
    by_type = F.create_map(*[x for k, v in fixed.TAGS_OF_RISK_TYPE.items()
                             for x in (F.lit(k), F.array(*[F.lit(t) for t in v]))])
    typed = F.coalesce(F.try_element_at(by_type, F.lower(F.coalesce("risk_type", F.lit("")))),
                       F.array(*[F.lit(t) for t in fixed.DEFAULT_TAGS]))
    return risks.withColumn("shown_tags", F.when(F.size("tags") > 0, own).otherwise(typed))


def risk_dimensions(risks: DataFrame) -> DataFrame:
    """Five named levels per document from words in its risk types."""
    kind = F.lower(F.coalesce("risk_type", F.lit("")))
    has = {k: F.bool_or(contains_any(kind, ws)) for k, ws in fixed.DIMENSION_WORDS.items()}
    grave = F.bool_or((F.lower("severity") == "high") & kind.contains("financial"))
    level = lambda k, top: F.when(has[k], top).otherwise("low").alias(f"{k}_level")
    return risks.groupBy("doc_id").agg(
        F.when(has["financial"], F.when(F.coalesce(grave, F.lit(False)), "high").otherwise("medium")).otherwise("low").alias("financial_level"),
        level("liability", "high"), level("termination", "high"), level("compliance", "medium"), level("operational", "medium"))


def apply_rules(df: DataFrame, rules: list[tuple[str, str]], text: str = "text") -> DataFrame:
    """One row per text and matching rule (rule, n matches), case ignored.

    Every (name, pattern) becomes a literal expression of the row: no rule table is
    joined, and only rules that match become rows. A pattern runs only on texts
    holding its first letters.
    """
    def count(low: Column, pattern: str) -> Column:
        hint = "" if "|" in pattern else literal_hint(pattern)
        n = count_matches(low, pattern).cast("long")
        return F.when(low.contains(hint), n).otherwise(F.lit(0).cast("long")) if hint else n

    def counted(low: Column) -> Column:
        every = F.array(*[F.struct(F.lit(name).alias("rule"), count(low, pattern).alias("n")) for name, pattern in rules])
        return F.filter(every, lambda x: x["n"] > 0)
    return df.select("*", F.inline(bind(F.lower(text), counted)))


def search_library(df: DataFrame, text: str = "", kind: str = "all", name: str = "document_name",
                   type_col: str = "document_type") -> DataFrame:
    q = text.strip().lower()
    by_name = F.lower(F.coalesce(name, F.lit(""))).contains(q)
    by_type = F.lower(F.coalesce(type_col, F.lit(""))).contains(kind.replace("-", " ", 1))
    tests = ([by_name] if q else []) + ([by_type] if kind != "all" else [])
    return df.filter(reduce(lambda a, b: a & b, tests)) if tests else df


def facets(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.length(column) > 0).select(F.col(column).alias("value")).distinct().orderBy("value")

"""Risk operators: parsing stored answers, per-document reports, corpus dedup, alert feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.cleaning import signature_text
from ..functions.columns import lookup, materialize, strip, words
from .labels import is_final, severity_of

PARSED = ["doc_id", "items", "failure"]


# --- raw answers -------------------------------------------------------------------------

def _unfenced(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(strip(c), r"^```(?:json)?\s*", ""), r"\s*```\s*$", "")


def _is_object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>").isNotNull()


def parse_responses(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Replaces ``raw`` by ``items`` array<variant> and ``failure`` (null when a JSON array of objects was found)."""
    keep = [c for c in df.columns if c != raw]
    parsed = materialize(df.select(*keep, _unfenced(F.col(raw)).alias("_text")), {"_v": F.try_parse_json(F.col("_text"))})
    items = F.try_variant_get(F.col("_v"), "$", "array<variant>")
    rows = materialize(parsed, {"_items": items})
    failure = (F.when(F.col("_v").isNull(), "Invalid LLM JSON output")
               .when(F.col("_items").isNull(), "Invalid LLM JSON output - expected array")
               .when(F.exists("_items", lambda x: ~_is_object(x)), "item is not an object"))
    return rows.select(*keep, F.when(failure.isNull(), F.col("_items")).alias("items"), failure.alias("failure"))


def _field(v: Column, name: str, default: str = "") -> Column:
    return F.coalesce(F.try_variant_get(v, f"$.{name}", "string"), F.lit(default))


def risk_rows(parsed: DataFrame, risk_type: str | Column = "general") -> DataFrame:
    """One row per titled risk; ids count the original items. ``risk_type`` is a column or a constant."""
    kind = F.lit(risk_type) if isinstance(risk_type, str) else risk_type
    rows = parsed.filter(F.col("items").isNotNull()).select("doc_id", kind.alias("risk_type"), F.posexplode("items").alias("seq", "v"))
    v = F.col("v")
    rows = rows.select("doc_id", "seq", "risk_type", _field(v, "title").alias("title"), F.lower(_field(v, "severity", "medium")).alias("sev"),
                       _field(v, "description").alias("explanation"), _field(v, "clause_reference").alias("clause_text"))
    return rows.filter(F.length("title") > 0).select(
        "doc_id", "seq", F.concat(F.lit("llm-risk-"), "seq").alias("clause_id"), "title", "risk_type",
        F.when(F.col("sev").isin("low", "medium", "high"), F.col("sev")).otherwise("medium").alias("severity"),
        F.lit("Not specified").alias("party"), F.lit("Not specified").alias("affected_party"),
        F.lit("Counterparty").alias("counterparty"), F.lit("Risk").alias("category"), F.array(F.lit("Risk")).alias("tags"),
        "explanation", F.col("explanation").alias("legal_reason"), "clause_text",
        F.when(F.length("clause_text") > 0, F.array("clause_text")).otherwise(F.array().cast("array<string>")).alias("source_clause_texts"))


def insight_rows(parsed: DataFrame) -> DataFrame:
    rows = parsed.filter(F.col("items").isNotNull()).select("doc_id", F.posexplode("items").alias("seq", "v"))
    v = F.col("v")
    return rows.select("doc_id", F.concat(F.lit("insight-"), F.col("seq") + 1).alias("insight_id"), _field(v, "title").alias("title"),
                       _field(v, "description").alias("description"), _field(v, "supporting_text").alias("supporting_text"))


def lenient_json(df: DataFrame, column: str) -> DataFrame:
    """Text to VARIANT; text that is no JSON becomes {"raw": text}."""
    wrapped = F.to_variant_object(F.struct(F.col(column).alias("raw")))
    return df.withColumn(column, F.when(F.col(column).isNotNull(), F.coalesce(F.try_parse_json(F.col(column)), wrapped)))


# --- reports -----------------------------------------------------------------------------

def kept_risks(risks: DataFrame, caps=fixed.RISK_CAPS) -> DataFrame:
    """The risks a report publishes: the first of each severity in answer order (the report's size, not a guard)."""
    w = Window.partitionBy("doc_id", "severity").orderBy("seq")
    cap = lookup(caps, F.col("severity"))
    ranked = risks.filter(F.col("severity").isin(*caps)).withColumn("_n", F.row_number().over(w))
    return ranked.filter(F.col("_n") <= max(caps.values())).filter(F.col("_n") <= cap).drop("_n")


def risk_report(risks: DataFrame, caps=fixed.RISK_CAPS, points=fixed.RISK_POINTS) -> DataFrame:
    """One row per document: score from published risks, level, detected and published counts. One aggregation."""
    counts = risks.groupBy("doc_id").agg(F.count("*").alias("detected_patterns"), *[
        F.least(F.count_if(F.col("severity") == s), F.lit(c)).alias(f"{s}_risks") for s, c in caps.items()])
    lost = sum((F.col(f"{s}_risks") * p for s, p in points.items()), F.lit(0))
    df = counts.withColumns({"published_risks": sum((F.col(f"{s}_risks") for s in caps), F.lit(0)).cast("long"),
                             "risk_score": F.greatest(F.lit(0), F.lit(100) - lost).cast("long")})
    return df.withColumns({"risk_level": F.when((F.col("high_risks") > 0) | (F.col("risk_score") < 45), "High").when(
        (F.col("medium_risks") > 0) | (F.col("risk_score") < 75), "Medium").otherwise("Low"), "status": F.lit("success")})


def report_with_failures(reports: DataFrame, parsed: DataFrame) -> DataFrame:
    """Reports of all parsed documents: failed answers get the neutral report with a reason, empty ones a clean one.

    The reports are not broadcast: Spark guesses their size from the files of the answers, far under that of a report a document.
    """
    df = parsed.select("doc_id", "failure").join(reports.hint("merge"), "doc_id", "left")
    failed = F.col("failure").isNotNull()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return df.select("doc_id", F.when(failed, "failed").otherwise("success").alias("status"), F.col("failure").alias("reason"),
                     F.coalesce("risk_score", F.lit(100)).cast("long").alias("risk_score"),
                     F.coalesce("risk_level", F.lit("Low")).alias("risk_level"),
                     *[zero(c) for c in ("detected_patterns", "published_risks", "high_risks", "medium_risks", "low_risks")])


def flatten_risk_payload(df: DataFrame, json_col: str) -> DataFrame:
    """Rows of a stored payload: a bare array of risks, or an object with high, medium and low lists."""
    v = F.col("_v")
    keep = [c for c in df.columns if c != json_col]
    df = materialize(df, {"_v": F.try_parse_json(F.col(json_col))})
    none = F.array().cast("array<variant>")
    lists = [F.coalesce(F.try_variant_get(v, f"$.{k}", "array<variant>"), none) for k in ("high_risks", "medium_risks", "low_risks")]
    # an array answers "$" and no key; an object answers the keys only
    every = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.concat(*lists))
    rows = df.select(*keep, F.posexplode(F.filter(every, _is_object)).alias("seq", "r"))
    r = F.col("r")
    return rows.select(*keep, "seq", *[F.try_variant_get(r, f"$.{f}", "string").alias(f) for f in
                                       ("title", "risk_type", "severity", "category", "explanation", "clause_text")])


# --- corpus ------------------------------------------------------------------------------

def risk_signature() -> Column:
    title = signature_text(F.coalesce(F.nullif("title", F.lit("")), F.col("risk_type")))
    opening = F.array_join(F.slice(words(signature_text(F.col("explanation"))), 1, 8), " ")
    return strip(F.concat_ws("|", title, signature_text(F.col("category")), signature_text(F.col("risk_type")), opening), "|")


def distinct_risks(docs: DataFrame, risks: DataFrame, status: str = "processing_status") -> DataFrame:
    """Risks of finalised documents, one per signature across the corpus (first document and position).

    The first one is an aggregate with map-side combine, so a signature copied
    through the whole corpus arrives as one row per task.
    """
    done = docs.filter(is_final(status)).select("doc_id")
    found = materialize(risks.join(done, "doc_id", "left_semi"), {"signature": risk_signature()}).filter(F.length("signature") > 0)
    return found.groupBy("signature").agg(F.min_by("severity", F.struct("doc_id", "seq")).alias("severity"))


def severity_counts(risks: DataFrame) -> DataFrame:
    s = F.lower(F.coalesce("severity", F.lit("")))
    return risks.agg(F.count("*").alias("total_risks"), *[F.count_if(s == k).alias(f"{k}_risk_count") for k in fixed.RISK_CAPS])


def risk_summary(docs: DataFrame, risks: DataFrame, status: str = "processing_status") -> DataFrame:
    return severity_counts(distinct_risks(docs, risks, status))


def corpus_kpis(docs: DataFrame, risks: DataFrame, status: str = "processing_status") -> DataFrame:
    """(metric, value) for documents, analysed documents and distinct risks."""
    rows = docs.agg(F.count("*").alias("total_documents"), F.count_if(is_final(status)).alias("analyzed_documents"))
    rows = rows.unpivot([], ["total_documents", "analyzed_documents"], "metric", "value")
    total = risk_summary(docs, risks, status).select(F.lit("total_risks").alias("metric"), F.col("total_risks").alias("value"))
    return rows.unionByName(total)


def supporting_texts(risks: DataFrame, n: int = 4) -> DataFrame:
    """Adds ``supporting``: the risk's own text and its sources, trimmed, distinct, first ``n``."""
    texts = F.concat(F.array("clause_text"), F.coalesce("source_clause_texts", F.array().cast("array<string>")))
    clean = F.filter(F.transform(texts, lambda t: strip(F.coalesce(t, F.lit("")))), lambda t: F.length(t) > 0)
    return risks.withColumn("supporting", F.slice(F.array_distinct(clean), 1, n))


def _severity_rank(c: Column) -> Column:
    return F.when(c == "high", 0).when(c == "medium", 1).otherwise(2)


def top_risks(risks: DataFrame, n: int = 8) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy(_severity_rank(F.lower(F.coalesce(F.nullif("severity", F.lit("")), F.lit("low")))), "seq")
    return risks.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def alert_feed(docs: DataFrame, risks: DataFrame, status: str = "processing_status") -> DataFrame:
    """Risks of analysed documents with display fallbacks, most severe first."""
    text = lambda *names, other: F.coalesce(*[F.nullif(n, F.lit("")) for n in names], F.lit(other))
    done = docs.filter(F.lower(F.coalesce(status, F.lit(""))).isin(*fixed.FINAL_STATUSES))
    df = risks.join(done, "doc_id").select(
        "doc_id", "seq", text("title", "risk_type", other=fixed.ALERT_TITLE).alias("title"), severity_of(F.col("severity")).alias("severity"),
        strip(text("explanation", other=fixed.ALERT_EXPLANATION)).alias("explanation"),
        text("document_name", other="Untitled document").alias("document_name"),
        text("category", "risk_type", other="General").alias("category"),
        text("document_type", other="General document").alias("document_type"))
    return df.orderBy(_severity_rank(F.col("severity")), "doc_id", "seq")


def filter_alerts(df: DataFrame, severity: str = "all", document_type: str = "all", category: str = "all") -> DataFrame:
    for name, value in (("severity", severity), ("document_type", document_type), ("category", category)):
        if value != "all":
            df = df.filter(F.col(name) == value)
    return df

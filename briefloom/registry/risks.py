"""Queries of the risk, answer-parsing and job operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import jobs as job_op
from ..operators import risks as op
from ..sources import samples
from . import query
from .labels import STATUS
from .sql import squeeze, text, view, with_views

risks = samples.risks


def finals(spark, d):
    return samples.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("doc_id"), F.expr(STATUS).alias("processing_status"),
        F.expr("CASE WHEN o_custkey % 3 = 0 THEN '' ELSE concat('Deed ', o_custkey) END").alias("document_name"),
        F.expr("CASE WHEN o_custkey % 5 = 0 THEN '' ELSE 'contract' END").alias("document_type"))


view("docs", f"""SELECT o_orderkey AS doc_id, {STATUS} AS processing_status, CASE WHEN o_custkey % 3 = 0 THEN '' ELSE concat('Deed ', o_custkey) END AS document_name,
 CASE WHEN o_custkey % 5 = 0 THEN '' ELSE 'contract' END AS document_type FROM orders""")
view("norm_risks", "SELECT * REPLACE (CASE WHEN lower(severity) IN ('high', 'medium', 'low') THEN lower(severity) ELSE 'medium' END AS severity) FROM risks", ["risks"])


def norm_risks(spark, d):
    s = F.lower("severity")
    return risks(spark, d).withColumn("severity", F.when(s.isin("high", "medium", "low"), s).otherwise("medium"))


# --- answers
view("answer_items", """SELECT doc_id, unnest(from_json(raw, '[{"title":"VARCHAR","severity":"VARCHAR","description":"VARCHAR","clause_reference":"VARCHAR"}]')) AS r,
 unnest(range(CAST(json_array_length(raw) AS BIGINT))) AS seq FROM responses WHERE json_valid(raw)""", ["responses"])


@query("parse_responses_j1", with_views("responses", """
SELECT doc_id, CASE WHEN NOT json_valid(raw) THEN 'Invalid LLM JSON output' END AS failure, CASE WHEN json_valid(raw) THEN CAST(json_array_length(raw) AS BIGINT) ELSE -1 END AS n FROM responses"""))
def parse_responses(spark, d):
    parsed = op.parse_responses(samples.responses(spark, d))
    return parsed.select("doc_id", "failure", F.when(F.col("items").isNotNull(), F.size("items")).otherwise(-1).cast("long").alias("n"))


@query("risk_rows_j2", with_views("answer_items", """
SELECT doc_id, CAST(seq AS BIGINT) AS seq, 'llm-risk-' || seq AS clause_id, r.title AS title, CASE WHEN lower(coalesce(r.severity, 'medium')) IN ('low', 'medium', 'high') THEN lower(coalesce(r.severity, 'medium')) ELSE 'medium' END AS severity,
 coalesce(r.description, '') AS explanation, coalesce(r.clause_reference, '') AS clause_text FROM answer_items WHERE coalesce(r.title, '') <> ''"""))
def risk_rows(spark, d):
    rows = op.risk_rows(op.parse_responses(samples.responses(spark, d)), "contract")
    return rows.select("doc_id", F.col("seq").cast("long").alias("seq"), "clause_id", "title", "severity", "explanation", "clause_text")


@query("insight_rows_j3", with_views("answer_items", """
SELECT doc_id, 'insight-' || (seq + 1) AS insight_id, coalesce(r.title, '') AS title, coalesce(r.description, '') AS description, '' AS supporting_text FROM answer_items"""))
def insight_rows(spark, d):
    return op.insight_rows(op.parse_responses(samples.responses(spark, d)))


_counts = "SELECT doc_id, count(*) AS det, count(*) FILTER (WHERE severity = 'high') AS h0, count(*) FILTER (WHERE severity = 'medium') AS m0, count(*) FILTER (WHERE severity = 'low') AS l0 FROM {src} GROUP BY doc_id"
_report = """SELECT *, CASE WHEN high_risks > 0 OR risk_score < 45 THEN 'High' WHEN medium_risks > 0 OR risk_score < 75 THEN 'Medium' ELSE 'Low' END AS risk_level FROM (
SELECT doc_id, det AS detected_patterns, least(h0, 5) AS high_risks, least(m0, 5) AS medium_risks, least(l0, 3) AS low_risks, least(h0, 5) + least(m0, 5) + least(l0, 3) AS published_risks,
 CAST(greatest(0, 100 - 18 * least(h0, 5) - 10 * least(m0, 5) - 4 * least(l0, 3)) AS BIGINT) AS risk_score FROM ({counts}))"""
view("answer_risks", "SELECT doc_id, CASE WHEN lower(coalesce(r.severity, 'medium')) IN ('low', 'medium', 'high') THEN lower(coalesce(r.severity, 'medium')) ELSE 'medium' END AS severity FROM answer_items WHERE coalesce(r.title, '') <> ''", ["answer_items"])


@query("failed_reports_j4", with_views("responses answer_risks", f"""
SELECT p.doc_id, CASE WHEN json_valid(raw) THEN 'success' ELSE 'failed' END AS status, CASE WHEN NOT json_valid(raw) THEN 'Invalid LLM JSON output' END AS reason,
 coalesce(risk_score, 100) AS risk_score, coalesce(risk_level, 'Low') AS risk_level, coalesce(detected_patterns, 0) AS detected_patterns, coalesce(published_risks, 0) AS published_risks,
 coalesce(high_risks, 0) AS high_risks, coalesce(medium_risks, 0) AS medium_risks, coalesce(low_risks, 0) AS low_risks
FROM responses p LEFT JOIN ({_report.format(counts=_counts.format(src='answer_risks'))}) r ON r.doc_id = p.doc_id"""))
def failed_reports(spark, d):
    parsed = op.parse_responses(samples.responses(spark, d))
    return op.report_with_failures(op.risk_report(op.risk_rows(parsed)), parsed)


@query("lenient_json_j5", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '{"raw":"broken ' || event_id || '"}' ELSE CAST(json(props) AS VARCHAR) END AS props FROM events""")
def lenient_json(spark, d):
    rows = samples.table(spark, d, "events").select("event_id", F.expr(
        "CASE WHEN event_id % 3 = 0 THEN concat('broken ', event_id) ELSE props END").alias("props"))
    return op.lenient_json(rows, "props").select("event_id", F.to_json("props").alias("props"))


# --- reports
@query("risk_report_g5", with_views("norm_risks", f"SELECT doc_id, detected_patterns, published_risks, risk_score, risk_level FROM ({_report.format(counts=_counts.format(src='norm_risks'))})"))
def risk_report(spark, d):
    return op.risk_report(norm_risks(spark, d)).select("doc_id", "detected_patterns", "published_risks", "risk_score", "risk_level")


@query("kept_risks_g5", with_views("norm_risks", """SELECT doc_id, seq, severity FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, severity ORDER BY seq) AS rn FROM norm_risks)
WHERE rn <= CASE severity WHEN 'low' THEN 3 ELSE 5 END"""))
def kept_risks(spark, d):
    return op.kept_risks(norm_risks(spark, d)).select("doc_id", "seq", "severity")


def _sig(expr):
    cleaned = f"regexp_replace(lower({expr}), '[^a-z0-9\\s]', ' ', 'g')"
    return squeeze(cleaned)


view("signed", f"""SELECT r.doc_id, r.seq, r.severity, trim(concat_ws('|', {_sig("coalesce(nullif(title, ''), risk_type)")}, {_sig('category')}, {_sig('risk_type')},
 array_to_string(string_split({_sig('explanation')}, ' ')[1:8], ' ')), '|') AS signature
FROM risks r JOIN docs d ON d.doc_id = r.doc_id WHERE lower(trim(processing_status)) IN ('completed', 'analyzed', 'processed')""", ["risks", "docs"])
view("distinct_risks", "SELECT signature, severity FROM (SELECT *, row_number() OVER (PARTITION BY signature ORDER BY doc_id, seq) AS rn FROM signed WHERE signature <> '') WHERE rn = 1", ["signed"])


@query("distinct_risks_g6", with_views("distinct_risks", "SELECT * FROM distinct_risks"))
def distinct_risks(spark, d):
    return op.distinct_risks(finals(spark, d), risks(spark, d))


@query("risk_summary_g6", with_views("distinct_risks", """SELECT count(*) AS total_risks, count(*) FILTER (WHERE lower(severity) = 'high') AS high_risk_count,
 count(*) FILTER (WHERE lower(severity) = 'medium') AS medium_risk_count, count(*) FILTER (WHERE lower(severity) = 'low') AS low_risk_count FROM distinct_risks"""))
def risk_summary(spark, d):
    return op.risk_summary(finals(spark, d), risks(spark, d))


@query("severity_counts_g11", with_views("risks", """SELECT count(*) AS total_risks, count(*) FILTER (WHERE lower(severity) = 'high') AS high_risk_count,
 count(*) FILTER (WHERE lower(severity) = 'medium') AS medium_risk_count, count(*) FILTER (WHERE lower(severity) = 'low') AS low_risk_count FROM risks"""))
def severity_counts(spark, d):
    return op.severity_counts(risks(spark, d))


@query("corpus_kpis_g13", with_views("docs distinct_risks", """SELECT 'total_documents' AS metric, count(*) AS value FROM docs UNION ALL
SELECT 'analyzed_documents', count(*) FROM docs WHERE lower(trim(processing_status)) IN ('completed', 'analyzed', 'processed') UNION ALL SELECT 'total_risks', count(*) FROM distinct_risks"""))
def corpus_kpis(spark, d):
    return op.corpus_kpis(finals(spark, d), risks(spark, d))


_payload_item = "concat('{\"title\":\"T', doc_id, '\",\"severity\":\"high\",\"risk_type\":\"liability\"}')"
PAYLOAD = f"""CASE doc_id % 4 WHEN 0 THEN concat('[', {_payload_item}, ',7]') WHEN 1 THEN concat('{{"high_risks":[', {_payload_item}, '],"low_risks":[', {_payload_item}, ',"x"]}}')
 WHEN 2 THEN 'oops' ELSE '{{"high_risks":5}}' END"""


@query("risk_payloads_g15", """SELECT doc_id, CAST(seq AS BIGINT) AS seq, 'T' || doc_id AS title, 'high' AS severity, 'liability' AS risk_type FROM (
 SELECT o_orderkey AS doc_id, 0 AS seq FROM orders WHERE o_orderkey % 4 IN (0, 1) UNION ALL SELECT o_orderkey, 1 FROM orders WHERE o_orderkey % 4 = 1)""")
def risk_payloads(spark, d):
    rows = samples.table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id")).select("doc_id", F.expr(PAYLOAD).alias("risks"))
    out = op.flatten_risk_payload(rows, "risks")
    return out.select("doc_id", F.col("seq").cast("long").alias("seq"), "title", "severity", "risk_type")


@query("supporting_texts_g16", with_views("risks", """SELECT doc_id, seq, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[1:4], '|') AS supporting
FROM (SELECT doc_id, seq, list_filter(list_transform([clause_text, ' ' || clause_text || ' ', title, category, risk_type, 'more'], lambda x: trim(x)), lambda x: x <> '') AS l FROM risks)"""))
def supporting_texts(spark, d):
    rows = risks(spark, d).withColumn("source_clause_texts", F.array(
        F.concat(F.lit(" "), "clause_text", F.lit(" ")), F.col("title"), F.col("category"), F.col("risk_type"), F.lit("more")))
    return op.supporting_texts(rows).select("doc_id", "seq", F.array_join("supporting", "|").alias("supporting"))


@query("top_risks_h3", with_views("norm_risks", """SELECT doc_id, seq, place FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY
 CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, seq) AS place FROM norm_risks) WHERE place <= 3"""))
def top_risks(spark, d):
    return op.top_risks(norm_risks(spark, d), 3).select("doc_id", "seq", F.col("place").cast("long").alias("place"))


view("alerts", f"""SELECT r.doc_id, seq, coalesce(nullif(title, ''), nullif(risk_type, ''), {text(fixed.ALERT_TITLE)}) AS title,
 CASE WHEN lower(severity) IN ('high', 'medium', 'low') THEN lower(severity) WHEN contains(lower(severity), 'high') THEN 'high' WHEN contains(lower(severity), 'med') THEN 'medium' ELSE 'low' END AS severity,
 trim(explanation) AS explanation, coalesce(nullif(document_name, ''), 'Untitled document') AS document_name, coalesce(nullif(category, ''), nullif(risk_type, ''), 'General') AS category,
 coalesce(nullif(document_type, ''), 'General document') AS document_type
FROM risks r JOIN docs d ON d.doc_id = r.doc_id WHERE lower(processing_status) IN ('completed', 'analyzed', 'processed')""", ["risks", "docs"])


@query("alert_feed_f9", with_views("alerts", "SELECT * FROM alerts"))
def alert_feed(spark, d):
    return op.alert_feed(finals(spark, d), risks(spark, d))


@query("filter_alerts_f10", with_views("alerts", "SELECT doc_id, seq, title FROM alerts WHERE severity = 'high' AND category = 'Money'"))
def filter_alerts(spark, d):
    return op.filter_alerts(op.alert_feed(finals(spark, d), risks(spark, d)), "high", "all", "Money").select("doc_id", "seq", "title")


@query("published_lists_i2", with_views("norm_risks", "SELECT doc_id, seq, severity FROM norm_risks WHERE severity IN ('high', 'medium')"))
def published_lists(spark, d):
    r = norm_risks(spark, d).select("doc_id", "seq", "severity")
    return r.filter("severity = 'high'").unionByName(r.filter("severity = 'medium'"))


# --- jobs
@query("queue_status_g7", with_views("jobs", """
SELECT 'counts' AS section, s AS item, CAST(count(id) AS VARCHAR) AS value FROM (VALUES ('queued'), ('processing'), ('completed'), ('failed')) v(s) LEFT JOIN jobs ON status = s GROUP BY s
UNION ALL SELECT 'counts', 'total', CAST(count(*) AS VARCHAR) FROM jobs WHERE status IN ('queued', 'processing', 'completed', 'failed')
UNION ALL SELECT 'oldest_queued_at', '', strftime(min(created_at), '%Y-%m-%d %H:%M:%S') FROM jobs WHERE status = 'queued'
UNION ALL SELECT DISTINCT 'active_workers', worker_name, '' FROM jobs WHERE status = 'processing' AND worker_name <> ''
UNION ALL SELECT 'recent_failures', CAST(id AS VARCHAR), CAST(attempts AS VARCHAR) FROM (SELECT * FROM jobs WHERE status = 'failed' ORDER BY created_at DESC, id DESC LIMIT 5)"""))
def queue_status(spark, d):
    rows = job_op.queue_status(samples.jobs(spark, d))
    return rows.withColumn("value", F.when(F.col("section") == "oldest_queued_at", F.left("value", F.lit(19))).otherwise(F.col("value")))


@query("attempt_outcome_k4", with_views("jobs", """
SELECT job_id, CAST(attempts AS BIGINT) AS attempts, CASE WHEN attempts >= 3 THEN 'failed' ELSE 'queued' END AS status, CASE WHEN attempts < 3 THEN strftime(failed_at + INTERVAL 30 SECOND, '%Y-%m-%d %H:%M:%S') END AS available_at, last_error FROM (
 SELECT document_id AS job_id, max(attempts) AS attempts, max(created_at) AS failed_at, max_by(error, (attempts, created_at)) AS last_error FROM jobs WHERE status = 'failed' GROUP BY 1)"""))
def attempt_outcome(spark, d):
    failed = samples.jobs(spark, d).filter("status = 'failed'").select(
        F.col("document_id").alias("job_id"), "attempts", F.col("created_at").alias("failed_at"), "error")
    return job_op.attempt_outcome(failed).withColumns({"attempts": F.col("attempts").cast("long"), "available_at": F.date_format(
        "available_at", "yyyy-MM-dd HH:mm:ss")})

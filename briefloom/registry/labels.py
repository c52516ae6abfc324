"""Queries of the label operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import labels as op
from ..sources import samples
from . import query
from .sql import any_of, text, view, with_views

table = samples.table

# upload types of every part, cycling through known, unknown and odd spellings
_RAW_TYPES = [*fixed.UPLOAD_TYPES, "lease", "Petition ", "LOAN", "motor_policy", "unknown", "", "rental_contract", "policy"]
RAW_TYPE = f"CASE p_partkey % {len(_RAW_TYPES)} " + " ".join(f"WHEN {i} THEN {text(t)}" for i, t in enumerate(_RAW_TYPES)) + " END"
view("typed_parts", f"SELECT p_partkey, p_name, {RAW_TYPE} AS raw_type FROM part")


def typed_parts(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_name", F.expr(RAW_TYPE).alias("raw_type"))


def d_map(expr, mapping, other="NULL"):
    return f"CASE {expr} " + " ".join(f"WHEN {text(k)} THEN {text(v)}" for k, v in mapping.items()) + f" ELSE {other} END"


@query("upload_type_d1", with_views("typed_parts", f"""SELECT p_partkey, upload_type, upload_type IS NULL AS rejected FROM (
  SELECT p_partkey, {d_map('lower(trim(raw_type))', fixed.UPLOAD_TYPES)} AS upload_type FROM typed_parts)"""))
def upload_type(spark, d):
    return op.normalize_upload_type(typed_parts(spark, d), "raw_type").select("p_partkey", "upload_type", "rejected")


@query("analysis_type_d2", with_views("typed_parts", f"""
SELECT p_partkey, {d_map('lower(trim(raw_type))', fixed.ANALYSIS_TYPES, "'general'")} AS analysis_type FROM typed_parts"""))
def analysis_type(spark, d):
    return op.normalize_type(typed_parts(spark, d), "raw_type").select("p_partkey", "analysis_type")


_ladder = " ".join(
    " ".join(f"WHEN document_type = '{t}' AND {any_of('low', ws)} THEN '{label}'" for ws, label in steps)
    + f" WHEN document_type = '{t}' THEN '{other}'" for t, (steps, other) in fixed.SUBTYPES.items())


@query("subtype_d3", with_views("contract_text", f"""
SELECT doc_id, subtype, subtype = 'loan_agreement' OR doc_id % 10 = 3 AS is_loan FROM (
SELECT doc_id, CASE WHEN {any_of('low', ['loan agreement', 'facility agreement'])} OR ({any_of('low', ['loan', 'facility'])}
  AND {any_of('low', ['borrower', 'lender'])}) THEN 'loan_agreement' {_ladder} ELSE 'general' END AS subtype
FROM (SELECT doc_id, document_type, lower(text) AS low FROM contract_text))"""))
def subtype(spark, d):
    docs = samples.contract_text(spark, d).withColumn("name", F.expr(
        "CASE WHEN doc_id % 10 = 3 THEN 'Loan Agreement.pdf' ELSE 'Deed.pdf' END"))
    return op.subtype(docs, "document_type", "name").select("doc_id", "subtype", "is_loan")


INTENT = f"""CASE WHEN regexp_matches(q, {text(fixed.GREETING)}, 'i') THEN 'greeting'
 WHEN regexp_matches(q, {text(fixed.HELP)}, 'i') THEN 'help' WHEN regexp_matches(q, {text(fixed.OFF_TOPIC)}, 'i') THEN 'off_topic'
 WHEN regexp_matches(q, {text(fixed.LOOKUP)}, 'i') THEN 'entity_lookup' WHEN regexp_matches(q, {text(fixed.ENTITY_LIST)}, 'i') THEN 'entity_query'
 WHEN {any_of('lower(q)', fixed.ANALYSIS_WORDS)} THEN 'legal_analysis' ELSE 'document_qa' END"""


@query("question_intent_d13", with_views("questions", f"""
SELECT intent, count(*) AS n, CAST(sum(query_id % 1000) AS BIGINT) AS id_sum FROM (SELECT query_id, {INTENT} AS intent
 FROM (SELECT query_id, trim(question) AS q FROM questions)) GROUP BY intent"""))
def question_intent(spark, d):
    rows = op.question_intent(samples.spread(samples.questions(spark, d)), "question")
    return rows.groupBy("intent").agg(F.count("*").alias("n"), F.sum(F.col("query_id") % 1000).alias("id_sum"))


STATUS = ("CASE o_orderstatus WHEN 'P' THEN 'Analyzed ' WHEN 'F' THEN 'failed' ELSE CASE o_orderpriority WHEN '5-LOW' THEN 'extracted' "
          "WHEN '1-URGENT' THEN 'Completed' WHEN '2-HIGH' THEN '' WHEN '3-MEDIUM' THEN 'processed' ELSE 'Waiting' END END")
view("statuses", f"SELECT o_orderkey AS doc_id, {STATUS} AS status FROM orders")


@query("status_distribution_d15", with_views("statuses", """
SELECT CASE WHEN coalesce(status, '') = '' THEN '—' WHEN lower(status) IN ('completed', 'analyzed') THEN 'Completed'
  WHEN lower(status) IN ('processing', 'uploaded', 'extracted', 'processed') THEN 'Processed' WHEN lower(status) = 'failed' THEN 'Failed' ELSE status END AS status,
  lower(trim(coalesce(status, ''))) IN ('completed', 'analyzed', 'processed') AS final, count(*) AS n
FROM statuses GROUP BY 1, 2"""))
def status_distribution(spark, d):
    return op.status_distribution(table(spark, d, "orders").select(F.expr(STATUS).alias("status")), "status")


@query("type_classes_d17", with_views("typed_parts", f"""
SELECT type_class, contract_subtype, count(*) AS n FROM (SELECT CASE WHEN k IN ('contract', 'property_agreement', 'rental_contract', 'employment_contract') THEN 'Contracts'
  WHEN k = 'court_judgment' THEN 'Court Judgment' WHEN k = 'general_legal_document' THEN 'General Legal Document' ELSE raw_type END AS type_class,
  {d_map('k', fixed.CONTRACT_SUBTYPE_LABELS, "''")} AS contract_subtype FROM (SELECT *, lower(raw_type) AS k FROM typed_parts)) GROUP BY 1, 2"""))
def type_classes(spark, d):
    return op.type_classes(typed_parts(spark, d), "raw_type").groupBy("type_class", "contract_subtype").agg(F.count("*").alias("n"))


@query("contract_family_d17", with_views("typed_parts", """SELECT p_partkey, raw_type FROM typed_parts
WHERE lower(raw_type) IN ('contract', 'property_agreement', 'rental_contract', 'employment_contract')"""))
def contract_family(spark, d):
    return op.type_classes(typed_parts(spark, d), "raw_type", "contract").select("p_partkey", "raw_type")


SEVERITY = ("CASE event_type WHEN 'error' THEN 'High' WHEN 'view' THEN 'very high' WHEN 'click' THEN 'Med.' WHEN 'signup' THEN '' ELSE event_type END")


@query("severity_d18", f"""SELECT severity_class, count(*) AS n FROM (SELECT CASE WHEN s IN ('high', 'medium', 'low') THEN s
 WHEN contains(s, 'high') THEN 'high' WHEN contains(s, 'med') THEN 'medium' ELSE 'low' END AS severity_class
 FROM (SELECT lower(coalesce(nullif({SEVERITY}, ''), 'medium')) AS s FROM events)) GROUP BY 1""")
def severity(spark, d):
    rows = table(spark, d, "events").select(F.expr(SEVERITY).alias("s"))
    return op.normalize_severity(rows, "s", "medium").groupBy("severity_class").agg(F.count("*").alias("n"))


SCORE = "CASE WHEN c_custkey % 50 = 7 THEN 'n/a' ELSE CAST(CAST(floor(c_acctbal / 100) AS BIGINT) AS VARCHAR(20)) END"


@query("score_bands_d19", f"""SELECT band, count(*) AS n FROM (SELECT CASE WHEN s IS NULL THEN 'Unknown' WHEN s >= 70 THEN 'Low Risk'
 WHEN s >= 40 THEN 'Moderate Risk' ELSE 'High Risk' END AS band FROM (SELECT greatest(0, least(100, floor(try_cast({SCORE} AS DOUBLE) + 0.5))) + 0 * try_cast({SCORE} AS DOUBLE) AS s FROM customer)) GROUP BY 1""")
def score_bands(spark, d):
    return op.score_bands(table(spark, d, "customer").select(F.expr(SCORE).alias("score")), "score")


@query("risk_tags_d21", with_views("risks", f"""
SELECT doc_id, seq, array_to_string(CASE WHEN len(tags) > 0 THEN list_filter(own, lambda x, i: list_position(own, x) = i)[1:3] ELSE
  {'CASE lower(risk_type) ' + ' '.join(f"WHEN '{k}' THEN [{', '.join(text(t) for t in v)}]" for k, v in fixed.TAGS_OF_RISK_TYPE.items()) + " ELSE ['Operational'] END"} END, '|') AS shown_tags
FROM (SELECT doc_id, seq, risk_type, tags, list_filter(list_transform(tags, lambda x: trim(x)), lambda x: x <> '') AS own
 FROM (SELECT *, CASE WHEN tag_text = '' THEN [] ELSE string_split(tag_text, ';') END AS tags FROM risks))"""))
def risk_tags(spark, d):
    return op.risk_tags(tagged_risks(spark, d)).select("doc_id", "seq", F.array_join("shown_tags", "|").alias("shown_tags"))


def tagged_risks(spark, d):
    return samples.risks(spark, d).withColumn("tags", F.when(
        F.col("tag_text") == "", F.array().cast("array<string>")).otherwise(F.split("tag_text", ";")))


_has = {k: f"bool_or({any_of('lower(risk_type)', ws)})" for k, ws in fixed.DIMENSION_WORDS.items()}


@query("risk_dimensions_d22", with_views("risks", f"""
SELECT doc_id, CASE WHEN {_has['financial']} THEN CASE WHEN bool_or(lower(severity) = 'high' AND contains(lower(risk_type), 'financial')) THEN 'high' ELSE 'medium' END ELSE 'low' END AS financial_level,
 CASE WHEN {_has['liability']} THEN 'high' ELSE 'low' END AS liability_level, CASE WHEN {_has['termination']} THEN 'high' ELSE 'low' END AS termination_level,
 CASE WHEN {_has['compliance']} THEN 'medium' ELSE 'low' END AS compliance_level, CASE WHEN {_has['operational']} THEN 'medium' ELSE 'low' END AS operational_level
FROM risks GROUP BY doc_id"""))
def risk_dimensions(spark, d):
    return op.risk_dimensions(samples.risks(spark, d))


@query("search_library_f11", """SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'widget') AND contains(lower(p_type), 'eco')""")
def search_library(spark, d):
    return op.search_library(table(spark, d, "part"), " Widget", "eco", "p_name", "p_type").select("p_partkey", "p_name")


@query("facets_g12", "SELECT DISTINCT p_type AS value FROM part WHERE p_type <> ''")
def facets(spark, d):
    return op.facets(table(spark, d, "part"), "p_type")



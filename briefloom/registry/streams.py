"""Queries of the streaming operators: each runs its stream to the end of the given table and returns the state."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clauses as clause_op
from ..operators import risks as risk_op
from ..operators import segments as segment_op
from ..plans.placement import work_dir
from ..sources import samples
from ..streaming import live as op
from . import query
from .sql import with_views


def _stream(spark, d, name):
    """The parquet table as a file stream."""
    schema = samples.table(spark, d, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(d)


def _jobs(spark, d):
    status = ("CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'processing' WHEN 'purchase' THEN 'completed' "
              "WHEN 'error' THEN 'failed' ELSE 'extracted' END")
    return _stream(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("document_id"), F.expr(status).alias("status"),
                                              F.col("ts").cast("timestamp").alias("ts"))


def _paragraphs_ranked(docs):
    """Clauses of contracts, paragraph by paragraph."""
    paras = segment_op.paragraphs(docs).select("doc_id", "para_no", F.lit(0).alias("pos"), F.col("paragraph").alias("clause"), F.col("paragraph").alias("full_text"))
    return clause_op.rank_clauses(clause_op.dedup_clauses(clause_op.describe_clauses(paras)))


@query("stream_analysis_k1", with_views("ranked", "SELECT doc_id, para_no, clause_type, risk_level, importance_label, rank FROM ranked"))
def stream_analysis(spark, d):
    """Contracts arrive in three files, each a batch: a third with an older text, then the rest, then that third's text of now."""
    out = work_dir(spark)
    docs = samples.contract_text(spark, d).select("doc_id", "text")
    early = F.col("doc_id") % 3 == 0
    old = F.concat(F.lit("Section 1 Withdrawn\n\nThe tenant shall pay a penalty, and the policy premium is due at once.\n\n"), F.col("text"))
    for part in (docs.where(early).withColumn("text", old), docs.where(~early), docs.where(early)):
        part.write.mode("append").parquet(f"{out}/in")
        arrived = spark.readStream.schema(docs.schema).parquet(f"{out}/in")
        op.finished(op.stream_analysis(arrived, f"{out}/rows", f"{out}/checkpoint", buckets=8, analyse=_paragraphs_ranked))
    rows = op.latest_documents(spark, f"{out}/rows").select("doc_id", "para_no", "clause_type", "risk_level", "importance_label", "rank")
    return rows.withColumns({c: F.col(c).cast("long") for c in ("para_no", "rank")})


@query("stream_status_k2", with_views("jobs", """SELECT document_id, status, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS changed_at FROM (
 SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY created_at DESC, id DESC) AS n FROM jobs) WHERE n = 1"""))
def stream_status(spark, d):
    out = work_dir(spark)
    op.finished(op.stream_status(_jobs(spark, d), f"{out}/rows", f"{out}/checkpoint"))
    rows = op.latest_rows(spark, f"{out}/rows", ["document_id"])
    return rows.withColumn("changed_at", F.date_format("changed_at", "yyyy-MM-dd HH:mm:ss"))


@query("stream_rollup_k3", with_views("jobs", "SELECT status, count(*) AS n FROM jobs WHERE status IN ('queued', 'processing', 'completed', 'failed') GROUP BY 1"))
def stream_rollup(spark, d):
    out = work_dir(spark)
    op.finished(op.stream_rollup(_jobs(spark, d), f"{out}/rows", f"{out}/checkpoint"))
    return op.latest_rows(spark, f"{out}/rows", ["status"])


# risks as events: the same event type, value and user say the same thing
@query("stream_dedup_k5", "SELECT DISTINCT 'event ' || event_type || '|||' || CAST(user_id AS VARCHAR) AS signature FROM events")
def stream_dedup(spark, d):
    out = work_dir(spark)
    risks = _stream(spark, d, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("Event "), "event_type").alias("title"), F.lit("").alias("category"),
        F.lit("").alias("risk_type"), F.col("user_id").cast("string").alias("explanation"))
    signed = risks.select("ts", risk_op.risk_signature().alias("signature"))
    op.finished(op.stream_dedup(signed, "ts", "7 days", ["signature"], f"{out}/rows", f"{out}/checkpoint"))
    return spark.read.parquet(f"{out}/rows").select("signature")

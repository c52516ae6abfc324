"""Job-table operators: queue status and outcome of attempts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed


def queue_status(jobs: DataFrame, failures: int = 5) -> DataFrame:
    """(section, item, value): counts per status with zeros and a total, oldest queued time, active workers, latest
    failures. Long form, so no part needs the others' rows."""
    counts = jobs.agg(*[F.count_if(F.col("status") == s).alias(s) for s in fixed.JOB_STATUSES],
                      F.count_if(F.col("status").isin(*fixed.JOB_STATUSES)).alias("total"))
    text = lambda c: F.col(c).cast("string").alias("value")
    rows = counts.unpivot([], [*fixed.JOB_STATUSES, "total"], "item", "value").select(
        F.lit("counts").alias("section"), "item", text("value"))
    oldest = jobs.filter("status = 'queued'").agg(F.min("created_at").alias("t")).select(
        F.lit("oldest_queued_at").alias("section"), F.lit("").alias("item"), text("t"))
    workers = jobs.filter("status = 'processing' AND worker_name <> ''").select("worker_name").distinct().select(
        F.lit("active_workers").alias("section"), F.col("worker_name").alias("item"), F.lit("").alias("value"))
    failed = jobs.filter("status = 'failed'").orderBy(F.desc("created_at"), F.desc("id")).limit(failures).select(
        F.lit("recent_failures").alias("section"), F.col("id").cast("string").alias("item"), text("attempts"))
    return rows.unionByName(oldest).unionByName(workers).unionByName(failed)


def attempt_outcome(attempts: DataFrame, max_attempts: int = 3, delay: str = "30 seconds") -> DataFrame:
    """Per job after its latest failed attempt: failed for good, or queued again after ``delay``."""
    last = attempts.groupBy("job_id").agg(F.max("attempts").alias("attempts"), F.max("failed_at").alias("failed_at"),
                                          F.max_by("error", F.struct("attempts", "failed_at")).alias("error"))
    over = F.col("attempts") >= max_attempts
    error = F.coalesce(F.nullif("error", F.lit("")), F.lit("Unknown worker error"))
    return last.select("job_id", "attempts", F.when(over, "failed").otherwise("queued").alias("status"),
                       F.when(~over, F.expr(f"failed_at + INTERVAL {delay}")).alias("available_at"),
                       F.left(error, F.lit(2000)).alias("last_error"))

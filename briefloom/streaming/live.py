"""The same operators on streams. Sinks write per batch under the batch's number, or exchange the rows of whole documents, so a
repeated batch changes nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions import fixed
from ..plans import briefing as plan
from ..plans.placement import place_by
from ..sources import tables


def _batches(df: DataFrame, out: str, checkpoint: str, mode: str, shape: Callable[[DataFrame], DataFrame] | None = None,
             ) -> StreamingQuery:
    def save(batch: DataFrame, number: int) -> None:
        rows = shape(batch) if shape else batch
        rows.write.mode("overwrite").parquet(f"{out}/batch_id={number}")
    return (df.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def finished(query: StreamingQuery) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def latest_rows(spark: SparkSession, out: str, key: list[str]) -> DataFrame:
    """Current state of a table written batch by batch: the last written row per key."""
    rows = spark.read.parquet(out)
    rest = [c for c in rows.columns if c not in key and c != "batch_id"]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch_id").alias("_r")).select(*key, "_r.*")


# --- analysis of new and changed documents ---------------------------------------------------------------

#: Folders into which the analysed rows are hashed by document. A batch rewrites those it touches.
BUCKETS = 64
#: Rows of a folder that one task writes.
FILE_ROWS = 250_000


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def newest_versions(batch: DataFrame, key: str = "doc_id", version: str | None = None) -> DataFrame:
    """One row per document of a batch: that of greatest ``version`` (without one, or at a tie, the greatest row), so that
    two versions in one batch leave one. Rows without a key name no document and are left out."""
    order = F.struct(*([version] if version else []), *[c for c in batch.columns if c != version])
    return batch.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(order).alias("_r")).select("_r.*")


def _by_bucket(rows: DataFrame, key: str, buckets: int, parts: int) -> DataFrame:
    """Each bucket in one task, or dealt by document over ``parts`` of its own."""
    if parts <= 1:
        return rows.repartition("bucket")
    part = F.pmod(F.xxhash64(F.lit("part"), F.col(key)), F.lit(parts)).cast("int")
    return rows.repartitionById(buckets * parts, F.col("bucket") * parts + part)


def replace_documents(new: DataFrame, out: str, batch_id: int, key: str = "doc_id", buckets: int = BUCKETS) -> None:
    """Exchange the rows of the documents in ``new`` for these rows, in the table under ``out``.

    Rows lie in folders by a hash of the document. Only folders that hold one of the documents are read and rewritten, each
    as one file for every ``FILE_ROWS`` rows, so that a few folders of many rows keep all tasks busy; readers find current rows
    alone and no history collects. The new content is first written whole under
    the number of the batch; a batch that fails while folders are exchanged is completed from there when it runs again, and a
    batch that was completed before changes nothing. A document without new rows keeps what it has.
    """
    spark = new.sparkSession
    current, staged = f"{out}/current", f"{out}/staged/batch-{batch_id}"
    if not _exists(spark, f"{staged}/_SUCCESS"):
        rows = new.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{staged}-new")
        rows = spark.read.schema(rows.schema).parquet(f"{staged}-new")
        many = rows.count()
        if _exists(spark, current):
            held = spark.read.schema(rows.schema).parquet(current)
            touched = F.broadcast(rows.select("bucket").distinct())  # at most ``buckets`` rows; prunes the folders read
            held = held.join(touched, "bucket", "left_semi")
            many += held.count()
            rows = rows.unionByName(held.join(rows.select(key).distinct().hint("merge"), key, "left_anti"))
        _by_bucket(rows, key, buckets, -(-many // (buckets * FILE_ROWS))).write.mode("overwrite").partitionBy("bucket").parquet(staged)
    schema = T.StructType([*new.schema.fields, T.StructField("bucket", T.IntegerType())])
    whole = spark.read.schema(schema).parquet(staged)
    tables.write_replacing(whole, current, "bucket")
    for done in (f"{staged}-new", f"{out}/staged/batch-{batch_id - 1}"):
        _remove(spark, done)


def clause_rows(docs: DataFrame) -> DataFrame:
    return plan.ranked_clauses(plan.cleaned(docs).select("doc_id", "text"))


def stream_analysis(docs: DataFrame, out: str, checkpoint: str, version: str | None = None, buckets: int = BUCKETS,
                    analyse: Callable[[DataFrame], DataFrame] = clause_rows) -> StreamingQuery:
    """Analysed rows (by default clauses) of new and changed documents. A document that comes again replaces its rows; the
    later batch wins, within a batch the greatest ``version``. ``analyse`` gives rows with a ``doc_id``."""
    def save(batch: DataFrame, number: int) -> None:
        placed = place_by(batch, "doc_id")  # else texts that pack well meet in a few tasks
        replace_documents(analyse(newest_versions(placed, version=version)), out, number, buckets=buckets)
    return docs.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_documents(spark: SparkSession, out: str) -> DataFrame:
    """The current rows of all documents."""
    return spark.read.parquet(f"{out}/current").drop("bucket")


# --- states and counts ------------------------------------------------------------------------------------

def current_status(changes: DataFrame) -> DataFrame:
    """Latest status per document from (document_id, status, ts, id); works on streams and tables."""
    return changes.groupBy("document_id").agg(F.max_by("status", F.struct("ts", "id")).alias("status"),
                                              F.max("ts").alias("changed_at"))


def stream_status(changes: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    return _batches(current_status(changes), out, checkpoint, "update")


def rollup_counts(jobs: DataFrame) -> DataFrame:
    """Jobs per status; works on streams and tables."""
    return jobs.filter(F.col("status").isin(*fixed.JOB_STATUSES)).groupBy("status").agg(F.count("*").alias("n"))


def stream_rollup(jobs: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    return _batches(rollup_counts(jobs), out, checkpoint, "update")


def stream_dedup(risks: DataFrame, time_col: str, delay: str, keys: list[str], out: str, checkpoint: str) -> StreamingQuery:
    """First risk per signature, remembered for ``delay`` of event time.

    A signature is forgotten once the watermark, the greatest time seen less ``delay``, has passed its first time by
    ``delay``; a repeat after that is a first risk again. Rows older than the watermark are late and dropped, whether their
    signature is remembered or not. Rows of one batch see the watermark the batches before it left.
    """
    once = risks.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(keys)
    return _batches(once, out, checkpoint, "append")

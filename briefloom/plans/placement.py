"""Where rows go: one hash placement per document, and joins that survive hot keys."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOT_KEYS = 1000


def place_by(df: DataFrame, *keys: str) -> DataFrame:
    """Hash rows by ``keys`` into a fixed number of partitions, once, for all later work on these keys.

    The number is explicit because the work that follows is far heavier than the
    bytes suggest, and adaptive execution sizes partitions by bytes alone.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


def salted_join(rows: DataFrame, lookup: DataFrame, on: str, salts: int = 32, hot_rows: int = 100_000,
                how: str = "inner") -> DataFrame:
    """Join many ``rows`` to a ``lookup`` with one row per key when a few keys hold a large share of the rows.

    Rows of hot keys are dealt over ``salts`` buckets and only the lookup rows of those
    keys are copied that often. The hot list holds at most ``HOT_KEYS`` keys, so it is
    safe to broadcast; every other key is joined once, in bucket 0.
    """
    hot = (rows.groupBy(on).count().filter(F.col("count") > hot_rows).orderBy(F.desc("count")).limit(HOT_KEYS)
           .select(on, F.lit(True).alias("_hot")))
    bucket = F.pmod(F.xxhash64(*[c for c, t in rows.dtypes if not t.startswith("map")]), F.lit(salts)).cast("int")
    left = rows.join(F.broadcast(hot), on, "left").withColumn(
        "_salt", F.when(F.col("_hot"), bucket).otherwise(0)).drop("_hot")
    right = lookup.join(F.broadcast(hot), on, "left").withColumn("_salt", F.explode(F.when(
        F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
    return left.join(right, [on, "_salt"], how).drop("_salt")


def work_dir(spark: SparkSession) -> str:
    """Shared folder for written intermediate tables: the cluster's checkpoint folder, or a fresh local one in
    local mode."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared:
        import uuid
        return f"{shared.rstrip('/')}/briefloom-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return tempfile.mkdtemp(prefix="spark-")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a new folder of ``work_dir`` and read again: evaluated once, with no lineage. The folder may be deleted
    once the result has been read.

    Joins with it are sort-merge joins unless the other side is marked for a broadcast: Spark takes the size of a scan from its
    files, and repeated wording packs so well that far too large a table would be built on the driver and sent to all tasks.
    """
    path = f"{work_dir(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).hint("merge")

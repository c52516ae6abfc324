"""What the operators of this subpackage share: written intermediates, checked broadcasts, hashes, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sides up to this many rows may be broadcast; callers count the side before they ask.
BROADCAST_ROWS = 50_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share, from ``spark.checkpoint.dir``; a temporary one in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = tempfile.mkdtemp(prefix="briefloom-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: evaluated once, lineage cut, safe from lost executors."""
    path = f"{shared_dir(df.sparkSession)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows; otherwise unchanged, for a shuffled join."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def hashed_sample(df: DataFrame, h: Column, max_rows: int, rows: int) -> DataFrame:
    """At most ``max_rows`` of the ``rows`` rows of ``df``, those of least hash ``h``.

    Rows are first thinned by hash to a few more than wanted, so the final cut sees about ``max_rows`` rows at any input size.
    """
    if rows > 2 * max_rows:
        df = df.where(F.pmod(h, F.lit(1 << 40)) < int((1 << 40) * 1.5 * max_rows / rows))
    return df.orderBy(F.pmod(h, F.lit(1 << 40))).limit(max_rows)


def text_of(column: str | Column) -> Column:
    """The text, null counting as empty."""
    return F.coalesce(column if isinstance(column, Column) else F.col(column), F.lit(""))


def hash60(*parts: Column | str) -> Column:
    """60 bits of the MD5 of the parts joined by ``|`` (nulls as the word null): the same number in any SQL engine."""
    words = [F.coalesce(p.cast("string"), F.lit("null")) if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *words)), 1, 15), 16, 10).cast("long")


def same(a: DataFrame, b: DataFrame, pairs: Sequence[tuple[str, str]]) -> Column:
    """Null-safe equality of column pairs, as a join condition."""
    cond = F.lit(True)
    for x, y in pairs:
        cond = cond & a[x].eqNullSafe(b[y])
    return cond


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)``: one row ``(node, root)`` per node that has an edge.

    Each round every node moves to the neighbour, or itself, of least random rank; edges are carried over to the new
    nodes and loops dropped. Ranks are drawn anew by round, so paths shrink by a constant share and the number of
    rounds is logarithmic. Links stay distributed; only the number of edges left comes to the driver.
    """
    edges = stored(edges.select("a", "b").where(F.col("a") != F.col("b")).distinct(), "edges")
    moves: list[DataFrame] = []
    for turn in range(max_rounds):
        if edges.isEmpty():
            break
        rank = lambda c, t=turn: F.struct(F.xxhash64(F.lit(t), c).alias("h"), F.col(c).alias("n"))
        both = edges.select("a", "b").union(edges.select("b", "a"))
        least = both.groupBy(F.col("a").alias("node")).agg(F.min(rank("b")).alias("m"))
        move = stored(least.select("node", F.when(F.col("m") < rank("node"), F.col("m.n")).otherwise(F.col("node")).alias("to")), "moves")
        moves.append(move)
        left = edges.join(move.select(F.col("node").alias("a"), F.col("to").alias("x")), "a")
        right = left.join(move.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        edges = stored(right.where(F.col("x") != F.col("y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    else:
        raise RuntimeError("components did not settle")
    if not moves:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = moves[0].select("node", F.col("to").alias("root"))
    for move in moves[1:]:
        step = move.select(F.col("node").alias("root"), F.col("to").alias("next"))
        out = out.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return out

"""Extractive summaries. A document's sentences are scored and chosen inside its row: no shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, segmenting
from ..functions.columns import bind, strip
from ..plans.placement import work_dir
from . import graph_rank


def score_of(sentence: Column) -> Column:
    low = F.lower(sentence)
    keywords = reduce(lambda a, b: a + b, [F.when(low.contains(w), 3).otherwise(0) for w in fixed.SCORE_WORDS])
    return (keywords + F.when(sentence.rlike(r"(?U)\d"), 2).otherwise(0)
            + F.when(sentence.rlike("(?iU)" + fixed.SECTION_REFERENCE), 3).otherwise(0)
            + F.when(sentence.rlike("(?i)" + fixed.CURRENCY), 3).otherwise(0))


def sentence_score(sentences: DataFrame, sentence: str = "sentence") -> DataFrame:
    return sentences.withColumn("score", score_of(F.col(sentence)).cast("long"))


def chosen_sentences(c: Column, n: int) -> Column:
    """Best ``n`` distinct sentences, back in text order; ties go to the earlier one."""
    def pick(xs: Column) -> Column:
        scored = F.transform(xs, lambda s, i: F.struct((-score_of(s)).alias("s"), i.alias("i"), s.alias("text")))
        best = F.slice(F.array_sort(scored), 1, n)
        return F.transform(F.array_sort(F.transform(best, lambda x: F.struct(x["i"].alias("i"), x["text"].alias("text")))),
                           lambda x: x["text"])
    return bind(F.array_distinct(segmenting.sentences(c)), pick)


def extractive_summary(df: DataFrame, n: int = 10, text: str = "text") -> DataFrame:
    """Adds ``extractive_summary``, one bullet line per sentence."""
    lines = F.transform(chosen_sentences(F.col(text), n), lambda s: F.concat(F.lit("- "), s))
    return df.withColumn("extractive_summary", F.array_join(lines, "\n"))


def lead_summary(df: DataFrame, n: int = 6, text: str = "text") -> DataFrame:
    return df.withColumn("lead_summary", F.array_join(F.slice(segmenting.sentences_raw(F.col(text)), 1, n), " "))


def graph_rank_summary(df: DataFrame, n: int = 6, iterations: int = 20, text: str = "text") -> DataFrame:
    """Adds ``graph_summary``: the ``n`` sentences ranked highest on the graph of shared words, in text order.

    Rows are numbered, so repeated rows and null keys each keep their own summary.
    """
    held = numbered(df)
    made = graph_rank.summarize(held.select("uid", F.col(f"row.{text}").alias("text")), n, iterations)
    return held.join(made.withColumnRenamed("summary", "graph_summary"), "uid").select("row.*", "graph_summary")


def numbered(df: DataFrame) -> DataFrame:
    """``uid, row`` of every row; written, so the numbers stay when a task is run again."""
    path = f"{work_dir(df.sparkSession)}/rows"
    df.select(F.monotonically_increasing_id().alias("uid"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def reduce_summaries(chunks: DataFrame, fan_in: int = 6, iterations: int = 20) -> DataFrame:
    """Summary per document from its chunks: 3 sentences per chunk, then groups of ``fan_in`` to 4 sentences until one is left.

    Blank chunks are skipped and the rest numbered anew; a document of blank chunks alone has no row. Only documents that
    still have several texts take part in a level, so the number of levels grows with the logarithm of the longest.
    """
    spark = chunks.sparkSession
    kept = chunks.where(F.length(strip(F.col("chunk_text"))) > 0)
    order = Window.partitionBy("doc_id").orderBy("chunk_index", "chunk_text")
    kept = kept.select("doc_id", (F.row_number().over(order) - 1).alias("i"), F.col("chunk_text").alias("t"))
    level, done, keep = kept, [], 3
    while True:
        # the numbers stay, as the sentences are written before they are used
        made = graph_rank.summarize(level.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "i", F.col("t").alias("text")), keep, iterations)
        path = f"{work_dir(spark)}/level"
        made.select("doc_id", "i", F.col("summary").alias("t")).write.parquet(path)
        level = spark.read.parquet(path)
        level = level.withColumn("more", F.count("*").over(Window.partitionBy("doc_id")) > 1)
        done.append(level.where("NOT more").select("doc_id", F.col("t").alias("summary")))
        level = level.where("more")
        if level.isEmpty():
            return reduce(DataFrame.unionByName, done)
        group = F.array_sort(F.collect_list(F.struct("i", "t")))
        level = level.groupBy("doc_id", F.floor(F.col("i") / fan_in).cast("int").alias("i")).agg(F.array_join(F.transform(group, lambda x: x["t"]), " ").alias("t"))
        keep = 4

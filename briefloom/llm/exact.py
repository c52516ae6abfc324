"""Exact dedup by progressive refinement: length, then the hash of the beginning, then the hash of the whole text.

Texts are equal when identical after lower-casing A-Z only; null counts as empty. Of equal texts the largest id stays
(null ids come last); of rows that also share the id, one stays. Empty input gives no rows.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from briefloom.llm.common import text_of

#: Characters of the beginning that the second step hashes.
PREFIX_CHARS = 256


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else unchanged. Pure ASCII texts take the fast built-in."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def text_hash(text: Column) -> Column:
    return F.sha2(lower_ascii(text), 256)


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of two or more equal texts: ``text_sha256, keep_id, group_size``.

    Only lengths travel for the first count, lengths and prefix hashes of the rows left for the second. Whole texts are
    read and hashed for ids that share both, and the groups are counted by that hash with map-side combine.
    """
    text = text_of(text_col)
    light = docs.select(F.col(id_col).alias("id"), F.octet_length(text).alias("bytes"),
                        F.xxhash64(lower_ascii(F.left(text, F.lit(PREFIX_CHARS)))).alias("prefix"))
    lengths = light.groupBy("bytes").count().where("count > 1").select("bytes")
    same_length = light.join(lengths, "bytes", "left_semi")
    prefixes = same_length.groupBy("bytes", "prefix").count().where("count > 1").select("bytes", "prefix")
    ids = same_length.join(prefixes, ["bytes", "prefix"], "left_semi").select("id").distinct()
    whole = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    left = whole.join(ids, whole["id"].eqNullSafe(ids["id"]), "left_semi")
    return (left.select("id", text_hash(F.col("text")).alias("text_sha256")).groupBy("text_sha256")
            .agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1"))


def mark_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col, keep_id, group_size, kept, text_sha256``.

    Equal rows, id included, are counted together and told apart by number, so exactly one row of a group is kept.
    """
    groups = duplicate_groups(docs, id_col, text_col).withColumnRenamed("text_sha256", "sha")
    rows = (docs.select(F.col(id_col).alias("id"), text_hash(text_of(text_col)).alias("text_sha256"))
            .groupBy("id", "text_sha256").agg(F.count("*").alias("times")))
    joined = rows.join(groups, rows["text_sha256"] == groups["sha"], "left")
    numbered = joined.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    keep = F.when(F.col("sha").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return numbered.select(
        F.col("id").alias(id_col), keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("id").eqNullSafe(keep) & (F.col("nth") == 1)).alias("kept"), "text_sha256")


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns kept. One shuffle of the texts, by id and hash."""
    stays = (mark_duplicates(docs, id_col, text_col).where("kept")
             .select(F.col(id_col).alias("__stay_id"), F.col("text_sha256").alias("__stay_sha")))
    hashed = docs.withColumn("__sha", text_hash(text_of(text_col)))
    cond = hashed[id_col].eqNullSafe(stays["__stay_id"]) & (hashed["__sha"] == stays["__stay_sha"])
    return hashed.join(stays, cond, "left_semi").dropDuplicates([id_col, "__sha"]).drop("__sha")

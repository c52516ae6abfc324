"""A training corpus from ``documents``: toxic texts out, exact and near copies out, sources mixed to their targets, packed.

Every stage takes ``(spark, docs, sf_dir)`` and works on all its predecessor kept; all but the last return the columns
of ``documents``. Stages are written as Parquet to the shared folder and read again, so a lost executor costs one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from briefloom.llm import exact, jaccard, mixing, packing, toxicity
from briefloom.llm.common import stored


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under the threshold. The model learns from the labelled documents of the same input, hold-outs excluded."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~toxicity.held_out(F.col("doc_id")))
    return model.score(docs, docs.columns, keep_text=True).where("predicted = 0").select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document of largest id."""
    return exact.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document of least id."""
    return jaccard.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; the one at which a source's target is met keeps its first words."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, in sequences along the curve."""
    return packing.pack(docs)


STAGES = [("toxicity", reject_toxic), ("exact dedup", drop_exact_copies), ("n-gram Jaccard join", drop_near_copies),
          ("mixing sources", mix_sources), ("packing", pack_sequences)]

#: The first stage is a learned model, so no SQL gives the rows; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

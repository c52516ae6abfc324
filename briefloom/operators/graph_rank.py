"""Sentences ranked on the graph of their shared words, for many texts at once.

The weight between two sentences of a text is the number of distinct words both hold over the sum of the logarithms of how
many each holds; no weight where that sum is zero. A round gives each sentence 0.15 / n and 0.85 of what its neighbours
pass on, each in proportion to its weights.

No pair of sentences is ever a row. The holders of a word that hold equally many words form a class: what a class passes on
through its word is one sum, and reaches a sentence that holds the word divided by one number. A round is one join and sum of
sentences into classes, and one of classes into sentences, however often a word occurs. Words of a single sentence link
nothing and are dropped. What a sentence would pass to itself is taken off by a class of its own with the negative weight.

All rows of a text are placed once by its number; the fixed tables stay cached there while the rounds run, and the scores are
written every few rounds, so no plan or lineage grows with the rounds.

A text of few sentences needs none of that: its bounded matrix is ranked in the task that holds the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

from ..functions import segmenting
from ..functions.columns import squeeze
from ..plans.placement import place_by, work_dir

DAMPING = 0.85
#: Rounds in one plan.
ROUNDS_AT_ONCE = 2
_SUBKEY = "spark.sql.requireAllClusterKeysForCoPartition"


@contextmanager
def _joined_in_place(spark: SparkSession) -> Iterator[None]:
    """Joins on (text, …) keep rows placed by text; the session's own setting returns afterwards."""
    before = spark.conf.get(_SUBKEY, None)
    spark.conf.set(_SUBKEY, "false")
    try:
        yield
    finally:
        spark.conf.set(_SUBKEY, before) if before is not None else spark.conf.unset(_SUBKEY)


def words_of(sentence: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(sentence), F.lit(r"(?U)\w+"), F.lit(0)))


def _weight(a: str, b: str) -> Column:
    return F.when(F.col(a) + F.col(b) > 0, 1 / (F.col(a) + F.col(b))).otherwise(0.0)


def _shared(holders: DataFrame) -> DataFrame:
    """From ``(uid, i, log, w)`` the rows of words that several sentences of a text hold, words and classes numbered."""
    # log is a function of the number of words, so equal logs are equal numbers
    ordered = holders.select("uid", "i", "log", F.dense_rank().over(Window.partitionBy("uid").orderBy("w")).alias("w"),
                             F.dense_rank().over(Window.partitionBy("uid").orderBy("w", "log")).alias("c"))
    return ordered.withColumn("holders", F.count("*").over(Window.partitionBy("uid", "w"))).where("holders > 1").drop("holders")


def _links(shared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Who is in a class ``(uid, i, c)``, and whom it reaches ``(uid, c, i, weight)``."""
    classes = shared.groupBy("uid", "w", "c", F.col("log").alias("from_log")).agg(F.count("*").alias("size"))
    reached = shared.drop("c").join(classes, ["uid", "w"]).select("uid", "c", "i", _weight("log", "from_log").alias("weight"))
    own = shared.groupBy("uid", "i").agg(F.sum(_weight("log", "log")).alias("own"))
    alone = own.select("uid", (-1 - F.col("i")).alias("c"), "i", (-F.col("own")).alias("weight"))
    members = shared.select("uid", "i", "c").unionByName(own.select("uid", "i", (-1 - F.col("i")).alias("c")))
    return members, reached.unionByName(alone)


def rank_sentences(sentences: DataFrame, iterations: int = 20, folder: str | None = None) -> DataFrame:
    """``uid, i, score`` of ``sentences(uid, i, n, sentence)``, n being the number of sentences of the text.

    Written tables go to ``folder``, else to a new folder under the cluster's checkpoint folder; they may be deleted once
    the result has been read.
    """
    spark = sentences.sparkSession
    folder = folder or work_dir(spark)

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    words = sentences.select("uid", "i", "n", words_of(F.col("sentence")).alias("words"))
    words = written(words.select("uid", "i", "n", F.log(F.greatest(F.size("words"), F.lit(1))).alias("log"), "words"), "words")
    with _joined_in_place(spark):
        placed = place_by(words, "uid")
        shared = _shared(placed.select("uid", "i", "log", F.explode("words").alias("w"))).persist(StorageLevel.MEMORY_AND_DISK)
        members, reached = _links(shared)
        members, reached = members.persist(StorageLevel.MEMORY_AND_DISK), reached.persist(StorageLevel.MEMORY_AND_DISK)

        def passed(outs: DataFrame) -> DataFrame:
            """What reaches each sentence of ``(uid, i, out)``."""
            into = members.join(outs.hint("shuffle_hash"), ["uid", "i"]).groupBy("uid", "c").agg(F.sum("out").alias("given"))
            return reached.join(into.hint("shuffle_hash"), ["uid", "c"]).groupBy("uid", "i").agg(F.sum(F.col("weight") * F.col("given")).alias("got"))

        # weights are symmetric: what reaches a sentence if each passes 1 is the sum of its weights
        base = place_by(words.select("uid", "i", "n"), "uid")
        total = passed(base.select("uid", "i", F.lit(1.0).alias("out")))
        base = base.join(total, ["uid", "i"], "left").select("uid", "i", "n", F.coalesce("got", F.lit(0.0)).alias("total")).persist(StorageLevel.MEMORY_AND_DISK)
        scores = base.select("uid", "i", (1.0 / F.col("n")).alias("score"), "total")
        for turn in range(iterations):
            got = passed(scores.select("uid", "i", F.when(F.col("total") > 1e-12, F.col("score") / F.col("total")).otherwise(0.0).alias("out")))
            scores = base.join(got.hint("shuffle_hash"), ["uid", "i"], "left").select("uid", "i", ((1 - DAMPING) / F.col("n") + DAMPING * F.coalesce("got", F.lit(0.0))).alias("score"), "total")
            if turn == iterations - 1 or turn % ROUNDS_AT_ONCE == ROUNDS_AT_ONCE - 1:
                scores = place_by(written(scores, f"scores-{turn}"), "uid")
    for df in (shared, members, reached, base):
        df.unpersist()
    return spark.read.parquet(f"{folder}/scores-{iterations - 1}").select("uid", "i", "score")


#: A text of at most so many sentences and characters is ranked whole in the task that reads it.
SMALL_SENTENCES, SMALL_CHARS = 256, 50_000
#: Words that are compared at once.
_WORDS_AT_ONCE = 4_096


def _scores(lengths: np.ndarray, words: np.ndarray, iterations: int) -> np.ndarray:
    """Scores of the sentences of one text that hold ``lengths`` distinct words each, ``words`` being their numbers, one after another."""
    n = len(lengths)
    holder, (kinds, word) = np.repeat(np.arange(n), lengths), np.unique(words, return_inverse=True)
    shared = np.zeros((n, n))
    for start in range(0, len(kinds), _WORDS_AT_ONCE):
        part = (word >= start) & (word < start + _WORDS_AT_ONCE)
        held = np.zeros((n, min(_WORDS_AT_ONCE, len(kinds) - start)))
        held[holder[part], word[part] - start] = 1.0
        shared += held @ held.T
    log = np.log(np.maximum(lengths, 1))
    both = log[:, None] + log[None, :]
    weights = np.divide(shared, both, out=np.zeros((n, n)), where=both > 0)
    np.fill_diagonal(weights, 0.0)
    total = weights.sum(axis=1)
    passed = np.divide(1.0, total, out=np.zeros(n), where=total > 1e-12)
    score = np.full(n, 1.0 / n)
    for _ in range(iterations):
        score = (1 - DAMPING) / n + DAMPING * (weights @ (score * passed))
    return score


def _picked(texts: DataFrame, iterations: int) -> DataFrame:
    """``summary`` in place of ``sentences, n`` for texts small enough to be ranked in their task; the order is that of ``summarize``."""
    rest = [c for c in texts.columns if c not in ("sentences", "n")]

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch["words"]
            per_sentence = words.flatten()
            lengths = pc.list_value_length(per_sentence).to_numpy(zero_copy_only=False)
            codes = pc.dictionary_encode(per_sentence.flatten()).indices.to_numpy(zero_copy_only=False)
            ends = np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False))
            word_ends = np.concatenate([[0], np.cumsum(lengths)])
            sentences, out, begin = batch["sentences"].flatten(), [], 0
            for end, n in zip(ends, batch["n"].to_pylist()):
                score = np.round(_scores(lengths[begin:end], codes[word_ends[begin]:word_ends[end]], iterations), 12)
                best = np.sort(np.lexsort((np.arange(end - begin), -score))[:n])
                out.append(" ".join(sentences.take(pa.array(best + begin)).to_pylist()))
                begin = end
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in rest], pa.array(out, pa.string())], names=[*rest, "summary"])

    marked = texts.withColumn("words", F.transform("sentences", words_of))
    fields = [f for f in texts.schema.fields if f.name in rest]
    return marked.mapInArrow(pick, T.StructType([*fields, T.StructField("summary", T.StringType())]))


def summarize(texts: DataFrame, n: int | Column, iterations: int = 20) -> DataFrame:
    """``summary`` in place of ``text``, of ``texts(uid, text, …)``, one row a uid: the ``n`` best sentences in text order, all if there are no more.

    Equal scores (to 12 digits) go to the earlier sentence. Null and blank texts have an empty summary. Texts of few sentences and
    characters are ranked where they lie, the others sentence by sentence; both by the same formula.
    """
    spark = texts.sparkSession
    folder = work_dir(spark)
    rest = [c for c in texts.columns if c != "text"]
    flat = texts.select(*rest, squeeze(F.coalesce("text", F.lit(""))).alias("text"), (n if isinstance(n, Column) else F.lit(n)).cast("int").alias("n"))
    cut = flat.select(*rest, "n", segmenting.sentences_raw(F.col("text")).alias("sentences"), (F.length("text") > SMALL_CHARS).alias("long"))
    cut.write.parquet(f"{folder}/texts")
    cut = spark.read.schema(cut.schema).parquet(f"{folder}/texts")
    whole, large = F.size("sentences") <= F.col("n"), F.col("long") | (F.size("sentences") > SMALL_SENTENCES)
    short = cut.where(whole).select(*rest, F.array_join("sentences", " ").alias("summary"))
    made = short.unionByName(_picked(cut.where(~whole & ~large).drop("long"), iterations))
    cut = cut.where(~whole & large)
    if cut.isEmpty():
        return made
    rows = cut.select("uid", F.size("sentences").alias("size"), "n", F.posexplode("sentences").alias("i", "sentence"))
    scores = rank_sentences(rows.select("uid", "i", F.col("size").alias("n"), "sentence"), iterations, folder)
    best = Window.partitionBy("uid").orderBy(F.round("score", 12).desc(), "i")
    ranked = scores.join(cut.select("uid", "n"), "uid").withColumn("place", F.row_number().over(best)).where(F.col("place") <= F.col("n"))
    picked = ranked.groupBy("uid").agg(F.array_sort(F.collect_list("i")).alias("picked"))
    chosen = F.transform("picked", lambda i: F.element_at("sentences", i + 1))
    return made.unionByName(cut.join(picked, "uid").select(*rest, F.array_join(chosen, " ").alias("summary")))

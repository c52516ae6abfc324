"""Document fingerprints by consistent weighted sampling.

The terms of a text are its words, weighted by how often they occur. For each of ``SAMPLES`` seeds every term draws
r ~ Gamma(2, 1), c ~ Gamma(2, 1) and b ~ U(0, 1) from hashes of term and seed; with t = floor(ln(weight) / r + b) the term's
value is ln c - r (t + 1 - b), and the sample is the (term, t) of least value. Two texts agree in a sample with
probability sum of min / sum of max of their weights. Equal texts have equal fingerprints.

All of it is built-in expressions and aggregates. A text is shuffled once, to its id; words are counted and samples
drawn in that place. Null texts and texts without words have the fingerprint of the empty text; two such texts have
likeness 1. Rows of one id are documents of their own, the smallest text of the next id being their neighbour.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from briefloom.llm.common import stored, text_of

#: Samples of a fingerprint, and how many of them one pass over the terms draws.
SAMPLES, AT_ONCE = 32, 8
WORDS = r"[^\p{L}\p{N}]+"
#: A sample is a 64-bit number: the value in its upper bits, so that the least number is the sample of least value; the rest names (term, t).
VALUE_SCALE, NAME_BITS, VALUE_SHIFT = 1 << 30, 23, 512.0


def _unit(h: Column, shift: int) -> Column:
    """20 bits of a hash as a number in (0, 1)."""
    return (F.shiftrightunsigned(h, shift).bitwiseAND(0xFFFFF).cast("double") + 0.5) / float(1 << 20)


def _sample(term: Column, log_weight: Column, seed: Column) -> Column:
    a = F.xxhash64(term, seed)
    b = F.xxhash64(a)
    r = -F.log(_unit(a, 0) * _unit(a, 20))
    beta = _unit(a, 40)
    log_c = F.log(-F.log(_unit(b, 0) * _unit(b, 20)))
    t = F.floor(log_weight / r + beta)
    value = log_c - r * (t + 1 - beta)
    name = F.xxhash64(a, t).bitwiseAND((1 << NAME_BITS) - 1)
    return F.shiftleft(((value + VALUE_SHIFT) * float(VALUE_SCALE)).cast("long"), NAME_BITS).bitwiseOR(name)


def next_ids(docs: DataFrame, id_col: str = "id") -> DataFrame:
    """``(id, next)`` for each distinct id in ascending order, null first; after the last comes the first.

    Ids are range-partitioned; within a partition the next row is a window away, across partitions it is the first of
    the next one that has rows. No step sorts all ids in one task.
    """
    ids = docs.select(F.col(id_col).alias("id")).distinct()
    ranged = stored(ids.repartitionByRange("id").withColumn("part", F.spark_partition_id()), "ids")
    order = Window.partitionBy("part").orderBy("id")
    firsts = ranged.groupBy("part").agg(F.min(F.struct(F.col("id").isNotNull(), "id")).alias("first"))
    firsts = firsts.withColumn("first", F.col("first.id"))
    # one row per partition, as many as there are shuffle partitions
    parts = Window.orderBy("part")
    whole = parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = firsts.select("part", F.lead("first").over(parts).alias("after"), F.first("first").over(whole).alias("start"), F.max("part").over(whole).alias("end"))
    return ranged.withColumns({"next": F.lead("id").over(order), "is_last": F.lead(F.lit(True)).over(order).isNull()}).join(F.broadcast(after), "part").select(
        "id", F.when(~F.col("is_last"), F.col("next")).when(F.col("part") == F.col("end"), F.col("start")).otherwise(F.col("after")).alias("next"))


def samples(texts: DataFrame, keys: list[str]) -> DataFrame:
    """``texts(*keys, text)`` to ``keys, s0 … s31``. Rows without words are absent. Expects rows placed by the first key."""
    words = texts.select(*keys, F.explode(F.split(F.lower("text"), WORDS)).alias("word")).where(F.col("word") != "")
    terms = words.select(*keys, F.xxhash64("word").alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("n"))
    drawn = terms.select(*keys, "term", F.log(F.col("n").cast("double")).alias("weight"), F.explode(F.array(*[F.lit(i) for i in range(SAMPLES // AT_ONCE)])).alias("lot"))
    drawn = drawn.select(*keys, "lot", *[_sample(F.col("term"), F.col("weight"), F.col("lot") * AT_ONCE + i).alias(f"v{i}") for i in range(AT_ONCE)])
    least = drawn.groupBy(*keys, "lot").agg(*[F.min(f"v{i}").alias(f"v{i}") for i in range(AT_ONCE)])
    name = lambda i: F.lpad(F.hex(F.col(f"v{i}").bitwiseAND((1 << NAME_BITS) - 1)), 6, "0")
    lots = least.select(*keys, F.struct("lot", F.concat(*[name(i) for i in range(AT_ONCE)]).alias("part")).alias("part"))
    return lots.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list("part")), lambda p: p["part"]), "").alias("fingerprint"))


#: Fingerprint of texts without words.
EMPTY = "-" * (6 * SAMPLES)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples of two fingerprints."""
    equal = [(F.substring(a, 6 * i + 1, 6) == F.substring(b, 6 * i + 1, 6)).cast("int") for i in range(SAMPLES)]
    total = equal[0]
    for e in equal[1:]:
        total = total + e
    return total / float(SAMPLES)


def key_of(column: str | Column) -> Column:
    """An id as a text that is never null, so that joins and groups on it share one placement."""
    column = column if isinstance(column, Column) else F.col(column)
    return F.coalesce(F.concat(F.lit("#"), column.cast("string")), F.lit(""))


def fingerprint(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``id_col, text_hash, fingerprint`` for each distinct id and text."""
    rows = docs.select(key_of(id_col).alias("k"), F.col(id_col).alias("id"), text_of(text_col).alias("text")).repartition("k")
    rows = rows.withColumn("h", F.xxhash64("text"))
    made = samples(rows.select("k", "h", "text"), ["k", "h"])
    light = rows.groupBy("k", "h").agg(F.first("id").alias("id"))
    return light.join(made, ["k", "h"], "left").select(F.col("id").alias(id_col), F.col("h").alias("text_hash"), F.coalesce("fingerprint", F.lit(EMPTY)).alias("fingerprint"))


def edited_fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Each document, and its text with the last quarter replaced by the beginning of the next document's:
    ``id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``. One row per input row."""
    text = text_of(text_col)
    # the same two columns wherever texts are moved, so that Spark moves them once and reuses the exchange
    rows = docs.select(key_of(id_col).alias("k"), text.alias("text"))
    needs = docs.select(key_of(id_col).alias("k"), F.length(text).alias("n")).groupBy("k").agg(F.floor(F.max("n") / 4).cast("int").alias("need"))
    chain = next_ids(docs, id_col).select(key_of("id").alias("k"), key_of("next").alias("next"))
    chain = stored(chain.join(needs, "k"), "chain")
    wanted = chain.select("k", "need", F.col("next").alias("nk"))
    heads = rows.withColumnRenamed("k", "at").join(wanted, F.col("at") == F.col("nk")).select("k", "nk", F.xxhash64("text").alias("nh"), F.left("text", "need").alias("head"))
    heads = heads.groupBy("k", "nk").agg(F.min(F.struct("head", "nh")).alias("m")).select("k", "nk", F.col("m.head").alias("head"), F.col("m.nh").alias("nh"))
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    both = rows.join(heads, "k").select("k", F.xxhash64("text").alias("h"), n.cast("long").alias("n_chars"), "text", "nk", "nh",
                                        F.concat(F.left("text", n - cut), F.left("head", cut)).alias("edited"))
    light = both.groupBy("k", "h").agg(F.count("*").alias("times"), F.first("n_chars").alias("n_chars"), F.first("nk").alias("nk"),
                                       F.first("nh").alias("nh"), F.first(F.sha2("edited", 256)).alias("edited_sha256"))
    sides = both.select("k", "h", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("text")),
                                                    F.struct(F.lit(1).alias("side"), F.col("edited").alias("text")))).alias("s"))
    made = samples(sides.select("k", "h", "s.side", "s.text"), ["k", "h", "side"])
    pairs = made.groupBy("k", "h").agg(F.max(F.when(F.col("side") == 0, F.col("fingerprint"))).alias("f0"), F.max(F.when(F.col("side") == 1, F.col("fingerprint"))).alias("f1"))
    done = light.join(pairs, ["k", "h"], "left").select("k", "h", "times", "n_chars", "nk", "nh", "edited_sha256", F.coalesce("f0", F.lit(EMPTY)).alias("fingerprint"),
                                                        F.coalesce("f1", F.lit(EMPTY)).alias("edited_fingerprint"))
    done = stored(done, "fingerprints")
    after = done.select(F.col("k").alias("nk"), F.col("h").alias("nh"), F.col("fingerprint").alias("next_fingerprint"))
    out = done.join(after, ["nk", "nh"]).withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    id_type = docs.schema[id_col].dataType.simpleString()
    of_key = F.when(F.col("k") != "", F.substr("k", F.lit(2)).cast(id_type))
    return out.select(of_key.alias(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                      likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))

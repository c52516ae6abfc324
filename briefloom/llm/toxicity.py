"""Toxicity scores: gradient-boosted trees over dense features of a text, calibrated by isotonic regression.

Features are densities of two learned lexicons (words, and beginnings of words), how close their hits stand to second-person words,
and rates of capitals, punctuation and obfuscation. Everything is learned from labelled rows, at most ``MAX_PER_CLASS``
per class, chosen by hash; rows a caller holds out never enter. Lexicon features of a training row come from the rows
of the other fold, so the trees do not see the row's own words as evidence.

Null and empty texts are scored like any other (all rates zero). Unless labelled documents of both classes are found, every
score is the share of label 1 among the labels, or 0. Rows are independent: repeated rows get equal scores, empty input gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from briefloom.llm.common import hashed_sample, stored, text_of

#: Labelled rows per class that are learned from, entries of a lexicon, and score from which a text is called toxic.
MAX_PER_CLASS = 10_000
MAX_ENTRIES = 2_000
THRESHOLD = 0.7
#: Beginnings of words that a lexicon may hold, in characters.
STEMS = (4, 5)
#: A lexicon's entry: least number of toxic rows (and share of them), least log odds.
LEAST_ROWS, LEAST_SHARE, LEAST_ODDS = 3, 0.004, 2.5
TREES, DEPTH = 15, 3
#: Second-person words of the corpus's languages. Fixed values.
SECOND_PERSON = frozenset("you your yours yourself ya u du dich dir dein deine ihr euch sie tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros os".split())
WORD = re.compile(r"\w+")
LEET = str.maketrans("013457@$", "oleastas")
FEATURES = ["word_density", "stem_density", "word_best", "stem_best", "hits", "closeness", "capitals", "capital_words", "exclamations", "punctuation", "obfuscation", "stretched", "length"]
FEATURE_TYPE = ", ".join(f"{f} double" for f in FEATURES)


class Scorer:
    """Features of texts under one lexicon: ``{word: odds}`` and ``{stem: odds}``."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.words, self.stems, self.known = words, stems, {}

    def _odds(self, token: str) -> tuple[float, float, float]:
        """Odds as a word, as a stem, and whether the token mixes letters with digits."""
        plain = token.lower()
        mixed = not plain.isalpha() and not plain.isdigit() and "_" not in plain
        if mixed:
            plain = plain.translate(LEET)
        return self.words.get(plain, 0.0), max((self.stems.get(plain[:k], 0.0) for k in STEMS if len(plain) >= k), default=0.0), float(mixed)

    def features(self, text: str) -> list[float]:
        tokens = WORD.findall(text)
        n, chars = max(len(tokens), 1), max(len(text), 1)
        known, hits, you = self.known, [], []
        if len(known) > 200_000:
            known.clear()
        word_sum = stem_sum = word_best = stem_best = mixed = capital = 0.0
        for i, token in enumerate(tokens):
            odds = known.get(token)
            if odds is None:
                low = token.lower()
                a, b, m = self._odds(token)
                odds = (a, b, m, len(token) > 2 and token.isupper(), low in SECOND_PERSON)
                odds = odds if any(odds) else False
                known[token] = odds
            if odds:
                a, b, m, c, y = odds
                if a or b:
                    hits.append(i)
                    word_sum, stem_sum, word_best, stem_best = word_sum + a, stem_sum + b, max(word_best, a), max(stem_best, b)
                mixed, capital = mixed + m, capital + c
                if y:
                    you.append(i)
        close = 0.0
        if hits and you:
            at = np.searchsorted(you, hits)
            y = np.array(you)
            gap = np.minimum(np.abs(y[np.clip(at, 0, len(y) - 1)] - hits), np.abs(y[np.clip(at - 1, 0, len(y) - 1)] - hits))
            close = float((1 / (1 + gap)).max())
        upper = sum(map(str.isupper, text)) if not text.islower() else 0
        marks = len(text) - sum(map(text.count, " \n")) - sum(map(len, tokens))
        return [word_sum / n, stem_sum / n, word_best, stem_best, float(np.log1p(len(hits))), close, upper / chars, capital / n, text.count("!") / n,
                marks / chars, mixed / n, len(STRETCHED.findall(text)) / n, float(np.log1p(len(tokens)))]


STRETCHED = re.compile(r"(\w)\1{3}")


def with_features(docs: DataFrame, scorer_of: dict[int, tuple[dict, dict]], columns: list[str]) -> DataFrame:
    """``columns`` (of which ``text`` and ``lexicon``, the number of the lexicon to use) to the columns but ``text`` and the features."""
    left = [c for c in columns if c != "text"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorers = {k: Scorer(*v) for k, v in scorer_of.items()}
        for batch in batches:
            rows = [scorers[k].features(t) for k, t in zip(batch["lexicon"], batch["text"], strict=True)]
            values = pd.DataFrame(np.array(rows, dtype=np.float64).reshape(len(rows), len(FEATURES)), columns=FEATURES, index=batch.index)
            yield pd.concat([batch[left], values], axis=1)

    types = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in left)
    return docs.select(*columns).mapInPandas(run, f"{types}, {FEATURE_TYPE}")


def _lexicons(sample: DataFrame) -> dict[int, tuple[dict, dict]]:
    """From ``(fold, toxic, text)`` the lexicons learned without fold 0, without fold 1, and from all (number 2)."""
    words = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+"))
    terms = F.concat(F.transform(words, lambda w: F.struct(F.lit(0).alias("k"), w.alias("t"))), *[
        F.array_distinct(F.transform(F.filter(words, lambda w, n=n: F.length(w) > n), lambda w, n=n: F.struct(F.lit(n).alias("k"), F.left(w, F.lit(n)).alias("t")))) for n in STEMS])
    counts = (sample.select("fold", "toxic", F.explode(terms).alias("x")).where(F.length("x.t") > 1).groupBy("x.k", "x.t")
              .agg(*[F.sum(((F.col("fold") == f) & (F.col("toxic") == y)).cast("long")).alias(f"n{f}{y}") for f in (0, 1) for y in (0, 1)]))
    rows = {(r["fold"], r["toxic"]): r["count"] for r in sample.groupBy("fold", "toxic").count().collect()}
    out = {}
    for number, folds in ((0, (1,)), (1, (0,)), (2, (0, 1))):
        total = [max(sum(rows.get((f, y), 0) for f in folds), 1) for y in (0, 1)]
        clean, toxic = (sum((F.col(f"n{f}{y}") for f in folds[1:]), F.col(f"n{folds[0]}{y}")) for y in (0, 1))
        odds = F.log((toxic + 0.1) / total[1]) - F.log((clean + 0.5) / total[0])
        least = max(LEAST_ROWS, LEAST_SHARE * total[1])
        best = counts.select("k", "t", odds.alias("odds"), toxic.alias("rows")).where((F.col("rows") >= least) & (F.col("odds") >= LEAST_ODDS))
        best = best.orderBy((F.col("odds") * F.log1p("rows")).desc(), "k", "t").limit(MAX_ENTRIES).collect()
        out[number] = ({r["t"]: float(r["odds"]) for r in best if r["k"] == 0}, {r["t"]: float(r["odds"]) for r in best if r["k"]})
    return out


class ToxicityModel:
    """Lexicon, trees and calibration; ``score`` adds ``score`` and ``predicted``."""

    def __init__(self, lexicon: tuple[dict, dict], trees, calibration, share: float):
        self.lexicon, self.trees, self.calibration, self.share = lexicon, trees, calibration, share

    @staticmethod
    def assemble(rows: DataFrame) -> DataFrame:
        return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)

    def margin(self, rows: DataFrame) -> DataFrame:
        """Features to the trees' margin, as the input of the calibration."""
        out = self.trees.transform(self.assemble(rows))
        return out.withColumn("margin", vector_to_array("rawPrediction")[1])

    def score(self, docs: DataFrame, id_cols: list[str], text_col: str = "text", keep_text: bool = False) -> DataFrame:
        """``id_cols, score, predicted`` for each row of ``docs``, from the text alone. ``keep_text``: the text may be among them."""
        if self.trees is None:
            rows = docs.select(*id_cols, F.lit(float(self.share)).alias("score"))
        else:
            ids = [f"id{i}" for i in range(len(id_cols))]
            texts = docs.select(*[F.col(f"`{c}`").alias(i) for c, i in zip(id_cols, ids, strict=True)], text_of(text_col).alias("text"), F.lit(0).alias("lexicon"))
            rows = with_features(texts, {0: self.lexicon}, [*ids, "text", "lexicon"])
            rows = self.calibration.transform(self.margin(rows).drop("prediction", "probability", "rawPrediction", "features"))
            rows = rows.select(*[F.col(i).alias(c) for c, i in zip(id_cols, ids, strict=True)], F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score")).alias("score"))
        return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def labelled_sample(docs: DataFrame, labels: DataFrame, usable: Column, max_per_class: int = MAX_PER_CLASS) -> tuple[DataFrame, dict[int, int]]:
    """``(fold, part, toxic, weight, text)`` of at most ``max_per_class`` usable labelled rows per class, and the class sizes.

    The sample has a fixed greatest size, so its ids are broadcast and no text is shuffled to find it.
    """
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).where(usable)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    rank = F.xxhash64("doc_id", F.lit("toxicity"))
    picks = [hashed_sample(known.where(F.col("toxic") == y), rank, max_per_class, sizes.get(y, 0)) for y in (0, 1)]
    picked = picks[0].union(picks[1]).select(F.col("doc_id").alias("pick"), "toxic")
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("pick")).select(
        F.pmod(F.xxhash64(F.left(text_of("text"), F.lit(200))), F.lit(2)).cast("int").alias("fold"),
        F.pmod(F.xxhash64(F.lit("part"), "pick"), F.lit(4)).cast("int").alias("part"), "toxic",
        F.when(F.col("toxic") == 1, max(1.0, sizes.get(1, 0) / max_per_class)).otherwise(max(1.0, sizes.get(0, 0) / max_per_class)).alias("weight"), text_of("text").alias("text"))
    return rows, sizes


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None) -> ToxicityModel:
    """Learn from labelled rows for which ``usable`` (of ``doc_id``) holds: three quarters fit the trees, one quarter the calibration."""
    rows, sizes = labelled_sample(docs, labels, F.lit(True) if usable is None else usable)
    share = sizes.get(1, 0) / max(1, sum(sizes.values()))
    sample = stored(rows, "labelled")
    found = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}  # labels without a document teach nothing
    if len(found) < 2:
        return ToxicityModel(({}, {}), None, None, share)
    lexicons = _lexicons(sample)
    features = stored(with_features(sample.withColumn("lexicon", F.col("fold")), lexicons, ["fold", "part", "toxic", "weight", "text", "lexicon"]), "features").coalesce(2)
    few = found[0] < 40 or found[1] < 40
    model = ToxicityModel(lexicons[2], None, None, share)
    train = ToxicityModel.assemble(features if few else features.where("part > 0"))
    model.trees = GBTClassifier(labelCol="toxic", featuresCol="features", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, minInstancesPerNode=3, seed=7).fit(train)
    held = model.margin(features if few else features.where("part = 0")).select(F.col("toxic").cast("double").alias("label"), "margin", "weight")
    model.calibration = IsotonicRegression(labelCol="label", featuresCol="margin", weightCol="weight", predictionCol="score").fit(held)
    return model


def held_out(doc_id: Column) -> Column:
    """Rows whose CRC-32 of the id as text leaves remainder 1 by 3."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1

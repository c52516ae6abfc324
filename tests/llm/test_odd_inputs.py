"""Very long runs of blanks and columns whose names the operators use themselves."""

from pyspark.sql import functions as F
from tokenizers import Tokenizer

from briefloom.llm import packing, toxicity


def test_long_runs_encode_like_the_json_vocabulary():
    plain = Tokenizer.from_file(packing.tokenizer_path("byte_bpe_50k.json"))
    encoder = packing.Encoder(packing.tokenizer_path())
    for text in (" " * 2_000_000, "\n" * 300_000, "word" + " \t" * 200_000, "a" * 300_000, " x" * 100_000 + " " * 400_000, " " * 400_000 + "end <|endoftext|> "):
        assert encoder.encode(text).tolist() == plain.encode(text, add_special_tokens=False).ids


def test_long_blank_texts_are_packed(spark):
    docs = spark.createDataFrame([(1, " " * 1_000_000, "x"), (2, "a few words", "y"), (3, None, None)], "doc_id long, text string, sequence_id string")
    rows = packing.pack(docs).collect()
    plain = Tokenizer.from_file(packing.tokenizer_path("byte_bpe_50k.json"))
    sizes = {1: len(plain.encode(" " * 1_000_000, add_special_tokens=False).ids) + 1, 2: 4, 3: 1}
    got = {}
    for r in rows:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == sizes


def test_toxicity_with_clashing_columns(spark):
    words = "you vile rotten fool shut up now".split()
    rows = [(i, " ".join(words[(i + k) % 7] if i % 3 == 0 else f"calm{(i * k) % 50}" for k in range(30)), i, i, "x", 1.0, 0) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int, pick int, fold string, weight double, part int")
    labels = docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0).alias("toxic"), F.lit(1).alias("text"))
    plain = toxicity.fit(docs.select("doc_id", "text"), labels.select("doc_id", "toxic")).score(docs.select("doc_id", "text"), ["doc_id"])
    clash = toxicity.fit(docs, labels).score(docs, ["doc_id", "toxic", "pick", "fold", "weight", "part"])
    assert {r["doc_id"]: (round(r["score"], 6), r["predicted"]) for r in plain.collect()} == {
        r["doc_id"]: (round(r["score"], 6), r["predicted"]) for r in clash.collect()}
    assert all(r["toxic"] == r["pick"] == r["doc_id"] for r in clash.collect())
    assert plain.where("doc_id % 3 = 0").agg(F.avg("score")).first()[0] > plain.where("doc_id % 3 = 1").agg(F.avg("score")).first()[0]

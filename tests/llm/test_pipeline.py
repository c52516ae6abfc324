"""The pipeline's stages held against plain Python on whole tables, and on an empty table."""

import os
import re
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from briefloom.llm import mixing, toxicity
from briefloom.llm import shingles as sh
from briefloom.llm.common import stored

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage but the last was given and kept, as lists of rows, and the pieces of the last."""
    docs, out = spark.read.parquet(f"{SF_DIR}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, SF_DIR), "stage")
        if name != "packing":
            assert docs.columns == before.columns, name
        out[name] = before.collect(), docs.collect()
    return out


def ids(rows):
    return Counter(r["doc_id"] for r in rows)


def test_order_and_numbers():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "n-gram Jaccard join", "mixing sources", "packing"]


def test_toxic_documents_go(spark, stages):
    before, after = stages["toxicity"]
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{SF_DIR}/labels.parquet"), ~toxicity.held_out(F.col("doc_id")))
    gone = {r["doc_id"] for r in model.score(docs, ["doc_id"]).where("predicted = 1").collect()}
    assert ids(after) == Counter(r["doc_id"] for r in before if r["doc_id"] not in gone)
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    clean = {k for k, y in toxic.items() if y == 0}
    assert len(gone & clean) <= 0.02 * len(clean)


def test_one_of_equal_texts_stays(stages):
    before, after = stages["exact dedup"]
    largest = {}
    for r in before:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or "")
        largest[text] = max(largest.get(text, r["doc_id"]), r["doc_id"])
    assert ids(after) == Counter(largest.values())


def test_one_of_each_group_of_near_copies_stays(stages):
    before, after = stages["n-gram Jaccard join"]
    sets = {r["doc_id"]: sh.shingle_set(r["text"] or "").tobytes() for r in before}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    order = sorted(sets)
    for n, a in enumerate(order):
        for b in order[n + 1:]:
            if sh.jaccard(sets[a], sets[b]) >= sh.SIMILARITY:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert ids(after) == Counter(i for i in order if find(i) == i)


def test_mixture_takes_what_sql_takes(spark, stages):
    before, after = stages["mixing sources"]
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, taken = Counter(), Counter()
    for r in before:
        sizes[r["source"]] += size(r["text"])
    for r in after:
        taken[r["source"]] += size(r["text"])
    open_ = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(open_)}
    left, target = sum(sizes.values()), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * level > 3 * sizes[s]]
        for s in full or open_:
            target[s] = min(weight[s] * level, 3.0 * sizes[s])
        left -= sum(target[s] for s in full)
        open_ = [s for s in open_ if s not in target] if full else []
    assert all(abs(taken[s] - t) <= 1 for s, t in target.items())
    times, text = ids(after), {r["doc_id"]: r["text"] for r in before}
    assert max(times.values()) <= 3
    assert all(text[r["doc_id"]].startswith(r["text"]) for r in after)


def test_pieces_hold_every_token_once(stages):
    import public_tokenizers
    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    before, pieces = stages["packing"]
    want = Counter()
    lengths = Counter()
    for r in before:
        found = whole.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        want[r["doc_id"], len(found)] += len(found)
    for p in pieces:
        lengths[p["doc_id"], p["doc_tokens"]] += p["length"]
    assert lengths == want
    places = {}
    for p in pieces:
        places.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for parts in places.values():
        parts.sort()
        assert all(o == sum(n for _, n in parts[:i]) for i, (o, _) in enumerate(parts))
        total = parts[-1][0] + parts[-1][1]
        assert total <= 1024 and total & (total - 1) == 0
    assert sum(p["length"] for p in pieces) == sum(want.values())


def test_empty_table(spark, tmp_path):
    for name in ("documents", "labels"):
        rows = spark.read.parquet(f"{SF_DIR}/{name}.parquet")
        (rows.limit(0) if name == "documents" else rows).write.parquet(os.path.join(tmp_path, f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

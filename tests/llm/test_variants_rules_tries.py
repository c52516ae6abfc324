"""Spelling variants, quality rules and the conversation trie against brute force, at small bounds and on odd rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from briefloom.llm import prefix_trie, quality, spelling

DOCS = "doc_id long, text string, word string, n long, row string, kept string"


def one_edit(a, b):
    """Brute force: every edit of ``a``."""
    letters = set(b)
    cuts = [(a[:i], a[i:]) for i in range(len(a) + 1)]
    made = {x + y[1:] for x, y in cuts if y} | {x + c + y for x, y in cuts for c in letters} | {x + c + y[1:] for x, y in cuts if y for c in letters}
    return b in made - {a}


def test_single_edits():
    rng = random.Random(3)
    for _ in range(4000):
        a = "".join(rng.choice("abé") for _ in range(rng.randint(1, 7)))
        b = "".join(rng.choice("abé") for _ in range(rng.randint(1, 7)))
        assert spelling.is_one_apart(a, b) == one_edit(a, b), (a, b)


def brute_forms(counted):
    near = {a: [b for b in counted if a != b and abs(len(a) - len(b)) < 2 and one_edit(a, b)] for a in counted}
    form = {}
    for a, others in near.items():
        best = min(others, key=lambda b: (-counted[b], b), default=None)
        form[a] = best if best and counted[best] >= 5 * counted[a] else None
    out = {}
    for a in counted:
        root = a
        while form[root]:
            root = form[root]
        out[a] = (counted[a], len(near[a]), form[a], counted[form[a]] if form[a] else None, root)
    return out


@pytest.mark.parametrize("part_words", [7, 20_000])
def test_variants_against_brute_force(spark, monkeypatch, part_words):
    monkeypatch.setattr(spelling, "PART_WORDS", part_words)
    monkeypatch.setattr(spelling, "LOT_WORDS", 50)
    rng = random.Random(5)
    counted = {}
    for _ in range(60):
        word = "".join(rng.choice("abcdéÿ") for _ in range(rng.randint(6, 9)))
        counted[word] = n = 5 ** rng.randint(1, 4)
        for _ in range(5):  # chains of edits, rarer and rarer
            i = rng.randrange(len(word))
            word = rng.choice([word[:i] + word[i + 1:], word[:i] + "x" + word[i:], word[:i] + "y" + word[i + 1:]])
            n = max(5, n // rng.choice([1, 5, 6]))
            counted[word] = n
    giant = "".join(rng.choice("abc") for _ in range(3000))
    counted |= {giant: 100, giant[:1500] + giant[1501:]: 10, "z" * 41: 9, "z" * 40: 50, "z" * 42: 6}
    rows = spark.createDataFrame(list(counted.items()), "word string, n long")
    got = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in spelling.group_variants(rows).collect()}
    assert got == brute_forms(counted)
    assert any(v[4] != v[2] for v in got.values() if v[2])  # some chain is longer than one step


def test_words_of_texts(spark):
    text = "Straße ÉCOLE école écoles; under_scores x×y÷zabc " * 3
    rows = [(i, text, "clash", 1, "clash", "clash") for i in range(300)] + [(None, text, None, None, None, None), (None, text, None, None, None, None),
                                                                            (5, None, None, None, None, None), (6, "", None, None, None, None)]
    want = Counter()
    for doc_id, t, *_ in rows:
        for run in spelling_runs(t or ""):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 6:
                want[run] += 1
    got = {r["word"]: r["n"] for r in spelling.words(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {w: n for w, n in want.items() if n >= 5}
    none = spelling.words(spark.createDataFrame([], DOCS))
    assert spelling.group_variants(none).count() == 0


def spelling_runs(text):
    import re
    return [x.translate(str.maketrans(spelling.UPPER, spelling.LOWER)) for x in re.findall("[A-Za-zÀ-ÿ]+", text)]


def brute_base(text):
    import re
    words = re.findall("[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


PROSE = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80))
TEXTS = [None, "", " \n\t ", PROSE, PROSE + "\n" + PROSE, " a b\x85c " * 30, PROSE.upper(), PROSE.replace(" ", "### "), "12 34 56. " * 3 + " ".join(str(i) for i in range(60)),
         "the " * 30 + PROSE[:200], "\n".join(["same line here", "same line here\r", "", "same line here"] + PROSE.split(" ")[:60]), "long " * 3 + "é" * 200_000 + " " + PROSE * 40,
         "\U0001F600 İstanbul " * 40]


def test_base_counts_and_order_of_rules(spark):
    docs = spark.createDataFrame([(i % 11 if i else None, t, "clash", i, "clash", "clash") for i, t in enumerate(TEXTS)], DOCS)
    rules = quality.cascade(docs)
    assert sorted(r.name for r in rules) == sorted(r.name for r in quality.RULES)
    first = {r["n"]: r for r in quality.judge(docs, rules, ["doc_id", "row", "n"]).collect()}
    other = {r["n"]: r for r in quality.judge(docs, rules[::-1], ["n"], base=False).collect()}
    for i, text in enumerate(TEXTS):
        r = first[i]
        want = brute_base(text or "")
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r["kept"] == other[i]["kept"] == (not any(rule.rejects(quality.Measured(text)) for rule in quality.RULES))
        assert r["kept"] or r["failed_rule"]
        assert r["row"] == "clash" and r["doc_id"] == (i % 11 if i else None)
    assert first[3]["kept"] and not first[6]["kept"] and not first[7]["kept"]
    none = spark.createDataFrame([], DOCS)
    assert quality.judge(none, quality.cascade(none)).count() == 0


def test_cheap_rejecting_rules_come_first(spark):
    docs = spark.createDataFrame([(i, "x y z" if i % 2 else PROSE, None, i, None, None) for i in range(200)], DOCS)

    def slow(t):
        return sum(range(20_000)) > 0 and len(t.words) < 50
    rules = [quality.Rule("never", lambda t: False), quality.Rule("slow", slow), quality.Rule("fast", lambda t: len(t.words) < 50)]
    assert [r.name for r in quality.cascade(docs, rules)] == ["fast", "slow", "never"]
    runs = quality.judge(docs, quality.cascade(docs, rules), base=False).groupBy("rules_run").count().collect()
    assert {r["rules_run"]: r["count"] for r in runs} == {1: 100, 3: 100}


CONV = "conv_id long, turn long, role string, text string, depth long, shard long, d1 long, size string"


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = own.get(c - int(np.fmod(c, 100)), [])[:h] + turns[h:]
    nodes = defaultdict(list)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    children = Counter(p[:-1] for p in nodes if p)
    leaves, saved = Counter(), Counter()
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(members) - 1) * (len(p[-1][1]) if p else 0)
    out = []
    for p, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if len(made[c]) == len(p))))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def conversations():
    rng = random.Random(11)
    rows = []
    for c in list(range(-3, 130)) + [205, 317, 10**15 + 7]:
        for turn in range(rng.choice([1, 2, 3, 4, 7])):
            text = rng.choice(["hello", "yes", "no, thanks", ""]) * rng.randint(1, 2)
            rows.append((c, turn, rng.choice(["user", "assistant"]) if turn > 1 else "user", text, 1, 1, 1, "x"))
    alike = [(turn, "user", f"turn {turn}") for turn in range(40)]
    rows += [(c, *t, 1, 1, 1, "x") for c in (701, 702, 703) for t in alike]
    rows += [(704, *t, 1, 1, 1, "x") for t in alike[:30]] + [(705, None, None, None, 1, 1, 1, "x"), (705, None, None, None, 1, 1, 1, "x"), (705, 0, "a", "b", 1, 1, 1, "x"),
                                                              (None, 0, "user", "lost", 1, 1, 1, "x")]
    return rows


@pytest.mark.parametrize("subtree_turns", [3, 25, 50_000])
def test_trie_against_brute_force(spark, subtree_turns):
    rows = conversations()
    got = prefix_trie.trie(spark.createDataFrame(rows, CONV).repartition(5), subtree_turns, shard_nodes=40)
    assert sorted(tuple(r) for r in got.collect()) == brute_trie(rows)


def test_trie_without_conversations(spark):
    assert prefix_trie.trie(spark.createDataFrame([], CONV)).count() == 0
    assert prefix_trie.trie(spark.createDataFrame([(None, 1, "user", "x", 1, 1, 1, "x")], CONV)).count() == 0


def test_slots_are_minimal_and_verified():
    rng = np.random.default_rng(1)
    k = rng.integers(-2**63, 2**63 - 1, (2, 5000))
    table = prefix_trie.Slots(k[0], k[1])
    assert sorted(table.slot) == list(range(5000)) and (table.find(k[0], k[1]) == table.slot).all()
    assert (table.find(k[0], k[1] ^ 1) == -1).all()
    assert prefix_trie.Slots(k[0][:0], k[1][:0]).find(k[0], k[1]).max() == -1
    with pytest.raises(ValueError):
        prefix_trie.Slots(np.array([1, 1]), np.array([2, 2]))


def test_shared_digests_are_noticed(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie.F, "bit_xor", lambda c: F.max(F.lit(7)))
    rows, _ = prefix_trie.rebuilt(prefix_trie.turns(spark.createDataFrame(conversations(), CONV)))
    with pytest.raises(RuntimeError):
        prefix_trie.verified_prefixes(rows, tries=1)

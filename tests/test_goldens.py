"""Small inputs with expected values, and random inputs against SQL or every pair."""

import datetime
import math
import random
import re
import shutil

import duckdb
import pytest
from pyspark.sql import functions as F

from briefloom.functions import cleaning, columns, fixed, headings, segmenting
from briefloom.operators import clauses, entities, graph_rank, jobs, labels, mention_review, retrieval, risks, segments, summaries
from briefloom.plans import answers, briefing, placement
from briefloom.registry import segments as registry_segments
from briefloom.sources import tables
from briefloom.streaming import live


def one(spark, fn, value):
    return spark.createDataFrame([(value,)], "t string").select(fn(F.col("t")).alias("r")).first()["r"]


def mapped(spark, fn, values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, t string").select("i", fn(F.col("t")).alias("r"))
    return [r["r"] for r in sorted(df.collect())]


# --- cleaning
@pytest.mark.parametrize("value", [None, "", "  \n\t "])
def test_blank_text_cleans_to_empty(spark, value):
    assert one(spark, cleaning.clean_text, value) == ""


def test_cleaning_for_summary(spark):
    raw = "Page 3 of 9\nDigitally signed by X\nThe Lessee shall pay Rs.500\nmonthly , on time!!\nOn time\non  TIME\nagree-\nment"
    assert one(spark, lambda c: cleaning.clean_text(c, True), raw) == (
        "The Lessee shall pay Rs. 500 monthly, on time!\nOn time agreement")


def test_cleaning_for_data_drops_headings_and_identities(spark):
    raw = "SECTION HEADING\nRavi son of Mohan, pays 5, now.\nSection 4 Rent\n" + "x" * 90 + " Main Road, City, with a long address part here\nEnd."
    assert one(spark, cleaning.clean_text, raw) == "Ravi, pays now.\nEnd."


def test_line_rules_touch_only_their_lines(spark):
    assert one(spark, cleaning.drop_noise_lines, "page 1\na\n  \nelectronically signed x\nb\npage") == "a\n\nb\npage"
    assert one(spark, cleaning.drop_repeated_lines, "A  b\na B\n\na b\nc") == "A  b\n\na b\nc"
    assert one(spark, cleaning.merge_continuations, "\n\nA\nb\n\n\n\nC\nD\ne") == "A b\n\nC\nD e"
    assert one(spark, cleaning.tidy_punctuation, "a ,b?!c") == "a, b! c"


def test_word_count_and_brief(spark):
    assert mapped(spark, columns.word_count, ["a-b -- c_d é 5", "", "one"]) == [4, 0, 1]
    assert one(spark, cleaning.brief, "Key pattern observed: A b.  C d! E f.") == "A b. C d!"
    assert one(spark, lambda c: cleaning.brief(c, "none"), None) == "none"


def test_rounding_follows_the_binary_value(spark):
    values = [0.605, 0.125, 0.375, 0.6275, 0.5 + 0.8 * 0.15, 2.675, 1.005, 0.98, 0.29]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r["r"] for r in sorted(df.select("i", columns.round_like_ieee(F.col("v")).alias("r")).collect())]
    assert got == [round(v, 2) for v in values]


# --- segmentation
WORDS = ["the lessee", "shall pay", "must obtain", "rent", "and", "subject to", "however", "agrees to", "provided that", "a deposit",
         "of Rs. 500", "(a) item", "(b) other", "liable for", "damages", "notice", "in addition", "within 30 days", "the premises", "policy"]


def random_paragraphs(n, seed, length=60):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        text = ""
        for _ in range(rnd.randint(1, length)):
            text += rnd.choice(WORDS) + rnd.choice([" ", " ", " ", ", ", "; ", ". ", ", and ", ")\n", "\n", "! ", ". "])
        out.append(text.strip())
    return out


LONG_PART = "A first part of some ninety characters stands here, and it goes on and on until it ends here."


@pytest.mark.parametrize("paragraph, expected", [
    # under 80 characters: as it is
    ("Short one.", ["Short one."]),
    ("x" * 79, ["x" * 79]),
    # boundaries after a full stop or semicolon
    ("The lessee pays the rent on the first day of every month. The lessor keeps the roof and the outer walls in good order; the garden behind the house is shared by both of them.",
     ["The lessee pays the rent on the first day of every month.", "The lessor keeps the roof and the outer walls in good order;", "the garden behind the house is shared by both of them."]),
    # items inside a line
    ("The parties agree on these two items of work in the house: (a) the painter paints all of the rooms in white (b) the roofer mends every tile of the roof before winter",
     ["The parties agree on these two items of work in the house:", "(a) the painter paints all of the rooms in white", "(b) the roofer mends every tile of the roof before winter"]),
    # a second duty is cut off behind the nearest separator before it
    ("The tenant shall pay the rent on the first day of each month to the landlord by bank transfer, and the tenant shall insure the furniture against fire.",
     ["The tenant shall pay the rent on the first day of each month to the landlord by bank transfer, and", "the tenant shall insure the furniture against fire."]),
    # more than five sentences are cut at connectives, which stay with what stands before them
    ("Is it one? Is it two? Is it three? Is it four? Is it five however long it takes? Is it six?",
     ["Is it one? Is it two? Is it three? Is it four? Is it five however", "long it takes? Is it six?"]),
    # without connectives, into groups of five
    ("Go left now! Go right now! Go up now! Go down now! Go in now! Go out right now! Then stop and wait here!",
     ["Go left now! Go right now! Go up now! Go down now! Go in now!", "Go out right now! Then stop and wait here!"]),
    # fragments join while they stay under 80 characters together; what is left of up to 20 characters goes
    ("A first part of fifty or so characters is written here. Tiny bit. Another part of more than twenty characters follows it.",
     ["A first part of fifty or so characters is written here. Tiny bit.", "Another part of more than twenty characters follows it."]),
    (LONG_PART + " Tiny bit.", [LONG_PART]),
])
def test_atomic_clauses(spark, paragraph, expected):
    assert one(spark, segmenting.atomic_clauses, paragraph) == expected


def chunks_by_sql(texts, lo, hi, overlap):
    """The registered SQL of the packing rules, run over ``texts``."""
    con = duckdb.connect()
    con.execute("CREATE TABLE t (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(texts)))
    packed = registry_segments.d_tail(registry_segments.d_packed("t", lo, hi), lo, hi)
    rows = dict(con.execute(registry_segments.d_overlapped(packed, overlap) if overlap else packed).fetchall())
    return [rows[i] for i in range(len(texts))]


def test_chunks_equal_the_sql(spark):
    rnd = random.Random(3)
    texts = ["\n\n".join(" ".join(f"w{rnd.randint(0, 99)}" for _ in range(rnd.randint(0, 45))) for _ in range(rnd.randint(1, 12)))
             for _ in range(300)]
    got = mapped(spark, lambda c: segmenting.chunk_text(c, 24, 30, 5), texts)
    assert got == chunks_by_sql(texts, 24, 30, 5)


@pytest.mark.parametrize("sizes", [[1200], [1500], [1501], [1500, 1500, 1199], [3000, 20], [1400, 1199, 3], [700, 600, 300]])
def test_chunk_limits(spark, sizes):
    text = "\n\n".join(" ".join(["w"] * n) for n in sizes)
    assert one(spark, lambda c: segmenting.chunk_text(c, overlap=0), text) == chunks_by_sql([text], 1200, 1500, 0)[0]


def test_section_chunks_equal_the_sql(spark):
    rnd = random.Random(5)
    texts = []
    for _ in range(120):
        parts = []
        for i in range(rnd.randint(0, 6)):
            parts.append(f"Section {i + 1} Terms of part {i}\n" + " ".join(f"word{rnd.randint(0, 9)}" for _ in range(rnd.randint(12, 70))))
        texts.append("Opening line here\n" + "\n".join(parts))
    found = mapped(spark, headings.section_array, texts)
    con = duckdb.connect()
    con.execute("CREATE TABLE contract_text (doc_id BIGINT, text VARCHAR); CREATE TABLE section_texts (doc_id BIGINT, section_no BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO contract_text VALUES (?, ?)", list(enumerate(texts)))
    con.executemany("INSERT INTO section_texts VALUES (?, ?, ?)", [(d, n, f"{x['title']}\n{x['content']}") for d, ss in enumerate(found) for n, x in enumerate(ss)])
    want = dict(con.execute(registry_segments.d_by_sections(50)).fetchall())
    assert mapped(spark, lambda c: headings.section_chunks(c, 50), texts) == [want[i] for i in range(len(texts))]


def test_sections(spark):
    text = ("Intro line\n# Definitions\n" + "d" * 60 + "\n# Witness\n" + "e" * 10 + "\n**Payment of Rent**\nshort\n1. Term and Renewal\n" + "t" * 55
            + "\nNotice.\nGOVERNING LAW\n" + "g" * 50)
    rows = one(spark, headings.section_array, text)
    assert [r["title"] for r in rows] == ["Definitions", "1. Term and Renewal", "GOVERNING LAW"]
    assert rows[0]["content"] == "d" * 60 + "\n" + "e" * 10


def test_heading_keys(spark):
    assert mapped(spark, headings.heading_key, ["**Section 4.1: Rent**", "a) Scope", "IV. Term", "  "]) == ["rent", "scope", "term", ""]
    assert mapped(spark, headings.heading_slug, ["1. Fees, Charges", "***"]) == ["fees_charges", "section"]


def test_headed_text_orders_and_keeps_the_last_part(spark):
    text = "lead\n## Decision\nfirst\n## Facts\nf\n## Decision\nsecond"
    df = spark.createDataFrame([(1, "court_judgment", text)], "doc_id int, kind string, text string")
    rows = segments.parse_headed_text(df, "kind").orderBy("part_no").collect()
    assert [(r["key"], r["content"]) for r in rows] == [("facts", "f"), ("decision", "second"), ("executive_summary", "lead")]


def test_selected_sections_fall_back_to_the_text(spark):
    text = "Section 1 Rent Payment\n" + "r" * 60 + "\nSection 2 Notice Period\n" + "n" * 60
    assert one(spark, lambda c: headings.selected_text(c, ["Notice"]), text) == "Section 2 Notice Period\n" + "n" * 60
    assert one(spark, lambda c: headings.selected_text(c, ["Arbitration"]), text) == text


# --- clauses
def clause_df(spark, texts):
    return spark.createDataFrame([(1, i, 0, t, t) for i, t in enumerate(texts)], "doc_id long, para_no int, pos int, clause string, full_text string")


def test_scores_prefer_the_first_type_on_ties(spark):
    rows = clauses.score_types(clause_df(spark, ["rental insured", "insured tax", "deposit paymentless advance", "nothing here", "must"])).orderBy("para_no").collect()
    assert [(r["clause_type"], r["confidence"]) for r in rows] == [
        ("rent", 0.63), ("insurance", round(0.5 + 0.7 * 0.15, 2)), ("deposit", 0.74), ("obligation", 0.5), ("obligation", 0.56)]


def test_scores_equal_plain_counting(spark):
    import re
    texts = [t.replace("\n", " ") for t in random_paragraphs(150, 11, 30)] + ["indemnify confidentially approved sublet sub-let is required to non-disclosure"]
    rows = clauses.score_types(clause_df(spark, texts)).orderBy("para_no").collect()
    for text, row in zip(texts, rows):
        best, name = 0.0, "obligation"
        for kind, weight, _, patterns in fixed.CLAUSE_TYPES:
            s = 0.0
            for p in patterns:
                s += len(re.findall(p, text.lower())) * weight
            if s > best:
                best, name = s, kind
        assert (row["clause_type"], row["confidence"]) == (name, round(min(0.98, 0.5 + best * 0.15), 2)), text


def test_responsible_party(spark):
    texts = ["The lessee\nof the house shall pay", "The lessee shall pay", "The lessor and the lessee must agree", "Ravi Kumar pays",
             "the bank and the lender", "the insurer of the bank", "nobody"]
    parties = spark.createDataFrame([(1, {"buyer": "Ravi Kumar"})], "doc_id long, parties map<string,string>")
    rows = clauses.responsible_party(clause_df(spark, texts), parties).orderBy("para_no").collect()
    assert [r["responsible_party"] for r in rows] == ["Lessee", "Lessee", "Both", "Buyer", "Unknown", "Insurer", "Unknown"]


def test_groups_and_supplements(spark):
    docs = spark.createDataFrame([(1, "The tenant shall keep quiet and must be kind to all people here.\n\nThe policy premium of 5% is due; damages follow a breach within 30 days.")],
                                 "doc_id long, text string")
    ranked = briefing.ranked_clauses(docs)
    groups = {r["category"]: r for r in clauses.insight_groups(ranked).collect()}
    assert "protections" not in groups and "risks" in groups
    extra = clauses.supplement_groups(ranked).collect()
    assert [r["category"] for r in extra] == ["protections"]
    assert {r["category"] for r in clauses.briefing(ranked).collect()} == {*groups, "protections"}


def test_only_obligations_still_give_a_group(spark):
    docs = spark.createDataFrame([(1, "The tenant shall keep quiet and must be kind to all people here.")], "doc_id long, text string")
    assert [r["category"] for r in briefing.briefing(docs).collect()] == ["protections"]


def test_dedup_keeps_the_first(spark):
    df = clause_df(spark, ["Rent  is due", "rent is DUE", "Tax is due"]).withColumn("clause_type", F.lit("rent"))
    assert [r["para_no"] for r in clauses.dedup_clauses(df).orderBy("para_no").collect()] == [0, 2]


# --- entities
TEXT = "This deed binds the Lessor Rajesh Kumar. Rent of Rs. 5,000 is due on 1st day of March, 2024. Justice Asha Rao held in Case No. 12/2020 for 30 days."


def ents(spark):
    docs = spark.createDataFrame([(1, TEXT)], "doc_id long, text string")
    found = [("PERSON", "the Lessor Rajesh Kumar"), ("MONEY", "Rs. 5,000"), ("DATE", "1st day of March, 2024"), ("DATE", "30 days"), ("ORG", "deed"), ("ORG", "Case")]
    rows = [(1, label, t, TEXT.index(t), TEXT.index(t) + len(t)) for label, t in found]
    return docs, spark.createDataFrame(rows, "doc_id long, label string, text string, start_char long, end_char long")


def test_entities(spark):
    docs, mentions = ents(spark)
    rows = {(r["bucket"], r["text"]): r for r in entities.all_entities(mentions, docs).collect()}
    party = rows[("parties", "Lessor Rajesh Kumar")]  # "the " comes after "lessor " in the prefix list
    assert (party["role"], party["confidence"]) == ("Lessor", 0.93)
    money = rows[("money", ".5000")]
    assert (money["money_type"], money["context"]) == ("rent", "Rent of Rs. 5,000 is due on 1st day of March, 2024")
    assert ("dates", "1 March 2024") in rows and ("dates", "30 days") not in rows
    assert rows[("durations", "30 days")]["start_char"] == TEXT.index("30 days")
    assert ("judges", "Justice Asha Rao held in Case No") in rows
    assert ("case_identifiers", "Case No. 12/2020") in rows


def test_spans_match_their_text(spark):
    docs, _ = ents(spark)
    for r in entities.pattern_entities(docs).collect():
        assert TEXT[r["start_char"]:r["end_char"]].rstrip(":;,").endswith(r["text"])


def test_fallback_mentions_are_not_repeated(spark):
    docs = spark.createDataFrame([(1, "Pay Rs. 500 and rs. 500 and USD 70 on 12/05/2024 or 5 May 2024."), (2, "nothing")], "doc_id long, text string")
    mentions = spark.createDataFrame([(1, "MONEY", "Rs. 500", 4, 11), (1, "DATE", "5 May 2024", 0, 1)], "doc_id long, label string, text string, start_char long, end_char long")
    rows = mention_review.fallback_mentions(mentions, docs).collect()
    assert sorted((r["label"], r["text"]) for r in rows) == [("DATE", "12/05/2024"), ("MONEY", "usd 70")]


def test_places_merge_once_in_order(spark):
    docs = spark.createDataFrame([(1, "In Pune, India and Delhi. Goa")], "doc_id long, text string")
    mentions = spark.createDataFrame([(1, "GPE", t, i) for i, t in enumerate(["Pune", "India", "Delhi", "Goa"])], "doc_id long, label string, text string, start_char long")
    assert [r["place"] for r in mention_review.merge_places(mentions, docs).collect()] == ["Pune, India", "Delhi", "Goa"]


def test_places_are_literal_and_of_any_script(spark):
    docs = spark.createDataFrame([(1, "À Évry,\u00a0île d'yeu; in A\\Eb, C+ and ÉVRY")], "doc_id long, text string")
    mentions = spark.createDataFrame([(1, "GPE", t, i) for i, t in enumerate(["évry", "Île d'Yeu", "A\\Eb", "C+"])], "doc_id long, label string, text string, start_char long")
    assert [r["place"] for r in mention_review.merge_places(mentions, docs).collect()] == ["évry, Île d'Yeu", "A\\Eb, C+"]


def test_second_pass_references(spark):
    docs = spark.createDataFrame([(1, "Under Section 12A of Código and the Indian Contract Act, 1872 Justice Asha Rao heard case no. 12/3 on Policy No: é9. Justice Asha Rao left")], "doc_id long, text string")
    laws = spark.createDataFrame([(1, "LAW", "GDPR"), (1, "ORG", "Acme")], "doc_id long, label string, text string")
    rows = mention_review.review_references(laws, docs).collect()
    assert sorted((r["bucket"], r["text"]) for r in rows) == [
        ("case_identifiers", "case no. 12/3"), ("judges", "Justice Asha Rao"), ("legal_references", "GDPR"),
        ("legal_references", "Indian Contract Act, 1872"), ("legal_references", "Section 12A of Código"), ("policy_identifiers", "Policy No: é9")]


# --- retrieval
def test_role_priority_and_aliases(spark):
    es = spark.createDataFrame([(1, "parties", "Asha", 5, "model", "Asha (Lessee)"), (1, "locations", "Pune", 9, "model", "Pune"),
                                (1, "parties", "Reserve Bank of India", 20, "model", "Reserve Bank of India")],
                               "doc_id long, bucket string, text string, start_char long, source string, display string")
    ps = spark.createDataFrame([(1, "lessee", "Asha")], "doc_id long, role string, name string")
    terms = spark.createDataFrame([(1, 1, "Tenant"), (2, 1, "pune"), (3, 1, "RBI"), (4, 1, "pun"), (5, 1, "(lessee"), (6, 1, "zz")], "query_id long, doc_id long, term string")
    rows = {r["query_id"]: (r["text"], r["match_type"]) for r in retrieval.resolve_entity(terms, es, ps).collect()}
    assert rows == {1: ("Asha", "role"), 2: ("Pune", "exact"), 3: ("Reserve Bank of India", "alias"), 4: ("Pune", "partial"), 5: ("Asha (Lessee)", "simple")}


def test_keyword_search_without_hits_is_empty_and_confidence_zero(spark):
    q = spark.createDataFrame([(1, 1, "zzzz?"), (2, 1, "deposit refund deposit")], "query_id long, doc_id long, question string")
    c = spark.createDataFrame([(1, 1, "Refund of the deposit", "deposit", "Lessor", "Critical"), (1, 2, "Deposit only", "deposit", "Lessor", "Standard")],
                              "doc_id long, rank int, text string, clause_type string, party string, importance_label string")
    s = retrieval.keyword_topk(q, c)
    assert [(r["query_id"], r["rank"], r["text"], r["score"]) for r in s.orderBy("rank").collect()] == [(2, 1, "Refund of the deposit", 0.3), (2, 2, "Deposit only", 0.15)]
    conf = {r["query_id"]: r["confidence"] for r in retrieval.answer_confidence(s, q).collect()}
    assert conf == {1: 0.0, 2: round(0.225 + 0.08 + 0.05, 2)}


def test_empty_risk_text_touches_every_source(spark):
    s = spark.createDataFrame([(1, 1, "A source over ten characters"), (2, 1, "tiny")], "query_id long, doc_id long, text string")
    r = spark.createDataFrame([(1, 0, "", "high"), (1, 1, "over ten", "medium"), (1, 2, "over ten", "low"), (1, 3, "else", "high")], "doc_id long, seq int, clause_text string, severity string")
    assert sorted((x["query_id"], x["seq"]) for x in retrieval.related_risks(s, r).collect()) == [(1, 0), (1, 1)]


def test_salted_join_is_an_ordinary_join(spark):
    rows = spark.range(5000).select(F.col("id").alias("n"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k"))
    held = spark.range(0, 40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    plain = rows.join(held, "k")
    salted = placement.salted_join(rows, held, "k", salts=8, hot_rows=100)
    assert sorted(map(tuple, salted.select("k", "n", "v").collect())) == sorted(map(tuple, plain.select("k", "n", "v").collect()))


# --- risks
def test_fenced_and_broken_answers(spark):
    raws = ["```json\n[{\"title\":\"A\",\"severity\":\"LOW\"},{\"title\":\"\"},{\"title\":\"B\"}]\n```", "{\"a\":1}", "[1]", "oops", "[]"]
    df = spark.createDataFrame(list(enumerate(raws)), "doc_id int, raw string")
    parsed = risks.parse_responses(df)
    assert [r["failure"] for r in parsed.orderBy("doc_id").collect()] == [
        None, "Invalid LLM JSON output - expected array", "item is not an object", "Invalid LLM JSON output", None]
    rows = risks.risk_rows(parsed).orderBy("seq").collect()
    assert [(r["clause_id"], r["title"], r["severity"]) for r in rows] == [("llm-risk-0", "A", "low"), ("llm-risk-2", "B", "medium")]
    full = risks.report_with_failures(risks.risk_report(risks.risk_rows(parsed)), parsed).orderBy("doc_id").collect()
    assert [(r["status"], r["risk_score"], r["risk_level"]) for r in full] == [
        ("success", 86, "Medium"), ("failed", 100, "Low"), ("failed", 100, "Low"), ("failed", 100, "Low"), ("success", 100, "Low")]


def test_reports_are_not_broadcast(spark):
    from briefloom import registry
    registry.load_all()
    reported = registry.QUERIES["failed_reports_j4"](spark, "/root/testdata/sf0.001")
    assert "BroadcastHashJoin" not in _plan(reported) and "SortMergeJoin" in _plan(reported)
    payload = spark.createDataFrame([(1, '[{}, {"title": "A"}, null, 7, "x", [1]]')], "doc_id int, r string")
    assert [(r["seq"], r["title"]) for r in risks.flatten_risk_payload(payload, "r").collect()] == [(0, None), (1, "A")]


def test_report_caps_six_high_risks(spark):
    df = spark.createDataFrame([(1, i, "high") for i in range(6)] + [(2, 0, "low")], "doc_id int, seq int, severity string")
    rows = {r["doc_id"]: r for r in risks.risk_report(df).collect()}
    assert (rows[1]["detected_patterns"], rows[1]["published_risks"], rows[1]["risk_score"], rows[1]["risk_level"]) == (6, 5, 10, "High")
    assert rows[2]["risk_level"] == "Low" and risks.kept_risks(df).filter("doc_id = 1").count() == 5


def test_same_signature_counts_once_across_documents(spark):
    docs = spark.createDataFrame([(1, "analyzed"), (2, " Completed"), (3, "failed")], "doc_id int, processing_status string")
    df = spark.createDataFrame([(1, 0, "Late fee", "x", "Risk", "One two", "high"), (2, 0, "late  FEE!", "x", "risk", "one, two", "low"), (3, 0, "Other", "x", "y", "z", "high"),
                                (2, 1, "", "", "", "", "low")], "doc_id int, seq int, title string, risk_type string, category string, explanation string, severity string")
    assert risks.risk_summary(docs, df).first().asDict() == {"total_risks": 1, "high_risk_count": 1, "medium_risk_count": 0, "low_risk_count": 0}


def test_entities_in_one_pass_equal_the_single_steps(spark):
    text = ("The Lessor Rajesh Kumar shall pay Rs. 500 as rent. Damages? Rajesh Kumar must indemnify First Bank for any liability! A penalty of Rs. 900; "
            "Justice Ravi Kumar held so in Case No. 7/2024 within 30 days. First Bank is liable for breach")
    spots = [("PERSON", "Rajesh Kumar"), ("ORG", "First Bank"), ("MONEY", "Rs. 500"), ("MONEY", "Rs. 900"), ("PERSON", "Ravi Kumar"), ("GPE", "x"), ("DATE", "30 days")]
    rows = [(doc, label, m, text.index(m) if m in text else 0, (text.index(m) if m in text else 0) + len(m)) for doc in (1, 2) for label, m in spots]
    rows += [(1, "ORG", "first bank", text.rindex("First"), text.rindex("First") + 10), (1, "PERSON", "Lessor Rajesh Kumar", 4, 23), (9, "PERSON", "Nobody Known", 0, 12)]
    mentions = spark.createDataFrame(rows, "doc_id long, label string, text string, start_char long, end_char long")
    docs = spark.createDataFrame([(1, text), (2, text + "."), (3, "Policy No. 55 of Justice Asha Rao"), (4, ""), (5, None)], "doc_id long, text string")
    single = entities.dedup_entities(entities.model_entities(mentions, docs).unionByName(entities.pattern_entities(docs)))
    once = entities.all_entities(mentions, docs)
    assert once.columns == single.columns
    key = lambda rows: sorted(str(tuple(r)) for r in rows)
    assert key(once.collect()) == key(single.collect()) and once.count() > 12
    by_step = entities.obligation_relations(single, docs).unionByName(entities.purpose_relations(single)).unionByName(entities.risk_relations(single, docs))
    assert key(entities.all_relations(mentions, docs).select(*by_step.columns).collect()) == key(by_step.collect()) and by_step.count() >= 5


def test_questions_of_every_kind_in_one_plan(spark):
    text = "The Lessee Asha Rao pays on time. " + "Nothing else is said. " * 5 + "Reserve Bank of India in Pune."
    docs = spark.createDataFrame([(d, text) for d in range(1, 9)], "doc_id long, text string")
    spots = [("PERSON", "Asha Rao"), ("ORG", "Reserve Bank of India"), ("GPE", "Pune")]
    mentions = spark.createDataFrame([(d, label, m, text.index(m), text.index(m) + len(m)) for d in range(1, 9) for label, m in spots],
                                     "doc_id long, label string, text string, start_char long, end_char long")
    asks = [(1, 1, "hello"), (2, 2, "What can you do?"), (3, 3, "List all parties"), (4, 4, "Who is the tenant?"), (5, 5, "what is Pune"), (6, 5, "Who is Asha?"), (7, 5, "what is RBI"),
            (8, 5, "who is rao (lessee"), (9, 6, "what is BDA"), (10, 7, "When is the deposit refunded?"), (11, 7, "zzzz?"), (12, 99, "When is the deposit due?")]
    questions = spark.createDataFrame(asks, "query_id long, doc_id long, question string")
    stored = spark.createDataFrame([(d, 1, "The deposit is refunded in time", "deposit", "Lessor", "Critical") for d in range(1, 9)],
                                   "doc_id long, rank int, text string, clause_type string, party string, importance_label string")
    risks_ = spark.createDataFrame([(7, 0, "The deposit is refunded in time", "high", "money", "Late."), (1, 0, "", "high", "x", "y")],
                                   "doc_id long, seq int, clause_text string, severity string, risk_type string, explanation string")
    wanted = []

    def clauses_of(ids):
        wanted.extend(r["doc_id"] for r in ids.collect())
        return stored.join(ids, "doc_id", "left_semi")
    rows = {r["query_id"]: r for r in answers.answer_questions(questions, docs, mentions, risks_, clauses_of).collect()}
    assert sorted(rows) == list(range(1, 13)) and sorted(wanted) == [6, 7, 99]
    assert {q: (r["route"], r["answer"], r["match_type"]) for q, r in rows.items() if r["route"] in ("lookup", "canned")} == {
        1: ("canned", None, None), 2: ("canned", None, None), 4: ("lookup", "Asha Rao", "role"), 5: ("lookup", "Pune", "exact"), 6: ("lookup", "Asha Rao", "partial"),
        7: ("lookup", "Reserve Bank of India", "alias"), 8: ("lookup", "Asha Rao (Lessee)", "simple")}
    assert rows[3]["route"] == "entities" and "Asha Rao (Lessee)" in rows[3]["answer"] and "Pune" in rows[3]["answer"]
    assert rows[10]["context"].endswith("KNOWN RISKS IN THIS CONTEXT:\n- MONEY RISK (high): Late.\n") and rows[10]["confidence"] == 0.24 and rows[10]["n_sources"] == 1
    assert all((rows[q]["route"], rows[q]["context"], rows[q]["confidence"], rows[q]["n_sources"]) == ("retrieval", None, 0.0, 0) for q in (9, 11, 12))


def test_party_known_only_by_name(spark):
    rows = [(1, 0, "Rajesh Kumar keeps the roof dry."), (1, 1, "The roof is kept dry."), (2, 0, "Rajesh Kumar keeps the roof dry."), (1, 2, "Rajesh Kumar and Asha Rao keep the roof dry."),
            (1, 3, "The Lessee shall pay Rajesh Kumar.")]
    parties = entities.parties_column(spark.createDataFrame([(1, "lessor", "Rajesh Kumar"), (1, "lessee", "Asha Rao")], "doc_id long, role string, name string"))
    got = clauses.responsible_party(spark.createDataFrame(rows, "doc_id long, pos int, clause string"), parties)
    assert {(r["doc_id"], r["pos"]): r["responsible_party"] for r in got.collect()} == {
        (1, 0): "Lessor", (1, 1): "Unknown", (2, 0): "Unknown", (1, 2): "Both", (1, 3): "Lessee"}


# --- vectors
def test_vector_blocks_against_every_pair(spark):
    import numpy as np
    rng = np.random.default_rng(4)
    rows = [(f"{doc}_clause_{i}", doc, rng.integers(-3, 4, 6).astype(float).tolist(), f"text {i % 40}") for doc, n in ((1, 120), (2, 3)) for i in range(n)]
    rows += [("short", 1, [1.0, 2.0], "short"), ("null", 1, None, "null"), (None, 1, [1.0] * 6, "no id"), ("zero", 2, [0.0] * 6, "zero")]
    asked = [(q, 1 if q < 90 else 2 if q < 95 else 3, rng.integers(-3, 4, 6).astype(float).tolist()) for q in range(100)] + [(200, 1, [3.0, 1.0]), (201, 1, None), (202, None, [1.0] * 6)]
    unit = lambda e: np.array(e) / max(np.linalg.norm(e), 1e-300)
    want = []
    for q, doc, e in asked:
        near = sorted((-round(float(unit(e) @ unit(x)), 12), i, t) for i, d, x, t in rows if e and x and i and d == doc and len(x) == len(e))[:5]
        seen = []
        for s, i, t in near:
            if t not in seen:
                seen.append(t)
                want.append((q, len(seen), t, round(-s, 4)))
    vectors = spark.createDataFrame(rows, "vec_id string, doc_id long, embedding array<double>, text string")
    queries = spark.createDataFrame(asked, "query_id long, doc_id long, embedding array<double>")
    for block_rows in (4, 1000):
        got = retrieval.vector_topk(queries, vectors, block_rows=block_rows).select("query_id", "rank", "text", "score").collect()
        assert sorted((r[0], r[1], r[2], r[3] + 0.0) for r in got) == sorted((q, n, t, s + 0.0) for q, n, t, s in want)
    assert retrieval.vector_topk(queries.limit(0), vectors).count() == 0


def test_stored_vector_rows_are_searched(spark):
    clauses_ = spark.createDataFrame([(1, r, "payment", "Lessee", f"clause {r}", "Critical" if r == 2 else "Standard") for r in range(1, 12)] + [(2, 1, "notice", "", "other", "Standard")],
                                     "doc_id long, rank int, clause_type string, responsible_party string, full_text string, importance_label string")
    vecs = spark.createDataFrame([(1, n, [float(n), 1.0]) for n in range(11)] + [(2, 0, [1.0, 1.0])], "doc_id long, clause_no int, embedding array<double>")
    stored = retrieval.vector_rows(clauses_, vecs)
    found = retrieval.vector_topk(spark.createDataFrame([(7, 1, [1.0, 1.0])], "query_id long, doc_id long, embedding array<double>"), stored, k=3).collect()
    assert [(r["rank"], r["text"], r["importance_label"]) for r in sorted(found, key=lambda r: r["rank"])] == [
        (1, "clause 2", "Critical"), (2, "clause 3", "Standard"), (3, "clause 4", "Standard")]


def test_related_risks_against_every_pair(spark):
    rnd = random.Random(9)
    words = ["rent", "the", "Lessee", "pays", "late", "fee", "of", "Rs.", "5,"]
    base = " ".join(rnd.choice(words) for _ in range(60))
    cut = lambda: base[(a := rnd.randrange(300)):a + rnd.choice([3, 12, 20, 60, 200])]
    sources = [(q, q % 2, cut()) for q in range(60)] + [(7, 1, base), (8, None, base), (9, 1, "late fee of"), (9, 1, None)]
    risks_ = [(doc, n, cut(), rnd.choice(["high", "medium", "low"])) for doc in (0, 1) for n in range(40)]
    risks_ += [(1, 90, "", "high"), (1, 91, None, "high"), (0, 92, base, "medium"), (1, 93, "fee", "high"), (1, 94, "rent\n the", "high")]
    want = {(q, doc, n) for q, doc, s in sources if s and len(s) > 10 for d, n, t, sev in risks_ if d == doc and t is not None and sev != "low" and (t in s or s in t)}
    got = retrieval.related_risks(spark.createDataFrame(sources, "query_id long, doc_id long, text string"),
                                  spark.createDataFrame(risks_, "doc_id long, seq int, clause_text string, severity string"))
    got = [(r["query_id"], r["doc_id"], r["seq"]) for r in got.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


# --- summaries
def test_extractive_summary_keeps_text_order(spark):
    text = "Hello there. The rent shall be Rs. 5. Hello there. Must pay 5 under Section 3. Nice day."
    df = spark.createDataFrame([(1, text), (2, "")], "doc_id int, text string")
    rows = {r["doc_id"]: r["extractive_summary"] for r in summaries.extractive_summary(df, 2).collect()}
    assert rows == {1: "- The rent shall be Rs.\n- Must pay 5 under Section 3.", 2: ""}


def ranked_pair_by_pair(sentences, rounds=20):
    """Scores by the stated formula, every pair compared."""
    words = [set(re.findall(r"\w+", s.lower())) for s in sentences]
    n = len(words)
    w = [[0.0] * n for _ in range(n)]
    for i in range(n):
        for j in range(n):
            scale = math.log(max(1, len(words[i]))) + math.log(max(1, len(words[j])))
            if i != j and scale > 0:
                w[i][j] = len(words[i] & words[j]) / scale
    score = [1 / n] * n
    for _ in range(rounds):
        out = [score[j] / sum(w[j]) if sum(w[j]) else 0.0 for j in range(n)]
        score = [0.15 / n + 0.85 * sum(w[j][i] * out[j] for j in range(n)) for i in range(n)]
    return score


def test_graph_ranking_against_every_pair(spark):
    rnd = random.Random(1)
    texts = {7: [" ".join(f"w{min(rnd.randint(0, 40), rnd.randint(0, 40))}" for _ in range(rnd.randint(1, 9))) for _ in range(60)],
             8: ["one", "one", "one two", "two", "", "three four", "One two"], 9: ["same same words"] * 5 + ["alone"]}
    rows = [(u, i, len(xs), x) for u, xs in texts.items() for i, x in enumerate(xs)]
    got = {(r["uid"], r["i"]): r["score"] for r in graph_rank.rank_sentences(spark.createDataFrame(rows, "uid long, i int, n int, sentence string")).collect()}
    want = {(u, i): v for u, xs in texts.items() for i, v in enumerate(ranked_pair_by_pair(xs))}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_small_texts_are_ranked_like_large_ones(spark, monkeypatch):
    rnd = random.Random(4)
    texts = [" ".join(" ".join(f"W{min(rnd.randint(0, 30), rnd.randint(0, 30))}" for _ in range(rnd.randint(1, 9))) + "." for _ in range(rnd.randint(0, 40))) for _ in range(40)]
    texts += [None, "", "...", "Same. Same. Same. Same. Same.", "A b. B c. C d. Q. É é b. ! ? ."]
    df = spark.createDataFrame(list(enumerate(texts)), "uid long, text string")
    small = graph_rank.summarize(df, 3)
    assert "MapInArrow" in _plan(small)
    small = {r["uid"]: r["summary"] for r in small.collect()}
    monkeypatch.setattr(graph_rank, "SMALL_SENTENCES", 0)
    assert small == {r["uid"]: r["summary"] for r in graph_rank.summarize(df, 3).collect()} and len(small) == len(texts)
    cut = [re.split(r"(?<=[.!?])\s+", t) for t in texts[:40]]
    for uid, xs in enumerate(cut):
        score = ranked_pair_by_pair(xs) if texts[uid] else [1]
        best = sorted(sorted(range(len(xs)), key=lambda i: (-round(score[i], 12), i))[:3])
        assert small[uid] == (" ".join(xs[i] for i in best) if len(xs) > 3 else texts[uid])


def test_graph_summary_keeps_every_row(spark):
    text = "A b c. B c d. C d e. X y. D e f. Q. A b c d e f."
    df = spark.createDataFrame([(1, text, "u"), (1, text, "u"), (None, text, "v"), (2, None, None), (3, " ", None), (4, "One. Two.", None)], "doc_id int, text string, uid string")
    rows = summaries.graph_rank_summary(df, 3).collect()
    assert len(rows) == 6 and {r["uid"] for r in rows} == {"u", "v", None}
    by_id = {r["doc_id"]: r["graph_summary"] for r in rows}
    assert by_id[2] == by_id[3] == "" and by_id[4] == "One. Two." and len({r["graph_summary"] for r in rows if r["text"] == text}) == 1
    assert by_id[1].endswith("A b c d e f.") and summaries.graph_rank_summary(df.limit(0), 3).count() == 0


def test_blank_chunks_are_skipped_and_numbered_anew(spark):
    rows = [(1, 0, " "), (1, 1, "First part."), (1, 2, None), (1, 3, "\n"), (1, 4, "Second part."), (2, 0, " "), (None, 0, "No id."), (None, 1, "Still none.")]
    out = summaries.reduce_summaries(spark.createDataFrame(rows, "doc_id int, chunk_index int, chunk_text string")).collect()
    assert {r["doc_id"]: r["summary"] for r in out} == {1: "First part. Second part.", None: "No id. Still none."}


def test_reduce_summaries_ends_with_one_per_document(spark):
    rows = [(d, i, " ".join(f"Word{d} a{i} b{j}." for j in range(5))) for d, n in ((1, 1), (2, 7), (3, 40)) for i in range(n)]
    out = summaries.reduce_summaries(spark.createDataFrame(rows, "doc_id int, chunk_index int, chunk_text string")).collect()
    assert sorted(r["doc_id"] for r in out) == [1, 2, 3]
    assert all(len(segment.split(".")) <= 5 for segment in [r["summary"] for r in out])


# --- tables and streams
def test_storage_names(spark):
    assert mapped(spark, tables.safe_name, [" a/b\\c d__é.pdf ", "x" * 200]) == ["a_b_c_d_.pdf", "x" * 180]


def test_replacing_and_deleting(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "doc_id int, v string")
    new = spark.createDataFrame([(2, "x"), (2, "y")], "doc_id int, v string")
    assert sorted(map(tuple, tables.replace_by_key(t, new).collect())) == [(1, "a"), (2, "x"), (2, "y"), (3, "c")]
    assert tables.replace_by_key(t, new.filter("false")).count() == 3
    ids = spark.createDataFrame([("1",), (None,), (" ",)], "gone string")
    assert tables.delete_by_ids(t, ids, "doc_id", "gone").count() == 2


def test_files_replace_only_their_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_replacing(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id int, v string"), path, "doc_id")
    tables.write_replacing(spark.createDataFrame([(2, "c")], "doc_id int, v string"), path, "doc_id")
    assert sorted((r["doc_id"], r["v"]) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "c")]


def test_attempt_outcome(spark):
    df = spark.createDataFrame([(1, 3, "e" * 3000), (2, 1, "")], "job_id int, attempts int, error string").withColumn("failed_at", F.expr("timestamp '2024-01-01 00:00:00'"))
    rows = {r["job_id"]: r for r in jobs.attempt_outcome(df).collect()}
    assert (rows[1]["status"], rows[1]["available_at"], len(rows[1]["last_error"])) == ("failed", None, 2000)
    assert (rows[2]["status"], rows[2]["available_at"].second, rows[2]["last_error"]) == ("queued", 30, "Unknown worker error")


def test_score_bands_and_severity(spark):
    df = spark.createDataFrame([("69.5",), ("40",), ("-3",), ("x",), (None,)], "s string")
    assert {r["band"]: r["n"] for r in labels.score_bands(df, "s").collect()} == {"Low Risk": 1, "Moderate Risk": 1, "High Risk": 1, "Unknown": 2}


def test_stream_equals_batch(spark, tmp_path):
    texts = [(i, f"The lessee shall pay Rs. {i}00 as rent within {i} days.\n\nThe policy premium is due; damages follow any breach here.") for i in range(1, 7)]
    src, out, schema = str(tmp_path / "in"), str(tmp_path / "out"), "doc_id long, text string, version int"

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        live.finished(live.stream_analysis(spark.readStream.schema(schema).parquet(src), out, str(tmp_path / "cp"), version="version", buckets=4))

    def clause_rows(rows):
        batch = briefing.ranked_clauses(briefing.cleaned(spark.createDataFrame(rows, schema)).select("doc_id", "text"))
        return sorted(map(tuple, batch.select("doc_id", "rank", "clause_type", "full_text").collect()))

    current = lambda: sorted(map(tuple, live.latest_documents(spark, out).select("doc_id", "rank", "clause_type", "full_text").collect()))
    arrive([(*t, 1) for t in texts[:4]])
    assert current() == clause_rows([(*t, 1) for t in texts[:4]])
    other = "The landlord must refund the deposit of Rs. 900 within 60 days of expiry of the lease."
    arrive([(1, other, 3), (1, texts[0][1], 2), (*texts[4], 1), (*texts[5], 1), (None, other, 1)])  # of two versions in a batch the greater stays
    now = [(1, other, 3)] + [(*t, 1) for t in texts[1:]]
    assert current() == clause_rows(now)
    arrive([(2, "", 2)])  # nothing to analyse: what is there stays
    assert current() == clause_rows(now)

    # a batch run twice, and one that stopped while folders were exchanged
    new = live.clause_rows(spark.createDataFrame([(3, other, 9)], schema)).persist()
    live.replace_documents(new, out, 7, buckets=4)
    once = current()
    live.replace_documents(new, out, 7, buckets=4)
    assert current() == once == clause_rows([(3, other, 9) if t[0] == 3 else t for t in now])
    lost = next((tmp_path / "out" / "current").glob("bucket=*"))
    shutil.rmtree(next((tmp_path / "out" / "current").glob(next((tmp_path / "out" / "staged" / "batch-7").glob("bucket=*")).name)))
    live.replace_documents(new, out, 7, buckets=4)
    assert lost.parent.exists() and current() == once
    files = list((tmp_path / "out" / "current").glob("bucket=*/*.parquet"))
    assert len(files) <= 4 and len(list((tmp_path / "out" / "staged").iterdir())) <= 2  # no history to scan


def test_a_folder_of_many_rows_is_written_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(live, "FILE_ROWS", 50)
    out = str(tmp_path / "out")
    for batch, name in enumerate(("old", "new")):
        live.replace_documents(spark.range(batch * 300, 600).selectExpr("id AS doc_id", f"'{name}' AS text"), out, batch, buckets=2)
    rows = live.latest_documents(spark, out).collect()
    assert sorted(map(tuple, rows)) == [(i, "old" if i < 300 else "new") for i in range(600)]
    assert len(list((tmp_path / "out" / "current").glob("bucket=*/*.parquet"))) > 2


def test_stream_dedup_forgets(spark, tmp_path):
    src, out, schema = str(tmp_path / "in"), str(tmp_path / "out"), "ts timestamp, signature string, n int"
    held = []

    def arrive(*rows):
        day = lambda x: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=x)
        spark.createDataFrame([(day(d), s, n) for d, s, n in rows], schema).coalesce(1).write.mode("append").parquet(src)
        q = live.stream_dedup(spark.readStream.schema(schema).parquet(src), "ts", "10 days", ["signature"], out, str(tmp_path / "cp"))
        live.finished(q)
        held.append(q.lastProgress.stateOperators[0].numRowsTotal)

    arrive(*[(1, f"s{i}", i) for i in range(50)], (1, "s0", 99))
    arrive((15, "s1", 100), (15, "new", 101))      # watermark -9 to day 5: s1 is remembered until day 11
    arrive((40, "later", 102))                     # watermark day 30: all of day 1 and 15 are forgotten
    arrive((41, "s2", 103), (20, "s3", 104), (20, "late", 105))  # s2 is new again; rows before day 30 are late
    got = {r["n"] for r in spark.read.parquet(out).collect()}
    assert {n for n in got if n < 50 or n == 99} >= set(range(1, 50)) and len(got & {0, 99}) == 1
    assert got & set(range(100, 106)) == {101, 102, 103}
    assert held[0] == 50 and held[1] == 51 and held[2] < 5 and held[3] < 5


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_written_tables_are_not_broadcast(spark):
    """A written table of repeated wording is a small file and a large table."""
    from briefloom.plans.placement import written
    kept = written(spark.range(20_000).select(F.col("id").alias("k"), F.repeat(F.lit("the same words "), 100).alias("text")), "packed")
    other = spark.range(10 ** 9).select(F.col("id").alias("k"))
    plan = _plan(other.join(kept, "k"))
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert "SortMergeJoin" in _plan(other.join(kept.groupBy("k").agg(F.max("text").alias("text")), "k", "left"))


def test_related_risks_broadcasts_no_copies(spark, tmp_path):
    """Risks are copied once per part, so what a packed file of them says of their size is no ground for a broadcast."""
    from briefloom.operators import retrieval as op
    spark.range(1000).selectExpr("id AS doc_id", "1L AS seq", "'high' AS severity", "'a late fee of ten percent' AS clause_text").write.parquet(f"{tmp_path}/risks")
    sources = spark.range(10 ** 9).selectExpr("id AS query_id", "id AS doc_id", "'a late fee of ten percent applies' AS text")
    assert "BroadcastHashJoin" not in _plan(op.related_risks(sources, spark.read.parquet(f"{tmp_path}/risks")))


def test_clause_queries_place_no_text(spark):
    """Contracts are dealt by their number before they are texts; only columns that are asked for are made."""
    from briefloom import registry
    registry.load_all()
    plan = _plan(registry.QUERIES["top_clauses_h2"](spark, "/root/testdata/sf0.001"))
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1 and "financial_values" not in plan and "deadlines" not in plan
    stored = _plan(registry.QUERIES["vector_rows_a14"](spark, "/root/testdata/sf0.001"))
    assert "regexp_extract_all" not in stored and "orders.parquet" not in stored  # clauses are made once and written


def test_patterns_that_start_at_a_letter_find_the_same(spark):
    text = "Late fee; a fee, coffee fees\nFEE ﬁne fee2 \u0301fee é-fee éfee _fee fee"
    for pattern in (r"\bfee\b", r"\bf\w+", r"\be?fee", "fee"):
        same = [one(spark, lambda c: columns.find_all(F.lower(c), p), text) for p in (pattern, columns.letter_first(pattern))]
        assert same[0] == same[1] != []
    assert columns.letter_first(r"\bfee\b") != r"\bfee\b"


@pytest.mark.parametrize("name", ["analysis_record_a16", "atomic_briefing_c5_g2", "known_parties_d9_e12", "entity_groups_e11", "entity_counts_g10",
                                  "purpose_relations_e14", "confidence_bands_d20"])
def test_work_on_a_contract_stays_in_its_row(spark, name):
    from briefloom import registry
    registry.load_all()
    plan = _plan(registry.QUERIES[name](spark, "/root/testdata/sf0.001"))
    # orders and customers meet, then the orders are dealt; only the bands are counted over all documents
    assert plan.count("orders.parquet") == 1 and plan.count("Join") == 1 and plan.count("Exchange hashpartitioning") == (2 if name == "confidence_bands_d20" else 1)


def test_parties_that_are_overridden_are_not_broadcast(spark):
    from briefloom import registry
    registry.load_all()
    plan = _plan(registry.QUERIES["override_parties_e18"](spark, "/root/testdata/sf0.001"))
    assert "SortMergeJoin" in plan and "judge" not in plan


def test_entities_made_in_the_row_equal_those_of_frames(spark):
    from briefloom.sources import samples
    sf = "/root/testdata/sf0.001"
    marked = samples.marked_text(spark, sf)
    docs = marked.select("doc_id", "text").where("doc_id < 200")
    mentions = marked.where("doc_id < 200").select("doc_id", F.inline("mentions"))
    marked = marked.where("doc_id < 200")
    key = lambda df: sorted(map(str, df.collect()))
    every = entities.marked_entities(marked)
    assert key(entities.marked_entity_groups(marked)) == key(entities.entity_groups(every))
    plain = entities.bucket_mentions(mentions)
    for buckets in (None, ["parties", "judges"], ["dates"]):
        rich = every if buckets is None else every.filter(F.col("bucket").isin(buckets))
        assert key(entities.marked_entity_counts(marked, buckets)) == key(entities.entity_counts(rich, plain))
    for kinds in (["purpose"], ["risk", "obligation"]):
        assert key(entities.marked_relations(marked, kinds)) == key(entities.all_relations(mentions, docs).where(F.col("type").isin(kinds)))
    held = entities.entities_in_row(marked).select("doc_id", entities.parties_in(F.col("_es")).alias("parties")).where(F.size("parties") > 0)
    assert key(held) == key(entities.parties_column(entities.parties_map(every))) and held.count() > 10


def test_analysis_in_one_row_equals_that_of_tables(spark):
    rows = [(1, "One two.\n\nThree four five."), (2, "x"), (3, "-")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    es = spark.createDataFrame([(1, "money", 5, "b", 0.9, None), (1, "dates", None, "a", 0.8, None), (2, "parties", 0, "x", 0.95, "Lessor")],
                               "doc_id long, bucket string, start_char long, text string, confidence double, role string")
    chunks = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "doc_id long, chunk_text string")
    want = tables.assemble_analysis(docs, summaries.extractive_summary(docs).drop("text"), es, chunks)
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    held = summaries.extractive_summary(docs).withColumnRenamed("text", "cleaned_text")
    held = held.join(es.groupBy("doc_id").agg(F.collect_list(F.struct(*es.columns[1:])).alias("entities")), "doc_id", "left")
    held = held.join(chunks.groupBy("doc_id").agg(F.collect_list("chunk_text").alias("chunks")), "doc_id", "left")
    held = held.withColumns({"entities": none("entities", held.schema["entities"].dataType), "chunks": none("chunks", "array<string>")})
    got = tables.analysis_in_row(held)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_short_rows_are_dealt_by_their_number(spark):
    """Texts are made of short rows, so the parts follow the rows and not the bytes of the file."""
    from briefloom.sources import samples
    rows = spark.range(0, 1000, 1, 2)
    assert samples.spread(rows, 50).rdd.getNumPartitions() == 20
    assert samples.spread(rows, 50).distinct().count() == 1000
    assert samples.spread(rows, 10 ** 6).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_rules_run_where_their_first_letters_are(spark):
    df = spark.createDataFrame([(1, "Rent, rental and RENT"), (2, "no such word"), (3, "a fee or a fine")], "id int, text string")
    ruled = labels.apply_rules(df, [("rent", r"\brent\b"), ("charge", r"\bfee|\bfine"), ("digits", r"\d")])
    assert sorted((r["id"], r["rule"], r["n"]) for r in ruled.collect()) == [(1, "rent", 2), (3, "charge", 2)]
    assert "contains(" in ruled._jdf.queryExecution().optimizedPlan().toString().lower()


def test_clause_queries_make_only_their_own_columns(spark):
    from briefloom import registry
    registry.load_all()
    for name, absent in (("clause_title_d10", "commencement|expiry"), ("clause_deadlines_e17", "lakh|crore"), ("clause_amounts_e16", "commencement|expiry"),
                         ("legal_impact_d12", "lakh|crore")):
        assert absent not in registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString(), name


def test_entities_of_some_buckets_are_those_of_all(spark):
    text = "The Lessor First Bank pays Rs. 1,50,000 as deposit within 30 days under Section 12 of Act, as held by Justice Ravi Kumar. Rs. 500 is a fee."
    docs = spark.createDataFrame([(1, text), (2, "Nothing here"), (3, "Rs. 70 and Rs. 70")], "doc_id long, text string")
    spots = [(1, "ORG", "First Bank"), (1, "MONEY", "Rs. 1,50,000"), (1, "MONEY", "Rs. 500"), (1, "PERSON", "Section 12 of Act")]
    rows = [(i, label, m, text.index(m), text.index(m) + len(m)) for i, label, m in spots] + [(3, "MONEY", "Rs. 70", 0, 6), (3, "MONEY", "Rs. 70", 11, 17)]
    found = spark.createDataFrame(rows, "doc_id long, label string, text string, start_char long, end_char long")
    every = entities.all_entities(found, docs).collect()
    for buckets in (["money"], ["judges", "legal_references"], ["parties"], ["durations", "money"]):
        some = entities.all_entities(found, docs, buckets).collect()
        assert sorted(map(str, some)) == sorted(str(e) for e in every if e["bucket"] in buckets) and some, buckets


def test_entity_queries_look_for_their_own_buckets(spark):
    from briefloom import registry
    registry.load_all()
    for name in ("pattern_spans_e1", "exclude_contained_e21", "amounts_by_type_g9"):
        assert "Writ" not in registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString(), name


def test_lookups_make_entities_once(spark):
    """Entities and the parties among them are read from one written table."""
    from briefloom import registry
    registry.load_all()
    assert "Writ" not in registry.QUERIES["resolve_entity_f7"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()


def test_contract_texts_keep_their_parts_behind_a_join_by_key(spark, monkeypatch):
    from briefloom.sources import samples
    monkeypatch.setattr(samples, "TASK_ORDERS", 100)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = samples.contract_text(spark, "/root/testdata/sf0.001")
        assert rows.rdd.getNumPartitions() == -(-rows.count() // 100)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_cleaning_of_odd_spacing_case_and_letters(spark):
    raw = ["a\u00a0\n b\n\n\n\nc", "A  line\na LINE\n\n b\nB", "Rs.,-x 12,  usd-y", "1.\t\t2  \n3", "\u017fon of X, y", "FLAT 5, road " + "x" * 120 + "\nzed"]
    assert mapped(spark, lambda c: cleaning.clean_text(c, False), raw) == ["a b\n\nc", "A line\n\nb", "x y", "2\n3", ", y", "zed"]


def test_clause_types_of_listed_words_only():
    pattern = re.compile(clauses.starts_of(["rent", "rental", "repair", "tax"]))
    assert [bool(pattern.match(w)) for w in ("rent", "renter", "repairs", "taxi", "ren", "reptile", "at")] == [True] * 4 + [False] * 3


def test_longest_word_of_a_pattern():
    got = [columns.literal_word(p) for p in (r"\bis\s*required\s*to\b", r"\bsub.?let\b", r"\bfees?\b", r"\bwithin\s*\d+", r"\b(?:a|bc)\b")]
    assert got == ["required", "sub", "fee", "within", ""]


def test_category_counts_need_no_wording(spark):
    rows = spark.createDataFrame([(1, "rent"), (1, "deposit"), (1, "obligation"), (2, "rent"), (2, "tribunal")], "doc_id long, clause_type string")
    got = {r["category"]: r["n"] for r in clauses.category_counts(clauses.group_keys(rows)).collect()}
    assert got == {"All": 3, "Finance": 2, "Protections": 1}


def test_briefing_reads_its_clauses_once(spark):
    docs = spark.createDataFrame([(i, "The tenant shall pay rent of Rs. 5,000 within 5 days and shall maintain the roof.\n\n"
                                   "The parties shall meet at the office and must bring every paper.\n\nAll disputes go to the court.") for i in range(3)],
                                 "doc_id long, text string")
    ranked = briefing.ranked_clauses(docs).localCheckpoint()
    got = clauses.briefing(ranked)
    want = clauses.insight_groups(ranked).unionByName(clauses.supplement_groups(ranked))
    assert got.columns == want.columns and got.count() > 3
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1


def test_phrases_share_their_first_words():
    pattern = segmenting.any_phrase(fixed.TRIGGER_PHRASES)
    plain = re.compile("(?i)(?:" + "|".join(fixed.TRIGGER_PHRASES) + ")")
    text = "He SHALL  pay and shall be liable; shall bear, must not, must\npay, may terminate, agrees to, entitled to shall"
    assert [m[0] for m in re.compile(pattern).finditer(text)] == [m[0] for m in plain.finditer(text)]
    assert pattern.count("shall") == 1 and segmenting.any_phrase(["a|b"]) == "(?i)(?:a|b)"


@pytest.mark.parametrize("name", ["assign_roles_e5", "entity_confidence_e8", "dedup_entities_e9_i1",
                                  "fallback_mentions_e20", "exclude_reviewed_e21"])
def test_contracts_carry_their_mentions(spark, name):
    # texts are made once and meet their mentions in the row: the only join is that of orders and customers
    from briefloom import registry
    registry.load_all()
    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "Window" not in plan and "Aggregate" not in plan and "hashpartitioning" not in plan


def test_legal_phrases_in_one_long_run_of_words(spark):
    import time
    run = "a contract, " + "word " * 12_000
    docs = spark.createDataFrame([(1, run + "; Section 3 of Sale Act"), (2, "The Sale Act of an act; Act, 1872 and Section 12 of Contract Act.")],
                                 "doc_id long, text string")
    start = time.time()
    rows = entities.pattern_entities(docs, [fixed.ENTITY_PATTERNS[0]]).orderBy("doc_id", "start_char").collect()
    assert time.time() - start < 8  # before, every letter of the run looked for "Act" up to its end
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert [(r["doc_id"], texts[r["doc_id"]][r["start_char"]:r["end_char"]]) for r in rows] == [
        (1, "a contract"), (1, "Section 3 of Sale"), (2, "The Sale Act of an act"), (2, "Act, 1872"), (2, "and Section 12 of Contract Act")]


def test_texts_with_mentions_equal_the_joined_ones(spark):
    t = "Mr. Rao, the Lessor, paid Rs. 500 as rent; the Sale Act, 1930 binds. Justice Ravi Kumar sat 5 days! The Buyer Asha paid Rs. 1,500 on 3/4/2024."
    found = [("PERSON", "Mr. Rao"), ("MONEY", "Rs. 500"), ("LAW", "Sale Act"), ("PERSON", "Ravi Kumar"), ("ORG", "Asha"), ("DATE", "5 days"), ("ORG", "Sale Act")]
    docs = spark.createDataFrame([(1, t), (2, "")], "doc_id long, text string")
    ms = [(1, label, m, t.index(m), t.index(m) + len(m)) for label, m in found]
    mentions = spark.createDataFrame(ms, "doc_id long, label string, text string, start_char long, end_char long")
    packed = mentions.groupBy("doc_id").agg(F.collect_list(F.struct("label", "text", "start_char", "end_char")).alias("mentions"))
    marked = docs.join(packed, "doc_id", "left").withColumn("mentions", F.coalesce("mentions", F.array()))
    key = lambda df, cols: sorted(map(str, df.select(*cols).collect()))
    cols = ["doc_id", "bucket", "text", "role", "money_type", "context", "confidence", "source"]
    assert key(entities.marked_entities(marked), cols) == key(entities.all_entities(mentions, docs), cols)
    assert key(entities.marked_model_entities(marked), cols) == key(entities.model_entities(mentions, docs), cols)
    assert key(entities.pattern_entities(docs, spans=False), cols) == key(entities.pattern_entities(docs), cols)
    kept = mention_review.filter_mentions(mentions)
    assert key(mention_review.marked_fallback_mentions(marked, "text"), ["doc_id", "label", "text"]) == key(
        mention_review.fallback_mentions(kept, docs), ["doc_id", "label", "text"])
    others = mention_review.review_references(kept, docs).filter("bucket IN ('judges', 'legal_references')")
    free = mention_review.exclude_contained(kept.filter("label IN ('PERSON', 'ORG')"), others)
    assert key(mention_review.marked_exclude_reviewed(marked), ["doc_id", "text"]) == key(free, ["doc_id", "text"])

"""Queries of the segmentation operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cleaning as clean
from ..functions import fixed, segmenting
from ..operators import segments as op
from ..sources import samples
from . import query
from .sql import squeeze, strip, text, view, with_views

WORD = r"[\p{L}\p{N}_]"


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


def d_units(source: str, array: str, pos: str, unit: str) -> str:
    """One row per element of ``array``, numbered from 0."""
    return (f"SELECT doc_id, CAST(unnest(range(len(l))) AS BIGINT) AS {pos}, unnest(l) AS {unit} "
            f"FROM (SELECT doc_id, {array} AS l FROM {source})")


def d_pieces(expr: str) -> str:
    return f"list_filter(list_transform({expr}, lambda x: {strip('x')}), lambda x: x <> '')"


def d_sentences(t: str) -> str:
    return d_pieces(rf"string_split(regexp_replace({squeeze(t)}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))")


def d_sentences_raw(t: str) -> str:
    return d_pieces(rf"string_split(regexp_replace({strip(t)}, '([.!?])[\s\x{{A0}}]+', '\1' || chr(1), 'g'), chr(1))")


def d_words(t: str) -> str:
    return rf"list_filter(regexp_split_to_array({t}, '[\s\x{{A0}}]+'), lambda x: x <> '')"


def d_grouped(array: str, n: int) -> str:
    return (f"list_transform(range(0, len({array}), {n}), "
            f"lambda i: array_to_string(({array})[i+1:i+{n}], ' '))")


D_PARAS = (rf"list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda x: {strip('x')}), "
           "lambda x: length(x) > 30)")
view("paragraphs", f"SELECT c.doc_id, c.document_type, p.para_no, p.paragraph FROM contract_text c JOIN "
                   f"({d_units('contract_text', D_PARAS, 'para_no', 'paragraph')}) p ON p.doc_id = c.doc_id",
     ["contract_text"])
view("sentences", d_units("documents", d_sentences("text"), "pos", "sentence"))


def contract_paragraphs(spark, d) -> DataFrame:
    return longs(op.paragraphs(samples.contract_text(spark, d)), "para_no")


@query("paragraphs_c1", with_views("paragraphs", "SELECT doc_id, para_no, paragraph FROM paragraphs"))
def paragraphs(spark, d):
    return contract_paragraphs(spark, d).drop("document_type")


@query("sentences_c2", with_views("sentences", "SELECT * FROM sentences"))
def sentences(spark, d):
    return longs(op.sentences(samples.documents(spark, d)), "pos")


@query("raw_sentences_c3", d_units("documents", d_sentences_raw("text"), "pos", "sentence"))
def raw_sentences(spark, d):
    return longs(op.sentences_raw(samples.documents(spark, d)), "pos")


@query("sentence_count_c4", f"""SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '[.!?]+'),
  lambda x: {strip('x')} <> '')) AS BIGINT) AS sentence_count FROM documents""")
def sentence_count(spark, d):
    return op.sentence_count(samples.documents(spark, d)).drop("text")


def contract_clauses(spark, d) -> DataFrame:
    """Single-duty clauses of the cleaned contracts."""
    docs = samples.contract_text(spark, d)
    docs = docs.withColumn("text", clean.clean_text(F.col("text"), for_summarization=True))
    return op.atomic_clauses(op.paragraphs(docs))


@query("atomic_clauses_c5")
def atomic_clauses(spark, d):
    return longs(op.atomic_clauses(op.paragraphs(samples.contract_text(spark, d))), "para_no", "pos").drop("document_type")


@query("group_sentences_c6", d_units(
    f"(SELECT doc_id, text, {d_sentences_raw('text')} AS s FROM documents)",
    f"CASE WHEN len(s) <= 5 THEN [text] ELSE {d_grouped('s', 5)} END", "pos", "group_text"))
def group_sentences(spark, d):
    return longs(op.group_sentences(samples.documents(spark, d)), "pos")


@query("word_windows_c7", d_units(f"(SELECT doc_id, {d_words('text')} AS w FROM documents)", d_grouped("w", 50),
                                  "pos", "window"))
def word_windows(spark, d):
    return longs(op.word_windows(samples.documents(spark, d), 50), "pos")


# --- packing, paragraph by paragraph: the open run starts at a and holds n words; runs are pairs of paragraph numbers
def d_tokens(x: str) -> str:
    return rf"len(regexp_extract_all({x}, '\S+'))"


def d_packed(source: str, min_words: int, max_words: int) -> str:
    """``doc_id, c`` of ``source(doc_id, text)``: the packed chunks as a list."""
    whole = "list_transform(range(r[1] + 1, r[2] + 1), lambda k: ps[k])"
    return rf"""SELECT doc_id, flatten(list_transform(runs, lambda r: CASE WHEN r[2] = r[1] + 1 AND {d_tokens('ps[r[1] + 1]')} > {max_words}
   THEN {d_grouped(d_words('ps[r[1] + 1]'), max_words)} ELSE [array_to_string({whole}, chr(10) || chr(10))] END)) AS c FROM (
 WITH RECURSIVE texts AS (SELECT doc_id, {d_pieces("string_split(text, chr(10) || chr(10))")} AS ps FROM {source}),
 step(doc_id, k, a, n, runs) AS (SELECT doc_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST([] AS BIGINT[][]) FROM texts UNION ALL
  SELECT doc_id, k + 1, CASE WHEN seals THEN k + 1 ELSE a END, CASE WHEN seals THEN 0 ELSE n + m END, CASE WHEN seals THEN runs || [[a, k + 1]] ELSE runs END
  FROM (SELECT *, big OR n + m BETWEEN {min_words} AND {max_words} AS seals
   FROM (SELECT doc_id, k, m, big, CASE WHEN closes THEN k ELSE a END AS a, CASE WHEN closes THEN 0 ELSE n END AS n, CASE WHEN closes AND k > a THEN runs || [[a, k]] ELSE runs END AS runs
    FROM (SELECT *, m > {max_words} AS big, m > {max_words} OR (k > a AND n + m > {max_words}) AS closes
     FROM (SELECT s.*, {d_tokens('t.ps[s.k + 1]')} AS m FROM step s JOIN texts t ON t.doc_id = s.doc_id WHERE s.k < len(t.ps))))))
 SELECT t.doc_id, t.ps, CASE WHEN s.k > s.a THEN runs || [[s.a, s.k]] ELSE runs END AS runs FROM step s JOIN texts t ON t.doc_id = s.doc_id WHERE s.k = len(t.ps))"""


def d_tail(source: str, min_words: int, max_words: int) -> str:
    return f"""SELECT doc_id, CASE WHEN len(c) >= 2 AND {d_tokens('c[len(c)]')} < {min_words} AND {d_tokens('c[len(c) - 1]')} + {d_tokens('c[len(c)]')} <= {2 * max_words}
  THEN c[1:len(c) - 2] || [c[len(c) - 1] || chr(10) || chr(10) || c[len(c)]] ELSE c END AS c FROM ({source})"""


def d_overlapped(source: str, overlap: int) -> str:
    last = f"CASE WHEN len({d_words('c[i - 1]')}) > {overlap} THEN array_to_string(({d_words('c[i - 1]')})[-{overlap}:], ' ') ELSE c[i - 1] END"
    return f"SELECT doc_id, list_transform(c, lambda x, i: CASE WHEN i = 1 THEN x ELSE {last} || chr(10) || chr(10) || x END) AS c FROM ({source})"


def d_chunk_rows(source: str) -> str:
    return f"SELECT doc_id, CAST(unnest(range(len(c))) AS BIGINT) AS chunk_index, unnest(c) AS chunk_text FROM ({source})"


@query("pack_chunks_c8", with_views("contract_text", d_chunk_rows(d_packed("contract_text", 30, 60))))
def pack_chunks(spark, d):
    rows = op.pack_chunks(samples.contract_text(spark, d), 30, 60)
    return longs(rows.select("doc_id", F.posexplode("chunks").alias("chunk_index", "chunk_text")), "chunk_index")


@query("merge_tail_c9", with_views("contract_text", d_chunk_rows(d_tail(d_packed("contract_text", 30, 60), 30, 60))))
def merge_tail(spark, d):
    rows = op.merge_tail(op.pack_chunks(samples.contract_text(spark, d), 30, 60), 30, 60)
    return longs(rows.select("doc_id", F.posexplode("chunks").alias("chunk_index", "chunk_text")), "chunk_index")


@query("add_overlap_c10", f"""
SELECT doc_id, pos AS chunk_index, CASE WHEN prev IS NULL THEN win ELSE
  array_to_string(CASE WHEN len(pw) > 10 THEN pw[len(pw)-9:] ELSE pw END, ' ') || chr(10) || chr(10) || win END AS chunk_text
FROM (SELECT *, {d_words('prev')} AS pw FROM (SELECT doc_id, pos, win, lag(win) OVER (PARTITION BY doc_id ORDER BY pos) AS prev
  FROM ({d_units(f"(SELECT doc_id, {d_words('text')} AS w FROM documents)", d_grouped("w", 40), "pos", "win")})))""")
def add_overlap(spark, d):
    docs = samples.documents(spark, d).withColumn("chunks", segmenting.word_windows(F.col("text"), 40))
    rows = op.add_overlap(docs, 10).select("doc_id", F.posexplode("chunks").alias("chunk_index", "chunk_text"))
    return longs(rows, "chunk_index")


# --- sections
def d_key(x: str) -> str:
    s = f"translate(lower({strip(x)}), '*#', '')"
    for p in (fixed.HEADING_LABEL_PREFIX, fixed.HEADING_NUMBER_PREFIX):
        s = f"regexp_replace({s}, {text(p)}, '', 'i')"
    return rf"trim(regexp_replace({s}, '\s+', ' ', 'g'), ' :.-')"


def _list(values) -> str:
    return ", ".join(text(v) for v in values)


view("marked_lines", f"""
SELECT *, {d_key('line')} AS key FROM (
SELECT doc_id, line_no, raw, line, clean, n, length(line) < 120 AND (starts_with(line, '#')
   OR (starts_with(line, '**') AND ends_with(line, '**') AND n BETWEEN 2 AND 11)
   OR regexp_matches(clean, {text(fixed.NAMED_HEADING)}, 'i')
   OR (regexp_matches(clean, {text(fixed.NUMBERED_HEADING)}) AND n BETWEEN 2 AND 10 AND right(clean, 1) NOT IN ('.', ';', ','))
   OR (upper(clean) = clean AND regexp_matches(clean, '[A-Z]') AND n BETWEEN 2 AND 7)) AS heading
FROM (SELECT *, len(regexp_extract_all(clean, '\\S+')) AS n FROM (
  SELECT doc_id, line_no, raw, {strip('raw')} AS line, {strip("translate(" + strip('raw') + ", '*#', '')")} AS clean
  FROM ({d_units('contract_text', 'string_split(text, chr(10))', 'line_no', 'raw')})) WHERE line <> ''))""",
     ["contract_text"])
D_NOISE = (f"(key = '' OR key IN ({_list(fixed.NOISE_HEADINGS)}) OR regexp_matches(key, {text(fixed.HONORIFIC_HEADING)}) "
           f"OR contains(lower(line), 'name: ____') OR contains(lower(line), 'address: ____') "
           rf"OR (len(regexp_extract_all(key, '\S+')) = 1 AND key NOT IN ({_list(fixed.SINGLE_WORD_HEADINGS)})))")
view("section_rows", f"""
SELECT doc_id, sec, max(clean) FILTER (WHERE heading) AS title,
  string_agg(raw, chr(10) ORDER BY line_no) FILTER (WHERE NOT heading) AS content
FROM (SELECT *, sum(CASE WHEN heading THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS sec
      FROM marked_lines WHERE NOT heading OR NOT {D_NOISE})
WHERE sec > 0 GROUP BY doc_id, sec""", ["marked_lines"])
view("sections", f"""
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY sec) - 1 AS BIGINT) AS section_no, title, content
FROM section_rows WHERE length({strip('content')}) >= 50""", ["section_rows"])


@query("sections_c11", with_views("sections", "SELECT * FROM sections"))
def sections(spark, d):
    return longs(op.sections(samples.contract_text(spark, d)), "section_no").drop("document_type")


@query("heading_keys_c12", with_views("marked_lines", rf"""
SELECT heading_key, CASE WHEN s = '' THEN 'section' ELSE s END AS heading_slug, count(*) AS n
FROM (SELECT key AS heading_key, trim(regexp_replace(regexp_replace(key, '[^a-z0-9\s_]', '', 'g'), '\s+', '_', 'g'), '_') AS s
      FROM marked_lines) GROUP BY ALL"""))
def heading_keys(spark, d):
    rows = op.lines(samples.contract_text(spark, d)).filter(F.trim("line") != "")
    rows = op.heading_slug(op.heading_key(rows, "line"), "line")
    return rows.groupBy("heading_key", "heading_slug").agg(F.count("*").alias("n"))


@query("noise_headings_c13", with_views("marked_lines", f"""
SELECT line, {D_NOISE} AS is_noise_heading, count(*) AS n FROM marked_lines GROUP BY ALL"""))
def noise_headings(spark, d):
    rows = op.lines(samples.contract_text(spark, d)).withColumn("line", F.trim("line")).filter("line <> ''")
    return op.is_noise_heading(rows, "line").groupBy("line", "is_noise_heading").agg(F.count("*").alias("n"))


@query("chunk_sequential_c14", with_views("contract_text", d_chunk_rows(d_overlapped(d_tail(d_packed("contract_text", 48, 60), 48, 60), 200))))
def chunk_sequential(spark, d):
    return longs(op.chunk_sequential(samples.contract_text(spark, d), 60).select("doc_id", "chunk_index", "chunk_text"), "chunk_index")


def d_sequential(source: str, max_words: int) -> str:
    return d_overlapped(d_tail(d_packed(source, int(max_words * 0.8), max_words), int(max_words * 0.8), max_words), 200)


def d_by_sections(max_words: int) -> str:
    """``doc_id, c``: whole sections packed greedily, a longer one chunked by itself; under three sections the text by paragraphs."""
    return rf"""SELECT d.doc_id, CASE WHEN coalesce(len(ts), 0) < 3 THEN q.c ELSE flatten(list_transform(runs, lambda r: CASE WHEN r[2] = r[1] + 1 AND ns[r[1] + 1] > {max_words} THEN cs[r[1] + 1]
   ELSE [array_to_string(list_transform(range(r[1] + 1, r[2] + 1), lambda k: ts[k]), chr(10) || chr(10))] END)) END AS c
FROM contract_text d JOIN ({d_sequential('contract_text', max_words)}) q ON q.doc_id = d.doc_id LEFT JOIN (
 WITH RECURSIVE parts AS (SELECT s.doc_id, list(s.text ORDER BY section_no) AS ts, list(len(regexp_extract_all(s.text, '\w\S*')) ORDER BY section_no) AS ns, list(p.c ORDER BY section_no) AS cs
  FROM section_texts s JOIN ({d_sequential('(SELECT doc_id * 1000 + section_no AS doc_id, text FROM section_texts)', max_words)}) p ON p.doc_id = s.doc_id * 1000 + s.section_no GROUP BY s.doc_id),
 step(doc_id, k, a, n, runs) AS (SELECT doc_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST([] AS BIGINT[][]) FROM parts UNION ALL
  SELECT doc_id, k + 1, CASE WHEN big THEN k + 1 WHEN closes THEN k ELSE a END, CASE WHEN big THEN 0 WHEN closes THEN m ELSE n + m END,
   CASE WHEN closes AND k > a THEN runs || [[a, k]] ELSE runs END || CASE WHEN big THEN [[k, k + 1]] ELSE CAST([] AS BIGINT[][]) END
  FROM (SELECT *, m > {max_words} AS big, m > {max_words} OR n + m > {max_words} AS closes FROM (
   SELECT s.*, t.ns[s.k + 1] AS m FROM step s JOIN parts t ON t.doc_id = s.doc_id WHERE s.k < len(t.ts))))
 SELECT t.*, CASE WHEN s.k > s.a THEN s.runs || [[s.a, s.k]] ELSE s.runs END AS runs FROM step s JOIN parts t ON t.doc_id = s.doc_id WHERE s.k = len(t.ts)) r ON r.doc_id = d.doc_id"""


view("section_texts", "SELECT doc_id, section_no, title || chr(10) || content AS text FROM sections", ["sections"])


@query("chunk_by_sections_c15", with_views("contract_text section_texts", d_chunk_rows(d_by_sections(60))))
def chunk_by_sections(spark, d):
    return longs(op.chunk_by_sections(samples.contract_text(spark, d), 60).select("doc_id", "chunk_index", "chunk_text"), "chunk_index")


WANTED = ["Security Deposit", "3. Indemnity"]


@query("select_sections_c16", with_views("contract_text sections", f"""
SELECT c.doc_id, coalesce(p.t, c.text) AS text FROM contract_text c LEFT JOIN (
  SELECT doc_id, string_agg(title || chr(10) || content, chr(10) || chr(10) ORDER BY section_no) AS t
  FROM (SELECT *, {d_key('title')} AS k FROM sections)
  WHERE contains(k, 'indemnity') OR contains('indemnity', k)
  GROUP BY doc_id) p ON p.doc_id = c.doc_id"""))
def select_sections(spark, d):
    return op.select_sections(samples.contract_text(spark, d), WANTED[1:]).drop("document_type")


HEADED = ("concat('Opening words.\n## Financial Obligations\nRent is ', doc_id, '.\n\n**Legal Clauses**\nCourt rules.\n"
          "1. Key Terms and Conditions\nTerm of one year.\nFinancial Obligations\nRent again ', doc_id, '.')")


def _headed_rows() -> str:
    """Expected parts of HEADED per document type; # stands for the document id."""
    lead, rent, law, terms, again = "Opening words.", "Rent is #.", "Court rules.", "Term of one year.", "Rent again #."
    full = f"{lead}\n## Financial Obligations\n{rent}\n\n**Legal Clauses**\n{law}\n1. Key Terms and Conditions\n{terms}\nFinancial Obligations\n{again}"
    law_only = [("executive_summary", f"{lead}\n## Financial Obligations\n{rent}"),
                ("legal_clauses", f"{law}\n1. Key Terms and Conditions\n{terms}\nFinancial Obligations\n{again}")]
    all_heads = [("executive_summary", lead), ("key_terms_and_conditions", terms), ("financial_obligations", again), ("legal_clauses", law)]
    parts = {"contract": [("executive_summary", lead), ("financial_obligations", again), ("legal_clauses", f"{law}\n1. Key Terms and Conditions\n{terms}")],
             "property": law_only, "insurance": law_only, "court_judgment": [("executive_summary", full)], "financial": all_heads, "general": all_heads}
    rows = [(t, n, k, c) for t, ps in parts.items() for n, (k, c) in enumerate(ps)]
    return ", ".join(f"({text(t)}, CAST({n} AS BIGINT), {text(k)}, {text(c)})" for t, n, k, c in rows)


@query("headed_text_c17", with_views("contract_text", f"""
SELECT doc_id, document_type, p.part_no, p.key, replace(p.content, '#.', doc_id || '.') AS content
FROM contract_text JOIN (VALUES {_headed_rows()}) p(kind, part_no, key, content) ON kind = document_type"""))
def headed_text(spark, d):
    docs = samples.contract_text(spark, d).withColumn("text", F.expr(HEADED.replace("\n", "\\n")))
    return longs(op.parse_headed_text(docs, "document_type"), "part_no")


@query("headed_selected_text_c17", with_views("contract_text", """
SELECT doc_id, p.part_no, p.key, replace(p.content, '#', CAST(doc_id AS VARCHAR)) AS content
FROM contract_text JOIN (VALUES (CAST(0 AS BIGINT), 'legal_clauses', 'Court rules.' || chr(10) || '1. Key Terms and Conditions' || chr(10) || 'Term of one year.'),
  (CAST(1 AS BIGINT), 'financial_obligations', 'Rent again #.')) p(part_no, key, content) ON true"""))
def headed_selected_text(spark, d):
    docs = samples.contract_text(spark, d).withColumn("text", F.expr(HEADED.replace("\n", "\\n"))).drop("document_type")
    return longs(op.parse_headed_text(docs, wanted=["Legal Clauses", "Financial Obligations"]), "part_no")


@query("template_headings_d4", "SELECT p_partkey, CAST(unnest(range(len(h))) AS BIGINT) AS heading_no, unnest(h) AS heading FROM ("
       "SELECT p_partkey, CASE p_type " + " ".join(
           f"WHEN {text(t)} THEN [{_list(fixed.TEMPLATES[n])}]" for t, n in
           [("ECONOMY", "contract"), ("SMALL", "court_judgment"), ("PROMO", "insurance")]) +
       f" ELSE [{_list(fixed.TEMPLATES['general'])}] END AS h FROM part)")
def template_headings(spark, d):
    parts = samples.table(spark, d, "part").select("p_partkey", F.expr(
        "CASE p_type WHEN 'ECONOMY' THEN 'Contract' WHEN 'SMALL' THEN 'court_judgment' WHEN 'PROMO' THEN 'insurance' "
        "ELSE p_type END").alias("t"))
    return longs(op.template_headings(parts, "t"), "heading_no").drop("t")


@query("summary_route_c18", f"""
SELECT doc_id, CASE WHEN n <= 800 THEN 'direct' ELSE 'chunked' END AS route,
  CASE WHEN n <= 800 THEN 'whole' WHEN doc_type = 'court_judgment' THEN 'sequential' ELSE 'sections' END AS chunker
FROM (SELECT doc_id, CASE WHEN lang = 'fr' THEN 'court_judgment' ELSE lang END AS doc_type,
  len(list_filter({d_words('text')}, lambda x: regexp_matches(x, '{WORD}'))) AS n FROM documents)""")
def summary_route(spark, d):
    docs = samples.spread(samples.table(spark, d, "documents").select(
        "doc_id", "text", F.expr("CASE WHEN lang = 'fr' THEN 'court_judgment' ELSE lang END").alias("doc_type")))
    return op.summary_route(docs, 800, "doc_type").select("doc_id", "route", "chunker")


@query("route_chunks_c18", with_views("contract_text section_texts", d_chunk_rows(rf"""
SELECT t.doc_id, CASE WHEN len(regexp_extract_all(t.text, '\w\S*')) <= 110 THEN [t.text] WHEN t.document_type = 'court_judgment' THEN q.c ELSE s.c END AS c
FROM contract_text t JOIN ({d_sequential('contract_text', 60)}) q ON q.doc_id = t.doc_id JOIN ({d_by_sections(60)}) s ON s.doc_id = t.doc_id""")))
def route_chunks(spark, d):
    return longs(op.route_chunks(samples.contract_text(spark, d), 110, 60, "document_type").select("doc_id", "chunk_index", "chunk_text"), "chunk_index")


@query("bullets_c19", f"""
SELECT doc_id, array_to_string(({d_pieces(f"regexp_split_to_array({strip('text')}, '[.!?]' || chr(92) || 's+')")})[1:12], chr(10)) AS bullets,
  array_to_string(({d_sentences_raw('text')})[1:8], chr(10)) AS viewer_bullets FROM documents""")
def bullets(spark, d):
    rows = op.bullets(samples.documents(spark, d)).withColumnRenamed("bullets", "b")
    rows = op.viewer_bullets(rows)
    return rows.select("doc_id", F.array_join("b", "\n").alias("bullets"),
                       F.array_join("bullets", "\n").alias("viewer_bullets"))


@query("summary_sections_c20", with_views("contract_text", """
SELECT doc_id, key, title, content FROM (
  SELECT doc_id, 'executive_summary' AS key, 'Executive Summary' AS title, trim(text) AS content FROM contract_text
  UNION ALL SELECT doc_id, 'key_terms', 'Key Terms', 'Type ' || document_type || chr(10) || 'One year' FROM contract_text
  UNION ALL SELECT doc_id, 'usage_rules_and_limits', 'Usage Rules And Limits', 'No subletting' FROM contract_text
)"""))
def summary_sections(spark, d):
    maps = samples.contract_text(spark, d).select("doc_id", F.expr(
        "map('executive_summary', array(text), 'key_terms', array(concat('Type ', document_type), 'One year'), "
        "'usage_rules_and_limits', array('No subletting'), 'top_insights', array('x'), 'risks', array(''))").alias("m"))
    return op.section_rows(maps, "m")

"""Queries of the retrieval and summary operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, segmenting
from ..operators import clauses as clause_op
from ..operators import entities as ent
from ..operators import labels as label_op
from ..operators import retrieval as op
from ..operators import segments as segment_op
from ..operators import summaries as sm
from ..plans import answers as answer_plan
from ..plans.placement import written
from ..sources import samples
from . import query
from .clauses import ranked
from .entities import entities
from .labels import INTENT
from .risks import norm_risks
from .segments import d_grouped, d_sentences, d_sentences_raw, d_words, longs
from .sql import ieee_round, text, view, with_views


# --- vectors: every vector belongs to the document of its label; each document is asked with the mean of its vectors
def vectors(spark, d):
    return samples.table(spark, d, "embeddings").select(
        "vec_id", F.col("label").cast("long").alias("doc_id"), "embedding",
        F.expr("concat('clause ', CAST(vec_id % 97 AS STRING))").alias("text"),
        F.expr("CASE WHEN vec_id % 5 = 0 THEN 'Critical' ELSE 'Standard' END").alias("importance_label"))


def vector_questions(spark, d):
    parts = vectors(spark, d).select("doc_id", F.posexplode("embedding").alias("i", "x")).groupBy("doc_id", "i").agg(F.avg("x").alias("x"))
    return parts.groupBy(F.col("doc_id").alias("query_id"), "doc_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("embedding"))


view("vec", """SELECT vec_id, CAST(label AS BIGINT) AS doc_id, CAST(embedding AS DOUBLE[]) AS embedding, 'clause ' || (vec_id % 97) AS text,
 CASE WHEN vec_id % 5 = 0 THEN 'Critical' ELSE 'Standard' END AS importance_label FROM embeddings""")
view("asked", """SELECT doc_id AS query_id, doc_id, list(x ORDER BY i) AS embedding FROM (SELECT doc_id, i, avg(x) AS x FROM (
 SELECT doc_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM vec) GROUP BY ALL) GROUP BY ALL""", ["vec"])
view("vec_top", """SELECT query_id, doc_id, vec_id, s, text, importance_label FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS n FROM (
 SELECT q.query_id, q.doc_id, v.vec_id, v.text, v.importance_label, round(list_cosine_similarity(q.embedding, v.embedding), 12) AS s FROM asked q JOIN vec v ON v.doc_id = q.doc_id)) WHERE n <= 5""",
     ["asked", "vec"])
view("vec_sources", """SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS BIGINT) AS rank, text, round(s, 4) AS score, importance_label
FROM (SELECT *, row_number() OVER (PARTITION BY query_id, text ORDER BY s DESC, vec_id) AS t FROM vec_top) WHERE t = 1""", ["vec_top"])


@query("vector_topk_f1", with_views("vec_sources", "SELECT query_id, doc_id, rank, text, score, importance_label FROM vec_sources"))
def vector_topk(spark, d):
    rows = op.vector_topk(vector_questions(spark, d), vectors(spark, d))
    return longs(rows.select("query_id", "doc_id", "rank", "text", "score", "importance_label"), "rank")


@query("vector_topk_by_join_f1", with_views("vec_sources", "SELECT query_id, doc_id, rank, text, score, importance_label FROM vec_sources"))
def vector_topk_by_join(spark, d):
    rows = op.vector_topk(vector_questions(spark, d), vectors(spark, d), block_rows=7)
    return longs(rows.select("query_id", "doc_id", "rank", "text", "score", "importance_label"), "rank")


@query("normalize_vectors_f2", """SELECT vec_id, round(e[1] / n, 5) AS first_value, round(list_sum(list_transform(e, lambda x: x * x / n / n)), 5) AS norm FROM (
 SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) AS n FROM embeddings WHERE len(embedding) = 64)""")
def normalize_vectors(spark, d):
    rows = op.normalize_vectors(samples.table(spark, d, "embeddings"), 64)
    return rows.select("vec_id", F.round(F.get("embedding", F.lit(0)), 5).alias("first_value"), F.round(F.aggregate(
        "embedding", F.lit(0.0), lambda a, x: a + x * x), 5).alias("norm"))


# --- keywords over ranked contract paragraphs
def stored_clauses(spark, d):
    return ranked(spark, d, ["responsible_party"]).select("doc_id", "rank", F.col("full_text").alias("text"), "clause_type",
                                   F.col("responsible_party").alias("party"), "importance_label")


def asked(spark, d):
    return samples.questions(spark, d)


view("kw_sources", r"""SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY least(0.9, n * CAST(0.15 AS DOUBLE)) DESC, crank) AS BIGINT) AS rank, text, clause_type, party, least(0.9, n * CAST(0.15 AS DOUBLE)) AS score, importance_label
FROM (SELECT q.query_id, q.doc_id, c.paragraph AS text, c.clause_type, c.responsible_party AS party, c.importance_label, c.rank AS crank, len(list_filter(q.ws, lambda w: contains(c.low, w))) AS n
 FROM (SELECT query_id, doc_id, list_distinct(list_filter(regexp_split_to_array(lower(question), '\s+'), lambda w: length(w) > 3)) AS ws FROM questions) q JOIN ranked c ON c.doc_id = q.doc_id) WHERE n > 0
QUALIFY rank <= 5""", ["questions", "ranked"])


@query("keyword_topk_f3", with_views("kw_sources", "SELECT query_id, doc_id, rank, text, clause_type, party, score, importance_label FROM kw_sources"))
def keyword_topk(spark, d):
    return longs(op.keyword_topk(asked(spark, d), stored_clauses(spark, d)), "rank")


@query("retrieve_f4", with_views("vec_sources", """SELECT query_id, rank, text, 'semantic' AS mode FROM vec_sources WHERE query_id % 2 = 0 UNION ALL
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY vec_id), text, 'keyword' FROM vec WHERE doc_id % 2 = 1 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY vec_id) <= 5"""))
def retrieve(spark, d):
    q = vector_questions(spark, d).withColumn("question", F.lit("Which clause applies?")).withColumn("indexed", F.col("query_id") % 2 == 0)
    v = vectors(spark, d)
    clauses = v.select("doc_id", F.col("vec_id").alias("rank"), "text", F.lit("").alias("clause_type"), F.lit("").alias("party"), "importance_label")
    return longs(op.retrieve(q, clauses, v).select("query_id", "rank", "text", "mode"), "rank")


def keyword_sources(spark, d):
    return op.keyword_topk(asked(spark, d), stored_clauses(spark, d))


@query("related_risks_f5", with_views("kw_sources norm_risks", """SELECT DISTINCT s.query_id, s.doc_id, r.seq, r.clause_text FROM kw_sources s JOIN norm_risks r ON r.doc_id = s.doc_id
WHERE r.severity IN ('high', 'medium') AND length(s.text) > 10 AND (contains(s.text, r.clause_text) OR contains(r.clause_text, s.text))"""))
def related_risks(spark, d):
    r = norm_risks(spark, d).select("doc_id", "seq", "clause_text", "severity", "risk_type", "explanation")
    return op.related_risks(written(keyword_sources(spark, d), "sources"), r).select("query_id", "doc_id", "seq", "clause_text")


@query("context_text_f13", with_views("kw_sources norm_risks", """SELECT query_id, body || coalesce(known, '') AS context FROM (
 SELECT query_id, string_agg('[' || upper(clause_type) || '] (Importance: ' || importance_label || ') ' || text, chr(10) || chr(10) ORDER BY rank) AS body FROM kw_sources GROUP BY query_id) b LEFT JOIN (
 SELECT query_id, chr(10) || chr(10) || 'KNOWN RISKS IN THIS CONTEXT:' || chr(10) || string_agg('- ' || upper(risk_type) || ' RISK (' || severity || '): ' || explanation || chr(10), '' ORDER BY seq) AS known FROM (
  SELECT DISTINCT s.query_id, r.seq, r.risk_type, r.severity, r.explanation FROM kw_sources s JOIN norm_risks r ON r.doc_id = s.doc_id
  WHERE r.severity IN ('high', 'medium') AND length(s.text) > 10 AND (contains(s.text, r.clause_text) OR contains(r.clause_text, s.text))) GROUP BY query_id) k USING (query_id)"""))
def context_text(spark, d):
    r = norm_risks(spark, d).select("doc_id", "seq", "clause_text", "severity", "risk_type", "explanation")
    return op.grounded_context(keyword_sources(spark, d), r)


@query("answer_confidence_g14", with_views("vec_sources", f"""SELECT query_id, {ieee_round("least(CAST(0.98 AS DOUBLE), greatest(CAST(0.1 AS DOUBLE), a + least(CAST(0.15 AS DOUBLE), n * CAST(0.04 AS DOUBLE)) + CASE WHEN crit THEN CAST(0.05 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END))")} AS confidence
FROM (SELECT query_id, avg(score) AS a, count(*) AS n, bool_or(importance_label = 'Critical') AS crit FROM vec_sources GROUP BY query_id)"""))
def answer_confidence(spark, d):
    return op.answer_confidence(op.vector_topk(vector_questions(spark, d), vectors(spark, d)))


# --- lookups
_term = rf"trim(regexp_replace(regexp_replace(trim(question), {text(fixed.LOOKUP_PREFIX)}, '', 'i'), '[?.!]+$', ''))"
view("terms", f"SELECT query_id, doc_id, CASE WHEN length({_term}) >= 2 THEN {_term} END AS term FROM questions", ["questions"])


@query("search_term_f6", with_views("terms", "SELECT query_id, term FROM terms"))
def search_term(spark, d):
    return op.search_term(samples.spread(asked(spark, d))).select("query_id", "term")


_order = "CASE bucket " + " ".join(f"WHEN '{b}' THEN {i}" for i, (b, _) in enumerate(fixed.LOOKUP_BUCKETS)) + " END"
_role_of = "coalesce(CASE t " + " ".join(f"WHEN {text(k)} THEN {text(v)}" for k, v in fixed.ROLE_ALIASES.items()) + " END, t)"


@query("resolve_role_f7", with_views("terms party_names entities", f"""
SELECT q.query_id, q.doc_id, p.name AS text, 'role' AS match_type FROM (SELECT *, {_role_of} AS r FROM (SELECT query_id, doc_id, lower(term) AS t FROM terms)) q
JOIN party_names p ON p.doc_id = q.doc_id AND p.role IN (q.r, q.t) QUALIFY row_number() OVER (PARTITION BY q.query_id ORDER BY p.role, p.name) = 1"""))
def resolve_role(spark, d):
    return _resolved(spark, d).filter("match_type = 'role'").select("query_id", "doc_id", "text", "match_type")


def _resolved(spark, d):
    es = written(ent.display_value(entities(spark, d)), "entities")
    terms = op.search_term(label_op.question_intent(asked(spark, d), "question"))
    return op.resolve_entity(terms.select("query_id", "doc_id", "term"), es, ent.parties_map(es))


# --- all questions in one plan
view("told", f"SELECT query_id, doc_id, term, {INTENT} AS intent FROM (SELECT q.query_id, q.doc_id, trim(q.question) AS q, t.term FROM questions q JOIN terms t ON t.query_id = q.query_id)",
     ["questions", "terms"])
_alias_of = "CASE t " + " ".join(f"WHEN {text(k)} THEN {text(v)}" for k, v in fixed.ORG_ALIASES.items()) + " END"
_near_term = lambda c: f"(contains(lower({c}), t) OR contains(t, lower({c})))"


def d_resolved(terms: str) -> str:
    """First hit of each term of ``terms(query_id, doc_id, t)``: role, entity, alias, display."""
    return f"""
WITH l AS (SELECT *, {_role_of} AS r, {_alias_of} AS alias FROM ({terms})),
e AS (SELECT * FROM (SELECT *, {_order} AS o FROM entities) WHERE o IS NOT NULL)
SELECT query_id, doc_id, text, category, match_type FROM (
 SELECT query_id, l.doc_id, 'parties' AS category, 0 AS p, 0 AS o, '' AS s, 0 AS place, role AS k, name AS text, 'role' AS match_type FROM l JOIN party_names n ON n.doc_id = l.doc_id AND n.role IN (r, t)
 UNION ALL SELECT query_id, l.doc_id, bucket, 1, o, source, start_char, text, text, CASE WHEN lower(text) = t THEN 'exact' ELSE 'partial' END FROM l JOIN e ON e.doc_id = l.doc_id WHERE {_near_term('text')}
 UNION ALL SELECT query_id, l.doc_id, bucket, 2, o, source, start_char, text, text, 'alias' FROM l JOIN e ON e.doc_id = l.doc_id WHERE bucket = 'parties' AND contains(lower(text), alias)
 UNION ALL SELECT query_id, l.doc_id, bucket, 3, o, source, start_char, text, display, 'simple' FROM l JOIN e ON e.doc_id = l.doc_id WHERE {_near_term('display')})
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY p, o, s, place, k) = 1"""


_TERM = "SELECT query_id, doc_id, lower(trim(term)) AS t FROM {} WHERE term IS NOT NULL"
view("resolved", d_resolved(_TERM.format("told") + " AND intent = 'entity_lookup'"), ["told", "entities", "party_names"])
view("resolved_terms", d_resolved(_TERM.format("terms")), ["terms", "entities", "party_names"])


@query("resolve_entity_f7", with_views("resolved_terms", "SELECT query_id, doc_id, text, category, match_type FROM resolved_terms"))
def resolve_entity(spark, d):
    return _resolved(spark, d)


_sure = ieee_round("least(CAST(0.98 AS DOUBLE), greatest(CAST(0.1 AS DOUBLE), a + least(CAST(0.15 AS DOUBLE), n * CAST(0.04 AS DOUBLE)) + CASE WHEN crit THEN CAST(0.05 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END))")


@query("answer_questions_f7_f13", with_views("told resolved entities kw_sources norm_risks", f"""
SELECT t.query_id, t.doc_id, t.intent, CASE WHEN t.intent IN ('greeting', 'help', 'off_topic') THEN 'canned' WHEN t.intent = 'entity_query' THEN 'entities' WHEN r.text IS NOT NULL THEN 'lookup' ELSE 'retrieval' END AS route,
  CASE WHEN t.intent = 'entity_query' THEN coalesce(listed, '') ELSE r.text END AS answer, r.match_type,
  CASE WHEN is_open THEN body || coalesce(known, '') END AS context, CASE WHEN is_open THEN coalesce(sure, CAST(0 AS DOUBLE)) END AS confidence, CASE WHEN is_open THEN coalesce(n, 0) END AS n_sources
FROM (SELECT told.*, intent IN ('legal_analysis', 'document_qa') OR intent = 'entity_lookup' AND query_id NOT IN (SELECT query_id FROM resolved) AS is_open FROM told) t
LEFT JOIN resolved r USING (query_id)
LEFT JOIN (SELECT doc_id, string_agg(display, '; ' ORDER BY bucket, display) AS listed FROM entities GROUP BY doc_id) e ON e.doc_id = t.doc_id
LEFT JOIN (SELECT query_id, string_agg('[' || upper(clause_type) || '] (Importance: ' || importance_label || ') ' || text, chr(10) || chr(10) ORDER BY rank) AS body, n, {_sure} AS sure
  FROM (SELECT *, avg(score) OVER w AS a, count(*) OVER w AS n, bool_or(importance_label = 'Critical') OVER w AS crit FROM kw_sources WINDOW w AS (PARTITION BY query_id)) GROUP BY query_id, a, n, crit) b ON b.query_id = t.query_id
LEFT JOIN (SELECT query_id, chr(10) || chr(10) || 'KNOWN RISKS IN THIS CONTEXT:' || chr(10) || string_agg('- ' || upper(risk_type) || ' RISK (' || severity || '): ' || explanation || chr(10), '' ORDER BY seq) AS known FROM (
  SELECT DISTINCT s.query_id, r.seq, r.risk_type, r.severity, r.explanation FROM kw_sources s JOIN norm_risks r ON r.doc_id = s.doc_id
  WHERE r.severity IN ('high', 'medium') AND length(s.text) > 10 AND (contains(s.text, r.clause_text) OR contains(r.clause_text, s.text))) GROUP BY query_id) k ON k.query_id = t.query_id"""))
def answer_questions(spark, d):
    def clauses_of(ids):
        paras = segment_op.paragraphs(samples.contract_text(spark, d).join(ids, "doc_id", "left_semi"))
        found = clause_op.describe_clauses(paras.select("doc_id", "para_no", F.lit(0).alias("pos"), F.col("paragraph").alias("clause"), F.col("paragraph").alias("full_text")),
                                           only=["responsible_party"])
        return clause_op.rank_clauses(clause_op.dedup_clauses(found)).select(
            "doc_id", "rank", F.col("full_text").alias("text"), "clause_type", F.col("responsible_party").alias("party"), "importance_label")
    r = norm_risks(spark, d).select("doc_id", "seq", "clause_text", "severity", "risk_type", "explanation")
    return answer_plan.answer_questions(asked(spark, d), samples.marked_text(spark, d), None, r, clauses_of)


# --- summaries
_score = (" + ".join(f"CASE WHEN contains(lower(sentence), '{w}') THEN 3 ELSE 0 END" for w in fixed.SCORE_WORDS)
          + r" + CASE WHEN regexp_matches(sentence, '[0-9]') THEN 2 ELSE 0 END"
          + f" + CASE WHEN regexp_matches(sentence, {text(fixed.SECTION_REFERENCE)}, 'i') THEN 3 ELSE 0 END"
          + f" + CASE WHEN regexp_matches(sentence, {text(fixed.CURRENCY)}, 'i') THEN 3 ELSE 0 END")


@query("extractive_summary_h4_i3", with_views("sentences", f"""
SELECT d.doc_id, coalesce(s.t, '') AS extractive_summary FROM documents d LEFT JOIN (SELECT doc_id, string_agg('- ' || sentence, chr(10) ORDER BY pos) AS t FROM (
 SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS n FROM (SELECT doc_id, pos, sentence, {_score} AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, sentence ORDER BY pos) AS k FROM sentences) WHERE k = 1)) WHERE n <= 10 GROUP BY doc_id) s ON s.doc_id = d.doc_id"""))
def extractive_summary(spark, d):
    return sm.extractive_summary(samples.documents(spark, d)).drop("text")


view("contract_sentences", f"SELECT doc_id, CAST(unnest(range(len(l))) AS BIGINT) AS pos, unnest(l) AS sentence FROM (SELECT doc_id, {d_sentences('text')} AS l FROM contract_text)", ["contract_text"])


@query("sentence_score_h5", with_views("contract_sentences", f"SELECT doc_id, pos, CAST({_score} AS BIGINT) AS score FROM contract_sentences"))
def sentence_score(spark, d):
    rows = samples.contract_text(spark, d).select("doc_id", F.posexplode(segmenting.sentences(F.col("text"))).alias("pos", "sentence"))
    return longs(sm.sentence_score(rows).drop("sentence"), "pos")


@query("lead_summary_h6", f"SELECT doc_id, array_to_string(({d_sentences_raw('text')})[1:6], ' ') AS lead_summary FROM documents")
def lead_summary(spark, d):
    return sm.lead_summary(samples.documents(spark, d)).drop("text")


def d_ranked(name: str, source: str, keep: int, rounds: int = 20) -> str:
    """CTEs that end in ``{name}(uid, summary)``: the ranking formula over ``source(uid, text)``, pair by pair."""
    r = name + "_"
    ctes = [f"{r}t AS MATERIALIZED (SELECT uid, {d_sentences('text')} AS l FROM {source})",
            f"{r}s AS MATERIALIZED (SELECT uid, len(l) AS n, unnest(range(len(l))) AS i, unnest(l) AS sentence FROM {r}t WHERE len(l) > {keep})",
            rf"{r}w AS (SELECT uid, i, ln(greatest(len(ws), 1)) AS lg, unnest(ws) AS w FROM (SELECT uid, i, list_distinct(regexp_extract_all(lower(sentence), '[\p{{L}}\p{{N}}_]+')) AS ws FROM {r}s))",
            f"{r}e AS MATERIALIZED (SELECT a.uid, a.i, b.i AS j, count(*) / (a.lg + b.lg) AS wt FROM {r}w a JOIN {r}w b ON a.uid = b.uid AND a.w = b.w AND a.i <> b.i "
            f"WHERE a.lg + b.lg > 0 GROUP BY a.uid, a.i, b.i, a.lg, b.lg)",
            f"{r}p AS MATERIALIZED (SELECT uid, i, j, wt / sum(wt) OVER (PARTITION BY uid, i) AS part FROM {r}e)",
            f"{r}r0 AS (SELECT uid, i, n, CAST(1.0 AS DOUBLE) / n AS score FROM {r}s)"]
    ctes += [f"{r}r{k} AS MATERIALIZED (SELECT o.uid, o.i, o.n, CAST(0.15 AS DOUBLE) / o.n + CAST(0.85 AS DOUBLE) * coalesce(g, 0) AS score FROM {r}r{k - 1} o LEFT JOIN "
             f"(SELECT e.uid, e.j AS i, sum(part * score) AS g FROM {r}p e JOIN {r}r{k - 1} x ON x.uid = e.uid AND x.i = e.i GROUP BY 1, 2) q ON q.uid = o.uid AND q.i = o.i)"
             for k in range(1, rounds + 1)]
    ctes += [f"{r}b AS (SELECT uid, i, row_number() OVER (PARTITION BY uid ORDER BY round(score, 12) DESC, i) AS place FROM {r}r{rounds})",
             f"{name} AS MATERIALIZED (SELECT uid, coalesce(string_agg(sentence, ' ' ORDER BY i), '') AS summary FROM {r}b JOIN {r}s USING (uid, i) WHERE place <= {keep} GROUP BY uid "
             f"UNION ALL SELECT uid, array_to_string(l, ' ') FROM {r}t WHERE len(l) <= {keep})"]
    return ",\n".join(ctes)


@query("graph_rank_summary_h7", "WITH rows AS (SELECT row_number() OVER () AS uid, doc_id, coalesce(text, '') AS text FROM documents),\n" + d_ranked("made", "rows", 6)
       + " SELECT doc_id, summary AS graph_summary FROM rows JOIN made USING (uid)")
def graph_rank_summary(spark, d):
    return sm.graph_rank_summary(samples.documents(spark, d)).drop("text")


_WINDOWS = 150
#: Levels of the SQL: enough for 6 ** 3 chunks a document.
_LEVELS = 3


def d_levels() -> str:
    """Chunk summaries, then groups of six summarised again until a document has one."""
    ctes = [f"chunks AS (SELECT doc_id, i, t, row_number() OVER () AS uid FROM (SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS t FROM (SELECT doc_id, {d_grouped('w', _WINDOWS)} AS l "
            f"FROM (SELECT doc_id, {d_words('text')} AS w FROM documents))))",
            "in0 AS (SELECT uid, t AS text FROM chunks)", d_ranked("out0", "in0", 3),
            "l0 AS (SELECT doc_id, i, summary AS t, count(*) OVER (PARTITION BY doc_id) AS n FROM chunks JOIN out0 USING (uid))"]
    for k in range(1, _LEVELS + 1):
        ctes += [f"g{k} AS (SELECT row_number() OVER () AS uid, doc_id, i, t FROM (SELECT doc_id, i // 6 AS i, string_agg(t, ' ' ORDER BY i) AS t FROM l{k - 1} WHERE n > 1 GROUP BY 1, i // 6))",
                 f"in{k} AS (SELECT uid, t AS text FROM g{k})", d_ranked(f"out{k}", f"in{k}", 4),
                 f"l{k} AS (SELECT doc_id, i, summary AS t, count(*) OVER (PARTITION BY doc_id) AS n FROM g{k} JOIN out{k} USING (uid))"]
    return "WITH " + ",\n".join(ctes) + " " + " UNION ALL ".join(f"SELECT doc_id, t AS summary FROM l{k} WHERE n = 1" for k in range(_LEVELS + 1))


@query("reduce_summaries_h8", d_levels())
def reduce_summaries(spark, d):
    chunks = samples.documents(spark, d).select("doc_id", F.posexplode(segmenting.word_windows(F.col("text"), _WINDOWS)).alias("chunk_index", "chunk_text"))
    return sm.reduce_summaries(chunks)

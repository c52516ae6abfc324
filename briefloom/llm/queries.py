"""Registered queries of the numbered operators, with the DuckDB SQL that gives the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from briefloom.llm import exact, fingerprints, htmlmain, jaccard, mixing, packing, paragraphs, prefix_trie, quality, secret_scan, sharding, spelling, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_secret_ownership")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*secret_scan.BASE_KINDS))
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *[number(k).alias(f"n_{k}") for k in secret_scan.BASE_KINDS], F.sha2(secret_scan.span_list(base), 256).alias("base_sha256"),
                        secret_scan.span_list(F.col("spans")).alias("spans"), F.col("copied").alias("n_copied"), F.col("live").alias("n_live"))


MIX_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
placed AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS place FROM per),
weighed AS (SELECT *, CASE place % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM placed),
cuts AS (SELECT *, 3 * source_size / weight AS cut_at FROM weighed),
levels AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY cut_at, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY cut_at, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM cuts),
targets AS (SELECT source, place, source_size, least(3 * source_size::DOUBLE, weight * max(lv) OVER ()) AS target,
  greatest(1, ceil(source_size / {mixing.BLOCK_WORDS}))::BIGINT AS blocks FROM levels),
words AS (SELECT *, least(floor(target + 0.5)::BIGINT, 3 * source_size) AS w FROM targets),
quotas AS (SELECT *, w // greatest(source_size, 1) AS passes, w % greatest(source_size, 1) AS rest FROM words),
docs AS (SELECT d.doc_id, d.size, q.*, ('0x' || substr(md5('{mixing.SEED}|block|' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 15))::BIGINT % q.blocks AS block
  FROM sized d JOIN quotas q ON d.source IS NOT DISTINCT FROM q.source),
ordered AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY place
    ORDER BY ('0x' || substr(md5('{mixing.SEED}|order|' || place || '|' || block), 1, 15))::BIGINT, block,
             ('0x' || substr(md5('{mixing.SEED}|inside|' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT, doc_id, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM docs)
SELECT doc_id, size, source_size, target, CAST(passes * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM ordered
"""


@query("op2_mix_sources", MIX_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    taken = F.aggregate("takes", F.lit(0).cast("long"), lambda a, t: a + t["words"])
    return mixed.select("kept.doc_id", "size", "source_size", "target", taken.alias("taken"))


@query("op3_pack_along_curve")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op4_toxicity_trees")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out(F.col("doc_id")))
    scored = model.score(docs, ["doc_id"])
    return scored.select("doc_id", F.coalesce(toxicity.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")


@query("op5_repeated_passages")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.repeated_passages(table(spark, sf_dir, "documents"))


@query("op6_jaccard_forest")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "class_id", "class_size", "n_links")


@query("op7_weighted_samples")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


EXACT_SQL = """
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC) = 1 AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)
"""


@query("op8_exact_dedup", EXACT_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.mark_duplicates(table(spark, sf_dir, "documents"))


@query("op9_html_main_text")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = htmlmain.extract(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


SHARD_NAMES = [f"shard-{i:02d}" for i in range(16)]
SHARD_SQL = f"""
WITH RECURSIVE shards AS (
  SELECT i, 'shard-' || lpad(i::VARCHAR, 2, '0') AS name,
    ('0x' || substr(md5('offset|shard-' || lpad(i::VARCHAR, 2, '0')), 1, 15))::BIGINT % {sharding.TABLE_SIZE} AS place,
    ('0x' || substr(md5('skip|shard-' || lpad(i::VARCHAR, 2, '0')), 1, 15))::BIGINT % {sharding.TABLE_SIZE - 1} + 1 AS skip
  FROM range({len(SHARD_NAMES)}) r(i)),
prefs AS (SELECT i, list((place + j * skip) % {sharding.TABLE_SIZE} ORDER BY j) AS wish FROM shards, range({sharding.TABLE_SIZE}) s(j) GROUP BY i),
fill(turn, slot, owners) AS (
  SELECT 0, -1::BIGINT, list_transform(range({sharding.TABLE_SIZE}), lambda x: -1)
  UNION ALL
  SELECT turn + 1, got, list_transform(owners, lambda o, k: CASE WHEN k = got + 1 THEN i ELSE o END)
  FROM (SELECT f.turn, f.owners, p.i, list_extract(list_filter(p.wish, lambda s: f.owners[s + 1] < 0), 1) AS got
        FROM fill f JOIN prefs p ON p.i = f.turn % {len(SHARD_NAMES)} WHERE f.turn < {sharding.TABLE_SIZE})),
slots AS (SELECT unnest(owners) AS i, unnest(range({sharding.TABLE_SIZE})) AS slot FROM fill WHERE turn = {sharding.TABLE_SIZE})
SELECT d.doc_id, s.slot, 'shard-' || lpad(s.i::VARCHAR, 2, '0') AS shard
FROM (SELECT doc_id, ('0x' || substr(md5('key|' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT % {sharding.TABLE_SIZE} AS slot FROM documents) d
JOIN slots s ON s.slot = d.slot
"""


@query("op10_shard_placement", SHARD_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.place(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], SHARD_NAMES)
    return placed.select("doc_id", "slot", "shard")


def crc_sql(strings: str) -> str:
    """CTEs that end in ``crc(s, h)``: the unsigned CRC-32 of each distinct string ``s`` of the relation ``strings(s)``."""
    return f"""
bits(i, k, c) AS (SELECT i, 0, i FROM range(256) r(i) UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS tb FROM bits WHERE k = 8),
steps(s, x, p, c) AS (SELECT s, hex(encode(s)), 0, 4294967295::BIGINT FROM (SELECT DISTINCT s FROM {strings}) UNION ALL
  SELECT s, x, p + 1, xor(tb[(xor(c, ('0x' || substr(x, 2 * p + 1, 2))::BIGINT) & 255) + 1], c >> 8) FROM steps, tab WHERE 2 * p < length(x)),
crc AS (SELECT s, xor(c, 4294967295) AS h FROM steps WHERE 2 * p = length(x))"""


SPELLING_SQL = f"""
WITH RECURSIVE runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(text, '{spelling.UPPER}', '{spelling.LOWER}'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
long AS (SELECT run, id || ':' || run AS s FROM runs WHERE length(run) >= 6), {crc_sql("long")},
made AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM long JOIN crc USING (s)),
w AS (SELECT word, count(*) AS n FROM made WHERE length(word) >= 6 GROUP BY word HAVING count(*) >= 5),
cuts AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)),
near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM cuts a JOIN cuts b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cuts c JOIN w ON c.rest = w.word
  UNION SELECT w.word, c.word, c.n FROM cuts c JOIN w ON c.rest = w.word),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-m, encode(other))) AS other, max(m) AS m FROM near GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= 5 * n THEN other END AS form, CASE WHEN m >= 5 * n THEN m END::BIGINT AS form_n
  FROM w LEFT JOIN best USING (word)),
chain(word, root) AS (SELECT word, word FROM forms UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL),
roots AS (SELECT c.word, c.root FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NULL)
SELECT word, n, n_near, form, form_n, root FROM forms JOIN roots USING (word)
"""


@query("op11_spelling_variants", SPELLING_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(spelling.words(table(spark, sf_dir, "documents")))


QUALITY_SQL = """
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws,
  list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines FROM t),
one AS (SELECT r, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM w),
win AS (SELECT r, i, word, lead(word, 1) OVER o AS w2, lead(word, 2) OVER o AS w3 FROM one WINDOW o AS (PARTITION BY r ORDER BY i)),
again AS (SELECT r, i, count(*) OVER (PARTITION BY r, word, w2, w3) AS times FROM win WHERE w3 IS NOT NULL),
inside AS (SELECT r, count(DISTINCT i + k) AS n FROM again, range(3) ks(k) WHERE times > 1 GROUP BY r),
tops AS (SELECT r, max(n) AS n FROM (SELECT r, word, count(*) AS n FROM one GROUP BY r, word) GROUP BY r),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
  coalesce(i.n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines, coalesce(tops.n, 0) AS top_word,
  len(list_filter(ws, lambda x: regexp_matches(x, '\\p{L}'))) AS lettered, length(regexp_replace(text, '\\P{L}+', '', 'g')) AS letters,
  length(regexp_replace(text, '\\P{Lu}+', '', 'g')) AS capitals
  FROM w LEFT JOIN inside i USING (r) LEFT JOIN tops USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 12 * n_words OR 10 * lettered < 7 * n_words
    OR 10 * capitals > 6 * letters OR 10 * top_word > 3 * n_words OR 2 * n_dup_lines > n_lines) AS kept FROM b
"""


@query("op12_quality_cascade", QUALITY_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    judged = quality.judge(docs, quality.cascade(docs), ["doc_id"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


TRIE_SQL = f"""
WITH RECURSIVE t AS (
  SELECT conv_id, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS content, length(coalesce(text, '')) AS chars, turn
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, content) AS pos FROM t),
strings AS (SELECT DISTINCT conv_id::VARCHAR AS s FROM own), {crc_sql("strings")},
ids AS (SELECT o.conv_id, o.n, h % 6 AS h, coalesce(least(h % 6, l.n), 0) AS taken FROM (SELECT conv_id, max(pos) AS n FROM own GROUP BY 1) o
  JOIN crc ON s = o.conv_id::VARCHAR LEFT JOIN (SELECT conv_id, max(pos) AS n FROM own GROUP BY 1) l ON l.conv_id = o.conv_id - o.conv_id % 100),
made AS (SELECT i.conv_id, o.pos AS depth, content, chars FROM ids i JOIN own o ON o.conv_id = i.conv_id - i.conv_id % 100 AND o.pos <= i.taken
  UNION ALL SELECT i.conv_id, i.taken + o.pos - i.h, content, chars FROM ids i JOIN own o ON o.conv_id = i.conv_id AND o.pos > i.h),
paths AS (SELECT *, sha256(string_agg(content, '' ORDER BY depth) OVER (PARTITION BY conv_id ORDER BY depth)) AS path FROM made
  UNION ALL SELECT conv_id, 0, NULL, 0, '' FROM ids),
named AS (SELECT *, lag(path) OVER (PARTITION BY conv_id ORDER BY depth) AS parent, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM paths),
nodes AS (SELECT path, min(conv_id) AS conv_id, min(depth) AS depth, min(parent) AS parent, min(chars) AS chars, count(*) AS n_convs,
  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM named GROUP BY path),
kids AS (SELECT parent AS path, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY 1),
sums AS (SELECT a.path, count(*) FILTER (k.n IS NULL) AS n_leaves, sum((x.n_convs - 1) * x.chars) AS saved
  FROM nodes x LEFT JOIN kids k ON k.path = x.path JOIN paths a ON a.conv_id = x.conv_id AND a.depth <= x.depth GROUP BY 1)
SELECT x.conv_id, x.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, x.n_convs, coalesce(k.n, 0)::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves,
  saved::BIGINT AS saved_tokens, x.ends_sha256
FROM nodes x LEFT JOIN nodes p ON p.path = x.parent LEFT JOIN kids k ON k.path = x.path JOIN sums ON sums.path = x.path
"""


@query("op13_conversation_trie", TRIE_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)

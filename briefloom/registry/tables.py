"""Queries of the stored-table operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import segmenting
from ..operators import entities as ent_op
from ..operators import retrieval as ret
from ..operators import summaries as sm
from ..plans import briefing as plan
from ..plans.placement import written
from ..sources import samples
from ..sources import tables as op
from . import query
from .clauses import ranked
from .segments import longs
from .sql import with_views

table = samples.table


def _orders(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"),
                                            F.col("o_orderdate").alias("upload_date"), F.col("o_totalprice").alias("price"))


_ORDERS = "(SELECT o_orderkey AS id, o_custkey AS user_id, o_orderdate AS upload_date FROM orders)"


@query("newest_documents_a1", f"SELECT id, user_id FROM {_ORDERS} ORDER BY upload_date DESC, id DESC LIMIT 200")
def newest_documents(spark, d):
    return op.newest(_orders(spark, d)).select("id", "user_id")


@query("newest_per_owner_a1", f"""SELECT id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY upload_date DESC, id DESC) AS n FROM {_ORDERS}) WHERE n <= 5""")
def newest_per_owner(spark, d):
    return op.newest(_orders(spark, d), 5, "user_id").select("id", "user_id")


@query("latest_turn_a3", """SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC) AS n FROM conversations) WHERE n = 1""")
def latest_turn(spark, d):
    return op.latest_per_key(table(spark, d, "conversations").select("conv_id", "turn", "role", "text"), "conv_id", ["turn", "role"])


_PRIMARY = "CASE WHEN doc_id % 5 = 0 THEN '  ' WHEN doc_id % 7 = 0 THEN '' ELSE text END"


def _sources(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    primary = docs.filter("doc_id % 4 <> 1").select("doc_id", F.expr(_PRIMARY).alias("text"))
    legacy = docs.filter("doc_id % 3 = 0").select("doc_id", F.concat(F.lit("old "), F.col("text")).alias("text"))
    spill = docs.filter("doc_id % 2 = 0").select("doc_id", F.concat(F.lit("spilled "), F.col("text")).alias("text"))
    return docs, primary, legacy, spill


_SIDES = f"""(SELECT d.doc_id, CASE WHEN d.doc_id % 4 <> 1 THEN {_PRIMARY.replace('text', 'd.text').replace('doc_id', 'd.doc_id')} END AS p,
 CASE WHEN doc_id % 3 = 0 THEN 'old ' || text END AS l, CASE WHEN doc_id % 2 = 0 THEN 'spilled ' || text END AS s FROM documents d)"""


@query("resolve_text_a4", f"""SELECT doc_id, CASE WHEN trim(p) <> '' THEN p ELSE coalesce(trim(s, ' '||chr(10)), '') END AS text,
 CASE WHEN trim(p) <> '' THEN 'primary' WHEN trim(s) <> '' THEN 'spill' ELSE 'none' END AS text_source FROM {_SIDES}""")
def resolve_text(spark, d):
    return op.resolve_text(*_sources(spark, d))


@query("resolve_text_keeping_blank_a4", f"""SELECT doc_id, CASE WHEN coalesce(p, l, '') <> '' THEN coalesce(p, l) ELSE coalesce(s, '') END AS text,
 CASE WHEN coalesce(p, l, '') = '' THEN CASE WHEN trim(s) <> '' THEN 'spill' ELSE 'none' END WHEN p IS NOT NULL THEN 'primary' ELSE 'legacy' END AS text_source FROM {_SIDES}""")
def resolve_text_keeping_blank(spark, d):
    return op.resolve_text(*_sources(spark, d), blank_is_missing=False)


_PAGE = "CASE WHEN turn % 3 = 1 THEN '  ' ELSE text END"


@query("assemble_pages_a5", f"""SELECT conv_id, coalesce(string_agg(t, chr(10) || chr(10) ORDER BY turn) FILTER (WHERE t <> ''), '') AS text, count(*) AS page_count
FROM (SELECT conv_id, turn, trim({_PAGE}, ' '||chr(10)||chr(13)||chr(9)) AS t FROM conversations) GROUP BY conv_id""")
def assemble_pages(spark, d):
    return op.assemble_pages(table(spark, d, "conversations").withColumn("text", F.expr(_PAGE)), "conv_id", "turn")


@query("assemble_paragraphs_a6", f"""SELECT conv_id, trim(string_agg({_PAGE}, chr(10) ORDER BY turn), ' '||chr(10)||chr(13)||chr(9)) AS text FROM conversations GROUP BY conv_id""")
def assemble_paragraphs(spark, d):
    return op.assemble_paragraphs(table(spark, d, "conversations").withColumn("text", F.expr(_PAGE)), "conv_id", "turn").drop("page_count")


_NAME = ("concat(regexp_replace(url, '[?].*', ''), CASE page_id % 5 WHEN 0 THEN '.PDF' WHEN 1 THEN '.docx' WHEN 2 THEN '.doc' WHEN 3 THEN '.txt' ELSE '' END)")


@query("route_by_extension_a7", f"""SELECT page_id, extension, CASE extension WHEN '.pdf' THEN 'pymupdf' WHEN '.docx' THEN 'docx' END AS method,
 CASE WHEN extension = '.doc' THEN 'legacy .doc is not supported' WHEN extension NOT IN ('.pdf', '.docx') THEN 'unsupported file type: ' || extension END AS reject_reason
FROM (SELECT page_id, CASE WHEN e <> '' THEN '.' || e ELSE '' END AS extension FROM (SELECT page_id, regexp_extract(lower({_NAME}), '[^/]\\.([^./\\s]+)$', 1) AS e FROM pages))""")
def route_by_extension(spark, d):
    rows = table(spark, d, "pages").select("page_id", F.expr(_NAME).alias("name"))
    return op.route_by_extension(rows, "name").drop("name")


@query("storage_path_a8", r"""SELECT page_id, (CASE WHEN page_id % 3 = 0 THEN 'public' ELSE 'user-' || page_id % 7 END) || '/' || page_id || '/' ||
 left(regexp_replace(regexp_replace(replace(trim(url), '/', '_'), '[^a-zA-Z0-9._-]+', '_', 'g'), '_+', '_', 'g'), 180) AS object_path FROM pages""")
def storage_path(spark, d):
    rows = table(spark, d, "pages").select("page_id", "url", F.expr("CASE WHEN page_id % 3 = 0 THEN '' ELSE concat('user-', page_id % 7) END").alias("owner"))
    return op.storage_path(rows, "owner", "page_id", "url").select("page_id", "object_path")


_URL = "concat('https://host.example.com/storage/v1/object/public/', CASE WHEN page_id % 4 = 0 THEN 'other' ELSE 'docs' END, '/u+', page_id, '/my%20deed%2B', page_id, '.pdf/?v=1')"


@query("object_path_a9", """SELECT page_id, CASE WHEN page_id % 4 <> 0 THEN 'u+' || page_id || '/my deed+' || page_id || '.pdf' END AS object_path FROM pages""")
def object_path(spark, d):
    rows = table(spark, d, "pages").select("page_id", F.expr(_URL).alias("url"))
    return op.object_path_from_url(rows, "url", "docs").drop("url")


@query("replace_by_key_a10_i4", """SELECT doc_id, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'quality ' || quality FROM labels""")
def replace_by_key(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    new = table(spark, d, "labels").select("doc_id", F.concat(F.lit("quality "), "quality").alias("text"))
    return op.replace_by_key(docs, new)


@query("cascade_delete_a11", """SELECT 'orders' AS table_name, count(*) AS deleted FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL
SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def cascade_delete(spark, d):
    orders = table(spark, d, "orders").withColumnRenamed("o_orderkey", "doc_id")
    lines = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "doc_id")
    return op.cascade_delete({"orders": orders, "lineitem": lines}, orders.filter("o_orderpriority = '1-URGENT'"))[1]


@query("left_after_delete_a11", """SELECT count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS key_sum FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def left_after_delete(spark, d):
    orders = table(spark, d, "orders").withColumnRenamed("o_orderkey", "doc_id")
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"))
    left, _ = op.cascade_delete({"lineitem": lines}, orders.filter("o_orderpriority = '1-URGENT'"))
    return left["lineitem"].agg(F.count("*").alias("n"), F.sum("doc_id").alias("key_sum"))


@query("upsert_a12", """SELECT vec_id, label, CASE WHEN label % 2 = 1 THEN vec_id % 10 ELSE -1 END AS version FROM embeddings UNION ALL
SELECT vec_id + 1000000000, -1, 5 FROM embeddings WHERE label % 2 = 1""")
def upsert(spark, d):
    base = table(spark, d, "embeddings").select("vec_id", "label", F.lit(-1).cast("long").alias("version"))
    odd = table(spark, d, "embeddings").filter("label % 2 = 1")
    updates = odd.select("vec_id", "label", F.expr("vec_id % 10").alias("version"), F.lit(2).alias("seq"))
    older = odd.select("vec_id", "label", F.lit(99).cast("long").alias("version"), F.lit(1).alias("seq"))
    added = odd.select((F.col("vec_id") + 1000000000).alias("vec_id"), F.lit(-1).alias("label"), F.lit(5).cast("long").alias("version"), F.lit(3).alias("seq"))
    target = base.withColumn("seq", F.lit(0))
    return op.upsert(target, updates.unionByName(older).unionByName(added), "vec_id", "seq").drop("seq")


@query("delete_by_ids_a13", "SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def delete_by_ids(spark, d):
    ids = table(spark, d, "labels").select(F.expr("CASE WHEN toxic = 1 THEN doc_id END").alias("gone"))
    return op.delete_by_ids(table(spark, d, "embeddings").select("vec_id", "label"), ids, "vec_id", "gone")


@query("vector_rows_a14", with_views("ranked", """SELECT doc_id || '_clause_' || (rank - 1) AS vec_id, doc_id, clause_type, responsible_party AS party, importance_label, round(len(paragraph) / 7.0, 3) AS first_value FROM ranked"""))
def vector_rows(spark, d):
    clauses = written(ranked(spark, d, ["responsible_party"]).select(
        "doc_id", "rank", "clause_type", "responsible_party", "importance_label", "full_text"), "clauses")
    vectors = clauses.select("doc_id", (F.col("rank") - 1).alias("clause_no"), F.array(F.length("full_text") / 7.0).alias("embedding"))
    rows = ret.vector_rows(clauses, vectors)
    return rows.select("vec_id", "doc_id", "clause_type", "party", "importance_label", F.round(F.get("embedding", F.lit(0)), 3).alias("first_value"))


@query("analysis_record_a16")
def analysis_record(spark, d):
    docs = plan.cleaned(samples.marked_text(spark, d), "contract")
    docs = ent_op.entities_in_row(docs, only=["bucket", "start_char", "text", "confidence", "role"], carry=["contract"])
    docs = sm.extractive_summary(docs, text="contract")
    chunks = segmenting.chunk_text(F.col("contract"), 60, 90, 10)
    return op.analysis_in_row(docs.select("doc_id", F.col("contract").alias("cleaned_text"), "extractive_summary", F.col("_es").alias("entities"), chunks.alias("chunks")))


@query("chunk_rows_a17", """SELECT doc_id, CAST(unnest(range(len(c))) AS BIGINT) AS chunk_index, unnest(c) AS chunk_text FROM (
 SELECT doc_id, CASE WHEN doc_id % 3 = 0 OR length(text) = 0 THEN [text] ELSE [left(text, 50), substr(text, 51)] END AS c FROM documents)""")
def chunk_rows(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", F.expr(
        "CASE WHEN doc_id % 3 = 0 THEN NULL WHEN length(text) = 0 THEN array() ELSE array(left(text, 50), substring(text, 51)) END").alias("chunks"))
    return longs(op.chunk_rows(docs), "chunk_index")

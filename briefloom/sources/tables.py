"""Stored tables: newest and latest rows, text fallbacks, assembling texts, names and paths, replacing and deleting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import strip

METHODS = {".pdf": "pymupdf", ".docx": "docx"}
LEGACY_EXTENSION = ".doc"
NAME_CHARS = 180


# --- choosing rows -----------------------------------------------------------------------

def newest(df: DataFrame, n: int = 200, owner: str | None = None, order: str = "upload_date", tie: str = "id") -> DataFrame:
    """The newest ``n`` rows, overall or per owner. Both keep only n candidates per task before any shuffle."""
    if owner is None:
        return df.orderBy(F.desc(order), F.desc(tie)).limit(n)
    w = Window.partitionBy(owner).orderBy(F.desc(order), F.desc(tie))
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def latest_per_key(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The latest row per key, as an aggregate with map-side combine: a hot key sends one row per task."""
    rest = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(key, "_r.*").select(*df.columns)


def resolve_text(docs: DataFrame, primary: DataFrame, legacy: DataFrame | None = None, spill: DataFrame | None = None,
                 blank_is_missing: bool = True, key: str = "doc_id") -> DataFrame:
    """Text per document from the first source that has it, and which one won.

    Sources are (key, text). With ``blank_is_missing`` a blank primary text counts as
    missing and the legacy table is not asked; otherwise any primary text, then any
    legacy text is kept and only an empty result goes to the spilled copy.
    """
    null = F.lit(None).cast("string")
    def side(df: DataFrame, source: DataFrame | None, name: str) -> DataFrame:
        if source is None:
            return df.withColumn(name, null)
        return df.join(source.select(key, F.col("text").alias(name)), key, "left")
    df = side(side(side(docs.select(key), primary, "_p"), legacy, "_l"), spill, "_s")
    has = lambda c: F.length(strip(F.col(c))) > 0
    if blank_is_missing:
        text = F.when(has("_p"), F.col("_p")).otherwise(F.coalesce(strip(F.col("_s")), F.lit("")))
        source = F.when(has("_p"), "primary").when(has("_s"), "spill").otherwise("none")
    else:
        stored = F.coalesce("_p", "_l")
        empty = F.coalesce(F.length(stored), F.lit(0)) == 0
        text = F.when(~empty, stored).otherwise(F.coalesce("_s", F.lit("")))
        source = F.when(empty, F.when(has("_s"), "spill").otherwise("none")).when(
            F.col("_p").isNotNull(), "primary").otherwise("legacy")
    return df.select(key, text.alias("text"), source.alias("text_source"))


# --- assembling one text per document ---------------------------------------------------------

def _joined(key: str, pos: str, text: Column, sep: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), text.alias("t")))),
                                    lambda x: x["t"]), sep)


def assemble_pages(pages: DataFrame, key: str = "doc_id", pos: str = "pos", text: str = "text") -> DataFrame:
    """Trimmed non-blank pages joined by a blank line; page_count counts all pages. The result is one cell per document."""
    t = strip(F.coalesce(text, F.lit("")))
    page = F.when(F.length(t) > 0, F.struct(F.col(pos).alias("p"), t.alias("t")))
    return pages.groupBy(key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(page)), lambda x: x["t"]), "\n\n").alias("text"),
        F.count("*").alias("page_count"))


def assemble_paragraphs(paras: DataFrame, key: str = "doc_id", pos: str = "pos", text: str = "text") -> DataFrame:
    """Paragraphs joined by one line break, blank ones kept; such documents have no page count."""
    body = strip(_joined(key, pos, F.coalesce(text, F.lit("")), "\n"))
    return paras.groupBy(key).agg(body.alias("text"), F.lit(None).cast("long").alias("page_count"))


# --- names and paths ------------------------------------------------------------------------------

def route_by_extension(df: DataFrame, name: str) -> DataFrame:
    """Adds extension, extraction method, and why a file is rejected."""
    ext = F.regexp_extract(F.lower(name), r"[^/]\.([^./\s]+)$", 1)
    ext = F.when(F.length(ext) > 0, F.concat(F.lit("."), ext)).otherwise("")
    method = F.when(F.col("extension") == ".pdf", METHODS[".pdf"]).when(F.col("extension") == ".docx", METHODS[".docx"])
    reason = F.when(F.col("extension") == LEGACY_EXTENSION, "legacy .doc is not supported").when(
        F.col("method").isNull(), F.concat(F.lit("unsupported file type: "), F.col("extension")))
    return df.withColumn("extension", ext).withColumn("method", method).withColumn("reject_reason", reason)


def safe_name(c: Column) -> Column:
    s = F.translate(strip(c), "\\/", "__")
    s = F.regexp_replace(F.regexp_replace(s, r"[^a-zA-Z0-9._-]+", "_"), "_+", "_")
    return F.left(s, F.lit(NAME_CHARS))


def storage_path(df: DataFrame, owner: str, key: str, name: str) -> DataFrame:
    """Adds ``object_path`` = owner or public / id / safe name (``document`` + extension when nothing is left)."""
    safe = safe_name(F.coalesce(name, F.lit("")))
    safe = F.when(F.length(safe) == 0, "document").otherwise(safe)
    base = F.coalesce(F.nullif(F.col(owner).cast("string"), F.lit("")), F.lit("public"))
    return df.withColumn("object_path", F.concat_ws("/", base, F.col(key).cast("string"), safe))


def object_path_from_url(df: DataFrame, url: str, bucket: str) -> DataFrame:
    """Adds ``object_path``: the percent-decoded path behind the bucket marker of a public URL, else null."""
    marker = f"/object/public/{bucket}/"
    path = F.coalesce(F.try_parse_url(strip(F.col(url)), F.lit("PATH")), F.lit(""))
    at = F.instr(path, F.lit(marker))
    tail = F.substring(path, at + len(marker), F.length(path))
    decoded = strip(F.try_url_decode(F.replace(tail, F.lit("+"), F.lit("%2B"))), "/")
    return df.withColumn("object_path", F.when(at > 0, F.nullif(decoded, F.lit(""))))


# --- changing tables ---------------------------------------------------------------------------------

def replace_by_key(target: DataFrame, new: DataFrame, key: str = "doc_id", replaced: DataFrame | None = None) -> DataFrame:
    """``target`` with the rows of each replaced key exchanged for the new ones.

    Keys without new rows stay as they are, unless ``replaced`` lists them.
    """
    keys = (new if replaced is None else replaced).select(key).distinct()
    return target.join(keys, key, "left_anti").unionByName(new)


def write_replacing(new: DataFrame, path: str, partition: str) -> None:
    """The same on disk: only the partitions present in ``new`` are overwritten."""
    (new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path))


def cascade_delete(tables: dict[str, DataFrame], ids: DataFrame, key: str = "doc_id") -> tuple[dict[str, DataFrame], DataFrame]:
    """All tables without the rows of ``ids``, and how many rows each of them loses."""
    gone = ids.select(key).distinct()
    left = {n: t.join(gone, key, "left_anti") for n, t in tables.items()}
    counts = None
    for n, t in tables.items():
        c = t.join(gone, key, "left_semi").agg(F.count("*").alias("deleted")).select(F.lit(n).alias("table_name"), "deleted")
        counts = c if counts is None else counts.unionByName(c)
    return left, counts


def upsert(target: DataFrame, updates: DataFrame, key: str, seq: str) -> DataFrame:
    """One row per key: the update with the highest ``seq``, else the target row."""
    rows = target.withColumn("_from", F.lit(0)).unionByName(updates.withColumn("_from", F.lit(1)))
    return latest_per_key(rows, key, ["_from", seq]).drop("_from")


def delete_by_ids(target: DataFrame, ids: DataFrame, key: str, id_col: str | None = None) -> DataFrame:
    """Rows whose key is not among the ids; null and blank ids are ignored."""
    c = F.col(id_col or key)
    gone = ids.filter(c.isNotNull() & (F.length(strip(c.cast("string"))) > 0)).select(c.alias(key)).distinct()
    return target.join(gone, key, "left_anti")


def chunk_rows(df: DataFrame, chunks: str = "chunks", text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, chunk_index, chunk_text) with contiguous numbers; the whole text when there are no chunks."""
    whole = F.array(F.col(text))
    filled = F.when(F.size(F.coalesce(chunks, F.array().cast("array<string>"))) > 0, F.col(chunks)).otherwise(whole)
    return df.select(key, F.posexplode(filled).alias("chunk_index", "chunk_text"))


def analysis_in_row(docs: DataFrame) -> DataFrame:
    """``assemble_analysis`` of documents that hold all of it in their row: ``doc_id, cleaned_text, extractive_summary``, the array
    ``entities`` and the array ``chunks``. Nothing is exchanged."""
    wanted = F.transform("entities", lambda e: F.struct(*[e[c].alias(c) for c in ("bucket", "start_char", "text", "confidence", "role")]))
    return docs.select(
        "doc_id", "cleaned_text", "extractive_summary", F.when(F.size("entities") > 0, F.array_sort(wanted)).alias("entities"),
        F.greatest(F.size("chunks"), F.lit(1)).cast("long").alias("chunk_count"),
        F.regexp_count("cleaned_text", F.lit(r"(?U)\w\S*")).cast("long").alias("cleaned_word_count"))


def assemble_analysis(docs: DataFrame, summaries: DataFrame, entities: DataFrame, chunks: DataFrame) -> DataFrame:
    """One nested record per document: summary columns, entity lists, chunk count (1 without chunks), cleaned text."""
    counts = chunks.groupBy("doc_id").agg(F.count("*").alias("chunk_count"))
    ents = entities.groupBy("doc_id").agg(F.array_sort(F.collect_list(
        F.struct("bucket", "start_char", "text", "confidence", "role"))).alias("entities"))
    df = docs.select("doc_id", F.col("text").alias("cleaned_text")).join(summaries, "doc_id", "left")
    df = df.join(ents, "doc_id", "left").join(counts, "doc_id", "left")
    return df.withColumn("chunk_count", F.coalesce("chunk_count", F.lit(1)).cast("long")).withColumn(
        "cleaned_word_count", F.regexp_count("cleaned_text", F.lit(r"(?U)\w\S*")).cast("long"))

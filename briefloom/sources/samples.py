"""Input views of the registered queries: the given tables, and rows Spark derives from all of them.

The SQL below runs unchanged on Spark and on DuckDB, so a query and its check
start from the same rows. Every view covers its whole base table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]

CONTRACT_COLUMNS = """
SELECT o.k AS doc_id,
  CASE WHEN m7 IN (0, 1) THEN 'contract' WHEN m7 = 2 THEN 'property' WHEN m7 = 3 THEN 'court_judgment'
       WHEN m7 = 4 THEN 'insurance' WHEN m7 = 5 THEN 'financial' ELSE 'general' END AS document_type,
  concat(
    CASE WHEN m7 = 5 THEN concat('This Loan Agreement is between the Lender First Bank and the Borrower ', c_name, '.')
         WHEN m7 = 2 THEN concat('This sale deed is executed by the Seller Asha Menon in favour of ', c_name, '.')
         ELSE concat('This deed binds the Lessor Rajesh Kumar and the Lessee ', c_name, '.') END, chr(10), chr(10),
    'Section 1 Payment Terms', chr(10),
    'The Lessee shall pay Rs. ', amt, ' as monthly rent within ', CAST(15 + m3 * 15 AS VARCHAR(20)), ' days of ', dt,
    ', and the Lessee shall maintain the premises', chr(10), 'in good repair; a late fee of ', CAST(2 + m5 AS VARCHAR(20)),
    '% may be charged. Tax and stamp duty are payable by the Lessee.', chr(10), chr(10),
    'Section 2 Security Deposit', chr(10),
    'A security deposit of Rs. 1,50,000 is held by the Lessor. The deposit must be refunded within 30 days of expiry, subject to deductions for damages.', chr(10), chr(10),
    CASE WHEN m3 = 0 THEN concat('Section 3 Indemnity', chr(10),
      'The Lessee shall indemnify and hold harmless the Lessor against all losses and unlimited liability arising from breach. (a) The Lessee must obtain insurance. (b) The policy shall be renewed yearly.', chr(10), chr(10)) ELSE '' END,
    CASE WHEN m5 = 0 THEN concat('Page 2 of 3', chr(10), 'TERMINATION AND NOTICE', chr(10),
      'Either party may terminate this agreement on 60 days notice under Section 12 of Contract Act, 1872, as held by Justice Ravi Kumar in Case No. ', ks, '/2024 and Policy No. ', ks, '.', chr(10),
      'This page is confidential.', chr(10), 'This page is confidential.', chr(10), chr(10)) ELSE '' END,
    CASE WHEN m7 = 1 THEN concat('Digitally signed by the parties', chr(10), chr(10)) ELSE '' END,
    'Section 9 Dispute Resolution', chr(10),
    'All disputes shall be referred to arbi-', chr(10), 'tration and the court at Bengaluru shall have exclusive jurisdiction.') AS text
"""
CONTRACT_ROWS = """FROM (SELECT o_orderkey AS k, o_orderkey % 7 AS m7, o_orderkey % 5 AS m5, o_orderkey % 3 AS m3,
         CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR(20)) AS amt,
         CAST(CAST(o_orderdate AS DATE) AS VARCHAR(20)) AS dt,
         CAST(o_orderkey AS VARCHAR(20)) AS ks, o_custkey
      FROM orders) o JOIN customer ON c_custkey = o.o_custkey"""
CONTRACT_TEXT = CONTRACT_COLUMNS + CONTRACT_ROWS

# the contract text on one line, the form the mention offsets refer to
FLAT_TEXT = r"""
SELECT doc_id, document_type, trim(regexp_replace(text, '\s+', ' '{g})) AS text FROM contract_text"""

MENTION_ROWS = [("PERSON", "the Lessor Rajesh Kumar"), ("PERSON", "Asha Menon"), ("ORG", "First Bank"),
                ("ORG", "Contract Act"), ("PERSON", "Ravi Kumar"), ("GPE", "Bengaluru"), ("MONEY", "Rs. 1,50,000"),
                ("DATE", "30 days"), ("DATE", "expiry"), ("LAW", "Section 12"), ("CARDINAL", "60"),
                ("ORG", "hold harmless the Lessor")]
_VALUES = ", ".join(f"('{a}', '{b}')" for a, b in MENTION_ROWS)
# model output stand-in: fixed names located in every text, plus the dated amount of each contract
MENTIONS = f"""
SELECT doc_id, label, mention AS text, CAST(instr(text, mention) - 1 AS BIGINT) AS start_char,
       CAST(instr(text, mention) - 1 + length(mention) AS BIGINT) AS end_char
FROM (SELECT doc_id, label, mention, text
      FROM (SELECT doc_id, text FROM flat_text) t JOIN (VALUES {_VALUES}) v(label, mention) ON instr(text, mention) > 0
      UNION ALL
      SELECT doc_id, 'DATE', regexp_extract(text, '[0-9][0-9][0-9][0-9]-[0-9][0-9]-[0-9][0-9]', 0), text FROM flat_text
      UNION ALL
      SELECT doc_id, 'MONEY', regexp_extract(text, 'Rs. [0-9]+ ', 0), text FROM flat_text) m"""

JOBS = """
SELECT event_id AS id, user_id AS document_id,
       CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'processing' WHEN 'purchase' THEN 'completed'
                       WHEN 'error' THEN 'failed' ELSE 'extracted' END AS status,
       1 + event_id % 3 AS attempts, ts AS created_at,
       concat('worker-', CAST(user_id % 4 AS VARCHAR(20))) AS worker_name,
       concat('code ', props) AS error
FROM events"""

# questions: every user turn, plus one question per contract, cycling through every intent
_ASKED = ["hello", "What can you do?", "tell me a joke", "Who is the landlord?", "List all parties",
          "Is this one-sided?", "When is the security deposit refunded?", "what is BBMP", "Who is Rajesh Kumar?",
          "Which court has jurisdiction over disputes?", "what is the deposit", "details of the Bengaluru."]
QUESTIONS = f"""
SELECT doc_id AS query_id, doc_id, CASE doc_id % {len(_ASKED)} {' '.join(f"WHEN {i} THEN '{q}'" for i, q in enumerate(_ASKED))} END AS question
FROM (SELECT o_orderkey AS doc_id FROM orders) q
UNION ALL
SELECT 1000000000000 + conv_id * 1000 + turn, conv_id, text FROM conversations WHERE role = 'user'"""

RESPONSES = """
SELECT o_orderkey AS doc_id,
  CASE WHEN o_orderkey % 11 = 0 THEN 'not json' WHEN o_orderkey % 7 = 0 THEN '[]'
  ELSE concat('[{"title":"Late fee","severity":"HIGH","description":"Fee of ', CAST(o_orderkey % 9 AS VARCHAR(20)), ' percent.","clause_reference":"Section 1"},{"title":"","severity":"low"},{"title":"Deposit","severity":"odd","description":"Refund is conditional.","clause_reference":""}]') END AS raw
FROM orders"""

# risk rows standing for parsed answers: one per order line, with uneven severities, types and wording
RISKS = """
SELECT l_orderkey AS doc_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS BIGINT) AS seq,
  CASE l_partkey % 4 WHEN 0 THEN 'Late fee' WHEN 1 THEN 'Deposit' WHEN 2 THEN '' ELSE 'Unlimited liability' END AS title,
  CASE l_suppkey % 6 WHEN 0 THEN 'liability' WHEN 1 THEN 'financial' WHEN 2 THEN 'termination' WHEN 3 THEN 'Payment terms' WHEN 4 THEN 'compliance' ELSE 'delay' END AS risk_type,
  CASE l_linenumber % 5 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' WHEN 3 THEN 'very high' ELSE 'odd' END AS severity,
  CASE l_partkey % 3 WHEN 0 THEN 'Risk' WHEN 1 THEN '' ELSE 'Money' END AS category,
  concat('Fee of ', CAST(CAST(l_quantity AS BIGINT) AS VARCHAR(20)), ' percent; due early. See part ', CAST(l_partkey % 10 AS VARCHAR(20))) AS explanation,
  CASE l_suppkey % 3 WHEN 0 THEN 'A security deposit of Rs. 1,50,000 is held by the Lessor.' WHEN 1 THEN 'shall have exclusive jurisdiction' ELSE 'Clause not in the text' END AS clause_text,
  CASE l_suppkey % 4 WHEN 0 THEN ' Legal ;Legal; Cost;Time;Scope' WHEN 1 THEN '' ELSE 'Operational' END AS tag_text
FROM lineitem"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Orders that one task turns into texts: they are small in a file, the texts and the work on them are not.
TASK_ORDERS = 50_000


def spread(df: DataFrame, task_rows: int | None = None) -> DataFrame:
    """Deal the rows of a plain scan over all cores when its files give fewer splits than there are cores.

    Large inputs have more splits than cores and stay as they are, without a shuffle. With ``task_rows``, for short rows that
    much is made of, there are so many parts that none has many more rows than that.
    """
    parts = df.sparkSession.sparkContext.defaultParallelism
    if task_rows:
        parts = max(parts, -(-df.count() // task_rows))
    return df if df.rdd.getNumPartitions() >= parts else df.repartition(parts)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _sql(spark: SparkSession, query: str, **frames: DataFrame) -> DataFrame:
    ctes = ", ".join(f"{n} AS (SELECT * FROM {{{n}}})" for n in frames)
    return spark.sql(f"WITH {ctes} " + query.replace("{", "{{").replace("}", "}}"), **frames)


def contract_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``CONTRACT_TEXT``. Orders are dealt over the tasks once they know their customer: a join by key would leave
    them in as many parts as their bytes ask for, which are few for all the text made of them. They are dealt by their number
    while they are short, so nothing made of a text has to be placed by document again."""
    rows = _sql(spark, "SELECT * " + CONTRACT_ROWS, orders=table(spark, sf_dir, "orders"), customer=table(spark, sf_dir, "customer"))
    rows = rows.select("k", "m7", "m5", "m3", "amt", "dt", "ks", "c_name")
    parts = max(spark.sparkContext.defaultParallelism, -(-table(spark, sf_dir, "orders").count() // TASK_ORDERS))
    return _sql(spark, CONTRACT_COLUMNS + "FROM contract_rows o", contract_rows=rows.repartition(parts, "k"))


def _one_line(c: Column) -> Column:
    """``trim(regexp_replace(c, '\\s+', ' '))``, without replacing every blank between two words by itself."""
    return F.trim(F.regexp_replace(c, r"\s(?:(?<! )\s*|\s+)", " "))


def flat_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``FLAT_TEXT``."""
    return contract_text(spark, sf_dir).select("doc_id", "document_type", _one_line(F.col("text")).alias("text"))


def _mentions_in(text: Column, labels: Sequence[str] | None = None) -> Column:
    """array<struct<label, text, start_char, end_char>> of the names, dates and amounts of a text, of the given labels if any.
    Most names are absent from most texts, which a plain search tells sooner than one that counts characters."""
    named = [(label, F.lit(mention)) for label, mention in MENTION_ROWS]
    named += [("DATE", F.regexp_extract(text, "[0-9]{4}-[0-9]{2}-[0-9]{2}", 0)), ("MONEY", F.regexp_extract(text, "Rs. [0-9]+ ", 0))]
    found = F.array(*[F.struct(F.lit(label).alias("label"), mention.alias("text"),
                               F.when(F.contains(text, mention), F.instr(text, mention).cast("long") - 1).alias("start_char"))
                      for label, mention in named if labels is None or label in labels])
    return F.transform(F.filter(found, lambda m: m["start_char"] >= 0), lambda m: F.struct(
        m["label"].alias("label"), m["text"].alias("text"), m["start_char"].alias("start_char"),
        (m["start_char"] + F.length(m["text"])).alias("end_char")))


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``MENTIONS``, each text read once: names are looked up in the row instead of joined to it."""
    return flat_text(spark, sf_dir).select("doc_id", F.inline(_mentions_in(F.col("text"))))


def marked_text(spark: SparkSession, sf_dir: str, labels: Sequence[str] | None = None) -> DataFrame:
    """``doc_id, contract, text, mentions``: each contract's text, the same on one line, and the mentions found in it (of the given
    labels, if any), for work that needs a text beside its own mentions and so needs no exchange."""
    docs = contract_text(spark, sf_dir).select("doc_id", F.col("text").alias("contract"), _one_line(F.col("text")).alias("text"))
    return docs.withColumn("mentions", _mentions_in(F.col("text"), labels))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, JOBS, events=table(spark, sf_dir, "events"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, QUESTIONS, orders=table(spark, sf_dir, "orders"),
                conversations=table(spark, sf_dir, "conversations"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, RESPONSES, orders=spread(table(spark, sf_dir, "orders").select("o_orderkey"), TASK_ORDERS))


def risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    return _sql(spark, RISKS, lineitem=spread(lines))

"""Relations of the engine derived from the driver's tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.text import KIND_WORDS, actionability, entry_id, entry_kind, reviewable, strip


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A call ledger from ``events``: the status and a missing price follow from the id."""
    status = (
        F.when(F.col("event_id") % 10 == 0, "blocked_by_budget").when(F.col("event_id") % 10 == 1, "error").otherwise("ok")
    )
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        "ts",
        F.col("user_id").alias("session_id"),
        F.col("event_type").alias("operation"),
        F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("usd"),
        F.get_json_object("props", "$.k").cast("long").alias("tokens"),
        status.alias("status"),
    )


CALLS_SQL = """calls AS (
  SELECT event_id AS id, ts, user_id AS session_id, event_type AS operation,
         CASE WHEN event_id % 7 <> 0 THEN value END AS usd,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens,
         CASE WHEN event_id % 10 = 0 THEN 'blocked_by_budget' WHEN event_id % 10 = 1 THEN 'error' ELSE 'ok' END AS status
  FROM events)"""


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"), "source", "lang", "n_chars")


DOCS_SQL = "docs AS (SELECT doc_id, text AS content, source, lang, n_chars FROM documents)"


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as transcripts: one path each, turns as lines, every third without a timestamp."""
    stamp = F.concat(F.lit("2026-01-"), F.lpad((F.col("turn") % 28 + 1).cast("string"), 2, "0"), F.lit("T08:00:00Z"))
    return table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("path"),
        (F.col("turn") + 1).alias("line_no"),
        "role",
        F.col("text").alias("content"),
        F.when(F.col("turn") % 3 != 2, stamp).otherwise("").alias("timestamp"),
        F.lit("log").alias("source"),
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("uuid"),
    )


MESSAGES_SQL = """messages AS (
  SELECT 'c' || conv_id AS path, turn + 1 AS line_no, role, text AS content,
         CASE WHEN turn % 3 <> 2 THEN '2026-01-' || lpad(CAST(turn % 28 + 1 AS VARCHAR), 2, '0') || 'T08:00:00Z' ELSE '' END AS timestamp,
         'log' AS source, conv_id || '-' || turn AS uuid
  FROM conversations)"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record log from ``events``: eight nodes, two of every hundred sequence numbers claimed twice."""
    e = table(spark, sf_dir, "events")
    seq = F.floor(F.col("event_id") / 8) - F.when(F.col("event_id") % 800 < 16, 1).otherwise(0)
    kind = F.when(F.col("event_id") % 50 == 49, "tombstone").otherwise(F.col("event_type"))
    return e.select(
        F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("record_id"),
        (F.col("event_id") % 8).alias("node_id"),
        seq.cast("long").alias("node_seq"),
        "ts",
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("hlc"),
        kind.alias("kind"),
        F.concat(F.lit("r"), (F.col("event_id") - 20).cast("string")).alias("target_id"),
        (F.col("user_id") % 5).cast("string").alias("namespace"),
        (F.col("user_id") % 11).cast("string").alias("section"),
        F.when(F.col("event_id") % 9 == 0, "remove").otherwise("set").alias("action"),
        F.when(F.col("event_id") % 13 == 0, " ").otherwise(F.col("props")).alias("body"),
        F.md5("props").alias("payload_hash"),
        F.col("props").alias("payload"),
        (F.col("event_id") % 17 != 0).alias("verified"),
    )


RECORDS_SQL = """records AS (
  SELECT 'r' || event_id AS record_id, event_id % 8 AS node_id,
         CAST(event_id // 8 - CASE WHEN event_id % 800 < 16 THEN 1 ELSE 0 END AS BIGINT) AS node_seq,
         ts, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS hlc,
         CASE WHEN event_id % 50 = 49 THEN 'tombstone' ELSE event_type END AS kind,
         'r' || (event_id - 20) AS target_id, CAST(user_id % 5 AS VARCHAR) AS namespace, CAST(user_id % 11 AS VARCHAR) AS section,
         CASE WHEN event_id % 9 = 0 THEN 'remove' ELSE 'set' END AS action,
         CASE WHEN event_id % 13 = 0 THEN ' ' ELSE props END AS body,
         md5(props) AS payload_hash, props AS payload, event_id % 17 <> 0 AS verified
  FROM events)"""


ENTRY_LEADS = ("Policy: ", "name: ", "todo ", "", "decided ", "PR #3 ", "prefers ")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of ``documents`` as memory entries of one section per source."""
    rows = docs(spark, sf_dir).select("doc_id", "lang", "source", F.posexplode(F.split("content", "\n")).alias("at", "line"))
    lead = F.get(F.array(*[F.lit(x) for x in ENTRY_LEADS]), (F.col("doc_id") % len(ENTRY_LEADS)).cast("int"))
    rows = rows.withColumn("text", strip(F.col("line"))).filter("text <> ''").withColumn("text", F.concat(lead, "text"))
    # The explode keeps the cascade of words from being copied into everything that reads the kind.
    rows = rows.select("*", F.explode(F.array(entry_kind(F.col("text"), F.col("source")))).alias("kind"))
    rows = rows.withColumn("actionability", actionability(F.col("kind")))
    return rows.select(
        F.col("lang").alias("record_id"),
        ((F.length("text") * 31 + F.col("doc_id")) % 1500).cast("string").alias("section"),
        "kind",
        "actionability",
        "text",
        entry_id(F.col("text")).alias("entry_id"),
        F.lit(False).alias("id_explicit"),
        reviewable(F.lit(None).cast("string"), F.col("kind"), F.col("actionability")).alias("reviewable"),
    )


_KIND_SQL = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(low, '{w}')" for w in words) + f" THEN '{kind}'" for kind, words in KIND_WORDS) + " ELSE 'evergreen' END"

ENTRIES_SQL = f"""entry_line AS (
  SELECT doc_id, lang, source, regexp_replace(unnest(string_split(text, chr(10))), '^\\s+|\\s+$', '', 'g') AS text FROM documents
), entry_kind AS (
  SELECT *, {_KIND_SQL} AS kind FROM (SELECT *, lower(source || ' ' || text) AS low FROM (
    SELECT doc_id, lang, source, {list(ENTRY_LEADS)}[doc_id % {len(ENTRY_LEADS)} + 1] || text AS text FROM entry_line WHERE text <> ''))
), entries AS (
  SELECT lang AS record_id, CAST((length(text) * 31 + doc_id) % 1500 AS VARCHAR) AS section, kind, text,
         CASE WHEN kind IN ('identity', 'policy', 'mode') THEN 'high' WHEN kind = 'snapshot' THEN 'low' ELSE 'medium' END AS actionability,
         'ome_' || substr(sha256(text), 1, 16) AS entry_id,
         kind IN ('identity', 'preference', 'policy', 'decision', 'mode') AS reviewable
  FROM entry_kind)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as start-up chunks; twenty make up a payload."""
    heading = F.element_at(
        F.array(*[F.lit(x) for x in ("Working Profile", "Core Identity", "Preferences", "Active Projects", "Notes")]), (F.col("doc_id") % 5 + 1).cast("int")
    )
    return docs(spark, sf_dir).select(
        F.floor(F.col("doc_id") / 20).cast("long").alias("payload"),
        F.when(F.col("doc_id") % 2 == 0, "profile").otherwise("active").alias("source"),
        heading.alias("heading"),
        F.col("content").alias("body"),
        F.concat(F.lit("h"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("handle"),
        F.length("content").alias("size"),
    )


CHUNKS_SQL = """chunks AS (
  SELECT doc_id // 20 AS payload, CASE WHEN doc_id % 2 = 0 THEN 'profile' ELSE 'active' END AS source,
         CASE doc_id % 5 WHEN 0 THEN 'Working Profile' WHEN 1 THEN 'Core Identity' WHEN 2 THEN 'Preferences' WHEN 3 THEN 'Active Projects' ELSE 'Notes' END AS heading,
         text AS body, 'h' || lpad(CAST(doc_id AS VARCHAR), 12, '0') AS handle, length(text) AS size
  FROM documents)"""

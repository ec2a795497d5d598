"""Retrieval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions import text as fx
from tidewell.operators import search
from tidewell.operators.index import StoredIndex
from tidewell.sources.sinks import new_folder

from .relations import DOCS_SQL, docs

ASKED = ((1, "the whsting eringer"), (2, "license version rights"), (3, "enfer idiot worthless"), (4, "the and of"), (5, "zzzz qqqq"))
STOP = ", ".join(f"'{w}'" for w in fx.STOPWORDS)
TOKENS_SQL = f"""list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(content, '')), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+'),
  lambda w: w <> '' AND w NOT IN ({STOP}))"""
STRIP_SQL = "regexp_replace(content, '^\\s+|\\s+$', '', 'g')"


def _asked(spark):
    return spark.createDataFrame(list(ASKED), "query_id int, query string")


def _scalars(spark, sf_dir):
    c = F.col("content")
    return docs(spark, sf_dir).select(
        "doc_id",
        F.size(fx.search_tokens(c)).cast("long").alias("n_tokens"),
        F.md5(fx.slug(c)).alias("slug_md5"),
        fx.entry_id(c).alias("entry_id"),
        fx.token_estimate(c).alias("est_tokens"),
        F.octet_length(c).cast("long").alias("n_bytes"),
        fx.snippet(c).alias("snippet"),
        fx.hex_name(F.concat(F.lit("obs:"), F.col("doc_id").cast("string"))).alias("file_name"),
    )


def _older(spark, sf_dir):
    """What an index held before: one document in ten is missing, one has another text, and one is there that has gone since."""
    d, n = docs(spark, sf_dir).select("doc_id", "content"), F.col("doc_id")
    kept = d.filter(n % 10 != 3).withColumn("content", F.when(n % 10 == 4, F.concat(F.lit("license the license "), F.coalesce("content", F.lit("")))).otherwise(F.col("content")))
    return kept.unionByName(d.filter(n % 10 == 5).withColumn("doc_id", -n - 1))


def _index(spark, sf_dir):
    index = StoredIndex(spark, new_folder(spark, "index"))
    index.update(_older(spark, sf_dir))
    return index


def _indexed(spark, sf_dir):
    """Hits from a stored index that was built over older texts and then brought up to date."""
    index = _index(spark, sf_dir)
    index.update(docs(spark, sf_dir).select("doc_id", "content"))
    return index.search(_asked(spark))


QUERIES = {
    "indexed_top_k": _indexed,
    "index_changes": lambda spark, sf_dir: _index(spark, sf_dir).changes(docs(spark, sf_dir).select("doc_id", "content")).select("doc_id", "change"),
    "bm25_top_k": lambda spark, sf_dir: search.bm25(docs(spark, sf_dir), _asked(spark)),
    "token_overlap": lambda spark, sf_dir: search.overlap(docs(spark, sf_dir), "the whsting eringer license"),
    "first_hits": lambda spark, sf_dir: search.first_hits(
        docs(spark, sf_dir).select(F.col("lang").alias("query_id"), F.col("source").alias("doc_id"), F.col("doc_id").alias("rank"))
    ),
    "matching_lines": lambda spark, sf_dir: search.matching_lines(docs(spark, sf_dir), "Rights Reserved"),
    "text_scalars": _scalars,
}

_ASKED = ", ".join(f"({i}, '{q}')" for i, q in ASKED)
ORACLE_SQL = {
    "bm25_top_k": f"""WITH {DOCS_SQL}, tok AS (SELECT doc_id, {TOKENS_SQL} AS ts FROM docs),
stats AS (SELECT count(*) AS n_docs, avg(len(ts)) AS avg_len FROM tok),
post AS (SELECT doc_id, len(ts) AS doc_len, t AS term, count(*) AS tf FROM (SELECT doc_id, ts, unnest(ts) AS t FROM tok) GROUP BY ALL),
raw AS (SELECT term, ln((n_docs - n + 0.5) / (n + 0.5)) AS raw FROM (SELECT term, count(*) AS n FROM post GROUP BY term), stats),
idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
asked(query_id, content) AS (VALUES {_ASKED}),
want AS (SELECT query_id, t AS term, count(*) AS times FROM (SELECT query_id, unnest({TOKENS_SQL}) AS t FROM asked) GROUP BY ALL),
scored AS (
  SELECT query_id, doc_id, sum(times * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * doc_len / avg_len))) AS score,
         CAST(sum(tf) AS DOUBLE) AS overlap
  FROM post JOIN want USING (term) JOIN idf USING (term), stats GROUP BY ALL),
chosen AS (
  SELECT query_id, doc_id, CASE WHEN max(score > 1e-12) OVER (PARTITION BY query_id) THEN score ELSE overlap END AS score FROM scored)
SELECT CAST(query_id AS INTEGER) AS query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS INTEGER) AS rank, doc_id, round(score, 6) AS score
FROM chosen WHERE score > 1e-12 QUALIFY rank <= 10""",
    "token_overlap": f"""WITH {DOCS_SQL}
SELECT doc_id, CAST(len(list_filter({TOKENS_SQL}, lambda w: w IN ('whsting', 'eringer', 'license'))) AS BIGINT) AS overlap
FROM docs WHERE overlap > 0""",
    "first_hits": """SELECT lang AS query_id, source AS doc_id, doc_id AS rank FROM documents
QUALIFY coalesce(source, '') = '' OR row_number() OVER (PARTITION BY lang, source ORDER BY documents.doc_id) = 1""",
    "matching_lines": """SELECT doc_id, CAST(i AS INTEGER) AS line_no, substr(regexp_replace(ls[i], '^\\s+|\\s+$', '', 'g'), 1, 200) AS line
FROM (SELECT doc_id, string_split(text, chr(10)) AS ls, unnest(range(1, len(ls) + 1)) AS i FROM documents)
WHERE contains(lower(ls[i]), 'rights reserved')""",
    "text_scalars": f"""WITH {DOCS_SQL}
SELECT doc_id, CAST(len({TOKENS_SQL}) AS BIGINT) AS n_tokens,
       md5(coalesce(nullif(trim(regexp_replace(lower(content), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'section')) AS slug_md5,
       'ome_' || substr(sha256({STRIP_SQL}), 1, 16) AS entry_id,
       CAST(length(content) // 4 AS BIGINT) AS est_tokens, CAST(strlen(content) AS BIGINT) AS n_bytes,
       CASE WHEN length({STRIP_SQL}) > 600 THEN regexp_replace(substr({STRIP_SQL}, 1, 600), '\\s+$', '') || ' …' ELSE {STRIP_SQL} END AS snippet,
       lower(hex('obs:' || doc_id)) AS file_name
FROM docs""",
}
ORACLE_SQL["indexed_top_k"] = ORACLE_SQL["bm25_top_k"]
ORACLE_SQL["index_changes"] = """SELECT doc_id, CASE doc_id % 10 WHEN 3 THEN 'new' ELSE 'changed' END AS change FROM documents WHERE doc_id % 10 IN (3, 4)
UNION ALL SELECT -doc_id - 1, 'gone' FROM documents WHERE doc_id % 10 = 5"""

"""Queries of what keeps notes, records and indexes in order."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions import text as fx
from tidewell.operators import artifacts, changes, search, trees, usage
from tidewell.operators import records as log

from .memory import FLAT, PARTS_SQL, _flat, _notes
from .records import VERSIONS, _versions
from .relations import CALLS_SQL, RECORDS_SQL, calls, docs, records
from .search import ORACLE_SQL as SEARCH_SQL
from .search import _asked


def _tree_notes(spark, sf_dir):
    text = F.concat(F.lit("intro\n# T\n\n## A\n- one "), _flat(), F.lit("\n  - two\n    tail\n\n  - three\nlazy\n## B\ntext"))
    return docs(spark, sf_dir).select(F.col("doc_id").alias("doc"), text.alias("text"))


def _metadata_lines(spark, sf_dir):
    n = F.col("doc_id")
    line = F.concat(F.lit("- prefers tea "), n.cast("string"), F.when(n % 3 == 0, " <!--om: kind=task node=h9-->").otherwise(""))
    rows = docs(spark, sf_dir).select(n.alias("doc"), F.lit(1).alias("line_no"), line.alias("line"), F.lit("S").alias("section"))
    return trees.with_metadata(rows, F.lit("2026-06-01 00:00:00").cast("timestamp"), "h1").select("doc", "line")


def _bundle(spark, sf_dir):
    made = artifacts.export_bundle(_notes(spark, sf_dir), docs(spark, sf_dir).select(F.col("doc_id").alias("doc"), F.coalesce("content", F.lit("")).alias("text")), most=1500)
    whole = F.concat(F.when(F.col("part") == 0, F.col("text")).otherwise(F.regexp_replace("text", r"\A#{1,6} [^\n]* \(continued\)\n\n", "")))
    parts = F.array_sort(F.collect_list(F.struct("part", whole.alias("t"))))
    return made.groupBy("role", "doc").agg((F.max("bytes") <= 1500).alias("fits"), F.md5(F.array_join(F.transform(parts, lambda x: x["t"]), "")).alias("text_md5"))


def _rewraps(spark, sf_dir):
    r = records(spark, sf_dir).withColumn("key_id", F.when(F.col("node_seq") % 2 == 0, "k1").otherwise("k2"))
    wraps = r.filter("kind = 'click'").select("record_id", "hlc", "target_id", F.md5("payload").alias("payload_hash"), "key_id", F.concat(F.lit("w:"), "record_id").alias("payload"))
    return r, wraps


def _keyed_rewraps(spark, sf_dir):
    r, wraps = _rewraps(spark, sf_dir)
    return log.latest_rewrap(r, wraps, ("payload_hash", "key_id")).select("record_id", "current_payload")


def _due_rewraps(spark, sf_dir):
    r, wraps = _rewraps(spark, sf_dir)
    return log.rewraps_due(r, wraps, "k1").select("record_id")


def _tombs(spark, sf_dir):
    r = records(spark, sf_dir).filter("kind = 'purchase'")
    return log.tombstones(r, F.lit("now")).select("node_id", "target_id", "kind", F.col("ord").cast("long").alias("ord"))


def _merged(spark, sf_dir):
    n = F.col("doc_id")
    old = F.when(n % 3 > 0, F.concat(_flat(), F.lit(" \n\n"))).otherwise(F.lit(" "))
    new = F.concat(F.when(n % 2 == 0, "## 2026-06-01\n- x ").otherwise("- y "), n.cast("string"))
    return docs(spark, sf_dir).select("doc_id", F.md5(fx.merged_observations(old, new, F.lit("2026-06-01"))).alias("text_md5"))


def _statuses(spark, sf_dir):
    n = F.col("doc_id").cast("string")
    text = F.concat(F.lit("Index x\n  Documents: "), n, F.when(F.col("doc_id") % 2 == 0, F.lit("\nVectors: 7\n")).otherwise("\n"), F.lit("Updated: 2026"))
    return docs(spark, sf_dir).select("doc_id", fx.index_status(text).alias("s")).select("doc_id", "s.*")


def _unmatched(spark, sf_dir):
    names = fx.name_tokens(F.concat(F.lit("om-relay hermes agent"), (F.col("doc_id") % 5).cast("string")))
    return docs(spark, sf_dir).select("doc_id", F.array_join(fx.unmatched_tokens(names, F.array(F.lit("relay"), F.lit("hermes"))), ",").alias("new_names"))


def _shareable(spark, sf_dir):
    """Hits whose documents are all local for every third id."""
    d = docs(spark, sf_dir)
    text = F.concat(F.lit("## H\n- "), _flat(), F.when(F.col("doc_id") % 3 == 0, " <!--om: scope=local-->").otherwise(""))
    hits = search.bm25(d, _asked(spark)).select("query_id", "rank", "doc_id")
    return trees.shareable_hits(hits, d.select("doc_id", text.alias("content"))).select("query_id", "rank", "doc_id", F.md5("content").alias("content_md5"))


QUERIES = {
    "block_trees": lambda spark, sf_dir: trees.block_tree(_tree_notes(spark, sf_dir)).select("doc", "line_no", "depth", "parent", "kind"),
    "entries_with_metadata": _metadata_lines,
    "export_bundles": _bundle,
    "keyed_rewraps": _keyed_rewraps,
    "due_rewraps": _due_rewraps,
    "new_tombstones": _tombs,
    "merged_observations": _merged,
    "index_statuses": _statuses,
    "unmatched_names": _unmatched,
    "shareable_hits": _shareable,
    "shared_paths": lambda spark, sf_dir: changes.shared_keys(*_versions(spark, sf_dir), "path"),
    "reconciled_index": lambda spark, sf_dir: changes.reconciled(*_versions(spark, sf_dir), "path"),
    "usage_lines": lambda spark, sf_dir: usage.tail_table(calls(spark, sf_dir)),
    "empty_backend": lambda spark, sf_dir: search.backend("none", docs(spark, sf_dir)).search(_asked(spark)),
    "chosen_backend": lambda spark, sf_dir: search.backend("bm25", docs(spark, sf_dir)).search(_asked(spark), 3).select("query_id", "rank", "doc_id"),
}

REWRAPS_SQL = f"""{RECORDS_SQL}, r AS (SELECT *, CASE WHEN node_seq % 2 = 0 THEN 'k1' ELSE 'k2' END AS key_id FROM records)"""
ORACLE_SQL = {
    "block_trees": """SELECT doc_id AS doc, CAST(l AS INTEGER) AS line_no, CAST(d AS INTEGER) AS depth, CAST(p AS INTEGER) AS parent, k AS kind FROM documents,
(VALUES (1, 0, NULL, 'text'), (2, 0, NULL, 'heading'), (4, 0, 2, 'heading'), (5, 0, 4, 'entry'), (6, 2, 5, 'entry'), (7, 4, 6, 'text'), (9, 2, 5, 'entry'), (10, 0, 9, 'text'),
        (11, 0, 2, 'heading'), (12, 0, 11, 'text')) t(l, d, p, k)""",
    "entries_with_metadata": """SELECT doc_id AS doc, '- prefers tea ' || doc_id || ' <!--om: id=ome_' || substr(sha256('prefers tea ' || doc_id), 1, 16) || CASE WHEN doc_id % 3 = 0 THEN ' kind=task' ELSE ' kind=preference' END
|| ' source_type=inferred confidence=medium sensitivity=normal actionability=medium last_seen=2026-06-01 seen_count=1 node=' || CASE WHEN doc_id % 3 = 0 THEN 'h9' ELSE 'h1' END || '-->' AS line FROM documents""",
    "export_bundles": f"""WITH {PARTS_SQL}, note AS (
  SELECT doc, '# Notes' || nl || nl || '*Last updated: ' || day || ' 08:00 UTC*' || nl || '*Last reflected: ' || day || '*' || nl || nl || core || nl || nl || CASE WHEN has_prefs THEN prefs || nl || nl ELSE '' END
    || '## Active Projects' || nl || '### ' || project || nl || '- ' || flat || ' <!--om: kind=task-->' || nl || '### Q' || nl || '- q' || nl || nl || facts || nl || '- cold' || nl || nl || '## Recent Themes' || nl || '- theme' AS text FROM made)
SELECT 'profile' AS role, doc, true AS fits, md5(text) AS text_md5 FROM note UNION ALL SELECT 'active', doc_id, true, md5(coalesce(text, '')) FROM documents""",
    "keyed_rewraps": f"""WITH {REWRAPS_SQL}, w AS (
  SELECT target_id, payload_hash, key_id, 'w:' || record_id AS payload FROM r WHERE kind = 'click' QUALIFY row_number() OVER (PARTITION BY target_id, payload_hash, key_id ORDER BY hlc DESC, record_id DESC) = 1)
SELECT record_id, coalesce(w.payload, r.payload) AS current_payload FROM r LEFT JOIN w ON r.record_id = w.target_id AND r.payload_hash = w.payload_hash AND r.key_id = w.key_id""",
    "due_rewraps": f"""WITH {REWRAPS_SQL} SELECT record_id FROM r WHERE key_id = 'k1' AND NOT EXISTS (SELECT 1 FROM records c WHERE c.kind = 'click' AND c.target_id = r.record_id AND c.payload_hash = r.payload_hash)""",
    "new_tombstones": f"""WITH {RECORDS_SQL} SELECT node_id, record_id AS target_id, 'tombstone' AS kind, row_number() OVER (PARTITION BY node_id ORDER BY record_id) AS "ord" FROM records WHERE kind = 'purchase'""",
    "merged_observations": f"""WITH s AS (SELECT doc_id, {FLAT} AS flat, CASE WHEN doc_id % 2 = 0 THEN '## 2026-06-01' || chr(10) || '- x ' ELSE '- y ' END || doc_id AS new FROM documents)
SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0 OR doc_id % 3 = 0 THEN new ELSE flat || chr(10) || chr(10) || new END) AS text_md5 FROM s""",
    "index_statuses": "SELECT doc_id, doc_id AS documents, CASE WHEN doc_id % 2 = 0 THEN CAST(7 AS BIGINT) END AS vectors, '2026' AS updated FROM documents",
    "unmatched_names": "SELECT doc_id, 'agent' || (doc_id % 5) || ',om-relay' AS new_names FROM documents",
    "shareable_hits": f"""SELECT query_id, rank, doc_id, md5(substr('## H' || chr(10) || '- ' || {FLAT}, 1, 500)) AS content_md5 FROM ({SEARCH_SQL["bm25_top_k"]}) JOIN documents USING (doc_id) WHERE doc_id % 3 > 0""",
    "shared_paths": f"WITH {VERSIONS} SELECT path FROM before INTERSECT SELECT path FROM after",
    "reconciled_index": f"""WITH {VERSIONS} SELECT path, CASE WHEN a.hash IS NULL THEN 'delete' ELSE 'upsert' END AS step FROM before b FULL JOIN after a USING (path) WHERE a.hash IS DISTINCT FROM b.hash""",
    "usage_lines": f"""WITH {CALLS_SQL} SELECT id, strftime(ts, '%Y-%m-%d %H:%M') || '  ' || rpad(operation, CAST(greatest(10, length(operation)) AS INTEGER), ' ') || '  ' || rpad(status, 18, ' ') || '  ' || lpad(CAST(coalesce(tokens, 0) AS VARCHAR), 8, ' ') || '  '
|| CASE WHEN usd IS NULL THEN '—' WHEN usd > 0 AND usd < 0.01 THEN printf('$%.4f', usd) ELSE '$' || format('{{:,.2f}}', usd) END AS line FROM calls ORDER BY id DESC LIMIT 20""",
    "empty_backend": "SELECT CAST(0 AS INTEGER) AS query_id, CAST(0 AS INTEGER) AS rank, CAST(0 AS BIGINT) AS doc_id, 0.0::DOUBLE AS score WHERE false",
    "chosen_backend": f"SELECT query_id, rank, doc_id FROM ({SEARCH_SQL['bm25_top_k']}) WHERE rank <= 3",
}

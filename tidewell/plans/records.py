"""Record-log and change queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions import clocks
from tidewell.operators import changes
from tidewell.operators import records as log

from .relations import ENTRIES_SQL, RECORDS_SQL, docs, entries, records

RULES = ((1, "click", "web"), (2, "purchase", "money"), (3, "click", "late"))


def _split(spark, sf_dir):
    r = records(spark, sf_dir)
    n = F.substring("record_id", 2, 20).cast("long")
    return r.filter(n % 3 != 0), r.filter(n % 5 != 0)


def _frontiers(spark, sf_dir):
    """Frontiers of the two sides of each namespace, their order and their join."""
    here, there = _split(spark, sf_dir)

    def side(rows, name):
        each = rows.groupBy("namespace", F.col("node_id").cast("string").alias("node")).agg(F.max("node_seq").alias("seq"))
        return each.groupBy("namespace").agg(F.map_from_entries(F.collect_list(F.struct("node", "seq"))).alias(name))

    both = side(here, "a").join(side(there, "b"), "namespace")
    seen = F.aggregate(F.map_values(clocks.frontier_join(F.col("a"), F.col("b"))), F.lit(0).cast("long"), lambda t, x: t + x)
    return both.select("namespace", clocks.frontier_order(F.col("a"), F.col("b")).alias("order"), seen.alias("seen"))


def _import(spark, sf_dir):
    here, there = _split(spark, sf_dir)
    tampered = F.when(F.col("node_seq") % 7 == 0, F.md5("record_id")).otherwise(F.col("payload_hash"))
    incoming = here.withColumn("payload_hash", tampered)
    return log.classify_import(incoming, there).groupBy("verdict").agg(F.count(F.lit(1)).alias("records"))


def _rewrap(spark, sf_dir):
    r = records(spark, sf_dir)
    wraps = r.filter("kind = 'click'").select("record_id", "hlc", "target_id", F.md5("payload").alias("payload_hash"), F.concat(F.lit("w:"), "record_id").alias("payload"))
    return log.latest_rewrap(r, wraps).select("record_id", "current_payload")


def _log(spark, sf_dir):
    kept = log.observation_log(records(spark, sf_dir), F.lit("2024-01-20 00:00:00").cast("timestamp"))
    return kept.select(F.date_format("date", "yyyy-MM-dd").alias("date"), "position", "record_id")


def _versions(spark, sf_dir):
    d = docs(spark, sf_dir)
    path = F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path")
    before = d.filter("doc_id % 5 <> 0").select(path, F.sha2("content", 256).alias("hash"))
    after = d.filter("doc_id % 7 <> 0").select(path, F.sha2(F.when(F.col("doc_id") % 3 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")), 256).alias("hash"))
    return before, after


def _snapshots(spark, sf_dir):
    r = records(spark, sf_dir).filter("kind = 'purchase'")
    shots = r.select(F.col("node_id").alias("host"), F.col("record_id").alias("snapshot_id"), F.col("ts").alias("created_at"), (F.col("node_seq") % 20 == 0).alias("pinned"))
    return log.retained(shots, 100, F.lit("2024-01-27 00:00:00").cast("timestamp")).select("host", "snapshot_id", "rank", "dropped_for")


def _sides(spark, sf_dir):
    e = entries(spark, sf_dir)
    return e.filter("record_id IN ('en', 'fr')"), e.filter("record_id IN ('de', 'es')")


def _divergences(spark, sf_dir):
    prior, new = _sides(spark, sf_dir)
    explicit = (F.length("text") % 9 == 0).alias("id_explicit")
    ids = F.when(F.length("text") % 9 == 0, F.concat(F.lit("x"), F.length("text").cast("string"), F.lit("-"), "section")).otherwise(F.col("entry_id")).alias("entry_id")
    shape = ["section", "kind", "text", "reviewable", explicit, ids]
    found = changes.divergences(prior.select(shape), new.select(shape))
    return found.groupBy("signal").agg(F.count(F.lit(1)).alias("pairs"), F.sum(F.length("before") + F.length("after")).alias("chars"))


QUERIES = {
    "record_heads": lambda spark, sf_dir: log.heads(records(spark, sf_dir)),
    "record_kinds": lambda spark, sf_dir: log.counts_by_kind(records(spark, sf_dir)),
    "head_conflicts": lambda spark, sf_dir: log.head_conflicts(records(spark, sf_dir)),
    "push_diff": lambda spark, sf_dir: log.missing_from(*_split(spark, sf_dir)).select("record_id", "node_id", "node_seq"),
    "live_records": lambda spark, sf_dir: log.live(records(spark, sf_dir)).select("record_id", "kind"),
    "latest_overrides": lambda spark, sf_dir: log.latest_overrides(records(spark, sf_dir)),
    "frontier_order": _frontiers,
    "import_verdicts": _import,
    "latest_rewraps": _rewrap,
    "observation_log": _log,
    "revoked_nodes": lambda spark, sf_dir: log.not_revoked(
        records(spark, sf_dir), spark.createDataFrame([(1, "2024-01-10T00:00:00"), (2, None)], "node_id long, revoked_after string")
    ).groupBy("node_id").agg(F.count(F.lit(1)).alias("records")),
    "namespace_rules": lambda spark, sf_dir: log.namespaces(
        records(spark, sf_dir).select(F.col("record_id").alias("event_id"), F.col("kind").alias("source")),
        spark.createDataFrame(list(RULES), "ord int, source string, namespace string"),
    ),
    "snapshot_retention": _snapshots,
    "file_changes": lambda spark, sf_dir: changes.file_changes(*_versions(spark, sf_dir)),
    "dropped_paths": lambda spark, sf_dir: changes.dropped_keys(*_versions(spark, sf_dir), "path"),
    "entry_conflicts": lambda spark, sf_dir: changes.conflicts(entries(spark, sf_dir)),
    "single_slots": lambda spark, sf_dir: changes.single_slots(entries(spark, sf_dir)),
    "solo_sections": lambda spark, sf_dir: changes.solo_sections(entries(spark, sf_dir)),
    "divergences": _divergences,
}

SPLIT = f"""{RECORDS_SQL}, here AS (SELECT * FROM records WHERE CAST(substr(record_id, 2) AS BIGINT) % 3 <> 0),
there AS (SELECT * FROM records WHERE CAST(substr(record_id, 2) AS BIGINT) % 5 <> 0)"""
VERSIONS = """before AS (SELECT 'f' || doc_id AS path, sha256(text) AS hash FROM documents WHERE doc_id % 5 <> 0),
after AS (SELECT 'f' || doc_id AS path, sha256(CASE WHEN doc_id % 3 = 0 THEN text || '!' ELSE text END) AS hash FROM documents WHERE doc_id % 7 <> 0)"""

ORACLE_SQL = {
    "record_heads": f"WITH {RECORDS_SQL} SELECT node_id, max(node_seq) AS seq FROM records GROUP BY node_id",
    "record_kinds": f"WITH {RECORDS_SQL} SELECT kind, count(*) AS records FROM records GROUP BY kind",
    "head_conflicts": f"""WITH {RECORDS_SQL}
SELECT node_id, node_seq, count(DISTINCT record_id) AS records FROM records GROUP BY ALL HAVING count(DISTINCT record_id) > 1""",
    "push_diff": f"WITH {SPLIT} SELECT record_id, node_id, node_seq FROM here ANTI JOIN there USING (node_id, record_id)",
    "live_records": f"""WITH {RECORDS_SQL} SELECT record_id, kind FROM records WHERE kind <> 'tombstone'
AND record_id NOT IN (SELECT target_id FROM records WHERE kind = 'tombstone')""",
    "latest_overrides": f"""WITH {RECORDS_SQL}, last AS (
  SELECT * FROM records QUALIFY row_number() OVER (PARTITION BY namespace, section ORDER BY hlc DESC, record_id DESC) = 1)
SELECT namespace, section, record_id, hlc, action, body FROM last WHERE action <> 'remove' AND trim(body) <> ''""",
    "frontier_order": f"""WITH {SPLIT}, a AS (SELECT namespace, node_id, max(node_seq) AS seq FROM here GROUP BY ALL),
b AS (SELECT namespace, node_id, max(node_seq) AS seq FROM there GROUP BY ALL),
pair AS (SELECT namespace, coalesce(a.seq, 0) AS x, coalesce(b.seq, 0) AS y FROM a FULL JOIN b USING (namespace, node_id))
SELECT namespace, CASE WHEN bool_and(x = y) THEN 'equal' WHEN bool_and(x >= y) THEN 'covers' WHEN bool_and(y >= x) THEN 'covered_by' ELSE 'incomparable' END AS "order",
       CAST(sum(greatest(x, y)) AS BIGINT) AS seen FROM pair GROUP BY namespace""",
    "import_verdicts": f"""WITH {SPLIT}, incoming AS (
  SELECT record_id, verified, CASE WHEN node_seq % 7 = 0 THEN md5(record_id) ELSE payload_hash END AS payload_hash FROM here)
SELECT CASE WHEN t.payload_hash = i.payload_hash THEN 'duplicate' WHEN t.record_id IS NOT NULL THEN 'rejected'
            WHEN i.verified THEN 'imported' ELSE 'rejected' END AS verdict, count(*) AS records
FROM incoming i LEFT JOIN there t USING (record_id) GROUP BY ALL""",
    "latest_rewraps": f"""WITH {RECORDS_SQL}, wraps AS (
  SELECT target_id, payload_hash, 'w:' || record_id AS payload FROM records WHERE kind = 'click'
  QUALIFY row_number() OVER (PARTITION BY target_id, payload_hash ORDER BY hlc DESC, record_id DESC) = 1)
SELECT record_id, coalesce(w.payload, r.payload) AS current_payload
FROM records r LEFT JOIN wraps w ON r.record_id = w.target_id AND r.payload_hash = w.payload_hash""",
    "observation_log": f"""WITH {RECORDS_SQL}
SELECT strftime(ts, '%Y-%m-%d') AS date, CAST(row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY hlc, node_id, node_seq, record_id) AS INTEGER) AS position, record_id
FROM records WHERE ts >= TIMESTAMP '2024-01-20 00:00:00'""",
    "revoked_nodes": f"""WITH {RECORDS_SQL} SELECT node_id, count(*) AS records FROM records
WHERE NOT (node_id = 1 AND hlc > '2024-01-10T00:00:00') GROUP BY node_id""",
    "namespace_rules": f"""WITH {RECORDS_SQL}
SELECT record_id AS event_id, kind AS source, CASE kind WHEN 'click' THEN 'web' WHEN 'purchase' THEN 'money' ELSE 'personal' END AS namespace FROM records""",
    "snapshot_retention": f"""WITH {RECORDS_SQL}, shots AS (
  SELECT node_id AS host, record_id AS snapshot_id, ts, node_seq % 20 = 0 AS pinned, CAST(row_number() OVER (PARTITION BY node_id ORDER BY ts DESC, record_id DESC) AS INTEGER) AS rank
  FROM records WHERE kind = 'purchase')
SELECT host, snapshot_id, rank, CASE WHEN rank > 1 AND NOT pinned THEN
  CASE WHEN rank > 100 THEN 'count' WHEN ts < TIMESTAMP '2024-01-27' THEN 'age' END END AS dropped_for FROM shots""",
    "file_changes": f"""WITH {VERSIONS}
SELECT path, CASE WHEN b.hash IS NULL THEN 'added' WHEN a.hash IS NULL THEN 'deleted' WHEN a.hash = b.hash THEN 'unchanged' ELSE 'changed' END AS change
FROM before b FULL JOIN after a USING (path)""",
    "dropped_paths": f"WITH {VERSIONS} SELECT path FROM before EXCEPT SELECT path FROM after",
    "entry_conflicts": f"""WITH {ENTRIES_SQL}
SELECT section, kind, count(DISTINCT lower(text)) AS texts, count(DISTINCT record_id) AS records,
       CASE WHEN bool_or(actionability = 'high') THEN 'high' ELSE 'medium' END AS actionability
FROM entries WHERE reviewable GROUP BY section, kind HAVING count(DISTINCT lower(text)) > 1 AND count(DISTINCT record_id) > 1""",
    "single_slots": f"WITH {ENTRIES_SQL} SELECT section, kind, any_value(entry_id) AS entry_id FROM entries WHERE reviewable GROUP BY section, kind HAVING count(*) = 1",
    "solo_sections": f"WITH {ENTRIES_SQL} SELECT section, any_value(entry_id) AS entry_id FROM entries GROUP BY section HAVING count(*) = 1",
    "divergences": f"""WITH {ENTRIES_SQL}, e AS (
  SELECT section, kind, text, reviewable, record_id, length(text) % 9 = 0 AS explicit, CASE WHEN length(text) % 9 = 0 THEN 'x' || length(text) || '-' || section ELSE entry_id END AS id,
         lower(regexp_replace(regexp_replace(regexp_replace(translate(text, '‘’“”–—*`', '\'\'""--'), '[\\s\\x1c-\\x1f\\x85\\p{{Z}}]+', ' ', 'g'), '^ | $', '', 'g'), '[.,;:!?]+$', '')) AS said FROM entries),
p AS (SELECT * FROM e WHERE record_id IN ('en', 'fr')), n AS (SELECT * FROM e WHERE record_id IN ('de', 'es')),
by_id AS (SELECT p.section, p.kind, p.text AS before, n.text AS after FROM p JOIN n ON p.id = n.id WHERE p.explicit AND n.explicit AND p.reviewable AND p.said <> n.said),
ps AS (SELECT section, kind, any_value(text) AS text, any_value(said) AS said FROM p WHERE reviewable GROUP BY section, kind HAVING count(*) = 1),
ns AS (SELECT section, kind, any_value(text) AS text, any_value(said) AS said FROM n WHERE reviewable GROUP BY section, kind HAVING count(*) = 1),
by_slot AS (SELECT section, kind, ps.text AS before, ns.text AS after FROM ps JOIN ns USING (section, kind) ANTI JOIN by_id USING (section, kind) WHERE ps.said <> ns.said),
po AS (SELECT section, any_value(text) AS text, any_value(said) AS said FROM p GROUP BY section HAVING count(*) = 1 AND bool_and(reviewable)),
no AS (SELECT section, any_value(text) AS text, any_value(said) AS said FROM n GROUP BY section HAVING count(*) = 1),
by_section AS (SELECT section, po.text AS before, no.text AS after FROM po JOIN no USING (section) WHERE po.said <> no.said AND section NOT IN (SELECT section FROM by_id UNION SELECT section FROM by_slot)),
every AS (SELECT 'id' AS signal, before, after FROM by_id UNION ALL SELECT 'slot', before, after FROM by_slot UNION ALL SELECT 'section', before, after FROM by_section)
SELECT signal, count(*) AS pairs, CAST(sum(length(before) + length(after)) AS BIGINT) AS chars FROM every GROUP BY signal""",
}

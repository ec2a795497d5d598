"""The append-only record log: heads, differences, latest-wins views, snapshots, import."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def heads(records: DataFrame) -> DataFrame:
    """(node_id, seq): the last record of each node."""
    return records.groupBy("node_id").agg(F.max("node_seq").alias("seq"))


def frontier(records: DataFrame) -> DataFrame:
    """One row: the heads as a map. A cluster has a bounded number of nodes, one entry each."""
    entries = F.array_sort(F.collect_list(F.struct("node_id", "seq")))
    return heads(records).agg(F.map_from_entries(entries).alias("frontier"))


def counts_by_kind(records: DataFrame) -> DataFrame:
    return records.groupBy("kind").agg(F.count(F.lit(1)).alias("records"))


def head_conflicts(records: DataFrame) -> DataFrame:
    """(node_id, node_seq) that several records claim."""
    n = F.count_distinct("record_id")
    return records.groupBy("node_id", "node_seq").agg(n.alias("records")).filter("records > 1")


def missing_from(here: DataFrame, there: DataFrame) -> DataFrame:
    """Records of ``here`` that ``there`` lacks, by node and id."""
    return here.join(there.select("node_id", "record_id"), ["node_id", "record_id"], "left_anti")


def live(records: DataFrame) -> DataFrame:
    """Records that no tombstone (a record of kind ``tombstone`` with a ``target_id``) names."""
    dead = records.filter("kind = 'tombstone'").select(F.col("target_id").alias("record_id"))
    return records.filter("kind <> 'tombstone'").join(dead, "record_id", "left_anti")


def latest_overrides(records: DataFrame) -> DataFrame:
    """Per (namespace, section) the override of greatest (hlc, record_id); gone if that is a removal or empty."""
    top = F.max_by(F.struct("record_id", "hlc", "action", "body"), F.struct("hlc", "record_id"))
    last = records.groupBy("namespace", "section").agg(top.alias("r")).select("namespace", "section", "r.*")
    return last.filter("action <> 'remove' AND trim(body) <> ''")


def choose_snapshot(snapshots: DataFrame) -> DataFrame:
    """The snapshot that has seen most: greatest sum of its frontier, then hlc, then record_id."""
    seen = F.aggregate(F.map_values("frontier"), F.lit(0).cast("long"), lambda a, x: a + x)
    return snapshots.withColumn("seen", seen).orderBy(F.desc("seen"), F.desc("hlc"), F.desc("record_id")).limit(1)


def latest_rewrap(records: DataFrame, rewraps: DataFrame, on: tuple[str, ...] = ("payload_hash",)) -> DataFrame:
    """Each record with the payload of its latest rewrap for the same id and the same columns ``on`` (envelope hash and key, if given), else its own."""
    last = rewraps.groupBy(F.col("target_id").alias("record_id"), *on).agg(F.max_by("payload", F.struct("hlc", "record_id")).alias("rewrapped"))
    met = records.join(last, ["record_id", *on], "left")
    return met.withColumn("current_payload", F.coalesce("rewrapped", "payload")).drop("rewrapped")


def classify_import(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Verdict per incoming record: duplicate (same bytes), rejected (an id with other bytes, or unverified), else imported."""
    known = stored.select("record_id", F.col("payload_hash").alias("known_hash"))
    met = incoming.join(known, "record_id", "left")
    verdict = (
        F.when(F.col("known_hash") == F.col("payload_hash"), "duplicate")
        .when(F.col("known_hash").isNotNull(), "rejected")
        .when(F.col("verified"), "imported")
        .otherwise("rejected")
    )
    return met.withColumn("verdict", verdict).drop("known_hash")


def not_revoked(records: DataFrame, nodes: DataFrame) -> DataFrame:
    """Records up to their node's revocation (nodes: node_id, revoked_after; null if it stands)."""
    met = records.join(nodes, "node_id", "left")
    return met.filter(F.col("revoked_after").isNull() | (F.col("hlc") <= F.col("revoked_after"))).drop("revoked_after")


def namespaces(events: DataFrame, rules: DataFrame, default: str = "personal") -> DataFrame:
    """``events`` (event_id, source) with the namespace of the first rule (ord, source, namespace) that matches.

    A rule without a source matches all; rules are a small settings table.
    """
    first = F.min(F.struct("ord", "namespace"))
    named = rules.filter("source IS NOT NULL").groupBy("source").agg(first.alias("named"))
    every = rules.filter("source IS NULL").agg(first.alias("every"))
    # Rules are settings: one row per named source, one for all.
    met = events.join(F.broadcast(named), "source", "left").join(F.broadcast(every))
    rule = F.least("named", "every")
    return met.withColumn("namespace", F.coalesce(rule["namespace"], F.lit(default))).select(*events.columns, "namespace")


def observation_log(records: DataFrame, since: Column) -> DataFrame:
    """Observation records after ``since`` with their position in their day: by stamp, node, sequence, id.

    A record's position is that within the hour of its stamp plus the records of the hours before it, so a busy day is ranked by hours.
    """
    rows = records.filter(F.col("ts") >= since).withColumns({"date": F.to_date("ts"), "_hour": F.substring("hlc", 1, 13)})
    hours = rows.groupBy("date", "_hour").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("date").orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1))
    starts = hours.select("date", "_hour", F.coalesce(before, F.lit(0)).alias("_before"))
    order = Window.partitionBy("date", "_hour").orderBy("hlc", "node_id", "node_seq", "record_id")
    placed = rows.withColumn("_at", F.row_number().over(order)).join(starts, ["date", "_hour"])
    return placed.withColumn("position", (F.col("_before") + F.col("_at")).cast("int")).select(*records.columns, "date", "position")


def retained(snapshots: DataFrame, keep: int, oldest: Column, by: str = "host") -> DataFrame:
    """Snapshots of each host with the reason they go (``count``, ``age``) or null; the newest and pinned ones stay.

    A host keeps few snapshots; hosts are ranked apart from each other.
    """
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("created_at"), F.desc("snapshot_id")))
    ranked = snapshots.withColumn("rank", rank)
    free = (F.col("rank") > 1) & ~F.col("pinned")
    reason = F.when(free & (F.col("rank") > keep), "count").when(free & (F.col("created_at") < oldest), "age")
    return ranked.withColumn("dropped_for", reason)


def unseen(messages: DataFrame, seen: DataFrame) -> DataFrame:
    """Inbox messages whose id the state does not hold, oldest first."""
    return messages.join(seen.select("message_id"), "message_id", "left_anti").orderBy("timestamp", "message_id")


def tombstones(targets: DataFrame, hlc: Column) -> DataFrame:
    """Rows that bury records (record_id, node_id): to be numbered by ``sinks.next_records`` and appended."""
    return targets.select("node_id", F.lit("tombstone").alias("kind"), F.col("record_id").alias("target_id"), hlc.alias("hlc"), F.row_number().over(Window.partitionBy("node_id").orderBy("record_id")).alias("ord"))


def rewraps_due(records: DataFrame, rewraps: DataFrame, key_id: str) -> DataFrame:
    """Records under an old key that no rewrap of the same id and hash covers."""
    done = rewraps.select(F.col("target_id").alias("record_id"), "payload_hash").distinct()
    return records.filter(F.col("key_id") == key_id).join(done, ["record_id", "payload_hash"], "left_anti")

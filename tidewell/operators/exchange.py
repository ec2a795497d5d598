"""What hosts exchange: views of the record log, snapshots, mail, batch jobs, node and peer listings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.clocks import frontier_covers, frontier_order
from tidewell.functions.text import head_within, is_id, strip
from tidewell.operators.records import frontier

GENERATED = "<!-- Generated from the record log. -->\n"
#: The kinds of mail and of records.
MAIL_KINDS = ("memory-note", "context-pack", "recall-request", "recall-response")
RECORD_KINDS = ("observation", "reflection_snapshot", "manual_override", "tombstone", "node_membership", "key_rotation", "key_epoch", "payload_rewrap")


def catch_up_flag(chosen: DataFrame, observations: DataFrame) -> DataFrame:
    """The chosen snapshot with ``catch_up``: whether the log has observations beyond its frontier."""
    seen = frontier(observations).select(F.col("frontier").alias("_seen"))  # one row
    return chosen.join(F.broadcast(seen)).withColumn("catch_up", ~frontier_covers(F.col("frontier"), F.col("_seen"))).drop("_seen")


def reflections_view(chosen: DataFrame) -> DataFrame:
    """(text): the body of the chosen snapshot under the generated header, with a note if it lags; no row for an empty body."""
    note = F.when(F.col("catch_up"), "\n\n<!-- Cluster reflection catch-up needed: local observations exceed selected snapshot frontier. -->").otherwise("")
    return chosen.filter(strip(F.col("body")) != "").select(F.concat(F.lit(GENERATED), strip(F.col("body")), note, F.lit("\n")).alias("text"))


def competing(snapshots: DataFrame, chosen: DataFrame, most: int = 4000) -> DataFrame:
    """(record_id, text): the snapshots whose frontier neither covers the chosen one's nor is covered, each cut to ``most`` characters."""
    own = chosen.select(F.col("record_id").alias("_id"), F.col("frontier").alias("_own"))  # one row
    met = snapshots.join(F.broadcast(own)).filter((F.col("record_id") != F.col("_id")) & (frontier_order(F.col("_own"), F.col("frontier")) == "incomparable"))
    return met.select("record_id", F.concat(F.lit("## Candidate snapshot "), "record_id", F.lit("\n\n"), head_within(F.col("body"), most)).alias("text"))


def conflict_files(conflicts: DataFrame, entries: DataFrame) -> DataFrame:
    """(section, kind, json, markdown) of every conflict, both from the same entries (record_id, node, text), in their order."""
    entry = F.struct("record_id", "node", "text")
    rows = entries.filter("reviewable").join(conflicts.select("section", "kind"), ["section", "kind"]).groupBy("section", "kind").agg(F.array_sort(F.collect_set(entry)).alias("es"))
    line = lambda e: F.concat(F.lit("- `"), e["record_id"], F.lit("` `"), e["node"], F.lit("` "), e["text"])
    head = F.concat(F.lit("## "), "section", F.lit(" ("), "kind", F.lit(")\n\n"))
    return rows.select("section", "kind", F.to_json("es").alias("json"), F.concat(head, F.array_join(F.transform("es", line), "\n")).alias("markdown"))


ORDS = 1 << 16


def merged_clocks(stamps: DataFrame) -> DataFrame:
    """(node_id, wall, counter): each node's clock after it received its stamps (ord, wall, counter, now) in order, starting from none.

    ``ord`` is a distinct long per node. A clock's wall is the latest of all walls and local times, and from the first row that reaches it on, every row
    counts one up, after taking a larger counter of the same wall. So the counter is the most that a row of that wall, or the first row, comes to
    with one for each row after it; rows are counted in blocks of ``ORDS`` ords, and no node's rows meet in one group.
    """
    rows = stamps.select("node_id", "ord", "wall", F.col("counter").cast("long").alias("counter"), F.greatest("wall", "now").alias("top"), F.floor(F.col("ord") / ORDS).alias("block"))
    best = rows.groupBy("node_id").agg(F.max(F.struct("top", (-F.col("ord")).alias("back"))).alias("t")).select("node_id", F.col("t.top").alias("latest"), (-F.col("t.back")).alias("first"))
    blocks = rows.groupBy("node_id", "block").agg(F.count(F.lit(1)).alias("n"))
    later = F.sum("n").over(Window.partitionBy("node_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("node_id", "block", F.coalesce(later, F.lit(0)).alias("later"))
    inside = F.row_number().over(Window.partitionBy("node_id", "block").orderBy(F.desc("ord"))) - 1
    placed = rows.withColumn("inside", inside).join(blocks, ["node_id", "block"]).join(best, "node_id")
    own = F.when(F.col("wall") == F.col("latest"), F.col("counter") + 1).otherwise(0)
    told = placed.filter((F.col("ord") == F.col("first")) | (F.col("ord") > F.col("first")) & (F.col("wall") == F.col("latest")))
    return told.groupBy("node_id").agg(F.max("latest").alias("wall"), F.max(own + F.col("inside") + F.col("later")).alias("counter"))


def record_index(records: DataFrame) -> DataFrame:
    """The index of the log: where each record is and what it is, without payloads."""
    path = F.concat(F.lit("records/"), F.col("node_id").cast("string"), F.lit("/"), F.col("record_id"), F.lit(".omr.json"))
    return records.select("record_id", path.alias("path"), "node_id", "node_seq", "hlc", "kind", "namespace")


def listed_records(records: DataFrame, kind: str | None = None) -> DataFrame:
    """Live records of a kind, by stamp, node, sequence and id."""
    from tidewell.operators.records import live

    rows = live(records)
    return (rows if kind is None else rows.filter(F.col("kind") == kind)).orderBy("hlc", "node_id", "node_seq", "record_id")


def pull_order(there: DataFrame, here: DataFrame) -> DataFrame:
    """Remote records that are not here, memberships first, then by sequence and id."""
    missing = there.join(here.select("node_id", "record_id"), ["node_id", "record_id"], "left_anti")
    return missing.withColumn("first", F.col("kind") == "node_membership").orderBy(F.desc("first"), "node_seq", "record_id")


def push_new(records: DataFrame, remote: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a push writes: the records that the remote lacks (it never overwrites one), and the heads, which replace the old ones."""
    fresh = records.join(remote.select("node_id", "record_id"), ["node_id", "record_id"], "left_anti")
    heads = records.groupBy("node_id").agg(F.max("node_seq").alias("seq"))
    return fresh, heads


def consistent(files: DataFrame) -> DataFrame:
    """Shared record files (path, record_id, node_id) whose path names the record and node that they hold."""
    named = F.regexp_extract("path", r"([^/]+)\.omr\.json$", 1)
    folder = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    return files.filter((named == F.col("record_id")) & (folder == F.col("node_id").cast("string")))


def sync_totals(transports: DataFrame) -> DataFrame:
    """One row: records pulled, pushed, rejected and transports that failed."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return transports.agg(total("pulled"), total("pushed"), total("rejected"), F.count_if(F.col("error").isNotNull()).alias("failed"))


def peer_union(*peers: DataFrame) -> DataFrame:
    """(node_id, record_id) that any peer has, once."""
    return reduce(DataFrame.unionByName, [p.select("node_id", "record_id") for p in peers]).distinct()


def first_answer(answers: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the value of the first peer (peer, value) that has one."""
    known = answers.filter("value IS NOT NULL")
    return answers.select(*keys).distinct().join(known.groupBy(*keys).agg(F.min_by("value", "peer").alias("value")), keys, "left")


def pending_nodes(announced: DataFrame, trusted: DataFrame, most: int = 128) -> DataFrame:
    """Announced nodes that are not trusted, the newest ``most`` (a limit of the listing)."""
    return announced.join(trusted.select("node_id"), "node_id", "left_anti").orderBy(F.desc("announced_at"), "node_id").limit(most)


def rewrap_report(records: DataFrame, rewraps: DataFrame, key_id: str) -> DataFrame:
    """(kind, records, ready): records under the old key, and those among them that a rewrap of the same id and hash covers."""
    done = rewraps.select(F.col("target_id").alias("record_id"), "payload_hash").distinct().withColumn("_done", F.lit(True))
    met = records.filter(F.col("key_id") == key_id).join(done, ["record_id", "payload_hash"], "left")
    return met.groupBy("kind").agg(F.count(F.lit(1)).alias("records"), F.count_if("_done").alias("ready"))


def record_problem(cluster: str) -> Column:
    """The first reason to refuse a record (record_id, cluster_id, key_id, version, kind, hash, verified), null if none."""
    ladder = [
        (~is_id(F.col("record_id"), "sha256:"), "bad record id"),
        (F.col("key_id").isNull(), "missing encryption metadata"),
        (F.coalesce("version", F.lit(0)) != 1, "unsupported record version"),
        (F.coalesce("cluster_id", F.lit("")) != cluster, "cluster mismatch"),
        (~F.coalesce(F.col("kind").isin(*RECORD_KINDS), F.lit(False)), "unknown record kind"),
        (F.coalesce(F.concat(F.lit("sha256:"), "hash") != F.col("record_id"), F.lit(True)), "record id mismatch"),
        (~F.coalesce("verified", F.lit(False)), "signature verification failed"),
    ]
    return F.coalesce(*[F.when(test, reason) for test, reason in ladder])


def envelope_problem() -> Column:
    """The first reason to refuse a mail envelope (json text ``raw``), null if none."""
    v = F.try_parse_json("raw")
    get = lambda p, kind="string": F.try_variant_get(v, p, kind)
    text = lambda p: F.coalesce(get(p), F.lit("")) != ""
    ladder = [
        (v.isNull(), "not valid JSON"),
        (~F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(False)), "not an object"),
        (F.coalesce(get("$.om_mail", "int"), F.lit(0)) != 1, "unsupported version"),
        (~F.coalesce(get("$.kind").isin(*MAIL_KINDS), F.lit(False)), "unknown kind"),
        (~(text("$.id") & text("$.sent_at") & text("$.signature_b64")), "missing field"),
        (~(text("$.sender.address") & text("$.sender.signing_public_key_b64")), "missing sender"),
        (get("$.payload", "variant").isNull(), "missing payload"),
    ]
    return F.coalesce(*[F.when(test, reason) for test, reason in ladder])


def inbound(mail: DataFrame, peers: DataFrame, respond: bool) -> DataFrame:
    """Adds ``action`` and ``reason`` to mail (sender, kind, attached, problem, verified, decrypted, request_id).

    ``peers`` (address, auto_accept, allow_recall) are settings. Actions: skipped, held, ingested, packs, responded, responses.
    """
    known = F.broadcast(peers.select(F.col("address").alias("sender"), "auto_accept", "allow_recall", F.lit(True).alias("_peer")))
    met = mail.join(known, "sender", "left")
    kind = F.col("kind")
    held = [
        (F.col("problem").isNotNull(), F.concat(F.lit("malformed envelope: "), "problem")),
        (F.col("_peer").isNull(), F.lit("unknown sender")),
        (~F.coalesce("verified", F.lit(False)), F.lit("signature verification failed")),
        (~F.coalesce("decrypted", F.lit(False)), F.lit("payload cannot be decrypted")),
        ((kind == "memory-note") & ~F.col("auto_accept"), F.lit("awaiting explicit accept")),
        ((kind == "recall-request") & ~F.col("allow_recall"), F.lit("peer not allowed")),
        ((kind == "recall-request") & ~F.lit(respond), F.lit("recall pending")),
        ((kind == "recall-response") & (F.coalesce("request_id", F.lit("")) == ""), F.lit("missing request id")),
        (~F.coalesce(kind.isin(*MAIL_KINDS), F.lit(False)), F.lit("unsupported kind")),
    ]
    why = F.when(~F.col("attached"), F.lit("plain email"))
    for test, reason in held:
        why = why.when(test, reason)
    done = F.when(kind == "memory-note", "ingested").when(kind == "context-pack", "packs").when(kind == "recall-request", "responded").otherwise("responses")
    routed = met.withColumn("reason", why)
    action = F.when(~F.col("attached"), "skipped").when(F.col("reason").isNotNull(), "held").otherwise(done)
    return routed.withColumn("action", action).drop("_peer", "auto_accept", "allow_recall")


def recheck_held(held: DataFrame, peers: DataFrame) -> DataFrame:
    """Adds ``refused``: why an accepted held note may still not enter (null: it may). Trust is checked anew, whatever the peer's flags."""
    known = F.broadcast(peers.select(F.col("address").alias("sender"), F.lit(True).alias("_peer")))
    met = held.join(known, "sender", "left")
    ladder = [
        (F.col("problem").isNotNull(), "malformed"),
        (F.col("kind") != "memory-note", "not a note"),
        (F.col("_peer").isNull(), "sender not pinned"),
        (~F.coalesce("verified", F.lit(False)), "signature"),
        (~F.coalesce("decrypted", F.lit(False)), "payload"),
    ]
    return met.withColumn("refused", F.coalesce(*[F.when(t, r) for t, r in ladder])).drop("_peer")


def answered(requests: DataFrame, mail: DataFrame) -> DataFrame:
    """Requests (request_id, peer) with the first valid response (by timestamp, then id) that their peer sent."""
    good = mail.filter("kind = 'recall-response' AND verified").select("request_id", F.col("sender").alias("peer"), "timestamp", "message_id")
    first = good.groupBy("request_id", "peer").agg(F.min(F.struct("timestamp", "message_id")).alias("r"))
    return requests.join(first, ["request_id", "peer"], "left").select("request_id", "peer", F.col("r.message_id").alias("response_id"))


def inbox(messages: DataFrame, after: str | None = None, limit: int = 50) -> DataFrame:
    """The oldest ``limit`` messages strictly after a timestamp."""
    rows = messages if after is None else messages.filter(F.col("timestamp") > after)
    return rows.orderBy("timestamp", "message_id").limit(limit)


def due_mail(messages: DataFrame, seen: DataFrame, cursor: Column, rewind_seconds: int = 1) -> DataFrame:
    """Messages from a second before the cursor on that the state has not seen: late ones of the cursor's second come through."""
    near = messages.filter(F.col("timestamp").cast("timestamp").cast("double") >= cursor.cast("double") - rewind_seconds)
    return near.join(seen.select("message_id"), "message_id", "left_anti")


def held_listing(held: DataFrame) -> DataFrame:
    """(name, sender, reason, readable) of held files (name, raw): those that are no JSON object are listed as unreadable."""
    v = F.try_parse_json("raw")
    ok = F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(False))
    get = lambda p: F.when(ok, F.coalesce(F.try_variant_get(v, p, "string"), F.lit("")))
    return held.select("name", F.coalesce(get("$.sender"), F.lit("")).alias("sender"), F.coalesce(get("$.reason"), F.lit("unreadable")).alias("reason"), ok.alias("readable"))


def jobs_listing(jobs: DataFrame, pending_only: bool = False) -> DataFrame:
    """Jobs, newest first; if asked, only those that a batch may still complete."""
    rows = jobs.filter(F.col("status").isin("submitted", "in_progress", "pending")) if pending_only else jobs
    return rows.orderBy(F.desc("created_at"), "job_id")


def response_lines(lines: DataFrame, jobs: DataFrame) -> DataFrame:
    """Jobs (custom_id) with the first line (line_no, line) of the output that answers them; lines that are no JSON do not count."""
    v = F.try_parse_json("line")
    said = lines.select(F.try_variant_get(v, "$.custom_id", "string").alias("custom_id"), "line_no", F.try_variant_get(v, "$.response.status_code", "int").alias("code"))
    first = said.filter("custom_id IS NOT NULL").groupBy("custom_id").agg(F.min(F.struct("line_no", "code")).alias("r"))
    return jobs.join(first, "custom_id", "left").select(jobs["*"], F.col("r.line_no").alias("line_no"), F.col("r.code").alias("code"))


def job_outcomes(jobs: DataFrame) -> DataFrame:
    """Adds ``next_status`` to jobs (status, batch_id, batch_status, output_file_id, line_no, code, drifted): one step of the life cycle.

    Applied and failed ones stay. Without a batch id there is nothing to ask: the job stays, as it does while the batch runs.
    """
    done = F.when(F.col("output_file_id").isNull() | F.col("line_no").isNull(), "failed").when(F.coalesce("code", F.lit(0)) != 200, "failed").when(F.col("drifted"), "drifted").otherwise("applied")
    state = F.col("batch_status")
    waiting = F.col("status").isin("submitted", "in_progress", "pending") & F.col("batch_id").isNotNull()
    moved = F.when(state == "completed", done).when(state.isin("failed", "expired", "cancelled"), state).otherwise(F.col("status"))
    return jobs.withColumn("next_status", F.when(waiting, moved).otherwise(F.col("status")))


def snapshot_listing(manifests: DataFrame) -> DataFrame:
    """Snapshots (snapshot_id, created_at, files array<struct<path,bytes>>) with their files and bytes, newest first."""
    total = F.aggregate("files", F.lit(0).cast("long"), lambda a, f: a + f["bytes"])
    rows = manifests.filter(F.col("files").isNotNull())
    return rows.select("snapshot_id", "created_at", F.size("files").cast("long").alias("n_files"), total.alias("bytes")).orderBy(F.desc("created_at"), F.desc("snapshot_id"))


def selected_snapshot(snapshots: DataFrame, selector: str | None = None) -> DataFrame:
    """The newest snapshot for None or ``latest``, else the one of that id; reading no row raises an error in the job."""
    if selector in (None, "latest"):
        rows = snapshots.orderBy(F.desc("created_at"), F.desc("snapshot_id")).limit(1)
    else:
        rows = snapshots.filter(F.col("snapshot_id") == selector).limit(1)
    found = rows.agg(F.max_by(F.struct(*snapshots.columns), "snapshot_id").alias("s"))
    known = F.when(F.col("s").isNull(), F.raise_error(F.lit(f"no snapshot {selector or 'latest'}"))).otherwise(F.col("s"))
    return found.select(known.alias("s")).select("s.*")


def restore_plan(listed: DataFrame, stored: DataFrame, current: DataFrame) -> DataFrame:
    """(path, step): what a restore does, if the stored files verify: write, keep or remove; one problem makes every step ``abort``."""
    from tidewell.sources.sinks import manifest, verify

    bad = verify(listed, stored).agg((F.count(F.lit(1)) > 0).alias("bad"))  # one row
    now = manifest(current).select("path", F.col("sha256").alias("now"))
    met = listed.select("path", F.col("sha256").alias("want")).join(now, "path", "full_outer").join(F.broadcast(bad))
    step = F.when(F.col("bad"), "abort").when(F.col("want").isNull(), "remove").when(F.col("want") == F.col("now"), "keep").otherwise("write")
    return met.select("path", step.alias("step"))


def source_metadata(events: DataFrame) -> DataFrame:
    """Provenance of events (source, first_source, path, cwd, remote, alias): names in clear, places as hashes, a project of 80 characters at most."""
    hashed = lambda c: F.concat(F.lit("sha256:"), F.sha2(c, 256))
    folder = F.regexp_extract("path", "([^/]+)/[^/]*$", 1)
    return events.select(
        F.coalesce(F.nullif("source", F.lit("")), F.nullif("first_source", F.lit("")), F.lit("manual")).alias("agent"),
        F.col("alias").alias("host_alias"),
        F.nullif(F.substring(F.regexp_replace(folder, "[^A-Za-z0-9._-]+", "-"), 1, 80), F.lit("")).alias("project"),
        hashed("path").alias("transcript_id"), hashed("cwd").alias("cwd_hash"), hashed("remote").alias("project_id"),
    )

"""Normalised messages: cursors, batches, windows, transcript text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _in_order(*extra: str) -> Window:
    return Window.partitionBy("path").orderBy("line_no", *extra)


def numbered(messages: DataFrame) -> DataFrame:
    """Adds ``msg_index`` (from 1) per path, by line."""
    return messages.withColumn("msg_index", F.row_number().over(_in_order()))


def after_uuid(messages: DataFrame, cursors: DataFrame) -> DataFrame:
    """Messages after the line of their path's cursor (path, uuid). A null cursor keeps all; one that is never met keeps none."""
    at = messages.join(cursors.filter("uuid IS NOT NULL").select("path", "uuid"), ["path", "uuid"]).groupBy("path").agg(F.max("line_no").alias("at"))
    met = messages.join(cursors.select("path", F.col("uuid").alias("cursor")), "path", "left").join(at, "path", "left")
    return met.filter(F.col("cursor").isNull() | (F.col("line_no") > F.col("at"))).drop("cursor", "at")


def after_count(messages: DataFrame, cursors: DataFrame) -> DataFrame:
    """Messages beyond the count of their path's cursor (path, seen); a count beyond the messages starts anew."""
    counted = numbered(messages).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("path")))
    met = counted.join(cursors.select("path", "seen"), "path", "left")
    start = F.when(F.coalesce("seen", F.lit(0)) > F.col("n"), 0).otherwise(F.coalesce("seen", F.lit(0)))
    return met.filter(F.col("msg_index") > start).drop("n", "seen")


def gated(messages: DataFrame, least: int = 5) -> DataFrame:
    """Messages of paths that have ``least`` of them; the others wait."""
    ready = messages.groupBy("path").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select("path")
    return messages.join(ready, "path", "left_semi")


def batches(messages: DataFrame, size: int) -> DataFrame:
    """Adds ``batch`` (from 0): runs of ``size`` messages of a path."""
    return numbered(messages).withColumn("batch", F.floor((F.col("msg_index") - 1) / size).cast("long"))


def newest_turns(messages: DataFrame, n: int) -> DataFrame:
    """The last ``n`` messages of each path."""
    rank = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("line_no")))
    return messages.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def latest_timestamp(messages: DataFrame) -> DataFrame:
    """(path, latest): greatest timestamp text that is not empty."""
    return messages.groupBy("path").agg(F.max(F.nullif("timestamp", F.lit(""))).alias("latest"))


def transcript(messages: DataFrame) -> DataFrame:
    """(path, text): messages as ``[timestamp] ROLE [source]: content`` blocks, in order."""
    stamp = F.when(F.coalesce("timestamp", F.lit("")) == "", "??:??").otherwise(F.substring("timestamp", 1, 19))
    name = F.when(F.col("role") == "user", "USER").otherwise("ASSISTANT")
    tag = F.when(F.coalesce("source", F.lit("")) == "", "").otherwise(F.concat(F.lit("["), F.col("source"), F.lit("]")))
    block = F.concat(F.lit("["), stamp, F.lit("] "), name, F.lit(" "), tag, F.lit(": "), F.col("content"))
    rows = messages.select("path", F.struct("line_no", block.alias("block")).alias("x"))
    ordered = F.transform(F.array_sort(F.collect_list("x")), lambda x: x["block"])
    return rows.groupBy("path").agg(F.array_join(ordered, "\n\n").alias("text"))


def checkpoint_due(sessions: DataFrame, now: Column, interval_seconds: int) -> DataFrame:
    """Adds ``due``: new messages, and a forced event or the interval over since the last checkpoint."""
    fresh = F.col("message_count") > F.coalesce("seen_count", F.lit(0))
    waited = F.col("last_observed").isNull() | (now.cast("long") - F.col("last_observed").cast("long") >= interval_seconds)
    return sessions.withColumn("due", fresh & (F.col("forced") | waited))


def after_timestamp(messages: DataFrame, cursors: DataFrame) -> DataFrame:
    """Messages after the first of their path with the cursor's timestamp (path, timestamp); one that is never met keeps none, no cursor all."""
    named = cursors.filter("timestamp IS NOT NULL").select("path", F.col("timestamp").alias("cursor"))
    at = messages.join(named, "path").filter("timestamp = cursor").groupBy("path").agg(F.min("line_no").alias("at"))
    met = messages.join(named, "path", "left").join(at, "path", "left")
    return met.filter(F.col("cursor").isNull() | (F.col("line_no") > F.col("at"))).drop("cursor", "at")


def within_lines(messages: DataFrame, after: int = 0, before: int | None = None) -> DataFrame:
    """Messages of the physical lines (after, before]."""
    rows = messages.filter(F.col("line_no") > after)
    return rows if before is None else rows.filter(F.col("line_no") <= before)


def after_lines(messages: DataFrame, cursors: DataFrame) -> DataFrame:
    """Messages beyond the physical line of their path's cursor (path, line)."""
    met = messages.join(cursors.select("path", "line"), "path", "left")
    return met.filter(F.col("line_no") > F.coalesce("line", F.lit(0))).drop("line")


def migrated_cursors(messages: DataFrame, cursors: DataFrame) -> DataFrame:
    """(path, seen): counts of messages for cursors that may still be line offsets, as those beyond the message count are.

    Such an offset becomes the number of messages up to that line, all of which have text; nothing beyond it is skipped.
    """
    met = messages.join(cursors.select("path", "seen"), "path")
    sums = met.groupBy("path", "seen").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("line_no") <= F.col("seen")).alias("until"))
    return sums.select("path", F.when(F.col("seen") > F.col("n"), F.col("until")).otherwise(F.col("seen")).alias("seen"))


def advanced(pending: DataFrame, cursors: DataFrame, least: int = 5) -> DataFrame:
    """(path, seen): cursors after a run: those of paths with ``least`` pending messages move by what was read, the others stay."""
    read = pending.groupBy("path").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    met = cursors.select("path", "seen").join(read, "path", "full_outer")
    return met.select("path", (F.coalesce("seen", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("seen"))


def prompt_turns(turns: DataFrame, snippets: DataFrame, keep: int = 4, status: str = "OK") -> DataFrame:
    """(path, prompt): what a reply is asked with: the numbered snippets (path, rank, text), or the status, and the last turns in order."""
    history = F.concat(F.initcap("role"), F.lit(": "), "content").alias("turn")
    last = newest_turns(turns, keep).select("path", F.struct("line_no", history).alias("x"))
    said = last.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["turn"]), "\n").alias("history"))
    noted = F.struct("rank", F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), "text").alias("note"))
    known = snippets.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(noted)), lambda x: x["note"]), "\n").alias("memory"))
    met = said.join(known, "path", "left")
    memory = F.coalesce("memory", F.lit(f"(no memories: {status})"))
    return met.select("path", F.concat(F.lit("Memories:\n"), memory, F.lit("\n\nConversation:\n"), "history").alias("prompt"))

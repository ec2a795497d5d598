"""Notes without their expired snapshots: dropped, marked, or moved to a section of their own at the end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.text import BLANKS, is_stale, iso_moment, metadata

#: The section of expired snapshots and the mark of one that stays.
STALE_SECTION = "Stale snapshots"
STALE_MARK = "<!-- stale=true -->"
ACTIONS = ("stale-section", "drop", "annotate")
_BREAK = "\r\n|[\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def marked(line: Column) -> Column:
    """A line with the mark of an expired snapshot at its end, once."""
    return F.when(F.contains(line, F.lit("stale=true")), line).otherwise(F.concat(F.regexp_replace(line, f"(?U){BLANKS}+$", ""), F.lit(f" {STALE_MARK}")))


def _lines(text: Column, now: Column, ttl_days: int) -> Column:
    """array<struct<line, stale>> of a text; what stands in the section of expired snapshots, and headings, are never stale."""
    heading = r"#{2,6}[^\S\n]+[^\n]"
    pieces = F.split(F.regexp_replace(text, _BREAK, "\n"), rf"(?md)(?=^{heading})")

    # Each step binds what the next ones name several times: a section's kind once a section, a comment once a line that has one.
    name = lambda p: F.lower(F.btrim(F.regexp_extract(p, r"\A#{2,6}[^\S\n]+([^\n]+)", 1), F.lit(" \t")))
    read = lambda line: F.struct(line.alias("line"), F.when(F.contains(line, F.lit("<!--om:")), metadata(line)).alias("fields"))
    field = lambda x, k: F.try_element_at(x["fields"], F.lit(k))
    seen = lambda x: F.struct(x["line"].alias("line"), F.when(field(x, "kind") == "snapshot", field(x, "last_seen")).alias("seen"))

    def lines(piece: Column, spared: Column) -> Column:
        old = lambda x: x["seen"].isNotNull() & ~spared & is_stale(iso_moment(x["seen"]), now, ttl_days) & ~x["line"].rlike(rf"\A{heading}")
        each = F.transform(F.transform(F.split(F.regexp_replace(piece, r"\n\z", ""), "\n"), read), seen)
        return F.transform(each, lambda x: F.struct(x["line"].alias("line"), old(x).alias("stale")))

    sections = F.transform(pieces, lambda p: F.struct(p.alias("piece"), (name(p) == STALE_SECTION.lower()).alias("spared")))
    return F.flatten(F.transform(sections, lambda x: lines(x["piece"], x["spared"])))


def pruned_notes(notes: DataFrame, now: Column, ttl_days: int = 14, action: str = "stale-section", doc: str = "doc", text: str = "text") -> DataFrame:
    """(doc, text, pruned, annotated, stale_sectioned): each note after pruning, and how many lines were dropped, marked or moved.

    Stale are lines whose comment says kind=snapshot and a last_seen at least ``ttl_days`` whole days ago; one that is missing or no time is not.
    Expressions only, a note at a time, with no shuffle. Every note ends with one line end; a null text is an empty one.
    """
    if action not in ACTIONS:
        raise ValueError(action)
    return pruned_each_way(notes, now, ttl_days, (action,), doc, text).drop("action")


def pruned_each_way(notes: DataFrame, now: Column, ttl_days: int = 14, actions: tuple[str, ...] = ACTIONS, doc: str = "doc", text: str = "text") -> DataFrame:
    """``pruned_notes`` for each of the actions, with the ``action``; a note is read once for all of them."""
    rows = notes.select(F.col(doc).alias("doc"), _lines(F.coalesce(F.col(text), F.lit("")), now, ttl_days).alias("_lines"))
    joined = lambda lines: F.array_join(F.transform(lines, lambda x: x["line"]), "\n")
    rows = rows.select("doc", "_lines", F.filter("_lines", lambda x: x["stale"]).alias("_stale"), joined(F.filter("_lines", lambda x: ~x["stale"])).alias("_kept"))
    rows = rows.withColumn("_above", F.regexp_replace("_kept", r"\n+\z", ""))
    noted = F.array_join(F.transform("_lines", lambda x: F.when(x["stale"], marked(x["line"])).otherwise(x["line"])), "\n")
    moved = F.concat("_above", F.when(F.col("_above") == "", "\n").otherwise("\n\n"), F.lit(f"## {STALE_SECTION}\n\n"), joined(F.col("_stale")))
    shown = {"drop": F.col("_kept"), "annotate": noted, "stale-section": F.when(F.size("_stale") > 0, moved).otherwise(F.col("_kept"))}
    whole = lambda a: F.concat(F.regexp_replace(shown[a], rf"(?U){BLANKS}+\z", ""), F.lit("\n")).alias("text")
    n = F.size("_stale").cast("long")
    counts = lambda action: [(n if action == a else F.lit(0).cast("long")).alias(c) for a, c in (("drop", "pruned"), ("annotate", "annotated"), ("stale-section", "stale_sectioned"))]
    return rows.select("doc", F.inline(F.array(*[F.struct(whole(a), *counts(a), F.lit(a).alias("action")) for a in actions])))

"""Differences between two versions: files, entries, conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.text import comparable
from tidewell.sources.sinks import written


def file_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change): added, changed, deleted or unchanged, by the hash of each path."""
    met = before.select("path", F.col("hash").alias("old")).join(after.select("path", F.col("hash").alias("new")), "path", "full_outer")
    change = (
        F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") == F.col("new"), "unchanged").otherwise("changed")
    )
    return met.select("path", change.alias("change"))


def conflicts(entries: DataFrame) -> DataFrame:
    """Slots (section, kind) in which reviewable entries of several records say different things."""
    rows = entries.filter("reviewable")
    found = rows.groupBy("section", "kind").agg(
        F.count_distinct(F.unhex(F.md5(F.lower("text")))).alias("texts"),  # digests travel, not texts
        F.count_distinct("record_id").alias("records"),
        F.when(F.max((F.col("actionability") == "high").cast("int")) == 1, "high").otherwise("medium").alias("actionability"),
    )
    return found.filter("texts > 1 AND records > 1")


def single_slots(entries: DataFrame) -> DataFrame:
    """The entry of each slot that holds one reviewable entry."""
    found = entries.filter("reviewable").groupBy("section", "kind").agg(F.count(F.lit(1)).alias("n"), F.any_value("entry_id").alias("entry_id"))
    return found.filter("n = 1").drop("n")


def solo_sections(entries: DataFrame, reviewable_only: bool = False) -> DataFrame:
    """The entry of each section that holds one entry of any kind; if asked, only where that one is reviewable."""
    found = entries.groupBy("section").agg(
        F.count(F.lit(1)).alias("n"), F.any_value("entry_id").alias("entry_id"), F.bool_or("reviewable").alias("reviewable")
    )
    found = found.filter("n = 1")
    return (found.filter("reviewable") if reviewable_only else found).select("section", "entry_id")


def divergences(prior: DataFrame, new: DataFrame) -> DataFrame:
    """Entries that changed silently between two versions (entry_id, id_explicit, section, kind, text, reviewable).

    By explicit id first; then by slot, then by section, each where both sides hold a single entry and
    no earlier signal names the slot or section.
    """

    columns = ["section", "kind", "entry_id", "text", "reviewable", "id_explicit"]
    # Both versions are read several times; each text is made comparable once, not once a pair.
    prior, new = (written(side.select(*columns, comparable(F.col("text")).alias("said")), "version") for side in (prior, new))

    def met(left: DataFrame, right: DataFrame, on: list[str], signal: str) -> DataFrame:
        pairs = left.alias("p").join(right.alias("n"), on).filter("p.said <> n.said")
        return pairs.select(
            F.lit(signal).alias("signal"), F.col("p.section").alias("section"), F.col("p.kind").alias("kind"), F.col("p.text").alias("before"), F.col("n.text").alias("after")
        )

    explicit, others = prior.filter("reviewable AND id_explicit"), new.filter("id_explicit")
    by_id = met(explicit, others, ["entry_id"], "id")
    # An entry differs from one of its id at least if it differs from the least or the greatest text, so no pairs are needed to know the slots.
    ends = others.groupBy("entry_id").agg(F.min("said").alias("low"), F.max("said").alias("high"))
    by_id_slots = written(explicit.join(ends, "entry_id").filter("said <> low OR said <> high").select("section", "kind").distinct(), "slots")

    def only_one(side: DataFrame, on: list[str]) -> DataFrame:
        """The row of each slot or section that holds one."""
        row = F.struct("section", "kind", "text", "said", "reviewable")
        return side.groupBy(*on).agg(F.count(F.lit(1)).alias("n"), F.any_value(row).alias("row")).filter("n = 1").select("row.*")

    slots = [only_one(side.filter("reviewable"), ["section", "kind"]) for side in (prior, new)]
    by_slot = met(*slots, ["section", "kind"], "slot").join(by_id_slots, ["section", "kind"], "left_anti")
    told = by_id_slots.select("section").union(by_slot.select("section")).distinct()
    by_section = met(only_one(prior, ["section"]).filter("reviewable"), only_one(new, ["section"]), ["section"], "section").join(told, "section", "left_anti")
    return by_id.unionByName(by_slot.select(by_id.columns)).unionByName(by_section.select(by_id.columns))


def dropped_keys(prior: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return prior.select(key).distinct().join(new.select(key).distinct(), key, "left_anti")


def shared_keys(prior: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return prior.select(key).intersect(new.select(key))


def reconciled(stored: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """What a store does to hold just ``new`` (key, hash): upsert what is new or differs, delete what is absent; nothing for the rest."""
    met = stored.select(key, F.col("hash").alias("_old")).join(new.select(key, F.col("hash").alias("_new")), key, "full_outer")
    step = F.when(F.col("_new").isNull(), "delete").when(F.col("_old").isNull() | (F.col("_old") != F.col("_new")), "upsert")
    return met.select(key, step.alias("step")).filter("step IS NOT NULL")

"""Start-up context: priorities, freshness, deduplication, packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.text import bullet_key, route_text

#: Priority by a word in a chunk's lower-cased heading; the last that holds counts.
PRIORITIES = (
    (("preference", "relationship", "communication"), 10),
    (("core identity",), 8),
    (("current session",), 9),
    (("active projects",), 8),
    (("life & operations",), 6),
    (("creative & professional",), 3),
)
#: Kinds of entries that do not age.
DURABLE = ("preference", "identity", "policy", "mode", "evergreen")
MATCH_BOOST = 6
#: What marks a statement that ages.
VERSION = r"\bv?\d+\.\d+(?:\.\d+)?\b"
STATUS = r"(?i)\b(installed|install status|version|upgraded|downgraded|running|available|enabled|disabled|up to date)\b"


def priority(source: Column, heading: Column, body: Column, terms: list[str]) -> Column:
    """Priority of a chunk; one that a routing term occurs in (separators alike) gets the boost."""
    low = F.lower(heading)
    base = F.when(low == "working profile", 14).when(source == "profile", 7).otherwise(4)
    for words, level in PRIORITIES:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        base = F.when(hit, level).otherwise(base)
    hay, boost = route_text(F.concat_ws(" ", heading, body)), F.lit(False)
    for t in terms:
        boost = boost | F.contains(hay, route_text(F.lit(t)))
    return base + F.when(boost, MATCH_BOOST).otherwise(0)


def operational(line: Column) -> Column:
    """Whether the visible part of a line names a version or a status."""
    shown = F.regexp_replace(line, "(?s)<!--om.*$", "")
    return shown.rlike(VERSION) | shown.rlike(STATUS)


def freshness(bullets: DataFrame) -> DataFrame:
    """(key, last_seen): the latest sighting of each bullet of a kind that ages."""
    ages = F.coalesce(~F.lower("kind").isin(*DURABLE), F.lit(True)) & operational(F.col("line"))
    rows = bullets.filter(ages & F.col("last_seen").isNotNull()).withColumn("key", bullet_key(F.col("line")))
    return rows.filter("key <> ''").groupBy("key").agg(F.max("last_seen").alias("last_seen"))


def first_sightings(bullets: DataFrame) -> DataFrame:
    """Lines (chunk_rank, line_no, line, exempt) without top-level leaf bullets that an earlier chunk or line shows.

    Bullets with something indented below them, and lines of exempt chunks, all stay.
    """
    indent = F.length("line") - F.length(F.ltrim("line"))
    shown = F.trim(F.col("line")) != ""
    after = Window.partitionBy("chunk_rank").orderBy("line_no").rowsBetween(1, Window.unboundedFollowing)
    below = F.coalesce(F.first(F.when(shown, indent), ignorenulls=True).over(after), F.lit(0))
    rows = bullets.withColumn("_leaf", F.col("line").rlike("^[-*] ") & (below == 0) & ~F.col("exempt"))
    rows = rows.withColumn("_key", F.when(F.col("_leaf"), F.nullif(bullet_key(F.col("line")), F.lit(""))))
    # The first place of each key by an aggregate, which merges a common bullet's rows before the shuffle.
    keyed = rows.filter("_key IS NOT NULL")
    first = keyed.groupBy("_key").agg(F.min(F.struct("chunk_rank", "line_no")).alias("_at")).select("_at.chunk_rank", "_at.line_no")
    kept = keyed.join(first, ["chunk_rank", "line_no"], "left_semi")
    return rows.filter("_key IS NULL").unionByName(kept).drop("_leaf", "_key")


def packed(chunks: DataFrame, budget: int, by: list[str] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(payload, source, heading, handle, size, kept columns, taken): the chunks, each once and with whether it is taken.

    In order (-priority, source, heading, handle), each chunk that still fits the budget of its payload is taken. A chunk that does not fit uses
    nothing, so this is a fold over each payload's chunks. A payload is one text for one reader, so its list of chunks is short.
    """
    by = by or []
    item = F.struct((-F.col("priority")).alias("p"), "source", "heading", "handle", "size", *keep)
    listed = chunks.groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("items"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<boolean>").alias("out"))

    def step(state: Column, x: Column) -> Column:
        fits = state["used"] + x["size"] <= budget
        used = state["used"] + F.when(fits, x["size"].cast("long")).otherwise(F.lit(0).cast("long"))
        return F.struct(used.alias("used"), F.concat(state["out"], F.array(fits)).alias("out"))

    flags = listed.select(*by, "items", F.aggregate("items", start, step, lambda s: s["out"]).alias("fits"))
    each = flags.select(*by, F.explode(F.arrays_zip("items", "fits")).alias("r"))
    columns = [F.col(f"r.items.{c}").alias(c) for c in ("source", "heading", "handle", "size", *keep)]
    return each.select(*by, *columns, F.col("r.fits").alias("taken"))


def pack(chunks: DataFrame, budget: int, by: list[str] | None = None) -> DataFrame:
    """(payload, handle, taken) of ``packed``."""
    return packed(chunks, budget, by).select(*(by or []), "handle", "taken")


def display_order(source: Column, heading: Column, handle: Column) -> Column:
    """Where a taken chunk stands in the payload, as a struct to sort by: profile before active, then by section, heading and handle."""
    low = F.lower(heading)
    profile = F.when(low == "working profile", 0)
    for at, words in enumerate((("core identity",), ("preference",), ("relationship", "communication")), 1):
        for w in words:
            profile = profile.when(F.contains(low, F.lit(w)), at)
    active = F.when(F.startswith(low, F.lit("current session")), 0)
    for at, head in enumerate(("active projects", "life & operations", "creative & professional"), 1):
        active = active.when(F.startswith(low, F.lit(head)), at)
    is_profile = source == "profile"
    return F.struct(
        F.when(is_profile, 0).otherwise(1).alias("source"),
        F.when(is_profile, profile.otherwise(4)).otherwise(active.otherwise(4)).alias("section"),
        heading.alias("heading"),
        handle.alias("handle"),
    )


def payload_text(packed: DataFrame, by: list[str]) -> DataFrame:
    """Per payload of packed chunks with bodies: the text of the taken ones in display order, and the handles that did not fit, sorted."""
    shown = F.struct(display_order(F.col("source"), F.col("heading"), F.col("handle")).alias("at"), F.col("body").alias("body"))
    parts = F.transform(F.array_sort(F.collect_list(F.when(F.col("taken"), shown))), lambda x: x["body"])
    left = F.array_sort(F.collect_list(F.when(~F.col("taken"), F.col("handle"))))
    return packed.groupBy(*by).agg(F.array_join(parts, "\n\n").alias("text"), F.array_join(left, ",").alias("overflow"))


def keyed_bullets(bullets: DataFrame) -> DataFrame:
    """Adds ``key`` to bullets and drops those with an empty one; a generator works each key out once, where a filter pushed below it would again."""
    return bullets.select("*", F.explode(F.filter(F.array(bullet_key(F.col("line"))), lambda k: k != "")).alias("key"))


def repeated_bullets(bullets: DataFrame) -> DataFrame:
    """(key, n): bullets shown more than once, and how often they would be dropped."""
    return keyed_bullets(bullets).groupBy("key").agg((F.count(F.lit(1)) - 1).alias("n")).filter("n > 0")


def route_terms(text: Column) -> Column:
    """Distinct words of three letters or more of a place or task, in order."""
    return F.array_distinct(F.filter(F.regexp_extract_all(route_text(text), F.lit("[a-z0-9]+"), 0), lambda w: F.length(w) >= 3))


def profile_lines(lines: DataFrame, terms: list[str], limit: int = 16) -> DataFrame:
    """The best distinct lines: 4 for each routing term in it, 1 for a red dot; earlier ones on ties."""
    once = lines.groupBy("line").agg(F.min("line_no").alias("line_no"))
    score = F.when(F.contains("line", F.lit("\U0001f534")), 1).otherwise(0)
    for t in terms:
        score = score + F.when(F.contains(F.lower("line"), F.lit(t)), 4).otherwise(0)
    return once.withColumn("score", score).orderBy(F.desc("score"), "line_no").limit(limit)


def priority_bullets(lines: DataFrame, marks: tuple[str, ...]) -> DataFrame:
    """Lines (doc, line_no, line) that start with a mark, and those indented right below a kept one."""
    core = F.ltrim("line")
    hit = F.lit(False)
    for m in marks:
        hit = hit | F.startswith(core, F.lit(m))
    inner = F.col("line").rlike("^(  |\t)") & ~hit
    so_far = Window.partitionBy("doc").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    keep = hit | (inner & F.coalesce(F.last(F.when(~inner, hit), ignorenulls=True).over(so_far), F.lit(False)))
    return lines.withColumn("_keep", keep).filter("_keep").drop("_keep")

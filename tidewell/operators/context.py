"""Derived notes and start-up context: profile and active text, chunks, handles, quality, budgets, provenance stamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.text import BLANKS, head_within, is_stale, last_reflected, last_updated, slug, strip, without_metadata
from tidewell.operators import pruning
from tidewell.operators.sections import sections

#: The sections of a profile, and of the active context, in their order.
PROFILE_HEADINGS = ("Core Identity", "Preferences & Opinions", "Relationship & Communication")
ACTIVE_HEADINGS = ("Active Projects", "Life & Operations", "Creative & Professional", "Recent Themes")
#: The lines of an identity that a profile shows.
BASICS = ("- **Name:**", "- **Role/occupation:**", "- **Communication style:**", "- **Working hours:**")
#: Words of text about current work.
CURRENT_WORK = ("today", "working", "wip", "in progress", "current", "now", "pr ", "release", "commit", "deploy", "branch")
PROFILE_HEAD = "# Startup Profile\n\n<!-- Auto-maintained from reflections.md. -->"
ACTIVE_HEAD = "# Active Context\n\n<!-- Auto-maintained from reflections.md and observations.md. -->"


def _whole() -> Column:
    return strip(F.concat(F.lit("## "), F.col("heading"), F.lit("\n"), F.col("body")))


def _first(value: str, heading: str) -> Column:
    """Aggregate: the value in the first section of a heading."""
    hit = F.col("heading") == heading
    return F.min_by(F.when(hit, F.col(value)), F.when(hit, F.col("ord")))


def _bodies(found: DataFrame, headings: tuple[str, ...]) -> DataFrame:
    """(doc, b0, b1, ...): per document the body of the first section of each heading, by one aggregation; other bodies stay where they are."""
    rows = found.select("doc", "ord", "heading", F.when(F.col("heading").isin(*headings), F.col("body")).alias("body"))
    return rows.groupBy("doc").agg(*[_first("body", h).alias(f"b{i}") for i, h in enumerate(headings)])


def _wholes(headings: tuple[str, ...]) -> list[Column]:
    return [strip(F.concat(F.lit(f"## {h}\n"), F.col(f"b{i}"))) for i, h in enumerate(headings)]


def _marked_bullets(body: Column, heading: str, mark: str) -> Column:
    """The marked bullets of a body with what is indented below them, under their heading; null without any."""
    # A fold over the section's lines: whether the last bullet at the margin is a marked one.
    inner = lambda x: x.rlike("^(  |\t)")
    start = F.struct(F.lit(False).alias("on"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        hit = F.startswith(F.ltrim(x), F.lit(mark))
        on = F.when(inner(x), s["on"]).otherwise(hit)
        return F.struct(on.alias("on"), F.when(hit | (inner(x) & s["on"]), F.concat(s["out"], F.array(x))).otherwise(s["out"]).alias("out"))

    shown = F.aggregate(F.split(body, "\n"), start, step, lambda s: F.when(F.size(s["out"]) > 0, F.array_join(s["out"], "\n")))
    return F.concat(F.lit(f"## {heading}\n"), shown)


def profiles(found: DataFrame) -> DataFrame:
    """(doc, text): the start-up profile of each note from its second-level sections."""
    facts = "Key Facts & Context"
    bodies = _bodies(found, (*PROFILE_HEADINGS, facts))
    shown = _marked_bullets(F.col(f"b{len(PROFILE_HEADINGS)}"), facts, "- \U0001f534")
    return bodies.select("doc", F.concat_ws("\n\n", F.lit(PROFILE_HEAD), *_wholes(PROFILE_HEADINGS), shown).alias("text"))


def current_context(found: DataFrame) -> DataFrame:
    """(doc, snapshot): the current-context part of the latest dated section, under a heading of its own; the first of equal dates, null without any."""
    dated = F.col("date").isNotNull()
    rows = found.select("doc", "ord", "date", F.when(dated, F.struct("heading", "body")).alias("_row"))
    last = rows.groupBy("doc").agg(F.max_by("_row", F.when(dated, F.struct("date", -F.col("ord")))).alias("x"))
    part = F.regexp_extract("x.body", r"(?s)(?:^|\n)### Current Context[ \t]*\n(.*?)(?=\n### |\z)", 1)
    text = F.nullif(strip(part), F.lit(""))
    return last.select("doc", F.concat(F.lit("## Current Session Snapshot\n\n### "), "x.heading", F.lit("\n\n"), text).alias("snapshot"))


def actives(reflections: DataFrame, observations: DataFrame) -> DataFrame:
    """(doc, text): the active context of each note from its sections and those of its observations."""
    met = _bodies(reflections, ACTIVE_HEADINGS).join(current_context(observations), "doc", "full_outer")
    return met.select("doc", F.concat_ws("\n\n", F.lit(ACTIVE_HEAD), *_wholes(ACTIVE_HEADINGS), "snapshot").alias("text"))


def _third_level() -> Column:
    return F.filter(F.split("body", r"(?m)(?=^### )"), lambda x: F.startswith(x, F.lit("### ")))


def startup_chunks(profile: DataFrame, active: DataFrame) -> DataFrame:
    """(doc, source, heading, body, handle): sections of the profile; of the active context, third-level parts where there are any.

    Metadata comments are left out, and so are chunks with nothing below their heading.
    """
    sides = []
    for source, docs in (("profile", profile), ("active", active)):
        found = sections(docs).filter("heading IS NOT NULL")
        items = F.array(_whole())
        if source == "active":
            parts = _third_level()
            items = F.when(F.size(parts) > 0, parts).otherwise(items)
        # A third-level part starts with ``###``, a whole section with ``##``; the section's text goes no further than its own row.
        each = found.select("doc", "heading", "slug", F.explode(items).alias("text"))
        part = F.startswith(F.col("text"), F.lit("### "))
        name = strip(F.regexp_extract("text", r"\A### ([^\n]*)", 1))
        title = F.when(part, F.concat_ws(" / ", "heading", name)).otherwise(F.col("heading"))
        body = F.when(part, F.concat(F.lit("## "), title, F.regexp_replace("text", r"\A### [^\n]*", ""))).otherwise(F.col("text"))
        handle = F.when(part, F.concat_ws(":", F.lit("startup:active"), "slug", slug(name))).otherwise(F.concat(F.lit(f"startup:{source}:"), "slug"))
        # Kept by a generator of none or one: the body is worked out once, not once more by a filter pushed below it.
        kept = F.explode(F.filter(F.array(strip(without_metadata(strip(body)))), _shows_below))
        sides.append(each.select("doc", F.lit(source).alias("source"), title.alias("heading"), kept.alias("body"), handle.alias("handle")))
    return sides[0].unionByName(sides[1])


def _shows_below(body: Column) -> Column:
    """Whether a line below the first is neither blank, nor a lone dash, nor a comment."""
    return F.size(F.filter(F.split(body, "\n"), lambda x, i: (i > 0) & x.rlike(f"(?U)\\A{BLANKS}*+(?!<!--|-?{BLANKS}*\\z)"))) > 0


def expanded(chunks: DataFrame, asked: DataFrame) -> DataFrame:
    """Asked handles (doc, handle) with the body of the first such chunk; ``known`` tells handles that none has."""
    first = chunks.groupBy("doc", "handle").agg(F.min_by("body", F.struct("source", "heading")).alias("body"))
    return asked.join(first, ["doc", "handle"], "left").withColumn("known", F.col("body").isNotNull())


def quality_report(packed: DataFrame, repeats: DataFrame, budget: int) -> DataFrame:
    """Per doc of packed chunks: characters used, share of the budget, chunks that fit or not, and repeated bullets (doc, n)."""
    sums = packed.groupBy("doc").agg(
        F.coalesce(F.sum(F.when(F.col("taken"), F.col("size"))), F.lit(0)).cast("long").alias("used"), F.count_if("taken").alias("included"), F.count_if(~F.col("taken")).alias("overflow")
    )
    again = repeats.groupBy("doc").agg(F.sum("n").cast("long").alias("duplicates"))
    return sums.join(again, "doc", "left").na.fill({"duplicates": 0}).withColumn("share", F.round(F.col("used") / budget, 4))


def identity_basics(found: DataFrame, heading: str = "Core Identity") -> DataFrame:
    """(doc, basics): the lines of the identity that a profile shows."""
    hit = lambda x: F.coalesce(F.array_contains(F.transform(F.array(*[F.lit(b) for b in BASICS]), lambda b: F.startswith(x, b)), True), F.lit(False))
    kept = F.filter(F.transform(F.split("body", "\n"), strip), hit)
    return found.filter(F.col("heading") == heading).select("doc", F.array_join(kept, "\n").alias("basics")).filter("basics <> ''")


def nested_bullets(found: DataFrame, heading: str, label: str) -> DataFrame:
    """(doc, at, line): bullets below ``- **label:**`` up to the next bold bullet."""
    start = F.struct(F.lit(False).alias("on"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, raw: Column) -> Column:
        x = strip(raw)
        mark, bold = F.startswith(x, F.lit(f"- **{label}:**")), F.startswith(x, F.lit("- **"))
        on = mark | (s["on"] & ~bold)
        keep = on & ~mark & F.startswith(x, F.lit("- "))
        return F.struct(on.alias("on"), F.when(keep, F.concat(s["out"], F.array(x))).otherwise(s["out"]).alias("out"))

    kept = F.aggregate(F.split("body", "\n"), start, step, lambda s: s["out"])
    return found.filter(F.col("heading") == heading).select("doc", F.posexplode(kept).alias("at", "line"))


def catch_up_needed(notes: DataFrame, latest: DataFrame, now: Column) -> DataFrame:
    """(doc, needed): whether the observations (doc, latest date) are ahead of a note (doc, text) that was last updated over a day before."""
    met = latest.join(notes, "doc", "left")
    seen, updated = last_reflected(F.coalesce("text", F.lit(""))), last_updated(F.coalesce("text", F.lit("")))
    overdue = updated.isNull() | (now.cast("double") - updated.cast("double") > 86400)
    return met.select("doc", F.coalesce(F.col("latest").isNotNull() & (seen.isNull() | ((F.col("latest") > seen) & overdue)), F.lit(False)).alias("needed"))


def memory_changed(notes: DataFrame, scans: DataFrame) -> DataFrame:
    """(doc, changed): whether the last scan (doc, last_scan as text) is later than the note's update; times that do not parse count as changed."""
    met = scans.join(notes, "doc", "left")
    same = F.try_to_timestamp("last_scan") <= last_updated(F.coalesce("text", F.lit("")))
    scanned = F.coalesce("last_scan", F.lit("")) != ""
    return met.select("doc", (scanned & ~F.coalesce(same, F.lit(False))).alias("changed"))


def date_span(observations: DataFrame, after: str | None = None) -> DataFrame:
    """(doc, first, last): the dates of the sections later than ``after``."""
    rows = observations.filter("date IS NOT NULL")
    rows = rows if after is None else rows.filter(F.col("date") > F.lit(after).cast("date"))
    return rows.groupBy("doc").agg(F.min("date").alias("first"), F.max("date").alias("last"))


def latest_stamp(docs: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """(doc, seen): the latest time that a text's metadata, provenance stamps or date headings name; null without any."""
    stamps = F.regexp_extract_all(text, F.lit(r"(?:last_seen|last_verified|last_reflected)=([0-9T:.+Z-]+[0-9Z])"), 1)
    ends = F.regexp_extract_all(text, F.lit(r"derived_from_obs_window=[0-9-]+\.\.([0-9-]+)"), 1)
    heads = F.regexp_extract_all(text, F.lit(r"(?m)^#{2,3}\s+(\d{4}-\d{2}-\d{2})"), 1)
    times = F.transform(F.concat(stamps, ends, heads), lambda x: F.try_to_timestamp(x))
    return docs.select(F.col(doc).alias("doc"), F.array_max(times).alias("seen"))


def restamped(new: DataFrame, prior: DataFrame, today: str, first: str, last: str) -> DataFrame:
    """Sections (doc, ord, heading, body) with a provenance line below the heading where the body changed.

    A section counts as unchanged if the last section of that heading in ``prior`` has the same body but for stamps; it keeps the prior stamp.
    """
    bare = lambda c: strip(F.regexp_replace(c, r"(?m)^<!--om-section:[^\n]*-->\n?", ""))
    stamp = F.nullif(F.regexp_extract("body", r"(?m)^(<!--om-section:[^\n]*-->)", 1), F.lit(""))
    before = prior.groupBy("doc", "heading").agg(F.max_by(F.struct(bare(F.col("body")).alias("bare"), stamp.alias("stamp")), "ord").alias("was"))
    met = new.join(before, ["doc", "heading"], "left").withColumn("bare", bare(F.col("body")))
    same = F.coalesce(F.col("was.bare") == F.col("bare"), F.lit(False))
    fresh = F.lit(f"<!--om-section: last_reflected={today} derived_from_obs_window={first}..{last}-->")
    mark = F.when(same, F.col("was.stamp")).otherwise(fresh)
    return met.select("doc", "ord", "heading", F.concat_ws("\n", mark, "bare").alias("body"), (~same).alias("changed"))


def fold_budgets(system: Column, memory: Column, tokens: int = 45_000, ratio: float = 0.6, cap: int = 48_000, wrapper: int = 2_000, least: int = 4_000) -> Column:
    """struct<context, chunk>: characters for the note and for the observations of one fold, at 3.5 characters a token."""
    whole = int(tokens * 3.5)
    chunk = max(int(whole * ratio), least)
    left = F.greatest(F.lit(whole - chunk - wrapper) - F.length(system) - F.length(memory), F.lit(0))
    return F.struct((F.least(F.lit(cap), left) if cap > 0 else left).cast("long").alias("context"), F.lit(chunk).cast("long").alias("chunk"))


def memory_context(files: DataFrame, most: int = 500) -> DataFrame:
    """(project, text): the start of each memory file (project, path, content) under its name, in path order."""
    row = F.struct("path", F.concat(F.lit("### "), "path", F.lit("\n"), head_within(strip(F.col("content")), most, " …")).alias("text"))
    texts = F.transform(F.array_sort(F.collect_list(row)), lambda x: x["text"])
    kept = files.filter(strip(F.coalesce("content", F.lit(""))) != "")
    return kept.groupBy("project").agg(F.concat(F.lit("## "), F.first("project"), F.lit("\n\n"), F.array_join(texts, "\n\n")).alias("text"))


def file_status(files: DataFrame) -> DataFrame:
    """(path, lines, chars): a final line end starts no line."""
    text = F.regexp_replace("content", "\n\\z", "")
    return files.select("path", F.when(F.col("content") == "", 0).otherwise(F.size(F.split(text, "\n"))).cast("long").alias("lines"), F.length("content").cast("long").alias("chars"))


def growth_lines(report: DataFrame, shown: Column) -> DataFrame:
    """Adds ``line``: a row of a growth report (bytes, n_lines, bullets, share) as text, ``shown`` its size."""
    percent = F.format_string("%.1f%%", F.floor(F.col("share") * 1000 + 0.5) / 10)
    return report.withColumn("line", F.concat_ws("  ", "doc", shown, percent, F.concat(F.col("bullets").cast("string"), F.lit(" bullets"))))


def growth_checks(report: DataFrame, most_bytes: int, most_days: int) -> DataFrame:
    """(doc, level, reason): WARN for what is too large or too old, else OK."""
    large, old = F.col("bytes") > most_bytes, F.coalesce(F.col("age_days") > most_days, F.lit(False))
    return report.select("doc", F.when(large | old, "WARN").otherwise("OK").alias("level"), F.concat_ws(",", F.when(large, "size"), F.when(old, "age")).alias("reason"))


def stale_moved(rows: DataFrame, now: Column, ttl_days: int, action: str = "stale-section") -> DataFrame:
    """Entries (doc, line_no, kind, last_seen, line) after pruning, with their new ``position``: stale snapshots go, are noted, or move to the end."""
    stale = F.coalesce((F.col("kind") == "snapshot") & is_stale(F.col("last_seen"), now, ttl_days), F.lit(False))
    marked = rows.withColumn("stale", stale)
    if action == "drop":
        marked = marked.filter(~F.col("stale")).withColumn("stale", F.lit(False))
    if action == "annotate":
        marked = marked.withColumn("line", F.when(F.col("stale"), pruning.marked(F.col("line"))).otherwise(F.col("line"))).withColumn("stale", F.lit(False))
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("doc").orderBy("stale", "line_no"))  # a note's own entries
    return marked.withColumn("position", place)

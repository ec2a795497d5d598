"""Section patches: replies in an envelope of lines, and notes that take them whole or not at all.

A reply is one or more blocks of a ``SECTION_HANDLE:`` line, perhaps a ``NEW_AFTER:`` line, and an ``UPDATED_MARKDOWN:`` line with a section
below it. A note is cut at its second and third level headings into parts that hold every byte of it, so what no patch names comes out
as it went in. Parsing and applying are joins and aggregates on (doc, handle); a note and its reply are one value each, as long as they are.

Everything fails closed: a reply with any fault, or one that does not fit its note, changes nothing of the note and gives the first fault's name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.text import slug

#: Fixed values of the envelope.
HANDLE_LINE = r"(?md)^SECTION_HANDLE:[ \t]*([^\n]*?)[ \t]*$"
AFTER_LINE = r"(?md)^NEW_AFTER:[ \t]*([^\n]*?)[ \t]*$"
BODY_LINE = r"(?md)^UPDATED_MARKDOWN:\s*$"
SECOND, THIRD = r"(?md)^## [^#\n].*$", r"(?md)^### [^#\n].*$"


def _heading(raw: Column, level: int) -> Column:
    return F.btrim(F.regexp_extract(raw, rf"\A#{{{level}}} ([^\n]*)", 1), F.lit(" \t\r\x0b\x0c"))


def _numbered(base: Column, nth: Column) -> Column:
    """``base``, with -2, -3, ... from its second one on."""
    return F.when(nth == 1, base).otherwise(F.concat_ws("-", base, nth.cast("string")))


def note_parts(docs: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """(doc, ord, sub, raw, slug, section, handle, last): every byte of each note, in parts.

    Ord 0 is what stands before the first section; sub 0 is a section up to its first subsection. ``section`` is the section's handle
    (null for ord 0), ``handle`` the part's own, ``last`` whether the part ends its section. A null text is an empty one.
    """
    note, opening = F.coalesce(F.col(text), F.lit("")), r"\A## [^#\n]"
    # A null in front of the pieces of a note that starts with a section: they then number themselves, and no row repeats the note.
    none = F.array().cast("array<string>")
    front = F.when(note.rlike(opening), F.array(F.lit(None).cast("string"))).otherwise(none)
    each = docs.select(F.col(doc).alias("doc"), F.posexplode(F.concat(front, F.split(note, r"(?md)(?=^## [^#\n])"))).alias("ord", "_raw")).filter("_raw IS NOT NULL")
    inner = F.when(F.col("ord") > 0, F.split("_raw", r"(?md)(?=^### [^#\n])")).otherwise(F.array("_raw"))
    base = F.when(F.col("ord") > 0, slug(_heading(F.col("_raw"), 2)))
    cut = each.select("doc", "ord", base.alias("_base"), inner.alias("_inner"))
    cut = cut.select("doc", "ord", "_base", F.size("_inner").alias("_n"), F.posexplode("_inner").alias("sub", "raw"))
    cut = cut.withColumn("_sub_base", F.when(F.col("sub") > 0, slug(_heading(F.col("raw"), 3))))
    # One shuffle of the parts: by note, which serves every window here and whatever goes on by note.
    parts = cut.repartition("doc")
    nth = F.dense_rank().over(Window.partitionBy("doc", "_base").orderBy("ord"))
    parts = parts.withColumn("slug", F.when(F.col("ord") > 0, _numbered(F.col("_base"), nth)))
    nth_sub = F.row_number().over(Window.partitionBy("doc", "ord", "_sub_base").orderBy("sub"))
    section = F.concat(F.lit("ref:"), "slug")
    parts = parts.withColumn("_sub_slug", F.when(F.col("sub") > 0, _numbered(F.col("_sub_base"), nth_sub)))
    return parts.select(
        "doc", "ord", "sub", "raw", "slug", section.alias("section"), F.when(F.col("sub") == 0, section).otherwise(F.concat(section, F.lit(":"), "_sub_slug")).alias("handle"),
        (F.col("sub") == F.col("_n") - 1).alias("last"),
    )


def parsed(replies: DataFrame, doc: str = "doc", reply: str = "reply") -> DataFrame:
    """(doc, at, handle, new_after, markdown, error): the patches of each reply, in order.

    ``error`` is the reply's first fault, the same in all its rows; a reply without blocks has one row. A block without a body line of its own belongs to
    the body above it. ``new_after`` is null for changes, and names a handle, or is empty for the end, for additions.
    """
    blank = r"\A\s*\z"
    text = F.regexp_replace(F.coalesce(F.col(reply), F.lit("")), r"\A\s+|\s+\z", "")
    pieces = F.split(text, r"(?md)(?=^SECTION_HANDLE:)")
    # A piece without its own body line goes on with the block before it; the first piece is a block anyway.
    joined = F.aggregate(
        pieces,
        F.array().cast("array<string>"),
        lambda out, p: F.when(
            (F.size(out) > 0) & ~p.rlike(BODY_LINE),
            F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(F.concat(F.element_at(out, -1), p))),
        ).otherwise(F.concat(out, F.array(p))),
    )
    rows = replies.select(F.col(doc).alias("doc"), text.alias("_text"), F.posexplode(joined).alias("at", "_block"))
    marked = F.col("_block").rlike(BODY_LINE)
    head = F.when(marked, F.get(F.split("_block", BODY_LINE, 2), F.lit(0)))
    body = F.when(marked, F.btrim(F.get(F.split("_block", BODY_LINE, 2), F.lit(1)), F.lit("\n")))
    rows = rows.select("doc", "at", "_text", "_block", head.alias("_head"), body.alias("markdown"))
    rows = rows.withColumns(
        {
            "handle": F.btrim(F.regexp_extract("_block", HANDLE_LINE, 1)),
            "new_after": F.when(F.col("_head").rlike(AFTER_LINE), F.btrim(F.regexp_extract("_head", AFTER_LINE, 1))),
        }
    )
    third = F.col("new_after").isNull() & (F.length("handle") - F.length(F.translate("handle", ":", "")) >= 2)
    heads = F.when(third, F.regexp_count("markdown", F.lit(THIRD))).otherwise(F.regexp_count("markdown", F.lit(SECOND)))
    level = F.when(third, F.col("markdown").rlike(r"\A\s*### ")).otherwise(F.col("markdown").rlike(r"\A\s*## "))
    own = (
        F.when(F.col("_text").rlike(blank), "empty reply")
        .when(~F.contains("_text", F.lit("SECTION_HANDLE:")), "no section handle")
        .when(~F.startswith("_text", F.lit("SECTION_HANDLE:")), "text before the first block")
        .when(F.col("handle") == "", "empty handle")
        .when(F.col("markdown").isNull(), "no markdown line")
        .when(F.col("markdown").rlike(blank), "empty markdown")
        .when(heads != 1, "not one heading")
        .when(~level, "text before the heading")
        .when(third & F.col("markdown").rlike(SECOND), "section inside a subsection")
    )
    nth = F.row_number().over(Window.partitionBy("doc", F.col("new_after").isNotNull(), "handle").orderBy("at"))
    rows = rows.withColumn("_own", own).withColumn("_again", F.when(nth > 1, "repeated handle"))
    whole = Window.partitionBy("doc")
    # Faults of single blocks come before those between blocks.
    fault = F.coalesce(F.min_by("_own", F.when(F.col("_own").isNotNull(), F.col("at"))).over(whole), F.max("_again").over(whole))
    return rows.select("doc", "at", "handle", "new_after", "markdown", fault.alias("error"))


def _faults(parts: DataFrame, patches: DataFrame, offered: DataFrame | None) -> DataFrame:
    """(doc, error): the first fault of each reply, its own or in how it fits the note."""
    third_slugs = F.collect_set(F.when(F.col("sub") > 0, F.element_at(F.split("handle", ":"), -1)))
    notes = parts.groupBy("doc", "section").agg(F.max("slug").alias("slug"), third_slugs.alias("thirds"))
    known = parts.filter("handle IS NOT NULL").select("doc", "handle", "section", (F.col("sub") == 0).alias("whole"))
    met = patches.join(known, ["doc", "handle"], "left")
    if offered is not None:
        met = met.join(offered.select("doc", "handle").distinct().withColumn("_offered", F.lit(True)), ["doc", "handle"], "left")
    else:
        met = met.withColumn("_offered", F.lit(True))
    thirds = notes.filter("section IS NOT NULL").select("doc", F.col("section").alias("handle"), "thirds")
    met = met.join(thirds, ["doc", "handle"], "left")
    anchors = notes.filter("section IS NOT NULL").select("doc", F.col("section").alias("new_after"), F.lit(True).alias("_anchor"))
    met = met.join(anchors, ["doc", "new_after"], "left")
    met = met.withColumn("_slug", slug(_heading(F.ltrim("markdown"), 2)))
    taken = notes.filter("slug IS NOT NULL").select("doc", F.col("slug").alias("_slug"), F.lit(True).alias("_taken"))
    met = met.join(taken, ["doc", "_slug"], "left")
    adds = F.col("new_after").isNotNull()
    same = F.row_number().over(Window.partitionBy("doc", "_slug", adds).orderBy("at"))
    parent = F.max(F.col("whole") & ~adds).over(Window.partitionBy("doc", "section"))
    new_thirds = F.transform(F.regexp_extract_all("markdown", F.lit(r"(?md)^### ([^\n]*)"), 1), lambda x: slug(F.btrim(x)))
    lost = F.size(F.array_except(F.coalesce("thirds", F.array().cast("array<string>")), new_thirds)) > 0
    fault = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(adds & F.col("whole").isNotNull(), "new handle exists")
        .when(adds & (F.col("new_after") != "") & F.col("_anchor").isNull(), "unknown place")
        .when(adds & (F.col("_taken").isNotNull() | (same > 1)), "heading exists")
        .when(~adds & F.col("whole").isNull(), "unknown handle")
        .when(~adds & F.col("_offered").isNull(), "handle not offered")
        .when(~adds & F.col("whole") & lost, "lost subsections")
        .when(~adds & ~F.col("whole") & parent, "section and subsection")
    )
    return met.withColumn("_fault", fault).groupBy("doc").agg(F.min_by("_fault", F.when(F.col("_fault").isNotNull(), F.col("at"))).alias("error"))


def applied(docs: DataFrame, replies: DataFrame, offered: DataFrame | None = None) -> DataFrame:
    """(doc, text, error): notes (doc, text) with the patches of their replies (doc, reply), or as they were where ``error`` says why.

    Patches may change what ``offered`` (doc, handle) lists, or anything where it is None. A changed section ends in one blank line, a changed last
    subsection in one line end; what stands before an added section gets a blank line. A note without a reply, or with several, stays as it is.
    """
    docs = docs.select("doc", "text")
    parts = note_parts(docs)
    counted = replies.groupBy("doc").agg(F.count(F.lit(1)).alias("_n"), F.max("reply").alias("reply"))
    patches = parsed(counted.filter("_n = 1"))
    faults = _faults(parts, patches, offered).unionByName(counted.filter("_n > 1").select("doc", F.lit("several replies").alias("error")))
    good = patches.join(faults.filter("error IS NULL"), "doc", "left_semi").withColumn("_body", F.rtrim(F.col("markdown"), F.lit("\n")))
    adds = good.filter("new_after IS NOT NULL")
    changes = good.filter("new_after IS NULL").select("doc", "handle", F.col("_body").alias("_new"))
    # A reply's changes as one map by handle, each once in a good reply: parts meet them by note, where they are.
    by_handle = changes.groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("handle", "_new"))).alias("_changes"))
    change = lambda c: F.try_element_at("_changes", F.col(c))
    now = parts.join(by_handle, "doc", "left").withColumns({"_new": change("handle"), "_whole": change("section")})
    text = (
        F.when(F.col("_whole").isNotNull(), F.when(F.col("sub") == 0, F.concat("_whole", F.lit("\n\n"))))
        .when(F.col("_new").isNotNull(), F.concat("_new", F.when(F.col("last"), "\n").otherwise("\n\n")))
        .otherwise(F.col("raw"))
    )
    now = now.select("doc", "ord", F.lit(0).alias("kind"), F.col("sub").alias("at"), "section", "last", text.alias("text")).filter("text IS NOT NULL")
    place = parts.filter("sub = 0 AND ord > 0").select("doc", F.col("section").alias("new_after"), "ord")
    added = adds.select("doc", "at", "new_after", F.concat("_body", F.lit("\n\n")).alias("text")).join(place, ["doc", "new_after"], "left")
    added = added.select("doc", F.coalesce("ord", F.lit((1 << 31) - 1)).alias("ord"), F.lit(1).alias("kind"), "at", "text")
    every = now.select("doc", "ord", "kind", "at", "text").unionByName(added.repartition("doc"))
    # An added section wants a blank line before it: the part that it follows ends in one.
    follows = F.lead("kind").over(Window.partitionBy("doc").orderBy("ord", "kind", "at")) == 1
    spaced = F.when(follows & (F.col("text") != ""), F.concat(F.rtrim(F.col("text"), F.lit("\n")), F.lit("\n\n"))).otherwise(F.col("text"))
    every = every.withColumn("text", spaced)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ord", "kind", "at", "text"))), lambda x: x["text"])
    return every.groupBy("doc").agg(F.array_join(ordered, "").alias("text")).join(faults, "doc", "left").select("doc", "text", "error")

"""Which parts of a note a chunk of new observations touches, over many notes and chunks.

The rules, in order: the core sections always; the themes if the chunk is about current work; every other section that the chunk names; every subsection
outside the core that shares a name with it. A chunk that touches none of the last three gets one subsection in turn, by its fold number
(without any, one section outside the core), flagged as rotation, as it is shown for coverage and is no match.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.text import name_tokens, slug, strip
from tidewell.operators.context import CURRENT_WORK
from tidewell.operators.patches import note_parts

#: Slugs of the core sections and of the themes.
CORE = ("core-identity", "preferences-opinions", "relationship-communication", "key-facts-context")
THEMES = "recent-themes"


def _title(level: int) -> Column:
    return strip(F.regexp_extract("raw", rf"\A#{{{level}}} ([^\n]*)", 1))


def outline(notes: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """(doc, ord, sub, handle, slug, core, names): every section (sub 0) and subsection of each note, with the tokens that name it; core ones and theirs have none."""
    parts = note_parts(notes, doc, text).filter("ord > 0").withColumn("core", F.col("slug").isin(*CORE))
    own = F.element_at(F.split("handle", ":"), -1)
    pieces = F.transform(F.filter(F.split(_title(3), r"[/.\-\s]"), lambda p: p != ""), lambda p: slug(p))
    whole = F.concat(pieces, F.array(own), F.filter(F.split(own, "-"), lambda p: F.length(p) >= 2))
    names = F.when(F.col("sub") > 0, F.array_distinct(whole)).otherwise(F.array("slug"))
    return parts.select("doc", "ord", "sub", "handle", "slug", "core", F.when(~F.col("core"), names).alias("names"))


def routed(chunks: DataFrame, notes: DataFrame) -> DataFrame:
    """(doc, chunk_id, sections, subsections, unmatched, rotation) of chunks (doc, chunk_id, fold, text): handles in the note's order, and the chunk's names that nothing in the note has.

    One equi join on (doc, token), so chunks meet only what they share a name with, and texts never leave their task. A chunk_id is
    unique in its note. A null text names nothing; chunks of an unknown note have no handles.
    """
    parts = outline(notes)
    place = F.struct("ord", "sub", "handle")
    other = ~F.col("core")
    gathered = lambda test: F.array_sort(F.collect_list(F.when(test, place)))
    shape = parts.groupBy("doc").agg(
        gathered(F.col("core") & (F.col("sub") == 0)).alias("_core"), gathered(other & (F.col("sub") == 0)).alias("_rest"), gathered(other & (F.col("sub") > 0)).alias("_subs"),
        F.max(F.when((F.col("sub") == 0) & (F.col("slug") == THEMES), place)).alias("_themes"),
    )
    names = parts.select("doc", F.explode("names").alias("_token"), place.alias("_hit"))
    current = reduce(or_, [F.contains(F.lower("text"), F.lit(w)) for w in CURRENT_WORK])
    # Names and the look at the text are worked out before the names become rows, once a chunk.
    read = chunks.select("doc", "chunk_id", "fold", F.coalesce(current, F.lit(False)).alias("_current"), F.explode_outer(F.array(name_tokens(F.col("text")))).alias("_tokens"))
    words = read.select("doc", "chunk_id", "fold", "_current", F.explode_outer("_tokens").alias("_token"))
    met = words.join(names, ["doc", "_token"], "left").groupBy("doc", "chunk_id", "fold", "_current")
    met = met.agg(F.collect_set("_hit").alias("_hits"), F.array_sort(F.collect_set(F.when(F.col("_hit").isNull(), F.col("_token")))).alias("unmatched"))
    empty = F.array().cast(met.schema["_hits"].dataType)
    all_of = lambda c: F.coalesce(F.col(c), empty)
    rows = met.join(shape, "doc", "left").withColumn("_met", F.array_union("_hits", F.when(F.col("_current") & F.col("_themes").isNotNull(), F.array("_themes")).otherwise(empty)))
    rotation = F.size("_met") == 0
    turn = lambda c: F.array(F.get(F.col(c), F.pmod(F.col("fold"), F.size(c)).cast("int")))
    spare = F.when(F.size(all_of("_subs")) > 0, turn("_subs")).when(F.size(all_of("_rest")) > 0, turn("_rest")).otherwise(empty)
    shown = F.array_sort(F.array_union(all_of("_core"), F.when(rotation, spare).otherwise(F.col("_met"))))
    rows = rows.select("doc", "chunk_id", shown.alias("_shown"), "unmatched", rotation.alias("rotation"))
    handles = lambda test: F.transform(F.filter("_shown", test), lambda x: x["handle"])
    return rows.select("doc", "chunk_id", handles(lambda x: x["sub"] == 0).alias("sections"), handles(lambda x: x["sub"] > 0).alias("subsections"), "unmatched", "rotation")


def contexts(routes: DataFrame, notes: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """(doc, chunk_id, text): the routed sections whole, then the routed subsections, each under its section's heading, in the note's order."""
    parts = note_parts(notes, doc, text).filter("ord > 0")
    bodies = F.array_sort(F.collect_list(F.struct("sub", "raw")))
    section = parts.groupBy("doc", "ord", F.col("section").alias("handle")).agg(bodies.alias("_parts"))
    joined = F.array_join(F.transform("_parts", lambda x: x["raw"]), "")
    whole = section.select("doc", "handle", F.struct(F.lit(0).alias("side"), "ord", F.lit(0).alias("sub")).alias("_at"), strip(joined).alias("_text"))
    head = parts.filter("sub = 0").select("doc", "ord", _title(2).alias("_head"))
    below = F.concat(F.lit("## "), "_head", F.lit("\n\n"), F.regexp_replace("raw", "\n+$", ""))
    under = parts.filter("sub > 0").join(head, ["doc", "ord"]).select("doc", "handle", F.struct(F.lit(1).alias("side"), "ord", "sub").alias("_at"), below.alias("_text"))
    asked = routes.select("doc", "chunk_id", F.explode(F.concat("sections", "subsections")).alias("handle"))
    found = asked.join(whole.unionByName(under), ["doc", "handle"]).groupBy("doc", "chunk_id").agg(F.array_sort(F.collect_list(F.struct("_at", "_text"))).alias("_x"))
    return found.select("doc", "chunk_id", F.array_join(F.transform("_x", lambda x: x["_text"]), "\n\n").alias("text"))

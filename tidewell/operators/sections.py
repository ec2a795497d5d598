"""Markdown as relations: lines, sections, entries, growth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.text import actionability, age_days, entry_id, entry_kind, metadata, reviewable, slug, strip


def lines(docs: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """(doc, line_no from 1, line)."""
    each = docs.select(F.col(doc).alias("doc"), F.posexplode(F.split(F.col(text), "\r\n|\r|\n")).alias("_at", "line"))
    return each.select("doc", (F.col("_at") + 1).alias("line_no"), "line")


def sections(docs: DataFrame, level: int = 2, doc: str = "doc", text: str = "text") -> DataFrame:
    """(doc, ord, heading, date, slug, handle, first_line, body): one row per heading of ``level``; ord 0 is what stands before the first.

    The nth section of one slug in a document has the handle ``slug-n`` from the second on. A text is cut within its row; only ``handle`` and
    ``first_line`` need windows, which are not planned where nobody reads them.
    """
    blank = r"[ \t\x0B\f]"
    head = rf"#{{{level}}}{blank}+(\S.*?){blank}*[\x85\u2028\u2029]?(?=\n)"
    # A line end before and after the text: every piece ends with one, and the first piece is never a section.
    framed = F.concat(F.lit("\n"), F.regexp_replace(F.col(text), "\r\n?", "\n"), F.lit("\n"))
    each = docs.select(F.col(doc).alias("doc"), F.posexplode(F.split(framed, rf"(?<=\n)(?={head})")).alias("_at", "_piece"))
    ends = F.length("_piece") - F.length(F.replace("_piece", F.lit("\n"), F.lit("")))
    before = F.sum(ends).over(Window.partitionBy("doc").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
    rows = each.withColumn("ord", F.col("_at").cast("long"))
    rows = rows.withColumn("heading", F.when(F.col("ord") > 0, F.regexp_extract("_piece", rf"\A{head}", 1)))
    rows = rows.withColumn("first_line", F.coalesce(before, F.lit(1)).cast("int")).filter("ord > 0 OR _piece <> '\n'")
    rest = F.substr(F.col("_piece"), F.locate("\n", F.col("_piece")) + 1)
    rows = rows.withColumn("body", F.left(rest, F.greatest(F.length(rest) - 1, F.lit(0))))
    date = F.when(F.col("heading").rlike("^\\d{4}-\\d{2}-\\d{2}$"), F.col("heading").try_cast("date"))
    out = rows.withColumn("date", date).withColumn("slug", F.when(F.col("heading").isNotNull(), slug(F.col("heading"))))
    nth = F.row_number().over(Window.partitionBy("doc", "slug").orderBy("ord"))
    handle = F.when(F.col("slug").isNull(), None).when(nth == 1, F.col("slug")).otherwise(F.concat_ws("-", "slug", nth.cast("string")))
    return out.withColumn("handle", handle).select("doc", "ord", "heading", "date", "slug", "handle", "first_line", "body")


def end_lines(found: DataFrame) -> DataFrame:
    """Adds ``next_line``: where the next section of the document starts; null for the last."""
    return found.withColumn("next_line", F.lead("first_line").over(Window.partitionBy("doc").orderBy("ord")))


def since(found: DataFrame, date: str | None) -> DataFrame:
    """Sections dated ``date`` or later, and what is undated; nothing for a document that keeps no dated one."""
    if date is None:
        return found
    kept = found.filter(F.col("date").isNull() | (F.col("date") >= F.lit(date).cast("date")))
    alive = kept.filter("date IS NOT NULL").select("doc").distinct()
    return kept.join(alive, "doc", "left_semi")


def retained(found: DataFrame, cutoff: str) -> DataFrame:
    return found.filter(F.col("date").isNull() | (F.col("date") >= F.lit(cutoff).cast("date")))


def latest_section(found: DataFrame) -> DataFrame:
    """Per document the section of the latest date, the first of several."""
    pick = F.max_by(F.struct("heading", "body"), F.struct("date", -F.col("ord")))
    return found.filter("date IS NOT NULL").groupBy("doc").agg(pick.alias("s")).select("doc", "s.*")


def entries(docs: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """Every bullet that is not empty, with its section, metadata, kind, actionability, id and whether it is worth comparing."""
    rows = lines(docs, doc, text)
    head = "^#{2,6}\\s+(.+?)\\s*$"
    bullet = "^\\s*[-*]\\s+(.*?)(?:\\s*<!--om:.*-->\\s*)?$"
    so_far = Window.partitionBy("doc").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    found = F.last(F.when(F.col("line").rlike(head), F.regexp_extract("line", head, 1)), ignorenulls=True).over(so_far)
    rows = rows.withColumn("section", F.coalesce(found, F.lit("")))
    rows = rows.filter(F.col("line").rlike("^\\s*[-*]\\s+") & ~F.col("line").rlike(head))
    rows = rows.withColumn("text", strip(F.regexp_extract("line", bullet, 1))).filter("text <> ''")
    rows = rows.withColumn("meta", metadata(F.col("line")))
    get = lambda k: F.try_element_at(F.col("meta"), F.lit(k))
    rows = rows.withColumn("kind", F.coalesce(F.nullif(get("kind"), F.lit("")), entry_kind(F.col("text"), F.col("section"))))
    rows = rows.withColumn("actionability", F.coalesce(get("actionability"), actionability(F.col("kind"))))
    rows = rows.withColumn("id_explicit", F.coalesce(get("id"), F.lit("")) != "")
    rows = rows.withColumn("entry_id", F.when(F.col("id_explicit"), get("id")).otherwise(entry_id(F.col("text"))))
    rows = rows.withColumn("reviewable", reviewable(get("scope"), F.col("kind"), F.col("actionability")))
    return rows.withColumn("scope", get("scope")).withColumn("node", get("node")).withColumn("source_type", get("source_type"))


def provenance(found: DataFrame, by: list[str]) -> DataFrame:
    """Per group of entries: scope by the most restrictive, owner and source type only where all agree."""
    one = lambda c: F.when(F.count_distinct(F.nullif(c, F.lit(""))) == 1, F.max(F.nullif(c, F.lit(""))))
    local, cluster = F.max((F.col("scope") == "local").cast("int")), F.max((F.col("scope") == "cluster").cast("int"))
    return found.groupBy(*by).agg(
        F.when(local == 1, "local").when(cluster == 1, "cluster").alias("scope"), one("node").alias("owner"), one("source_type").alias("source_type")
    )


def for_host(found: DataFrame, node: str) -> DataFrame:
    """Entries without those that are local to another, or to no named, node."""
    own = F.coalesce(F.col("node").isin("", node), F.lit(False))
    return found.filter(~(F.coalesce(F.col("scope") == "local", F.lit(False)) & ~own))


def growth(found: DataFrame, by: list[str], now: Column) -> DataFrame:
    """Bytes, lines, bullets, share of all bytes and age of each group of sections (heading, body, and ``seen`` timestamps)."""
    n_lines = F.when(F.col("body") == "", 0).otherwise(F.size(F.split(F.regexp_replace("body", "\n$", ""), "\n")))
    bullets = F.regexp_count("body", F.lit("(?m)^\\s*[-*]\\s+"))
    sums = found.groupBy(*by).agg(
        F.sum(F.octet_length("body")).cast("long").alias("bytes"),
        F.sum(n_lines).cast("long").alias("n_lines"),
        F.sum(bullets).cast("long").alias("bullets"),
        F.max("seen").alias("seen"),
    )
    total = sums.agg(F.sum("bytes").alias("all_bytes"))
    shared = sums.join(F.broadcast(total))  # one row
    share = F.when(F.col("all_bytes") > 0, F.round(F.col("bytes") / F.col("all_bytes"), 4)).otherwise(0.0)
    return shared.withColumn("share", share).withColumn("age_days", age_days(F.col("seen"), now)).drop("all_bytes", "seen")


def fattest(report: DataFrame, n: int, name: str) -> DataFrame:
    return report.orderBy(F.desc("bytes"), name).limit(n)


def coldest(report: DataFrame, n: int, name: str) -> DataFrame:
    return report.filter("age_days IS NOT NULL").orderBy(F.desc("age_days"), name).limit(n)

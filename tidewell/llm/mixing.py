"""Mixing sources to target weights along a time-varying curriculum.

Sources in code point order (null last) carry the weights in turn. Each gets its share of all words
by weight, at most ``cap`` times its own size; what a full source cannot take is shared again by
weight. A source is read in whole passes and one partial pass, in an order fixed by a digest, until
its target is met to the word. Its weight schedule over training time t in [0, 1] has the density
1 + a(2t - 1); the integral a t^2 + (1 - a) t, inverted at the share of the source's words that
come before a pass over a document, gives the time of that pass, and a range sort by time gives
the training order.

Defined results: a null text has size 0 and is never taken; a null source is a source of its own;
repeated rows form one unit whose words they share evenly; an empty table gives an empty table;
other columns of the input play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import running_totals, words_of

WEIGHTS = (5, 2, 1)
SLOPES = (-0.5, 0.0, 0.5)
CAP = 3
SALTS = 16


def unit_key(doc_id: Column, source: Column, text: Column) -> Column:
    """Digest that names a row by its id, source and text; it also fixes the order within a source."""
    parts = [F.coalesce(doc_id.cast("string"), F.lit("-")), F.coalesce(F.md5(source), F.lit("-"))]
    return F.md5(F.concat_ws("|", *parts, F.md5(F.coalesce(text, F.lit("")))))


def source_targets(sizes: DataFrame, weights=WEIGHTS, slopes=SLOPES, cap: int = CAP) -> DataFrame:
    """(source, source_size, start, target, slope): one row per source; ``start`` is the size of all sources before it.

    Filling: with sources by cap/weight ascending, the fair share per weight that is left after the
    sources before k rises while they are full and falls after that, so its maximum is the level.
    """
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = [F.col("source").asc_nulls_last()]
    ranked = running_totals(each, by_name, {"rank": F.lit(1), "start": F.col("source_size")})
    pick = lambda values: F.get(F.array(*[F.lit(v) for v in values]), F.col("rank").cast("int") % len(values))
    ranked = ranked.withColumn("weight", pick(weights)).withColumn("slope", pick(slopes))
    ranked = ranked.withColumn("most", F.col("source_size") * cap)
    filled = running_totals(
        ranked, [F.col("most") / F.col("weight"), F.col("rank")], {"most_before": F.col("most"), "weight_before": F.col("weight")}
    )
    sums = filled.agg(F.sum("source_size").alias("_all"), F.sum("weight").alias("_weights"))
    fair = (F.col("_all") - F.col("most_before")) / (F.col("_weights") - F.col("weight_before"))
    level = filled.crossJoin(F.broadcast(sums)).agg(F.max(fair).alias("_level"))  # one row each
    target = F.least(F.col("most").cast("double"), F.col("_level") * F.col("weight"))
    return filled.crossJoin(F.broadcast(level)).select("source", "source_size", "start", target.alias("target"), "slope")


def mix(docs: DataFrame, doc_id="doc_id", source="source", text="text", weights=WEIGHTS, slopes=SLOPES, cap=CAP) -> DataFrame:
    """One row per distinct unit: key, doc_id, source, size, copies, source_size, target, slope, passes, part, offset.

    ``passes`` are whole passes over the unit, ``part`` the words of its partial pass, ``offset`` the
    words of its source before it. Only ids, sizes and digests are shuffled, never texts.
    """
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).alias("source"),
        unit_key(F.col(doc_id), F.col(source), F.col(text)).alias("key"),
        F.size(words_of(F.col(text))).cast("long").alias("size"),
    )
    units = rows.groupBy("key").agg(
        F.any_value("doc_id").alias("doc_id"),
        F.any_value("source").alias("source"),
        F.any_value("size").alias("size"),
        F.count(F.lit(1)).alias("copies"),
    )
    order = [F.col("source").asc_nulls_last(), F.col("key")]
    placed = running_totals(units, order, {"before": F.col("size") * F.col("copies")})
    targets = source_targets(placed.select("source", (F.col("size") * F.col("copies")).alias("size")), weights, slopes, cap)
    # A source may hold a third of all rows: these are dealt over SALTS keys, and the one row of each source with them.
    dealt = placed.withColumn("salt", F.pmod(F.hash("key"), F.lit(SALTS))).alias("u")
    every = targets.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).alias("t")
    same = F.col("u.source").eqNullSafe(F.col("t.source")) & (F.col("u.salt") == F.col("t.salt"))
    joined = dealt.join(every, same, "left").drop(F.col("u.salt"))
    joined = joined.select("u.key", "u.doc_id", "u.source", "u.size", "u.copies", "u.before", "t.source_size", "t.start", "t.target", "t.slope")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    joined = joined.withColumn("passes", whole).withColumn("offset", F.col("before") - F.col("start"))
    left = F.round("target").cast("long") - F.col("passes") * F.col("source_size") - F.col("offset")
    part = F.greatest(F.lit(0), F.least(left, F.col("size") * F.col("copies"))).cast("long")
    return joined.withColumn("part", part).drop("before", "start")


def taken_per_row(units: DataFrame) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken."""
    taken = F.col("passes") * F.col("size") + F.floor(F.col("part") / F.col("copies"))
    rows = units.withColumn("taken", taken.cast("long")).withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return rows.select("key", "doc_id", "size", "source_size", "target", "taken")


def training_order(units: DataFrame, whole_parts: bool = False) -> DataFrame:
    """One row per pass over a unit, range-sorted by training time: key, doc_id, pass, words, time, position.

    ``position`` counts the words of the mix before the pass. With ``whole_parts`` a partial pass
    counts as a whole one from half of the unit on, else as none.
    """
    last = F.col("part") * 2 >= F.col("size") * F.col("copies") if whole_parts else F.lit(True)
    n = F.col("passes") + F.when((F.col("part") > 0) & last, 1).otherwise(0)
    each = units.filter(n > 0).withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    full = F.col("size") * F.col("copies")
    words = F.when((F.col("pass") < F.col("passes")) | F.lit(whole_parts), full).otherwise(F.col("part"))
    share = F.least(F.lit(1.0), (F.col("pass") * F.col("source_size") + F.col("offset")) / F.col("target"))
    a = F.col("slope")
    time = F.when(a == 0, share).otherwise((F.sqrt((1 - a) * (1 - a) + 4 * a * share) - (1 - a)) / (2 * a))
    timed = each.select("key", "doc_id", "copies", "pass", words.alias("words"), time.alias("time"))
    return running_totals(timed, [F.col("time"), F.col("key"), F.col("pass")], {"position": F.col("words")})

"""Hybrid logical clocks and vector-clock frontiers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STAMP = r"^(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d+Z)-(\d+)-(.+)$"


def hlc(text: Column) -> Column:
    """struct<wall, counter, node> of a stamp; null fields where it does not parse."""
    return F.struct(
        F.try_to_timestamp(F.nullif(F.regexp_extract(text, STAMP, 1), F.lit(""))).alias("wall"),
        F.nullif(F.regexp_extract(text, STAMP, 2), F.lit("")).try_cast("int").alias("counter"),
        F.nullif(F.regexp_extract(text, STAMP, 3), F.lit("")).alias("node"),
    )


def hlc_text(stamp: Column) -> Column:
    """The sortable text of a stamp."""
    wall = F.date_format(stamp["wall"], "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return F.concat(wall, F.lit("-"), F.lpad(stamp["counter"].cast("string"), 6, "0"), F.lit("-"), stamp["node"])


def hlc_tick(last: Column, now: Column, node: Column) -> Column:
    """Stamp of a local event at wall time ``now`` after ``last``."""
    ahead = last["wall"] >= now
    wall, counter = F.when(ahead, last["wall"]).otherwise(now), F.when(ahead, last["counter"] + 1).otherwise(0)
    return F.struct(wall.alias("wall"), counter.alias("counter"), node.alias("node"))


def hlc_merge(last: Column, seen: Column, now: Column, node: Column) -> Column:
    """Stamp after receiving ``seen`` at wall time ``now``."""
    wall = F.greatest(last["wall"], seen["wall"], now)
    own, other = last["wall"] == wall, seen["wall"] == wall
    counter = (
        F.when(own & other, F.greatest(last["counter"], seen["counter"]) + 1)
        .when(own, last["counter"] + 1)
        .when(other, seen["counter"] + 1)
        .otherwise(0)
    )
    return F.struct(wall.alias("wall"), counter.alias("counter"), node.alias("node"))


def frontier_join(a: Column, b: Column) -> Column:
    """Pointwise maximum of two map<node, seq>."""
    return F.map_zip_with(a, b, lambda node, x, y: F.greatest(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0))))


def frontier_covers(a: Column, b: Column) -> Column:
    """Whether ``a`` has seen all that ``b`` has."""
    return F.forall(F.map_entries(b), lambda e: F.coalesce(F.try_element_at(a, e["key"]), F.lit(0)) >= e["value"])


def frontier_order(a: Column, b: Column) -> Column:
    up, down = frontier_covers(a, b), frontier_covers(b, a)
    return F.when(up & down, "equal").when(up, "covers").when(down, "covered_by").otherwise("incomparable")

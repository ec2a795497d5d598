"""Requests to peers and what became of each: answered, answered with nothing, without an index, or out of time.

``outcomes`` is for tables, ``outcome_stream`` for streams; on the same rows they say the same. Requests are (request_id, peer, asked_at) and
replies (request_id, sender, replied_at, message_id, verified, ready, hits), both with timestamps. A reply counts if it is verified, comes from the peer that
was asked, and at most ``patience`` seconds after the request (both ends included); the first by (replied_at, message_id) is the answer, so a
repeated, forged or late one changes nothing. Repeated requests are one. A request without a time gives no row; one without an id or
peer has no answer.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["request_id", "peer"]


def reply_status() -> Column:
    """What a reply (ready, hits) says: null counts as not ready and as no hits."""
    return F.when(~F.coalesce("ready", F.lit(False)), "UNAVAILABLE").when(F.coalesce("hits", F.lit(0)) > 0, "OK").otherwise("EMPTY")


def _asked(requests: DataFrame) -> DataFrame:
    return requests.filter("asked_at IS NOT NULL").select(*KEY, "asked_at")


def _valid(replies: DataFrame) -> DataFrame:
    known = replies.filter("verified AND request_id IS NOT NULL AND sender IS NOT NULL AND replied_at IS NOT NULL")
    return known.select("request_id", F.col("sender").alias("peer"), "replied_at", F.struct("replied_at", "message_id", reply_status().alias("status")).alias("reply"))


def outcomes(requests: DataFrame, replies: DataFrame, patience: int, until: Column | None = None) -> DataFrame:
    """(request_id, peer, asked_at, status, message_id, replied_at); with ``until``, unanswered requests whose time is not up by then have no row.

    Time is cut into spans of ``patience``, so an answer lies in the request's span or the next: it is the first reply from the request
    on in the one, found by a window over a span of a key, or else the first of the other. So no pairs are made, and a key with
    many requests and replies is dealt by its spans. Replies of the same moment merge before the shuffle.
    """
    span = F.floor(F.unix_micros("at") / (patience * 1_000_000))
    firsts = _valid(replies).groupBy(*KEY, F.col("replied_at").alias("at")).agg(F.min("reply").alias("reply")).withColumn("span", span)
    asked = _asked(requests).distinct().select(*KEY, F.col("asked_at").alias("at"), F.lit(None).cast(firsts.schema["reply"].dataType).alias("reply")).withColumn("span", span).withColumn("asks", F.lit(True))
    rows = asked.unionByName(firsts.withColumn("asks", F.lit(False)))
    on = Window.partitionBy(*KEY, "span").orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    here = rows.withColumn("near", F.min("reply").over(on)).filter("asks").select(*KEY, "span", F.col("at").alias("asked_at"), "near")
    following = firsts.groupBy(*KEY, (F.col("span") - 1).alias("span")).agg(F.min("reply").alias("next"))
    end = F.col("asked_at") + F.lit(timedelta(seconds=patience))
    found = F.coalesce("near", "next")
    met = here.join(following, [*KEY, "span"], "left").withColumn("answer", F.when(found["replied_at"] <= end, found))
    status = F.coalesce(F.col("answer.status"), F.when(F.lit(True) if until is None else end < until, "TIMEOUT"))
    return met.select(*KEY, "asked_at", status.alias("status"), "answer.message_id", "answer.replied_at").filter("status IS NOT NULL")


def outcome_stream(requests: DataFrame, replies: DataFrame, patience: int, late: str = "1 minute") -> DataFrame:
    """As ``outcomes``, each row once no reply in time can still come: when both streams are ``late`` past the end of the request's time.

    An outer join of the streams within the time range, whose state the watermarks bound, under an aggregate for the first of several replies.
    Rows that arrive later than ``late`` behind their stream are not seen, as in any stream with a watermark.
    """
    a = _asked(requests).withWatermark("asked_at", late).alias("a")
    r = _valid(replies).withWatermark("replied_at", late).alias("r")
    in_time = (F.col("r.replied_at") >= F.col("a.asked_at")) & (F.col("r.replied_at") <= F.col("a.asked_at") + F.lit(timedelta(seconds=patience)))
    same = (F.col("a.request_id") == F.col("r.request_id")) & (F.col("a.peer") == F.col("r.peer"))
    met = a.join(r, same & in_time, "left_outer").select("a.request_id", "a.peer", "a.asked_at", "r.reply")
    first = met.groupBy(*KEY, "asked_at").agg(F.min("reply").alias("answer"))
    return first.select(*KEY, "asked_at", F.coalesce("answer.status", F.lit("TIMEOUT")).alias("status"), "answer.message_id", "answer.replied_at")

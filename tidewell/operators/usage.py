"""The call ledger: totals, summaries, tails, budgets and prices."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.rounding import exact_sum, round6, usd
from tidewell.functions.text import shown_usd

#: Providers whose calls cost nothing more than their subscription.
SUBSCRIPTIONS = ("openai-chatgpt", "xai-oauth")


def _ok() -> Column:
    return F.col("status") == "ok"


def _tokens(when: Column) -> Column:
    return F.coalesce(F.sum(F.when(when, F.col("tokens"))), F.lit(0)).cast("long")


def _where(calls: DataFrame, since=None, session=None, operation=None) -> DataFrame:
    """Optional conditions as one conjunction, so that the scan gets them."""
    tests = []
    if since is not None:
        tests.append(F.col("ts") >= F.lit(since).cast("timestamp"))
    if session is not None:
        tests.append(F.col("session_id") == session)
    if operation is not None:
        tests.append(F.col("operation") == operation)
    return calls.filter(reduce(and_, tests)) if tests else calls


def window_totals(calls: DataFrame, since=None, session=None, operation=None) -> DataFrame:
    """Cost and tokens of successful calls under the given conditions; one row, 0 where nothing matches."""
    rows = _where(calls, since, session, operation).filter(_ok())
    return rows.agg(usd(exact_sum(F.col("usd"))).alias("usd"), F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("tokens"))


def _summary() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("calls"),
        _tokens(_ok()).alias("tokens"),
        usd(exact_sum(F.when(_ok(), F.col("usd")))).alias("usd"),
        F.count_if(_ok() & F.col("usd").isNull()).alias("unpriced"),
        F.count_if(F.col("status") == "blocked_by_budget").alias("blocked"),
    ]


def usage_summary(calls: DataFrame, since=None) -> DataFrame:
    """One row: calls of any status, cost and tokens of successes, successes without a price, blocked calls."""
    return _where(calls, since).agg(*_summary())


def usage_by_operation(calls: DataFrame, since=None) -> DataFrame:
    """The summary per operation."""
    return _where(calls, since).groupBy("operation").agg(*_summary())


def tail(calls: DataFrame, limit: int = 20) -> DataFrame:
    """The newest calls by id."""
    return calls.orderBy(F.desc("id")).limit(limit)


def totals_by_window(calls: DataFrame) -> DataFrame:
    """Successful cost and tokens per UTC day, month and session, in one pass by grouping sets."""
    rows = calls.filter(_ok()).select(
        F.date_trunc("DAY", "ts").alias("day"), F.date_trunc("MONTH", "ts").alias("month"), "session_id", "usd", "tokens"
    )
    sets = [["day"], ["month"], ["session_id"]]
    sums = rows.groupingSets([[F.col(c) for c in s] for s in sets], "day", "month", "session_id").agg(
        usd(exact_sum(F.col("usd"))).alias("usd"), F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("tokens")
    )
    kind = F.when(F.col("day").isNotNull(), "day").when(F.col("month").isNotNull(), "month").otherwise("session")
    start = F.coalesce(F.date_format("day", "yyyy-MM-dd"), F.date_format("month", "yyyy-MM-dd"), F.col("session_id").cast("string"))
    return sums.select(kind.alias("window"), start.alias("key"), "usd", "tokens")


def budget_status(calls: DataFrame, budgets: DataFrame, now: str, session: int) -> DataFrame:
    """Spent, remaining and used percent of each budget (key, scope, window, unit, limit, mode).

    Budgets are a handful of settings; the ledger is summed once per (operation, window), then joined.
    """
    at = F.lit(now).cast("timestamp")
    spans = {
        "day": F.col("ts") >= F.date_trunc("DAY", at),
        "month": F.col("ts") >= F.date_trunc("MONTH", at),
        "session": F.col("session_id") == session,
    }
    inside = F.array(*[F.struct(F.lit(w).alias("window"), cond.alias("hit")) for w, cond in spans.items()])
    rows = calls.filter(_ok()).select("operation", "usd", "tokens", F.explode(F.filter(inside, lambda x: x["hit"])).alias("x"))
    per = rows.groupBy("operation", F.col("x.window").alias("window")).agg(exact_sum(F.col("usd")).alias("usd"), F.sum("tokens").alias("tokens"))
    joined = budgets.alias("b").join(
        per.alias("p"), (F.col("b.window") == F.col("p.window")) & ((F.col("b.scope") == "global") | (F.col("b.scope") == F.col("p.operation"))), "left"
    )
    spent = F.when(F.col("unit") == "usd", usd(F.sum("usd"))).otherwise(F.coalesce(F.sum("tokens"), F.lit(0)).cast("double"))
    sums = joined.groupBy("b.key", "b.scope", "b.window", "b.unit", "b.limit", "b.mode").agg(spent.alias("spent"))
    return sums.withColumns(
        {
            "remaining": F.greatest(F.col("limit") - F.col("spent"), F.lit(0.0)),
            "pct": F.floor(F.col("spent") / F.col("limit") * 100).cast("long"),
        }
    )


def budget_decision(status: DataFrame, estimates: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Per planned call (operation, est_usd, est_tokens): block, warn or allow, with the budgets that say so."""
    both = estimates.join(status, (F.col("scope") == "global") | (F.col("scope") == F.col("operation")), "left")
    estimate = F.when(F.col("unit") == "usd", F.coalesce("est_usd", F.lit(0.0))).otherwise(F.coalesce(F.col("est_tokens").cast("double"), F.lit(0.0)))
    over = F.col("spent") + estimate > F.col("limit")
    level = (
        F.when(over & (F.col("mode") == "hard"), 2).when(over, 1).when(F.col("spent") / F.col("limit") >= threshold, 1).otherwise(0)
    )
    judged = both.withColumn("level", level)
    top = F.max("level")
    return judged.groupBy("operation", "est_usd", "est_tokens").agg(
        F.when(top == 2, "block").when(top == 1, "warn").otherwise("allow").alias("action"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("level") == 2, F.col("key")))), ",").alias("blocked_by"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("level") == 1, F.col("key")))), ",").alias("warned_by"),
    )


def price_lookup(models: DataFrame, rates: DataFrame) -> DataFrame:
    """``models`` (column model) with key, input and output of their rate: exact, then without ``-YYYYMMDD``, then longest prefix.

    Prefixes become equality: a model is expanded to its prefixes, which meet the keys in one equi join.
    """
    base = F.regexp_replace("model", "-[0-9]{8}$", "")
    names = models.select("model").distinct()
    ways = F.concat(
        F.array(F.struct(F.lit(0).alias("way"), F.col("model").alias("key")), F.struct(F.lit(1).alias("way"), base.alias("key"))),
        F.transform(
            F.filter(F.sequence(F.length("model"), F.lit(1), F.lit(-1)), lambda n: F.length("model") > 0),
            lambda n: F.struct((2 + F.length("model") - n).alias("way"), F.substr(F.col("model"), F.lit(1), n).alias("key")),
        ),
    )
    each = names.select("model", F.explode(ways).alias("w")).select("model", "w.way", "w.key")
    met = each.join(rates.select("key", "input", "output"), "key")
    best = met.groupBy("model").agg(F.min_by(F.struct("key", "input", "output"), "way").alias("r"))
    return models.join(best, "model", "left").select(models["*"], "r.key", "r.input", "r.output")


def cost_estimate(calls: DataFrame) -> DataFrame:
    """Adds est_input, est_output, est_total: rounded to 6 each, then as a sum; subscriptions cost 0, unknown rates give null."""

    def part(tokens: str, rate: str) -> Column:
        cost = round6(F.col(tokens).cast("double") * F.col(rate) / 1e6)
        return F.when(F.coalesce(F.col("provider").isin(*SUBSCRIPTIONS), F.lit(False)), F.lit(0.0)).otherwise(cost)

    out = calls.withColumn("est_input", part("prompt_tokens", "input")).withColumn("est_output", part("completion_tokens", "output"))
    return out.withColumn("est_total", round6(F.col("est_input") + F.col("est_output")))


def batch_cost(priced: DataFrame) -> DataFrame:
    """Half of each estimate, rounded to 6; null stays null."""
    return priced.withColumns({c: round6(F.col(c) * 0.5) for c in ("est_input", "est_output", "est_total")})


def tail_table(calls: DataFrame, limit: int = 20) -> DataFrame:
    """(id, line): the newest calls as lines of a report: time, operation, status, tokens, dollars."""
    row = F.format_string("%s  %-10s  %-18s  %8d", F.date_format("ts", "yyyy-MM-dd HH:mm"), "operation", "status", F.coalesce("tokens", F.lit(0).cast("long")))
    return tail(calls, limit).select("id", F.concat(row, F.lit("  "), shown_usd(F.col("usd"))).alias("line"))

"""Ledger queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import usage

from .relations import CALLS_SQL, calls, table

OK_SUMS = """count(*) AS calls,
  CAST(coalesce(sum(CASE WHEN status = 'ok' THEN tokens END), 0) AS BIGINT) AS tokens,
  coalesce(CAST(round(sum(CASE WHEN status = 'ok' THEN CAST(usd AS DECIMAL(28,8)) END), 6) AS DOUBLE), 0) AS usd,
  count(*) FILTER (WHERE status = 'ok' AND usd IS NULL) AS unpriced,
  count(*) FILTER (WHERE status = 'blocked_by_budget') AS blocked"""
TOTALS = """coalesce(CAST(round(sum(CAST(usd AS DECIMAL(28,8))), 6) AS DOUBLE), 0) AS usd,
  CAST(coalesce(sum(tokens), 0) AS BIGINT) AS tokens"""
BUDGETS = (
    ("g_month_usd", "global", "month", "usd", 1500.0, "hard"),
    ("g_day_tok", "global", "day", "tokens", 900.0, "soft"),
    ("click_month_usd", "click", "month", "usd", 100.0, "soft"),
    ("view_month_tok", "view", "month", "tokens", 100000.0, "hard"),
    ("g_session_usd", "global", "session", "usd", 50.0, "hard"),
)
ESTIMATES = (("click", 1.5, 100), ("view", 2000.0, 10), ("purchase", None, 5))
NOW, SESSION = "2024-01-20 00:00:00", 7


def _budgets(spark):
    return spark.createDataFrame(list(BUDGETS), "key string, scope string, window string, unit string, limit double, mode string")


def _status(spark, sf_dir):
    return usage.budget_status(calls(spark, sf_dir), _budgets(spark), NOW, SESSION)


def _rates(spark, sf_dir):
    """A price for the first word, and for the first two words, of every part type, and for some brands."""
    types = F.split("p_type", " ")
    part = table(spark, sf_dir, "part")
    one, two = F.get(types, 0), F.array_join(F.slice(types, 1, 2), " ")
    keys = part.select(one.alias("key")).union(part.select(two.alias("key"))).distinct()
    return keys.select("key", F.length("key").cast("double").alias("input"), (F.length("key") * 2.0).alias("output"))


def _price(spark, sf_dir):
    suffix = F.when(F.col("p_partkey") % 3 == 0, "-20260101").otherwise("")
    models = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_type", suffix).alias("model"))
    return usage.price_lookup(models, _rates(spark, sf_dir))


def _cost(spark, sf_dir):
    priced = _price(spark, sf_dir).select(
        "p_partkey", "input", "output", (F.col("p_partkey") * 7).alias("prompt_tokens"), (F.col("p_partkey") * 3).alias("completion_tokens"),
        F.when(F.col("p_partkey") % 10 == 0, "xai-oauth").otherwise("api").alias("provider"),
    )
    out = usage.cost_estimate(priced)
    half = usage.batch_cost(out).select("p_partkey", F.col("est_total").alias("batch_total"))
    return out.join(half, "p_partkey").select("p_partkey", "est_input", "est_output", "est_total", "batch_total")


QUERIES = {
    "usage_by_operation": lambda spark, sf_dir: usage.usage_by_operation(calls(spark, sf_dir)),
    "usage_summary": lambda spark, sf_dir: usage.usage_summary(calls(spark, sf_dir)),
    "usage_window_totals": lambda spark, sf_dir: usage.window_totals(calls(spark, sf_dir), since="2024-01-10 00:00:00", operation="click"),
    "usage_totals_by_window": lambda spark, sf_dir: usage.totals_by_window(calls(spark, sf_dir)),
    "usage_tail": lambda spark, sf_dir: usage.tail(calls(spark, sf_dir)).select("id", "operation", "usd", "tokens", "status"),
    "budget_status": _status,
    "budget_decision": lambda spark, sf_dir: usage.budget_decision(
        _status(spark, sf_dir), spark.createDataFrame(list(ESTIMATES), "operation string, est_usd double, est_tokens long")
    ),
    "price_lookup": _price,
    "cost_estimate": _cost,
}

_VALUES = ", ".join(str(b) for b in BUDGETS)
STATUS_SQL = f"""{CALLS_SQL}, budgets(key, scope, "window", unit, "limit", mode) AS (VALUES {_VALUES}),
status AS (
  SELECT key, scope, "window", unit, CAST("limit" AS DOUBLE) AS "limit", mode,
         CASE WHEN unit = 'usd' THEN coalesce(CAST(round(sum(CAST(usd AS DECIMAL(28,8))), 6) AS DOUBLE), 0)
              ELSE CAST(coalesce(sum(tokens), 0) AS DOUBLE) END AS spent
  FROM budgets b LEFT JOIN calls c ON c.status = 'ok' AND (b.scope = 'global' OR b.scope = c.operation)
   AND CASE b."window" WHEN 'day' THEN c.ts >= date_trunc('day', TIMESTAMP '{NOW}')
            WHEN 'month' THEN c.ts >= date_trunc('month', TIMESTAMP '{NOW}') ELSE c.session_id = {SESSION} END
  GROUP BY key, scope, "window", unit, "limit", mode)"""
PRICE_SQL = """rates AS (
  SELECT DISTINCT key, CAST(length(key) AS DOUBLE) AS input, length(key) * 2.0::DOUBLE AS output FROM (
    SELECT string_split(p_type, ' ')[1] AS key FROM part UNION ALL
    SELECT array_to_string(string_split(p_type, ' ')[1:2], ' ') FROM part)
), models AS (
  SELECT p_partkey, p_type || CASE WHEN p_partkey % 3 = 0 THEN '-20260101' ELSE '' END AS model FROM part
), ways AS (
  SELECT m.model, r.*, CASE WHEN m.model = r.key THEN 0 WHEN regexp_replace(m.model, '-[0-9]{8}$', '') = r.key THEN 1
                            ELSE 2 + length(m.model) - length(r.key) END AS way
  FROM (SELECT DISTINCT model FROM models) m JOIN rates r ON starts_with(m.model, r.key)
), best AS (SELECT * FROM ways QUALIFY row_number() OVER (PARTITION BY model ORDER BY way) = 1),
price AS (SELECT m.p_partkey, m.model, b.key, b.input, b.output FROM models m LEFT JOIN best b ON m.model = b.model)"""
_ESTIMATES = ", ".join(f"('{o}', {'NULL' if u is None else u}::DOUBLE, {t}::BIGINT)" for o, u, t in ESTIMATES)

ORACLE_SQL = {
    "usage_by_operation": f"WITH {CALLS_SQL} SELECT operation, {OK_SUMS} FROM calls GROUP BY operation",
    "usage_summary": f"WITH {CALLS_SQL} SELECT {OK_SUMS} FROM calls",
    "usage_window_totals": f"""WITH {CALLS_SQL} SELECT {TOTALS} FROM calls
WHERE status = 'ok' AND ts >= TIMESTAMP '2024-01-10 00:00:00' AND operation = 'click'""",
    "usage_totals_by_window": f"""WITH {CALLS_SQL}, ok AS (SELECT * FROM calls WHERE status = 'ok')
SELECT 'day' AS "window", strftime(date_trunc('day', ts), '%Y-%m-%d') AS key, {TOTALS} FROM ok GROUP BY ALL
UNION ALL SELECT 'month', strftime(date_trunc('month', ts), '%Y-%m-%d'), {TOTALS} FROM ok GROUP BY ALL
UNION ALL SELECT 'session', CAST(session_id AS VARCHAR), {TOTALS} FROM ok GROUP BY ALL""",
    "usage_tail": f"WITH {CALLS_SQL} SELECT id, operation, usd, tokens, status FROM calls ORDER BY id DESC LIMIT 20",
    "budget_status": f"""WITH {STATUS_SQL}
SELECT *, greatest("limit" - spent, 0.0::DOUBLE) AS remaining, CAST(floor(spent / "limit" * 100) AS BIGINT) AS pct FROM status""",
    "budget_decision": f"""WITH {STATUS_SQL}, est(operation, est_usd, est_tokens) AS (VALUES {_ESTIMATES}),
judged AS (
  SELECT e.*, key, CASE
    WHEN spent + CASE WHEN unit = 'usd' THEN coalesce(est_usd, 0) ELSE coalesce(est_tokens, 0) END > "limit"
      THEN CASE WHEN mode = 'hard' THEN 2 ELSE 1 END
    WHEN spent / "limit" >= 0.8 THEN 1 ELSE 0 END AS level
  FROM est e LEFT JOIN status s ON s.scope = 'global' OR s.scope = e.operation)
SELECT operation, est_usd, est_tokens,
       CASE max(level) WHEN 2 THEN 'block' WHEN 1 THEN 'warn' ELSE 'allow' END AS action,
       coalesce(string_agg(key, ',' ORDER BY key) FILTER (WHERE level = 2), '') AS blocked_by,
       coalesce(string_agg(key, ',' ORDER BY key) FILTER (WHERE level = 1), '') AS warned_by
FROM judged GROUP BY ALL""",
    "price_lookup": f"WITH {PRICE_SQL} SELECT * FROM price",
    "cost_estimate": f"""WITH {PRICE_SQL}, cost AS (
  SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 0.0::DOUBLE ELSE floor(((p_partkey * 7)::DOUBLE * input / 1e6) * 1e6 + 0.5) / 1e6 END AS est_input,
         CASE WHEN p_partkey % 10 = 0 THEN 0.0::DOUBLE ELSE floor(((p_partkey * 3)::DOUBLE * output / 1e6) * 1e6 + 0.5) / 1e6 END AS est_output
  FROM price)
SELECT *, floor((est_input + est_output) * 1e6 + 0.5) / 1e6 AS est_total, floor(((floor((est_input + est_output) * 1e6 + 0.5) / 1e6) * 0.5) * 1e6 + 0.5) / 1e6 AS batch_total FROM cost""",
}

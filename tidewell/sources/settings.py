"""Small settings read on the driver: prices and budgets."""

from __future__ import annotations

import itertools
import tomllib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RATES = "key string, input double, output double, origin string"
WINDOWS, UNITS = ("day", "month", "session"), ("usd", "tokens")


def read_rates(spark: SparkSession, path: str | Path, origin: str) -> DataFrame:
    """(key, input, output, origin) of a TOML file with a table per model: ``[models."name"]`` input, output."""
    data = tomllib.loads(Path(path).read_text())
    rows = [(k, float(v["input"]), float(v["output"]), origin) for k, v in data.get("models", {}).items()]
    return spark.createDataFrame(rows, RATES)


def merge_rates(builtin: DataFrame, override: DataFrame) -> DataFrame:
    """Both tables; where both have a model, the override."""
    o = override.select("key", *[F.col(c).alias(f"o_{c}") for c in ("input", "output", "origin")])
    met = builtin.join(o, "key", "full_outer")
    return met.select("key", *[F.coalesce(f"o_{c}", c).alias(c) for c in ("input", "output", "origin")])


def budgets(spark: SparkSession, settings: dict[str, str], operations: tuple[str, ...], mode: str = "hard") -> DataFrame:
    """Budgets named ``<scope>_<window>_<unit>`` (lower case) with a positive number; ``..._mode`` sets hard or soft."""
    rows = []
    for scope, window, unit in itertools.product(("global", *operations), WINDOWS, UNITS):
        key = f"{scope}_{window}_{unit}"
        raw = settings.get(key, "").strip().replace("_", "").replace(",", "").lstrip("$")
        try:
            limit = float(raw)
        except ValueError:
            continue
        own = settings.get(f"{key}_mode", mode).strip().lower()
        if limit > 0:
            rows.append((key, scope, window, unit, limit, own if own in ("hard", "soft") else mode))
    return spark.createDataFrame(rows, "key string, scope string, window string, unit string, limit double, mode string")

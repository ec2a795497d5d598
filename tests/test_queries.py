"""Every registered query of the library against its SQL in DuckDB, on the smallest tables."""

import glob
import os
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
import pytest

from tidewell.plans import registry

DATA = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    for c in df.columns:
        if "datetime" in str(df[c].dtype):
            df = df.assign(**{c: df[c].dt.strftime("%Y-%m-%d")})
    rows = [tuple(None if pd.isna(v) else (round(float(v), 9) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)) for v in r) for r in df.astype(object).itertuples(index=False)]
    return sorted(rows, key=str)


@pytest.fixture(scope="module")
def results(spark, request):
    """The chosen queries, a few at a time, as small ones spend their time in planning."""
    names = [i.callspec.params["name"] for i in request.session.items if i.nodeid.startswith("tests/test_queries.py::test_query[")]
    with ThreadPoolExecutor(6) as pool:
        yield {n: pool.submit(lambda n: registry.QUERIES[n](spark, DATA).toPandas(), n) for n in names}


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(results, engine, name):
    got = results[name].result()
    if name not in registry.ORACLE_SQL:
        return
    want = engine.execute(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_entry_point_lists_every_query(spark):
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_lines_after_the_first_compete(spark, tmp_path):
    rows = [(1, "plain\nthe undoing", "s", "en", 1), (2, "the undoing\n\nthe red 🔴", "s", "en", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.QUERIES["profile_all_lines"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == [("the undoing", 1, 2, 12), ("the red 🔴", 2, 3, 5), ("plain", 1, 1, 0), ("", 2, 2, 0)]


def test_answers_of_jobs_with_long_ids_are_their_own(spark, tmp_path):
    """An id with the digits of a status code in it stood for another job's once ids passed four million."""
    rows = [(2_000_001, "2024-01-01 00:00:00"), (4_040_001, "2024-01-01 00:00:00")]
    spark.createDataFrame(rows, "event_id long, ts string").selectExpr("event_id", "timestamp(ts) AS ts").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    assert plain(registry.QUERIES["job_outcomes"](spark, str(tmp_path)).toPandas()) == plain(con.execute(registry.ORACLE_SQL["job_outcomes"]).df())

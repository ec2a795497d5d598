"""Approximate nearest neighbours by cosine over shifted Hilbert curves.

Unit vectors are projected to ``DIMS`` random directions, once per curve, shifted by a random part
of a cell, and ordered by the Hilbert key of their cell. Spark range-partitions (curve, key), which
gives every vector a rank on every curve. Each curve is cut into blocks of ``BLOCK`` ranks; a query meets the
rows of the blocks that its window of ranks touches, compares itself with those inside the window
in single precision, and keeps the best ``SPARE`` times k. The lists of all curves merge, and the best of them are
reranked by exact cosine of the original vectors.

A task compares one block with the queries of at most ``SPAN`` ranks, however wide the window is.

The window is fitted: for ``SAMPLE`` vectors, queries or not, the true neighbours are found by a scan, and the window is the distance in ranks, on the
nearest curve, that holds ``RECALL`` of them and a standard error more. On data with low inner dimension it stays a few rows at any size; on data
without structure no index of any kind can keep it small, and it grows with the table.

Equal vectors are one entry, which keeps its k + 1 least ids; with a query's own id left out this is enough for
any answer, so copies cost nothing and ties go to the smaller id.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do
vectors of another length than the commonest (the longer on ties); a null id takes no part; a repeated id counts once per
distinct vector; fewer candidates than k give all of them; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, running_totals
from .hilbert import hilbert_key

CURVES = 32
DIMS, BITS = 12, 4
SAMPLE = 200
RECALL = 0.95
BLOCK = 4096
SPAN = 64 * BLOCK
SPARE = 2
SPREAD = 3.2


def usable(vector: Column) -> Column:
    """A vector of finite components, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, width)


def entries(table: DataFrame, is_query: Column, k: int, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(entry, v, ids, asks): one row per distinct usable vector, its k + 1 least ids, and whether a query has it.

    ``entry`` is a row number, to be fixed by a checkpoint.
    Ids are cut to k + 1 per partition before the shuffle and per vector after it; nothing that can
    be among the k nearest is lost.
    """
    rows = table.filter(F.col(vec_id).isNotNull() & usable(F.col(vector)))
    rows = rows.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    if not sizes:
        return rows.limit(0).select(F.col("id").alias("entry"), "v", F.array("id").alias("ids"), "asks")
    width = sizes[0]["n"]

    def least(batches):
        held: dict[bytes, list] = {}

        def out():
            keys = list(held)
            v = pa.array([np.frombuffer(x, np.float64) for x in keys], pa.list_(pa.float64()))
            return pa.RecordBatch.from_arrays([v, pa.array([held[x][0] for x in keys], pa.list_(pa.int64())), pa.array([held[x][1] for x in keys])], names=["v", "ids", "asks"])

        for batch in batches:
            for i, row, asks in zip(batch.column(0).to_pylist(), _matrix(batch.column(1), width) + 0.0, batch.column(2).to_pylist(), strict=True):
                ids, asked = held.get(row.tobytes(), ([], False))
                held[row.tobytes()] = [sorted({*ids, i})[: k + 1], asked or asks]
            if len(held) > 50_000:
                yield out()
                held = {}
        if held:
            yield out()

    part = rows.filter(F.size("v") == width).mapInArrow(least, "v array<double>, ids array<long>, asks boolean")
    merged = part.groupBy("v").agg(F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"), F.bool_or("asks").alias("asks"))
    return merged.select(F.monotonically_increasing_id().alias("entry"), "v", "ids", "asks")


def _scaled(m: np.ndarray) -> np.ndarray:
    """Rows times the power of two that brings their largest component next to one: squares stay in range, and no digit changes."""
    return np.ldexp(m, -np.frexp(np.abs(m).max(axis=1, keepdims=True))[1])


def _normed(m: np.ndarray) -> np.ndarray:
    """Rows at unit length."""
    m = _scaled(m)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _frame(width: int, curve: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([curve, 20_21])
    axes, _ = np.linalg.qr(rng.normal(size=(width, min(DIMS, width))))
    return axes, rng.uniform(0, 1, min(DIMS, width))


def _keyed(found: DataFrame, width: int, curves: int) -> DataFrame:
    """(curve, key, entry) of every entry on every curve."""

    def keys(batches):
        for batch in batches:
            unit = _normed(_matrix(batch.column(1), width))
            entry = batch.column(0)
            for c in range(curves):
                axes, shift = _frame(width, c)
                place = unit @ axes * np.sqrt(width)  # about unit variance where directions are even
                cells = (place + SPREAD) / (2 * SPREAD) * ((1 << BITS) - 1) + shift
                key = hilbert_key(np.clip(cells, 0, (1 << BITS) - 1).astype(np.int64), BITS)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(entry), c, np.int32)), pa.array(key), entry], names=["curve", "key", "entry"])

    return found.select("entry", "v").mapInArrow(keys, "curve int, key long, entry long")


def nearest_by_scan(found: DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """(query, entry, score) of the k nearest other entries of a bounded set of queries (columns entry, v), by a scan of all rows."""
    ask, who = np.stack(queries["v"].to_list()), queries["entry"].to_numpy()
    ask = _normed(ask)

    def scan(batches):
        for batch in batches:
            own = batch.column(0).to_numpy()
            scores = ask @ _normed(_matrix(batch.column(1), ask.shape[1])).T
            scores[who[:, None] == own[None, :]] = -2
            best = np.argpartition(-scores, min(k, len(own) - 1), axis=1)[:, :k]
            at = np.repeat(np.arange(len(who)), best.shape[1])
            columns = who[at], own[best.ravel()], scores[at, best.ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["query", "entry", "score"])

    rows = found.select("entry", "v").mapInArrow(scan, "query long, entry long, score double").filter("score >= -1.5")
    tops = rows.groupBy("query").agg(F.slice(F.sort_array(F.collect_list(F.struct("score", "entry")), asc=False), 1, k).alias("t"))
    return tops.select("query", F.explode("t").alias("t")).select("query", "t.entry", "t.score").toPandas()


def fit_window(ranked: DataFrame, found: DataFrame, k: int) -> int:
    """Distance in ranks, on the nearest curve, that holds ``RECALL`` of the neighbours of ``SAMPLE`` vectors."""
    sample = found.orderBy(F.xxhash64("v")).limit(SAMPLE).select("entry", "v").toPandas()
    if not len(sample):
        return 1
    truth = nearest_by_scan(found, sample, k)
    wanted = found.sparkSession.createDataFrame(pd.DataFrame({"entry": pd.unique(pd.concat([truth["query"], truth["entry"]]))}), "entry long")
    ranks = ranked.join(F.broadcast(wanted), "entry").select("entry", "curve", "rank").toPandas()  # SAMPLE * (k + 1) * curves rows at most
    table = ranks.pivot_table(index="entry", columns="curve", values="rank")
    if not len(truth):
        return 1
    apart = np.abs(table.loc[truth["query"]].to_numpy() - table.loc[truth["entry"]].to_numpy()).min(axis=1)
    error = np.sqrt(RECALL * (1 - RECALL) / truth["query"].nunique())  # a vector's neighbours are not independent
    return max(1, int(np.ceil(np.quantile(apart, min(1.0, RECALL + error)))))


def _unit(column: pa.Array, width: int) -> np.ndarray:
    """Unit vectors in single precision, as they travel to the blocks."""
    return _normed(_matrix(column, width)).astype(np.float32)


def _packed(found: DataFrame, width: int) -> DataFrame:
    """(entry, asks, unit) with the unit vector as bytes."""

    def pack(batches):
        for batch in batches:
            flat = _unit(batch.column(2), width).tobytes()
            unit = pa.array([flat[at : at + 4 * width] for at in range(0, len(flat), 4 * width)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), unit], names=["entry", "asks", "unit"])

    return found.select("entry", "asks", "v").mapInArrow(pack, "entry long, asks boolean, unit binary")


def _best(block: pd.DataFrame, asks: pd.DataFrame, k: int, window: int) -> pd.DataFrame:
    """The k best of a block for each query whose window touches it."""
    stacked = lambda part: np.frombuffer(b"".join(part["unit"]), np.float32).reshape(len(part), -1)
    rows, rank, own = stacked(block), block["rank"].to_numpy(), block["entry"].to_numpy()
    out = []
    for start in range(0, len(asks), 256):
        part = asks.iloc[start : start + 256]
        scores = stacked(part) @ rows.T
        outside = np.abs(part["rank"].to_numpy()[:, None] - rank[None, :]) > window
        scores[outside | (part["entry"].to_numpy()[:, None] == own[None, :])] = -2
        best = np.argpartition(-scores, min(k, len(own) - 1), axis=1)[:, :k]
        at = np.repeat(np.arange(len(part)), best.shape[1])
        out.append(pd.DataFrame({"query": part["entry"].to_numpy()[at], "entry": own[best.ravel()], "score": scores[at, best.ravel()]}))
    found = pd.concat(out)
    return found[found["score"] >= -1.5]


def candidates(found: DataFrame, ranked: DataFrame, window: int, width: int, k: int) -> DataFrame:
    """(query, entry) of the best k of every query among the rows inside its window on any curve, by single precision."""
    block, span = (lambda rank: F.floor(rank / BLOCK).cast("long")), (lambda rank: F.floor(rank / SPAN).cast("long"))
    placed = ranked.join(_packed(found, width), "entry").withColumn("block", block(F.col("rank")))
    low, high = F.greatest(F.col("rank") - window, F.lit(0)), F.col("rank") + window
    asks = placed.filter("asks").withColumn("span", span(F.col("rank"))).withColumn("block", F.explode(F.sequence(block(low), block(high))))
    first, last = F.greatest(F.col("block") * BLOCK - window, F.lit(0)), (F.col("block") + 1) * BLOCK - 1 + window
    rows = placed.withColumn("span", F.explode(F.sequence(span(first), span(last))))
    columns = ["curve", "block", "span", "entry", "rank", "unit"]
    both = rows.select(*columns, F.lit(False).alias("ask")).unionByName(asks.select(*columns, F.lit(True).alias("ask")))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        ask = group["ask"].to_numpy()
        if ask.all() or not ask.any():
            return pd.DataFrame({"query": [], "entry": [], "score": []})
        return _best(group[~ask], group[ask], k, window)

    lists = both.groupBy("curve", "block", "span").applyInPandas(compare, "query long, entry long, score double")
    merged = lists.groupBy("query", "entry").agg(F.max("score").alias("score"))
    tops = merged.groupBy("query").agg(F.slice(F.sort_array(F.collect_list(F.struct("score", "entry")), asc=False), 1, k).alias("t"))
    return tops.select("query", F.explode("t.entry").alias("entry"))


def search(table: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", curves: int = CURVES) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found for every row that ``is_query`` names."""
    found = checkpointed(entries(table, is_query, k, vec_id, vector))
    head = found.select(F.size("v")).head()
    width = head[0] if head else 1
    ranked = running_totals(_keyed(found, width, curves), [F.col("curve"), F.col("key"), F.col("entry")], {"rank": F.lit(1)})
    ranked = checkpointed(ranked.select("curve", "entry", "rank"))
    near = candidates(found, ranked, fit_window(ranked, found, k), width, SPARE * k)
    near = near.unionByName(found.filter("asks").select(F.col("entry").alias("query"), "entry"))
    return _answers(near, found, table, is_query, k, vec_id, vector)


def _answers(near: DataFrame, found: DataFrame, table: DataFrame, is_query: Column, k: int, vec_id: str, vector: str) -> DataFrame:
    """Exact scores of the found entries, spread over the ids that share their vectors, for every query id."""
    each = near.join(found.select("entry", "ids", "v"), "entry")
    own = found.select(F.col("entry").alias("query"), F.col("v").alias("q"))

    def cosine(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            width = len(batch.column(2)[0])
            a, b = _scaled(_matrix(batch.column(2), width)), _scaled(_matrix(batch.column(3), width))
            dot = (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(dot)], names=["query", "ids", "score"])

    scored = each.join(own, "query").select("query", "ids", "v", "q").mapInArrow(cosine, "query long, ids array<long>, score double")
    flat = scored.select("query", F.explode("ids").alias("id"), "score")
    listed = flat.groupBy("query").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("far"), "id"))).alias("t"))
    asks = table.filter(F.col(vec_id).isNotNull() & is_query & usable(F.col(vector)))
    asks = asks.select(F.col(vec_id).cast("long").alias("query_id"), F.transform(F.col(vector).cast("array<double>"), lambda x: x + 0.0).alias("q"))
    rows = asks.distinct().join(own, "q").select("query_id", "query").join(listed, "query")
    kept = F.slice(F.filter("t", lambda x: x["id"] != F.col("query_id")), 1, k)
    return rows.select("query_id", F.posexplode(kept).alias("at", "x")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.far")).alias("score")
    )

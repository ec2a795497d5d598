"""Shared pieces: words, hold-out sets, checkpoints, distributed ranks."""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"


def words_of(text: Column) -> Column:
    """Array of the maximal runs of characters other than the six ASCII spaces; null and blank give []."""
    core = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, SPACE_RUN))


def held_out(doc_id: Column, modulus: int, remainder: int = 2) -> Column:
    """True where crc32 of the id's decimal text leaves ``remainder``; a null id counts as empty text."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % modulus == remainder


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that starts with ``stem`` and that ``df`` does not have (in any case)."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name


def kept_columns(keep: tuple[str, ...], *made: str) -> tuple[str, ...]:
    """``keep`` without columns named like those that an operator adds: these give way to the new ones."""
    taken = {c.lower() for c in made}
    return tuple(c for c in keep if c.lower() not in taken)


def with_fields(rows: DataFrame, n: int, more: str) -> T.StructType:
    """Schema of the first ``n`` columns of ``rows`` and the fields that the DDL text ``more`` names."""
    return T.StructType([*rows.schema.fields[:n], *T.StructType.fromDDL(more).fields])


def kept_with_text(docs: DataFrame, keep: tuple[str, ...], text: str) -> tuple[DataFrame, int]:
    """The columns ``keep`` and the text, and the place of the text among them: a text that is kept travels to Python once, not twice."""
    if text in keep:
        return docs.select(*keep), keep.index(text)
    return docs.select(*keep, F.col(text).alias(free_name(docs, "_text"))), len(keep)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder of ``spark.checkpoint.dir``.

    Where none is set, a local session gets a temporary folder, and a cluster an error, as its executors would not see one.
    """
    spark: SparkSession = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tidewell-checkpoint-"))
    return df.checkpoint(eager=True)


def running_totals(df: DataFrame, order: list[Column], amounts: dict[str, Column], partitions: int | None = None) -> DataFrame:
    """Add, for each name in ``amounts``, the sum of its column over all rows before the row in the order ``order``.

    Rows are range-partitioned, sorted and cut by a checkpoint; one row of sums per partition then
    gives each partition its start, and a running sum over batches adds the rest without another
    shuffle. No task holds more than a batch of its own range. ``order`` must be total, or tied rows
    come in any order. The driver sees one row per partition.
    """
    names = list(amounts)
    part, *sums = (free_name(df, f"_{x}") for x in ("part", *names))
    plus = df.withColumns({c: F.coalesce(amounts[n], F.lit(0)).cast("long") for n, c in zip(names, sums, strict=True)})
    spread = plus.repartitionByRange(partitions, *order) if partitions else plus.repartitionByRange(*order)
    ranged = checkpointed(spread.sortWithinPartitions(*order).withColumn(part, F.spark_partition_id()))
    seen, starts = np.zeros(len(names), np.int64), {}
    for row in sorted(ranged.groupBy(part).agg(*[F.sum(c) for c in sums]).collect(), key=lambda r: r[0]):
        starts[row[0]] = seen.copy()
        seen += np.array(row[1:], np.int64)
    keep = [c for c in df.columns if c not in names]

    def add(batches):
        at = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if at is None:
                at = starts[batch.column(part)[0].as_py()].copy()
            columns = [batch.column(c) for c in keep]
            for i, c in enumerate(sums):
                each = batch.column(c).to_numpy(zero_copy_only=False)
                columns.append(pa.array(at[i] + np.cumsum(each) - each))
                at[i] += each.sum()
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *names])

    schema = T.StructType([*(ranged.schema[c] for c in keep), *(T.StructField(n, T.LongType()) for n in names)])
    return ranged.mapInArrow(add, schema)

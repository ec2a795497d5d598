"""Structured Streaming around the batch operators: the same functions, with checkpoints for cursors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewell.sources.transcripts import READERS


def transcript_stream(spark: SparkSession, path: str) -> DataFrame:
    """Lines of new transcript files as they arrive; the stream's checkpoint is the cursor over files."""
    files = spark.readStream.schema("value string").option("wholetext", True).text(path, wholetext=True)
    each = files.select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\r\n|\n|\r")).alias("_at", "line"))
    return each.select("path", (F.col("_at") + 1).alias("line_no"), "line")


def ingest_messages(lines: DataFrame, source: str, out: str, checkpoint: str) -> StreamingQuery:
    """Write the messages of a stream of lines as Parquet, once for all there is.

    Each batch has a folder named by its id, which a batch that is tried again replaces, so nothing is written twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        READERS[source](batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sync_records(records: DataFrame, out: str, checkpoint: str, rejects: str | None = None) -> StreamingQuery:
    """Append records whose id is new; late and repeated deliveries change nothing.

    Each batch meets the stored ids by an anti join, so no record is dropped for being late, and no
    state grows in the stream. Unverified records go to ``rejects``, each once. Batches write folders of their own, as in
    ``ingest_messages``, and do not compare themselves with their own folder.
    """

    def stored(spark: SparkSession, path: str, number: int, like: DataFrame) -> DataFrame:
        try:
            return spark.read.parquet(path).filter(F.col("batch") != number).select("record_id")
        except AnalysisException as error:  # the first batch has no table yet
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return like.select("record_id").limit(0)

    def write(batch: DataFrame, number: int) -> None:
        spark, rows = batch.sparkSession, batch.dropDuplicates(["record_id"])
        new = rows.join(stored(spark, out, number, rows), "record_id", "left_anti")
        new.filter("verified").write.mode("overwrite").parquet(f"{out}/batch={number}")
        if rejects:
            bad = rows.filter("NOT verified").join(stored(spark, rejects, number, rows), "record_id", "left_anti")
            bad.withColumn("reason", F.lit("unverified")).write.mode("overwrite").parquet(f"{rejects}/batch={number}")

    return records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def session_state(messages: DataFrame) -> DataFrame:
    """Per path the count and the latest timestamp so far, and whether there is enough to observe; kept as state across batches."""
    n = F.count(F.lit(1))
    sums = messages.groupBy("path").agg(n.alias("messages"), F.max("timestamp").alias("last"))
    return sums.withColumn("status", F.when(F.col("messages") >= 5, "ready").otherwise("waiting"))


def usage_windows(calls: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Successful cost per operation and time window, with a watermark."""
    rows = calls.filter("status = 'ok'").withWatermark("ts", late)
    return rows.groupBy(F.window("ts", width), "operation").agg(F.sum("usd").alias("usd"), F.sum("tokens").alias("tokens"))


def compress_batches(transcripts: DataFrame, compress: Callable[[str, str], str], system: str) -> DataFrame:
    """(path, note) of transcripts (path, text) from an injected model, called in the tasks.

    A lost task calls again for its texts, so write the result before using it twice.
    """

    def noted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "note": [compress(system, t) for t in batch["text"]]})

    return transcripts.select("path", "text").mapInPandas(noted, "path string, note string")

"""Batch jobs from their sending to their end, with a guard against inputs that moved meanwhile.

A job's life is a set of events: it is sent with digests of its note's three inputs, polled any number of times, perhaps cancelled. The
first event that ends it counts, by time and then by content, and the later ones change nothing; so ``states`` is one
aggregation, does not depend on the order in which events arrive, takes replays, and runs over tables and streams alike.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tidewell.functions.text import strip

#: The inputs of a job, and how a batch and a job can end.
INPUTS = ("reflections", "observations", "auto_memory")
BATCH_ENDS = ("failed", "expired", "cancelled")
ENDS = ("applied", "drifted", "failed", "expired", "cancelled")


def input_digests(inputs: DataFrame) -> DataFrame:
    """(note, digests) of the inputs (note, kind, text): SHA-256 of each kind, that of the empty text where it is missing or null. Of repeated rows the largest counts."""
    kinds = [F.coalesce(F.max(F.when(F.col("kind") == k, F.sha2(F.coalesce("text", F.lit("")), 256))), F.sha2(F.lit(""), 256)).alias(k) for k in INPUTS]
    return inputs.groupBy("note").agg(*kinds).select("note", F.struct(*INPUTS).alias("digests"))


def _with_digests(rows: DataFrame, inputs: DataFrame) -> DataFrame:
    none = F.struct(*[F.sha2(F.lit(""), 256).alias(k) for k in INPUTS])
    return rows.join(input_digests(inputs), "note", "left").withColumn("digests", F.coalesce("digests", none))


def _event(kind: str, to: Column, error: Column, text: Column) -> list[Column]:
    return ["job_id", "at", F.lit(kind).alias("kind"), to.cast("string").alias("to"), error.cast("string").alias("error"), text.cast("string").alias("text"), "digests"]


def sent(jobs: DataFrame, inputs: DataFrame) -> DataFrame:
    """Events of jobs (job_id, note, at), with the digests of their notes' inputs as they are now."""
    return _with_digests(jobs, inputs).select(*_event("sent", F.lit(None), F.lit(None), F.lit(None)))


def cancelled(requests: DataFrame) -> DataFrame:
    """Events of jobs (job_id, at) that were called off."""
    none = F.struct(*[F.lit(None).cast("string").alias(k) for k in INPUTS])
    return requests.withColumn("digests", none).select(*_event("cancelled", F.lit("cancelled"), F.lit(None), F.lit(None)))


def answers(lines: DataFrame) -> DataFrame:
    """(output_file_id, custom_id, fault, text): the first line (by line_no) of each output file for each id; lines that are no JSON do not count.

    ``fault`` says why the answer has no text: an error, a status other than 200 (none given is fine), no body, or nothing in it.
    """
    v = F.try_parse_json("line")
    get = lambda p, kind="string": F.try_variant_get(v, p, kind)
    kind = lambda p: F.schema_of_variant(get(p, "variant"))
    error, code = get("$.error"), get("$.response.status_code", "int")
    said = ~F.coalesce(error, F.lit("")).isin("", "{}", "[]", "false", "0")
    path = "$.response.body.choices[0].message.content"
    fault = (
        F.when(said, F.concat(F.lit("request failed: "), error)).when(code != 200, F.concat(F.lit("request failed: HTTP "), code.cast("string")))
        .when(~F.coalesce(F.startswith(kind("$.response.body"), F.lit("OBJECT")), F.lit(False)), "no body")
        .when(F.coalesce(kind(path), F.lit("")) != "STRING", "no text").when(strip(get(path)) == "", "no text")
    )
    found = lines.select("output_file_id", "line_no", get("$.custom_id").alias("custom_id"), fault.alias("fault"), get(path).alias("text")).filter("custom_id IS NOT NULL")
    return found.groupBy("output_file_id", "custom_id").agg(F.min(F.struct("line_no", "fault", "text")).alias("a")).select("output_file_id", "custom_id", "a.fault", "a.text", F.lit(True).alias("answered"))


def polled(polls: DataFrame, lines: DataFrame, inputs: DataFrame) -> DataFrame:
    """Events of polls (job_id, note, custom_id, at, batch_status, output_file_id), with the inputs' digests at this time.

    A completed batch ends its job as ``ready`` or, without an answer of use, as failed; one that runs on, or has no status, ends nothing.
    """
    met = _with_digests(polls, inputs).join(answers(lines), ["output_file_id", "custom_id"], "left")
    done = F.col("batch_status") == "completed"
    why = F.when(F.col("output_file_id").isNull(), "no output file").when(F.col("answered").isNull(), "no answer").otherwise(F.col("fault"))
    to = F.when(done & why.isNull(), "ready").when(done, "failed").when(F.col("batch_status").isin(*BATCH_ENDS), F.col("batch_status"))
    error = F.when(done, why).when(to.isNotNull(), F.concat(F.lit("batch "), "batch_status"))
    return met.select(*_event("polled", to, error, F.when(to == "ready", F.col("text"))))


def states(events: DataFrame) -> DataFrame:
    """(job_id, status, error, text, moved, artifact) of each job that was sent: submitted, or as it ended.

    A ready answer is applied if the digests at its arrival are those of the sending; else the job is drifted, ``moved`` names the inputs, and
    the text is for review under ``artifact``. A job's earliest sending counts. Events of unknown jobs give no row.
    """
    start = F.min(F.when(F.col("kind") == "sent", F.struct("at", "digests")))
    end = F.min(F.when(F.col("to").isNotNull(), F.struct("at", "to", "error", "text", "digests")))
    rows = events.groupBy("job_id").agg(start.alias("start"), end.alias("end")).filter("start IS NOT NULL")
    ready = F.coalesce(F.col("end.to") == "ready", F.lit(False))
    other = F.array_compact(F.array(*[F.when(~F.col(f"start.digests.{k}").eqNullSafe(F.col(f"end.digests.{k}")), k) for k in INPUTS]))
    moved = F.when(ready, other).otherwise(F.array().cast("array<string>"))
    status = F.when(ready, F.when(F.size(moved) > 0, "drifted").otherwise("applied")).otherwise(F.coalesce("end.to", F.lit("submitted")))
    artifact = F.when(status == "drifted", F.concat("job_id", F.lit(".result.md")))
    return rows.select("job_id", status.alias("status"), "end.error", "end.text", moved.alias("moved"), artifact.alias("artifact"))


def write_states(events: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Keep the states of a stream of events under ``out``: each batch writes the jobs that it moved into a folder of its own."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return states(events).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored_states(spark: SparkSession, out: str) -> DataFrame:
    """The newest state of each job that ``write_states`` kept; none before its first batch."""
    like = states(spark.createDataFrame([], "job_id string, at timestamp, kind string, to string, error string, text string, digests struct<reflections: string, observations: string, auto_memory: string>"))
    try:
        rows = spark.read.schema(StructType(like.schema.fields).add("batch", "integer")).parquet(out)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return like
    newest = rows.groupBy("job_id").agg(F.max_by(F.struct(*like.columns), "batch").alias("s"))
    return newest.select("s.*")

"""Writes: appends, quarantine, manifests, upserts of small state."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def append_calls(calls: DataFrame, path: str) -> None:
    """Append to the ledger, one folder per day, so that windows prune."""
    calls.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)


def next_records(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """New log rows (node_id, ord, ...) with the sequence numbers after their node's head, and all heads as parents."""
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("node_id").orderBy("ord"))
    met = rows.withColumn("_n", nth).join(heads, "node_id", "left")
    parents = heads.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("node_id", "seq")))).alias("parents"))
    numbered = met.withColumn("node_seq", F.coalesce("seq", F.lit(0)) + F.col("_n")).drop("_n", "seq")
    return numbered.join(F.broadcast(parents))  # one row: a cluster has a bounded number of nodes


def split_rejects(rows: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """Good rows, and rejected ones with their ``reason`` (null for good)."""
    judged = rows.withColumn("reason", reason)
    return judged.filter("reason IS NULL").drop("reason"), judged.filter("reason IS NOT NULL")


def manifest(files: DataFrame) -> DataFrame:
    """(path, bytes, sha256) of files (path, content)."""
    return files.select("path", F.octet_length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify(listed: DataFrame, files: DataFrame) -> DataFrame:
    """What differs between a manifest and files: missing, extra or changed paths; no rows if all is well."""
    found = manifest(files).select("path", F.col("bytes").alias("b"), F.col("sha256").alias("s"))
    met = listed.join(found, "path", "full_outer")
    problem = (
        F.when(F.col("s").isNull(), "missing").when(F.col("sha256").isNull(), "extra").when((F.col("s") != F.col("sha256")) | (F.col("b") != F.col("bytes")), "changed")
    )
    return met.select("path", problem.alias("problem")).filter("problem IS NOT NULL")


def changed_only(new: DataFrame, stored: DataFrame) -> DataFrame:
    """Files (path, content) that are new or differ from the stored ones."""
    old = manifest(stored).select("path", F.col("sha256").alias("_old"))
    met = new.join(old, "path", "left")
    return met.filter(F.col("_old").isNull() | (F.sha2("content", 256) != F.col("_old"))).drop("_old")


def upsert(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``stored`` with the rows of ``new`` in place of those of equal key."""
    return stored.join(new.select(key), key, "left_anti").unionByName(new)


def newest_ids(seen: DataFrame, most: int = 2000) -> DataFrame:
    """The last ``most`` ids (message_id, ord) of a seen-list."""
    return seen.orderBy(F.desc("ord")).limit(most)


def write_postings(postings: DataFrame, path: str, buckets: int = 64) -> None:
    """Postings (doc_id, term, tf, doc_len) as Parquet in folders by a hash of the term, so that a search reads those of its terms."""
    dealt = postings.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)))
    dealt.repartition("bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(path)


def postings_of(stored: DataFrame, terms: list[str], buckets: int = 64) -> DataFrame:
    """The stored postings of some terms; folders of other buckets are not read."""
    asked = stored.sparkSession.range(1).select(F.explode(F.array(*[F.lit(t) for t in terms])).alias("term"))
    folders = [r[0] for r in asked.select(F.pmod(F.xxhash64("term"), F.lit(buckets))).distinct().collect()]  # one number per asked term
    return stored.filter(F.col("bucket").isin(folders) & F.col("term").isin(terms)).drop("bucket")


def sorted_rates(stored: DataFrame, new: DataFrame) -> DataFrame:
    """The override table after an upsert by model, in order of models."""
    return upsert(stored, new, "key").orderBy("key")


def new_folder(spark: SparkSession, stem: str) -> str:
    """The path of a folder not used before, in the shared folder of ``spark.checkpoint.dir``; where none is set, a local session gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(base or tempfile.mkdtemp(prefix='tidewell-')).rstrip('/')}/{stem}-{uuid.uuid4().hex}"


def written(df: DataFrame, stem: str) -> DataFrame:
    """``df`` as a table in a new folder, so that what reads it several times does not plan and run it again."""
    path = new_folder(df.sparkSession, stem)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

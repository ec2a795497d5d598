"""A stored inverted index for BM25: segments of documents in versions, blocks with score bounds, updates by what changed.

A folder holds three tables. ``docs`` (version, segment, doc_id, sha) says what is indexed; ``blocks`` (version, segment, block,
term, n, words, max_tf, min_len, entries) has a row per term and block of documents, sorted by term, so that a search reads the row groups of its
terms; ``manifest`` (version, segment, live) names each segment's live version. A document's segment and block follow from its id. A
manifest is one file and is written last, so a reader sees an update whole or not at all, and a writer that fails leaves the index
as it was. One writer at a time; superseded versions stay for running readers.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.functions.text import search_tokens
from tidewell.operators import search
from tidewell.sources.sinks import written

SCHEMAS = {
    "docs": "doc_id {id}, sha string, version int, segment int",
    "blocks": "block int, term string, n long, words long, max_tf long, min_len int, entries array<struct<doc_id: {id}, tf: long, doc_len: int>>, version int, segment int",
    "manifest": "segment int, live int, n_docs long, words long, mean_raw double, n_segments int, n_blocks int, version int",
}
SEGMENT_CHARS = 1 << 23
MOST_TERMS = 200  # asked terms up to which the scan gets them as a filter; beyond it the join alone finds them


class StoredIndex:
    """An index at ``path`` over documents (doc_id, content); ids are unique and not null, a null text is empty.

    A segment is a task's work and a file, and a block of documents is a row per term. Both numbers are fixed by the first build:
    without ``segments`` it takes one for each ``SEGMENT_CHARS`` characters of text, 16 at least, so that a task's work does not grow with
    the corpus; a stored index is then opened as it was built.
    """

    def __init__(self, spark: SparkSession, path: str, segments: int | None = None, blocks: int = 16, id_type: str = "long"):
        self.spark, self.path, self.segments, self.blocks, self.id_type = spark, path.rstrip("/"), segments, blocks, id_type

    def _stored(self, kind: str) -> DataFrame:
        schema = SCHEMAS[kind].format(id=self.id_type)
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{kind}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _manifest(self) -> list:
        """The newest manifest: a row per segment."""
        rows = self._stored("manifest")
        newest = rows.agg(F.max("version")).first()[0]
        found = [] if newest is None else rows.filter(F.col("version") == newest).collect()  # a row per segment
        if found and self.segments is None:
            self.segments = found[0].n_segments
        if found and (found[0].n_segments, found[0].n_blocks) != (self.segments, self.blocks):
            raise ValueError(f"the index has {found[0].n_segments} segments of {found[0].n_blocks} blocks")
        return found

    def _live(self, kind: str, manifest: list) -> DataFrame:
        alive = F.lit(False)
        for v in sorted({r.live for r in manifest}):
            alive = alive | ((F.col("version") == v) & F.col("segment").isin([r.segment for r in manifest if r.live == v]))
        return self._stored(kind).filter(alive)

    def _segment(self, doc_id: Column) -> Column:
        return F.pmod(F.xxhash64(doc_id), F.lit(self.segments)).cast("int")

    def ready(self) -> bool:
        return any(r.n_docs for r in self._manifest()[:1])

    def changes(self, docs: DataFrame) -> DataFrame:
        """(doc_id, change, repeats): documents that are ``new``, ``changed`` or ``gone`` against the index. Only ids and digests are shuffled."""
        now = docs.select("doc_id", F.sha2(F.coalesce("content", F.lit("")), 256).alias("sha"))
        now = now.groupBy("doc_id").agg(F.min("sha").alias("sha"), F.count(F.lit(1)).alias("repeats"))
        old = self._live("docs", self._manifest()).select("doc_id", F.col("sha").alias("old"))
        change = F.when(F.col("old").isNull(), "new").when(F.col("sha").isNull(), "gone").when((F.col("sha") != F.col("old")) | (F.col("repeats") > 1), "changed")
        return now.join(old, "doc_id", "full_outer").select("doc_id", change.alias("change"), "repeats").filter("change IS NOT NULL")

    def update(self, docs: DataFrame) -> list[int]:
        """Make the index that of ``docs`` and return the segments written: those with a document that is new, changed or gone.

        Repeated or null ids raise a ValueError before anything is written.
        """
        manifest = self._manifest()
        if self.segments is None:
            chars = docs.agg(F.sum(F.length("content"))).first()[0] or 0
            self.segments = max(16, -(-chars // SEGMENT_CHARS))
        by_segment = self.changes(docs).groupBy(self._segment(F.col("doc_id")).alias("segment"))
        bad = F.max((F.col("doc_id").isNull() | (F.coalesce("repeats", F.lit(1)) > 1)).cast("int"))
        touched = by_segment.agg(bad.alias("bad")).collect()  # a row per segment
        if any(r.bad for r in touched):
            raise ValueError("document ids must be unique and not null")
        numbers = sorted(r.segment for r in touched)
        if not numbers and manifest:
            return []
        # Above what a writer that failed may have left behind, which no manifest names.
        version = max(self._stored("docs").agg(F.max("version")).first()[0] or 0, *(r.version for r in manifest[:1]), 0) + 1
        dealt = docs.select("doc_id", F.coalesce("content", F.lit("")).alias("content"), self._segment(F.col("doc_id")).alias("segment"))
        dealt = dealt.filter(F.col("segment").isin(numbers)).withColumn("version", F.lit(version))
        words = search_tokens(F.col("content"))
        rows = dealt.select("doc_id", F.sha2("content", 256).alias("sha"), "version", "segment")
        rows.write.mode("append").partitionBy("version", "segment").parquet(f"{self.path}/docs")
        # One shuffle, of texts (their words as arrays take twice the room), that gives a segment to a task and so one file: the grouping below keeps its partitions.
        block = F.pmod(F.xxhash64("doc_id", F.lit("block")), F.lit(self.blocks)).cast("int")
        spread = dealt.select("segment", block.alias("block"), "doc_id", "content").repartition(len(numbers) or 1, "segment").withColumn("_t", F.array_sort(words))
        # Words are counted in their document, by the places where a new one starts in order; so only distinct words become rows.
        spread = spread.withColumn("_s", F.filter(F.transform("_t", lambda _, i: i), lambda i: (i == 0) | (F.get("_t", i) != F.get("_t", i - 1))))
        until = lambda j: F.coalesce(F.get("_s", j + 1), F.size("_t"))
        terms = F.transform("_s", lambda s, j: F.struct(F.get("_t", s).alias("term"), (until(j) - s).cast("long").alias("tf")))
        made = spread.select("segment", "block", "doc_id", F.size("_t").alias("doc_len"), F.inline(terms))
        made = made.groupBy("segment", "block", "term").agg(
            F.count(F.lit(1)).alias("n"), F.sum("tf").alias("words"), F.max("tf").alias("max_tf"), F.min("doc_len").alias("min_len"), F.collect_list(F.struct("doc_id", "tf", "doc_len")).alias("entries")
        )
        made.withColumn("version", F.lit(version)).sortWithinPartitions("version", "segment", "term").write.mode("append").partitionBy("version", "segment").parquet(f"{self.path}/blocks")
        before = {r.segment: r.live for r in manifest} or dict.fromkeys(range(self.segments), version)
        live = {**before, **dict.fromkeys(numbers, version)}
        self._publish(version, live)
        return numbers

    def _publish(self, version: int, live: dict[int, int]) -> None:
        """Write the manifest with the figures of the live segments, from the index alone."""
        from pyspark.sql import Row

        named = [Row(segment=s, live=v) for s, v in live.items()]
        n_docs = self._live("docs", named).count()
        words = self._live("blocks", named).agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
        counts = self._live("blocks", named).groupBy("term").agg(F.sum("n").alias("n"))
        raw = F.ln((F.lit(n_docs) - F.col("n") + 0.5) / (F.col("n") + 0.5))
        mean = counts.agg(F.avg(raw)).first()[0]
        rows = [(s, v, n_docs, words, mean, self.segments, self.blocks, version) for s, v in sorted(live.items())]
        made = self.spark.createDataFrame(rows, SCHEMAS["manifest"])
        made.coalesce(1).write.mode("append").partitionBy("version").parquet(f"{self.path}/manifest")

    def _worth(self, blocks: DataFrame, queries: DataFrame, manifest: list, epsilon: float) -> tuple[DataFrame, DataFrame]:
        """The blocks of the asked terms, and (query_id, term, times, idf)."""
        asked = queries.select("query_id", F.explode(search_tokens(F.col("query"))).alias("term"))
        asked = asked.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
        terms = [r[0] for r in asked.select("term").distinct().limit(MOST_TERMS + 1).collect()]
        if len(terms) <= MOST_TERMS:
            # Equalities, as a long list of values would reach the scan as one range of them.
            blocks = blocks.filter(reduce(or_, [F.col("term") == t for t in terms], F.lit(False)))
        n_docs, mean = manifest[0].n_docs, manifest[0].mean_raw
        raw = F.ln((F.lit(n_docs) - F.col("n") + 0.5) / (F.col("n") + 0.5))
        counts = blocks.select("term", "n").join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("n"))
        idf = counts.select("term", F.when(raw < 0, F.lit(epsilon) * F.lit(mean)).otherwise(raw).alias("idf"))
        return blocks, written(asked.join(idf, "term"), "worth")

    def kept_blocks(self, queries: DataFrame, limit: int = 10, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> tuple[DataFrame, DataFrame]:
        """(query_id, segment, block, bound, kept) and the blocks' entries that are ``kept``, with the weights of their terms.

        No document of a block scores above the sum of its terms' bounds, as a part rises with tf and falls with the length (k1 >= 0,
        0 <= b <= 1). The ``limit`` blocks of largest bound are scored first; with ``limit`` positive scores among them, blocks bounded
        below the last of these hold no hit and their entries are not read. Without, all blocks are kept.
        """
        manifest = self._manifest()
        blocks, worth = self._worth(self._live("blocks", manifest), queries, manifest, epsilon)
        avg_len = F.lit(manifest[0].words / manifest[0].n_docs)
        part = lambda tf, n: F.col("times") * F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * n / avg_len))
        most = F.sum(F.greatest(part(F.col("max_tf"), F.col("min_len")), F.lit(0.0)))
        met = blocks.select("segment", "block", "term", "max_tf", "min_len").join(worth, "term")
        bounds = written(met.groupBy("query_id", "segment", "block").agg(most.alias("bound")), "bounds")

        def scores(of: DataFrame) -> DataFrame:
            met = blocks.select("segment", "block", "term", "entries").join(worth, "term").join(of.select("query_id", "segment", "block"), ["query_id", "segment", "block"], "left_semi")
            each = met.select("query_id", "times", "idf", F.inline("entries"))
            return each.groupBy("query_id", "doc_id").agg(F.sum(part(F.col("tf"), F.col("doc_len"))).alias("score"), F.sum("tf").cast("double").alias("overlap"))

        order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "segment", "block")
        first = bounds.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= limit)
        best = Window.partitionBy("query_id").orderBy(F.desc("score"))
        top = scores(first).filter("score > 1e-12").withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= limit)
        floor = top.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == limit, F.min("score")).alias("floor"))
        # Scores are ranked to six places, so what rounds to the floor is still read.
        kept = F.coalesce(F.col("bound") >= F.col("floor") - 2e-6, F.lit(True))
        judged = written(bounds.join(floor, "query_id", "left").select("query_id", "segment", "block", "bound", kept.alias("kept")), "kept")
        return judged, scores(judged.filter("kept"))

    def search(self, queries: DataFrame, limit: int = 10, **settings: float) -> DataFrame:
        """The hits that ``search.bm25`` gives for the indexed documents; no text is read. An index without documents has none."""
        if not self.ready():
            return queries.limit(0).select("query_id", F.lit(0).alias("rank"), F.lit(None).cast(self.id_type).alias("doc_id"), F.lit(0.0).alias("score"))
        return search.ranked(self.kept_blocks(queries, limit, **settings)[1], limit)


class Stored:
    """A search back end on an index in a folder, built by the first search that finds none."""

    def __init__(self, docs: DataFrame, path: str, **shape: int):
        self.docs, self.index = docs, StoredIndex(docs.sparkSession, path, **shape)

    def search(self, queries: DataFrame, limit: int = 10, **settings: float) -> DataFrame:
        if not self.index.ready():
            self.index.update(self.docs)
        return self.index.search(queries, limit, **settings)

"""Keyword retrieval: postings, BM25, overlap fallback, hit shaping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.text import search_tokens, snippet, strip
from tidewell.sources.sinks import written


def postings(docs: DataFrame, doc_id: str = "doc_id", text: str = "content", only: DataFrame | None = None) -> DataFrame:
    """(doc_id, term, tf, doc_len): counted before any shuffle by term. Of the terms ``only`` (term), if given: others are left out where they are read."""
    tokens = docs.select(F.col(doc_id).alias("doc_id"), search_tokens(F.coalesce(F.col(text), F.lit(""))).alias("_t"))
    each = tokens.select("doc_id", F.size("_t").alias("doc_len"), F.explode("_t").alias("term"))
    if only is not None:
        each = each.join(F.broadcast(only.select("term").distinct()), "term", "left_semi")  # the words of the queries
    return each.groupBy("doc_id", "doc_len", "term").agg(F.count(F.lit(1)).alias("tf"))


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "content") -> DataFrame:
    """(term, n, words): documents with each term; the empty term stands for all documents, with all their words.

    One pass over the texts; counts are merged before the shuffle by term.
    """
    tokens = docs.select(search_tokens(F.coalesce(F.col(text), F.lit(""))).alias("_t"))
    each = tokens.select(F.size("_t").alias("_n"), F.explode(F.concat(F.array(F.lit("")), F.array_distinct("_t"))).alias("term"))
    return each.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.sum("_n").alias("words"))


def corpus_stats(terms: DataFrame) -> DataFrame:
    """One row: number of documents and their average length, from the vocabulary."""
    return terms.filter("term = ''").select(F.col("n").alias("n_docs"), (F.col("words") / F.col("n")).alias("avg_len"))


def inverse_frequency(terms: DataFrame, epsilon: float = 0.25) -> DataFrame:
    """(term, idf): ln((N - n + .5) / (n + .5)); negative ones become ``epsilon`` times the mean over the vocabulary."""
    known = terms.filter("term <> ''").join(F.broadcast(corpus_stats(terms)))  # one row
    raw = known.select("term", F.ln((F.col("n_docs") - F.col("n") + 0.5) / (F.col("n") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.join(F.broadcast(mean)).select("term", F.when(F.col("raw") < 0, F.lit(epsilon) * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def bm25(docs: DataFrame, queries: DataFrame, limit: int = 10, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """(query_id, rank, doc_id, score) of the best documents for each query (query_id, query).

    Terms of a query count as often as they occur in it. Only positive scores rank; a query without
    any ranks documents by the number of their words that it has. Ties go to the smaller doc_id.
    Texts are read twice: once for the vocabulary, which is stored as its figures are asked for several times, and once for the
    postings of the asked terms; other words are not shuffled. Every partition keeps its best ``limit`` of a query before the last shuffle.
    """
    terms = written(vocabulary(docs), "terms")
    asked = queries.select("query_id", F.explode(search_tokens(F.col("query"))).alias("term"))
    asked = asked.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    worth = inverse_frequency(terms, epsilon).join(F.broadcast(asked), "term").join(F.broadcast(corpus_stats(terms)))
    hits = postings(docs, only=asked).join(F.broadcast(worth), "term")
    norm = F.col("tf") + k1 * (1 - b + b * F.col("doc_len") / F.col("avg_len"))
    part = F.col("times") * F.col("idf") * F.col("tf") * (k1 + 1) / norm
    scored = hits.groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"), F.sum("tf").cast("double").alias("overlap"))
    return ranked(scored, limit)


def ranked(scored: DataFrame, limit: int) -> DataFrame:
    """(query_id, rank, doc_id, score): the best of scored documents (query_id, doc_id, score, overlap), by overlap where no score is positive."""
    good = F.col("score") > 1e-12
    rows = scored.select("query_id", "doc_id", good.alias("good"), F.when(good, F.col("score")).otherwise(F.col("overlap")).alias("score")).filter("score > 1e-12")
    # Positive scores come first, so the best rows tell whether there are any: no look at all of a query's documents is needed.
    order = Window.partitionBy("query_id").orderBy(F.desc("good"), F.desc("score"), "doc_id")
    best = rows.withColumn("score", F.round("score", 6)).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    found = F.max("good").over(Window.partitionBy("query_id"))
    return best.withColumn("found", found).filter("good OR NOT found").select("query_id", "rank", "doc_id", "score")


def overlap(docs: DataFrame, query: str, doc_id: str = "doc_id", text: str = "content") -> DataFrame:
    """(doc_id, overlap): occurrences in the document of words that the query has; documents without any are left out."""
    words = search_tokens(F.lit(query))
    n = F.size(F.filter(search_tokens(F.coalesce(F.col(text), F.lit(""))), lambda w: F.array_contains(words, w)))
    return docs.select(F.col(doc_id).alias("doc_id"), n.cast("long").alias("overlap")).filter("overlap > 0")


def first_hits(hits: DataFrame) -> DataFrame:
    """Hits of a query without later ones of a document; hits without a document id all stay."""
    blank = F.coalesce(F.col("doc_id").cast("string"), F.lit("")) == ""
    # The first hit by an aggregate, which merges a common document's hits before the shuffle.
    first = hits.filter(~blank).groupBy("query_id", "doc_id").agg(F.min_by(F.struct(*hits.columns), "rank").alias("hit")).select("hit.*")
    return hits.filter(blank).unionByName(first)


def hit_payload(hits: DataFrame, docs: DataFrame, most: int = 500) -> DataFrame:
    """Hits with the start of their stripped content and a snippet. Texts of other documents are neither cut nor shuffled."""
    hits = written(hits, "hits")
    docs = docs.join(F.broadcast(hits.select("doc_id").distinct()), "doc_id", "left_semi")  # a query's hits are few
    text = docs.select("doc_id", F.substring(strip(F.col("content")), 1, most).alias("content"), snippet(F.col("content")).alias("snippet"))
    return hits.join(text, "doc_id", "left")


def recall_status(hits: DataFrame, ready: Column) -> DataFrame:
    """One row: UNAVAILABLE without an index, EMPTY without hits, else OK."""
    n = F.count(F.lit(1))
    return hits.agg(F.when(~ready, "UNAVAILABLE").when(n == 0, "EMPTY").otherwise("OK").alias("status"), n.alias("hits"))


def matching_lines(docs: DataFrame, needle: str, most: int = 200) -> DataFrame:
    """(doc_id, line_no, line) of the lines that hold the needle in any case."""
    lines = docs.select("doc_id", F.posexplode(F.split("content", "\n")).alias("line_no", "line"))
    hit = F.contains(F.lower("line"), F.lit(needle.lower()))
    return lines.filter(hit).select("doc_id", (F.col("line_no") + 1).alias("line_no"), F.substring(strip(F.col("line")), 1, most).alias("line"))


def named_hits(hits: DataFrame, listed: DataFrame) -> DataFrame:
    """Hits (file, rank) with the document id of their file in the manifest (file, doc_id), else of the file that differs in case only."""
    low = listed.groupBy(F.lower("file").alias("_low")).agg(F.min("doc_id").alias("_any"))
    met = hits.join(listed, "file", "left").join(low, F.lower("file") == F.col("_low"), "left")
    return met.select("file", "rank", F.coalesce("doc_id", "_any").alias("doc_id"))


class Bm25:
    """A search back end: ``search`` gives ranked hits of queries (query_id, query)."""

    def __init__(self, docs: DataFrame, **settings: float):
        self.docs, self.settings = docs, settings

    def search(self, queries: DataFrame, limit: int = 10) -> DataFrame:
        return bm25(self.docs, queries, limit, **self.settings)


class Nothing:
    """A back end without an index: no hits."""

    def __init__(self, docs: DataFrame | None = None):
        del docs

    def search(self, queries: DataFrame, limit: int = 10) -> DataFrame:
        return queries.limit(0).select("query_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0.0).alias("score"))


BACKENDS = {"bm25": Bm25, "none": Nothing}


def backend(name: str, docs: DataFrame):
    if name not in BACKENDS:
        raise ValueError(f"no search back end {name}")
    return BACKENDS[name](docs)

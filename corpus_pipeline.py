"""Corpus pipeline: language ID, line dedup, near-duplicate removal, mixing to target weights, piece encoding.

Each stage takes (spark, docs, sf_dir) and returns a table; all but the last return the columns of
``documents``, and other columns of its input are dropped, whatever their names. No stage needs unique ids. An empty table gives an empty table. ``ORACLE_SQL`` is None: hyperdimensional cosines, XXH64 fingerprints and piece merges are not SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import langid, lines, mixing, pieces, simhash
from tidewell.llm.common import free_name, held_out

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; a missing ``lang`` is filled with the prediction.

    Rejected are texts without a letter, null and empty ones among them, and texts whose trigrams resemble no learned language.
    Languages are learned from the rows with a text and a language outside the hold-out. Ties go to the language of the smaller
    name; repeated rows are judged row by row; a text of any length is read whole.
    """
    prototypes = langid.fit(docs.filter(~held_out(F.col("doc_id"), 4)))
    found = langid.predict(docs.select(*COLUMNS), prototypes, keep=COLUMNS)
    kept = found.filter(langid.accepted(F.col("lang_pred"), F.col("score"), F.col("text")))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that spread over many sources; ``n_chars`` follows the text.

    Of documents made up of such lines, only copies stay whole, for the next stage to decide on. A null text stays null; a
    null source is no source; repeated rows are cleaned row by row; ``n_chars`` of an uncut row stays as it came.
    """
    clean = lines.drop_boilerplate(docs.select(*COLUMNS), only_copies=True)
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", n_chars).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of least id.

    Of several texts of that id, the one of least fingerprint and hash stays; of equal rows, one. Null and blank texts are one
    group. Rows without an id stay, once per text.
    """
    return simhash.one_per_component(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per pass of the mix over a document, range-sorted by training position.

    Documents of full sources come up to three times, those of sources above their share come in
    part: a pass over less than half of a document is left out, another counts as whole. Texts without
    words are never taken; a null source is a source of its own; repeated rows share what the mix takes.
    """
    docs = docs.select(*COLUMNS)
    key, place = free_name(docs, "_key"), free_name(docs, "_place")
    order = mixing.training_order(mixing.mix(docs), whole_parts=True)
    order = order.select(F.col("key").alias(key), F.col("position").alias(place))
    keyed = docs.withColumn(key, mixing.unit_key(F.col("doc_id"), F.col("source"), F.col("text")))
    rows = keyed.join(order, key)
    return rows.repartitionByRange(place, key).sortWithinPartitions(place, key).select(*COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every row, and whether they decode to its text; a null text has begin and end only."""
    coded = pieces.encode_documents(docs, pieces.model_bytes(), keep=("doc_id", "lang", "source", "text"))
    ids = F.octet_length("ids")
    return coded.select(
        "doc_id",
        "lang",
        "source",
        (ids / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        (F.col("decoded") == F.translate(F.coalesce("text", F.lit("")), pieces.SPACE, " ")).alias("round_trip"),
    )


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_boilerplate_lines),
    ("near_dedup", drop_near_duplicates),
    ("source_mix", mix_sources),
    ("piece_codes", encode_pieces),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs

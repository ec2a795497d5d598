"""Line dedup by distinct-site spread.

A HyperLogLog sketch of the sites on each line hash is merged by aggregation. Lines whose estimate
lies near the threshold get exact distinct counts. Lines that occur on ``min_sites`` sites or more
are boilerplate and leave every document, unless that would take more than ``max_share`` of the
document. With ``only_copies`` such a document stays whole only if it is shown to be a copy, as the same set of lines stands on
two sites or more (near-duplicate removal decides on it); all others lose their widespread lines, at worst all of their text.

Defined results: a null text stays null and has no lines; blank lines are neither counted nor
removed; a null site is no site; lines are compared without surrounding ASCII spaces; repeated
rows and ids are cleaned row by row, as the outcome depends on the text alone; an empty table
gives an empty table; columns ``n_lines``, ``n_spread`` and ``n_removed`` of the input are replaced.
Texts and lines are told apart by their MD5, so one text's spots cannot cut another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACES, checkpointed, free_name

LG_K = 12
SALTS = 32


def _core(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACES))


def _digest(text: Column) -> Column:
    """16 bytes."""
    return F.unhex(F.md5(text))


def _row_salt(docs: DataFrame, text: str) -> Column:
    """A salt from a row's plain columns but the text, so that copies of one text spread over tasks (the same on a rerun)."""
    plain = [f.name for f in docs.schema if f.name != text and isinstance(f.dataType, T.AtomicType)]
    return F.pmod(F.hash(*[F.col(f"`{c}`") for c in plain]) if plain else F.lit(0), F.lit(SALTS))


def _lines(docs: DataFrame, text: str, site: str) -> DataFrame:
    """(key of the text, line position, line hash, site, salt of the row) of every line that is not blank: the one pass over all lines."""
    # One row per document before the explode, or the digest of the whole text would be taken once per line.
    each = docs.filter(F.col(text).isNotNull()).select(
        _digest(F.col(text)).alias("_key"), F.col(site).alias("_site"), _row_salt(docs, text).alias("_salt"), F.split(F.col(text), "\n").alias("_all")
    )
    parts = each.select("_key", "_site", "_salt", F.posexplode("_all").alias("_pos", "_line"))
    cores = parts.withColumn("_line", _core(F.col("_line"))).filter("_line != ''")
    return checkpointed(cores.select("_key", "_pos", _digest(F.col("_line")).alias("_h"), "_site", "_salt"))


def _salted(df: DataFrame, salt: str) -> DataFrame:
    """``df`` once for each of ``SALTS`` salts: the side that a hot key's rows, dealt over the salts, meet."""
    return df.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def widespread_lines(lines: DataFrame, min_sites: int, slack: float = 0.1) -> DataFrame:
    """Hashes of lines on ``min_sites`` sites or more: by the sketch where it is clear, else by an exact count.

    ``slack`` is six times the sketch's relative error, one site at least.
    """
    sketched = lines.groupBy("_h").agg(F.hll_sketch_estimate(F.hll_sketch_agg("_site", F.lit(LG_K))).alias("_est"))
    margin = max(1.0, slack * min_sites)
    spread = checkpointed(sketched.filter(F.col("_est") >= min_sites - margin))
    clear = spread.filter(F.col("_est") > min_sites + margin).select("_h")
    near = spread.filter(F.col("_est") <= min_sites + margin).select("_h")
    pairs = lines.filter(F.col("_site").isNotNull()).select("_h", "_site").distinct()
    exact = pairs.join(near, "_h", "left_semi").groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_sites).select("_h")
    return checkpointed(clear.unionAll(exact))


def copied_texts(docs: DataFrame, text: str, site: str) -> DataFrame:
    """Keys of the texts whose set of lines that are not blank stands on two sites or more."""
    cores = F.filter(F.transform(F.split(F.col(text), "\n"), _core), lambda x: x != "")
    sets = docs.filter(F.col(text).isNotNull() & F.col(site).isNotNull()).select(
        _digest(F.col(text)).alias("_key"), _digest(F.array_join(F.array_sort(F.array_distinct(cores)), "\n")).alias("_set"), F.col(site).alias("_site")
    )
    each = sets.groupBy("_set", "_key").agg(F.min("_site").alias("_lo"), F.max("_site").alias("_hi"))
    each = checkpointed(each)
    several = each.groupBy("_set").agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi")).filter("_lo < _hi")
    return each.join(several, "_set", "left_semi").select("_key").distinct()


def drop_boilerplate(
    docs: DataFrame, text: str = "text", site: str = "source", min_sites: int = 5, max_share: float = 0.5, only_copies: bool = False
) -> DataFrame:
    """``docs`` with ``text`` cleaned, and the columns ``n_lines``, ``n_spread`` and ``n_removed`` (replaced if present).

    A document that was left uncut has widespread lines (``n_spread``) and none removed.
    """
    lines = _lines(docs, text, site)
    spread = widespread_lines(lines, min_sites)
    docs = docs.drop("n_lines", "n_spread", "n_removed")
    key, salt, spots, kept = (free_name(docs, x) for x in ("_text_key", "_row_salt", "_spots", "_kept"))
    # A line may stand in a third of all rows, so its rows are dealt over SALTS keys, and its hash with them.
    marked = lines.select("_key", "_pos", "_h", "_salt").join(_salted(spread, "_salt"), ["_h", "_salt"], "left_semi")
    marked = marked.groupBy(F.col("_key").alias(key)).agg(F.sort_array(F.collect_set("_pos")).alias(spots))
    copy = free_name(docs, "_copy")
    if only_copies:
        copies = copied_texts(docs, text, site).select(F.col("_key").alias(key), F.lit(True).alias(copy))
        marked = marked.join(copies, key, "left")
    else:
        marked = marked.withColumn(copy, F.lit(True))
    dealt = docs.withColumns({key: _digest(F.col(text)), salt: _row_salt(docs, text)})
    joined = dealt.join(_salted(marked, salt), [key, salt], "left")
    split = F.split(F.col(text), "\n")
    n_spots, end = F.size(spots), F.size(split)
    # ``ls`` is a lambda's variable, so the text is split once; the work is linear in its lines.
    rest = F.array_except(F.sequence(F.lit(0), end - 1), spots)
    left = F.get(F.transform(F.array(split), lambda ls: F.array_join(F.transform(rest, lambda at: F.get(ls, at)), "\n")), 0)
    joined = joined.withColumn(kept, F.when(F.col(spots).isNotNull(), left))
    enough = F.length(kept) >= (1 - max_share) * F.length(text)
    cut = F.col(kept).isNotNull() & (enough | F.col(copy).isNull())
    out = joined.withColumn("n_lines", F.when(F.col(text).isNull(), 0).otherwise(end).cast("long"))
    out = out.withColumn("n_spread", F.when(F.col(spots).isNotNull(), n_spots).otherwise(0).cast("long"))
    out = out.withColumn("n_removed", F.when(cut, n_spots).otherwise(0).cast("long"))
    return out.withColumn(text, F.when(cut, F.col(kept)).otherwise(F.col(text))).drop(key, salt, spots, kept, copy)

"""Quality rules as a bitmask ledger [native].

Every rule is evaluated once per document. The ledger stores the measurements and one long whose
bit k says that rule k failed. Policies are versioned masks over those bits: applying or ablating
one reads the stored bits only, never the texts.

Defined results: a null or blank text has no words and fails ``few_words``; repeated rows and
repeated ids are judged row by row; an empty table gives an empty ledger; of ``keep``, columns named like one of
the ledger's own give way to it, all others are kept whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, kept_columns, words_of

SYMBOLS = "[#*$%&|<>]"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_bangs", "has_letter")


@dataclass(frozen=True)
class Rule:
    """A failing condition over the measurement columns; ``bit`` never changes once published."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbol_heavy", "10 * n_symbols > 2 * n_words"),
    Rule(3, "odd_word_length", "word_chars > 25 * n_words OR word_chars < 2 * n_words"),
    Rule(4, "repeated_lines", "100 * n_dup_lines > 30 * n_lines AND n_lines >= 4"),
    Rule(5, "bang_heavy", "10 * n_bangs > 3 * n_words"),
    Rule(6, "no_letters", "NOT has_letter"),
)

#: Policies by version: the rules that remove a document.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": tuple(r.name for r in RULES),
}


def mask_of(policy: str) -> int:
    return sum(1 << r.bit for r in RULES if r.name in POLICIES[policy])


def _repeat_words(starts: Column) -> Column:
    """Words under at least one repeated window, from the sorted start positions of such windows."""
    reach = F.transform(starts, lambda at, k: F.least(F.lit(3), F.coalesce(F.get(starts, k + 1) - at, F.lit(3))))
    return F.coalesce(F.aggregate(reach, F.lit(0).cast("long"), lambda total, x: total + x), F.lit(0)).cast("long")


def _twins(sorted_pairs: str) -> Column:
    """Entries of a sorted array<struct<g, i>> whose ``g`` equals that of an entry beside them."""

    def equal(k: Column, e: Column) -> Column:
        return F.coalesce(F.get(sorted_pairs, k)["g"] == e["g"], F.lit(False))

    return F.filter(sorted_pairs, lambda e, k: equal(k - 1, e) | equal(k + 1, e))


def ledger(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per input row: ``keep``, the measurements, ``failed_bits``.

    Windows of three words are compared as strings wherever their hashes repeat, so counts are exact. Work per row is
    n log n in its own words; there is no shuffle.
    """
    keep = kept_columns(keep, *MEASURES, "failed_bits")
    # Kept columns travel in a struct, where no name of theirs can clash.
    nothing = F.lit(None).cast("byte").alias(free_name(docs, "_none"))
    base = docs.select(F.struct(*[F.col(c) for c in keep], nothing).alias("_kept"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    split = base.withColumn("_w", words_of(F.col("_t")))
    width = F.size("_w")
    windows = F.when(width >= 3, F.sequence(F.lit(0), width - 3)).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(windows, lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)))
    lines = F.filter(F.split("_t", "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\x0c\r")) != "")
    staged = split.withColumn("_h", hashes).withColumn("_l", lines)
    # A text whose window hashes all differ repeats no window. In the others, windows that share
    # their hash with a neighbour in hash order are compared as strings.
    by_hash = F.when(
        F.size(F.array_distinct("_h")) < F.size("_h"),
        F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("g"), i.alias("i")))),
    )
    staged = staged.withColumn("_o", by_hash).withColumn("_c", _twins("_o")).drop("_h", "_o")
    by_text = F.sort_array(
        F.transform(
            "_c",
            lambda e: F.struct(
                F.concat_ws(" ", F.get("_w", e["i"]), F.get("_w", e["i"] + 1), F.get("_w", e["i"] + 2)).alias("g"),
                e["i"].alias("i"),
            ),
        )
    )
    staged = staged.withColumn("_s", by_text)
    staged = staged.withColumn("_p", F.sort_array(F.transform(_twins("_s"), lambda e: e["i"])))
    measured = staged.select(
        "_kept",
        width.cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("_p")).alias("n_repeat_words"),
        F.regexp_count("_t", F.lit("!")).cast("long").alias("n_bangs"),
        F.col("_t").rlike("\\p{L}").alias("has_letter"),
    )
    bits = F.lit(0).cast("long")
    for rule in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("long"))
    return measured.select(*[F.col(f"_kept.`{c}`").alias(c) for c in keep], *MEASURES, bits.alias("failed_bits"))


def apply_policy(entries: DataFrame, policy: str = "v1", into: str = "kept") -> DataFrame:
    """Add ``into``: no rule of the policy failed. Reads the stored bits only."""
    return entries.withColumn(into, F.col("failed_bits").bitwiseAND(F.lit(mask_of(policy))) == 0)


def sole_rule(policy: str = "v1") -> Column:
    """The rule that alone removes a row under the policy, null if none or several do: without it the row would be kept."""
    hit = F.col("failed_bits").bitwiseAND(F.lit(mask_of(policy)))
    return F.coalesce(*[F.when(hit == F.lit(1 << r.bit), r.name) for r in RULES if r.name in POLICIES[policy]])


def ablation(entries: DataFrame, policy: str = "v1") -> DataFrame:
    """Per rule of the policy: rows failing it, rows failing it alone, and rows kept without it.

    One aggregation over the bits; each rule is a pair of conditional counts.
    """
    mask = mask_of(policy)
    hit = F.col("failed_bits").bitwiseAND(F.lit(mask))
    rules = [r for r in RULES if r.name in POLICIES[policy]]
    counts = [F.count(F.lit(1)).alias("rows"), F.count_if(hit == 0).alias("kept")]
    for r in rules:
        counts += [
            F.count_if(hit.bitwiseAND(F.lit(1 << r.bit)) != 0).alias(f"fails_{r.name}"),
            F.count_if(hit == F.lit(1 << r.bit)).alias(f"alone_{r.name}"),
        ]
    wide = entries.agg(*counts)
    each = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(r.name).alias("rule"),
                    F.col(f"fails_{r.name}").alias("n_failed"),
                    F.col(f"alone_{r.name}").alias("n_failed_alone"),
                    (F.col("kept") + F.col(f"alone_{r.name}")).alias("n_kept_without"),
                )
                for r in rules
            ]
        )
    )
    return wide.select("rows", "kept", each.alias("r")).select("rows", "kept", "r.*")

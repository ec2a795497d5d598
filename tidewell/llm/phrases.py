"""Phrase collocations by contiguous pattern growth (PrefixSpan over runs of words).

Texts are cut into pieces and words, and frequent words counted. A pair of words that may be frequent is a prefix: each of its
occurrences is a pointer, kept with the words to its right in the piece, up to ``longest`` in all or the first one that makes no such
pair; pointers with the same words to their right travel as one row and a count. One task per prefix gets its pointers sorted by
these words, so that those which share an extension are a run of rows: growth to the right keeps the runs of enough pointers and looks into
those only, depth first.

Growth goes through a sorted stream batch by batch; what a run has in two batches is added up after it. A prefix of more than
1/``PARTS`` of all words (there are fewer than ``PARTS``) is dealt over several tasks by the next word, and its support added up likewise.
Which words and pairs may be frequent is told by one bit per hash (``BITS`` in all), for pairs from counts per hash of 40 bits:
these never call a frequent word or pair rare, and what they let through is counted exactly.

Cohesion of a phrase is a * a / (l * r) for its weakest cut in two, computed in decimals of 38 digits.

Defined results: a null text has no words; a null language is ``und``; repeated rows count as often as they occur; ties go by count,
then by the phrase's bytes; a text of any length is read whole; an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

UNKNOWN = "und"
PARTS = 1024
BITS = 1 << 26
TOGETHER = 1 << 23
ROWS = 50_000
SPACE, BREAK = 1, 2
LOW_BITS = 28
LOW = (1 << LOW_BITS) - 1
#: Bytes with A-Z lower-cased, and what each is: 0 in a word, a space, or the end of a piece.
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_KIND = np.zeros(256, np.uint8)
_KIND[[9, 32]] = SPACE
_KIND[[*b".,;:!?", *range(10, 14)]] = BREAK


def tokens(texts: list[str]) -> tuple[np.ndarray, pa.Array]:
    """Codes of all words in order, with -1 between pieces, and the array of distinct words that codes point into."""
    flat = np.frombuffer(b"\n".join(t.encode("utf-8", "surrogatepass") for t in texts), np.uint8)
    kind = _KIND[flat]
    word = kind == 0
    edge = np.concatenate(([0], np.nonzero(word[1:] != word[:-1])[0] + 1, [len(flat)])) if len(flat) else np.zeros(1, np.int64)
    if len(edge) < 2:
        return np.empty(0, np.int64), pa.array([], pa.large_string())
    # Stretches of word bytes and of other bytes take turns, so they are one array of strings without a copy.
    strings = pa.LargeStringArray.from_buffers(len(edge) - 1, pa.py_buffer(edge.astype(np.int64)), pa.py_buffer(_LOWER[flat]))
    first = 0 if word[0] else 1
    own = strings.take(pa.array(np.arange(first, len(strings), 2)))
    coded = own.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    if not len(codes):
        return codes, coded.dictionary
    after = np.unique(np.searchsorted(edge[first + 1 :: 2], np.nonzero(kind == BREAK)[0], side="right"))  # words that a break comes after
    return np.insert(codes, after[(after > 0) & (after < len(codes))], -1), coded.dictionary


def _slices(batches):
    """(language, texts) of about ``TOGETHER`` characters at most, or one longer text, from batches of (language, text)."""
    for batch in batches:
        by = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            by.setdefault(lang, []).append(text)
        for lang, texts in by.items():
            held, size = [], 0
            for t in texts:
                if held and size + len(t) > TOGETHER:
                    yield lang, held
                    held, size = [], 0
                held.append(t)
                size += len(t)
            yield lang, held


def _batches(columns: list, names: list[str]):
    """Record batches of ``ROWS`` rows at most."""
    whole = pa.RecordBatch.from_arrays(columns, names=names)
    for at in range(0, whole.num_rows, ROWS):
        yield whole.slice(at, ROWS)


def _rows(docs: DataFrame, text: str, lang: Column) -> DataFrame:
    return docs.select(F.coalesce(lang.cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text).alias("text")).filter("text IS NOT NULL")


def word_counts(docs: DataFrame, text: str = "text", lang: Column | None = None) -> DataFrame:
    """(lang, phrase, a): occurrences of every word in each language, and those of all words together as the phrase ''."""

    def counted(batches):
        for name, texts in _slices(batches):
            codes, words = tokens(texts)
            if len(words):
                n = np.bincount(codes[codes >= 0], minlength=len(words))
                listed = pa.concat_arrays([words.cast(pa.string()), pa.array([""])])
                yield from _batches([pa.array([name] * len(listed)), listed, pa.array(np.append(n, n.sum()))], ["lang", "phrase", "a"])

    rows = _rows(docs, text, F.col("lang") if lang is None else lang)
    return rows.mapInArrow(counted, "lang string, phrase string, a long").groupBy("lang", "phrase").agg(F.sum("a").alias("a"))


def _word_hashes(lang: str, words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(f"{lang} {w}".encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))


def _pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """40 bits for each pair of words, from the words' hashes."""
    return (((first ^ first >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) + second) >> np.uint64(24)).astype(np.int64)


class Filter:
    """One bit per hash: clear bits are of words or pairs that are not frequent."""

    def __init__(self, keys: DataFrame, bits: int):
        """Of the non-negative longs ``key``. Spark packs the bits, so the driver gets ``bits`` / 64 longs at most."""
        spot = F.col("key") % bits
        cells = keys.groupBy(F.floor(spot / 64).alias("cell")).agg(F.expr(f"bit_or(shiftleft(1L, CAST(key % {bits} % 64 AS INT)))").alias("bits")).toArrow()
        self.cells, self.bits = np.zeros(-(-bits // 64), np.int64), bits
        self.cells[cells.column("cell").to_numpy()] = cells.column("bits").to_numpy()

    def has(self, keys: np.ndarray) -> np.ndarray:
        spots = keys % self.bits
        return (self.cells[spots >> 6] >> (spots & 63)) & 1 > 0


def _word_keys(words: DataFrame) -> DataFrame:
    """key: 63 bits for each (lang, phrase), as ``_coded`` looks them up."""

    def hashed(batches):
        for batch in batches:
            keys = [int(_word_hashes(x, [w])[0]) >> 1 for x, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64())], names=["key"])

    return words.select("lang", "phrase").mapInArrow(hashed, "key long")


def _coded(batches, known: Filter):
    """(language, codes, words, hashes) of each slice of texts; words that cannot be frequent have code -1."""
    for lang, texts in _slices(batches):
        codes, words = tokens(texts)
        hashes = _word_hashes(lang, words.to_pylist())
        may = np.append(known.has((hashes >> np.uint64(1)).astype(np.int64)), False)  # the last one stands for the end of a piece
        yield lang, np.where(may[codes], codes, -1), words, hashes


def _joined(words: pa.Array, columns: list[np.ndarray]) -> pa.Array:
    each = [words.take(pa.array(c)).cast(pa.string()) for c in columns]
    return pc.binary_join_element_wise(*each, " ") if len(each) > 1 else each[0]


def _packed(keys: np.ndarray, n: np.ndarray) -> bytes:
    """Ascending keys of one range, as steps, and their counts: all lowest bytes first, so that the higher ones, nearly all zero, lie together."""
    both = np.concatenate((np.diff(keys & LOW, prepend=0), n)).astype("<u4")
    return both.view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpacked(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)
    return np.cumsum(both[: len(both) // 2]), both[len(both) // 2 :]


def _pair_counts(docs: DataFrame, text: str, known: Filter, support: int) -> DataFrame:
    """(key, a): occurrences of all pairs of words that may be frequent, by the pairs' keys; those of ``support`` or more.

    Keys are cut into 4,096 ranges; a range's keys travel packed, some three bytes each, and a group gets one range.
    """
    shared = docs.sparkSession.sparkContext.broadcast(known)  # BITS bits

    def counted(batches):
        held, size = [], 0
        for _, codes, _, hashes in _coded(batches, shared.value):
            at = np.nonzero((codes[:-1] >= 0) & (codes[1:] >= 0))[0]
            held.append(_pair_keys(hashes[codes[at]], hashes[codes[at + 1]]))
            size += len(at)
            if size >= TOGETHER // 4:
                yield from _ranges(held)
                held, size = [], 0
        if size:
            yield from _ranges(held)

    def _ranges(held):
        keys, n = np.unique(np.concatenate(held), return_counts=True)
        first = np.flatnonzero(np.diff(keys >> LOW_BITS, prepend=-1))
        ends = np.append(first[1:], len(keys))
        packed = [_packed(keys[i:j], n[i:j]) for i, j in zip(first.tolist(), ends.tolist(), strict=True)]
        yield from _batches([pa.array(keys[first] >> LOW_BITS), pa.array(packed, pa.binary())], ["range", "packed"])

    def added(key, found):
        keys, n = (np.concatenate(x) for x in zip(*map(_unpacked, found.column("packed").to_pylist()), strict=True))
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        n = np.add.reduceat(n, first)
        often = n >= support
        return pa.table({"key": pa.array(keys[first][often] + (key[0].as_py() << LOW_BITS), pa.int64()), "a": pa.array(n[often], pa.int64())})

    rows = _rows(docs, text, F.col("lang")).mapInArrow(counted, "range long, packed binary")
    return rows.groupBy("range").applyInArrow(added, "key long, a long")


def _projections(docs: DataFrame, text: str, known: Filter, paired: Filter, heavy: dict[int, int], longest: int) -> DataFrame:
    """(lang, prefix, part, n, w3, w4, ...): pointers of each pair that may be frequent, with the words to the right or null.

    ``part`` deals the pointers of the prefixes whose keys are in ``heavy`` over so many tasks by the next word; it is -1 for others.
    """
    shared = docs.sparkSession.sparkContext.broadcast((known, paired, heavy))  # twice BITS bits, PARTS pairs
    names = [f"w{k}" for k in range(3, longest + 1)]

    def projected(batches):
        known, paired, split = shared.value
        for lang, codes, words, hashes in _coded(batches, known):
            at = np.nonzero((codes[:-1] >= 0) & (codes[1:] >= 0))[0]
            at = at[paired.has(_pair_keys(hashes[codes[at]], hashes[codes[at + 1]]))]
            if not len(at):
                continue
            pair = np.zeros(len(codes) + longest, bool)  # where a pair begins that may be frequent
            pair[at] = True
            codes, goes = np.concatenate((codes, np.full(longest, -1))), np.ones(len(at), bool)
            columns = [codes[at], codes[at + 1]]
            for k in range(2, longest):
                goes = goes & pair[at + k - 1]
                columns.append(np.where(goes, codes[at + k], -1))
            order = np.lexsort(columns[::-1])
            columns = [c[order] for c in columns]
            first = np.nonzero(np.concatenate(([True], np.any([c[1:] != c[:-1] for c in columns], axis=0))))[0]
            n = np.diff(np.append(first, len(order)))
            columns = [c[first] for c in columns]
            parts = np.full(len(first), -1)
            if split and longest > 2:
                keys = _pair_keys(hashes[columns[0]], hashes[columns[1]])
                for i in np.nonzero(np.isin(keys, list(split)))[0].tolist():
                    parts[i] = int(hashes[columns[2][i]]) % split[int(keys[i])] if columns[2][i] >= 0 else 0
            right = [words.take(pa.array(c, mask=c < 0)).cast(pa.string()) for c in columns[2:]]
            yield from _batches([pa.array([lang] * len(first)), _joined(words, columns[:2]), pa.array(parts), pa.array(n), *right], ["lang", "prefix", "part", "n", *names])

    schema = ", ".join(["lang string, prefix string, part long, n long", *(f"{c} string" for c in names)])
    return _rows(docs, text, F.col("lang")).mapInArrow(projected, schema)


def _grow(rows: DataFrame, support: int, longest: int) -> DataFrame:
    """(lang, phrase, a): the frequent prefixes and their frequent extensions, with supports that are still to be added up.

    Runs that touch the edge of a batch, and prefixes dealt in parts, may go on elsewhere: they come with what they have here, however little.
    """

    def grown(batches):
        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            words = [batch.column(i) for i in (1, *range(4, 2 + longest))]
            part, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))

            def changed(column, size=size):
                """Whether each row but the first differs from the one before; a null differs from a word."""
                differs = pc.fill_null(pc.not_equal(column.slice(1), column.slice(0, size - 1)), False).to_numpy(zero_copy_only=False)
                valid = column.is_valid().to_numpy(zero_copy_only=False)
                return differs | (valid[1:] != valid[:-1])

            edges = [changed(batch.column(0)) | changed(batch.column(2)) | changed(words[0])]
            for column in words[1:]:
                edges.append(edges[-1] | changed(column))
            told = []

            def extend(level, lo, hi):
                """Runs of rows lo to hi, which share what ``level`` names, by the next word; each is the prefix of the next level."""
                starts = np.concatenate(([lo], lo + 1 + np.nonzero(edges[level][lo : hi - 1])[0]))
                ends = np.append(starts[1:], hi)
                sums = np.add.reduceat(n[lo:hi], starts - lo)
                going = (starts == 0) | (ends == size)
                if not level:
                    going |= part[starts] >= 0
                for k in np.nonzero((sums >= support) | going)[0].tolist():
                    i = int(starts[k])
                    if not words[level][i].is_valid:
                        continue
                    told.append((batch.column(0)[i].as_py(), " ".join(c[i].as_py() for c in words[: level + 1]), int(sums[k])))
                    if level + 1 < len(words):
                        extend(level + 1, i, int(ends[k]))

            extend(0, 0, size)
            if told:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*told, strict=True)], names=["lang", "phrase", "a"])

    order = ["lang", "prefix", "part", *(f"w{k}" for k in range(3, longest + 1))]
    dealt = rows.repartition("lang", "prefix", "part").sortWithinPartitions(*order)
    return dealt.mapInArrow(grown, "lang string, phrase string, a long")


def frequent_phrases(docs: DataFrame, support: int, longest: int, text: str = "text", bits: int = BITS, parts: int = PARTS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, a) of every phrase of one to ``longest`` words that occurs ``support`` times or more, and (lang, n): all words."""
    often = F.col("a") >= support
    words = checkpointed(word_counts(docs, text).filter(often | (F.col("phrase") == "")))
    totals, words = words.filter("phrase = ''").select("lang", F.col("a").alias("n")), words.filter("phrase <> ''")
    if longest < 2:
        return words, totals
    known = Filter(_word_keys(words), bits)
    pairs = checkpointed(_pair_counts(docs, text, known, support))
    every = totals.agg(F.sum("n")).collect()[0][0] or 0
    hot = pairs.filter(F.col("a") * parts > every).collect()  # fewer than ``parts``
    heavy = {r["key"]: max(2, r["a"] * parts // every) for r in hot}
    pointers = _projections(docs, text, known, Filter(pairs, bits), heavy, longest)
    longer = _grow(pointers, support, longest).groupBy("lang", "phrase").agg(F.sum("a").alias("a")).filter(often)
    return checkpointed(words.unionByName(longer)), totals


def _sub_phrases(words: Column, n: Column) -> Column:
    """All shorter runs of two or more of a phrase's words."""
    runs = F.transform(F.sequence(F.lit(2), n - 1), lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.array_join(F.slice(words, i, k), " ")))
    return F.when(n > 2, F.flatten(runs)).otherwise(F.array().cast("array<string>"))


def collocations(docs: DataFrame, support: int = 10, longest: int = 3, top: int | None = 2000, inside: int = 50, text: str = "text", **sizes: int) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the most cohesive phrases of each language, ``top`` at most (None: all).

    Phrases are dropped that stand inside a longer one with ``inside`` percent of their occurrences or more. ``sizes``: ``bits`` and ``parts``.
    """
    counts, totals = frequent_phrases(docs, support, longest, text, **sizes)
    words = F.split("phrase", " ")
    phrases = counts.withColumns({"_words": words, "_n": F.size(words)}).filter("_n > 1")
    cut = phrases.select("lang", "phrase", "a", "_words", "_n", F.explode(F.sequence(F.lit(1), F.col("_n") - 1)).alias("k"))
    cut = cut.select(
        "lang", "phrase", "a", "k",
        F.array_join(F.slice("_words", F.lit(1), F.col("k")), " ").alias("left"),
        F.array_join(F.slice("_words", F.col("k") + 1, F.col("_n") - F.col("k")), " ").alias("right"),
    )
    part = lambda side, count: counts.select("lang", F.col("phrase").alias(side), F.col("a").alias(count))
    cut = cut.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    score = F.expr("(CAST(a AS DECIMAL(15,0)) * CAST(a AS DECIMAL(15,0)) * CAST(1000000 AS DECIMAL(7,0))) div (CAST(l AS DECIMAL(15,0)) * CAST(r AS DECIMAL(15,0)))")
    weakest = cut.groupBy("lang", "phrase").agg(F.min("a").alias("a"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    longer = phrases.select("lang", F.explode(F.array_distinct(_sub_phrases(F.col("_words"), F.col("_n")))).alias("phrase"), F.col("a").alias("longer"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = weakest.join(longer, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("longer") < inside * F.col("a"), F.lit(True)))
    rows = kept.select("lang", "phrase", "a", "cut.l", "cut.r", F.col("cut.score").cast("long").alias("score"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = rows.withColumn("rank", rank)
    if top is not None:
        ranked = ranked.filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")

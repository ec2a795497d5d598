"""Language ID by hyperdimensional profiles.

Every letter (and the gap between words) has a random vector of +1 and -1, drawn from its code
point. A trigram's vector binds the first letter's vector rotated twice, the second's rotated
once and the third's, by multiplication. A document bundles (sums) the vectors of its trigrams; a
language's prototype bundles its training documents. A document's language is the prototype of
largest cosine; the cosine, at least 0, is the score.

Bundling is linear, so prototypes are summed per partition, then per dimension by Spark; the
driver gets one vector per language (``MAX_LANGUAGES`` at most, else an error).

Defined results: null texts and texts without a letter are ``und`` with score 0; documents with a
null text or language teach nothing; repeated rows count as often as they occur; ties go to the
smaller name; without any training document every prediction is ``und``; an empty table gives an empty table;
of ``keep``, columns named ``lang_pred`` or ``score`` give way to the results.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept_columns, kept_with_text, with_fields

DIMENSIONS = 512
TOGETHER = 128
MAX_LANGUAGES = 5000
CACHE_ROWS = 20_000
SEED = 77
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


@lru_cache(maxsize=20_000)
def _letter(code: int) -> np.ndarray:
    return np.random.default_rng([SEED, code]).choice(np.array([-1, 1], np.int8), DIMENSIONS)


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams of letters and single gaps (three code points in one long) around a letter, with counts."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), "<u4").astype(np.int64)
    codes = np.where(_is_letter()[codes], codes, 0) if len(codes) else codes
    codes = np.concatenate(([0], codes, [0]))
    codes = codes[np.concatenate(([True], (codes[1:] != 0) | (codes[:-1] != 0)))]
    grams = codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:]
    return np.unique(grams[codes[1:-1] != 0], return_counts=True)


class Vectors:
    """Trigram vectors, of which ``CACHE_ROWS`` are kept, and bundles of texts by matrix product."""

    def __init__(self):
        self.codes, self.rows = np.empty(0, np.int64), np.empty((0, DIMENSIONS), np.float32)

    def _rows(self, codes: np.ndarray) -> np.ndarray:
        """Vectors of sorted distinct trigrams."""
        new = codes[~np.isin(codes, self.codes, assume_unique=True)]
        if len(new):
            low = (1 << 21) - 1
            made = np.empty((len(new), DIMENSIONS), np.float32)
            for i, c in enumerate(new.tolist()):
                made[i] = np.roll(_letter(c >> 42), 2) * np.roll(_letter(c >> 21 & low), 1) * _letter(c & low)
            if len(self.codes) + len(new) > CACHE_ROWS:  # keep the ones in use only
                old = np.isin(self.codes, codes, assume_unique=True)
                self.codes, self.rows = self.codes[old], self.rows[old]
            all_codes = np.concatenate((self.codes, new))
            order = np.argsort(all_codes)
            self.codes, self.rows = all_codes[order], np.concatenate((self.rows, made))[order]
        return self.rows[np.searchsorted(self.codes, codes)]

    def bundles(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """One bundle per (trigrams, counts)."""
        out = np.zeros((len(texts), DIMENSIONS), np.float32)
        if not texts:
            return out
        rows = np.repeat(np.arange(len(texts)), [len(c) for c, _ in texts])
        codes, spot = np.unique(np.concatenate([c for c, _ in texts]), return_inverse=True)
        counts = np.concatenate([n for _, n in texts])
        for at in range(0, len(codes), CACHE_ROWS // 4):
            inside = (spot >= at) & (spot < at + CACHE_ROWS // 4)
            part = codes[at : at + CACHE_ROWS // 4]
            dense = np.zeros((len(texts), len(part)), np.float32)
            dense[rows[inside], spot[inside] - at] = counts[inside]
            out += dense @ self._rows(part)
        return out


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, np.ndarray]:
    """Prototype of each language, from every row of ``docs``."""

    def partial(batches):
        sums, vectors = {}, Vectors()
        for batch in batches:
            for start in range(0, len(batch), 8 * TOGETHER):
                part, by_lang = batch.slice(start, 8 * TOGETHER), {}
                for t, name in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    by_lang.setdefault(name, []).append(trigrams(t))
                for name, found in by_lang.items():
                    codes, back = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
                    counts = np.bincount(back, np.concatenate([n for _, n in found]), len(codes))
                    sums[name] = sums.get(name, 0) + vectors.bundles([(codes, counts)])[0].astype(float)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()])], names=["lang", "sums"])

    rows = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).dropna()
    each = rows.mapInArrow(partial, "lang string, sums array<double>").select("lang", F.posexplode("sums").alias("at", "x"))
    summed = each.groupBy("lang", "at").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("v"))
    found = summed.limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return {r["lang"]: np.array([x["x"] for x in r["v"]]) for r in sorted(found, key=lambda r: r["lang"])}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, ``lang_pred`` and ``score`` of every row."""
    keep = kept_columns(keep, "lang_pred", "score")
    rows, at = kept_with_text(docs, keep, text)
    names = [n for n, v in prototypes.items() if np.any(v)]
    matrix = np.stack([prototypes[n] / np.linalg.norm(prototypes[n]) for n in names]) if names else None

    def some(texts, vectors):
        found = [trigrams(t) for t in texts]
        if matrix is None:
            return [(UNKNOWN, 0.0)] * len(texts)
        own = vectors.bundles(found).astype(float)
        cosines = own @ matrix.T / np.maximum(np.linalg.norm(own, axis=1), 1e-9)[:, None]
        best = np.argmax(cosines, axis=1)
        score = np.clip(cosines[np.arange(len(best)), best], 0, 1)
        return [(names[b], float(x)) if len(c) else (UNKNOWN, 0.0) for b, x, (c, _) in zip(best, score, found, strict=True)]

    def scored(batches):
        vectors = Vectors()
        for batch in batches:
            found = []
            for start in range(0, len(batch), TOGETHER):
                found += some(batch.column(at).slice(start, TOGETHER).to_pylist(), vectors)
            columns = [batch.column(i) for i in range(len(keep))]
            columns += [pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "lang_pred", "score"])

    return rows.mapInArrow(scored, with_fields(rows, len(keep), "lang_pred string, score double"))


def accepted(lang_pred: Column, score: Column, text: Column, least: float = 0.15, half: int = 200) -> Column:
    """Whether a document stays: it has letters, and resembles a language more than letters in random order do.

    The cosine of a bundle of n trigrams with any prototype grows as the square root of n before it levels off, so what is asked does too:
    ``least`` times sqrt(n / (n + half)), with the length of the text for n. One rule holds at every length.
    """
    n = F.length(text)
    return (lang_pred != UNKNOWN) & (score >= least * F.sqrt(n / (n + half)))

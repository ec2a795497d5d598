"""Toxicity by a factorization machine over hashed terms.

A document's terms are its distinct lower-cased words and their first
five and seven letters, hashed to 2**20 buckets. A term's linear
weight and the product of two terms' factor vectors both count, so a pair such as an insult and a
mention of a group can weigh more, or less, than its parts.

Terms take part for either of two reasons: their share of toxic documents differs from their share of others by ``MIN_Z``
standard errors; or they make up a pair whose toxicity differs by ``MIN_PAIR_Z`` standard errors from what its terms add up to, so
that a pair can tell although neither term does alone. What counts is what a linear machine of the first terms leaves unexplained, in the documents
with both terms, one, the other and neither. All pairs of all terms of all training documents are counted, however rare or long; only the standard
errors say what is too rare to tell, and terms of fewer than ``LEAST_DOCS`` documents cannot be in such a pair. The work is that of the pairs in
at most ``TRAIN_DOCS`` documents, dealt in blocks of two groups of terms. No number of terms is set but that of the buckets.

The machine is fitted on the driver, on at most ``TRAIN_DOCS`` labelled documents: those with the
smallest digests of their ids; their terms are counted on the executors, and the driver gets the
terms that take part only. Everything else covers all rows.

Defined results: null and empty texts have no terms and get the score of the bias; rows with a
null label teach nothing; of several labels of an id the largest holds, and of several texts that of the least digest teaches;
repeated documents are scored row by row; without labels of both kinds the score is the share of toxic labels (0 without any);
an empty table gives an empty table; of ``keep``, a column named ``score`` gives way to the result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, kept_columns, with_fields

TRAIN_DOCS = 20_000
BUCKETS = 1 << 20
FACTORS = 8
STEMS = (5, 7)
MIN_Z = 5.0
MIN_PAIR_Z = 6.0
LEAST_DOCS = 6
GROUP = 1 << 21
UNIT = 1 << 20
PARTS = 8
BATCH = 64
THRESHOLD = 0.3
_WORD = re.compile(r"\w+")


def terms(text: str | None) -> np.ndarray:
    """Sorted distinct buckets of the text's words and of their beginnings."""
    words = set(_WORD.findall((text or "").lower()))
    words |= {f"{w[:k]}-" for k in STEMS for w in words if len(w) > k}
    digest = xxhash.xxh64_intdigest
    hashed = np.fromiter((digest(w.encode("utf-8", "replace")) for w in words), np.uint64, len(words))
    return np.unique((hashed % np.uint64(BUCKETS)).astype(np.int32))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Machine:
    """bias + sum of w_i + sum over pairs of <v_i, v_j>, for the active terms of a document."""

    def __init__(self, chosen: np.ndarray, bias: float, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.chosen, self.bias = chosen, bias
        self.w, self.v = np.zeros(len(chosen), np.float32), rng.normal(0, 0.05, (len(chosen), FACTORS)).astype(np.float32)

    def active(self, buckets: np.ndarray) -> np.ndarray:
        if not len(self.chosen):
            return np.empty(0, np.int64)
        spot = np.minimum(np.searchsorted(self.chosen, buckets), len(self.chosen) - 1)
        return spot[self.chosen[spot] == buckets]

    def margin(self, active: np.ndarray) -> float:
        v = self.v[active].astype(float)
        total = v.sum(axis=0)
        return self.bias + float(self.w[active].sum(dtype=float)) + 0.5 * float(total @ total - (v * v).sum())

    def fit(self, docs: list[np.ndarray], toxic: np.ndarray, passes: int = 10, steps: int = 3000, rate: float = 0.05, decay: float = 1e-3) -> None:
        """Adagrad on the logistic loss over batches of ``BATCH`` documents, in an order fixed by a seed: ``passes``, or ``steps`` if that is more.

        Documents without an active term teach the bias alone.
        """
        if not len(self.chosen):
            return
        sizes = np.array([len(d) for d in docs])
        flat, begins = np.concatenate(docs), np.cumsum(sizes) - sizes
        rng, eps = np.random.default_rng(11), 1e-6
        sum_w, sum_v, sum_b = np.zeros_like(self.w), np.zeros_like(self.v), 0.0
        for _ in range(max(passes, -(-steps * BATCH // len(docs)))):
            order = rng.permutation(len(docs))
            for at in range(0, len(docs), BATCH):
                part = order[at : at + BATCH]
                n = sizes[part]
                row = np.repeat(np.arange(len(part)), n)
                spot = np.arange(n.sum()) + np.repeat(begins[part] - np.cumsum(n) + n, n)
                term, back = np.unique(flat[spot], return_inverse=True)
                w, v = self.w[term], self.v[term]
                each = v[back]
                total = np.stack([np.bincount(row, each[:, k], len(part)) for k in range(FACTORS)], axis=1)
                pairs = 0.5 * ((total * total).sum(axis=1) - np.bincount(row, (each * each).sum(axis=1), len(part)))
                g = _sigmoid(self.bias + np.bincount(row, w[back], len(part)) + pairs) - toxic[part]
                own = g[row]
                pull = own[:, None] * (total[row] - each)
                grad_w = np.bincount(back, own, len(term)) + decay * w
                grad_v = np.stack([np.bincount(back, pull[:, k], len(term)) for k in range(FACTORS)], axis=1) + decay * v
                sum_w[term] += grad_w * grad_w
                sum_v[term] += grad_v * grad_v
                sum_b += g.sum() ** 2
                self.w[term] -= rate * grad_w / (np.sqrt(sum_w[term]) + eps)
                self.v[term] -= rate * grad_v / (np.sqrt(sum_v[term]) + eps)
                self.bias -= rate * g.sum() / (sum_b**0.5 + eps)


def term_counts(rows: DataFrame) -> DataFrame:
    """(term, a, b): toxic and other documents with each bucket."""
    each = rows.select("y", F.explode("terms").alias("term"))
    return each.groupBy("term").agg(F.count_if(F.col("y") > 0).alias("a"), F.count_if(F.col("y") <= 0).alias("b"))


def telling_terms(counts: DataFrame, n_toxic: int, n_other: int) -> np.ndarray:
    """Buckets whose shares in the two classes differ by ``MIN_Z`` standard errors."""
    share = (F.col("a") + F.col("b")) / (n_toxic + n_other)
    error = F.sqrt(F.greatest(share * (1 - share), F.lit(1e-12)) * (1 / n_toxic + 1 / n_other))
    z = F.abs(F.col("a") / n_toxic - F.col("b") / n_other) / error
    return counts.filter((z >= MIN_Z) & (F.col("a") + F.col("b") >= 3)).select("term").toArrow().column("term").to_numpy()


def _surprise(both, one, two, whole, base: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs that interact, and by how many standard errors what is left unexplained in a pair's four cells (both terms, only one, only the
    other, neither) fails to add up.

    Each argument has three numbers, of the documents with both terms, with one, with the other, and of all: toxic ones, all, and toxic ones by a machine.
    """
    least = base * (1 - base)
    toxic, every, said = ([m, x - m, y - m, n - x - y + m] for m, x, y, n in zip(both, one, two, whole, strict=True))
    rate = [(t + 0.5) / (x + 1) for t, x in zip(toxic, every, strict=True)]
    left = [r - (p + base) / (x + 1) for r, p, x in zip(rate, said, every, strict=True)]
    off = np.abs(left[0] - left[1] - left[2] + left[3])
    # One cell's share of the error is less than the whole, so the others are worked out for few pairs.
    may = np.flatnonzero(off * off * every[0] >= MIN_PAIR_Z**2 * np.maximum(rate[0] * (1 - rate[0]), least))
    error = sum(np.maximum(r[may] * (1 - r[may]), least) / np.maximum(x[may], 1) for r, x in zip(rate, every, strict=True))
    z = off[may] / np.sqrt(error)
    return may[z >= MIN_PAIR_Z], z[z >= MIN_PAIR_Z]


def _most(wrong, x, c: float):
    """The most that a cell of ``x`` documents can have unexplained a document, where a machine is wrong by ``wrong`` at most in all of them."""
    return (np.minimum(wrong, x) + abs(c)) / (x + 1)


def _least_met(own, other, whole, base: float) -> np.ndarray:
    """For each term of one group, a number of documents in common with a term of the other group below which no pair can interact.

    ``own``, ``other`` and ``whole`` have, beside the numbers of ``_surprise``, by how much the machine is wrong in all.
    """
    c, most = 0.5 - base, np.full(len(own[1]), LEAST_DOCS + 1)
    neither = np.maximum(whole[1] - own[1] - other[1].max(), whole[3])
    for m in range(LEAST_DOCS, 0, -1):
        reach = _most(own[3], m, c) + _most(own[3], own[1] - m, c) + _most(other[3], other[1] - m, c).max() + _most(whole[3], neither, c)
        most[reach * reach * m >= 0.999 * MIN_PAIR_Z**2 * base * (1 - base)] = m
    return most


def _may_interact(m, one, two, whole, base: float) -> np.ndarray:
    """Which pairs with ``m`` documents in common may interact, whatever is unexplained in these: it is no more than that of either term."""
    c, x, y = 0.5 - base, one[1] - m, two[1] - m
    left, gone = one[0] - one[2], two[0] - two[2]
    shares = [1 / (k + 1) for k in (m, x, y, whole[1] - x - two[1])]
    middle = c * shares[0] - (left + c) * shares[1] - (gone + c) * shares[2] + (whole[0] - whole[2] - left - gone + c) * shares[3]
    off = np.abs(middle) + np.minimum(one[3], two[3]) * sum(shares)
    return off * off * m >= 0.999 * MIN_PAIR_Z**2 * base * (1 - base)


def telling_pairs(rows: DataFrame, counts: DataFrame, machine: Machine, n: int, n_toxic: int, group: int = GROUP) -> DataFrame:
    """(one, two, z): pairs of terms with an interaction of ``MIN_PAIR_Z`` standard errors or more in what ``machine`` leaves unexplained.

    Every pair that a document has is counted. Terms are cut into groups of ``group`` occurrences, and each two groups make a block: one group of rows, with
    what documents have of either. A task holds these occurrences and the counts of one term's pairs.
    """
    if not 0 < n_toxic < n:
        return rows.sparkSession.createDataFrame([], "one int, two int, z double")

    def told_(batches):
        for batch in batches:
            margins = np.array([machine.margin(machine.active(np.asarray(t, np.int32))) for t in batch.column(2).to_pylist()], float)
            said = np.rint(UNIT * _sigmoid(margins)).astype(np.int64)  # whole numbers: sums do not depend on the order
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(said), batch.column(2)], names=["y", "said", "terms"])

    rows = rows.mapInArrow(told_, "y int, said long, terms array<int>")
    wrong = F.abs(F.when(F.col("y") > 0, UNIT).otherwise(0) - F.col("said"))
    sums = rows.select("said", wrong.alias("wrong"), F.explode("terms").alias("term")).groupBy("term").agg(F.sum("said").alias("said"), F.sum("wrong").alias("wrong"))
    found = counts.filter(F.col("a") + F.col("b") >= LEAST_DOCS).join(sums, "term").select("term", "a", "b", "said", "wrong").toArrow().sort_by("term")  # BUCKETS at most
    if not found.num_rows:
        return rows.sparkSession.createDataFrame([], "one int, two int, z double")
    terms_, a, b, said, off = (found.column(c).to_numpy() for c in ("term", "a", "b", "said", "wrong"))
    side = (np.cumsum(a + b) - a - b) // group
    edges = np.append(np.flatnonzero(np.diff(side, prepend=-1)), len(terms_))  # where groups begin, and the end
    groups, base = len(edges) - 1, n_toxic / n
    kind = np.uint16 if np.diff(edges).max() <= 1 << 16 else np.uint32
    whole = (n_toxic, n, *(x / UNIT for x in rows.agg(F.sum("said"), F.sum(wrong)).collect()[0]))
    shared = rows.sparkSession.sparkContext.broadcast((terms_, (a, a + b, said / UNIT, off / UNIT)))

    def dealt(batches):
        terms_ = shared.value[0]
        for batch in batches:
            made = []
            for y, p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                spots = np.searchsorted(terms_, np.intersect1d(np.asarray(t, np.int64), terms_, assume_unique=True))
                cut = np.searchsorted(spots, edges)
                parts = [(spots[cut[g] : cut[g + 1]] - edges[g]).astype(kind).tobytes() for g in range(groups)]
                has = [g for g in range(groups) if parts[g]]
                for k, g in enumerate(has):
                    made += [(g * groups + h, y > 0, p, parts[g], parts[h]) for h in has[k:]]
                if len(made) >= 1 << 12:
                    yield _blocks(made)
                    made = []
            if made:
                yield _blocks(made)

    def _blocks(made):
        return pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*made, strict=True)], names=["block", "toxic", "said", "one", "two"])

    def counted(key, rows_):
        g, h = divmod(key[0].as_py(), groups)
        terms_, counts_ = shared.value
        at, to = slice(edges[g], edges[g + 1]), slice(edges[h], edges[h + 1])
        toxic = rows_.column("toxic").to_numpy()
        order = np.argsort(~toxic, kind="stable")  # toxic documents come first
        one, two = ([np.frombuffer(x, kind).astype(np.intp) for x in rows_.column(c).take(pa.array(order)).to_pylist()] for c in ("one", "two"))
        first, said = int(toxic.sum()), rows_.column("said").to_numpy()[order] / UNIT
        sizes = np.array([len(x) for x in two])
        own = np.concatenate(one)
        by = np.argsort(own, kind="stable")
        docs, ends = np.repeat(np.arange(len(one)), [len(x) for x in one])[by], np.searchsorted(own[by], np.arange(edges[g + 1] - edges[g] + 1))
        lows, highs, told = [c[at] for c in counts_], [c[to] for c in counts_], []
        least = _least_met(lows, highs, whole, base)
        for i in range(len(ends) - 1):
            own = docs[ends[i] : ends[i + 1]]
            met = np.concatenate([two[d] for d in own.tolist()])
            many = np.bincount(met)
            if g == h:
                many[: i + 1] = 0
            one_, near = [c[i] for c in lows], np.flatnonzero(many >= least[i])
            near = near[_may_interact(many[near], one_, [c[near] for c in highs], whole, base)]
            if not len(near):
                continue
            worse = np.bincount(met[: sizes[own[own < first]].sum()], minlength=len(many))[near]
            judged = np.bincount(met, np.repeat(said[own], sizes[own]))[near]
            spots, z = _surprise((worse, many[near], judged), one_[:3], [c[near] for c in highs[:3]], whole[:3], base)
            if len(spots):
                told.append((np.full(len(spots), terms_[at][i]), terms_[to][near[spots]], z))
        columns = [np.concatenate(x) for x in zip(*told, strict=True)] if told else [[], [], []]
        return pa.table([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.float64())], names=["one", "two", "z"])

    blocks = rows.mapInArrow(dealt, "block long, toxic boolean, said long, one binary, two binary")
    return blocks.repartition(2 * groups * (groups + 1), "block").groupBy("block").applyInArrow(counted, "one int, two int, z double")


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Machine:
    """Learn from the documents that ``labels`` (doc_id and a 0/1 label) names."""
    known = labels.select(F.col(doc_id).alias("_id"), F.col(label).alias("_y")).dropna()
    known = known.groupBy("_id").agg(F.max("_y").alias("_y"))
    sample = known.orderBy(F.xxhash64("_id"), "_id").limit(TRAIN_DOCS)
    rows = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = rows.join(F.broadcast(sample), "_id")  # TRAIN_DOCS rows at most

    def featured(batches):
        for batch in batches:
            found = pa.array([terms(t) for t in batch.column(3).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), found], names=["id", "y", "digest", "terms"])

    # Terms are taken before the shuffle by id, so whole texts never travel.
    each = rows.select(F.col("_id").cast("string").alias("id"), F.col("_y").cast("int").alias("y"), F.md5("_text").alias("digest"), "_text")
    each = each.mapInArrow(featured, "id string, y int, digest string, terms array<int>")
    table = checkpointed(each.groupBy("id").agg(F.max("y").alias("y"), F.min_by("terms", "digest").alias("terms")).repartition(PARTS))
    n, n_toxic = table.agg(F.count(F.lit(1)), F.count_if(F.col("y") > 0)).collect()[0]
    if not 0 < n_toxic < n:
        return Machine(np.empty(0, np.int32), 40.0 if n_toxic else -40.0)
    counts = checkpointed(term_counts(table))
    base = float(np.log(n_toxic / (n - n_toxic)))
    alone = Machine(np.sort(telling_terms(counts, n_toxic, n - n_toxic)).astype(np.int32), base)
    alone.v[:] = 0  # stays so: a linear machine
    _taught(alone, table)
    pairs = telling_pairs(table, counts, alone, n, n_toxic).select(F.explode(F.array("one", "two")).alias("term")).distinct()
    chosen = np.union1d(alone.chosen, pairs.toArrow().column("term").to_numpy())  # BUCKETS at most
    machine = Machine(chosen.astype(np.int32), base)
    _taught(machine, table)
    return machine


def _taught(machine: Machine, table: DataFrame) -> None:
    """Fit ``machine`` on the training documents (id, y, terms), of which the driver gets the terms that take part."""

    def narrowed(batches):
        for batch in batches:
            spots = [machine.active(np.asarray(t, np.int32)) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spots, pa.list_(pa.int64()))], names=["id", "y", "spots"])

    found = table.mapInArrow(narrowed, "id string, y int, spots array<long>").toPandas()
    found = found.sort_values("id", ignore_index=True)
    machine.fit([np.asarray(x, np.int64) for x in found["spots"]], (found["y"].to_numpy() > 0).astype(float))


def score(docs: DataFrame, machine: Machine, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``score`` (0 to 1) of every row."""
    keep = kept_columns(keep, "score")
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # BUCKETS terms at most

    def scored(batches):
        for batch in batches:
            own = shared.value
            margins = np.array([own.margin(own.active(terms(t))) for t in batch.column(len(keep)).to_pylist()], float)
            columns = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(_sigmoid(margins))], names=[*keep, "score"])

    rows = docs.select(*keep, F.col(text).alias("_scored_text"))
    return rows.mapInArrow(scored, with_fields(rows, len(keep), "score double"))

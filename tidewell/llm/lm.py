"""Language-model scoring by prediction by partial matching.

A text is its words, with A-Z lower-cased, joined by single spaces and closed by a line end; its bytes
are predicted from the ``ORDER`` bytes before. The byte-context trie is kept as counts of grams of one byte
more: their last k + 1 bytes count the symbols after every context of k bytes. Prediction starts
at the longest context that was seen. A symbol of count c after a context of total T has probability (c - 1/2) / T; what is left, with d
distinct symbols d / 2T, is the escape to the next shorter context (method D). After an escape, the
symbols of the longer context are excluded: as a context's symbols all follow its shorter contexts
too, what remains of T and d is a constant of the longer context, so all is precomputed and
scoring is table lookup. Below order 0 the bytes never seen are alike.

Counts cover all training rows and every gram has its part in the scores. What travels to the executors is bounded: grams
seen less than a threshold stay behind, the least power of two that leaves ``MAX_GRAMS``; likewise words beyond the
``HOT_WORDS`` commonest. If grams stay behind, only whole grams that travel are scored in place, as their counts and totals are exact;
all others are scored once each against the table of all grams, dealt by the two bytes before the symbol, and joined. So are rarer words.

Defined results: null and blank texts have the end token only; repeated rows are trained on and scored
row by row; without training rows every count is 0 and all bytes are alike; words are told apart
by their 64-bit hash; an empty table gives an empty table; of ``keep``, columns named like a result give way to it.
"""

from __future__ import annotations

import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, free_name, kept_columns, with_fields
from .lookup import Table

ORDER = 5
MAX_GRAMS = 1_500_000
HOT_WORDS = 400_000
END = b"\n"
BATCH_BYTES = 1 << 19
FLUSH_WORDS = 200_000
FLUSH_GRAMS = 500_000
GROUP_GRAMS = 60_000


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def word_keys(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def grams(split: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Grams of ``ORDER`` + 1 bytes ending at every byte of the texts, and the start of each text among them."""
    pad = END * ORDER
    bodies = [b" ".join(ws) + END for ws in split]
    lengths = np.array([len(b) for b in bodies], np.int64)
    flat = np.frombuffer(pad.join([b"", *bodies]), np.uint8).astype(np.uint64)
    starts = np.cumsum(lengths + ORDER) - lengths
    keys = np.zeros(len(flat), np.uint64)
    for back in range(ORDER + 1):
        keys[back:] |= flat[: len(flat) - back] << np.uint64(8 * back)
    inside = np.ones(len(flat), bool)
    inside[(starts[:, None] - 1 - np.arange(ORDER)).ravel()] = False
    return keys[inside], np.cumsum(lengths) - lengths


def _parts(column: pa.Array):
    """(start, end, texts) of runs of ``BATCH_BYTES``, or of a single text, of a column."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    start = 0
    while start < len(sizes):
        end, size = start, 0
        while end < len(sizes) and (end == start or size + sizes[end] <= BATCH_BYTES):
            size += sizes[end]
            end += 1
        yield start, end, column.slice(start, end - start).to_pylist()
        start = end


def count(docs: DataFrame, text: str = "text") -> DataFrame:
    """(kind, key, n): grams (kind 0) and words with the end token (kind 1) of all rows, summed per task first."""

    def rows(kind, keys, n):
        columns = [pa.array(np.full(len(keys), kind, np.int8)), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))]
        return pa.RecordBatch.from_arrays(columns, names=["kind", "key", "n"])

    def words_out(counter):
        found = list(counter)
        return rows(1, word_keys(found), np.fromiter(counter.values(), np.int64, len(found)))

    def merged(found):
        keys, back = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
        return keys, np.bincount(back, np.concatenate([n for _, n in found]), len(keys)).astype(np.int64)

    def counted(batches):
        words: Counter = Counter()
        seen, new, waiting = (np.empty(0, np.uint64), np.empty(0, np.int64)), [], 0
        for batch in batches:
            for _, _, texts in _parts(batch.column(0)):
                split = [tokens(t) for t in texts]
                words[END] += len(split)
                for ws in split:
                    words.update(ws)
                new.append(np.unique(grams(split)[0], return_counts=True))
                waiting += len(new[-1][0])
                if waiting > FLUSH_GRAMS:
                    seen, new, waiting = merged([seen, *new]), [], 0
                if len(words) > FLUSH_WORDS:
                    yield words_out(words)
                    words = Counter()
                if len(seen[0]) > FLUSH_GRAMS:
                    yield rows(0, *seen)
                    seen = np.empty(0, np.uint64), np.empty(0, np.int64)
        if words:
            yield words_out(words)
        seen = merged([seen, *new])
        if len(seen[0]):
            yield rows(0, *seen)

    found = docs.select(F.col(text).alias("text")).mapInArrow(counted, "kind byte, key long, n long")
    return checkpointed(found.groupBy("kind", "key").agg(F.sum("n").alias("n")))


class Trie:
    """Log10 probabilities by context, from arrays of gram keys and counts per order, and the number of all grams.

    Without that number the grams are all that follow their contexts, whose totals are then their sums.
    """

    def __init__(self, by_order: list[tuple[np.ndarray, np.ndarray]], all_grams: int | None = None):
        self.grams, self.contexts = [], []
        shorter = None
        for k, (keys, n) in enumerate(by_order):
            order = np.argsort(keys)
            keys, n = keys[order].astype(np.uint64), n[order].astype(np.float64)
            context, first, distinct = np.unique(keys >> np.uint64(8), return_index=True, return_counts=True)
            spot = np.repeat(np.arange(len(context)), distinct)
            kept = np.add.reduceat(n, first) if len(n) else n
            rest = again = np.zeros(len(context))
            with np.errstate(divide="ignore", invalid="ignore"):
                if not shorter:
                    total = kept if all_grams is None else np.full(len(context), float(all_grams))
                    texts = n[keys == np.uint64(END[0])].sum()
                else:
                    below, below_n, below_context, below_total, below_kept, below_distinct = shorter
                    if all_grams is None:
                        total = kept
                    else:
                        # A context is the gram before its symbol, but for the padding before a text.
                        at = np.minimum(np.searchsorted(below, context), len(below) - 1)
                        total = np.where(below[at] == context, below_n[at], 0.0) if len(below) else np.zeros(len(context))
                        total = np.where(context & np.uint64(255) == np.uint64(END[0]), texts, total)
                    mask = np.uint64((1 << 8 * k) - 1)
                    same = below_n[np.searchsorted(below, keys & mask)]
                    used = np.add.reduceat(same, first) if len(n) else same
                    up = np.searchsorted(below_context, context & (mask >> np.uint64(8)))
                    left, seen = below_total[up] - used, below_kept[up] - used
                    rest = np.log10(left)
                    again = np.where(left > 0, np.log10((left - seen + (below_distinct[up] - distinct) / 2) / left), 0.0)
                start = np.log10((n - 0.5) / total[spot])
                escape = np.log10((total - kept + distinct / 2) / total)
            self.grams.append((Table(keys), start.astype(np.float32), np.log10(n - 0.5).astype(np.float32)))
            self.contexts.append((Table(context), *(x.astype(np.float32) for x in (escape, rest, again))))
            shorter = keys, n, context, total, kept, distinct
        self.floor = -np.log10(max(1, 256 - len(by_order[0][0])))

    def whole(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which grams are here at full length, and their log10 probability (0 for others)."""
        table, start, _ = self.grams[ORDER]
        row = table.find(keys)
        hit = row >= 0
        out = np.zeros(len(keys))
        out[hit] = start[row[hit]]
        return hit, out

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """Log10 probability of the last byte of each gram after the bytes before it."""
        out = np.zeros(len(keys))
        todo, left = np.arange(len(keys)), np.full(len(keys), -1)  # left: row of the longer context that was left, or -1
        for k in range(ORDER, -1, -1):
            table, start, logs = self.grams[k]
            context, escape, _, _ = self.contexts[k]
            key = keys[todo] & np.uint64((1 << 8 * (k + 1)) - 1)
            row = table.find(key)
            after = left >= 0
            if k < ORDER:
                _, _, rest, again = self.contexts[k + 1]
            hit = row >= 0
            plain = hit & ~after
            out[todo[plain]] += start[row[plain]]
            if after.any():
                both = hit & after
                out[todo[both]] += logs[row[both]] - rest[left[both]]
                lost = ~hit & after
                out[todo[lost]] += again[left[lost]]
            miss = ~hit
            at = context.find(key[miss] >> np.uint64(8))
            fresh = (at >= 0) & ~after[miss]
            todo, left = todo[miss], at
            out[todo[fresh]] += escape[at[fresh]]
            if not len(todo):
                return out
        out[todo] += self.floor
        return out


def _bounded(counts: DataFrame, most: int) -> DataFrame:
    """The rows of the largest counts: all whose count reaches the least power of two that leaves ``most`` rows."""
    steps = [1 << p for p in range(62)]
    found = counts.agg(*[F.count_if(F.col("n") >= s).alias(f"n{s}") for s in steps]).collect()[0]
    least = next(s for s, n in zip(steps, found, strict=True) if n <= most)
    return counts.filter(F.col("n") >= least)


def fit(counts: DataFrame) -> dict:
    """The model as plain arrays: kept grams by order, hot words, and totals. Executors build the tables from them."""
    full = counts.filter("kind = 0").select("key", "n")
    suffixes = F.array(*[F.struct(F.lit(k).alias("k"), F.col("key").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1)).alias("key")) for k in range(ORDER + 1)])
    every = full.select("n", F.explode(suffixes).alias("g")).groupBy("g.k", "g.key").agg(F.sum("n").alias("n"))
    every = checkpointed(every)
    kept = _bounded(every, MAX_GRAMS)
    model = {"grams": [_arrays(kept.filter(F.col("k") == k)) for k in range(ORDER + 1)]}
    model["all_here"] = every.count() == sum(len(keys) for keys, _ in model["grams"])
    model["all_grams"] = full.agg(F.coalesce(F.sum("n"), F.lit(0))).collect()[0][0]
    words = counts.filter("kind = 1").select("key", "n")
    model["tokens"], model["distinct"] = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).collect()[0]
    model["hot"] = _arrays(_bounded(words, HOT_WORDS))
    return model


def _arrays(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of a bounded table."""
    table = rows.select("key", "n").toArrow()
    key, n = (table.column(c).to_numpy() for c in ("key", "n"))
    return key.view(np.uint64), n


def _far_logs(counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, log) of every gram in ``wanted``, from all grams of ``counts``.

    All that decides a gram from order 2 up shares the two bytes before its symbol, so grams are dealt by these and each group
    is scored by its own trie; orders 0 and 1, with 65,792 grams at most, go to every task.
    """
    full = counts.filter("kind = 0").select("key", "n")
    short = [full.groupBy(F.col("key").bitwiseAND(F.lit(m)).alias("key")).agg(F.sum("n").alias("n")) for m in (0xFF, 0xFFFF)]
    shared = counts.sparkSession.sparkContext.broadcast([_arrays(x) for x in short])
    rows = full.unionAll(wanted.select("key", F.lit(0).cast("long").alias("n")))
    rows = rows.withColumn("pair", F.shiftright("key", 8).bitwiseAND(F.lit(0xFFFF)))

    def scored(keys, n):
        asked = keys[n == 0]
        by_order = [(keys[n > 0], n[n > 0])]
        for k in range(ORDER - 1, 1, -1):
            longer, times = by_order[0]
            shorter, back = np.unique(longer & np.uint64((1 << 8 * (k + 1)) - 1), return_inverse=True)
            by_order.insert(0, (shorter, np.bincount(back, times, len(shorter))))
        logs = Trie([*shared.value, *by_order]).log10(asked) if len(asked) else np.empty(0)
        return pa.RecordBatch.from_arrays([pa.array(asked.view(np.int64)), pa.array(logs)], names=["key", "log"])

    def found(batches):
        _BUILT.clear()
        held, waiting = [], 0
        for batch in batches:
            key, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            held.append((key.view(np.uint64), n))
            waiting += len(key)
            if waiting > GROUP_GRAMS:
                keys, n = (np.concatenate(x) for x in zip(*held, strict=True))
                pairs = keys >> np.uint64(8) & np.uint64(0xFFFF)
                cut = int(np.argmax(pairs == pairs[-1]))  # the last group may go on; groups are in one run each
                if cut:
                    yield scored(keys[:cut], n[:cut])
                held, waiting = [(keys[cut:], n[cut:])], 0
        if held:
            yield scored(*(np.concatenate(x) for x in zip(*held, strict=True)))

    dealt = rows.repartition("pair").sortWithinPartitions("pair").select("key", "n")
    return dealt.mapInArrow(found, "key long, log double")


_BUILT: dict = {}


def _tables(shared) -> tuple[Trie, Table, np.ndarray]:
    """The trie and the hot words, built once per worker process. If not all grams are here, only those of full length serve."""
    if shared.value["name"] not in _BUILT:
        _BUILT.clear()
        model = shared.value
        trie = Trie(model["grams"], model["all_grams"])
        if not model["all_here"]:
            trie.grams[:ORDER], trie.contexts = [None] * ORDER, []
        _BUILT[model["name"]] = trie, Table(model["hot"][0]), model["hot"][1]
    return _BUILT[shared.value["name"]]


def score(docs: DataFrame, counts: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, n_tokens, n_known, train_tokens, base_score (add-one unigrams) and score (the trie's log10 probability)."""
    keep = kept_columns(keep, "n_tokens", "n_known", "train_tokens", "base_score", "score")
    model = fit(counts)
    model["name"] = uuid.uuid4().hex
    shared = docs.sparkSession.sparkContext.broadcast(model)  # MAX_GRAMS and HOT_WORDS rows at most
    tokens_seen, distinct, all_here = model["tokens"], model["distinct"], model["all_here"]
    del model
    names = ["n_tokens", "n_hot", "hot_logs", "score", "rare", "far"]

    def scored(batches):
        trie, known, times = _tables(shared)
        for batch in batches:
            for start, end, texts in _parts(batch.column(1)):
                split = [tokens(t) for t in texts]
                keys, first = grams(split)
                here, each = (np.ones(len(keys), bool), trie.log10(keys)) if all_here else trie.whole(keys)
                total = np.add.reduceat(each, first)
                far_ends = np.concatenate(([0], np.cumsum(np.add.reduceat((~here).astype(np.int64), first)))).astype(np.int32)
                far = pa.ListArray.from_arrays(pa.array(far_ends), pa.array(keys[~here].view(np.int64)))
                sizes = np.array([len(ws) + 1 for ws in split], np.int64)
                hashed = word_keys([w for ws in split for w in (*ws, END)])
                row = known.find(hashed)
                hot, at = row >= 0, np.cumsum(sizes) - sizes
                logs = np.where(hot, np.log10(times[row] + 1.0) if len(times) else 0.0, 0.0)
                owner = np.repeat(np.arange(len(split)), sizes)[~hot]
                ends = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(split))))).astype(np.int32)
                rare = pa.ListArray.from_arrays(pa.array(ends), pa.array(hashed[~hot].view(np.int64)))
                columns = [batch.column(0).slice(start, end - start), pa.array(sizes), pa.array(np.add.reduceat(hot.astype(np.int64), at)), pa.array(np.add.reduceat(logs, at)), pa.array(total), rare, far]
                yield pa.RecordBatch.from_arrays(columns, names=["kept", *names])

    rows = docs.select(F.struct(*[F.col(c) for c in keep], F.lit(None).cast("byte").alias(free_name(docs, "_none"))).alias("kept"), F.col(text).alias("text"))
    kinds = "n_tokens long, n_hot long, hot_logs double, score double, rare array<long>, far array<long>"
    found = rows.mapInArrow(scored, with_fields(rows, 1, kinds)).withColumn("_row", F.monotonically_increasing_id())
    found = checkpointed(found)
    rare = found.select("_row", F.explode("rare").alias("key"))
    all_words = counts.filter("kind = 1").select("key", "n")
    seen = rare.join(all_words, "key").groupBy("_row").agg(F.count(F.lit(1)).alias("n_rare"), F.sum(F.log10(F.col("n") + 1.0)).alias("rare_logs"))
    norm = float(np.log10(tokens_seen + distinct + 1))
    joined = found.join(seen, "_row", "left").na.fill({"n_rare": 0, "rare_logs": 0.0})
    log10 = F.col("score")
    if not all_here:
        far = found.select("_row", F.explode("far").alias("key"))
        logs = _far_logs(counts, far.select("key").distinct())
        joined = joined.join(far.join(logs, "key").groupBy("_row").agg(F.sum("log").alias("far_logs")), "_row", "left")
        log10 = F.col("score") + F.coalesce("far_logs", F.lit(0.0))
    return joined.select(
        *[F.col(f"kept.`{c}`").alias(c) for c in keep],
        "n_tokens",
        (F.col("n_hot") + F.col("n_rare")).alias("n_known"),
        F.lit(tokens_seen).cast("long").alias("train_tokens"),
        (F.col("hot_logs") + F.col("rare_logs") - F.col("n_tokens") * norm).alias("base_score"),
        log10.alias("score"),
    )

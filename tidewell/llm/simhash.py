"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within three bits of each other, cut into three blocks, differ in at most two bits
outside the block where they differ most. So every distinct fingerprint, with one block erased,
emits itself and its variants at one bit (half that radius); two such fingerprints meet in at least
one variant. Rows are shuffled on (block, variant); members of a bucket are verified on all 64 bits.

A bucket holds distinct fingerprints within one bit of its variant, so at most 44 * 2^22 of them
however large a group of copies is. Small buckets compare members directly. Large ones compare
values of the erased block: members that share a value are within two bits, values one bit apart
link whole groups, and values two or three bits apart link where their members' flipped bits
allow it. Both ways are exact, and each bucket passes on a spanning set of its links.

Defined results: a null or blank text has fingerprint 0 and links like any other; documents with
one text share a fingerprint, so repeated rows and ids meet in one component; a null id takes part
but is never a component's id unless all its ids are null; an empty table gives an empty table.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, free_name
from .components import components

RADIUS = 3
BLOCKS = ((0, 22), (22, 21), (43, 21))
DIRECT = 1024


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """Majority bits of the XXH64 hashes of all word shingles of a text with A-Z lower-cased."""
    words = (text or "").encode().lower().split()
    n = len(words) - width + 1
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if n <= 1:
        return digest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        to = min(n, at + (1 << 16))
        spans = zip(starts[at:to].tolist(), ends[at + width - 1 : to + width - 1].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], seed) for a, b in spans], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, digest) of every row; fp is the 64 bits as a signed long, digest tells texts of one fingerprint apart."""

    def hashed(batches):
        for batch in batches:
            values = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64)), batch.column(2)], names=["doc_id", "fp", "digest"])

    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("digest"))
    return source.mapInArrow(hashed, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, fp long, digest long")


def _long(value: int) -> str:
    """SQL for 64 bits as a signed long."""
    return f"CAST({value - (1 << 64) if value >> 63 else value} AS BIGINT)"


def _variants(fps: DataFrame) -> DataFrame:
    """(block, variant, fp): each fingerprint with each block erased, as it is and with one other bit flipped."""
    full, forms = (1 << 64) - 1, []
    for k, (at, width) in enumerate(BLOCKS):
        rest = full ^ (((1 << width) - 1) << at)
        flips = [0] + [1 << i for i in range(64) if rest >> i & 1]
        forms += [f"named_struct('k', {k}Y, 'rest', {_long(rest)}, 'flip', {_long(x)})" for x in flips]
    each = fps.select("fp", F.explode(F.expr(f"array({', '.join(forms)})")).alias("f"))
    return each.select(
        F.col("f.k").alias("block"), F.col("fp").bitwiseAND(F.col("f.rest")).bitwiseXOR(F.col("f.flip")).alias("variant"), "fp"
    )


def _settle(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of the component of each of n nodes joined by the links a-b."""
    label = np.arange(n)
    while True:
        before = label.copy()
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
        if np.array_equal(label, before):
            return label


def _masks(width: int, bits: int) -> list[int]:
    return [sum(1 << i for i in c) for c in itertools.combinations(range(width), bits)]


def bucket_links(fps: np.ndarray, block: int, variant: int, direct: int = DIRECT) -> tuple[np.ndarray, np.ndarray]:
    """Links (each member to the least of its component) among distinct fingerprints of one bucket."""
    if len(fps) <= direct:
        a, b = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= RADIUS)
        label = _settle(len(fps), a, b)
    else:
        at, width = BLOCKS[block]
        inside = np.uint64(((1 << width) - 1) << at)
        value = (fps & inside) >> np.uint64(at)
        flip = (fps & ~inside) ^ np.uint64(variant)
        values, group = np.unique(value, return_inverse=True)
        seen = np.zeros(len(values), np.uint64)  # the bits that members flip
        np.bitwise_or.at(seen, group, flip)
        plain = np.zeros(len(values), bool)  # a member flips none
        plain[group[flip == 0]] = True
        links = []
        for bits in (1, 2, 3):
            for mask in _masks(width, bits):
                other = values ^ np.uint64(mask)
                spot = np.minimum(np.searchsorted(values, other), len(values) - 1)
                met = np.nonzero((values[spot] == other) & (values < other))[0]
                to = spot[met]
                if bits == 2:
                    ok = plain[met] | plain[to] | (seen[met] & seen[to] != 0)
                elif bits == 3:
                    ok = (plain[met] & plain[to]) | (seen[met] & seen[to] != 0)
                else:
                    ok = np.ones(len(met), bool)
                links.append(np.stack([met[ok], to[ok]]))
        a, b = np.concatenate(links, axis=1)
        first = np.full(len(values), len(fps))
        np.minimum.at(first, group, np.arange(len(fps)))
        roots = _settle(len(values), a, b)[group]
        least = np.full(len(values), len(fps))
        np.minimum.at(least, roots, np.arange(len(fps)))
        label = least[roots]
    far = np.nonzero(label != np.arange(len(fps)))[0]
    return fps[far], fps[label[far]]


def _pairs(batches):
    """Links among the rows of each (block, variant), which arrive together and sorted."""

    def linked(block, variant, fp):
        edge = np.nonzero((block[1:] != block[:-1]) | (variant[1:] != variant[:-1]))[0] + 1
        starts, ends = np.concatenate(([0], edge)), np.concatenate((edge, [len(fp)]))
        size = ends - starts
        two = starts[size == 2]
        near = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= RADIUS]
        found = [(fp[near], fp[near + 1])]
        found += [bucket_links(fp[s:e], int(block[s]), int(variant[s])) for s, e in zip(starts[size > 2], ends[size > 2], strict=True)]
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        links = np.unique(np.stack([a, b], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(links[:, i].copy().view(np.int64)) for i in (0, 1)], names=["a", "b"])

    held = None
    for batch in batches:
        now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        now = [now[0], now[1].view(np.uint64), now[2].view(np.uint64)]
        if held is not None:
            now = [np.concatenate(x) for x in zip(held, now, strict=True)]
        if not len(now[0]):
            continue
        open_run = (now[0] == now[0][-1]) & (now[1] == now[1][-1])
        cut = len(open_run) - int(np.argmin(open_run[::-1])) if not open_run.all() else 0
        held = [x[cut:] for x in now]
        if cut:
            yield linked(*(x[:cut] for x in now))
    if held is not None and len(held[0]):
        yield linked(*held)


def _rooted(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp, digest) of every row, and (fp, least, root) of every fingerprint, with its least id and its component."""
    hashed = checkpointed(fingerprints(docs, doc_id, text))
    fps = checkpointed(hashed.groupBy("fp").agg(F.min("doc_id").alias("least")))
    dealt = _variants(fps.select("fp")).repartition("block", "variant").sortWithinPartitions("block", "variant", "fp")
    roots = components(dealt.mapInArrow(_pairs, "a long, b long"))
    rooted = fps.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    return hashed, checkpointed(rooted)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every row; ``component_id`` is the least id that links reach."""
    hashed, rooted = _rooted(docs, doc_id, text)
    ids = checkpointed(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    named = checkpointed(rooted.join(ids, "root", "left").select("fp", "component_id"))
    return hashed.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def one_per_component(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each component the document with the least id, once.

    If that id stands on several texts of the component, the one of least fingerprint, then of least hash, stays. An id may
    stay in several components. Rows without an id cannot be named by a component: they stay, once per text.
    """
    hashed, rooted = _rooted(docs, doc_id, text)
    digest = free_name(docs, "_digest")
    each = hashed.filter("doc_id IS NOT NULL").groupBy("fp").agg(F.min(F.struct("doc_id", "fp", "digest")).alias("first"))
    first = each.join(rooted.select("fp", "root"), "fp").groupBy("root").agg(F.min("first").alias("first"))
    keys = checkpointed(first.select(F.col("first.doc_id").alias(doc_id), F.col("first.digest").alias(digest)).distinct())
    stay = docs.withColumn(digest, F.xxhash64(text)).join(keys, [doc_id, digest], "left_semi").dropDuplicates([doc_id, digest])
    return stay.select(*docs.columns).unionByName(docs.filter(F.col(doc_id).isNull()).dropDuplicates([text]))

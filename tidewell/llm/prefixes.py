"""Prefix trie of conversations by chained digests.

Every conversation's turns are chained: the digest of a prefix is SHA-256 over the digest of the prefix before it and the digest
of its last turn. All prefixes of all conversations are exploded to rows, and a trie node is a group of rows with one (depth, digest).

Subtree sums come from exploding nodes to their ancestors. The nodes that have conversation m as their least member are the end of
m's path, so they are summed along it first (a running sum); above them, m's rows carry the whole to every ancestor. So there
are never more rows than prefixes, and equal conversations, however many, add one path.

Only digests and byte counts travel, texts never do. A chain is followed row by row over sorted rows, and the ids that end at a node are
hashed in blocks of ``BLOCK`` ids, so no task holds a conversation or a group of copies.

Defined results: a null role or text is empty; turns without a number come first; ties of turn go by role, then by the turn's
digest, so repeated rows count as turns of their own; rows without a conversation id belong to none; a conversation of one row is a
conversation; an empty table gives an empty table, without a root; columns other than the four are not looked at.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

ROOT = hashlib.sha256(b"").digest()
BLOCK = 4096


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, at, unit, bytes): each turn's place from 1, digest and text length in UTF-8."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    framed = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.unhex(F.sha2(framed, 256)).alias("unit"), F.octet_length(text).cast("long").alias("bytes")
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "unit")
    return rows.select("conv_id", F.row_number().over(order).cast("long").alias("at"), "unit", "bytes")


def rebuilt(rows: DataFrame, lender: Column, lent: Column, most: int) -> DataFrame:
    """(conv_id, part, at, unit, bytes): ``rows`` with each conversation's first ``lent`` turns taken from the conversation ``lender``.

    Both are expressions of ``conv_id``; ``lent`` is ``most`` at most. Part 0 holds lent turns, part 1 own ones, and a row of part -1
    stands for the conversation itself, so that one without turns is there as well.
    """
    each = rows.filter("at = 1").select("conv_id", lender.alias("lender"), lent.alias("lent"))
    head = rows.filter(F.col("at") <= most).groupBy(F.col("conv_id").alias("lender"))
    head = head.agg(F.sort_array(F.collect_list(F.struct("at", "unit", "bytes"))).alias("head"))  # ``most`` structs at most
    opened = each.join(head, "lender", "left").select("conv_id", F.explode_outer(F.filter("head", lambda x: x["at"] <= F.col("lent"))).alias("x"))
    opened = opened.filter("x IS NOT NULL").selectExpr("conv_id", "0 AS part", "x.at AS at", "x.unit AS unit", "x.bytes AS bytes")
    own = rows.filter(F.col("at") > lent).selectExpr("conv_id", "1 AS part", "at", "unit", "bytes")
    marks = each.selectExpr("conv_id", "-1 AS part", "0L AS at", "CAST(NULL AS BINARY) AS unit", "0L AS bytes")
    return marks.unionByName(opened).unionByName(own)


def prefixes(parts: DataFrame) -> DataFrame:
    """(conv_id, depth, digest, before, bytes, ends): every prefix of every conversation; ``before`` is the digest one turn shorter.

    ``ends`` marks the prefix that is the whole conversation.
    """
    names = ["conv_id", "depth", "digest", "before", "bytes", "ends"]

    def chained(batches):
        held = None  # the last prefix of the open conversation: it ends there, unless another turn follows
        for batch in batches:
            out = []
            conv, part, unit, size = (batch.column(i).to_pylist() for i in (0, 1, 3, 4))
            for c, p, u, n in zip(conv, part, unit, size, strict=True):
                if p < 0:
                    if held:
                        out.append((*held, True))
                    held = (c, 0, ROOT, None, 0)
                else:
                    out.append((*held, False))
                    held = (c, held[1] + 1, hashlib.sha256(held[2] + u).digest(), held[2], n)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), TYPES, strict=True)], names=names)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*held, True), TYPES, strict=True)], names=names)

    dealt = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part", "at")
    return dealt.mapInArrow(chained, "conv_id long, depth long, digest binary, before binary, bytes long, ends boolean")


TYPES = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_())


def _member_digests(ended: DataFrame) -> DataFrame:
    """(depth, digest, ends_sha256) of the nodes at which conversations end: SHA-256 over their ids in order, joined by commas.

    Ids are distinct, so a block of ``BLOCK`` consecutive numbers holds as many at most, and blocks are joined before they meet. SHA-256 reads its
    input in order, so the blocks of one node pass through one task, one at a time.
    """
    block = F.floor(F.col("conv_id") / BLOCK)
    blocks = ended.groupBy("depth", "digest", block.alias("block")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    blocks = blocks.select("depth", "digest", "block", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))

    def hashed(batches):
        key, state = None, None
        for batch in batches:
            out = []
            for depth, digest, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if (depth, digest) != key:
                    if key:
                        out.append((*key, state.hexdigest()))
                    key, state = (depth, digest), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if out:
                yield _named(out)
        if key:
            yield _named([(*key, state.hexdigest())])

    def _named(out):
        kinds = (pa.int64(), pa.binary(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["depth", "digest", "ends_sha256"])

    dealt = blocks.repartition("depth", "digest").sortWithinPartitions("depth", "digest", "block")
    return dealt.mapInArrow(hashed, "depth long, digest binary, ends_sha256 string")


def trie(parts: DataFrame) -> DataFrame:
    """One row per trie node of the conversations in ``parts`` (see ``rebuilt``).

    conv_id is the least member, parent_conv_id the parent's; n_convs counts members, n_children children, n_leaves the childless nodes of the
    subtree; saved_tokens sums (n_convs - 1) times the bytes of the last text over the subtree; ends_sha256 digests the ids that end here.
    """
    paths = checkpointed(prefixes(parts))
    nodes = paths.groupBy("depth", "digest").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.count_if("ends").alias("n_ends"), F.min("before").alias("before"), F.min("bytes").alias("bytes")
    )
    # A node is childless if all its members end there.
    saved, leaf = (F.col("n_convs") - 1) * F.col("bytes"), F.expr("CAST(n_ends = n_convs AS BIGINT)")
    path = Window.partitionBy("conv_id")
    down = path.orderBy("depth")
    above = down.rowsBetween(Window.unboundedPreceding, -1)
    nodes = nodes.withColumns({"_saved": saved, "_leaf": leaf}).withColumns(
        {f"{n}{k}": F.sum(f"_{n}").over(w) for n in ("saved", "leaf") for k, w in (("_all", path), ("_above", above))} | {"place": F.row_number().over(down)}
    )
    nodes = nodes.selectExpr(
        "depth", "digest", "conv_id", "n_convs", "before", "place = 1 AS top", "saved_all", "leaf_all",
        "saved_all - coalesce(saved_above, 0) AS saved", "leaf_all - coalesce(leaf_above, 0) AS leaves",
    )
    nodes = checkpointed(nodes)
    tops = nodes.filter("top").selectExpr("conv_id", "depth AS top_depth", "saved_all", "leaf_all").filter("saved_all <> 0 OR leaf_all <> 0")
    up = paths.select("conv_id", "depth", "digest").join(tops, "conv_id").filter("depth < top_depth").selectExpr("depth", "digest", "saved_all AS saved", "leaf_all AS leaves", "0L AS child")
    children = nodes.filter("depth > 0").selectExpr("depth - 1 AS depth", "before AS digest", "0L AS saved", "0L AS leaves", "1L AS child")
    own = nodes.selectExpr("depth", "digest", "saved", "leaves", "0L AS child")
    sums = own.unionByName(up).unionByName(children).groupBy("depth", "digest").agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"), F.sum("child").alias("n_children"))
    # Below its top, a node of m's path has a parent on m's path.
    parents = nodes.filter("top").selectExpr("depth", "digest", "before", "depth - 1 AS parent_depth").join(
        nodes.selectExpr("depth AS parent_depth", "digest AS before", "conv_id AS parent_id"), ["parent_depth", "before"]
    )
    ended = _member_digests(paths.filter("ends").select("depth", "digest", "conv_id"))
    found = nodes.select("depth", "digest", "conv_id", "n_convs", "top").join(sums, ["depth", "digest"])
    found = found.join(parents.select("depth", "digest", "parent_id"), ["depth", "digest"], "left").join(ended, ["depth", "digest"], "left")
    parent = F.when(F.col("depth") > 0, F.when(F.col("top"), F.col("parent_id")).otherwise(F.col("conv_id")))
    return found.select(
        "conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )

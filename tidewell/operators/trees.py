"""Markdown trees: sharing filter, packing of long texts.

Ownership of nested lines needs a look at what stands above each line, so these run per document in
Arrow batches; a document is one value, as long as its notes are.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.text import default_fields, entry_id, entry_kind, has_visible_content, is_stale, metadata, metadata_comment, strip
from tidewell.operators.sections import entries, sections
from tidewell.sources.sinks import written

_COMMENT = re.compile(r"\s*<!--om:\s*(.*?)\s*-->\s*$")
_BULLET = re.compile(r"^(\s*)(?:[-*]|\d+[.)])\s+")
_HEADING = re.compile(r"^(#{1,6})\s+\S")
SHAREABLE = frozenset({"cluster"})


def _scope(line: str) -> str | None:
    found = _COMMENT.search(line)
    fields = dict(t.split("=", 1) for t in found.group(1).split() if "=" in t) if found else {}
    return fields.get("scope")


def _depth(line: str) -> int:
    return len(line.expandtabs(4)) - len(line.expandtabs(4).lstrip())


def shareable_text(text: str | None) -> str | None:
    """A text without entries that may not leave the host.

    An entry owns the lines below it that are indented deeper, and lines without a marker that follow
    directly. A withheld entry takes what it owns along, but for nested entries with a scope of their own
    that passes. Headings with nothing left below them go.
    """
    if text is None:
        return None
    kept: list[str] = []
    owners: list[tuple[int, bool]] = []  # (indent, withheld) of the open entries
    after_blank = True
    for line in text.split("\n"):
        bullet, head = _BULLET.match(line), _HEADING.match(line)
        if not line.strip():
            after_blank = True
            kept.append(line)
            continue
        depth = _depth(line)
        if head:
            owners = []
        elif bullet:
            owners = [o for o in owners if o[0] < depth]
        elif after_blank:
            owners = [o for o in owners if o[0] < depth]
        after_blank = False
        inherited = owners[-1][1] if owners else False
        scope = _scope(line)
        withheld = (scope not in SHAREABLE) if scope is not None else inherited
        if bullet:
            owners.append((depth, withheld))
        if not withheld:
            kept.append(line)
    return _without_empty_headings(kept)


def _without_empty_headings(lines: list[str]) -> str:
    out: list[str] = []
    alive = 7  # the highest level of heading that what follows keeps alive; 7: none
    content = False
    for line in reversed(lines):
        head = _HEADING.match(line)
        if head:
            level = len(head.group(1))
            if content or level < alive:
                out.append(line)
                content, alive = False, level
            continue
        if line.strip() and not line.lstrip().startswith("<!--"):
            content = True
        out.append(line)
    return "\n".join(reversed(out))


def _per_text(docs: DataFrame, text: str, make: Callable[[str | None], str | None]) -> DataFrame:
    at, schema = docs.columns.index(text), docs.schema

    def run(batches):
        for batch in batches:
            made = pa.array([make(t) for t in batch.column(at).to_pylist()], pa.string())
            yield batch.set_column(at, text, made)

    return docs.mapInArrow(run, schema)


def for_sharing(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with each text filtered by ``shareable_text``."""
    return _per_text(docs, text, shareable_text)


def reassembled(found: DataFrame) -> DataFrame:
    """(doc, text): the sections of each document in order, with their headings."""
    whole = F.when(F.col("heading").isNull(), F.col("body")).otherwise(F.concat(F.lit("## "), "heading", F.lit("\n"), "body"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ord", whole.alias("b")))), lambda x: x["b"])
    return found.groupBy("doc").agg(F.array_join(ordered, "\n").alias("text"))


def pruned(docs: DataFrame, now: Column, ttl_days: int = 14, action: str = "stale-section") -> DataFrame:
    """Snapshot entries with what happens to them: kept, or, once ``ttl_days`` old, ``drop``, ``annotate`` or ``stale-section``."""
    if action not in ("stale-section", "drop", "annotate"):
        raise ValueError(action)
    rows = entries(docs)
    seen = F.try_to_timestamp(F.try_element_at(F.col("meta"), F.lit("last_seen")))
    old = (F.try_element_at(F.col("meta"), F.lit("kind")) == "snapshot") & (F.lower("section") != "stale snapshots") & is_stale(seen, now, ttl_days)
    return rows.withColumn("action", F.when(F.coalesce(old, F.lit(False)), action).otherwise("keep"))


def packed_pieces(text: str | None, budget: int) -> list[str]:
    """A text cut into pieces of ``budget`` characters at most: at dated sections, then at lines, then anywhere."""
    parts = re.split(r"(?m)^(?=## \d{4}-\d{2}-\d{2})", text or "")
    small: list[str] = []
    for p in parts:
        lines = p.splitlines(keepends=True) if len(p) > budget else [p]
        for line in lines:
            small += [line[i : i + budget] for i in range(0, len(line), budget)]
    out, now = [], ""
    for p in small:
        if now and len(now) + len(p) > budget:
            out.append(now)
            now = ""
        now += p
    return [*out, now] if now else out


def chunked(docs: DataFrame, budget: int, doc: str = "doc", text: str = "text") -> DataFrame:
    """(doc, piece, text): each text in pieces of ``budget`` characters at most."""
    source = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text"))

    def run(batches):
        for batch in batches:
            ids, n, pieces = [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = packed_pieces(t, budget)
                ids += [i] * len(found)
                n += range(len(found))
                pieces += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), pa.array(n, pa.int64()), pa.array(pieces, pa.string())], names=["doc", "piece", "text"])

    return source.mapInArrow(run, f"doc {source.schema['doc'].dataType.simpleString()}, piece long, text string")


def shared_sections(docs: DataFrame) -> DataFrame:
    """Second-level sections of the shareable texts."""
    return sections(for_sharing(docs))


def block_tree(docs: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """(doc, line_no, depth, parent, kind): every line that is not blank, with the line of the entry or heading that owns it (null at the top).

    An entry owns deeper lines, and lines without a marker that follow directly; a heading owns what comes before the next one of its level or above.
    """
    source = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text"))

    def rows(text: str | None):
        heads: list[tuple[int, int]] = []
        owners: list[tuple[int, int]] = []
        blank = True
        for n, line in enumerate((text or "").split("\n"), 1):
            if not line.strip():
                blank = True
                continue
            head, bullet, depth = _HEADING.match(line), _BULLET.match(line), _depth(line)
            if head:
                level = len(head.group(1))
                heads, owners = [h for h in heads if h[0] < level], []
                yield n, 0, heads[-1][1] if heads else None, "heading"
                heads.append((level, n))
            else:
                if bullet or blank:
                    owners = [o for o in owners if o[0] < depth]
                owner = owners[-1][1] if owners else (heads[-1][1] if heads else None)
                yield n, depth, owner, "entry" if bullet else "text"
                if bullet:
                    owners.append((depth, n))
            blank = False

    def run(batches):
        for batch in batches:
            ids, found = [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = list(rows(t))
                ids += [i] * len(own)
                found += own
            columns = [pa.array([r[k] for r in found], kind) for k, kind in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.string()))]
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), *columns], names=["doc", "line_no", "depth", "parent", "kind"])

    return source.mapInArrow(run, f"doc {source.schema['doc'].dataType.simpleString()}, line_no int, depth int, parent int, kind string")


def with_metadata(lines: DataFrame, now: Column, node: str) -> DataFrame:
    """Bullet lines (doc, line_no, line, section) with a metadata comment that has all default fields; what is there already stays as it is."""
    bare = strip(F.regexp_replace("line", r"(?s)\s*<!--om:.*$", ""))
    body = F.regexp_replace(bare, r"^[-*]\s+", "")
    own = metadata(F.col("line"))
    rows = lines.select("*", F.explode(F.array(F.coalesce(F.try_element_at(own, F.lit("kind")), entry_kind(body, F.col("section"))))).alias("_kind"))
    more = F.create_map(F.lit("id"), entry_id(body), F.lit("kind"), F.col("_kind"), F.lit("last_seen"), F.date_format(now, "yyyy-MM-dd"), F.lit("node"), F.lit(node))
    every = F.map_concat(F.map_filter(F.map_concat(default_fields(F.col("_kind")), more), lambda k, v: ~F.map_contains_key(own, k)), own)
    return rows.withColumn("line", F.concat(bare, F.lit(" "), metadata_comment(every))).drop("_kind")


def shareable_hits(hits: DataFrame, docs: DataFrame, most: int = 500) -> DataFrame:
    """Hits (query_id, rank, doc_id) with the start of what their documents (doc_id, content) may share; those with nothing left but headings go."""
    hits = written(hits, "hits")
    # Only the texts of hits go through the sharing filter; a query's hits are few.
    docs = docs.select("doc_id", "content").join(F.broadcast(hits.select("doc_id").distinct()), "doc_id", "left_semi")
    shared = for_sharing(docs, "content")
    kept = shared.filter(has_visible_content(F.coalesce("content", F.lit(""))))
    return hits.join(kept.select("doc_id", F.substring(strip(F.col("content")), 1, most).alias("content")), "doc_id")

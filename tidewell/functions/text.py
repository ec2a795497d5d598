"""Text expressions. Each takes and returns columns and stays inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that a search ignores.
STOPWORDS = (
    "the", "a", "an", "is", "are", "was", "were", "in", "on", "at", "to", "for", "of", "and", "or", "but", "not", "with", "by", "from",
)
#: The order of metadata keys in a comment.
METADATA_KEYS = (
    "id", "kind", "mode", "source_type", "confidence", "sensitivity", "actionability", "last_seen", "last_verified",
    "expires", "seen_count", "node", "scope",
)
#: Words that decide an entry's kind; the first kind with a hit holds.
KIND_WORDS = (
    ("mode", ("working mode", "execution mode", "launch mode", "mode:")),
    ("identity", ("identity", "name:", "role:")),
    ("policy", ("policy", "must not", "never ", "requires explicit approval")),
    ("preference", ("preference", "prefers", "communication")),
    (
        "snapshot",
        ("pr #", "issue #", "branch", "commit", "sha", "pending", "approved", "merged", "current", "today", "yesterday"),
    ),
    ("task", ("task", "todo", "open question")),
    ("decision", ("decision", "decided")),
)
#: How actionable each kind is; other kinds are medium.
ACTIONABILITY = {"identity": "high", "policy": "high", "mode": "high", "snapshot": "low"}
HIGH_STAKES = ("identity", "preference", "policy", "decision", "mode")
PERSONAL = ("identity", "policy")

BLANKS = "[\\s\\x1c-\\x1f]"


def strip(text: Column) -> Column:
    """Without Unicode white space at either end. ASCII blanks go first, so that few texts need a pattern to run over all of them."""
    ends = lambda t: F.concat(F.left(t, F.lit(1)), F.right(t, F.lit(1)))
    rest = lambda t: F.when(ends(t).rlike(f"(?U){BLANKS}"), F.regexp_replace(t, f"(?U)^{BLANKS}+|{BLANKS}+$", "")).otherwise(t)
    # The lambda binds the trimmed text, which is named five times.
    return F.get(F.transform(F.array(F.btrim(text, F.lit(" \t\n\x0b\f\r\x1c\x1d\x1e\x1f"))), rest), F.lit(0))


def search_tokens(text: Column) -> Column:
    """Lower-cased words (letters, digits, underscore) in order, with repeats, without stop words."""
    spaced = F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}_\\s]", " ")
    return F.filter(F.split(spaced, "\\s+"), lambda w: (w != "") & ~w.isin(*STOPWORDS))


def slug(text: Column, empty: str = "section") -> Column:
    """Lower-case letters and digits joined by hyphens; ``empty`` if none."""
    core = F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(core == "", F.lit(empty)).otherwise(core)


def comparable(text: Column) -> Column:
    """Text without differences that do not change its meaning: quotes, dashes, emphasis, spaces, final marks, case."""
    plain = F.translate(text, "\u2018\u2019\u201c\u201d\u2013\u2014*`", "''\"\"--")
    plain = strip(F.regexp_replace(plain, f"(?U){BLANKS}+", " "))
    return F.lower(F.regexp_replace(plain, "[.,;:!?]+$", ""))


def bullet_key(line: Column) -> Column:
    """What two sightings of a bullet share: no marker, priority dot, emphasis, metadata, freshness note or case."""
    shown = F.regexp_replace(line, "(?s)<!--om:.*$", "")
    shown = strip(F.regexp_replace(shown, "(?i)\\s*\\(as of [^)]*verify\\)", ""))
    shown = F.regexp_replace(shown, "^[-*]\\s+", "")
    shown = F.regexp_replace(shown, "[\U0001f534\U0001f7e1\U0001f7e2\u26aa\ufe0f\U0001f535\U0001f7e0*`]", "")
    return F.lower(strip(F.regexp_replace(shown, "\\s+", " ")))


def metadata(line: Column) -> Column:
    """Map of the ``<!--om: k=v ...-->`` comment that ends a line; the last of equal keys holds. Empty without one."""
    inside = F.regexp_extract(line, "<!--om:\\s*(.*?)\\s*-->\\s*$", 1)
    pairs = F.filter(F.split(inside, "\\s+"), lambda t: t.rlike("^[^=]+="))
    entries = F.transform(
        pairs, lambda t: F.struct(F.substring_index(t, "=", 1).alias("key"), F.regexp_replace(t, "^[^=]+=", "").alias("value"))
    )
    last = F.filter(
        entries,
        lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"]),
    )
    return F.map_from_entries(last)


def metadata_comment(fields: Column) -> Column:
    """The comment for a map: known keys in their order, then the others by name."""
    known = F.array(*[F.lit(k) for k in METADATA_KEYS])
    keys = F.concat(
        F.filter(known, lambda k: F.map_contains_key(fields, k)), F.array_sort(F.array_except(F.map_keys(fields), known))
    )
    pairs = F.transform(keys, lambda k: F.concat(k, F.lit("="), F.element_at(fields, k)))
    return F.concat(F.lit("<!--om: "), F.array_join(pairs, " "), F.lit("-->"))


def entry_kind(body: Column, section: Column) -> Column:
    """Kind of an entry by the words in its section and body."""
    both = F.lower(F.concat_ws(" ", section, body))
    kind = None
    for name, words in KIND_WORDS:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(both, F.lit(w))
        kind = F.when(hit, name) if kind is None else kind.when(hit, name)
    return kind.otherwise("evergreen")


def default_fields(kind: Column) -> Column:
    """Metadata map of an entry that has none, by its kind."""
    personal = F.when(kind.isin(*PERSONAL), "personal").otherwise("normal")
    pairs = {"source_type": F.lit("inferred"), "confidence": F.lit("medium"), "sensitivity": personal, "actionability": actionability(kind), "seen_count": F.lit("1")}
    return F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)])


def actionability(kind: Column) -> Column:
    out = None
    for name, level in ACTIONABILITY.items():
        out = F.when(kind == name, level) if out is None else out.when(kind == name, level)
    return out.otherwise("medium")


def reviewable(scope: Column, kind: Column, action: Column) -> Column:
    """Entries worth a comparison: shared, lasting, and of high stakes or high actionability."""
    return ~(F.coalesce(scope == "local", F.lit(False)) | (kind == "snapshot")) & (kind.isin(*HIGH_STAKES) | (action == "high"))


def shareable(scope: Column) -> Column:
    """No scope passes; a scope passes if it is ``cluster``; all others, the empty one too, are withheld."""
    return scope.isNull() | (scope == "cluster")


def entry_id(body: Column) -> Column:
    return F.concat(F.lit("ome_"), F.substring(F.sha2(strip(body), 256), 1, 16))


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("long")


def number(raw: Column) -> Column:
    """A number with ``_`` or ``,`` between digits and ``$`` before it; null if it is none."""
    return F.regexp_replace(F.regexp_replace(strip(raw), "[_,]", ""), "^\\$+", "").try_cast("double")


def duration_seconds(raw: Column) -> Column:
    """Seconds of ``90``, ``90s``, ``15m``, ``2h`` or ``7d``; null if it is none of these."""
    text = F.lower(strip(raw))
    unit = F.regexp_extract(text, "^[0-9]+([smhd]?)$", 1)
    times = F.when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86400).otherwise(1)
    return F.when(text.rlike("^[0-9]+[smhd]?$"), F.regexp_extract(text, "^([0-9]+)", 1).try_cast("long") * times)


def is_id(text: Column, prefix: str) -> Column:
    """Whether a text is ``prefix`` and 64 lower-case hexadecimal digits, and nothing else."""
    return F.coalesce(text.rlike(f"^\\Q{prefix}\\E[0-9a-f]{{64}}\\z"), F.lit(False))


def id_of_hex_name(name: Column) -> Column:
    """Invert ``hex_name``; names that are not hexadecimal are read as URL-safe base64 without padding; null if neither is."""
    stem = F.regexp_replace(name, "\\.md$", "")
    plain = F.translate(stem, "-_", "+/")
    padded = F.rpad(plain, F.ceil(F.length(plain) / 4).cast("int") * 4, "=")
    by_hex = F.when(stem.rlike("^(?:[0-9a-f]{2})+$"), F.try_validate_utf8(F.unhex(stem)))
    by_base64 = F.when(plain.rlike("^[A-Za-z0-9+/]+$") & (F.length(plain) % 4 != 1), F.try_validate_utf8(F.unbase64(padded)))
    return F.coalesce(by_hex, by_base64)


def total_tokens(prompt: Column, completion: Column, total: Column) -> Column:
    """The given total, else the sum of what is known of both parts; null if nothing is."""
    both = F.coalesce(prompt, F.lit(0)) + F.coalesce(completion, F.lit(0))
    return F.coalesce(total, F.when(prompt.isNotNull() | completion.isNotNull(), both))


def canonical_json(fields: Column) -> Column:
    """A map<string,string> as JSON without spaces, keys sorted, other than ASCII kept."""
    quote = lambda x: F.regexp_replace(F.to_json(F.array(x)), "^\\[|\\]$", "")
    pairs = F.transform(F.array_sort(F.map_keys(fields)), lambda k: F.concat(quote(k), F.lit(":"), quote(F.element_at(fields, k))))
    return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))


def typed_metadata(value: Column) -> Column:
    """The number that a metadata text of digits stands for, else null."""
    return F.when(value.rlike("^[0-9]+$"), value.try_cast("long"))


def without_metadata(text: Column) -> Column:
    return F.regexp_replace(text, "(?s)[ \t]*<!--om:.*?-->", "")


def has_visible_content(body: Column) -> Column:
    """Whether a line is neither blank, nor a heading, nor a comment."""
    return F.exists(F.split(body, "\n"), lambda x: strip(x).rlike("^(?!#|<!--)."))


def name_tokens(text: Column) -> Column:
    """Distinct slugs of three letters or more of the names in a text: compounds whole and in parts, sorted."""
    names = F.regexp_extract_all(text, F.lit("[A-Za-z0-9][A-Za-z0-9_./-]*"), 0)
    every = F.concat(names, F.flatten(F.transform(names, lambda n: F.split(n, "[/.-]"))))
    return F.array_sort(F.array_distinct(F.filter(F.transform(every, lambda n: slug(n, "")), lambda x: F.length(x) >= 3)))


def shown_bytes(n: Column) -> Column:
    """412 B, 37.2 KB, 1.4 MB."""
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1024 * 1024, F.format_string("%.1f KB", F.bround(n / 1024, 1)))
        .otherwise(F.format_string("%.1f MB", F.bround(n / (1024 * 1024), 1)))
    )


def shown_usd(x: Column) -> Column:
    """Dollars with two decimals, four for less than a cent; a dash for what is unknown."""
    small = (x > 0) & (x < 0.01)
    return F.coalesce(F.concat(F.lit("$"), F.when(small, F.format_number(x, 4)).otherwise(F.format_number(x, 2))), F.lit("\u2014"))


def noted_freshness(line: Column, last_seen: Column, now: Column, days: int) -> Column:
    """A line with a note of its age before its metadata, if ``last_seen`` is ``days`` old; lines with such a note stay."""
    shown, meta = F.regexp_replace(line, "(?s)<!--om:.*$", ""), F.regexp_extract(line, "(?s)<!--om:.*$", 0)
    old = last_seen.isNotNull() & (F.floor((now.cast("double") - last_seen.cast("double")) / 86400) >= days)
    note = F.concat(F.lit(" (as of "), F.date_format(last_seen, "yyyy-MM-dd"), F.lit(" \u2014 verify)"))
    return F.when(old & ~F.contains(F.lower(shown), F.lit("as of")), F.concat(F.regexp_replace(shown, "\\s+$", ""), note, meta)).otherwise(line)


def stamped(text: Column, updated: Column, reflected: Column) -> Column:
    """A note with its *Last updated* and *Last reflected* lines set: the first ones replaced, missing ones put in below the title."""
    up, re_ = (F.concat(F.lit(f"*Last {k}: "), v, F.lit("*")) for k, v in (("updated", updated), ("reflected", reflected)))
    has = lambda k: text.rlike(f"(?m)^\\*Last {k}:[^\n]*\\*$")

    def first(t: Column, k: str, new: Column) -> Column:
        mark = f"(?s)\\A(.*?)(?m:^\\*Last {k}:[^\n]*\\*$)"
        start = F.regexp_extract(t, mark, 1)
        whole = F.regexp_extract(t, mark, 0)
        return F.when(whole != "", F.concat(start, new, F.substr(t, F.length(whole) + 1))).otherwise(t)

    both = F.concat(up, F.lit("\n"), re_)
    title = F.regexp_extract(text, "\\A#[^\n]*\n", 0)
    added = F.when(title != "", F.concat(title, F.lit("\n"), both, F.lit("\n"), F.substr(text, F.length(title) + 1))).otherwise(text)
    return (
        F.when(has("updated") & has("reflected"), first(first(text, "updated", up), "reflected", re_))
        .when(has("updated"), first(text, "updated", both))
        .when(has("reflected"), F.when(title != "", first(text, "reflected", re_)).otherwise(first(text, "reflected", re_)))
        .otherwise(added)
    )


def last_reflected(text: Column) -> Column:
    """The date of the *Last reflected* line."""
    return F.regexp_extract(text, "(?m)^\\*Last reflected: (\\d{4}-\\d{2}-\\d{2})", 1).try_cast("date")


def last_updated(text: Column) -> Column:
    """The time of the *Last updated* line, null for ``never`` and what is no time."""
    raw = F.regexp_extract(text, "(?m)^\\*Last updated: (\\d{4}-\\d{2}-\\d{2} \\d{2}:\\d{2}) UTC\\*$", 1)
    return F.try_to_timestamp(F.nullif(raw, F.lit("")), F.lit("yyyy-MM-dd HH:mm"))


def merged_observations(old: Column, new: Column, today: Column) -> Column:
    """A note after a run: the new text alone if it has a section of today (it then holds all of it), else the old one with the new text below."""
    whole = F.contains(new, F.concat(F.lit("## "), today))
    return F.when(whole | (strip(F.coalesce(old, F.lit(""))) == ""), new).otherwise(F.concat(F.regexp_replace(old, "\\s+$", ""), F.lit("\n\n"), new))


def index_status(text: Column) -> Column:
    """struct<documents, vectors, updated> of an external index's status text; null where a line is missing."""
    number = lambda name: F.nullif(F.regexp_extract(text, f"(?mi)^\\s*{name}:\\s*([0-9]+)", 1), F.lit("")).try_cast("long")
    return F.struct(number("documents").alias("documents"), number("vectors").alias("vectors"), F.nullif(F.regexp_extract(text, "(?mi)^\\s*updated:\\s*(\\S+)", 1), F.lit("")).alias("updated"))


def unmatched_tokens(tokens: Column, matched: Column) -> Column:
    return F.array_sort(F.array_except(tokens, matched))


def head_within(text: Column, most: int, mark: str = "\n\n[truncated]") -> Column:
    """The first ``most`` characters, with a mark if any are cut."""
    return F.when(F.length(text) > most, F.concat(F.regexp_replace(F.substring(text, 1, most), "\\s+$", ""), F.lit(mark))).otherwise(text)


def tail_within(text: Column, most: int) -> Column:
    """The last ``most`` characters, from the first line that begins within them; the whole text if it fits."""
    cut = F.right(text, F.lit(most))
    at = F.locate("\n", cut)
    return F.when(F.length(text) <= most, text).otherwise(F.when(at > 0, F.substr(cut, at + 1)).otherwise(cut))


def hex_name(doc_id: Column) -> Column:
    return F.lower(F.hex(F.encode(doc_id, "UTF-8")))


def snippet(text: Column, most: int = 600) -> Column:
    """Stripped text, cut to ``most`` characters with an ellipsis."""
    core = strip(text)
    return F.when(F.length(core) > most, F.concat(F.regexp_replace(F.substring(core, 1, most), "\\s+$", ""), F.lit(" \u2026"))).otherwise(core)


def age_days(ts: Column, now: Column) -> Column:
    """Whole days from ``ts`` to ``now``, rounded down, 0 for the future."""
    return F.greatest(F.floor((now.cast("double") - ts.cast("double")) / 86400), F.lit(0)).cast("long")


def iso_moment(text: Column) -> Column:
    """The time of an ISO date or date and time, in UTC where no zone is given; null for anything else."""
    part = lambda n: F.regexp_extract(text, r"\A(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2})(:\d{2}(?:\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})?)?\z", n)
    other = lambda c, default: F.when(c == "", default).otherwise(c)
    zone = F.regexp_replace(other(part(4), "Z"), r"([+-]\d{2})(\d{2})", "$1:$2")
    return F.when(part(1) != "", F.try_to_timestamp(F.concat(part(1), F.lit("T"), other(part(2), "00:00"), other(part(3), ":00"), zone)))


def is_stale(ts: Column, now: Column, ttl_days: int) -> Column:
    return F.coalesce(F.floor((now.cast("double") - ts.cast("double")) / 86400) >= ttl_days, F.lit(False))


def route_text(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), "[\\s_.-]+", " "))

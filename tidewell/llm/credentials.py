"""Secret scan with guess costs.

Three fixed patterns give the base spans. Beyond them, every value in a credential's context (``password is ...``, ``bearer ...``) is
weighed by the fewest guesses that find it: a dynamic program over the value's positions picks the cheapest segmentation into dictionary words,
dates, repeats of a unit, keyboard walks, runs of neighbouring letters or digits, and single characters by brute force. Values of ``LEAST`` decimal
digits of guesses or more become spans of kind ``context``; cheaper ones are words, placeholders or dates, not secrets.

The dictionary is the corpus's own: its ``DICTIONARY`` most frequent words of letters (counted over all texts, ties by the word),
after the commonest passwords. A word costs its rank. That is the one table that travels to the tasks.

Defined results: a null or empty text has no spans; positions count code points; spans of one start come in the order of the kinds; a
context span never overlaps a base span; repeated rows are scanned row by row; a text of any length is read whole; an empty table gives an
empty table; of ``keep``, columns named like the results give way to them.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept_columns, kept_with_text, with_fields
from .phrases import word_counts

KINDS = ("assign", "access", "hex", "context")
DICTIONARY = 20_000
LEAST = 8.0
#: Decimal digits of guesses that each change of segment costs.
JOIN = 0.3
LONGEST_WORD, LONGEST_UNIT = 24, 16
#: Passwords tried first, rows of keys, characters that stand for letters.
COMMON_PASSWORDS = (
    "password", "qwerty", "admin", "welcome", "letmein", "login", "master", "dragon", "monkey", "shadow", "sunshine", "princess", "football",
    "baseball", "iloveyou", "trustno1", "secret", "changeme", "default", "guest", "root", "test", "user", "example", "sample", "dummy", "none", "null",
    "true", "false", "your", "here", "token", "key", "pass", "passwd", "value", "string", "required", "hidden", "redacted", "placeholder", "hunter",
)
KEY_ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
STANDS_FOR = {"4": "a", "@": "a", "3": "e", "1": "i", "!": "i", "0": "o", "5": "s", "$": "s", "7": "t"}

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # whole runs: what is shorter fails, and a failing run holds no other match
CONTEXT = re.compile(
    r"""(?<![A-Za-z0-9])(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|(?:api|access|private|secret)[_\ -]?key)["'\])]*
        (?:\ *(?:=>|->|:=|[:=])\ *|(?P<prose>\ +(?:is|was|ist|est|es)\ +))["'`(\[]*(?P<value>[^\s"'`<>(),;\[\]]{6,})
      |(?<![A-Za-z0-9])bearer\ +(?P<bearer>[^\s"'`<>(),;\[\]]{6,})""",
    re.ASCII | re.IGNORECASE | re.VERBOSE,
)
_HINTS = ("pass", "pwd", "secret", "token", "credential", "key", "bearer")
_WORDLIKE = re.compile(r"[A-Z]?[^\W\d_A-Z]+(?:[.!?:-]+|$)")
_YEAR = r"(?:19\d\d|20[0-4]\d)"
_MONTH, _DAY = r"(?:0[1-9]|1[0-2])", r"(?:0[1-9]|[12]\d|3[01])"
_SPLIT = r"[-./_ ]?"
#: Forms of a date, and the digits of guesses for each: a year; a day of 150 years, in three orders; a day of a century.
DATES = (
    (re.compile(_YEAR), math.log10(150)),
    *((re.compile(_SPLIT.join(p)), math.log10(150 * 366 * 4)) for p in ((_YEAR, _MONTH, _DAY), (_DAY, _MONTH, _YEAR), (_MONTH, _DAY, _YEAR))),
    *((re.compile("".join(p)), math.log10(100 * 366 * 3)) for p in ((r"\d\d", _MONTH, _DAY), (_DAY, _MONTH, r"\d\d"), (_MONTH, _DAY, r"\d\d"))),
)


@lru_cache(maxsize=1)
def _keys() -> dict[str, tuple[int, int]]:
    """Row and half-step column of each key: a row stands half a key to the right of the one above."""
    return {c: (y, 2 * x + y) for y, row in enumerate(KEY_ROWS) for x, c in enumerate(row)}


def _step(a: str, b: str) -> tuple[int, int] | None:
    """The direction from one key to a neighbouring one, or None."""
    one, two = _keys().get(a.lower()), _keys().get(b.lower())
    if one is None or two is None:
        return None
    move = (two[0] - one[0], two[1] - one[1])
    return move if move in ((0, 2), (0, -2), (1, 1), (1, -1), (-1, 1), (-1, -1)) else None


def brute(c: str) -> float:
    """Digits of guesses for one character by brute force over its class."""
    if c.isascii():
        return math.log10(10 if c.isdigit() else 26 if c.isalpha() else 33)
    return 2.0


def word_cost(piece: str, ranks: dict[str, float]) -> float | None:
    """A dictionary word's rank, with a factor for capitals and one for characters that stand for letters; None for others."""
    low = piece.lower()
    cost = ranks.get(low)
    swapped = 0
    if cost is None:
        plain = "".join(STANDS_FOR.get(c, c) for c in low)
        if plain == low or not (cost := ranks.get(plain)):
            return None
        swapped = sum(a != b for a, b in zip(plain, low, strict=True))
    upper = sum(c.isupper() for c in piece)
    if upper:
        plain_case = upper == len(piece) or upper == 1 and piece[0].isupper()
        cost += math.log10(2) * (1 if plain_case else min(len(piece), 2 * upper))
    return cost + math.log10(2) * swapped


def _walks(s: str, i: int):
    """(end, cost) of keyboard walks and alphabet or digit runs of three or more from i on."""
    turns, last, j = 0, None, i
    while j + 1 < len(s) and (move := _step(s[j], s[j + 1])):
        turns, last, j = turns + (move != last), move, j + 1
        if j - i >= 2:
            yield j + 1, math.log10(47 * (j - i + 1)) + turns * math.log10(6)
    for way in (1, -1):
        j = i
        while j + 1 < len(s) and s[j].isalnum() and ord(s[j + 1]) - ord(s[j]) == way:
            j += 1
            if j - i >= 2:
                yield j + 1, math.log10(2 * (10 if s[i].isdigit() else 26) * (j - i + 1))


def _repeats(s: str, i: int):
    """(end, unit, times) of units that stand two or more times in a row from i on; for a single character three or more."""
    for u in range(1, min(LONGEST_UNIT, (len(s) - i) // 2) + 1):
        unit, times = s[i : i + u], 1
        while s.startswith(unit, i + times * u):
            times += 1
            if times > 2 or u > 1 and times > 1:
                yield i + times * u, unit, times


def guess_digits(s: str, ranks: dict[str, float], deep: bool = True) -> float:
    """Digits of guesses of the cheapest segmentation of ``s``; the unit of a repeat is weighed the same way, without repeats in it."""
    best, units = [0.0] + [math.inf] * len(s), {}
    for i in range(len(s)):
        base = best[i]
        found = [(i + 1, brute(s[i]))]
        for j in range(i + 3, min(len(s), i + LONGEST_WORD) + 1):
            if (cost := word_cost(s[i:j], ranks)) is not None:
                found.append((j, cost + JOIN))
        for form, cost in DATES:
            if m := form.match(s, i):
                found.append((m.end(), cost + JOIN))
        found += [(j, cost + JOIN) for j, cost in _walks(s, i)]
        if deep:
            for j, unit, times in _repeats(s, i):
                if unit not in units:
                    units[unit] = guess_digits(unit, ranks, deep=False)
                found.append((j, units[unit] + math.log10(times) + JOIN))
        for j, cost in found:
            if base + cost < best[j]:
                best[j] = base + cost
    return best[-1]


def _in_order(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    return sorted(spans, key=lambda x: (x[0], KINDS.index(x[2])))


def base_spans(text: str, named: bool = True) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the three fixed patterns: leftmost matches of each that are long enough; of the last two if not ``named``."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6] if named else []
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return _in_order(found + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)])


def context_values(text: str) -> list[tuple[int, int, int, str]]:
    """(start, end, start of the value, value) of each value in a credential's context; what a sentence goes on with must not look like a word."""
    found = []
    for m in CONTEXT.finditer(text):
        kind = "value" if m["value"] is not None else "bearer"
        value = m[kind].rstrip(".!?:")
        if len(value) < 6 or "://" in value or (m["prose"] or kind == "bearer") and _WORDLIKE.fullmatch(value):
            continue
        found.append((m.start(), m.start(kind) + len(value), m.start(kind), value))
    return found


def scan(text: str | None, ranks: dict[str, float]) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, float]]]:
    """All spans (start, end, kind) in order, and (start, end, digits of guesses) of every value in a credential's context."""
    if not text:
        return [], []
    low = text.lower()
    hinted = any(x in low for x in _HINTS)  # every credential's name has one of them, so most texts are not searched for names
    spans, values = base_spans(text, hinted), []
    if hinted:
        taken = list(spans)
        for start, end, at, value in context_values(text):
            digits = guess_digits(value, ranks)
            values.append((at, end, digits))
            if digits >= LEAST and not any(a < end and start < b for a, b, _ in taken):
                spans.append((start, end, "context"))
    return _in_order(spans), values


def dictionary(docs: DataFrame, text: str = "text", size: int = DICTIONARY) -> dict[str, float]:
    """Digits of guesses by rank of the commonest passwords and the ``size`` most frequent words of letters in ``docs``."""
    words = word_counts(docs, text, F.lit("")).filter(F.col("phrase").rlike(rf"^\p{{L}}{{3,{LONGEST_WORD}}}$"))
    words = words.groupBy(F.lower("phrase").alias("word")).agg(F.sum("a").alias("n"))
    ranked = [r["word"] for r in words.orderBy(F.desc("n"), "word").limit(size).collect()]
    return {w: math.log10(k + 2) for k, w in reversed(list(enumerate([*COMMON_PASSWORDS, *ranked])))}


def find_secrets(docs: DataFrame, ranks: dict[str, float], text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, ``spans`` (start, end, kind) and ``values`` (start, end, digits of guesses) of every row."""
    keep = kept_columns(keep, "spans", "values")
    rows, at = kept_with_text(docs, keep, text)
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # DICTIONARY words
    schema = with_fields(rows, len(keep), "spans array<struct<start:long,end:long,kind:string>>, values array<struct<start:long,end:long,digits:double>>")
    kinds = (
        pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])),
        pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("digits", pa.float64())])),
    )

    def scanned(batches):
        own = shared.value
        for batch in batches:
            found = [scan(t.as_py(), own) for t in batch.column(at)]
            columns = [batch.column(i) for i in range(len(keep))]
            for k, kind in enumerate(kinds):
                columns.append(pa.array([[dict(zip(kind.value_type.names, x, strict=True)) for x in f[k]] for f in found], kind))
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "spans", "values"])

    return rows.mapInArrow(scanned, schema)

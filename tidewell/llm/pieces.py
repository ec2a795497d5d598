"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

Distinct words of a batch lie in one flat array of symbols. Each round finds, per word, the adjacent
pair of best rank (leftmost on ties), merges it in all words at once, and compacts the array; words
without a pair leave it. Where no longer piece that begins or ends with the merged one ranks as
high, later merges cannot come before the pair's other occurrences, so these merge in the same
round, leftmost first. Words begin at spaces and line ends, which no piece spans; a model where
one does is encoded text by text. Words of over ``LONG`` symbols go through a heap of pairs in
the same order of merges, as they may need as many rounds as symbols.

Defined results: null is the empty text, encoded as begin and end only; rows are encoded one by
one, whatever their ids; an empty table gives an empty table; of ``keep``, columns named ``ids`` or ``decoded`` give
way to the results; a model that normalises text otherwise than by a leading space is refused.
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept_columns, kept_with_text, with_fields
from .lookup import Table

SPACE = "▁"
LONG = 256
CACHE_WORDS = 200_000
BATCH_BYTES = 1 << 19
_WORD = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
#: Texts that any usual normaliser would change.
PROBES = ("a  b ", "\ufb01\uff21", "A\u0301", "x\ty", "\u00a0z")
_NONE = np.int64(1) << 62


class Coder:
    """Pieces, ranks and pairs of a BPE model with byte fallback, a dummy prefix and no other normalisation."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        if any(sp.normalize(x) != SPACE + x.replace(" ", SPACE) for x in PROBES):
            raise ValueError("the model normalises text by more than a leading space")
        size = sp.get_piece_size()
        special = [sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) for i in range(size)]
        pieces = {sp.id_to_piece(i): i for i in range(size) if not special[i]}
        self.begin, self.end = sp.bos_id(), sp.eos_id()
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.bytes_of = [b"" if special[i] else sp.id_to_piece(i).encode() for i in range(size)]
        for b, i in enumerate(self.byte_ids):
            self.bytes_of[i] = bytes([b])
        self.size = size
        symbols = dict(pieces)  # and characters that only longer pieces have
        for c in sorted({c for p in pieces for c in p}):
            symbols.setdefault(c, size + len(symbols))
        self.char_ids = {s: i for s, i in symbols.items() if len(s) == 1}
        self.strings = {i: s for s, i in symbols.items()}
        self.other = max(symbols.values()) + 1  # a character in no piece
        self.width = self.other + 1
        scores = {p: sp.get_score(i) for p, i in pieces.items()}
        order = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank = np.zeros(self.width, np.int64)
        self.together = np.ones(self.width, bool)
        pairs = {}
        for p, i in pieces.items():
            self.rank[i] = order[scores[p]]
            for k in range(1, len(p)):
                left, right = p[:k], p[k:]
                if left in symbols and right in symbols:
                    pairs[symbols[left] * self.width + symbols[right]] = i
                for part in (left, right):
                    if part in pieces and scores[p] >= scores[part]:
                        self.together[pieces[part]] = False
        keys = np.array(sorted(pairs), np.uint64)
        self.pairs, self.merged = Table(keys), np.array([pairs[int(k)] for k in keys], np.int64)
        self.by_word = not any(SPACE in p.lstrip(SPACE) or ("\n" in p and p != "\n") for p in pieces)
        self.cache: dict[str, bytes] = {}

    def words(self, text: str) -> list[str]:
        if not text:
            return []
        marked = SPACE + text.replace(" ", SPACE)
        return _WORD.findall(marked) if self.by_word else [marked]

    def _join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Piece that each pair makes, or -1."""
        row = self.pairs.find((left * self.width + right).astype(np.uint64))
        return np.where(row >= 0, self.merged[row], -1)

    def _flatten(self, ids: np.ndarray, word: str) -> bytes:
        """Little-endian ids of a word's final symbols; characters without a piece become bytes."""
        out, at = [], 0
        for i in ids.tolist():
            text = self.strings[i] if i != self.other else word[at]
            out += [i] if i < self.size else [self.byte_ids[b] for b in text.encode("utf-8", "replace")]
            at += len(text)
        return np.array(out, "<u4").tobytes()

    def _by_heap(self, word: str) -> bytes:
        ids = [self.char_ids.get(c, self.other) for c in word]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        table = self._pair_dict()
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(i):
            j = after[i]
            if j < len(ids) and (m := table.get(ids[i] * self.width + ids[j])) is not None:
                heapq.heappush(heap, (int(self.rank[m]), i, ids[i], ids[j], m))

        for i in range(len(ids)):
            offer(i)
        while heap:
            _, i, left, right, m = heapq.heappop(heap)
            j = after[i] if i < len(ids) else len(ids)
            if ids[i] != left or j >= len(ids) or ids[j] != right:
                continue
            ids[i], ids[j] = m, -1
            after[i] = after[j]
            if after[i] < len(ids):
                before[after[i]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return self._flatten(np.array([x for x in ids if x >= 0], np.int64), word)

    @lru_cache(maxsize=1)  # noqa: B019
    def _pair_dict(self) -> dict[int, int]:
        filled = self.pairs.rows >= 0
        return dict(zip(self.pairs.keys[filled].tolist(), self.merged[self.pairs.rows[filled]].tolist(), strict=True))

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each word."""
        out: list[bytes] = [b""] * len(words)
        short = [k for k, w in enumerate(words) if len(w) <= LONG]
        for k in (k for k, w in enumerate(words) if len(w) > LONG):
            out[k] = self._by_heap(words[k])
        if not short:
            return out
        lengths = np.array([len(words[k]) for k in short])
        get, other = self.char_ids.get, self.other
        sym = np.array([get(c, other) for k in short for c in words[k]], np.int64)
        word = np.repeat(np.arange(len(short)), lengths)
        joined = np.full(len(sym), -1, np.int64)
        inner = np.nonzero(word[1:] == word[:-1])[0]
        joined[inner] = self._join(sym[inner], sym[inner + 1])
        done = []
        while len(sym):
            starts = np.nonzero(np.concatenate(([True], word[1:] != word[:-1])))[0]
            count = np.diff(np.concatenate((starts, [len(sym)])))
            at = np.arange(len(sym))
            rank = self.rank[joined]
            key = np.where(joined >= 0, rank << 32 | at, _NONE)
            best = np.minimum.reduceat(key, starts)
            live = best < _NONE
            if not live.all():
                over = np.repeat(~live, count)
                done.append((word[over], sym[over]))
                sym, word, joined = sym[~over], word[~over], joined[~over]
                continue
            first = best & ((1 << 32) - 1)
            take = np.zeros(len(sym), bool)
            take[first] = True
            same = (joined >= 0) & (rank == np.repeat(best >> 32, count)) & (joined == np.repeat(joined[first], count))
            same &= self.together[joined]
            run = np.nonzero(same)[0]
            if len(run) > len(first) or not take[run].all():
                head = np.concatenate(([True], np.diff(run) != 1))
                since = run - run[np.maximum.accumulate(np.where(head, np.arange(len(run)), 0))]
                take[run[since % 2 == 0]] = True
            spots = np.nonzero(take)[0]
            sym[spots] = joined[spots]
            stay = np.ones(len(sym), bool)
            stay[spots + 1] = False
            moved = np.cumsum(stay) - 1
            sym, word, joined = sym[stay], word[stay], joined[stay]
            new = moved[spots]
            touched = np.unique(np.concatenate((new, new[new > 0] - 1)))
            joined[touched] = -1
            touched = touched[touched + 1 < len(sym)]
            touched = touched[word[touched] == word[touched + 1]]
            joined[touched] = self._join(sym[touched], sym[touched + 1])
        owner, ids = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(owner, kind="stable")
        owner, ids = owner[order], ids[order]
        ends = np.cumsum(np.bincount(owner, minlength=len(short))).tolist()
        odd = set(np.unique(owner[ids >= self.size]).tolist())
        flat, start = ids.astype("<u4").tobytes(), 0
        for i, end in enumerate(ends):
            out[short[i]] = self._flatten(ids[start:end], words[short[i]]) if i in odd else flat[4 * start : 4 * end]
            start = end
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text with begin and end, as little-endian 32-bit bytes."""
        split = [self.words(t or "") for t in texts]
        cache = self.cache
        new = list({w for ws in split for w in ws if w not in cache})
        if len(cache) + len(new) > CACHE_WORDS:
            cache.clear()
            new = list({w for ws in split for w in ws})
        cache.update(zip(new, self.encode_words(new), strict=True))
        head, tail = (np.array([i], "<u4").tobytes() for i in (self.begin, self.end))
        return [b"".join((head, *map(cache.__getitem__, ws), tail)) for ws in split]

    def decode(self, ids: bytes) -> str:
        """Text of little-endian ids: control ids vanish, byte pieces join to characters, one leading space goes."""
        raw = b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        text = raw.decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=2)
def coder(model: bytes) -> Coder:
    return Coder(model)


def model_bytes(path: str | None = None) -> bytes:
    """The model file, read on the driver (about 0.5 MB travel with the tasks)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def encode_documents(docs: DataFrame, model: bytes, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, ``ids`` (binary, little-endian 32-bit, with begin and end) and ``decoded`` of every row."""
    keep = kept_columns(keep, "ids", "decoded")
    rows, at = kept_with_text(docs, keep, text)

    def coded(batches):
        own = coder(model)
        for batch in batches:
            column = batch.column(at)
            sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
            start = 0
            while start < len(sizes):
                end, size = start, 0
                while end < len(sizes) and (end == start or size + sizes[end] <= BATCH_BYTES):
                    size += sizes[end]
                    end += 1
                ids = own.encode(column.slice(start, end - start).to_pylist())
                columns = [batch.column(i).slice(start, end - start) for i in range(len(keep))]
                columns += [pa.array(ids, pa.binary()), pa.array([own.decode(x) for x in ids], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, "ids", "decoded"])
                start = end

    return rows.mapInArrow(coded, with_fields(rows, len(keep), "ids binary, decoded string"))

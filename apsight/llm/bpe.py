"""Operator 5: byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Boundaries are found without a regex. Each code point gets a class from an
array; a class is a transition function on eight scanner states, functions
compose associatively, and a blocked scan over the composition table gives the
state before every code point of many texts at once. Two things that the
pattern looks ahead for are put into the classes first: whether white space is
the last of its run before a visible character, and whether an apostrophe is
followed by the letters of a contraction. State and class tell whether a
pre-token begins.

The slices go to pair merging by rank, kept in a bounded cache. Beside the ids
the byte offset of every id is retained, so any slice of ids is decoded, and
placed in the text, on its own.

Defined cases: a null text is the empty text (no ids, empty bytes); rows that
share a ``doc_id`` each get a row; an empty table gives none.
"""

from __future__ import annotations

import base64
import heapq
import itertools
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from apsight.llm.common import TwoGenerations, map_documents

# Code point classes.
LETTER, NUMBER, SIGN, SHORT, LONG, SPACE, LAST, INNER, END = range(9)
# SHORT, LONG: an apostrophe before a contraction of one or two letters; SPACE: a blank before a visible character;
# LAST: other white space there; INNER: white space before white space or the end; END: between texts.

# Scanner states after a code point.
FREE, IN_LETTERS, IN_NUMBERS, IN_SIGNS, AFTER_BLANK, ONE_LEFT, TWO_LEFT, IN_SPACE = range(8)

# The Unicode White_Space property and the contractions of the pattern.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]


def _step(state: int, kind: int) -> tuple[int, bool]:
    """(next state, whether a pre-token begins at this code point)."""
    if state == TWO_LEFT and kind == LETTER:
        return ONE_LEFT, False
    if state == ONE_LEFT and kind == LETTER:
        return FREE, False
    if kind in (LETTER, NUMBER, SIGN):
        run = (IN_LETTERS, IN_NUMBERS, IN_SIGNS)[kind]
        return run, state not in (run, AFTER_BLANK)
    if kind in (SHORT, LONG):
        if state in (IN_SIGNS, AFTER_BLANK):
            return IN_SIGNS, False
        return (ONE_LEFT if kind == SHORT else TWO_LEFT), True
    if kind == SPACE:
        return AFTER_BLANK, True
    if kind == INNER:
        return IN_SPACE, state != IN_SPACE
    return FREE, True  # LAST, END


class Scanner:
    """Composition table of the transition functions reachable from the nine classes."""

    BLOCK = 64

    def __init__(self):
        steps = [tuple(_step(s, c)[0] for s in range(8)) for c in range(9)]
        known = {f: i for i, f in enumerate(dict.fromkeys(steps))}
        todo = list(known)
        while todo:  # close the set under composition
            f = todo.pop()
            for g in list(known):
                for h in (tuple(g[x] for x in f), tuple(f[x] for x in g)):
                    if h not in known:
                        known[h] = len(known)
                        todo.append(h)
        functions = list(known)
        self.of_class = np.array([known[f] for f in steps], np.int16)
        self.then = np.array([[known[tuple(g[x] for x in f)] for g in functions] for f in functions], np.int16)
        self.apply = np.array(functions, np.int8)
        self.begins = np.array([[_step(s, c)[1] for c in range(9)] for s in range(8)])

    def states_before(self, kinds: np.ndarray) -> np.ndarray:
        """The state before each code point, from FREE: a scan in blocks, then over the blocks' compositions."""
        n = len(kinds)
        rows = -(-n // self.BLOCK)
        f = np.full(rows * self.BLOCK, self.of_class[END], np.int16)
        f[:n] = self.of_class[kinds]
        f = np.ascontiguousarray(f.reshape(rows, self.BLOCK).T)  # one block per column
        for j in range(1, self.BLOCK):
            f[j] = self.then[f[j - 1], f[j]]
        start = np.zeros(rows, np.int8)
        state = FREE
        for i, g in enumerate(f[-1, :-1].tolist(), start=1):
            state = int(self.apply[g, state])
            start[i] = state
        after = self.apply[f, start[None, :]]
        before = np.empty_like(after)
        before[1:] = after[:-1]
        before[0] = start
        return np.ascontiguousarray(before.T).ravel()[:n]

    def boundaries(self, points: np.ndarray, breaks: np.ndarray) -> np.ndarray:
        """Where pre-tokens (and the breaks between texts) begin in ``points``."""
        kinds = point_classes()[points]
        kinds[breaks] = END
        white = kinds == INNER
        following = np.append(kinds[1:], END)
        last = white & (following != INNER) & (following != END)
        kinds[last] = LAST
        kinds[last & (points == 0x20)] = SPACE
        marks = np.flatnonzero((points == 0x27) & (kinds == SIGN))
        if len(marks):
            ahead = np.append(points, [0, 0])
            a, b = ahead[marks + 1], ahead[marks + 2]
            for letters in CONTRACTIONS:
                hit = a == ord(letters[0])
                if len(letters) == 2:
                    hit &= b == ord(letters[1])
                kinds[marks[hit]] = SHORT if len(letters) == 1 else LONG
        return np.flatnonzero(self.begins[self.states_before(kinds), kinds])


_made: dict = {}


def point_classes() -> np.ndarray:
    """Class of every code point (white space as INNER)."""
    if "classes" not in _made:
        initial = np.full(0x110000, SIGN, np.int8)
        for c in range(sys.maxunicode + 1):
            major = unicodedata.category(chr(c))[0]
            if major == "L":
                initial[c] = LETTER
            elif major == "N":
                initial[c] = NUMBER
        initial[WHITE] = INNER
        _made["classes"] = initial
    return _made["classes"]


def scanner() -> Scanner:
    if "scanner" not in _made:
        _made["scanner"] = Scanner()
    return _made["scanner"]


class BytePairs:
    """Ranks of a byte-level vocabulary (``base64 rank`` lines), cached merging and decoding."""

    #: Pieces kept per generation and worker; longer ones than CACHE_CHARS are not kept.
    CACHE_PIECES, CACHE_CHARS = 300_000, 64
    #: Code points scanned together.
    GROUP = 1 << 18

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.lengths = np.array([len(t) for t in self.tokens], np.uint32)
        self.cache = TwoGenerations(self._encode_piece, self.CACHE_PIECES)

    @classmethod
    def cached(cls, path: str) -> BytePairs:
        if path not in _made:
            _made[path] = cls(path)
        return _made[path]

    def _encode_piece(self, piece: str) -> bytes:
        data = piece.encode()
        whole = self.ranks.get(data)
        if whole is not None:
            return whole.to_bytes(4, "little")
        return np.array(self._merge(data) if len(data) < 100 else self._merge_long(data), "<u4").tobytes()

    def _merge(self, data: bytes) -> list[int]:
        """Join the adjacent pair of lowest rank (leftmost first) until none has a rank."""
        ranks = self.ranks
        parts = [data[i:i + 1] for i in range(len(data))]
        none = len(self.tokens)
        pairs = [ranks.get(a + b, none) for a, b in itertools.pairwise(parts)]
        while pairs:
            low = min(pairs)
            if low == none:
                break
            i = pairs.index(low)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], none)
        return [ranks[p] for p in parts]

    def _merge_long(self, data: bytes) -> list[int]:
        """The same with a heap over a linked list: n log n for long unbroken runs."""
        ranks, n = self.ranks, len(data)
        end = list(range(1, n + 1))  # end of the part that begins here; 0: not a part any more
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not end[i] or end[i] >= n or end[end[i]] != stop:
                continue  # one of the two parts has changed since
            middle = end[i]
            end[i], end[middle] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := ranks.get(data[i:end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := before[i]) >= 0 and (r := ranks.get(data[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i:end[i]]])
            i = end[i]
        return out

    def encode_group(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit bytes."""
        joined = "\n".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1  # where the joining breaks are
        at = scanner().boundaries(points, ends[:-1])
        first = np.searchsorted(at, np.append(0, ends[:-1] + 1)).tolist()
        stop = np.searchsorted(at, ends).tolist()
        cuts = [*at.tolist(), len(joined)]
        pieces = [joined[a:b] for a, b in itertools.pairwise(cuts)]
        cache, most = self.cache, self.CACHE_CHARS
        for a, b in zip(first, stop, strict=True):
            own = pieces[a:b]
            if len(max(own, key=len, default="")) < most:
                yield b"".join(map(cache.__getitem__, own))
            else:
                yield b"".join([cache[p] if len(p) < most else self._encode_piece(p) for p in own])

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Byte offset of the end of each id in the text."""
        return np.cumsum(self.lengths[ids], dtype=np.uint32)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


def grouped(rows: Iterator[tuple], size: int) -> Iterator[list[tuple]]:
    """Consecutive rows (id, text) with about ``size`` code points together, at least one row."""
    held, n = [], 0
    for doc_id, text in rows:
        held.append((doc_id, text or ""))
        n += len(held[-1][1]) + 1
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def encode(docs: DataFrame, ranks: str) -> DataFrame:
    """doc_id, ids and ends (both little-endian unsigned 32-bit): the ids of the text and the byte offset each ends at."""
    def rows(source: Iterator[tuple]) -> Iterator[tuple]:
        pairs = BytePairs.cached(ranks)
        for group in grouped(source, pairs.GROUP):
            for (doc_id, _), data in zip(group, pairs.encode_group([t for _, t in group]), strict=True):
                yield doc_id, data, pairs.offsets(np.frombuffer(data, "<u4")).astype("<u4").tobytes()

    return map_documents(docs, rows, [T.StructField("ids", T.BinaryType()), T.StructField("ends", T.BinaryType())])


def decode(encoded: DataFrame, ranks: str, with_digest: bool = False) -> DataFrame:
    """doc_id and the decoded bytes; with ``with_digest`` also n_tokens and the ids as decimal text's sha256."""
    fields = [T.StructField("decoded", T.BinaryType())]
    if with_digest:
        fields += [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType())]

    def rows(source: Iterator[tuple]) -> Iterator[tuple]:
        import hashlib

        pairs = BytePairs.cached(ranks)
        for doc_id, data in source:
            ids = np.frombuffer(data, "<u4")
            more = (len(ids), hashlib.sha256(" ".join(map(str, ids.tolist())).encode()).hexdigest()) if with_digest else ()
            yield doc_id, pairs.decode(ids), *more

    return map_documents(encoded, rows, fields, columns=("doc_id", "ids"))


def decode_range(docs: DataFrame, ranks: str, first: int, last: int) -> DataFrame:
    """doc_id, the bytes of ids ``first`` to ``last`` (exclusive), and the byte they begin at, from ``encode``'s output."""
    def rows(source: Iterator[tuple]) -> Iterator[tuple]:
        pairs = BytePairs.cached(ranks)
        for doc_id, data, ends in source:
            ids, stop = np.frombuffer(data, "<u4")[first:last], np.frombuffer(ends, "<u4")
            yield doc_id, pairs.decode(ids), int(stop[first - 1]) if 0 < first <= len(stop) else 0

    return map_documents(docs, rows, [T.StructField("decoded", T.BinaryType()), T.StructField("at", T.LongType())],
                         columns=("doc_id", "ids", "ends"))


def sha256(column: str):
    return F.sha2(column, 256)

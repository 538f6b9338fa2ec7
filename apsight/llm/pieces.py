"""Whole texts through the ``tokenizers`` library, one call per distinct piece.

The vocabularies used here split a text before they merge, and never across a
space that stands before a visible character: such a space always begins a new
pre-token (or is dropped). A text is therefore cut before each such space; a
piece's ids are those that the library gives it alone, and are kept in a
bounded cache. A piece of plain letters, with punctuation or a line break
behind, is cut there too (letters and punctuation never share a pre-token) and
its letters go straight to the library's merge model. Whether that shortcut
holds for a vocabulary is tested when it is loaded; if not, it is not used. A
text that holds the content of an added token goes to the library whole.
"""

from __future__ import annotations

import itertools
import os
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_LOOSE = re.compile(r" (?!\S)")
_CUT = re.compile(r" (?=\S)")
#: ASCII punctuation without the apostrophe, which may begin a contraction.
_SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_WORD_AND_SIGNS = "^(?P<word>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<signs>[" + re.escape(_SIGNS) + "]*)$"
_PROBES = ["Straße", "Éa", "the", "ÿÀz", "Xyzzyq", "a", "I"]
#: Pieces that a worker keeps (about 200 bytes each); at a batch that finds more, it begins anew.
CACHE_PIECES = 800_000
#: Code points that are encoded together.
BATCH_CHARS = 1 << 21
#: Longer pieces are not kept.
CACHE_CHARS = 64


def _byte_symbols() -> list[str]:
    """The printable symbol of each byte in byte-level vocabularies: printable Latin-1 stays, the rest follow from 256."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(rest)) for b in range(256)]


def _plain(word: str) -> bool:
    """Letters of ASCII or Latin-1 alone: the same under every normalisation but case."""
    return word.isalpha() and (word.isascii() or max(word) <= "ÿ")


class Kept(dict):
    """Values by key, made when first asked for."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make = make

    def __missing__(self, key: str) -> bytes:
        value = self[key] = self.make(key)
        return value


class PieceEncoder:
    """``encode(text)`` -> ids as little-endian unsigned 32-bit bytes."""

    _made: dict[str, PieceEncoder] = {}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a Spark task is the unit of parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)), re.IGNORECASE) if added else None  # a normaliser may fold case
        start = os.path.commonprefix(added)
        self.added_start = start if start == start.lower() == start.upper() else ""  # what stands in a text that holds one
        self.model = self.tokenizer.model
        self.symbols = str.maketrans(dict(enumerate(_byte_symbols())))
        self.spaced = Kept(self._spaced_piece)  # pieces behind a space, keys without it
        self.bare = Kept(self._bare_piece)  # pieces without a space
        self.direct = next((f for f in (self._after_space, self._lowered) if all(f(p) == self._library(f" {p}") for p in _PROBES)), None)

    @classmethod
    def cached(cls, path: str) -> PieceEncoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _library(self, piece: str) -> bytes:
        return np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()

    def _merge(self, piece: str) -> bytes:
        symbols = piece if piece.isascii() else piece.encode().decode("latin-1")
        return array("I", [t.id for t in self.model.tokenize(symbols.translate(self.symbols))]).tobytes()

    def _after_space(self, word: str) -> bytes:
        return self._merge(f" {word}")

    def _lowered(self, word: str) -> bytes:
        return self._merge(word.lower())

    def _spaced_piece(self, word: str) -> bytes:
        if self.direct:
            core = word.rstrip(_SIGNS)
            if _plain(core):
                return self.direct(word) if core == word else self.spaced[core] + self.bare[word[len(core):]]
            first, line, rest = word.partition("\n")
            if line and rest and _plain(first.rstrip(_SIGNS)) and rest[0].isalpha():
                return b"".join([self.spaced[first], self.bare[line], self.bare[rest]])
        return self._library(f" {word}")

    def _bare_piece(self, piece: str) -> bytes:
        core = piece.rstrip(_SIGNS)
        if self.direct and _plain(core):
            if core != piece:
                return self.bare[core] + self.bare[piece[len(core):]]
            return self._merge(piece) if self.direct == self._after_space else self._lowered(piece)
        return self._library(piece)

    def batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text.

        Arrow numbers the distinct pieces of the batch and takes punctuation off
        plain words, so that Python sees each word of the batch once.
        """
        if len(self.spaced) + len(self.bare) > CACHE_PIECES:
            self.spaced.clear()
            self.bare.clear()
        whole_texts = {i: t for i, t in enumerate(texts) if self._holds_added(t)}
        loose = {i: t for i, t in enumerate(texts) if i not in whole_texts and _LOOSE.search(t)}
        apart = loose.keys() | whole_texts.keys()
        parts = pc.split_pattern(pa.array(["" if i in apart else t for i, t in enumerate(texts)], pa.large_string()), " ")
        begin = parts.offsets.to_numpy()  # every text has a first piece, maybe empty
        coded = parts.flatten().dictionary_encode()
        code = coded.indices.to_numpy().astype(np.int64)
        distinct, n = coded.dictionary, len(coded.dictionary)
        heads = distinct.take(pa.array(code[begin[:-1]])).to_pylist()
        code[begin[:-1]] = n + np.arange(len(texts))  # not behind a space: a piece of its own
        split = pc.extract_regex(distinct, _WORD_AND_SIGNS)
        whole = split.is_null()
        words = pc.if_else(whole, distinct, split.field("word")).dictionary_encode()
        signs = pc.if_else(whole, "", split.field("signs")).dictionary_encode()
        found = self._look_up(words.dictionary.to_pylist())
        first = len(found)
        found += [self.bare[x] if x else b"" for x in signs.dictionary.to_pylist()]
        last = len(found)
        found += [self._library(h) if h else b"" for h in heads]
        both = np.full((n + len(texts), 2), last, np.int64)  # each piece: a word or whole piece, and its signs
        both[:n, 0], both[:n, 1] = words.indices.to_numpy(), signs.indices.to_numpy() + first
        both[n:, 0] = last + np.arange(len(texts))
        found.append(b"")
        both[n:, 1] = len(found) - 1
        taken = pa.array(found, pa.large_binary()).take(pa.array(both[code].ravel()))
        ends = np.frombuffer(taken.buffers()[1], np.int64)[: 2 * len(code) + 1]
        data, bounds = taken.buffers()[2], ends[2 * begin].tolist()
        out = [data[a:b].to_pybytes() if b > a else b"" for a, b in itertools.pairwise(bounds)]
        for i, text in loose.items():
            head, *rest = _CUT.split(text)
            out[i] = (self._library(head) if head else b"") + b"".join(map(self._ids, rest))
        for i, text in whole_texts.items():
            out[i] = self._library(text)
        return out

    def _holds_added(self, text: str) -> bool:
        return self.added is not None and self.added_start in text and self.added.search(text) is not None

    def _look_up(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces behind a space; plain ASCII words that are new go straight to the merge model."""
        cache, tokenize = self.spaced, self.model.tokenize
        lower = self.direct == self._lowered
        mark = self.symbols[ord(" ")]
        found = list(map(cache.get, pieces))
        for i, ids in enumerate(found):
            if ids is None:
                piece = pieces[i]
                if self.direct and len(piece) < CACHE_CHARS and piece.isascii() and piece.isalpha():
                    found[i] = cache[piece] = array("I", [t.id for t in tokenize(piece.lower() if lower else mark + piece)]).tobytes()
                else:
                    found[i] = self._ids(piece)
        return found

    def _ids(self, piece: str) -> bytes:
        """Ids of a piece behind a space."""
        return self.spaced[piece] if len(piece) < CACHE_CHARS else self._library(f" {piece}")

    def __call__(self, text: str) -> bytes:
        return self.batch([text])[0]

    def rows(self, source: Iterator[tuple]) -> Iterator[tuple]:
        """(id, ids) of rows (id, text), in batches of about BATCH_CHARS code points; a null text is empty."""
        for some in by_chars(source, BATCH_CHARS):
            yield from zip([i for i, _ in some], self.batch([t or "" for _, t in some]), strict=True)


def by_chars(rows: Iterator[tuple], size: int) -> Iterator[list[tuple]]:
    """Consecutive rows (id, text), cut when ``size`` code points are reached."""
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += len(row[1] or "") + 1
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held

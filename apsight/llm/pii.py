"""Operator 4: personal data by four patterns and a character-level bidirectional LSTM with CRF transitions.

The network is trained in numpy on labelled spans: the patterns' own findings in
a bounded sample of texts, and written variants that the patterns do not cover
(numbers grouped by other signs, spaced addresses, numbers without a plus),
set into the same texts. Its tags are begin and inside of each kind, and none.

Every text is read in windows of ``WINDOW`` code points that overlap by half.
Each window is decoded by its best path; a span that touches an inner edge of
its window is left to the neighbour. Spans of all windows of a text are then
reconciled together: the set of spans without overlap and with the highest
total score (over none) stays, and of those the ones that no pattern's span
overlaps and that pass their kind's check (digits, Luhn, octets, an at sign)
are added. A window without a digit or at sign cannot yield a span that passes,
so it is not decoded.

Defined cases: a null text is the empty text, without findings; rows that share
a ``doc_id`` each get a row; equal texts give equal spans; an empty table gives
none, and training then uses the variants alone.
"""

from __future__ import annotations

import bisect
import itertools
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from apsight.llm.common import map_documents
from apsight.llm.recurrent import F32, LSTM, Adam, Bidirectional

#: Code points of the widest window that a span is decoded in.
WIDEST = 1 << 14
KINDS = ("email", "ip", "card", "phone")
NONE = 0  # tags: 2k+1 begins kind k, 2k+2 continues it
TAGS = 2 * len(KINDS) + 1

# The base patterns. Digit runs are matched whole, which is what leftmost matching finds.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBER = re.compile(r"[0-9]+")
_TELLING = re.compile(r"[0-9@]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(_NUMBER.findall(text))


def _octet(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or "0") <= 255


def emails(text: str) -> list[Span]:
    """Leftmost matches, found from the at signs: each extends left as far as the last match allows."""
    found, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            found.append(("email", start, free))
        at = text.find("@", max(at + 1, free))
    return found


def base_spans(text: str) -> list[Span]:
    found = emails(text)
    if not _NUMBER.search(text):
        return found
    found += [("ip", *m.span()) for m in _IP.finditer(text) if all(_octet(p) for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return found


def by_place(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


# ---- conditional random field over the network's scores -----------------------------------------------------------

def allowed() -> np.ndarray:
    """0 where a tag may follow, a large penalty where not: only a kind's begin or inside leads to its inside."""
    out = np.zeros((TAGS, TAGS), F32)
    for k in range(len(KINDS)):
        out[:, 2 * k + 2] = -1e4
        out[[2 * k + 1, 2 * k + 2], 2 * k + 2] = 0
    return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


def crf_gradient(scores: np.ndarray, moves: np.ndarray, tags: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log-likelihood of ``tags`` (time, sequences), and its gradients for scores and moves."""
    t, c, n = scores.shape
    a, b = np.empty_like(scores), np.zeros_like(scores)
    a[0] = scores[0]
    for i in range(1, t):
        a[i] = _log_sum(a[i - 1][:, None] + moves[:, :, None], 0) + scores[i]
    for i in range(t - 2, -1, -1):
        b[i] = _log_sum(moves[:, :, None] + (scores[i + 1] + b[i + 1])[None], 1)
    z = _log_sum(a[-1], 0)
    d = np.exp(a + b - z)
    d_moves = np.zeros((c, c), np.float64)
    gold = np.zeros(n)
    who = np.arange(n)
    for i in range(t):
        gold += scores[i, tags[i], who]
        d[i, tags[i], who] -= 1
        if i:
            d_moves += np.exp(a[i - 1][:, None] + moves[:, :, None] + (scores[i] + b[i])[None] - z).sum(axis=2)
            np.add.at(d_moves, (tags[i - 1], tags[i]), -1)
            gold += moves[tags[i - 1], tags[i]]
    return float((z - gold).mean()), (d / n).astype(F32), (d_moves / n).astype(F32)


def best_path(scores: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Tags (time, sequences) of the best path of each sequence."""
    t, c, n = scores.shape
    state, came = scores[0], np.empty((t, c, n), np.int8)
    for i in range(1, t):
        x = state[:, None] + moves[:, :, None]
        came[i] = x.argmax(axis=0)
        state = np.take_along_axis(x, came[i][None].astype(np.int64), 0)[0] + scores[i]
    out = np.empty((t, n), np.int8)
    out[-1] = state.argmax(axis=0)
    for i in range(t - 1, 0, -1):
        out[i - 1] = came[i][out[i], np.arange(n)]
    return out


# ---- training data ------------------------------------------------------------------------------------------------

#: Bounds of the training sample: texts, and code points of each.
SAMPLE_TEXTS, SAMPLE_CHARS = 300, 2000
HIDDEN, WINDOW = 16, 96
SYMBOLS = 131  # ASCII, other letters, other digits, the rest
TOGETHER = 512
TRAIN_STEPS, TRAIN_WINDOWS = 260, 96


def symbols_of(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    out = np.minimum(points, 130).astype(np.uint8)
    for i in np.flatnonzero(points >= 128).tolist():
        c = text[i]
        out[i] = 128 if c.isalpha() else 129 if c.isdigit() else 130
    return out


def _card_digits(rng: np.random.Generator) -> str:
    head = "".join(map(str, rng.integers(0, 10, rng.choice([12, 14, 15, 15, 15, 18]))))
    return next(head + str(d) for d in range(10) if luhn(head + str(d)))


def _grouped(digits: str, sign: str, size: int = 4) -> str:
    return sign.join(digits[i:i + size] for i in range(0, len(digits), size))


def variant(rng: np.random.Generator) -> tuple[str, str | None]:
    """(text, kind): a span written in some form, or a number of no kind."""
    pick = lambda options: options[rng.integers(len(options))]
    n = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    word = lambda: "".join(pick("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.integers(2, 9)))
    octets = [str(x) for x in rng.integers(0, 256, 4)]
    area, mid, end = n(3), n(3), n(4)
    choice = rng.integers(0, 20)
    if choice < 2:
        return f"{word()}{pick(['', '.', '_'])}{n(rng.integers(0, 3))}@{word()}.{pick(['com', 'org', 'example.net', 'de'])}", "email"
    if choice < 5:
        return pick(["{0} @ {1}.{2}", "{0}@{1} . {2}", "{0} @ {1} . {2}", "{0}@{1}[.]{2}", "{0}@{1}(dot){2}"]).format(word() + n(rng.integers(0, 3)), word(), pick(["com", "org", "net", "fr"])), "email"
    if choice < 6:
        return ".".join(octets), "ip"
    if choice < 8:
        return pick([" . ", "[.]", "(.)", ". "]).join(octets), "ip"
    if choice < 9:
        return pick([_card_digits(rng), _grouped(_card_digits(rng), pick([" ", "-"]))]), "card"
    if choice < 11:
        return _grouped(_card_digits(rng), pick([".", "/", " - ", "_"])), "card"
    if choice < 12:
        return f"+{rng.integers(1, 99)} {pick([f'({area})', area])} {mid}-{end}", "phone"
    if choice < 15:
        return pick([f"({area}) {mid}-{end}", f"{area}-{mid}-{end}", f"{area}.{mid}.{end}", f"001 {area} {mid} {end}", f"({area}) {mid} {end}"]), "phone"
    return pick([n(rng.integers(1, 7)), n(20), f"{rng.integers(1, 30)}.{rng.integers(0, 99)}", f"{n(1)}.{n(1)}.{n(2)}", f"{rng.integers(1900, 2030)}-{n(2)}-{n(2)}",
                 "".join(pick("0123456789abcdef") for _ in range(rng.integers(8, 40))), f"{n(2)}:{n(2)}", f"{n(3)} {n(2)}", f"@{word()}", f"v{n(1)}.{n(2)}"]), None


def training_windows(texts: list[str], count: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, tags), each (WINDOW, count): stretches of the texts, most with a variant set into them."""
    symbols, tags = np.zeros((WINDOW, count), np.uint8), np.zeros((WINDOW, count), np.int64)
    filler = [t for t in texts if t] or ["the word and another word for it "]
    for i in range(count):
        source = filler[rng.integers(len(filler))]
        at = int(rng.integers(max(1, len(source) - WINDOW)))
        text = source[at:at + WINDOW]
        extra: list[Span] = []
        if rng.random() < 0.85:
            span, kind = variant(rng)
            cut = int(rng.integers(0, max(1, min(len(text), WINDOW - len(span) - 2))))
            cut = text.rfind(" ", 0, cut + 1) + 1
            text = f"{text[:cut]}{span}{text[cut - 1:cut] or ' '}{text[cut:]}"
            if kind:
                extra.append((kind, cut, cut + len(span)))
        text = text[:WINDOW].ljust(WINDOW)
        taken = [(a, b) for _, a, b in extra]
        spans = extra + [s for s in base_spans(text) if not any(s[1] < b and a < s[2] for a, b in taken)]
        symbols[:, i] = symbols_of(text)
        for kind, a, b in sorted(spans, key=lambda s: -s[1]):
            k = KINDS.index(kind)
            tags[a:min(b, WINDOW), i] = 2 * k + 2
            if a < WINDOW:
                tags[a, i] = 2 * k + 1
    return symbols, tags


class Model:
    def __init__(self, net: Bidirectional, moves: np.ndarray):
        self.net, self.moves = net, moves

    def windows(self, text: str) -> list[int]:
        """Starts of the windows that hold a digit or at sign."""
        step = WINDOW // 2
        places = np.unique([m.start() // step for m in _TELLING.finditer(text)])
        starts = np.unique(np.concatenate([places, places - 1])) if len(places) else places
        last = max(0, -(-(len(text) - WINDOW) // step))
        return [int(s) * step for s in starts if 0 <= s <= last]

    def spans(self, texts: list[str]) -> list[list[tuple[str, int, int, float]]]:
        """Reconciled spans of each text, with their scores.

        A span that an inner edge of a window cuts is left to the neighbouring
        window. If none saw it whole, it is decoded again amid twice the text,
        and so on until it stands free of the edges, up to WIDEST: the network
        reports nothing longer.
        """
        todo = [(i, s) for i, t in enumerate(texts) for s in self.windows(t)]
        found: list[list[tuple[str, int, int, float]]] = [[] for _ in texts]
        width = WINDOW
        while todo and width <= WIDEST:
            cut: list[list[tuple[int, int]]] = [[] for _ in texts]
            together = max(1, TOGETHER * WINDOW // width)
            for lo in range(0, len(todo), together):
                some = todo[lo:lo + together]
                for (i, s), spans in zip(some, self._decoded([texts[i][s:s + width] for i, s in some], width), strict=True):
                    for kind, a, b, score in spans:
                        if a == 0 and s > 0 or b == width and s + width < len(texts[i]):
                            cut[i].append((s + a, s + b))
                        else:
                            found[i].append((kind, s + a, min(s + b, len(texts[i])), score))
            width *= 2
            todo = []
            for i, parts in enumerate(cut):
                whole = sorted((a, b) for _, a, b, _ in found[i])
                starts, ends = [a for a, _ in whole], list(itertools.accumulate((b for _, b in whole), max))
                unseen = [(a, b) for a, b in parts if not ((n := bisect.bisect_left(starts, b)) and ends[n - 1] > a)]
                grid = width // 4  # so that a round decodes each place a few times at most
                todo += [(i, s) for s in sorted({max(0, ((a + b - width) // 2 + grid // 2) // grid * grid) for a, b in unseen})]
        return [reconcile(f) for f in found]

    def _decoded(self, pieces: list[str], width: int) -> list[list[tuple[str, int, int, float]]]:
        """(kind, start, end, score) of the tagged stretches of each piece, filled up to ``width``."""
        steps = symbols_of("".join(p.ljust(width) for p in pieces)).reshape(-1, width).T
        scores = self.net.scores(np.ascontiguousarray(steps))
        paths = best_path(scores, self.moves)
        out: list[list[tuple[str, int, int, float]]] = [[] for _ in pieces]
        for w in np.flatnonzero((paths != NONE).any(axis=0)).tolist():
            path = paths[:, w]
            for a in np.flatnonzero(path % 2 == 1).tolist():
                inside = int(path[a]) + 1
                b = a + 1
                while b < width and path[b] == inside:
                    b += 1
                own = scores[np.arange(a, b), path[a:b], w] - scores[a:b, NONE, w]
                moved = sum(float(self.moves[path[j - 1], path[j]] - self.moves[NONE, NONE]) for j in range(max(a, 1), b))
                out[w].append((KINDS[inside // 2 - 1], a, b, float(own.sum()) + moved))
        return out


def reconcile(spans: list[tuple[str, int, int, float]]) -> list[tuple[str, int, int, float]]:
    """The non-overlapping spans of highest total score; what two windows both found counts once, at its better score."""
    best: dict[Span, float] = {}
    for kind, a, b, score in spans:
        if score > 0:
            best[kind, a, b] = max(score, best.get((kind, a, b), 0.0))
    order = sorted(best, key=lambda s: (s[2], s[1], KINDS.index(s[0])))
    ends = [s[2] for s in order]
    totals, choice = [0.0], []
    for j, span in enumerate(order):
        before = bisect.bisect_right(ends, span[1], 0, j)
        take = totals[before] + best[span]
        choice.append((take > totals[-1], before))
        totals.append(max(totals[-1], take))
    out, j = [], len(order)
    while j:
        taken, before = choice[j - 1]
        if taken:
            out.append((*order[j - 1], best[order[j - 1]]))
        j = before if taken else j - 1
    return out[::-1]


def passes(kind: str, text: str) -> bool:
    """The check of a span that the network proposes."""
    digits = _digits(text)
    if kind == "email":
        left, _, right = text.partition("@")
        return any(map(str.isalnum, left)) and sum(map(str.isalpha, right)) >= 3 and "@" not in right and len(text) >= 6
    if kind == "ip":
        parts = _NUMBER.findall(text)
        return len(parts) == 4 and all(len(p) < 4 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15 and not any(map(str.isalpha, text))


def train(texts: list[str], seed: int = 11, steps: int = TRAIN_STEPS) -> Model:
    rng = np.random.default_rng(seed)
    net = Bidirectional(LSTM, SYMBOLS, HIDDEN, TAGS, rng)
    fixed, moves = allowed(), np.zeros((TAGS, TAGS), F32)
    adam = Adam(net.parameters() | {"moves": moves}, 0.02)
    texts = sorted(texts)
    for step in range(steps):
        symbols, tags = training_windows(texts, TRAIN_WINDOWS, rng)
        scores, kept = net.forward(symbols)
        _, d, d_moves = crf_gradient(scores, moves + fixed, tags)
        adam.step(net.backward(symbols, kept, d) | {"moves": d_moves}, scale=1 - 0.9 * step / steps)
    return Model(net, moves + fixed)


def training_texts(docs: DataFrame, rows: int = SAMPLE_TEXTS, chars: int = SAMPLE_CHARS) -> list[str]:
    """A stretch of each of a bounded number of rows (the first of the table: a training sample needs no order)."""
    place = F.pmod(F.xxhash64("text"), F.greatest(F.length("text") - chars, F.lit(1)).cast("long")) + 1
    part = F.substring(F.col("text"), place.cast("int"), F.lit(chars))
    return [r.part for r in docs.where("text is not null").select(part.alias("part")).limit(rows).collect()]


def find(texts: list[str], model: Model) -> list[list[Span]]:
    """All spans of each text by start, then kind: the patterns' and the network's."""
    out = []
    for text, added in zip(texts, model.spans(texts), strict=True):
        base = base_spans(text)
        taken = sorted((x, y) for _, x, y in base)
        starts, ends = [x for x, _ in taken], list(itertools.accumulate((y for _, y in taken), max))
        more = []
        for k, a, b, _ in added:
            before = bisect.bisect_left(starts, b)  # base spans that begin before this one ends
            if not (before and ends[before - 1] > a) and passes(k, text[a:b]):
                more.append((k, a, b))
        out.append(by_place(base + more))
    return out


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
                                  T.StructField("by_pattern", T.BooleanType())]))


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id and the spans of every row's whole text."""
    model = model or train(training_texts(docs))

    def rows(source: Iterator[tuple]) -> Iterator[tuple]:
        held: list[tuple] = []

        def done() -> Iterator[tuple]:
            for (doc_id, text), spans in zip(held, find([t for _, t in held], model), strict=True):
                base = set(base_spans(text)) if spans else set()
                yield doc_id, [{"kind": k, "start": a, "end": b, "by_pattern": (k, a, b) in base} for k, a, b in spans]

        size = 0
        for doc_id, text in source:
            held.append((doc_id, text or ""))
            size += len(text or "")
            if size >= 1 << 20:
                yield from done()
                held, size = [], 0
        yield from done()

    return map_documents(docs, rows, [T.StructField("spans", SPANS)])

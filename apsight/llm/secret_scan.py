"""Operator 9: secrets, with structural confirmation of encoded candidates.

Base findings are three patterns over the whole text. The method adds spans:
a base64 or hex candidate is decoded, and reported only if its structure holds:

* ``der``: nested tag-length-value encoding, every length exact, in the shape of
  a private key (RSA, DSA, EC, a wrapped key, an encrypted key, or a PKCS #12
  store with a key bag), an OpenSSH key, or base64 of a ``pem`` block;
* ``pem``: a private key block whose body is such an encoding, or begins with
  the magic string of OpenSSH keys followed by exact length-prefixed fields, or
  has the headers and whole cipher blocks of the older encrypted form;
* ``jwt``: three parts of which the first decodes to a JSON object that names
  an algorithm, the second to a JSON object, the third to bytes.

A key is looked for at every place where its first byte can stand, whatever is
before it, and ends where its own lengths say: glued or wrapped text (line
ends, also escaped, quotes, ``> # | *`` between lines) hides none.

Defined cases: a null text is the empty text and has no finding; a candidate of
any length is decoded whole; equal rows give equal findings; an empty table
gives none.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import itertools
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from apsight.llm.common import map_documents, ship

KINDS = ("assign", "access", "hex", "pem", "der", "jwt")
BASE_KINDS = KINDS[:3]

# The base patterns.
_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")  # a maximal run: what leftmost matching finds
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")

_MARK = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]*PRIVATE KEY)-----")
_BODY = re.compile(r"[A-Za-z0-9+/=\s\\:,.-]*")
_BREAK = r"""(?:\\[rn]|\\(?=\s)|["']\s*[+.,]?\s*["']|[\s>#|*])++"""  # between the lines of a wrapped encoding
_WRAP, _LINE_END = re.compile(_BREAK), re.compile(r"""[\n\r\\"']""")
_DIGITS = {64: re.compile(r"[A-Za-z0-9+/_-]+"), 16: re.compile(r"[0-9a-fA-F]+")}
# 0x30, the first byte of every DER key, is M[A-P] in base64; b3 starts the magic string of OpenSSH keys.
_STARTS = {64: re.compile(r"""M(?=[A-P\s\\"'])|b3(?=[B\s\\"'])"""), 16: re.compile(r"30(?=[0-9a-fA-F\s\\])|6[fF](?=[7\s\\])")}
_BASE64 = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{16,}}+(?:{_BREAK}[A-Za-z0-9+/_-]{{16,}}+)*+(?:{_BREAK}[A-Za-z0-9+/_-]++)?={{0,2}}")
_ENCODED_PEM = ("UFJJVkFURSBLRVktLS0tL", "BSSVZBVEUgS0VZLS0tLS", "QUklWQVRFIEtFWS0tLS0t")  # PRIVATE KEY----- at the three alignments
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{14,}+)(?=\.([A-Za-z0-9_-]{3,}+)\.([A-Za-z0-9_-]*+))")
_OBJECT = re.compile("(?=e[w-z0-9_-]|I[A-P]|C[Q-Za-v]|D[Q-Za-f]|77)")  # a brace, white space or byte order mark in base64
_OPEN = re.compile(rb"(?:\xef\xbb\xbf)?[ \t\n\r]*(?:\{[ \t\n\r]*(?:\"|$)|$)")  # an object with a member, as far as can be seen
_OPEN_START = re.compile(r"(?:\xef\xbb\xbf)?[ \t\n\r]*")
_PIECES = re.compile(r'"(?:[^"\\]|\\.)*+"?|[{}]', re.DOTALL)
_ENCRYPTION = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))  # password-based schemes of PKCS #5 and #12
_KEY_BAGS = (bytes.fromhex("2a864886f70d010c0a0101"), bytes.fromhex("2a864886f70d010c0a0102"))
_ENCRYPTED = re.compile(r"(?:\s|\\[rn])*Proc-Type:\s*4,ENCRYPTED(?:\s|\\[rn])+DEK-Info:\s*[A-Z0-9-]+,[0-9A-Fa-f]{16,32}(?:\s|\\[rn])+")
_OPENSSH = b"openssh-key-v1\0"

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    found: list[Span] = []
    low = text.lower()
    if any(n in low for n in _NAMES):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 8]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return found


def unbase64(data: str) -> bytes | None:
    """Standard or URL alphabet, padding optional; None if it cannot be decoded."""
    data = data.rstrip("=").replace("-", "+").replace("_", "/")
    if len(data) % 4 == 1:
        return None
    try:
        return base64.b64decode(data + "=" * (-len(data) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def elements(data: bytes) -> list[tuple[int, bytes]] | None:
    """Tag-length-value elements that fill ``data`` exactly, or None."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size >= 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > len(data):
                return None
            size, at = int.from_bytes(data[at:at + n]), at + n
            if size < 0x80:
                return None  # not the shortest form
        if at + size > len(data):
            return None
        out.append((tag, data[at:at + size]))
        at += size
    return out


def is_algorithm(tag: int, value: bytes) -> bool:
    return tag == 0x30 and bool(parts := elements(value)) and parts[0][0] == 0x06


def holds_key_bag(data: bytes, depth: int = 0) -> bool:
    """Whether nested elements (also inside octet strings) name a bag with a private key."""
    parts = elements(data) or []
    return any(t == 0x06 and v in _KEY_BAGS or depth < 12 and (t & 0x20 or t == 0x04) and holds_key_bag(v, depth + 1) for t, v in parts)


def is_private_key(data: bytes, depth: int = 0) -> bool:
    """A sequence with exact nested lengths in the shape of a private key."""
    outer = elements(data)
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    inner = elements(outer[0][1])
    if not inner:
        return False
    tags = [t for t, _ in inner]
    if tags == [0x30, 0x04] and is_algorithm(*inner[0]):  # encrypted: algorithm, data; a digest has this shape too
        return elements(inner[0][1])[0][1].startswith(_ENCRYPTION) and len(inner[1][1]) >= 16
    if inner[0][0] != 0x02 or len(inner[0][1]) != 1:
        return False
    if inner[0][1][0] == 3:
        return tags[1:] in ([0x30], [0x30, 0x30]) and is_algorithm(*inner[1]) and holds_key_bag(inner[1][1])  # PKCS #12 store
    if inner[0][1][0] > 1:
        return False
    if len(inner) >= 9 and all(t == 0x02 and v for t, v in inner[:9]):
        return True  # RSA: version and eight numbers
    if tags == [0x02] * 6 and len(inner[1][1]) >= 64 and len(inner[2][1]) >= 20 and all(v for _, v in inner):
        return True  # DSA: version, two primes, generator, public and secret number
    if len(inner) >= 2 and tags[1] == 0x04 and len(inner[1][1]) >= 16:
        return all(elements(v) is not None for t, v in inner[2:] if t & 0x20)  # EC: version, secret, tagged fields
    if len(inner) >= 3 and tags[2] == 0x04 and is_algorithm(*inner[1]) and depth < 2:  # wrapped: version, algorithm, key
        body = inner[2][1]
        nested = elements(body)
        if is_private_key(body, depth + 1) or nested and nested[0][0] == 0x04:
            return True
        if nested and len(nested) == 1 and len(nested[0][1]) >= 16:  # a number (DSA, DH), a seed, or a seed and a key
            return nested[0][0] in (0x02, 0x80) or nested[0][0] == 0x30 and [t for t, _ in elements(nested[0][1]) or []] == [0x04, 0x04]
        return elements(inner[1][1])[0][1].startswith(b"\x2a\x85\x03") and len(body) in (32, 64)  # GOST: bare octets
    return False


def openssh_size(data: bytes) -> int | None:
    """Bytes of the key that ``data`` begins with: the magic string, three length-prefixed names, a count, and length-prefixed keys."""
    if not data.startswith(_OPENSSH):
        return None
    at = len(_OPENSSH)

    def field() -> bool:
        nonlocal at
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at:at + 4])
        return at <= len(data)

    if not (field() and field() and field()) or at + 4 > len(data):
        return None
    keys = int.from_bytes(data[at:at + 4])
    at += 4
    return at if 1 <= keys <= 16 and all(field() for _ in range(keys + 1)) else None


def is_openssh_key(data: bytes) -> bool:
    return openssh_size(data) == len(data)


def is_key(data: bytes | None) -> bool:
    return bool(data) and (is_private_key(data) or is_openssh_key(data))


def digits(text: str, at: int, base: int, n: int | None = None) -> tuple[str, int]:
    """Up to ``n`` digits from ``at`` on, over the breaks of a wrapped encoding, and where they end."""
    parts, have, end = [], 0, at
    while n is None or have < n:
        m = _DIGITS[base].match(text, at, len(text) if n is None else at + n - have)
        if not m:
            break
        parts.append(m[0])
        have, end = have + len(m[0]), m.end()
        gap = _WRAP.match(text, end)
        if not gap or not (_LINE_END.search(gap[0]) or len(m[0]) in (64, 76)):  # blanks alone: only after a line of usual width
            break
        at = gap.end()
    return "".join(parts), end


def decoded(data: str, base: int) -> bytes:
    """The whole bytes that ``data`` begins with."""
    if base == 16:
        return bytes.fromhex(data[:len(data) // 2 * 2])
    return unbase64(data[:-1] if len(data) % 4 == 1 else data) or b""


def key_size(head: bytes) -> int | None:
    """Bytes of a DER key that begins with ``head`` by its outermost length; None if no key begins so."""
    if len(head) < 8 or head[0] != 0x30 or head[1] == 0x80 or head[1] > 0x84:
        return None
    n = max(0, head[1] - 0x80)
    size = 2 + n + (int.from_bytes(head[2:2 + n]) if n else head[1])
    first = head[2 + n:]
    return size if first[0] == 0x30 or first[:2] == b"\2\1" and first[2:3] in (b"", b"\0", b"\1", b"\3") else None


def key_end(text: str, at: int, base: int) -> int | None:
    """Where the encoded key that begins at ``at`` ends, its padding included; None if there is none."""
    head = decoded(digits(text, at, base, 24)[0], base)
    if _OPENSSH.startswith(head[:len(_OPENSSH)]) and head:
        first = decoded(digits(text, at, base, 2 * len(_OPENSSH) + 8)[0], base)[len(_OPENSSH):][:4]
        if len(first) < 4 or int.from_bytes(first) > len(text) - at:
            return None  # the first name alone would not fit
        data = decoded(digits(text, at, base)[0], base)
        size = openssh_size(data)
    else:
        size = key_size(head)
    if not size or size > len(text) - at:
        return None
    n = 2 * size if base == 16 else -(-size * 4 // 3)
    found, end = digits(text, at, base, n)
    if end - at > n and _DIGITS[base].match(text, end):
        return None  # the last line goes on: a cut key, filled up from what follows
    if len(found) < n or not is_key(decoded(found, base)[:size]):
        return None
    if base == 64:
        pad = -n % 4
        end += len(text[end:end + pad]) - len(text[end:end + pad].lstrip("="))
    return end


def encoded_blocks(text: str, at: int, end: int) -> list[tuple[int, int]]:
    """Spans in ``text[at:end]`` (base64 digits and breaks) whose bytes hold a private key block, at any alignment."""
    places = [m.start() + i for m in _DIGITS[64].finditer(text, at, end) for i in range(len(m[0]))]
    data = "".join(text[i] for i in places)
    if not any(x in data for x in _ENCODED_PEM):
        return []
    found = []
    for skip in range(4):
        content = decoded(data[skip:], 64)
        if b"PRIVATE KEY-----" not in content:
            continue
        blocks = [(a, b) for kind, a, b in confirmed_spans(content.decode("latin-1")) if kind == "pem"]
        for a, b in blocks:
            first, last = skip + a * 4 // 3, min(len(places), skip - (-b * 4 // 3)) - 1
            if not skip and content[:a].isascii():
                first = 0  # an encoded text that holds the block: whole, from where it starts
            stop = places[last] + 1
            stop = max(stop, _DIGITS[64].match(text, places[last], end).end())
            found.append((places[first], stop + len(text[stop:stop + 2]) - len(text[stop:stop + 2].lstrip("="))))
    return found


def is_signed_token(header: str, payload: str, signature: str) -> bool:
    try:
        head, body = (json.loads(unbase64(x) or b"") for x in (header, payload))
    except (ValueError, RecursionError):
        return False
    if not (isinstance(head, dict) and isinstance(body, dict) and isinstance(head.get("alg"), str)):
        return False
    return head["alg"] == "none" if not signature else bool(unbase64(signature))


def confirmed_spans(text: str) -> list[Span]:
    found: list[Span] = []
    if "PRIVATE KEY-----" in text:
        for a, b, body in blocks(text):
            lines = [x for x in re.split(r"(?:\s|\\[rn])+", body) if x]
            data = unbase64("".join(x for x in lines if ":" not in x and "," not in x))
            if is_key(data):
                found.append(("pem", a, b))
            elif data is None or "ENCRYPTED" in body:
                if (h := _ENCRYPTED.match(body)) and (data := unbase64(re.sub(r"\s|\\[rn]", "", body[h.end():]))) and len(data) % 8 == 0:
                    found.append(("pem", a, b))
    taken = [(a, b) for _, a, b in found]  # ascending, apart from each other

    def add(a: int, b: int) -> None:
        at = bisect.bisect_left(taken, (a, b))
        if not (at and a < taken[at - 1][1] or at < len(taken) and taken[at][0] < b):
            found.append(("der", a, b))
            taken.insert(at, (a, b))

    for m in _BASE64.finditer(text):
        for a, b in encoded_blocks(text, *m.span()):
            add(a, b)
    for base, start in _STARTS.items():
        done = 0
        for m in start.finditer(text):
            if m.start() >= done and (end := key_end(text, m.start(), base)):
                add(m.start(), end)
                done = end
    for m in _TOKEN.finditer(text):
        at = token_start(m[1], m[2], m[3])
        if at is not None:
            found.append(("jwt", m.start() + at, m.end(3)))
    return found


def blocks(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, body) of each private key block: a begin mark, its end mark next, and nothing else between."""
    begin = None
    for m in _MARK.finditer(text):
        if m[1] == "END" and begin and begin[2] == m[2] and _BODY.fullmatch(text, begin.end(), m.start()):
            yield begin.start(), m.end(), text[begin.end():m.start()]
        begin = m if m[1] == "BEGIN" else None


def token_start(head: str, payload: str, signature: str) -> int | None:
    """The first place in ``head`` from which it is the header of a signed token.

    The head is decoded once for each of the four alignments. A header ends with
    the last brace there, so it begins at the brace that matches: one pass finds
    it, a second one those that the first took for text within quotes.
    """
    starts = [i for i in itertools.chain([0], (x.start() for x in _OBJECT.finditer(head, 1))) if _OPEN.match(decoded(head[i:i + 48], 64))]
    found = []
    for r in range(4):
        own = [i for i in starts if i % 4 == r]
        if not own:
            continue
        data = (unbase64(head[r:]) or b"").decode("latin-1").rstrip(" \t\n\r")
        if not data.endswith("}"):
            continue
        braces = {i: _OPEN_START.match(data, i // 4 * 3).end() for i in own}
        first, quoted = last_object(data, braces[own[0]])
        within = iter(quoted)
        span = next(within, None)
        other = None
        for i in own:
            while span and span[1] <= braces[i]:
                span = next(within, None)
            if span and span[0] < braces[i]:
                other, _ = last_object(data, braces[i])
                break
        found += [i for i in own if braces[i] in (first, other)]
    return next((i for i in sorted(found) if is_signed_token(head[i:], payload, signature)), None)


def last_object(data: str, at: int) -> tuple[int | None, list[tuple[int, int]]]:
    """Read from ``at`` on: where the brace stands that the last character closes, and the spans of quoted texts."""
    opened, quoted, start = [], [], None
    for m in _PIECES.finditer(data, at):
        start = None
        if m[0] == "{":
            opened.append(m.start())
        elif m[0] == "}":
            brace = opened.pop() if opened else None
            start = brace if m.end() == len(data) else None
        else:
            quoted.append(m.span())
    return start, quoted


def by_place(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def find(text: str | None) -> list[Span]:
    """All spans (kind, start, end) of a text in code points, by start, then kind."""
    text = text or ""
    return by_place(base_spans(text) + confirmed_spans(text))


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and the list of spans."""
    def rows(source: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in source:
            yield doc_id, [{"kind": k, "start": a, "end": b} for k, a, b in find(text)]

    return map_documents(docs, rows, [T.StructField("spans", SPANS)])


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found span of ``text`` replaced (touching spans by one mask); other columns as they are."""
    ship(docs.sparkSession)
    at = docs.columns.index("text")

    def clean(text: str | None) -> str | None:
        spans = find(text)
        if not spans:
            return text
        out, end = [], 0
        for _, a, b in spans:
            if a >= end:
                out += [text[end:a], mask]
            end = max(end, b)
        return "".join([*out, text[end:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = pa.array([clean(t) for t in part.column(at).to_pylist()], part.schema.field(at).type)
                yield pa.RecordBatch.from_arrays([texts if k == at else c for k, c in enumerate(part.columns)], schema=part.schema)

    return docs.mapInArrow(run, docs.schema)

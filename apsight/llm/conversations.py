"""Operator 12: repair of conversation structure with a persistent audit.

A conversation's rows are edited so that their roles read ``(s?(ua)+)?`` (an
optional system turn, then user and assistant in turn; or nothing) at the least
cost: Keep 0, Rerole 3, Delete 4 (required for blank and duplicate rows), Insert
an empty turn 3, and 3 for each truncated row that stays. Of equally cheap edits
the audit, their initials in order, is the least in ASCII order.

**Audit.** A dynamic program goes over the rows and keeps the best (cost, audit)
for each state of the role pattern. Audits share prefixes: each is a node with a
parent, its last letter, a rolling hash of the whole, and its ancestors 1, 2, 4,
... letters back. Of two candidates of equal cost the lesser is found by a search
for their longest common prefix over ancestors' hashes; what the hashes call
equal is then verified letter by letter down to the node that both share. (Of
two audits that took the same rows to the same state at the same cost neither is
a prefix of the other: what it lacked would be paid inserts. So the lesser
prefix stays the lesser.)

**At scale.** One range shuffle orders the rows of all conversations. A task
holds at most ``CHUNK_ROWS`` rows of one; a conversation that lies whole in one
chunk, away from the edges of its partition, is finished there. One cut by a
chunk or a partition becomes ``line`` rows: duplicates across chunks are found by
an aggregate, each chunk gives the best (cost, audit) from every state to every
state, these are joined up along the conversation, and the repaired text, whose
SHA-256 can only be taken in order, is streamed through one hash. The chosen
audit of one conversation, a letter a row, is all that is ever held whole.

Defined cases: rows are ordered by turn (null first), then role, then text;
rows alike in all are duplicates; a null role or text is one space, and so is a
null conv_id or turn where it is named in a key; a null ``conv_id`` is a
conversation of its own; a role that does not begin with s, u or a (or is empty)
fits no place and is reroled or deleted; other columns are not looked at; a
conversation without rows after damage has zeros, an empty audit and the hash of
nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from apsight.llm.common import map_documents, written

#: Rows of one conversation that a task holds.
CHUNK_ROWS = 4096

# The contract's costs and the role pattern. States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
NEXT = {0: "u", 1: "u", 2: "a", 3: "u"}  # the role that an inserted or reroled turn takes
NAMES = {"u": "user", "a": "assistant"}
ACCEPTED = (0, 3)
LEGAL = {"su", "ua", "au"}
_SPACE = " \t\n\x0b\x0c\r"


# ---- persistent audits --------------------------------------------------------------------------------------------

class Audits:
    """Strings as nodes that share prefixes; node 0 is the empty string."""

    def __init__(self, base: int = 1_000_003, modulus: int = (1 << 61) - 1):
        self.base, self.modulus = base, modulus
        self.up: list[list[int]] = [[]]
        self.depth, self.hash, self.last = [0], [0], [""]
        self.equal: dict[tuple[int, int], bool] = {}  # pairs of nodes compared letter by letter

    def add(self, parent: int, letter: str) -> int:
        node, up, k = len(self.last), [parent], 0
        while k < len(self.up[up[k]]):  # the ancestor 2^k back has one that is 2^k further
            up.append(self.up[up[k]][k])
            k += 1
        self.up.append(up)
        self.depth.append(self.depth[parent] + 1)
        self.hash.append((self.hash[parent] * self.base + ord(letter)) % self.modulus)
        self.last.append(letter)
        return node

    def ancestor(self, node: int, depth: int) -> int:
        back = self.depth[node] - depth
        while back:
            k = back.bit_length() - 1
            node = self.up[node][k]
            back -= 1 << k
        return node

    def common(self, a: int, b: int) -> int:
        """Length of the longest common prefix."""
        depth = min(self.depth[a], self.depth[b])
        x, y = self.ancestor(a, depth), self.ancestor(b, depth)
        for k in range(depth.bit_length(), -1, -1):
            if self.hash[x] == self.hash[y]:
                break
            if k < len(self.up[x]) and self.hash[self.up[x][k]] != self.hash[self.up[y][k]]:
                x, y = self.up[x][k], self.up[y][k]
        if self.hash[x] != self.hash[y]:
            x, y = self.up[x][0], self.up[y][0]
        if self._verified(x, y):
            return self.depth[x]
        text, other = self.text(a), self.text(b)  # a hash collision: letter by letter
        return next((i for i, (c, d) in enumerate(zip(text, other, strict=False)) if c != d), min(len(text), len(other)))

    def _verified(self, x: int, y: int) -> bool:
        """Whether two nodes of one depth spell the same: letters are compared back to a node that both share."""
        walked = []
        while x != y and (x, y) not in self.equal:
            walked.append((x, y))
            if self.last[x] != self.last[y]:
                self.equal[x, y] = False
                break
            x, y = self.up[x][0], self.up[y][0]
        same = x == y or self.equal[x, y]
        self.equal.update(dict.fromkeys(walked, same))
        return same

    def less(self, a: int, b: int) -> bool:
        n = self.common(a, b)
        if n == min(self.depth[a], self.depth[b]):
            return self.depth[a] < self.depth[b]
        return self.last[self.ancestor(a, n + 1)] < self.last[self.ancestor(b, n + 1)]

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.last[node])
            node = self.up[node][0]
        return "".join(reversed(out))


def audits(rows: list[tuple[str, str]], entry: int = 0, make=Audits) -> dict[int, tuple[int, str]]:
    """rows: (role initial, fault). For each state that can be reached from ``entry``: the least cost and its least audit."""
    strings = make()
    best: dict[int, tuple[int, int]] = {}

    def offer(to: dict, state: int, cost: int, parent: int, letter: str) -> bool:
        now = to.get(state)
        if now is not None and cost > now[0]:
            return False
        node = strings.add(parent, letter) if letter else parent
        if now is not None and cost == now[0] and not strings.less(node, now[1]):
            return False
        to[state] = (cost, node)
        return True

    def inserted() -> None:
        grown = True
        while grown:  # ends: every insert costs, and there are four states
            grown = False
            for state, (cost, node) in list(best.items()):
                grown |= offer(best, STEP[state, NEXT[state]], cost + INSERT, node, "I")

    offer(best, entry, 0, 0, "")
    inserted()
    for initial, fault in rows:
        before, best = best, {}
        stays = TRUNCATED if fault == "truncated" else 0
        for state, (cost, node) in before.items():
            offer(best, state, cost + DELETE, node, "D")
            if fault not in ("blank", "duplicate"):
                if (state, initial) in STEP:
                    offer(best, STEP[state, initial], cost + stays, node, "K")
                offer(best, STEP[state, NEXT[state]], cost + REROLE + stays, node, "R")
        inserted()
    return {state: (cost, strings.text(node)) for state, (cost, node) in best.items()}


def accepted(found: dict[int, tuple[int, str]]) -> tuple[int, str]:
    return min(found[s] for s in ACCEPTED if s in found)


def repaired(rows: list[tuple[str, str]], audit: str, entry: int = 0) -> Iterator[str]:
    """``role:text`` of the turns that an audit makes of rows (role, text)."""
    state, left = entry, iter(rows)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(left)
        if edit == "D":
            continue
        initial = role[:1] if edit == "K" else NEXT[state]
        yield f"{role if edit == 'K' else NAMES[initial]}:{text}"
        state = STEP[state, initial]


# ---- faults -------------------------------------------------------------------------------------------------------

def damaged(conversations: DataFrame) -> DataFrame:
    """The contract's damage by crc32 of ``conv_id:turn``. Dropped rows stay as rows with ``gone``, so that
    their conversation is known."""
    def named(c: str):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    fate = F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn")).cast("binary")) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.translate(named("text"), ".!?", "")).otherwise(named("text"))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), fate.alias("fate"),
                                F.when(fate == 0, "").when(fate == 4, "user").otherwise(named("role")).alias("role"),
                                F.when(fate == 0, "").otherwise(text).alias("text"))
    twice = F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", "role", "text", (F.col("fate") == 0).alias("gone"), F.explode(twice).alias("copy")).drop("copy")


def fault(text: str, seen: bool) -> str:
    """The first fault of a row, or nothing."""
    inked = text.rstrip(_SPACE)
    if not inked:
        return "blank"
    return "duplicate" if seen else "" if inked[-1] in ".!?" else "truncated"


COUNTS = ("blank", "duplicate", "truncated", "illegal")


def counts(rows: list[tuple[str, str]]) -> list[int]:
    """COUNTS of rows (role initial, fault)."""
    faults = [f for _, f in rows]
    pairs = sum(a + b not in LEGAL for (a, _), (b, _) in zip(rows, rows[1:], strict=False))
    return [*(faults.count(f) for f in COUNTS[:3]), pairs]


# ---- whole conversations, and lines of those that are cut -----------------------------------------------------------

def _long(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.LongType()) for n in names]


_TEXTS = [T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())]
RESULT = [*_long("gaps", *COUNTS, "cost"), *_TEXTS]
LINE = [T.StructField("whole", T.BooleanType()), T.StructField("chunk", T.LongType()), T.StructField("place", T.LongType()),
        T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("gone", T.BooleanType())]


def chunks(rows: Iterator[tuple], size: int) -> Iterator[tuple]:
    """Consecutive rows (conv_id, ...) as (conv_id, rows, first chunk of the conversation here?, last?)."""
    held: list[tuple] = []
    first = True
    for row in rows:
        if held and (row[0] != held[0][0] or len(held) >= size):
            last = row[0] != held[0][0]
            yield held[0][0], held, first, last
            held, first = [], last
        held.append(row)
    if held:
        yield held[0][0], held, first, True


def repair(conversations: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One row per ``conv_id`` of rows (conv_id, turn, role, text, gone): the columns of RESULT."""
    def split(rows: Iterator[tuple]) -> Iterator[tuple]:
        task = TaskContext.get().partitionId() << 40
        place = 0
        edge = None  # a chunk is written once it is known whether another conversation follows
        for n, (conv, held, first, last) in enumerate(chunks(rows, chunk_rows)):
            if edge:
                yield from edge(False)
            whole = n > 0 and first and last
            edge = lambda end, conv=conv, held=held, whole=whole, chunk=task + n, at=task + place: out(conv, held, whole and not end, chunk, at)
            place += len(held)
        if edge:
            yield from edge(True)

    def out(conv, held: list[tuple], whole: bool, chunk: int, at: int) -> Iterator[tuple]:
        if whole:
            yield conv, True, *[None] * (len(LINE) - 1), *finished(held)
        else:
            for i, (_, turn, role, text, gone) in enumerate(held):
                yield conv, False, chunk, at + i, turn, role, text, gone, *[None] * len(RESULT)

    def finished(held: list[tuple]) -> tuple:
        rows = [(turn, role, text) for _, turn, role, text, gone in held if not gone]
        seen, judged = set(), []
        for _, role, text in rows:
            judged.append((role[:1], fault(text, (role, text) in seen)))
            seen.add((role, text))
        cost, audit = accepted(audits(judged))
        turns = {turn for turn, _, _ in rows if turn is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        text = "\n".join(repaired([(role, text) for _, role, text in rows], audit))
        return gaps, *counts(judged), cost, audit, hashlib.sha256(text.encode()).hexdigest()

    conv = T.StructField("conv_id", conversations.schema["conv_id"].dataType)
    columns = ("conv_id", "turn", "role", "text", "gone")
    ordered = conversations.select(*columns).repartitionByRange("conv_id", "turn", "role", "text").sortWithinPartitions("conv_id", "turn", "role", "text")
    parts = written(map_documents(ordered, split, [conv, *LINE, *RESULT], columns=columns, keep_id=False), "conversations")
    names = [f.name for f in RESULT]
    return parts.where("whole").select("conv_id", *names).unionByName(_joined(parts.where(~F.col("whole")), conv, chunk_rows).select("conv_id", *names))


def _joined(lines: DataFrame, conv: T.StructField, chunk_rows: int) -> DataFrame:
    """The conversations that are cut, from their chunks."""
    lines = lines.select("conv_id", "chunk", "place", "turn", "role", "text", "gone")
    there = lines.where(~F.col("gone"))
    first = there.groupBy(*(F.col(c).alias(f"first__{c}") for c in ("conv_id", "role", "text"))).agg(F.min("place").alias("first__place"), F.count("*").alias("n"))
    again = first.where("n > 1")
    same = lines["conv_id"].eqNullSafe(F.col("first__conv_id")) & (lines["role"] == F.col("first__role")) & (lines["text"] == F.col("first__text"))
    marked = written(lines.join(again, same & ~lines["gone"], "left").select(
        "conv_id", "chunk", "place", "turn", "role", "text", "gone", F.coalesce(F.col("place") > F.col("first__place"), F.lit(False)).alias("seen")), "conversation-lines")

    def chunk(key: tuple, table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table[c].to_pylist() for c in ("place", "turn", "role", "text", "gone", "seen")), strict=True))
        rows = [r for r in rows if not r[4]]
        judged = [(role[:1], fault(text, seen)) for _, _, role, text, _, seen in rows]
        turns = [t for _, t, *_ in rows if t is not None]
        best = [(entry, state, cost, audit) for entry in range(4) for state, (cost, audit) in audits(judged, entry).items()]
        ends = (judged[0][0], judged[-1][0], min(turns, default=None), max(turns, default=None)) if rows else (None,) * 4
        row = (key[0].as_py(), key[1].as_py(), len(rows), len(set(turns)), *counts(judged), *ends, *(list(x) for x in zip(*best, strict=True)))
        return pa.table({f.name: pa.array([v], f.type) for f, v in zip(_arrow(matrix), row, strict=True)})

    longs, texts = T.ArrayType(T.LongType()), T.ArrayType(T.StringType())
    matrix = T.StructType([conv, *_long("chunk", "n_rows", "turns", *COUNTS), T.StructField("opening", T.StringType()), T.StructField("closing", T.StringType()),
                           *_long("least", "most"), T.StructField("entries", longs), T.StructField("exits", longs), T.StructField("costs", longs), T.StructField("audits", texts)])
    matrices = marked.groupBy("conv_id", "chunk").applyInArrow(chunk, matrix)

    path = T.StructType([conv, *_long("chunk", "entry"), T.StructField("piece", T.StringType()), *RESULT[:-1]])

    def along(key: tuple, table: pa.Table) -> pa.Table:
        parts = sorted(table.to_pylist(), key=lambda r: r["chunk"])
        best = {0: (0, None)}  # state: cost and a chain (chain before, entry, piece) that shares its beginnings
        for part in parts:
            now: dict[int, tuple] = {}
            for entry, state, cost, audit in zip(part["entries"], part["exits"], part["costs"], part["audits"], strict=True):
                if entry in best:
                    total, chain = best[entry][0] + cost, (best[entry][1], entry, audit)
                    if state not in now or total < now[state][0] or total == now[state][0] and _chain_less(chain, now[state][1]):
                        now[state] = (total, chain)
            best = now
        cost, chain = None, None
        for state in ACCEPTED:
            if state in best and (cost is None or best[state][0] < cost or best[state][0] == cost and _chain_less(best[state][1], chain)):
                cost, chain = best[state]
        steps = []
        while chain:
            chain, entry, piece = chain
            steps.append((entry, piece))
        steps.reverse()
        some = [p for p in parts if p["n_rows"]]
        with_turns = [p for p in some if p["turns"]]
        distinct = sum(p["turns"] for p in with_turns) - sum(a["most"] == b["least"] for a, b in zip(with_turns, with_turns[1:], strict=False))
        gaps = max(p["most"] for p in with_turns) - min(p["least"] for p in with_turns) + 1 - distinct if with_turns else 0
        total = {c: sum(p[c] for p in some) for c in COUNTS}
        total["illegal"] += sum(a["closing"] + b["opening"] not in LEGAL for a, b in zip(some, some[1:], strict=False))
        audit = "".join(p for _, p in steps)
        rows = [(key[0].as_py(), p["chunk"], entry, piece, gaps, *(total[c] for c in COUNTS), cost, audit if i == 0 else None)
                for i, (p, (entry, piece)) in enumerate(zip(parts, steps, strict=True))]
        return pa.table({f.name: pa.array(c, f.type) for f, c in zip(_arrow(path), zip(*rows, strict=True), strict=True)})

    # a few numbers and at most 16 audits a chunk: one conversation's come together, its texts do not
    paths = written(matrices.groupBy("conv_id").applyInArrow(along, path), "conversation-paths")

    def fixed(key: tuple, table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table[c].to_pylist() for c in ("place", "role", "text", "gone")), strict=True))
        entry, piece = table["entry"][0].as_py(), table["piece"][0].as_py()
        text = "\n".join(repaired([(role, text) for _, role, text, gone in rows if not gone], piece, entry))
        made = any(e != "D" for e in piece)
        return pa.table({f.name: pa.array([v], f.type) for f, v in zip(_arrow(fix), (key[0].as_py(), key[1].as_py(), text if made else None), strict=True)})

    fix = T.StructType([conv, *_long("chunk"), T.StructField("text", T.StringType())])
    of = paths.select(F.col("conv_id").alias("path__conv"), F.col("chunk").alias("path__chunk"), "entry", "piece")
    placed = marked.join(of, marked["conv_id"].eqNullSafe(F.col("path__conv")) & (marked["chunk"] == F.col("path__chunk")))
    texts_of = placed.select("conv_id", "chunk", "place", "role", "text", "gone", "entry", "piece").groupBy("conv_id", "chunk").applyInArrow(fixed, fix)

    def hashed(rows: Iterator[tuple]) -> Iterator[tuple]:
        """SHA-256 of each conversation's chunks in order, one chunk held at a time."""
        now, digest, any_text, started = None, None, False, False
        for conv_id, _, text in rows:
            if not started or conv_id != now:
                if started:
                    yield now, digest.hexdigest()
                now, digest, any_text, started = conv_id, hashlib.sha256(), False, True
            if text is not None:
                digest.update((f"\n{text}" if any_text else text).encode())
                any_text = True
        if started:
            yield now, digest.hexdigest()

    in_order = texts_of.repartition("conv_id").sortWithinPartitions("conv_id", "chunk")
    hashes = map_documents(in_order, hashed, [T.StructField("hash__conv", conv.dataType), RESULT[-1]], columns=("conv_id", "chunk", "text"), keep_id=False)
    heads = paths.where("audit is not null")
    return heads.join(hashes, heads["conv_id"].eqNullSafe(F.col("hash__conv"))).select("conv_id", *(f.name for f in RESULT))


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _chain_less(a: tuple, b: tuple) -> bool:
    """Whether one chain of pieces spells less than another of as many; what they share is not looked at."""
    ours, theirs = [], []
    while a is not b:
        ours.append(a[2])
        theirs.append(b[2])
        a, b = a[0], b[0]
    return "".join(reversed(ours)) < "".join(reversed(theirs))

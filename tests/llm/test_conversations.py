"""Conversation repair against a uniform-cost search over all edit sequences."""

import hashlib
import heapq
import itertools
import random
import zlib

import pytest

from apsight.llm import conversations as C

SPACES = " \t\n\x0b\x0c\r"


def search(rows):
    """(cost, audit) of rows (initial, fault): the first complete sequence that comes off a heap by (cost, audit)."""
    heap = [(0, "", 0, 0)]
    while True:
        cost, audit, i, state = heapq.heappop(heap)
        if i == len(rows) and state in (0, 3):
            return cost, audit
        ask = "a" if state == 2 else "u"
        heapq.heappush(heap, (cost + 3, audit + "I", i, 3 if ask == "a" else 2))
        if i == len(rows):
            continue
        initial, fault = rows[i]
        heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state))
        if fault in ("blank", "duplicate"):
            continue
        extra = 3 * (fault == "truncated")
        heapq.heappush(heap, (cost + 3 + extra, audit + "R", i + 1, 3 if ask == "a" else 2))
        if initial == ask or initial == "s" and state == 0:
            heapq.heappush(heap, (cost + extra, audit + "K", i + 1, {"s": 1, "u": 2, "a": 3}[initial]))


def plain(table):
    """The contract, row by row: {conv_id: result} of (conv_id, turn, role, text)."""
    groups = {}
    for conv, turn, role, text in table:
        rows = groups.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fate == 1:
            text = ""
        elif fate == 2:
            text = "".join(c for c in text if c not in ".!?")
        elif fate == 4:
            role = "user"
        rows += [(turn, role, text)] * {0: 0, 3: 2}.get(fate, 1)
    out = {}
    for conv, rows in groups.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        judged, seen = [], set()
        for _, role, text in rows:
            inked = text.strip(SPACES)
            fault = "blank" if not inked else "duplicate" if (role, text) in seen else "truncated" if inked[-1] not in ".!?" else ""
            seen.add((role, text))
            judged.append((role[:1], fault))
        cost, audit = cheapest(judged)
        state, left, lines = 0, list(rows), []
        for e in audit:
            ask = "assistant" if state == 2 else "user"
            _, role, text = (None, ask, "") if e == "I" else left.pop(0)
            if e == "D":
                continue
            role = ask if e == "R" else role
            state = "_sua".index(role[0])
            lines.append(f"{role}:{text}")
        turns = {t for t, *_ in rows if t is not None}
        faults = [f for _, f in judged]
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
                     sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(judged)), cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def cheapest(rows):
    """The search's result for long inputs: best (cost, audit) per state, audits as plain strings."""
    def close(best):
        for _ in range(4):
            for s, (c, a) in list(best.items()):
                to, cand = (3 if s == 2 else 2), (c + 3, a + "I")
                best[to] = min(best.get(to, cand), cand)
        return best

    best = close({0: (0, "")})
    for initial, fault in rows:
        now = {}
        for s, (c, a) in best.items():
            asked, extra = "a" if s == 2 else "u", 3 * (fault == "truncated")
            offers = [(s, (c + 4, a + "D"))]
            if fault not in ("blank", "duplicate"):
                offers.append((3 if s == 2 else 2, (c + 3 + extra, a + "R")))
                if initial == asked or initial == "s" and s == 0:
                    offers.append(("_sua".index(initial), (c + extra, a + "K")))
            for to, cand in offers:
                now[to] = min(now.get(to, cand), cand)
        best = close(now)
    return min(best[s] for s in (0, 3) if s in best)


def rows_of(rng, n):
    return [(rng.choice(["s", "u", "a", " ", ""]), rng.choice(["", "", "", "blank", "duplicate", "truncated"])) for _ in range(n)]


def test_least_audit_equals_search():
    rng = random.Random(3)
    for _ in range(300):
        rows = rows_of(rng, rng.randrange(6))
        assert C.accepted(C.audits(rows)) == search(rows) == cheapest(rows)


def test_long_conversations_and_weak_hashes():
    rng = random.Random(4)
    for n in (50, 200, 700):
        rows = rows_of(rng, n)
        assert C.accepted(C.audits(rows)) == cheapest(rows)
        assert C.accepted(C.audits(rows, make=lambda: C.Audits(base=3, modulus=5))) == cheapest(rows)  # collisions are found out


def test_common_prefixes():
    rng = random.Random(5)
    for modulus in ((1 << 61) - 1, 7):
        strings, nodes = C.Audits(modulus=modulus), {0: ""}
        for _ in range(400):
            parent = rng.choice(list(nodes))
            letter = rng.choice("DK")
            nodes[strings.add(parent, letter)] = nodes[parent] + letter
        for _ in range(3000):
            a, b = rng.choice(list(nodes)), rng.choice(list(nodes))
            n = next((i for i, (c, d) in enumerate(zip(nodes[a], nodes[b])) if c != d), min(len(nodes[a]), len(nodes[b])))
            assert strings.common(a, b) == n
            assert strings.less(a, b) == (nodes[a] < nodes[b])


def as_dict(found):
    rows = [tuple(r) for r in found.collect()]
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: r[1:] for r in rows}


def test_query_equals_plain(spark):
    from apsight.llm.queries import op12_conversation_repair

    got = op12_conversation_repair(spark, "/root/testdata/sf0.01")
    table = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert as_dict(got) == plain(table)


@pytest.mark.parametrize("chunk_rows", [1, 3, 50])
def test_chunks_and_edges(spark, chunk_rows):
    rng = random.Random(chunk_rows)
    texts = ["Yes.", "No", "  ", "", None, "Yes.", "Why? ", "a" * 50_000 + "."]
    table = [(conv, rng.choice([None, *range(-3, 60)]), rng.choice(["system", "user", "assistant", "tool", "", None]), rng.choice(texts))
             for conv in (None, 1, 2, 3) for _ in range(rng.randrange(1, 60))]
    table += [(9, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for t in range(400)]  # most of all rows
    table += [(7, None, None, None), (8, 5, "user", "Same."), (8, 5, "user", "Same."), *((100 + i, i, "user", "Gone?") for i in range(60))]
    df = spark.createDataFrame([(*r, "x", True, 1) for r in table], "conv_id long, turn long, role string, text string, audit string, whole boolean, place long")
    got = as_dict(C.repair(C.damaged(df.repartition(4)), chunk_rows))
    assert got == plain(table)


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.repair(C.damaged(df)).collect() == []

"""Spelling variants against a comparison by deletion neighbourhoods in plain Python."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from apsight.llm import variants as V

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain_words(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    """Whether a and b differ by exactly one inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a != b and (len(a) == len(b) and a[i + 1:] == b[i + 1:] or len(a) + 1 == len(b) and a[i:] == b[i + 1:])


def plain(rows):
    words = plain_words(rows)
    by_less = defaultdict(set)
    for w in words:
        for i in range(len(w) + 1):
            by_less[w[:i] + w[i + 1:]].add(w)
    near = {w: set() for w in words}
    for group in by_less.values():
        for a in group:
            near[a] |= {b for b in group if one_edit(a, b)}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best and words[best] >= 5 * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None)
    return out


def check(found, rows):
    got = [tuple(r) for r in found.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len({r[0] for r in got}) == len(got)
    assert {r[0]: r[1:] for r in got} == plain(rows)
    return got


def test_query_equals_plain(spark):
    from apsight.llm.queries import op11_spelling_variants

    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    got = check(op11_spelling_variants(spark, "/root/testdata/sf0.01"), rows)
    assert any(r[1] for r in got)


@pytest.mark.parametrize("least_rows", [1, 7, 10**9])
def test_random_words(spark, least_rows):
    rng = random.Random(11)
    base = ["".join(rng.choice("abÿ") for _ in range(rng.randrange(5, 9))) for _ in range(60)]
    base += ["aaaaaa", "aaaaaaa", "aaaaab", "baaaaa", "a" * 3000, "a" * 3001, "a" * 2999 + "b", "straßen", "Àbcdefg", "àbcdefg", "x×÷xxxx"]
    rows = [(i % 400, " ".join(rng.choices(base, [5 ** rng.randrange(1, 5) for _ in base], k=30))) for i in range(500)]
    rows += [(i, f"chainzz {'chainzzz ' * 5}{'chaonzzz ' * 40}{'Chaonzzy, ' * 300}") for i in range(1000, 1005)]  # a chain of forms
    rows += [(None, "nullid nullid nullid nullid nullid nullide"), (5, None), (6, ""), (7, "short"), (7, "short"), (8, "écombining écombining")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n long, word string").repartition(5)
    check(V.spelling_variants(df, least_rows=least_rows), rows)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert V.spelling_variants(df).collect() == []


def test_node_numbers_are_prefixes():
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(1, 12))) for _ in range(300)})
    for step in (1, 5, 40):
        bounds = words[::step]
        bound_nodes = list(V.trie_nodes(bounds, 1 << 62))
        names = {}
        for lot in range(7):  # tasks: each a range of the sorted words
            some = words[lot * len(words) // 7:(lot + 1) * len(words) // 7]
            inner = [b for b in [*bounds, *(words[k * len(words) // 7] for k in range(7))]]
            inner = sorted(set(inner))
            nodes = V.trie_nodes(some, lot + 1 << 40, inner, list(V.trie_nodes(inner, 1 << 62)))
            for word, ids in zip(some, nodes, strict=True):
                assert len(ids) == len(word) + 1
                for d, node in enumerate(ids):
                    assert names.setdefault(node, word[:d]) == word[:d]
        assert len(names) == len(set(names.values()))
        assert len(bound_nodes) == len(bounds)


def test_shared():
    rng = random.Random(2)
    for _ in range(3000):
        a, b = ("".join(rng.choice("ab") if rng.random() < 0.03 else "a" for _ in range(rng.randrange(90))) for _ in range(2))
        assert V.shared(a, b) == next((i for i, (c, d) in enumerate(zip(a, b)) if c != d), min(len(a), len(b)))

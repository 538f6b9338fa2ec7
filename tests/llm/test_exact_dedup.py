"""Exact duplicates against a dictionary of whole texts; quotient filters against counters."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from apsight.llm import exact_dedup as X

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def plain(rows):
    """{doc_id: (text_sha256, keep_id, group_size, row that stays)} of rows (doc_id, text); ids are unique or null."""
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[SPACE.sub("", text or "")].append((-len(text or ""), doc_id is None, doc_id))
    return {norm: (hashlib.sha256(norm.encode()).hexdigest(), min(group)[2], len(group), min(group)) for norm, group in groups.items()}


def check(found, rows):
    expected = plain(rows)
    want = Counter()
    for doc_id, text in rows:
        sha, keep, size, _ = expected[SPACE.sub("", text or "")]
        want[doc_id, sha, keep, size] += 1
    got = found.select("doc_id", "text_sha256", "keep_id", "group_size", "kept", "n_chars").collect()
    assert Counter(tuple(r)[:4] for r in got) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == len(expected) and len({r.text_sha256 for r in kept}) == len(kept)  # one row of each group stays
    best = {sha: first for sha, _, _, first in expected.values()}
    for r in kept:
        assert (-r.n_chars, r.doc_id) == (best[r.text_sha256][0], best[r.text_sha256][2])


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query_equals_plain(spark, sf):
    from apsight.llm.queries import op13_exact_dedup

    rows = [tuple(r) for r in spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r for r in op13_exact_dedup(spark, f"/root/testdata/sf{sf}").collect()}
    assert len(got) == len(rows) and any(not r.kept for r in got.values())
    expected = plain(rows)
    for doc_id, text in rows:
        sha, keep, size, _ = expected[SPACE.sub("", text or "")]
        assert tuple(got[doc_id]) == (doc_id, keep, size, doc_id == keep, sha)


@pytest.mark.parametrize("bits", [1, 5, 64])
def test_edges_and_short_fingerprints(spark, bits):
    """With few bits most fingerprints collide; the bytes decide."""
    rows = [(i, f"text {i % 40}" + " " * (i % 3)) for i in range(300)] + [(1000 + i, "hot  copy" if i % 2 else "hot copy") for i in range(400)]
    rows += [(None, "no id"), (None, "no id"), (None, "text 1     "), (501, None), (502, ""), (503, " \n\t"), (504, "no id"), (7, "text 7"), (7, "text 7"), (505, " "),
             (506, "long " * 100_000), (507, "long" * 100_000), (508, "ünï cödé \U0001f600"), (509, "ünïcödé\U0001f600\v")]
    df = spark.createDataFrame([(*r, True, "x", 3) for r in rows], "doc_id long, text string, kept boolean, norm string, row long").repartition(6)
    check(X.exact_duplicates(df, bits=bits), rows)


def test_no_rows(spark):
    assert X.exact_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_filters_list_what_went_in():
    rng = np.random.default_rng(1)
    for n, range_bits, high in ((1, 1, 1 << 63), (1, 4, 1 << 60), (500, 3, 1 << 61), (5000, 8, 1 << 56), (4000, 2, 6000)):
        for of_range in (0, (1 << range_bits) - 1):
            base = np.uint64(of_range << (64 - range_bits))
            fps = np.unique(rng.integers(0, high, n, dtype=np.uint64)) | base
            counts = np.where(rng.random(len(fps)) < 0.5, 1, rng.integers(1, 1 << 40, len(fps)))
            back, again = X.listed(of_range, range_bits, *X.build(fps, counts, range_bits))
            assert (back == fps).all() and (again == counts).all()


def test_merged_filters_count_everything(spark):
    rng = np.random.default_rng(2)
    values = np.concatenate([rng.integers(-2**63, 2**63 - 1, 3000), np.full(5000, 77), rng.integers(0, 50, 2000), np.array([-1, -1, -2**63, 0, 0, 2**63 - 1])])
    df = spark.createDataFrame([(int(v),) for v in rng.permutation(values)], "fp long").repartition(7)
    for range_bits in (1, 5):
        found = X.counted(X.filters(df, range_bits, filter_rows=300), at_least=1)
        assert {r.fp: r.n for r in found.collect()} == Counter(values.tolist())

"""Operators 2, 6, 10 and the pipeline: brute force, plans, and edge rows."""

import hashlib
import re
from collections import defaultdict

import duckdb
import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from apsight.llm import packing, quality, queries, secret_scan, simhash, syncmers, urls
from apsight.llm.common import written

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_native_operators_run_no_python(spark):
    for query in (queries.op2_host_reputation, queries.op6_syncmer_fingerprints):
        assert not re.search("Python|Pandas|Arrow|MapIn", plan(query(spark, SF)))


def test_url_query_equals_sql(spark):
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    want = sorted(con.execute(queries.ORACLES["op2_host_reputation"]).fetchall())
    assert sorted(tuple(r) for r in queries.op2_host_reputation(spark, SF).collect()) == want


def test_url_reputation_shrinks(spark):
    pages, labels = [], []

    def host(name, n, bad, page=[0]):
        for i in range(n):
            page[0] += 1
            pages.append((page[0], f"http://{name}/p{i}"))
            labels.append((page[0], int(i < bad)))

    for i in range(30):
        host(f"h{i}.good.org", 40, 2)
        host(f"h{i}.spam.biz", 40, 38)
    host("one.good.org", 1, 1)
    host("new.spam.biz", 1, 0)
    pages += [(9001, "http://unseen.spam.biz/"), (9002, "http://unseen.good.org/"), (9003, None), (9004, "no url"), (9005, "HTTP://A.Example.COM/en/x?q#f"),
              (9006, "http://www.example.com/en/"), (9007, "x://b.net/es/"), (9007, "x://b.net/es/"), (9008, "http://net.org/es/"), (None, "http://c.com")]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, host string")
    got = defaultdict(list)
    for r in urls.filter_urls(df, spark.createDataFrame(labels, "page_id long, bad int")).collect():
        got[r.page_id].append(tuple(r)[1:])
    verdict = lambda url: next(v[0][3] for k, v in got.items() if k and (k, url) in pages)
    assert verdict("http://h1.spam.biz/p0") == "block" and verdict("http://h1.good.org/p0") == "allow"
    assert verdict("http://one.good.org/p0") == "allow"  # one bad page does not outweigh the domain
    assert verdict("http://new.spam.biz/p0") == "block" and verdict("http://unseen.spam.biz/") == "block"
    assert got[9003] == [("", "", None, "allow")] and got[9004] == [("", "", None, "allow")]
    assert got[9005] == [("a.example.com", "/en/x", "example.com/en/", "block")]
    assert got[9006][0][2:] == ("www.example.com/en/", "allow") and got[9007] == [("b.net", "/es/", "net/es/", "block")] * 2
    assert got[9008][0][2] is None and got[None] == [("c.com", "", None, "allow")]
    empty = urls.filter_urls(df.limit(0), spark.createDataFrame([], "page_id long, bad int"))
    assert empty.count() == 0


def test_syncmer_query_by_brute_force(spark, texts):
    rows = {r.doc_id: r for r in queries.op6_syncmer_fingerprints(spark, SF).collect()}
    ids = sorted(texts)
    assert len(rows) == len(ids)
    for a, b in zip(ids, [*ids[1:], ids[0]], strict=True):
        half = len(texts[a]) // 2
        edited = texts[a][:len(texts[a]) - half] + texts[b][:half]
        assert (rows[a].n_chars, rows[a].edited_sha256) == (len(texts[a]), hashlib.sha256(edited.encode()).hexdigest())
    near, apart = (np.array([rows[i][c] for i in ids if len(texts[i]) > 300]) for c in ("near_edited", "near_next"))
    assert near.mean() > 0.4 and apart.mean() < 0.1 and (near > apart).mean() > 0.95


def test_syncmers_by_definition(spark):
    rng = np.random.default_rng(0)
    text = " ".join(rng.choice(list("abcdefgh"), 60))
    df = spark.createDataFrame([(text,)], "text string")
    words = text.split()
    h = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(F.xxhash64("w")).collect()]
    pairs = spark.createDataFrame([(a, b) for a, b in zip(h, h[1:], strict=False)], "a long, b long").select(F.xxhash64("a", "b")).collect()
    runs = [r[0] for r in pairs]
    chosen = [i for i in range(len(words) - 3) if min(runs[i:i + 3]) in (runs[i], runs[i + 2])]
    got = syncmers.with_fingerprint(df, "text", "f").first().f
    first = {}
    for i in chosen:
        first.setdefault(tuple(words[i:i + 4]), i)
    assert sorted(v & ((1 << 22) - 1) for v in got) == sorted(first.values())


def likeness(spark, *pairs):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string").repartition(1)
    df = syncmers.with_fingerprint(syncmers.with_fingerprint(df, "a", "x"), "b", "y")
    return [r.near for r in syncmers.with_likeness(df, "x", "y", "near").orderBy("i").collect()]


def test_syncmer_likeness_of_shifted_texts(spark):
    rng = np.random.default_rng(5)
    draw = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    text = draw(1000)
    shifted = [draw(n) + text for n in (64, 65, 200)] + [text[:100] + draw(70) + text[100:], text[:300] + text[400:], text[100:] + text[:100]]
    got = likeness(spark, *[(" ".join(text), " ".join(x)) for x in [*shifted, draw(1000)]])
    assert min(got[:2]) > 0.9 and min(got[2:6]) > 0.8 and got[6] == 0.0
    assert likeness(spark, ("a b c d", "x y a b c d"), ("a b", "a b"), ("a", "b"), ("", ""))[1:] == [1.0, 0.0, 1.0]
    # shared anchors in another order are shifted unlike each other
    ten = [draw(4) for _ in range(60)]
    order = rng.permutation(60)
    filled = lambda parts: " ".join(w for part in parts for w in [*part, *draw(100)])
    assert likeness(spark, (filled(ten), filled(ten[i] for i in order)))[0] < 0.02


def test_syncmers_keep_shared_passages_of_long_texts(spark):
    rng = np.random.default_rng(6)
    draw = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    pairs = []
    for _ in range(8):
        passage = draw(100)
        pairs.append(tuple(" ".join(draw(5000) + passage + draw(n)) for n in (5000, 7000)))
    assert min(likeness(spark, *pairs)) > 0.002  # some 65 of 13,000 anchors
    row = syncmers.fingerprints(spark.createDataFrame([(1, pairs[0][0])], "doc_id long, text string")).first()
    assert len(row.anchors) > 6000 and len(row.fingerprint) == 16 * len(row.anchors)


def test_syncmer_edges(edge, spark):
    rows = syncmers.compared_with_edit(edge).collect()
    assert len(rows) == 10
    ones = [r for r in rows if r.doc_id == 1]
    assert ones[0].anchors == ones[1].anchors
    by_id = {r.doc_id: r for r in rows}
    assert by_id[2].anchors == [] and by_id[2].near_next == 1.0 and by_id[3].n_chars == 0
    assert syncmers.compared_with_edit(edge.limit(0)).count() == 0
    one = syncmers.compared_with_edit(spark.createDataFrame([(5, "a b c d e f g h")], "doc_id long, text string")).first()
    assert one.near_next == 1.0
    big = 2**60  # ids beyond what a double holds
    df = spark.createDataFrame([(big + i, f"text {i} of many") for i in range(200)], "doc_id long, text string").repartition(7)
    got = {r.doc_id: r.edited_sha256 for r in syncmers.compared_with_edit(df).collect()}
    for i in range(200):
        t, u = f"text {i} of many", f"text {(i + 1) % 200} of many"
        assert got[big + i] == hashlib.sha256((t[:len(t) - len(t) // 2] + u[:len(t) // 2]).encode()).hexdigest()


def plain_fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, fps):
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1:] ^ fps[i]) <= 4):
            a, b = root(i), root(i + 1 + int(j))
            parent[max(a, b)] = min(a, b)
    return [ids[root(i)] for i in range(len(ids))]


def test_simhash_query_by_brute_force(spark, texts):
    ids = sorted(texts)
    fps = np.array([plain_fingerprint(texts[i]) for i in ids], np.uint64)
    got = {r.doc_id: r for r in queries.op10_simhash_near_dedup(spark, SF).collect()}
    assert [got[i].fingerprint for i in ids] == [f"{int(f):016x}" for f in fps]
    assert [got[i].component_id for i in ids] == plain_components(ids, fps)


def test_golay_keys_miss_no_pair():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.choice(64, rng.integers(0, 5), replace=False):
            b[i] ^= np.uint64(1 << int(bit))
    sides = []
    for fps in (a, b):
        keys = defaultdict(dict)
        for k, r, p in zip(*(x.tolist() for x in simhash.keys_of(fps)), strict=True):
            keys[r][k] = p
        sides.append(keys)
    assert all(any(k in sides[1][r] and not (p and sides[1][r][k]) for k, p in sides[0][r].items()) for r in range(len(a)))


def test_simhash_long_runs_and_chains(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 30, dtype=np.uint64)
    fps = set(base.tolist())
    for f in base.tolist():  # chains of single flips and dense balls around each
        for _ in range(40):
            f ^= 1 << int(rng.integers(0, 64))
            fps.add(f)
    fps = np.array(sorted(fps), np.uint64)
    df = spark.createDataFrame([(int(f) - (int(f) >> 63 << 64),) for f in fps], "fp long").repartition(4)
    want = plain_components(list(range(len(fps))), fps)
    for run_rows in (1 << 14, 8):  # the second sends most runs through the chunked comparison
        roots = {r.node & (2**64 - 1): r.root & (2**64 - 1) for r in simhash.components(simhash.links(df, 4, run_rows)).collect()}
        got = defaultdict(set)
        for i, f in enumerate(fps.tolist()):
            got[roots.get(f, f)].add(i)
        expected = defaultdict(set)
        for i, c in enumerate(want):
            expected[c].add(i)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, expected.values()))


def test_simhash_edges(edge):
    rows = simhash.near_duplicates(edge).collect()
    assert len(rows) == 10 and {r.component_id for r in rows if r.doc_id in (2, 3, 4)} == {2}
    kept = simhash.keep_one(edge)
    assert kept.columns == edge.columns
    assert sorted((r.doc_id or 0, (r.text or "")[:3]) for r in kept.collect()) == [(0, "no "), (1, "The"), (2, ""), (5, "wor"), (6, "ano"), (6, "tie"), (7, "ünï")]
    assert simhash.keep_one(edge.limit(0)).count() == 0


def test_pipeline_by_brute_force(spark):
    """Every stage against its rule on what its predecessor kept."""
    docs = queries.table(spark, SF, "documents")
    columns, seen = docs.columns, {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = written(stage(spark, docs, SF), "test-stage")
        rows = {r.doc_id: r for r in out.collect()}
        assert out.columns == columns and set(rows) <= set(seen)
        ids = sorted(seen)
        if name == "quality_rules":
            assert set(rows) == {i for i in ids if quality.first_failed(quality.Measures(seen[i].text), list(quality.RULES)) is None}
        elif name == "language_id":
            assert len(rows) >= 0.99 * len(seen)
        elif name == "simhash_near_dedup":
            assert set(rows) == set(plain_components(ids, np.array([plain_fingerprint(seen[i].text) for i in ids], np.uint64)))
        else:
            assert set(rows) == set(seen) and not any(secret_scan.find(r.text) for r in rows.values())
            assert all(r.n_chars == len(r.text) for r in rows.values())
        docs, seen = out, rows
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in pieces} == set(seen) and sum(r.length for r in pieces) == sum(r.doc_tokens for r in pieces if r.start == 0)
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == set(seen)


def test_pipeline_edges(spark, edge):
    docs = edge.select("doc_id", "text", "lang", "source", "n_chars")
    for table in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, table, SF).count() >= 0
    assert packing.cut(5000, 2048) == [(0, 2048), (2048, 2048), (4096, 904)]

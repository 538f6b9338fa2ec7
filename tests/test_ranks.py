"""Distributed ranks, fold assignment of many groups, registry line order, one-pass profile, sorted sinks."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from apsight.operators import profile, splits
from apsight.operators.ranks import global_rank
from apsight.operators.vendor import registry_lookup
from apsight.sources import readers, sinks


def test_global_rank(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, *range(300)]), i) for i in range(4000)]
    ranked, n = global_rank(spark.createDataFrame(rows, "a int, b int").repartition(5), [F.desc_nulls_last("a"), F.asc("b")])
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert n == 4000 and [(r.a, r.b) for r in sorted(ranked.collect(), key=lambda r: r["rank"])] == want
    assert sorted(r["rank"] for r in ranked.collect()) == list(range(1, 4001))
    empty, n = global_rank(spark.createDataFrame([], "a int"), [F.asc("a")])
    assert n == 0 and empty.count() == 0


def test_shuffled_folds_need_no_single_partition(spark):
    df = spark.range(5000).select(F.concat(F.lit("g"), (F.col("id") % 997).cast("string")).alias("g"))
    folds = splits.shuffled_group_folds(df, "g", 5)
    assert "SinglePartition" not in folds._jdf.queryExecution().executedPlan().toString()
    sizes = Counter(r.fold for r in folds.collect())
    assert sorted(sizes.items()) == [(0, 200), (1, 200), (2, 199), (3, 199), (4, 199)]


def _groups(spark, n=600):
    rng = random.Random(7)
    rows = [(f"g{i}", int(rng.random() < 0.2 + 0.3 * (i % 3 == 0))) for i in range(n) for _ in range(400 if i < 3 else rng.randrange(1, 12))]
    return spark.createDataFrame(rows, "g string, y int"), rows


@pytest.mark.parametrize("heavy", [5, 50, 10_000])
def test_folds_of_many_groups(spark, heavy):
    """Few heavy groups one by one, the rest dealt out: disjoint groups, all rows, near-equal folds and class shares."""
    df, rows = _groups(spark)
    for folds in (splits.stratified_group_folds(df, "g", "y", 5, heavy=heavy), splits.group_kfold(df, "g", 5, heavy=heavy)):
        of = {r.g: r.fold for r in folds.collect()}
        assert folds.count() == len(of) == 600 and set(of.values()) == set(range(5))
        per, positive = defaultdict(int), defaultdict(int)
        for g, y in rows:
            per[of[g]] += 1
            positive[of[g]] += y
        assert max(per.values()) - min(per.values()) < 0.15 * len(rows) / 5 + 400
        if heavy == 10_000:
            assert max(per.values()) - min(per.values()) < 0.15 * len(rows) / 5


def test_light_groups_spread_by_class_counts(spark):
    rows = [(f"a{i}", 0) for i in range(500)] + [(f"b{i}", 1) for i in range(500)] + [("big", 0)] * 300 + [("big2", 1)] * 300 + [("big3", 1)] * 300
    of = {r.g: r.fold for r in splits.stratified_group_folds(spark.createDataFrame(rows, "g string, y int"), "g", "y", 5, heavy=3).collect()}
    for kind in "ab":
        assert sorted(Counter(f for g, f in of.items() if g[0] == kind and "big" not in g).values()) == [100] * 5


def test_registry_order_over_files_and_splits(spark, tmp_path):
    """The same prefixes in two files of several splits each: the last line of the last file wins."""
    for name, n in (("a.txt", 4000), ("b.txt", 3000)):
        lines = [f"00-00-{i % 250:02X}\tvendor {name} {i}" for i in range(n)] + ["no tab here", ""]
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    s = spark.newSession()
    s.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    s.conf.set("spark.sql.files.openCostInBytes", "0")
    reg = readers.read_oui_registry(s, str(tmp_path))
    assert reg.rdd.getNumPartitions() > 5 and reg.count() == 7000
    got = {r.prefix: r.vendor for r in reg.groupBy("prefix").agg(F.max_by("vendor", "line_no").alias("vendor")).collect()}
    assert got == {f"00-00-{i % 250:02X}": f"vendor b.txt {i}" for i in range(3000)}
    best = {r["_oui_base"]: r["_best"] for r in registry_lookup(reg).collect()}
    assert best["00-00-07"][0]["vendor"] == "vendor b.txt 2757" and best["00-00-07"][0]["src"] == 1 and best["00-00-07"][3]["src"] == 4


def test_cube_is_one_scan(spark, tmp_path):
    rng = random.Random(3)
    rows = [tuple(rng.choice([None, "a", "b", "yes"]) for _ in range(4)) + (rng.choice(["n1", "n2", None]),) for _ in range(500)]
    spark.createDataFrame(rows, "class string, type string, addresstype string, vendor string, name string").write.parquet(str(tmp_path / "t"))
    cube = profile.Cube(spark.read.parquet(str(tmp_path / "t")))
    frames = [cube.distributions(), cube.yes_share(), cube.frequent_values(5), *(cube.crosstab(*p) for p in cube.pairs)]
    assert len(frames) == 6 and cube.total == 500
    for f in frames:  # cut out of the checkpointed counts: no scan of the table, no window
        plan = f._jdf.queryExecution().executedPlan().toString()
        assert "parquet" not in plan and "Window" not in plan
    d = {(r["column"], r["value"]): r["count"] for r in cube.distributions().collect()}
    for i, c in enumerate(("class", "type", "addresstype", "vendor")):
        assert {v: n for (k, v), n in d.items() if k == c} == Counter(r[i] for r in rows)
    df = spark.read.parquet(str(tmp_path / "t"))
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(cube.yes_share().collect(), key=key) == sorted(profile.yes_share(df).collect(), key=key)
    for pair in cube.pairs:
        assert cube.crosstab(*pair, limit=7).collect() == profile.crosstab(df, *pair, limit=7).collect()
    assert {tuple(r) for r in cube.frequent_values(5).collect()} == {t for t in Counter(r[4] for r in rows).items() if t[1] > 5}


def test_sorted_sink_keeps_the_order(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.choice([None, "x", "y"]), rng.randrange(50), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "value string, count int, id int").repartition(4)
    sinks.write_sorted({"t": (df, [F.desc("count"), F.asc_nulls_first("value"), F.asc("id")])}, str(tmp_path / "s"))
    back = [(r.value, r["count"], r.id, r.row_no) for r in sinks.read_sorted(spark, str(tmp_path / "s"), "t").collect()]
    want = sorted(rows, key=lambda r: (-r[1], r[0] is not None, r[0] or "", r[2]))
    assert back == [(*r, i) for i, r in enumerate(want, 1)]
    sinks.write_sorted({"t": (df, [F.asc("id")])}, str(tmp_path / "v"), fmt="tsv")
    lines = [x.split("\t") for p in sorted((tmp_path / "v" / "t").glob("part-*")) for x in p.read_text().splitlines()[1:]]
    assert [int(x[2]) for x in lines] == list(range(2000))

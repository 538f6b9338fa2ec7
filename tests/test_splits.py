"""Split properties: exact counts, disjointness, repeatability, group rules."""

import pytest
from pyspark.sql import functions as F

from apsight.operators import splits


@pytest.fixture
def data(spark):
    rows = [(i, i % 7 == 0 and 1 or 0, f"S{i % 11}") for i in range(1, 3001)]
    return spark.createDataFrame(rows, "row_id long, y int, state string")


def test_stratified_exact_counts_and_repeatable(data):
    s = splits.stratified_holdout(data, "y", "row_id")
    got = {(r["y"], r["is_test"]): r["count"] for r in s.groupBy("y", "is_test").count().collect()}
    n1 = data.where("y = 1").count()
    n0 = data.count() - n1
    assert got[(1, True)] == (2 * n1 + 5) // 10 and got[(0, True)] == (2 * n0 + 5) // 10
    again = splits.stratified_holdout(data, "y", "row_id")
    a = {r["row_id"] for r in s.where("is_test").collect()}
    b = {r["row_id"] for r in again.where("is_test").collect()}
    assert a == b


def test_multilevel_cut_matches_brute_force(spark, monkeypatch):
    # force the histogram refinement (no early final ranking)
    monkeypatch.setattr(splits, "FINAL_RANK_ROWS", 3)
    monkeypatch.setattr(splits, "BUCKETS", 8)
    df = spark.range(1, 2001).withColumnRenamed("id", "k").withColumn("g", F.col("k") % 3)
    targets = {(0,): 100, (1,): 7, (2,): 0}
    m = splits.mark_first_n(df, ["g"], "k", "t", targets)
    from apsight.functions.hashing import hash32
    pdf = df.withColumn("h", hash32(F.col("k"), "t")).toPandas().sort_values(["g", "h", "k"])
    expect = set()
    for g, grp in pdf.groupby("g"):
        expect |= set(grp["k"].head(targets[(g,)]))
    assert {r["k"] for r in m.where("_in").collect()} == expect
    # size-dependent targets (group sizes read off the first histogram)
    fn = lambda n: n // 7
    m2 = splits.mark_first_n(df, ["g"], "k", "t", fn)
    expect2 = set()
    for g, grp in pdf.groupby("g"):
        expect2 |= set(grp["k"].head(fn(len(grp))))
    assert {r["k"] for r in m2.where("_in").collect()} == expect2


def test_sample_fixed_min_n_rows(data):
    assert splits.sample_fixed(data, 100, "row_id").count() == 100
    assert splits.sample_fixed(data, 10**6, "row_id").count() == data.count()


def test_plain_holdout_share(data):
    share = splits.plain_holdout(data, "row_id").agg(F.avg(F.col("is_test").cast("int"))).first()[0]
    assert 0.15 < share < 0.25


def test_stratified_group_folds_disjoint(data):
    f = splits.stratified_group_folds(data, "state", "y", 5)
    fm = {r["state"]: r["fold"] for r in f.collect()}
    assert len(fm) == 11 and set(fm.values()) == set(range(5))
    a = splits.assign_folds(data, f, "state")
    for k in range(5):
        test_states = {r["state"] for r in a.where(F.col("fold") == k).select("state").distinct().collect()}
        train_states = {r["state"] for r in a.where(F.col("fold") != k).select("state").distinct().collect()}
        assert not test_states & train_states
    assert a.count() == data.count()


def test_group_folds_need_three_groups(spark):
    df = spark.createDataFrame([(1, 0, "A"), (2, 1, "B")], "row_id long, y int, state string")
    with pytest.raises(ValueError):
        splits.stratified_group_folds(df, "state", "y", 5)


def test_group_kfold_balances_sizes(spark):
    df = spark.createDataFrame([(i, f"g{i % 10}") for i in range(100)], "row_id long, state string")
    f = splits.group_kfold(df, "state", 5)
    sizes = splits.assign_folds(df, f, "state").groupBy("fold").count().collect()
    assert sorted(r["count"] for r in sizes) == [20] * 5


def test_shuffled_group_folds_sizes_and_null(spark):
    df = spark.createDataFrame([(i, None if i == 0 else f"s{i}") for i in range(12)], "row_id long, state string")
    f = splits.shuffled_group_folds(df, "state", 5).collect()
    sizes = sorted([sum(1 for r in f if r["fold"] == k) for k in range(5)], reverse=True)
    assert sizes == [3, 3, 2, 2, 2]
    assert any(r["state"] is None for r in f)   # null is one of the groups
    a = splits.assign_folds(df, splits.shuffled_group_folds(df, "state", 5), "state")
    assert a.where(F.col("fold").isNull()).count() == 0


def test_drop_unknown_null_rules(spark):
    df = spark.createDataFrame([("unknown",), ("a",), (None,)], "l string")
    assert splits.drop_unknown(df, "l").count() == 1
    assert splits.drop_unknown(df, "l", keep_null=True).count() == 2


def test_small_group_filter(data):
    out = splits.small_group_filter(data, "state", 273)
    assert {r["state"] for r in out.select("state").distinct().collect()} == {
        r["state"] for r in data.groupBy("state").count().where("count >= 273").collect()}

"""Profiling operators: null rules, shares, limits (FIXTURES §3) and plan shape."""

import pytest

from apsight.operators import profile


@pytest.fixture
def rows(spark):
    data = [
        ("a", "yes", "US", "n1"), ("a", "no", "us", "n1"), ("b", "no", "Us", "n1"),
        (None, "yes", "US", "n1"), (None, "no", None, "n1"), ("c", "yes", "xx", "n2"),
    ] + [("a", "no", "US", "six")] * 6 + [("a", "no", "US", "five")] * 5
    return spark.createDataFrame(data, "class string, type string, add_country_code string, name string")


def test_country_filter_case_and_null(rows):
    us = profile.country_filter(rows)
    assert us.count() == 4 + 11  # 'US', 'us', 'Us' kept; null and 'xx' dropped


def test_country_filter_skipped_without_column(spark):
    df = spark.createDataFrame([(1,)], "x int")
    assert profile.country_filter(df) is df


def test_yes_share_null_rules(rows):
    out = {r["class"]: r for r in profile.yes_share(rows).collect()}
    assert out["b"]["yes_count"] == 0 and out["b"]["yes_proportion"] is None   # class without 'yes'
    assert out[None]["yes_count"] == 0 and out[None]["yes_proportion"] is None  # null class matches nothing
    assert out["a"]["yes_count"] == 1 and out["a"]["total_in_class"] == 13
    assert out["c"]["yes_proportion"] == 1.0


def test_frequent_names_threshold(rows):
    names = {r["name"] for r in profile.frequent_values(rows, "name", 5).collect()}
    assert "six" in names and "five" not in names


def test_distributions_sum_to_one_and_keep_null(rows):
    d = profile.distributions(rows, ["class", "type"]).collect()
    by_col = {}
    for r in d:
        by_col.setdefault(r["column"], []).append(r)
    for col, rs in by_col.items():
        assert sum(r["count"] for r in rs) == rows.count()
        assert abs(sum(r["proportion"] for r in rs) - 1.0) < 1e-12
    assert any(r["value"] is None for r in by_col["class"])


def test_distributions_single_scan(rows, spark, tmp_path):
    p = str(tmp_path / "t.parquet")
    rows.write.parquet(p)
    df = spark.read.parquet(p)
    cube = profile.Cube(df, ["class", "type", "name"])
    plan = cube.counts._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("FileScan") == 1
    assert "Expand" in plan
    assert "FileScan" not in cube.distributions()._jdf.queryExecution().executedPlan().toString()


def test_crosstab_limit_tie_break(spark):
    data = [(f"v{i:02d}", "t") for i in range(10)]
    df = spark.createDataFrame(data, "vendor string, type string")
    out = profile.crosstab(df, "vendor", "type", total=10, limit=3).collect()
    assert [r["vendor"] for r in out] == ["v00", "v01", "v02"]
    assert all(r["proportion_within_type"] == 0.1 for r in out)  # marginals before the limit


def test_top_n_and_share(spark):
    data = [("a",)] * 50 + [("b",)] * 30 + [("c",)] * 15 + [("d",)] * 5
    df = spark.createDataFrame(data, "v string")
    cov = profile.top_n_coverage(df, "v", 2).first()
    assert cov["covered"] == 80 and cov["coverage"] == 0.8
    # cumulative shares 0.5, 0.8, 0.95, 1.0 -> three are <= 0.95, plus one
    assert profile.values_for_share(df, "v", 0.95).first()["n_values_for_share"] == 4


def test_distinct_count_exact_and_approx(spark):
    df = spark.range(0, 5000).selectExpr("cast(id % 1234 as string) as v")
    assert profile.distinct_count(df, "v").first()[0] == 1234
    approx = profile.distinct_count(df, "v", approx=True).first()[0]
    assert abs(approx - 1234) / 1234 < 0.05
    top = profile.top_values(df, "v", 3).collect()
    assert [r["count"] for r in top] == [5, 5, 5] and top[0]["v"] < top[1]["v"]


def test_values_for_share_brute_force(spark):
    import numpy as np
    rng = np.random.default_rng(4)
    vals = [f"v{int(x)}" for x in rng.zipf(1.6, 5000) if x < 400]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    cnt = {}
    for v in vals:
        cnt[v] = cnt.get(v, 0) + 1
    order = sorted(cnt.items(), key=lambda kv: (-kv[1], kv[0]))
    total, cum, k = len(vals), 0, 0
    for _, c in order:
        cum += c
        if cum / total <= 0.95:
            k += 1
    for share, expect in ((0.95, k + 1),):
        assert profile.values_for_share(df, "v", share).first()["n_values_for_share"] == expect

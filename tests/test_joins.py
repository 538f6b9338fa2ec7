"""Rows without a usable key: nothing lost, and no single shuffle partition holds them all."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from apsight.operators import metrics
from apsight.operators.joins import left_join_spread
from apsight.operators.vendor import vendor_lookup


@pytest.fixture
def shuffled(spark):
    """A session that shuffles every join into 16 partitions."""
    s = spark.newSession()
    for k, v in {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}.items():
        s.conf.set(k, v)
    return s


def test_null_keys_are_spread(shuffled):
    left = shuffled.range(5000).select("id", F.when(F.col("id") % 10 == 0, F.col("id")).alias("k"))
    right = shuffled.range(0, 5000, 20).select(F.col("id").alias("rk"), (F.col("id") * 2).alias("v"))
    j = left_join_spread(left, right, [("k", "rk")])
    assert "BroadcastHashJoin" not in j._jdf.queryExecution().executedPlan().toString()
    rows = j.select("id", "k", "v", F.spark_partition_id().alias("p")).collect()
    assert len(rows) == 5000
    assert all(r.v == (r.id * 2 if r.id % 20 == 0 else None) for r in rows)
    lots = Counter(r.p for r in rows if r.k is None)
    assert len(lots) == 16 and max(lots.values()) < 2 * 4500 / 16


def test_bad_sightings_are_spread(shuffled):
    sightings = shuffled.range(3000).select("id", F.when(F.col("id") % 2 == 0, "zz").otherwise("00:0B:86:01:02:03").alias("bssid"))
    registry = shuffled.createDataFrame([("00-0B-86", "V", 1)], "prefix string, vendor string, line_no long")
    got = vendor_lookup(sightings, registry).select("vendor", "vendor_src", F.spark_partition_id().alias("p")).collect()
    assert Counter((r.vendor, r.vendor_src) for r in got) == {("NaN", 0): 1500, ("V", 1): 1500}
    assert len({r.p for r in got if r.vendor == "NaN"}) == 16


def test_rank_pieces_share_a_large_group(shuffled):
    """One group of 20,000 scores: 16 pieces, none much larger than its share, no array of cuts in the plan."""
    df = shuffled.range(20_000).select((F.col("id") * 7919 % 20_000 / 20_000).alias("score"), (F.col("id") % 3 == 0).cast("int").alias("y"), F.lit("a").alias("g"))
    pieces = metrics.ranked_groups(df, "y", "score", ["g"])
    sizes = [r["count"] for r in pieces.groupBy("_piece").count().collect()]
    assert len(sizes) == 16 and sum(sizes) == 20_000 and max(sizes) < 2 * 20_000 / 16
    plan = metrics.rank_metrics(df, "y", "score", ["g"], groups=pieces)._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "hashpartitioning(g" in plan and "_piece" in plan

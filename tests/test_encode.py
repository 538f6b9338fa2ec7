"""Encoders: capped one-hot rules and target encoding against brute force."""

import numpy as np
import pytest

from apsight.operators import encode


def _vocab(spark, counts, m):
    rows = [(v,) for v, n in counts.items() for _ in range(n)]
    df = spark.createDataFrame(rows, "v string")
    return {r["value"]: r["kept"] for r in encode.ohe_vocabulary(df, "v", m).collect()}


@pytest.mark.parametrize("n_values,n_infrequent", [(4, 0), (5, 1), (6, 2)])
def test_ohe_cap(spark, n_values, n_infrequent):
    counts = {f"v{i}": 10 + i for i in range(n_values)}
    vocab = _vocab(spark, counts, 5)
    assert sum(1 for k in vocab.values() if not k) == n_infrequent


def test_ohe_ties_keep_later_name(spark):
    vocab = _vocab(spark, {"a": 5, "b": 5, "c": 5, "d": 9}, 3)  # keep 2: d and the later of a/b/c
    assert {k for k, v in vocab.items() if v} == {"d", "c"}


def test_ohe_bucket_unseen(spark):
    train = spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "v string")
    vocab = encode.ohe_vocabulary(train, "v", 3)   # 3 values >= 3 -> keep 2 (a, c), b infrequent
    test = spark.createDataFrame([("a",), ("b",), ("zzz",)], "v string")
    got = {r["v"]: r["bucket"] for r in encode.ohe_bucket(test, "v", vocab).collect()}
    assert got == {"a": "a", "b": encode.INFREQUENT, "zzz": encode.INFREQUENT}
    vocab2 = encode.ohe_vocabulary(train, "v", 10)  # no infrequent bucket -> unseen is all-zero (null)
    got2 = {r["v"]: r["bucket"] for r in encode.ohe_bucket(test, "v", vocab2).collect()}
    assert got2["zzz"] is None and got2["b"] == "b"


def _te_brute(values, ys, v):
    y = np.array(ys, dtype=float)
    mask = np.array([x == v for x in values])
    mean = y.mean()
    if mask.sum() == 0:
        return mean
    n = mask.sum()
    mc = y[mask].mean()
    lam = n * y.var() / (y[mask].var() + n * y.var())
    return lam * mc + (1 - lam) * mean


def test_target_encoding_matches_formula(spark):
    rng = np.random.default_rng(1)
    values = [f"c{int(x)}" for x in rng.integers(0, 6, 400)]
    ys = [int(x) for x in rng.integers(0, 2, 400)]
    train = spark.createDataFrame(list(zip(range(400), values, ys)), "row_id long, v string, y int")
    test = spark.createDataFrame([(0, "c1"), (1, "never")], "row_id long, v string")
    got = {r["v"]: r["te"] for r in encode.target_encode_apply(test, train, "v", "y", "te").collect()}
    assert got["c1"] == pytest.approx(_te_brute(values, ys, "c1"), abs=1e-12)
    assert got["never"] == pytest.approx(np.mean(ys), abs=1e-12)


def test_crossfit_uses_other_folds_only(spark):
    rng = np.random.default_rng(2)
    n = 300
    values = [f"c{int(x)}" for x in rng.integers(0, 4, n)]
    ys = [int(x) for x in rng.integers(0, 2, n)]
    train = spark.createDataFrame(list(zip(range(n), values, ys)), "row_id long, v string, y int")
    tr = encode.cross_fit_fold(train, "row_id", 5)
    out = encode.target_encode_crossfit(tr, "v", "y", "te").toPandas()
    for f in range(5):
        other = out[out.cf_fold != f]
        for v in ["c0", "c3"]:
            rows = out[(out.cf_fold == f) & (out.v == v)]
            if len(rows):
                assert rows.te.iloc[0] == pytest.approx(_te_brute(list(other.v), list(other.y), v), abs=1e-12)


def test_balanced_weights(spark):
    df = spark.createDataFrame([(0,)] * 90 + [(1,)] * 10, "y int")
    w = {r["y"]: r["weight"] for r in encode.balanced_class_weights(df, "y").collect()}
    assert w[0] == pytest.approx(100 / (2 * 90)) and w[1] == pytest.approx(100 / (2 * 10))
    b = encode.class_balance(df, "y").first()
    assert b["neg_pos_ratio"] == 9.0


def test_scale_without_centring(spark):
    df = spark.createDataFrame([(0.0,), (2.0,), (4.0,)], "x double")
    out = [r["x_scaled"] for r in encode.scale_by_std(df, df, ["x"]).collect()]
    assert out[0] == 0.0 and out[2] == pytest.approx(4.0 / np.std([0, 2, 4]))


def test_label_index_alphabetical(spark):
    df = spark.createDataFrame([("z",), ("a",), ("m",), ("a",)], "l string")
    got = {r["l"]: r["idx"] for r in encode.index_labels(df, "l", "idx").collect()}
    assert got == {"a": 0.0, "m": 1.0, "z": 2.0}

"""Metrics: golden matrices from recorded runs, AP/AUC examples, properties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from apsight.operators import metrics, thresholds


def _from_matrix(spark, m, labels):
    rows = [(a, p) for i, a in enumerate(labels) for j, p in enumerate(labels) for _ in range(m[i][j])]
    return spark.createDataFrame(rows, "actual int, predicted int")


def _matrix_summary(spark, m, labels):
    """Summary straight from a confusion table (no row expansion)."""
    conf = spark.createDataFrame([(a, p, m[i][j]) for i, a in enumerate(labels) for j, p in enumerate(labels)],
                                 "actual int, predicted int, n long")
    return metrics.summary(conf, "actual", "predicted").first(), conf


def test_golden_binary_matrix(spark):
    # recorded run: [[329599, 48495], [8325, 13581]] -> accuracy 0.85795, macro F1 0.6220354507985464
    s, conf = _matrix_summary(spark, [[329599, 48495], [8325, 13581]], [0, 1])
    assert s["accuracy"] == pytest.approx(0.85795, abs=1e-12)
    assert s["macro_f1"] == pytest.approx(0.6220354507985464, abs=1e-12)
    assert s["weighted_f1"] == pytest.approx(0.8879378090533527, abs=1e-12)
    rep = {r["class"]: r for r in metrics.report(conf, "actual", "predicted").collect()}
    assert round(rep["0"]["precision"], 3) == 0.975 and round(rep["1"]["recall"], 3) == 0.62
    assert round(rep["macro avg"]["recall"], 3) == 0.746 and rep["macro avg"]["support"] == 400000.0
    assert round(rep["weighted avg"]["precision"], 3) == 0.934
    assert rep["accuracy"]["support"] == rep["accuracy"]["f1"]


# Recorded runs (confusion matrix -> accuracy, macro F1, weighted F1).
GOLDEN = [
    ([[350402, 40395], [9066, 12695]], (0.880111402517949, 0.6366412592083536, 0.9026980711974444)),
    ([[7021, 2896, 6802, 2373, 5047, 1427],
      [3141, 4391, 3626, 3357, 6779, 1921],
      [347, 186, 843, 185, 389, 125],
      [2671, 3370, 1632, 30935, 19141, 4586],
      [7048, 9795, 5602, 24636, 113812, 18373],
      [4645, 5719, 6239, 9729, 26481, 6955]],
     (0.4654893888849457, 0.2966116229477046, 0.46971596112460634)),
]


@pytest.mark.parametrize("matrix,expected", GOLDEN)
def test_golden_matrices(spark, matrix, expected):
    s, conf = _matrix_summary(spark, matrix, list(range(len(matrix))))
    assert (s["accuracy"], s["macro_f1"], s["weighted_f1"]) == pytest.approx(expected, abs=1e-12)
    if len(matrix) == 6:  # first class of the recorded report: 0.282 / 0.275 / 0.278, support 25566
        rep = {r["class"]: r for r in metrics.report(conf, "actual", "predicted").collect()}
        r0 = rep["0"]
        assert (round(r0["precision"], 3), round(r0["recall"], 3), round(r0["f1"], 3), r0["support"]) == \
            (0.282, 0.275, 0.278, 25566.0)


def test_confusion_zero_cells_and_unpredicted_class(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "a")], "actual string, predicted string")
    conf = metrics.confusion(df, "actual", "predicted")
    assert conf.count() == 9 and conf.agg(F.sum("n")).first()[0] == 3
    cs = {r["cls"]: r for r in metrics.class_stats(conf, "actual", "predicted").collect()}
    assert cs["b"]["precision"] == 0.0 and cs["b"]["f1"] == 0.0


def _rank(spark, pairs):
    df = spark.createDataFrame(pairs, "score double, y int")
    return metrics.rank_metrics(df, "y", "score").first()


def test_ap_auc_example(spark):
    pairs = [(0.1, 0), (0.4, 1), (0.4, 0), (0.35, 0), (0.8, 1), (0.9, 0), (0.2, 1)]
    r = _rank(spark, pairs)
    assert r["pr_auc"] == pytest.approx(0.5, abs=1e-9)
    assert r["roc_auc"] == pytest.approx(0.541667, abs=1e-6)


def test_auc_properties(spark):
    rng = np.random.default_rng(0)
    s = np.round(rng.random(500), 2)
    y = (rng.random(500) < 0.3).astype(int)
    r1 = _rank(spark, [(float(a), int(b)) for a, b in zip(s, y)])
    r2 = _rank(spark, [(float(a), int(1 - b)) for a, b in zip(s, y)])
    assert r1["roc_auc"] + r2["roc_auc"] == pytest.approx(1.0, abs=1e-12)
    assert 0 <= r1["pr_auc"] <= 1
    # brute force: P(score_pos > score_neg) + 0.5 P(equal)
    pos, neg = s[y == 1], s[y == 0]
    brute = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    assert r1["roc_auc"] == pytest.approx(brute, abs=1e-12)
    # brute-force AP over distinct thresholds
    order = np.argsort(-s, kind="mergesort")
    ap, prev_r = 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        pred = s >= t
        tp = (pred & (y == 1)).sum()
        p, rcl = tp / pred.sum(), tp / y.sum()
        ap += (rcl - prev_r) * p
        prev_r = rcl
    assert r1["pr_auc"] == pytest.approx(ap, abs=1e-9)
    del order


def test_all_equal_scores_and_single_class(spark):
    assert _rank(spark, [(0.3, 0), (0.3, 1), (0.3, 0)])["roc_auc"] == 0.5
    r = _rank(spark, [(0.3, 1), (0.5, 1)])
    assert r["pr_auc"] is None and r["roc_auc"] is None


def _plain_rank(rows):
    """AP and ROC-AUC by definition; null and NaN scores tie below all others."""
    rows = [(-1e9 if s is None or s != s else s, y) for s, y in rows if y is not None]
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    ap = 0.0
    for t in set(pos):
        ap += pos.count(t) / len(pos) * sum(p >= t for p in pos) / sum(s >= t for s, _ in rows)
    return ap, auc


def test_prefix_by_brute_force_with_null_groups_and_scores(spark):
    rng = np.random.default_rng(3)
    rows = [(g, None if a < 0.03 else float("nan") if a < 0.06 else round(float(a), 3), None if c < 0.02 else int(b))
            for g in ("a", None) for a, b, c in zip(rng.random(800), rng.random(800) < 0.2, rng.random(800))]
    df = spark.createDataFrame(rows, "g string, score double, y int")
    for by in (["g"], []):
        for r in metrics.rank_metrics(df, "y", "score", by).collect():
            ap, auc = _plain_rank([(s, y) for g, s, y in rows if not by or g == r["g"]])
            assert r["pr_auc"] == pytest.approx(ap, abs=1e-8) and r["roc_auc"] == pytest.approx(auc, abs=1e-12)


def test_null_labels_and_scores_are_counted(spark):
    df = spark.createDataFrame([("a", "a"), (None, "a"), ("b", None), (None, None)], "t string, p string")
    conf = metrics.confusion(df, "t", "p")
    assert sum(r["n"] for r in conf.collect()) == 4 and conf.count() == 9
    assert metrics.summary(conf, "t", "p").first()["n"] == 4
    scored = spark.createDataFrame([(0.9, 1), (None, 1), (float("nan"), 0), (0.2, 0), (None, 0)], "score double, y int")
    for r in thresholds.grid_counts(scored, "y", "score", [0.1, 0.5]).collect():
        assert r["tp"] + r["fp"] + r["fn"] + r["tn"] == 5
    groups = metrics.score_groups(scored, "y", "score")
    cells = {(r["y"], r["pred"]): r["n"] for r in metrics.binary_confusion_from_groups(groups, 0.5).collect()}
    assert cells == {(1, 1): 1, (0, 1): 0, (1, 0): 1, (0, 0): 3}
    assert scored.select(metrics.predict_at(scored.score, 0.5).alias("p")).where("p = 1").count() == 1


def test_grouped_rank_metrics(spark):
    df = spark.createDataFrame([("m1", 0.9, 1), ("m1", 0.1, 0), ("m2", 0.1, 1), ("m2", 0.9, 0)],
                               "model string, score double, y int")
    got = {r["model"]: r["roc_auc"] for r in metrics.rank_metrics(df, "y", "score", ["model"]).collect()}
    assert got == {"m1": 1.0, "m2": 0.0}


def test_bands_histogram_agreement(spark):
    df = spark.createDataFrame([(0.01, 0, 1, 1), (0.5, 1, 1, 0), (0.99, 1, 0, 0), (0.5, 0, 1, 1)],
                               "score double, y int, a int, b int")
    b = metrics.score_bands(df, "score").first()
    assert (b["share_low"], b["share_mid"], b["share_high"]) == (0.25, 0.5, 0.25)
    h = metrics.score_histogram(df, "y", "score").collect()
    assert sum(r["count"] for r in h) == 4 and max(r["bin"] for r in h) == 100
    ag = metrics.pairwise_agreement(df, ["a", "b"]).first()
    assert ag["agreement"] == 0.75


def test_histogram_matches_numpy(spark):
    rng = np.random.default_rng(11)
    y = (rng.random(3000) < 0.3).astype(int)
    sc = np.round(rng.beta(2, 5, 3000) + 0.2 * y, 4)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(sc, y)], "score double, y int")
    got = {(r["label"], r["bin"]): r for r in metrics.score_histogram(df, "y", "score").collect()}
    for lab in (0, 1):
        counts, edges = np.histogram(sc[y == lab], bins=100)
        dens, _ = np.histogram(sc[y == lab], bins=100, density=True)
        for i, c in enumerate(counts):
            if c:
                r = got[(lab, i + 1)]
                assert r["count"] == c
                assert r["density"] == pytest.approx(dens[i], rel=1e-9)
        assert sum(r["count"] for k, r in got.items() if k[0] == lab) == (y == lab).sum()
    same = spark.createDataFrame([(0.3, 1), (0.3, 1)], "score double, y int")
    assert [(r["bin"], r["count"]) for r in metrics.score_histogram(same, "y", "score").collect()] == [(1, 2)]

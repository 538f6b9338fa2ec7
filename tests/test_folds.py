"""All folds encoded in one pass: equal to the encoders fitted fold by fold; sweep and evaluation from scores."""

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from apsight.operators import encode, metrics, splits
from apsight.plans import experiment as X
from apsight.plans import folds
from apsight.sources.fixtures import Fixtures
from paths import SF_SMALL


def _frames(spark, **kw):
    cfg = X.ExperimentConfig(ohe_max=6, **kw)
    d, classes = X.prepare(Fixtures(spark, SF_SMALL).ml, cfg)
    x = folds.runs(d.checkpoint(), cfg).checkpoint()
    return cfg, d, classes, x


@pytest.mark.parametrize("target", ["label_sensitive_binary", "label_target_main"])
def test_one_pass_equals_fold_by_fold(spark, target):
    cfg, d, classes, x = _frames(spark, target=target)
    enc = folds.encode_runs(x, cfg, classes, ("full",))
    runs = sorted(r.run for r in enc.select("run").distinct().collect())
    assert runs == ["random_1", *(f"state_{i}" for i in range(1, 6))]
    n = len(classes) if len(classes) > 2 else 1
    y = {f"_{i}": (F.col("label") == float(i)).cast("int") for i in range(len(classes))} if n > 1 else "label"
    for run in ("random_1", "state_3"):
        train, test = (x.where((F.col("run") == run) & (F.col("role") == r)).select(*d.columns) for r in ("train", "test"))
        crossed = encode.cross_fit_fold(train, "row_id", 5, cfg.seed)
        for feature, at in (("vendor_clean", 0), ("add_state", 1)):
            names = [f"t{k}" for k in y] if n > 1 else ["t"]
            want = {r.row_id: tuple(r)[1:] for f in (encode.target_encode_crossfit(crossed, feature, y, "t"), encode.target_encode_apply(test, train, feature, y, "t"))
                    for r in f.select("row_id", *names).collect()}
            rows = enc.where(F.col("run") == run).select("row_id", vector_to_array("features").alias("f")).collect()
            assert len(rows) == len(want) == train.count() + test.count()
            for r in rows:
                assert r.f[6 + at * n:6 + (at + 1) * n] == pytest.approx(want[r.row_id], abs=1e-12)
        vocab = encode.ohe_vocabulary(train, "vendor_clean", 6)
        bucketed = encode.ohe_bucket(train, "vendor_clean", vocab).unionByName(encode.ohe_bucket(test, "vendor_clean", vocab))
        names = sorted({r.bucket for r in bucketed.select("bucket").distinct().collect() if r.bucket is not None} | {r.value for r in vocab.where("kept").collect()})
        want = {r.row_id: [float(r.bucket == b) for b in names] for r in bucketed.select("row_id", "bucket").collect()}
        for r in enc.where(F.col("run") == run).select("row_id", vector_to_array("features").alias("f")).collect():
            assert r.f[:len(names)] == want[r.row_id] and not any(r.f[len(names):6])
        weights = {r["label"]: r["weight"] for r in encode.balanced_class_weights(train, "label").collect()}
        for r in enc.where((F.col("run") == run) & (F.col("role") == "train")).select("label", "weight").distinct().collect():
            assert r["weight"] == pytest.approx(weights[r["label"]])


def test_variants_and_validation_rows(spark):
    cfg, d, classes, x = _frames(spark, threshold_mode="best_f1", split_modes=("random",))
    enc = folds.encode_runs(x, cfg, classes, ("fit", "full"))
    n = {(r.variant, r.role): r["count"] for r in enc.groupBy("variant", "role").count().collect()}
    assert ("full", "val") not in n and n["full", "train"] == n["fit", "train"] + n["fit", "val"] and n["full", "test"] == n["fit", "test"]
    train = splits.stratified_holdout(d, "label", "row_id", 0.2, 42).where("not is_test")
    held = {r.row_id for r in splits.stratified_holdout(train, "label", "row_id", 0.1, 43, "v").where("v").select("row_id").collect()}
    assert held == {r.row_id for r in enc.where("role = 'val'").select("row_id").collect()}


def test_options(spark):
    for kw in ({"state_folds": "shuffled"}, {"state_folds": "group_kfold"}, {"min_group_rows": 60}, {"random_split": "plain"}, {"drop_unknown": "pandas"}, {"drop_unknown": "polars"}):
        cfg, d, classes, x = _frames(spark, **kw)
        if "drop_unknown" in kw:
            assert d.join(Fixtures(spark, SF_SMALL).ml.where("label_target_main = 'unknown'"), "row_id", "left_semi").isEmpty()
        tests = x.where("role = 'test' and run like 'state%'").groupBy("row_id").count()
        assert tests.where("count <> 1").isEmpty()  # each row is tested in one state fold
    cfg = X.ExperimentConfig(ablation="no_osm_scores", scale_numeric=True)
    assert cfg.numeric_columns(Fixtures(spark, SF_SMALL).ml) == []
    assert X.ExperimentConfig().numeric_columns(Fixtures(spark, SF_SMALL).ml.withColumn("extra", F.lit(1.5))) == ["place_rank", "importance", "extra"]


def test_unusable_scores_reach_no_threshold(spark):
    rows = [(1.0, float("nan"), 1), (0.0, None, 0), (1.0, 0.9, 1), (0.0, 0.1, 0)]
    df = spark.createDataFrame(rows, "label double, score double, pred_idx int")
    m = X.evaluate(df, [0, 1], 0.5)
    assert m["n_test"] == 4 and {(a, p): n for a, p, n in m["confusion"]} == {(1, 1): 1, (1, 0): 1, (0, 0): 2, (0, 1): 0}


def test_sweep_metrics_from_scores(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [(m, w, role, int(y), float(round(min(1.0, rng.random() * 0.6 + 0.4 * y), 3))) for m in ("a", "b") for w in ("1", "2") for role in ("val", "test")
            for y in (rng.random(300) < 0.3)]
    scores = spark.createDataFrame(rows, "model string, class_weight string, role string, y int, score double")
    table = {(r.model, r.class_weight): r for r in X.sweep_metrics(scores).collect()}
    assert len(table) == 4
    for (m, w), r in table.items():
        one = scores.where((F.col("model") == m) & (F.col("class_weight") == w) & (F.col("role") == "test"))
        conf = metrics.confusion(one.withColumn("p", metrics.predict_at(F.col("score"), r.best_threshold)), "y", "p")
        s, k = metrics.summary(conf, "y", "p").first(), metrics.rank_metrics(one, "y", "score").first()
        assert (r.n_test, r.pr_auc, r.roc_auc) == (300, k.pr_auc, k.roc_auc)
        assert (r.accuracy, r.macro_f1, r.weighted_f1) == pytest.approx((s.accuracy, s.macro_f1, s.weighted_f1))


def test_state_folds_learn_from_all_rows_unless_capped(spark, monkeypatch):
    first_n, salts = splits.mark_first_n, []
    monkeypatch.setattr(splits, "mark_first_n", lambda df, by, key, salt, *a: salts.append(salt) or first_n(df, by, key, salt, *a))
    cfg, d, _, x = _frames(spark, split_modes=("state",))
    assert cfg.train_cap is None and not salts   # 5 million rows a fold before
    assert {r["count"] for r in x.groupBy("run").count().collect()} == {d.count()}
    _, _, _, capped = _frames(spark, split_modes=("state",), train_cap=100)
    assert {r["count"] for r in capped.where("role = 'train'").groupBy("run").count().collect()} == {100}
    assert capped.where("role = 'test'").count() == d.count()

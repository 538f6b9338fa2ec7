"""End-to-end plans: profiling entry, streaming enrichment."""

from apsight.plans.profiling import profile_tables, run_profile
from apsight.sources.fixtures import Fixtures
from apsight.plans import catalog
from paths import SF_SMALL


def test_profile_entry_writes_all_tables(spark, tmp_path):
    fx = Fixtures(spark, SF_SMALL)
    integ = catalog.integrated(fx)
    n = run_profile(integ, str(tmp_path / "res"))
    assert n == catalog.us_rows(fx).count() > 0
    res = spark.read.parquet(str(tmp_path / "res"))
    tables = {r["table"] for r in res.select("table").distinct().collect()}
    assert {"distribution", "yes_per_class", "frequent_names", "cross_vendor_x_type",
            "cross_type_x_addresstype", "cross_vendor_x_addresstype"} <= tables


def test_profile_stops_when_empty(spark):
    df = spark.createDataFrame([("a", "xx")], "class string, add_country_code string")
    assert profile_tables(df) is None


def test_streaming_enrichment_equals_batch(spark, tmp_path):
    from apsight.operators import geocode
    from apsight.streaming.enrich_stream import start_enrichment_stream
    fx = Fixtures(spark, SF_SMALL)
    raw = catalog.raw_text(fx)
    raw_dir = str(tmp_path / "raw")
    raw.write.option("sep", "\t").csv(raw_dir)
    q = start_enrichment_stream(spark, raw_dir, fx.oui, fx.geocode_responses, str(tmp_path / "out"),
                                str(tmp_path / "ckpt"))
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out" / "integrated")).drop("batch_id")
    want = geocode.integrated_rows(catalog.tagged(fx))
    assert got.count() == want.count() > 0
    assert got.exceptAll(want).count() == 0
    dl = spark.read.parquet(str(tmp_path / "out" / "dead_letter"))
    assert dl.count() == geocode.dead_letter_rows(catalog.tagged(fx)).count()


def test_scale_settings_bounds():
    from apsight.session import scale_settings
    tb = 1024 ** 4
    s = scale_settings(100 * tb, total_cores=4000)
    split = int(s["spark.sql.files.maxPartitionBytes"])
    assert 128 * 1024 ** 2 <= split <= 1024 ** 3
    assert int(s["spark.sql.shuffle.partitions"]) >= 4000
    small = scale_settings(10 * 1024 ** 2, total_cores=8)
    assert int(small["spark.sql.shuffle.partitions"]) == 8


def test_results_as_tsv_per_table(spark, tmp_path):
    from apsight.sources.sinks import write_results
    a = spark.createDataFrame([("x", 2, 0.5)], "value string, count long, proportion double")
    b = spark.createDataFrame([("n", 7)], "name string, count long")
    write_results({"dist": a, "names": b}, str(tmp_path / "r"), fmt="tsv")
    back = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "r" / "names"))
    assert back.columns == ["name", "count"] and back.first()["count"] == "7"


def test_experiment_run_tables(spark, tmp_path):
    from apsight.plans import experiment as X
    fx = Fixtures(spark, SF_SMALL)
    cfg = X.ExperimentConfig(models=("sgd",), split_modes=("random",), model_params={"sgd": {"maxIter": 10}})
    art = {}
    m = X.run_experiment(fx.ml, cfg, run_id="r1", artifacts=art)
    row = m.first()
    assert m.count() == 1 and 0 <= row["accuracy"] <= 1 and row["pr_auc"] is not None
    conf = art["confusion"].collect()
    assert len(conf) == 4 and sum(r["n"] for r in conf) == row["n_test"]
    rep = {r["class"]: r for r in art["report"].collect()}
    assert set(rep) == {"0", "1", "accuracy", "macro avg", "weighted avg"}
    assert abs(rep["macro avg"]["f1"] - row["macro_f1"]) < 1e-12
    X.save_run(m, art, str(tmp_path / "runs"), "r1")
    back = spark.read.parquet(str(tmp_path / "runs" / "confusion"))
    assert back.where("run_id = 'r1'").count() == 4

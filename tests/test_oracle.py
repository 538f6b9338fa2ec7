"""Every registered query against its DuckDB oracle (small scale factor), the
same comparison the driver makes: columns, row count, order-insensitive values."""

import math

import pytest

import __spark_entry__ as E
from paths import SF_SMALL

ORACLES = E.oracle_sql()
SKIP_SLOW = {"model_logreg", "model_dtree", "model_rf", "model_gbt", "model_linear_svc_calibrated", "experiment_tuned",
             "model_isotonic", "weight_sweep", "experiment_metrics", "sgd_rounds"}


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _rows(cols, recs):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in recs]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF_SMALL)
    srows = [tuple(r) for r in df.collect()]
    rel = duck(SF_SMALL).execute(ORACLES[name])
    ocols = [d[0] for d in rel.description]
    orows = rel.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(srows) == len(orows)
    assert _rows(df.columns, srows) == _rows(ocols, orows)


def test_every_query_has_a_builder_and_most_an_oracle():
    q = E.queries()
    assert set(ORACLES) <= set(q)
    q = set(q) - set(E.EXTRA_QUERIES)
    assert q - set(ORACLES) == SKIP_SLOW | {"group_folds_stratified", "group_kfold"}


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["column", "value", "count", "proportion"]


@pytest.mark.parametrize("name", ["vendor_lookup", "distribution_all", "geocode_join", "split_stratified",
                                  "target_encode_crossfit", "average_precision", "operating_curve"])
def test_no_python_udf_in_plans(spark, name):
    df = E.queries()[name](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for marker in ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "FlatMapGroupsInPandas"):
        assert marker not in plan


def test_scan_prunes_columns(spark):
    df = E.queries()["split_plain"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    # the orders scan reads only the columns the fixture needs
    scans = [l for l in plan.splitlines() if "FileScan parquet" in l and "orders" in l]
    assert scans and all("o_orderdate" not in l.split("ReadSchema")[1] for l in scans)

"""Geocode enrichment: reasons, JSON edge cases, dead letter (FIXTURES §3)."""

from apsight.operators import geocode


def _run(spark, raw_rows, responses):
    raw = spark.createDataFrame(raw_rows, "epochtime string, bssid string, latlong string, c3 string, c4 string, altitude string")
    reg = spark.createDataFrame([("00-11-22", "Zero", 1)], "prefix string, vendor string, line_no long")
    resp = spark.createDataFrame(responses, "lat double, lon double, status int, body string")
    return geocode.enrich(raw, reg, resp)


def test_reasons_and_fields(spark):
    raw = [
        ("1", "00:11:22:00:00:01", "1.5,2.5", None, None, "10"),     # ok with address
        ("2", "00:11:22:00:00:02", "1.0,2.0", None, None, None),     # JSON without address
        ("3", "00:11:22:00:00:03", "3.0,3.0", None, None, "1"),      # {"error": ..} with 200
        ("4", "00:11:22:00:00:04", "4.0,4.0", None, None, "1"),      # not json
        ("5", "00:11:22:00:00:05", "5.0,5.0", None, None, "1"),      # http 500
        ("6", "00:11:22:00:00:06", "6.0,6.0", None, None, "1"),      # no response
        ("7", "00:11:22:00:00:07", "7.0", None, None, "1"),          # no comma
        ("x", "00:11:22:00:00:08", "1.5,2.5", None, None, "1"),      # bad epoch
        ("9", "ZZ:11:22:00:00:09", "1.5,2.5", None, None, "1"),      # non-hex octet
    ]
    resp = [
        (1.5, 2.5, 200, '{"place_id": 5, "class": "amenity", "importance": 0.5, "address": {"state": "Ohio", "ISO3166-2-lvl4": "US-OH", "country_code": "us"}}'),
        (1.0, 2.0, 200, '{"place_id": 6, "class": "highway"}'),
        (3.0, 3.0, 200, '{"error": "Unable to geocode"}'),
        (4.0, 4.0, 200, 'not json'),
        (5.0, 5.0, 500, ''),
    ]
    t = _run(spark, raw, resp)
    reasons = {r["raw_epochtime"]: r["reason"] for r in t.collect()}
    assert reasons == {"1": None, "2": None, "3": None, "4": "bad_json", "5": "http_500", "6": "no_response",
                       "7": "bad_row", "x": "bad_row", "9": "bad_row"}
    good = {r["epochtime"]: r for r in geocode.integrated_rows(t).collect()}
    assert good[1]["add_state"] == "Ohio" and good[1]["add_ISO3166v14"] == "US-OH" and good[1]["place_id"] == 5
    assert good[2]["add_state"] is None and good[2]["class"] == "highway"
    assert all(good[3][c] is None for c in ("place_id", "class", "add_state"))
    dl = geocode.dead_letter_rows(t)
    assert dl.count() == 6
    assert {r["error_code"] for r in dl.collect() if r["reason"] == "http_500"} == {500}
    c = geocode.run_counters(t).first()
    assert (c["processed"], c["failed_geo"], c["bad_rows"]) == (9, 3, 3)


def test_duplicate_responses_do_not_multiply(spark):
    raw = [("1", "00:11:22:00:00:01", "1.5,2.5", None, None, "1")]
    resp = [(1.5, 2.5, 500, ''), (1.5, 2.5, 200, '{"place_id": 1}'), (1.5, 2.5, 200, '{"place_id": 2}')]
    t = _run(spark, raw, resp)
    rows = t.collect()
    assert len(rows) == 1 and rows[0]["reason"] is None and rows[0]["place_id"] == 2


def test_enrichment_plan_writes_both_sinks(spark, tmp_path):
    from apsight.plans.enrich import run_enrichment
    raw = [("1", "00:11:22:00:00:01", "1.5,2.5", None, None, "1"), ("2", "00:11:22:00:00:02", "9.0,9.0", None, None, "1")]
    t = _run(spark, raw, [(1.5, 2.5, 200, '{"place_id": 1}')])
    counters = run_enrichment(spark, t, str(tmp_path / "out"))
    assert counters["processed"] == 2 and counters["failed_geo"] == 1
    assert spark.read.parquet(str(tmp_path / "out" / "integrated")).count() == 1
    assert spark.read.parquet(str(tmp_path / "out" / "dead_letter")).first()["reason"] == "no_response"


def test_raw_reader_comments_quotes_and_short_rows(spark, tmp_path):
    from apsight.sources.readers import read_raw_sightings
    p = tmp_path / "raw.tsv"
    p.write_text('# epoch\tbssid\tlatlong\tx\ty\talt\n'
                 '1\t00:11:22:00:00:01\t"1.5,2.5"\ta\tb\t10\n'
                 '2\t00:11:22:00:00:02\t3.0,4.0\n')
    rows = read_raw_sightings(spark, str(p)).orderBy("epochtime").collect()
    assert len(rows) == 2
    assert rows[0]["latlong"] == "1.5,2.5" and rows[0]["altitude"] == "10"
    assert rows[1]["altitude"] is None   # short row: missing columns are null
    parsed = geocode.parse_sightings(read_raw_sightings(spark, str(p))).orderBy("epochtime").collect()
    assert (parsed[0]["lat"], parsed[0]["lon"]) == (1.5, 2.5)


def test_bodies_are_parsed_once(spark):
    """geocode_json_fields: one parse a body (it stood once in every output column), rows of one partition dealt out."""
    from apsight.plans import catalog
    from paths import SF_SMALL
    plan = catalog.QUERIES["geocode_json_fields"](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1 and "Repartition" in plan

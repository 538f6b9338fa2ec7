"""Edge rows for BSSID parsing and the bit-flip vendor lookup (FIXTURES §3)."""

from pyspark.sql import functions as F

from apsight.operators import vendor


def _registry(spark, rows):
    return spark.createDataFrame(rows, "prefix string, vendor string, line_no long")


def _lookup(spark, bssids, registry_rows):
    s = spark.createDataFrame([(i, b) for i, b in enumerate(bssids)], "id int, bssid string")
    out = vendor.vendor_lookup(s, _registry(spark, registry_rows)).orderBy("id").collect()
    return [(r["vendor"], r["mac_flags"], r["vendor_src"], r["bad_bssid"]) for r in out]


def test_short_bssid_is_unknown(spark):
    assert _lookup(spark, ["AA:BB"], [("AA-BB-CC", "X", 1)]) == [("NaN", 0, 0, False)]


def test_normalisation_dashes_blanks_case(spark):
    res = _lookup(spark, ["  aa-bb-cc-00-00-01 ", "AA:BB:CC:00:00:01"], [("AA-BB-CC", "Acme", 1)])
    assert res[0] == res[1] == ("Acme", 2, 1, False)


def test_each_flip_code(spark):
    reg = [("00-11-22", "Zero", 1)]
    res = _lookup(spark, ["00:11:22:00:00:01", "01:11:22:00:00:01", "02:11:22:00:00:01", "03:11:22:00:00:01"], reg)
    assert res == [("Zero", 0, 1, False), ("Zero", 1, 2, False), ("Zero", 2, 3, False), ("Zero", 3, 4, False)]


def test_as_is_wins_over_flip(spark):
    reg = [("00-11-22", "Flipped", 1), ("01-11-22", "AsIs", 2)]
    assert _lookup(spark, ["01:11:22:00:00:00"], reg) == [("AsIs", 1, 1, False)]


def test_flip_order_multicast_before_local(spark):
    # 03 -> as-is 03 (miss), flip multicast 02, flip local 01, flip both 00
    reg = [("01-11-22", "Local", 1), ("02-11-22", "Multicast", 2)]
    assert _lookup(spark, ["03:11:22:00:00:00"], reg) == [("Multicast", 3, 2, False)]


def test_unknown_prefix_keeps_flags(spark):
    assert _lookup(spark, ["03:99:99:00:00:00"], [("00-11-22", "Zero", 1)]) == [("NaN", 3, 0, False)]


def test_unpadded_octets_do_not_match(spark):
    reg = [("00-0B-86", "Aruba", 1)]
    assert _lookup(spark, ["0:b:86:00:00:00"], reg)[0][0] == "NaN"
    assert _lookup(spark, ["0:0B:86:00:00:00"], reg)[0] == ("Aruba", 0, 1, False)


def test_pad_octets_option(spark):
    s = spark.createDataFrame([("0:b:86:00:00:00",)], "bssid string")
    reg = _registry(spark, [("00-0B-86", "Aruba", 1)])
    assert vendor.vendor_lookup(s, reg).first()["vendor"] == "NaN"
    assert vendor.vendor_lookup(s, reg, pad_octets=True).first()["vendor"] == "Aruba"


def test_non_hex_octet_is_bad_row(spark):
    assert _lookup(spark, ["ZZ:11:22:00:00:00"], [("00-11-22", "Zero", 1)]) == [("NaN", 0, 0, True)]


def test_duplicate_prefix_later_line_wins(spark):
    reg = [("00-11-22", "First", 1), ("00-11-22", "Second", 2)]
    assert _lookup(spark, ["00:11:22:00:00:00"], reg)[0][0] == "Second"


def test_registry_reader(spark, tmp_path):
    from apsight.sources.readers import read_oui_registry
    p = tmp_path / "oui.txt"
    p.write_text("no tab line\n00-11-22\tFirst Vendor\naa-bb-cc\tLower Case\n00-11-22\tSecond Vendor\nDD-EE-FF\t\n")
    reg = read_oui_registry(spark, str(p))
    rows = {(r["prefix"], r["vendor"]) for r in reg.collect()}
    assert ("AA-BB-CC", "Lower Case") in rows
    assert not any(p_ == "DD-EE-FF" for p_, _ in rows)  # tab but no vendor: skipped
    s = spark.createDataFrame([("00:11:22:00:00:00",)], "bssid string")
    assert vendor.vendor_lookup(s, reg).first()["vendor"] == "Second Vendor"


def test_lookup_is_broadcast_and_udf_free(spark, tmp_path):
    s = spark.createDataFrame([("00:11:22:00:00:00",)], "bssid string")
    _registry(spark, [("00-11-22", "Zero", 1)]).write.parquet(f"{tmp_path}/registry")  # a table of known size
    plan = vendor.vendor_lookup(s, spark.read.parquet(f"{tmp_path}/registry"))._jdf.queryExecution() \
        .executedPlan().toString()
    assert "BroadcastHashJoin" in plan or "BroadcastExchange" in plan
    assert "PythonUDF" not in plan and "BatchEvalPython" not in plan


def test_alias_canonicalisation(spark):
    aliases = spark.createDataFrame(
        [("Cisco", "Cisco Meraki", 1), ("Nokia Networks", "Nokia", 2), ("Nokia", "Nokia", 3)],
        "canonical string, alias string, line_no long")
    df = spark.createDataFrame([("Cisco  MERAKI",), ("nokia",), ("cisco",), ("Other Co",), (None,)], "vendor string")
    out = vendor.canonicalize_vendor(df, aliases).collect()
    got = {r["vendor"]: r["vendor_clean"] for r in out}
    assert got["Cisco  MERAKI"] == "Cisco"
    assert got["nokia"] == "Nokia"          # later line wins
    assert got["cisco"] == "Cisco"          # canonical name is its own alias
    assert got["Other Co"] == "Other Co"    # unmatched keeps the raw name
    assert got[None] is None


def test_normalize_vendor_unicode_space(spark):
    from apsight.functions.text import normalize_vendor
    df = spark.createDataFrame([(" A \tB  C ",)], "v string")
    assert df.select(normalize_vendor(F.col("v"))).first()[0] == "a b c"


def test_alias_rows_and_canonical_without_aliases(spark):
    aliases = vendor.alias_rows(spark, {"Cisco": ["Cisco Systems, Inc", "Cisco Meraki"], "TP-Link": [],
                                        "Linksys": ["Cisco Meraki"]})
    assert [r["line_no"] for r in aliases.collect()] == [1, 2, 3, 4]
    df = spark.createDataFrame([("tp-link",), ("CISCO MERAKI",), ("cisco systems, inc",)], "vendor string")
    got = {r["vendor"]: r["vendor_clean"] for r in vendor.canonicalize_vendor(df, aliases).collect()}
    assert got == {"tp-link": "TP-Link", "CISCO MERAKI": "Linksys", "cisco systems, inc": "Cisco"}

"""Registry of named queries: a Spark builder and (where SQL can express it)
the DuckDB oracle text. ``__spark_entry__`` only exposes this registry.

Every builder reads the driver tables of ``sf_dir`` (or frames Spark derives
from them), so its work grows with the data.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apsight import schemas
from apsight.operators import profile, thresholds as TH, vendor
from apsight.plans import oracle_sql as O
from apsight.sources.fixtures import Fixtures

Builder = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn: Builder) -> Builder:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


# ---------------------------------------------------------------- shared frames

def integrated(fx: Fixtures) -> DataFrame:
    """Sightings with vendor, mac_flags and vendor_src."""
    return vendor.vendor_lookup(fx.ap, fx.oui)


def us_rows(fx: Fixtures) -> DataFrame:
    return profile.country_filter(integrated(fx))


def ml_rows(fx: Fixtures) -> DataFrame:
    """Modelling rows with the required fields present."""
    return fx.ml.where(F.col("vendor_clean").isNotNull() & F.col("add_state").isNotNull())


# ------------------------------------------------------------ enrichment (J1..)

@query("vendor_lookup", O.with_integrated() + """
select ap_id, bssid, vendor, mac_flags, vendor_src from integrated""")
def q_vendor_lookup(spark, sf_dir):
    return integrated(Fixtures(spark, sf_dir)).select("ap_id", "bssid", "vendor", "mac_flags", "vendor_src")


@query("mac_flags", O.oracle_with(["ap", "oui"]) + """
select ap_id, bssid,
  cast(('0x' || p[1])::BIGINT & 3 as integer) as mac_flags,
  printf('%02X', ('0x' || p[1])::BIGINT) || '-' || p[2] || '-' || p[3] as oui_key,
  printf('%02X', xor(('0x' || p[1])::BIGINT, 3)) || '-' || p[2] || '-' || p[3] as oui_key_flip_both
from (select *, string_split(replace(upper(trim(bssid)), '-', ':'), ':') as p from ap)""")
def q_mac_flags(spark, sf_dir):
    from apsight.functions.mac import mac_fields, oui_key
    fx = Fixtures(spark, sf_dir)
    m = mac_fields(F.col("bssid"))
    return fx.ap.select("ap_id", "bssid", m["mac_flags"].alias("mac_flags"),
                        oui_key(F.col("bssid")).alias("oui_key"),
                        oui_key(F.col("bssid"), 3).alias("oui_key_flip_both"))


@query("vendor_src_counts", O.with_integrated() + """
select vendor_src, mac_flags, count(*) as count from integrated group by 1, 2""")
def q_vendor_src_counts(spark, sf_dir):
    return (integrated(Fixtures(spark, sf_dir)).groupBy("vendor_src", "mac_flags")
            .agg(F.count(F.lit(1)).alias("count")))


# ---------------------------------------------------------------- profiling (A*)

@query("country_filter_count", O.with_us() + "select count(*) as n_rows from us")
def q_country_filter_count(spark, sf_dir):
    return profile.row_count(us_rows(Fixtures(spark, sf_dir)))


_DIST_COLS = ["class", "type", "addresstype", "vendor", "vendor_src", "mac_flags", "add_state"]

@query("distribution_all", O.with_us() + "\nunion all\n".join(
    f"select '{c}' as \"column\", cast(\"{c}\" as varchar) as value, count(*) as count, "
    f"count(*) / sum(count(*)) over () as proportion from us group by \"{c}\"" for c in _DIST_COLS))
def q_distribution_all(spark, sf_dir):
    return profile.distributions(us_rows(Fixtures(spark, sf_dir)))


@query("yes_share", O.with_us() + """
select t.class, t.total_in_class, cast(coalesce(y.yes_count, 0) as bigint) as yes_count,
  y.yes_count / t.total_in_class as yes_proportion
from (select class, count(*) as total_in_class from us group by class) t
left join (select class, count(*) as yes_count from us where type = 'yes' group by class) y on t.class = y.class""")
def q_yes_share(spark, sf_dir):
    return profile.yes_share(us_rows(Fixtures(spark, sf_dir)))


def _crosstab_oracle(left: str, right: str) -> str:
    return O.with_us() + f"""
select {left}, {right}, count,
  count / (select count(*) from us) as proportion_of_total,
  count / sum(count) over (partition by {left}) as proportion_within_{left},
  count / sum(count) over (partition by {right}) as proportion_within_{right}
from (select {left}, {right}, count(*) as count from us group by 1, 2)
order by count desc, {left} asc nulls first, {right} asc nulls first limit 5000"""


def _crosstab_builder(left: str, right: str) -> Builder:
    def build(spark, sf_dir):
        return profile.crosstab(us_rows(Fixtures(spark, sf_dir)), left, right)
    return build


for _l, _r in profile.CROSS_TABS:
    query(f"crosstab_{_l}_{_r}", _crosstab_oracle(_l, _r))(_crosstab_builder(_l, _r))


@query("frequent_names", O.with_us() + """
select name, count(*) as count from us group by name having count(*) > 5""")
def q_frequent_names(spark, sf_dir):
    return profile.frequent_values(us_rows(Fixtures(spark, sf_dir)), "name", 5)


# ------------------------------------------------------ vendor names

@query("vendor_normalized", O.with_integrated() + """
select ap_id, vendor, trim(regexp_replace(lower(coalesce(vendor, '')), '\\s+', ' ', 'g')) as vendor_key
from integrated""")
def q_vendor_normalized(spark, sf_dir):
    from apsight.functions.text import normalize_vendor
    return integrated(Fixtures(spark, sf_dir)).select(
        "ap_id", "vendor", normalize_vendor(F.col("vendor")).alias("vendor_key"))


@query("alias_lookup", O.with_integrated("alias", extra=[("aliases", O.ALIAS_ORACLE)]) + """
select i.ap_id, i.vendor, coalesce(a.canonical, i.vendor) as vendor_clean
from integrated i left join aliases a
  on a.key = trim(regexp_replace(lower(coalesce(i.vendor, '')), '\\s+', ' ', 'g'))""")
def q_alias_lookup(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return vendor.canonicalize_vendor(integrated(fx).select("ap_id", "vendor"), fx.alias)


# ------------------------------------------------------ value counts

@query("value_counts", O.with_ml() + """
select vendor_clean, count(*) as count from mlf group by 1""")
def q_value_counts(spark, sf_dir):
    return profile.value_counts(ml_rows(Fixtures(spark, sf_dir)), "vendor_clean")


@query("topn_coverage", O.with_ml() + """
select 50 as top_n, count(*) as n_values,
  cast(coalesce(sum(case when rk <= 50 then count end), 0) as bigint) as covered,
  cast(sum(count) as bigint) as total,
  cast(coalesce(sum(case when rk <= 50 then count end), 0) as bigint) / cast(sum(count) as bigint) as coverage
from (select count, row_number() over (order by count desc, vendor_clean) as rk
      from (select vendor_clean, count(*) as count from mlf group by 1))""")
def q_topn_coverage(spark, sf_dir):
    return profile.top_n_coverage(ml_rows(Fixtures(spark, sf_dir)), "vendor_clean", 50)


@query("vendors_for_95pct", O.with_ml() + """
select cast(count(*) filter (where cum_share <= 0.95) + 1 as bigint) as n_values_for_share,
  count(*) as n_values
from (select sum(count) over (order by count desc, vendor_clean rows between unbounded preceding and current row)
             / sum(count) over () as cum_share
      from (select vendor_clean, count(*) as count from mlf group by 1))""")
def q_vendors_for_95pct(spark, sf_dir):
    return profile.values_for_share(ml_rows(Fixtures(spark, sf_dir)), "vendor_clean", 0.95)


# ------------------------------------------------- geocode enrichment

def raw_text(fx: Fixtures) -> DataFrame:
    """Raw sightings as text columns (the TSV layout); every 101st sighting has
    a point without a comma, so it is a bad row."""
    r = fx.raw
    latlong = F.when(F.col("ap_id") % 101 == 0, F.col("lat").cast("string")).otherwise(
        F.concat_ws(",", F.col("lat").cast("string"), F.col("lon").cast("string")))
    return r.select(F.col("epochtime").cast("string").alias("epochtime"), "bssid", latlong.alias("latlong"),
                    F.lit(None).cast("string").alias("c3"), F.lit(None).cast("string").alias("c4"), "altitude")


def tagged(fx: Fixtures) -> DataFrame:
    from apsight.operators import geocode
    return geocode.enrich(raw_text(fx), fx.oui, fx.geocode_responses)


_GEO_CTE = [
    ("rawo", O.vendor_oracle("raw")),
    ("tag", """
select r.*, g.status, g.body,
  case when r.ap_id % 101 = 0 then 'bad_row'
       when g.status is null then 'no_response'
       when g.status <> 200 then 'http_' || cast(g.status as varchar)
       when coalesce(g.body, '') = '' then 'empty_body'
       when not json_valid(g.body) then 'bad_json' end as reason
from rawo r left join geocode_responses g on r.lat = g.lat and r.lon = g.lon"""),
]

_JSON_SELECT = """
  try_cast(json_extract_string(body, '$.place_id') as bigint) as place_id,
  json_extract_string(body, '$.osm_type') as osm_type,
  try_cast(json_extract_string(body, '$.osm_id') as bigint) as osm_id,
  json_extract_string(body, '$.class') as class,
  json_extract_string(body, '$.type') as type,
  try_cast(json_extract_string(body, '$.place_rank') as integer) as place_rank,
  try_cast(json_extract_string(body, '$.importance') as double) as importance,
  json_extract_string(body, '$.addresstype') as addresstype,
  json_extract_string(body, '$.name') as name,
  json_extract_string(body, '$.display_name') as display_name,
  json_extract_string(body, '$.address.road') as add_road,
  json_extract_string(body, '$.address.neighbourhood') as add_neighbourhood,
  json_extract_string(body, '$.address.town') as add_town,
  json_extract_string(body, '$.address.county') as add_county,
  json_extract_string(body, '$.address.state') as add_state,
  json_extract_string(body, '$.address."ISO3166-2-lvl4"') as add_ISO3166v14,
  json_extract_string(body, '$.address.postcode') as add_postcode,
  json_extract_string(body, '$.address.country') as add_country,
  json_extract_string(body, '$.address.country_code') as add_country_code"""


def _geo_oracle(body: str) -> str:
    return O.with_integrated("raw", "geocode_responses", extra=_GEO_CTE) + body


@query("geocode_join", _geo_oracle("""
select epochtime, bssid, lat, lon, altitude, vendor, mac_flags, vendor_src,""" + _JSON_SELECT + """
from tag where reason is null"""))
def q_geocode_join(spark, sf_dir):
    from apsight.operators import geocode
    return geocode.integrated_rows(tagged(Fixtures(spark, sf_dir)))


@query("geocode_dead_letter", _geo_oracle("""
select cast(epochtime as varchar) as epochtime, bssid, altitude,
  case when status <> 200 and reason <> 'bad_row' then status end as error_code, reason
from tag where reason is not null"""))
def q_geocode_dead_letter(spark, sf_dir):
    from apsight.operators import geocode
    dl = geocode.dead_letter_rows(tagged(Fixtures(spark, sf_dir)))
    return dl.select("epochtime", "bssid", "altitude",
                     F.when(F.col("reason") != "bad_row", F.col("error_code")).alias("error_code"), "reason")


@query("geocode_json_fields", O.oracle_with(["geocode_responses"]) + """
select lat, lon, status, (status = 200 and coalesce(body, '') <> '' and not json_valid(body)) as bad_json,""" +
       _JSON_SELECT.replace("body", "(case when json_valid(body) then body end)") + """
from geocode_responses""")
def q_geocode_json_fields(spark, sf_dir):
    from apsight.operators import geocode
    r = geocode.with_parsed(Fixtures(spark, sf_dir).geocode_responses)
    j = F.col("_j")
    return r.select("lat", "lon", "status",
                    ((F.col("status") == 200) & (F.coalesce("body", F.lit("")) != "")
                     & j.getField("_corrupt_record").isNotNull()).alias("bad_json"),
                    *geocode.json_fields(F.when(j.getField("_corrupt_record").isNull(), j)))


@query("failed_counters", _geo_oracle("""
select count(*) as processed,
  count(*) filter (where reason is not null and reason <> 'bad_row') as failed_geo,
  count(*) filter (where reason = 'bad_row') as bad_rows,
  count(*) filter (where vendor = 'NaN') as failed_vendor
from tag"""))
def q_failed_counters(spark, sf_dir):
    from apsight.operators import geocode
    return geocode.run_counters(tagged(Fixtures(spark, sf_dir)))


# --------------------------------------------------- file round trips

def _scratch(spark, name: str) -> str:
    import uuid
    from apsight.session import scratch_path
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


@query("raw_scan_roundtrip", O.oracle_with(["raw"]) + """
select epochtime, bssid,
  case when ap_id % 101 = 0 then null else lat end as lat,
  case when ap_id % 101 = 0 then null else lon end as lon, altitude
from raw""")
def q_raw_scan_roundtrip(spark, sf_dir):
    """Derived sightings written as a '#'-headed TSV, then read with the S1 reader."""
    from apsight.operators import geocode
    from apsight.sources import readers
    path = _scratch(spark, "raw-tsv")
    (raw_text(Fixtures(spark, sf_dir)).write.mode("overwrite").option("sep", "\t")
     .option("header", False).csv(path))
    parsed = geocode.parse_sightings(readers.read_raw_sightings(spark, path))
    return parsed.select(F.col("_epoch").alias("epochtime"), "bssid", "lat", "lon", "altitude")


_STR_COLS = [n for n, t in schemas.INTEGRATED_FIELDS if t.typeName() == "string"]


@query("integrated_tsv_roundtrip", _geo_oracle("""
, good as (select epochtime, bssid, lat, lon, altitude, vendor, mac_flags, vendor_src,""" + _JSON_SELECT + """
from tag where reason is null)
select * replace (""" + ", ".join(f"nullif({c}, '') as {c}" for c in _STR_COLS) + """) from good""")
    .replace("\n, good as", ", good as"))
def q_integrated_tsv_roundtrip(spark, sf_dir):
    """Integrated rows written with the TSV sink and read back with the S4 reader."""
    from apsight.operators import geocode
    from apsight.sources import readers, sinks
    path = _scratch(spark, "integrated-tsv")
    sinks.write_integrated(geocode.integrated_rows(tagged(Fixtures(spark, sf_dir))), path, fmt="tsv")
    return readers.read_integrated_tsv(spark, path)


# ------------------------------------------------------------ splits (X*, A10-A11, A16, P14, P16, P17)

def _h(key: str, salt: str) -> str:
    """DuckDB twin of ``hash32``."""
    return f"('0x' || substr(md5(cast({key} as varchar) || '-{salt}'), 1, 8))::BIGINT"


@query("drop_unknown", O.with_ml() + """
select row_id, label_target_main from mlf where label_target_main <> 'unknown'""")
def q_drop_unknown(spark, sf_dir):
    from apsight.operators import splits
    return splits.drop_unknown(ml_rows(Fixtures(spark, sf_dir))).select("row_id", "label_target_main")


EXCLUDED = ("row_id", "label_target_main", "label_sensitive_binary", "label_sensitive_subtype", "score")
OSM_SCORES = ("place_rank", "importance")


def feature_columns(df: DataFrame, mode: str = "full") -> list[str]:
    """All columns except the excluded set; ``no_osm_scores`` also drops the OSM scores."""
    drop = set(EXCLUDED) | (set(OSM_SCORES) if mode == "no_osm_scores" else set())
    return [c for c in df.columns if c not in drop]


@query("ablation_select", O.with_ml() + """
select row_id, vendor_clean, add_state from mlf""")
def q_ablation_select(spark, sf_dir):
    df = ml_rows(Fixtures(spark, sf_dir))
    return df.select("row_id", *feature_columns(df, "no_osm_scores"))


@query("sample_fixed", O.with_ml() + f"""
select row_id from (select row_id, row_number() over (order by {_h('row_id', 'sample42')}, row_id) as rn from mlf)
where rn <= 10000""")
def q_sample_fixed(spark, sf_dir):
    from apsight.operators import splits
    return splits.sample_fixed(ml_rows(Fixtures(spark, sf_dir)), 10000, "row_id", 42).select("row_id")


_STRAT_ORACLE = f"""
select row_id, label_sensitive_binary,
  rn <= (2 * n_c + 5) // 10 as is_test
from (select row_id, label_sensitive_binary,
        row_number() over (partition by label_sensitive_binary order by {_h('row_id', 'strat42')}, row_id) as rn,
        count(*) over (partition by label_sensitive_binary) as n_c from mlf)"""


@query("split_stratified", O.with_ml() + _STRAT_ORACLE)
def q_split_stratified(spark, sf_dir):
    from apsight.operators import splits
    df = ml_rows(Fixtures(spark, sf_dir))
    return splits.stratified_holdout(df, "label_sensitive_binary", "row_id").select(
        "row_id", "label_sensitive_binary", "is_test")


@query("split_plain", O.with_ml() + f"""
select row_id, {_h('row_id', 'plain42')} < {int(0.2 * (1 << 32))} as is_test from mlf""")
def q_split_plain(spark, sf_dir):
    from apsight.operators import splits
    return splits.plain_holdout(ml_rows(Fixtures(spark, sf_dir)), "row_id").select("row_id", "is_test")


@query("split_val", O.with_ml(), )
def q_split_val(spark, sf_dir):
    from apsight.operators import splits
    df = ml_rows(Fixtures(spark, sf_dir))
    s = splits.stratified_holdout(df, "label_sensitive_binary", "row_id")
    train = s.where(~F.col("is_test"))
    v = splits.stratified_holdout(train, "label_sensitive_binary", "row_id", test_size=0.1, seed=7, out="is_val")
    return v.select("row_id", "label_sensitive_binary", "is_val")


ORACLES["split_val"] = O.with_ml() + f"""
, tr as (select * from ({_STRAT_ORACLE}) where not is_test)
select row_id, label_sensitive_binary, rn <= (n_c + 5) // 10 as is_val
from (select row_id, label_sensitive_binary,
        row_number() over (partition by label_sensitive_binary order by {_h('row_id', 'strat7')}, row_id) as rn,
        count(*) over (partition by label_sensitive_binary) as n_c from tr)"""


_FOLDS_SQL = f"""
select add_state, cast(case when i < r * (q + 1) then i // (q + 1) else r + (i - r * (q + 1)) // q end as integer) as fold
from (select add_state, row_number() over (order by {_h("coalesce(cast(add_state as varchar), '<null>')", 'groups42')}, add_state) - 1 as i,
        count(*) over () // 5 as q, count(*) over () % 5 as r
      from (select distinct add_state from ml))"""


@query("group_folds_shuffled", O.with_ml() + _FOLDS_SQL)
def q_group_folds_shuffled(spark, sf_dir):
    from apsight.operators import splits
    return splits.shuffled_group_folds(Fixtures(spark, sf_dir).ml, "add_state", k=5)


@query("small_group_filter", O.with_ml() + """
select row_id, add_state from mlf where add_state in
  (select add_state from mlf group by add_state having count(*) >= 500)""")
def q_small_group_filter(spark, sf_dir):
    from apsight.operators import splits
    return splits.small_group_filter(ml_rows(Fixtures(spark, sf_dir)), "add_state", 500).select("row_id", "add_state")


@query("class_weights", O.with_ml() + f"""
, s as ({_STRAT_ORACLE})
select label_sensitive_binary, count(*) as n_c,
  sum(count(*)) over () / (count(*) over () * count(*)) as weight
from s where not is_test group by 1""")
def q_class_weights(spark, sf_dir):
    from apsight.operators import encode, splits
    s = splits.stratified_holdout(ml_rows(Fixtures(spark, sf_dir)), "label_sensitive_binary", "row_id")
    return encode.balanced_class_weights(s.where(~F.col("is_test")), "label_sensitive_binary")


@query("pos_weight", O.with_ml() + f"""
, s as ({_STRAT_ORACLE})
select count(*) filter (where label_sensitive_binary = 1) as n_pos,
  count(*) filter (where label_sensitive_binary = 0) as n_neg,
  count(*) filter (where label_sensitive_binary = 1) / count(*) as pos_share,
  count(*) filter (where label_sensitive_binary = 0) / count(*) filter (where label_sensitive_binary = 1) as neg_pos_ratio
from s where not is_test""")
def q_pos_weight(spark, sf_dir):
    from apsight.operators import encode, splits
    s = splits.stratified_holdout(ml_rows(Fixtures(spark, sf_dir)), "label_sensitive_binary", "row_id")
    return encode.class_balance(s.where(~F.col("is_test")), "label_sensitive_binary")


@query("label_index", O.with_ml() + """
select row_id, label_target_main,
  cast(dense_rank() over (order by label_target_main) - 1 as double) as label_idx
from mlf where label_target_main <> 'unknown'""")
def q_label_index(spark, sf_dir):
    from apsight.operators import encode, splits
    df = splits.drop_unknown(ml_rows(Fixtures(spark, sf_dir)))
    return encode.index_labels(df, "label_target_main", "label_idx").select("row_id", "label_target_main", "label_idx")


@query("group_folds_stratified")
def q_group_folds_stratified(spark, sf_dir):
    from apsight.operators import splits
    df = splits.clean_group_key(ml_rows(Fixtures(spark, sf_dir)), "add_state")
    return splits.stratified_group_folds(df, "_group", "label_sensitive_binary", k=5)


# ------------------------------------------------------------ encoders

def split_frames(fx: Fixtures, label: str = "label_sensitive_binary"):
    """Stratified 80/20 split of the modelling rows: (train, test)."""
    from apsight.operators import splits
    s = splits.stratified_holdout(ml_rows(fx), label, "row_id")
    return s.where(~F.col("is_test")).drop("is_test"), s.where("is_test").drop("is_test")


_TRAIN_TEST = [("s", f"""select *, rn <= (2 * n_c + 5) // 10 as is_test
from (select *, row_number() over (partition by label_sensitive_binary order by {_h('row_id', 'strat42')}, row_id) as rn,
        count(*) over (partition by label_sensitive_binary) as n_c from mlf)"""),
               ("train", "select * exclude (is_test, rn, n_c) from s where not is_test"),
               ("test", "select * exclude (is_test, rn, n_c) from s where is_test")]


def _te_sql(n: str, s: str, n_all: str, s_all: str) -> str:
    mean_c, mean = f"({s} / {n})", f"({s_all} / {n_all})"
    var_c, tau2 = f"({mean_c} * (1 - {mean_c}))", f"({mean} * (1 - {mean}))"
    lam = f"(({n} * {tau2}) / ({var_c} + {n} * {tau2}))"
    return (f"case when {n} is null or {n} = 0 then {mean} when {var_c} + {n} * {tau2} = 0 then {mean_c} "
            f"else {lam} * {mean_c} + (1 - {lam}) * {mean} end")


# One-hot cap of 50 columns (incl. the infrequent one), top-N 50
# for coverage, 95 % share, 5000 cross-tab rows, names seen more than 5 times.
OHE_MAX = 50

_VOCAB_SQL = f"""select vendor_clean as value, count,
  (count(*) over () < {OHE_MAX} or row_number() over (order by count desc, vendor_clean desc) <= {OHE_MAX - 1}) as kept
from (select vendor_clean, count(*) as count from train group by 1)"""


@query("ohe_vocab", O.with_ml() + "".join(f", {n} as ({q})\n" for n, q in _TRAIN_TEST) + _VOCAB_SQL)
def q_ohe_vocab(spark, sf_dir):
    from apsight.operators import encode
    train, _ = split_frames(Fixtures(spark, sf_dir))
    return encode.ohe_vocabulary(train, "vendor_clean", OHE_MAX)


@query("ohe_bucketed_counts", O.with_ml() + "".join(f", {n} as ({q})\n" for n, q in _TRAIN_TEST) + f"""
, vocab as ({_VOCAB_SQL})
select case when v.value is not null then t.vendor_clean
            when (select count(*) from vocab where not kept) > 0 then '__infrequent__' end as bucket,
  count(*) as count
from test t left join (select value from vocab where kept) v on t.vendor_clean = v.value group by 1""")
def q_ohe_bucketed_counts(spark, sf_dir):
    from apsight.operators import encode
    train, test = split_frames(Fixtures(spark, sf_dir))
    vocab = encode.ohe_vocabulary(train, "vendor_clean", OHE_MAX)
    return (encode.ohe_bucket(test, "vendor_clean", vocab).groupBy("bucket")
            .agg(F.count(F.lit(1)).alias("count")))


@query("target_encode_binary", O.with_ml() + "".join(f", {n} as ({q})\n" for n, q in _TRAIN_TEST) + f"""
, per as (select vendor_clean as v, count(*) as n, sum(label_sensitive_binary) as s from train group by 1)
, tot as (select count(*) as n_all, sum(label_sensitive_binary) as s_all from train)
select t.row_id, coalesce({_te_sql('per.n', 'per.s', 'tot.n_all', 'tot.s_all')}, tot.s_all / tot.n_all) as te_vendor
from test t cross join tot left join per on per.v = t.vendor_clean""")
def q_target_encode_binary(spark, sf_dir):
    from apsight.operators import encode
    train, test = split_frames(Fixtures(spark, sf_dir))
    return encode.target_encode_apply(test, train, "vendor_clean", "label_sensitive_binary",
                                      "te_vendor").select("row_id", "te_vendor")


@query("target_encode_crossfit", O.with_ml() + "".join(f", {n} as ({q})\n" for n, q in _TRAIN_TEST) + f"""
, tr as (select *, cast(({_h('row_id', 'cf42')}) % 5 as integer) as cf_fold from train)
, pf as (select vendor_clean as v, cf_fold as f, count(*) as n_vf, sum(label_sensitive_binary) as s_vf from tr group by 1, 2)
, oof as (select v, f, sum(n_vf) over (partition by v) - n_vf as n, sum(s_vf) over (partition by v) - s_vf as s from pf)
, ft as (select f, sum(sum(n_vf)) over () - sum(n_vf) as n_all, sum(sum(s_vf)) over () - sum(s_vf) as s_all from pf group by f)
select tr.row_id, tr.cf_fold, {_te_sql('oof.n', 'oof.s', 'ft.n_all', 'ft.s_all')} as te_vendor
from tr join oof on oof.v = tr.vendor_clean and oof.f = tr.cf_fold join ft on ft.f = tr.cf_fold""")
def q_target_encode_crossfit(spark, sf_dir):
    from apsight.operators import encode
    train, _ = split_frames(Fixtures(spark, sf_dir))
    tr = encode.cross_fit_fold(train, "row_id", 5, 42)
    return encode.target_encode_crossfit(tr, "vendor_clean", "label_sensitive_binary", "te_vendor").select(
        "row_id", "cf_fold", "te_vendor")


_CLASSES = ["high", "low", "medium", "urgent"]


@query("target_encode_multiclass", O.with_ml() + "".join(
        f", {n} as ({q.replace('from s where', 'from s where label_target_main <> ' + repr('unknown') + ' and')})\n"
        for n, q in _TRAIN_TEST) + ", tot as (select count(*) as n_all, " + ", ".join(
        f"sum(case when label_target_main = '{c}' then 1 else 0 end) as s_{c}" for c in _CLASSES) + " from train)\n"
        + ", per as (select vendor_clean as v, count(*) as n, " + ", ".join(
        f"sum(case when label_target_main = '{c}' then 1 else 0 end) as s_{c}" for c in _CLASSES)
        + " from train group by 1)\nselect t.row_id, " + ", ".join(
        f"coalesce({_te_sql('per.n', f'per.s_{c}', 'tot.n_all', f'tot.s_{c}')}, tot.s_{c} / tot.n_all) as te_vendor_{c}"
        for c in _CLASSES) + "\nfrom test t cross join tot left join per on per.v = t.vendor_clean")
def q_target_encode_multiclass(spark, sf_dir):
    from apsight.operators import encode, splits
    train, test = split_frames(Fixtures(spark, sf_dir))
    train, test = splits.drop_unknown(train), splits.drop_unknown(test)
    classes = sorted(r[0] for r in train.select("label_target_main").distinct().collect())
    out = encode.target_encode_multiclass(test, train, "vendor_clean", "label_target_main", classes, "te_vendor")
    return out.select("row_id", *[f"te_vendor_{c}" for c in classes])


@query("scale_std", O.with_ml() + "".join(f", {n} as ({q})\n" for n, q in _TRAIN_TEST) + """
select row_id, round(place_rank / (select stddev_pop(place_rank) from train), 9) as place_rank_scaled,
  round(importance / (select stddev_pop(importance) from train), 9) as importance_scaled
from test""")
def q_scale_std(spark, sf_dir):
    from apsight.operators import encode
    train, test = split_frames(Fixtures(spark, sf_dir))
    out = encode.scale_by_std(test, train, ["place_rank", "importance"])
    return out.select("row_id", F.round("place_rank_scaled", 9).alias("place_rank_scaled"),
                      F.round("importance_scaled", 9).alias("importance_scaled"))


# --------------------------------------------------- evaluation (M*, T*, A12-A15, J5, J8, S12)

MODELS = ("uniform", "blend", "rank")


def scored_long(fx: Fixtures) -> DataFrame:
    """(model, row_id, add_state, y, score): one row per model and modelling row."""
    stack = "stack(3, " + ", ".join(f"'{m}', s_{m}" for m in MODELS) + ") as (model, score)"
    return fx.scored.selectExpr("row_id", "add_state", "y", stack)


def multiclass(fx: Fixtures) -> DataFrame:
    return fx.scored.where(F.col("label_target_main") != "unknown")


_LONG = ("scored_long", " union all ".join(
    f"select '{m}' as model, row_id, add_state, y, s_{m} as score from scored" for m in MODELS))
_MC = ("mc", "select * from scored where label_target_main <> 'unknown'")


def _with_eval(*extra) -> str:
    return O.oracle_with(["scored"], extra=[_LONG, _MC, *extra])


def _grid_values(spec, digits=None) -> str:
    from apsight.operators.thresholds import arange
    return "select * from (values " + ", ".join(
        f"({i}, cast('{t!r}' as double), cast('{(round(t, digits) if digits is not None else t)!r}' as double))"
        for i, t in enumerate(arange(*spec))) + ") as g(t_idx, threshold_raw, threshold)"


_CONF_ORACLE = ("conf", """
select a.l as label_target_main, p.l as pred_target, coalesce(c.n, 0) as n
from (select label_target_main as l from mc union select pred_target from mc) a
cross join (select label_target_main as l from mc union select pred_target from mc) p
left join (select label_target_main, pred_target, count(*) as n from mc group by 1, 2) c
  on c.label_target_main = a.l and c.pred_target = p.l""")

_CLASS_STATS = ("cs", """
select cls, tp, n_pred - tp as fp, support - tp as fn, support, n_pred,
  coalesce(tp / nullif(n_pred, 0), 0.0) as precision, coalesce(tp / nullif(support, 0), 0.0) as recall,
  coalesce(2 * tp / nullif(2 * tp + (n_pred - tp) + (support - tp), 0), 0.0) as f1
from (select l as cls,
        (select coalesce(sum(n), 0) from conf where label_target_main = l) as support,
        (select coalesce(sum(n), 0) from conf where pred_target = l) as n_pred,
        (select coalesce(sum(n), 0) from conf where label_target_main = l and pred_target = l) as tp
      from (select label_target_main as l from conf union select pred_target from conf))
where support + n_pred > 0""")


@query("confusion_matrix", _with_eval(_CONF_ORACLE) + "select * from conf")
def q_confusion_matrix(spark, sf_dir):
    from apsight.operators import metrics
    return metrics.confusion(multiclass(Fixtures(spark, sf_dir)), "label_target_main", "pred_target")


@query("accuracy_f1", _with_eval(_CONF_ORACLE, _CLASS_STATS) + """
select cast(sum(support) as bigint) as n, round(sum(tp) / sum(support), 9) as accuracy,
  round(avg(f1), 9) as macro_f1, round(sum(f1 * support) / sum(support), 9) as weighted_f1 from cs""")
def q_accuracy_f1(spark, sf_dir):
    from apsight.operators import metrics
    conf = metrics.confusion(multiclass(Fixtures(spark, sf_dir)), "label_target_main", "pred_target")
    s = metrics.summary(conf, "label_target_main", "pred_target")
    return s.select("n", *[F.round(c, 9).alias(c) for c in ("accuracy", "macro_f1", "weighted_f1")])


@query("classification_report", _with_eval(_CONF_ORACLE, _CLASS_STATS) + """
select cls as class, round(precision, 9) as precision, round(recall, 9) as recall, round(f1, 9) as f1,
  cast(support as double) as support from cs
union all select 'accuracy', round(sum(tp) / sum(support), 9), round(sum(tp) / sum(support), 9),
  round(sum(tp) / sum(support), 9), round(sum(tp) / sum(support), 9) from cs
union all select 'macro avg', round(avg(precision), 9), round(avg(recall), 9), round(avg(f1), 9),
  cast(sum(support) as double) from cs
union all select 'weighted avg', round(sum(precision * support) / sum(support), 9),
  round(sum(recall * support) / sum(support), 9), round(sum(f1 * support) / sum(support), 9),
  cast(sum(support) as double) from cs""")
def q_classification_report(spark, sf_dir):
    from apsight.operators import metrics
    conf = metrics.confusion(multiclass(Fixtures(spark, sf_dir)), "label_target_main", "pred_target")
    r = metrics.report(conf, "label_target_main", "pred_target")
    return r.select("class", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "support")])


_RANK_ORACLE = ("rk", """
select model, sum(pos) as P, sum(neg) as N,
  sum(cast(pos as double) * cum_pos / cum_cnt) as ap_sum,
  sum(cast(neg as hugeint) * cast(2 * (cum_pos - pos) + pos as hugeint)) as auc_sum
from (select model, score, pos, neg,
        sum(pos) over (partition by model order by score desc rows between unbounded preceding and current row) as cum_pos,
        sum(pos + neg) over (partition by model order by score desc rows between unbounded preceding and current row) as cum_cnt
      from (select model, score, sum(y) as pos, sum(1 - y) as neg from scored_long group by 1, 2))
group by model""")

_RANK_SELECT = """case when P > 0 and N > 0 then round(ap_sum / P, 9) end as pr_auc,
  case when P > 0 and N > 0 then cast(auc_sum as double) / (2.0 * cast(P as double) * cast(N as double)) end as roc_auc"""


@query("average_precision", _with_eval(_RANK_ORACLE) + "select model, " + _RANK_SELECT.split(",\n")[0] + " from rk")
def q_average_precision(spark, sf_dir):
    from apsight.operators import metrics
    return metrics.rank_metrics(scored_long(Fixtures(spark, sf_dir)), "y", "score", ["model"]).select("model", "pr_auc")


@query("roc_auc", _with_eval(_RANK_ORACLE) + "select model, " + _RANK_SELECT.split(",\n")[1].strip() + " from rk")
def q_roc_auc(spark, sf_dir):
    from apsight.operators import metrics
    return metrics.rank_metrics(scored_long(Fixtures(spark, sf_dir)), "y", "score", ["model"]).select("model", "roc_auc")


def _rates_sql(grid_sql: str) -> tuple[str, str]:
    return ("rates", f"""
select model, t_idx, threshold, tp, fp, fn, tn,
  coalesce(tp / nullif(tp + fp, 0), 0.0) as precision,
  coalesce(tp / nullif(tp + fn, 0), 0.0) as recall,
  coalesce(((case when tp + fn + fp > 0 then coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0) else 0.0 end)
          + (case when tn + fp + fn > 0 then coalesce(2 * tn / nullif(2 * tn + fn + fp, 0), 0.0) else 0.0 end))
         / nullif((case when tp + fn + fp > 0 then 1 else 0 end) + (case when tn + fp + fn > 0 then 1 else 0 end), 0), 0.0) as macro_f1,
  coalesce(fn / nullif(fn + tp, 0), 0.0) as fnr,
  coalesce(fp / nullif(fp + tn, 0), 0.0) as fpr
from (select s.model, g.t_idx, g.threshold,
        count(*) filter (where s.score >= g.threshold_raw and s.y = 1) as tp,
        count(*) filter (where s.score >= g.threshold_raw and s.y = 0) as fp,
        count(*) filter (where s.score < g.threshold_raw and s.y = 1) as fn,
        count(*) filter (where s.score < g.threshold_raw and s.y = 0) as tn
      from scored_long s cross join ({grid_sql}) g group by 1, 2, 3)""")


def _tuning_oracle(body: str) -> str:
    from apsight.operators.thresholds import TUNING_GRID
    return _with_eval(_rates_sql(_grid_values(TUNING_GRID))) + body


@query("threshold_best_f1", _tuning_oracle("""
select model, threshold as best_threshold, macro_f1 as best_macro_f1
from (select *, row_number() over (partition by model order by macro_f1 desc, t_idx) as rn from rates) where rn = 1"""))
def q_threshold_best_f1(spark, sf_dir):
    from apsight.operators import thresholds
    return thresholds.best_macro_f1(scored_long(Fixtures(spark, sf_dir)), "y", "score", ["model"])


@query("threshold_precision_floor", _tuning_oracle("""
, fl as (select * from (select *, row_number() over (partition by model order by recall desc, t_idx) as rn
                        from rates where tp + fp > 0 and precision >= 0.70) where rn = 1)
, bf as (select * from (select *, row_number() over (partition by model order by macro_f1 desc, t_idx) as rn from rates) where rn = 1)
select bf.model, coalesce(fl.threshold, bf.threshold) as best_threshold, coalesce(fl.macro_f1, bf.macro_f1) as best_macro_f1,
  case when fl.threshold is not null then 'precision_floor' else 'macro_f1' end as rule
from bf left join fl on bf.model = fl.model""".replace("\n, fl as", ", fl as")))
def q_threshold_precision_floor(spark, sf_dir):
    from apsight.operators import thresholds
    return thresholds.best_under_precision_floor(scored_long(Fixtures(spark, sf_dir)), "y", "score", 0.70, ["model"])


def evaluate_scored(df: DataFrame, threshold: float, by: list[str]) -> DataFrame:
    """T4: confusion-derived metrics at ``score >= threshold`` plus AP/AUC, per group."""
    from apsight.operators import metrics
    from apsight.operators.joins import null_safe_join
    # one aggregate of the scored rows, checkpointed, feeds both the confusion and AP/AUC
    g = metrics.ranked_groups(df, "y", "score", by)
    conf = metrics.binary_confusion_from_groups(g, threshold, by)
    s = metrics.summary(conf, "y", "pred", by)
    r = metrics.rank_metrics(df, "y", "score", by, groups=g)
    return null_safe_join(s, r, by).select(*by, F.col("n").alias("n_test"), *[F.round(c, 9).alias(c) for c in (
        "accuracy", "macro_f1", "weighted_f1")], "pr_auc", "roc_auc")


def _eval_oracle_ctes(by: str, src: str, t: float, p: str = "ev") -> list[tuple[str, str]]:
    """Binary evaluation per ``by`` group in SQL (labels fixed to 0 and 1)."""
    return [
        (f"{p}_c", f"""select {by}, count(*) filter (where score >= {t!r} and y = 1) as tp1,
            count(*) filter (where score >= {t!r} and y = 0) as fp1,
            count(*) filter (where score < {t!r} and y = 1) as fn1,
            count(*) filter (where score < {t!r} and y = 0) as tn1 from {src} group by {by}"""),
        (f"{p}_cls", f"""select {by}, tp1 as tp, fp1 as fp, fn1 as fn, tp1 + fn1 as support, tp1 + fp1 as n_pred from {p}_c
            union all select {by}, tn1, fn1, fp1, tn1 + fp1, tn1 + fn1 from {p}_c"""),
        (f"{p}_s", f"""select {by}, cast(sum(support) as bigint) as n_test, round(sum(tp) / sum(support), 9) as accuracy,
            round(avg(f1), 9) as macro_f1, round(sum(f1 * support) / sum(support), 9) as weighted_f1
            from (select *, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0) as f1 from {p}_cls where support + n_pred > 0)
            group by {by}"""),
        (f"{p}_r", f"""select {by}, sum(pos) as P, sum(neg) as N,
            sum(cast(pos as double) * cum_pos / cum_cnt) as ap_sum,
            sum(cast(neg as hugeint) * cast(2 * (cum_pos - pos) + pos as hugeint)) as auc_sum
            from (select {by}, score, pos, neg,
                  sum(pos) over (partition by {by} order by score desc rows between unbounded preceding and current row) as cum_pos,
                  sum(pos + neg) over (partition by {by} order by score desc rows between unbounded preceding and current row) as cum_cnt
                  from (select {by}, score, sum(y) as pos, sum(1 - y) as neg from {src} group by {by}, score))
            group by {by}"""),
        (p, f"""select {p}_s.*, {_RANK_SELECT} from {p}_s join {p}_r using ({by})"""),
    ]


@query("evaluate_at_threshold", _with_eval(*_eval_oracle_ctes("model", "scored_long", 0.5)) + "select * from ev")
def q_evaluate_at_threshold(spark, sf_dir):
    return evaluate_scored(scored_long(Fixtures(spark, sf_dir)), 0.5, ["model"])


def _curve_oracle(body: str) -> str:
    from apsight.operators.thresholds import CURVE_GRID
    return _with_eval(_rates_sql(_grid_values(CURVE_GRID, 3)), ("curve", """
select model, threshold, precision, recall, macro_f1 as f1_macro, fnr, fpr from rates
where tp + fp > 0 and tp + fp < tp + fp + fn + tn""")) + body


@query("operating_curve", _curve_oracle("select * from curve"))
def q_operating_curve(spark, sf_dir):
    from apsight.operators import thresholds
    return thresholds.operating_curve(scored_long(Fixtures(spark, sf_dir)), "y", "score", ["model"])


@query("plateau_width", _curve_oracle("""
select model, max(peak) as peak_f1, max(threshold) - min(threshold) as plateau_width, count(*) as n_points
from (select *, max(f1_macro) over (partition by model) as peak from curve) where f1_macro >= peak - 0.001
group by model"""))
def q_plateau_width(spark, sf_dir):
    from apsight.operators import thresholds
    curve = thresholds.operating_curve(scored_long(Fixtures(spark, sf_dir)), "y", "score", ["model"])
    return thresholds.plateau_width(curve, ["model"])


@query("score_bands", _with_eval() + """
select model, count(*) filter (where score < 0.05) / count(*) as share_low,
  count(*) filter (where score >= 0.05 and score <= 0.95) / count(*) as share_mid,
  count(*) filter (where score > 0.95) / count(*) as share_high
from scored_long group by model""")
def q_score_bands(spark, sf_dir):
    from apsight.operators import metrics
    return metrics.score_bands(scored_long(Fixtures(spark, sf_dir)), "score", ["model"])


@query("score_histogram", _with_eval() + """
select model, label, bin, count, count / (sum(count) over (partition by model, label) * case when w > 0 then w else 1.0 end) as density
from (select model, label, bin, w, count(*) as count from (
        select s.model, s.y as label, (r.hi - r.lo) / 100.0 as w,
          cast(case when r.hi = r.lo then 1 else 1 + (case
            when s.score < cast(i0 as double) * ((r.hi - r.lo) / 100.0) + r.lo then i0 - 1
            when s.score >= cast(i0 + 1 as double) * ((r.hi - r.lo) / 100.0) + r.lo and i0 <> 99 then i0 + 1
            else i0 end) end as integer) as bin
        from (select s.*, least(greatest(floor((s.score - r.lo) * (100.0 / (r.hi - r.lo))), 0), 99) as i0
              from scored_long s join (select model, y, min(score) as lo, max(score) as hi from scored_long group by 1, 2) r
                using (model, y)) s
        join (select model, y, min(score) as lo, max(score) as hi from scored_long group by 1, 2) r using (model, y))
      group by 1, 2, 3, 4)""")
def q_score_histogram(spark, sf_dir):
    from apsight.operators import metrics
    return metrics.score_histogram(scored_long(Fixtures(spark, sf_dir)), "y", "score", ["model"])


@query("model_agreement", _with_eval() + " union all ".join(
    f"select '{a}' as model_a, '{b}' as model_b, avg(case when (s_{a} >= 0.5) = (s_{b} >= 0.5) then 1 else 0 end) as agreement from scored"
    for i, a in enumerate(MODELS) for b in MODELS[i + 1:]))
def q_model_agreement(spark, sf_dir):
    from apsight.operators import metrics
    sc = Fixtures(spark, sf_dir).scored
    preds = sc.select(*[metrics.predict_at(F.col(f"s_{m}"), 0.5).alias(m) for m in MODELS])
    return metrics.pairwise_agreement(preds, list(MODELS))


# ------------------------------------------------ run tables

RUNS = (("run_20260101T000000Z", 0.5), ("run_20260102T000000Z", 0.45))


def fold_scored(fx: Fixtures) -> DataFrame:
    """Scored rows with the shuffled state fold of their state (X9 + J6)."""
    from apsight.operators import splits
    folds = splits.shuffled_group_folds(fx.ml, "add_state", k=5)
    return splits.assign_folds(scored_long(fx), folds, "add_state")


def fold_metrics(fx: Fixtures, threshold: float) -> DataFrame:
    """Per (model, fold): the test-fold metrics at ``threshold``."""
    return evaluate_scored(fold_scored(fx), threshold, ["model", "fold"])


_FOLD_ORACLE = ("fs", """select s.*, f.fold from scored_long s join (""" + _FOLDS_SQL + """) f
  on s.add_state is not distinct from f.add_state""")


def _runs_oracle(*extra) -> str:
    ctes = [_FOLD_ORACLE]
    for i, (_, t) in enumerate(RUNS):
        ctes += _eval_oracle_ctes("model, fold", "fs", t, f"run{i}")
    ctes.append(("runs", " union all ".join(f"select '{r}' as run_id, * from run{i}" for i, (r, _) in enumerate(RUNS))))
    return O.oracle_with(["scored", "ml"], extra=[_LONG, *ctes, *extra])


_MEAN_SQL = f"""select model, {", ".join(f"round(avg({c}), 4) as {c}" for c in ("accuracy", "macro_f1", "weighted_f1", "pr_auc", "roc_auc"))}
from runs where run_id = '{RUNS[0][0]}' group by model"""
_BEST_SQL = f"""select model, fold, pr_auc, macro_f1 from (
  select *, row_number() over (partition by model order by pr_auc desc nulls last, fold) as rn
  from runs where run_id = '{RUNS[0][0]}') where rn = 1"""


@query("mean_metrics", _runs_oracle() + _MEAN_SQL)
def q_mean_metrics(spark, sf_dir):
    from apsight.operators import summaries
    return summaries.mean_metrics(fold_metrics(Fixtures(spark, sf_dir), RUNS[0][1]), ["model"])


@query("best_per_model", _runs_oracle() + _BEST_SQL)
def q_best_per_model(spark, sf_dir):
    from apsight.operators import summaries
    return summaries.best_per_group(fold_metrics(Fixtures(spark, sf_dir), RUNS[0][1]), ["model"],
                                    "pr_auc", ["fold"]).select("model", "fold", "pr_auc", "macro_f1")


def _fold_rates_oracle() -> tuple[str, str]:
    from apsight.operators.thresholds import TUNING_GRID
    name, sql = _rates_sql(_grid_values(TUNING_GRID))
    sql = (sql.replace("select model, t_idx, threshold,", "select model, fold, t_idx, threshold,")
              .replace("from (select s.model, g.t_idx, g.threshold,", "from (select s.model, s.fold, g.t_idx, g.threshold,")
              .replace("from scored_long s cross join", "from fs s cross join")
              .replace("group by 1, 2, 3)", "group by 1, 2, 3, 4)"))
    return ("frates", sql)


_THREE_WAY_ORACLE = _runs_oracle(
    ("base", """select model, round(avg(pr_auc), 4) as pr_auc, round(avg(roc_auc), 4) as roc_auc,
  round(avg(macro_f1), 4) as macro_f1, round(avg(weighted_f1), 4) as weighted_f1
from runs where run_id = '""" + RUNS[0][0] + """' group by model"""),
    ("best", """select model, fold, round(pr_auc, 4) as pr_auc, round(roc_auc, 4) as roc_auc,
  round(macro_f1, 4) as macro_f1, round(weighted_f1, 4) as weighted_f1 from (
  select *, row_number() over (partition by model order by pr_auc desc nulls last, fold) as rn
  from runs where run_id = '""" + RUNS[0][0] + """') where rn = 1"""),
    _fold_rates_oracle(),
    ("fbest", """select model, fold, threshold as best_threshold from (
  select *, row_number() over (partition by model, fold order by macro_f1 desc, t_idx) as rn from frates) where rn = 1"""),
    ("tc", """select s.model, s.fold,
  count(*) filter (where s.score >= b.best_threshold and s.y = 1) as tp1,
  count(*) filter (where s.score >= b.best_threshold and s.y = 0) as fp1,
  count(*) filter (where s.score < b.best_threshold and s.y = 1) as fn1,
  count(*) filter (where s.score < b.best_threshold and s.y = 0) as tn1
from fs s join fbest b using (model, fold) group by 1, 2"""),
    ("tcls", """select model, fold, tp1 as tp, fp1 as fp, fn1 as fn, tp1 + fn1 as support, tp1 + fp1 as n_pred from tc
  union all select model, fold, tn1, fn1, fp1, tn1 + fp1, tn1 + fn1 from tc"""),
    ("ts", """select model, fold, round(avg(f1), 9) as macro_f1, round(sum(f1 * support) / sum(support), 9) as weighted_f1
from (select *, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0) as f1 from tcls where support + n_pred > 0)
group by 1, 2"""),
    ("thr", """select ts.model, round(avg(r.pr_auc), 4) as pr_auc, round(avg(r.roc_auc), 4) as roc_auc,
  round(avg(ts.macro_f1), 4) as macro_f1, round(avg(ts.weighted_f1), 4) as weighted_f1,
  round(avg(b.best_threshold), 4) as best_threshold
from ts join fbest b using (model, fold) join (select model, fold, pr_auc, roc_auc from run0) r using (model, fold)
group by ts.model"""),
)


@query("three_way_summary", _THREE_WAY_ORACLE + """
select coalesce(thr.model, best.model, base.model) as model,
  thr.pr_auc as thresh_pr_auc, thr.roc_auc as thresh_roc_auc, thr.macro_f1 as thresh_macro_f1,
  thr.weighted_f1 as thresh_weighted_f1, thr.best_threshold as thresh_best_threshold,
  best.fold as cw_fold, best.pr_auc as cw_pr_auc, best.roc_auc as cw_roc_auc, best.macro_f1 as cw_macro_f1,
  best.weighted_f1 as cw_weighted_f1,
  base.pr_auc as baseline_pr_auc, base.roc_auc as baseline_roc_auc, base.macro_f1 as baseline_macro_f1,
  base.weighted_f1 as baseline_weighted_f1
from thr full outer join best on thr.model = best.model
  full outer join base on coalesce(thr.model, best.model) = base.model""")
def q_three_way_summary(spark, sf_dir):
    """Threshold-tuned summary (each fold at its own best-macro-F1
    threshold, means per model), the best fold per model by PR-AUC, and the
    untuned baseline means, merged on model with prefixes."""
    from apsight.operators import summaries, thresholds
    fx = Fixtures(spark, sf_dir)
    fs = fold_scored(fx)
    by = ["model", "fold"]
    best_t = thresholds.best_macro_f1(fs, "y", "score", by)
    tuned = evaluate_scored(fs, best_t.select(*by, F.col("best_threshold").alias("threshold")), by)
    tuned = tuned.join(best_t.select(*by, "best_threshold"), by)
    cols4 = ("pr_auc", "roc_auc", "macro_f1", "weighted_f1")
    thr = summaries.mean_metrics(tuned, ["model"], cols4 + ("best_threshold",))
    fm = fold_metrics(fx, RUNS[0][1])
    best = summaries.best_per_group(fm, ["model"], "pr_auc", ["fold"]).select(
        "model", "fold", *[F.round(c, 4).alias(c) for c in cols4])
    base = summaries.mean_metrics(fm, ["model"], cols4)
    return summaries.merge_summaries("model", [("thresh_", thr), ("cw_", best), ("baseline_", base)])


@query("latest_run", _runs_oracle() + f"""
select * from runs where run_id = (select max(run_id) from runs)""")
def q_latest_run(spark, sf_dir):
    """Both runs appended to a run-partitioned metrics table (S11), then the
    newest run selected (S12)."""
    from apsight.sources import sinks
    fx = Fixtures(spark, sf_dir)
    path = _scratch(spark, "metrics")
    for run_id, t in RUNS:
        sinks.append_run(fold_metrics(fx, t), path, run_id)
    table = spark.read.parquet(path)
    cols = ["run_id", "model", "fold", "n_test", "accuracy", "macro_f1", "weighted_f1", "pr_auc", "roc_auc"]
    return sinks.latest_run(table).select(*cols)


# ------------------------------------------- learned models and experiments (R: rows only)

def _model_query(name: str, target: str = "label_sensitive_binary", **params) -> Builder:
    def build(spark, sf_dir):
        from apsight.plans import experiment as X
        cfg = X.ExperimentConfig(target=target, models=(name,), split_modes=("random",),
                                 model_params={name: params} if params else {})
        return X.run_experiment(Fixtures(spark, sf_dir).ml, cfg, run_id=f"model_{name}")
    return build


QUERIES["model_logreg"] = _model_query("logreg")
QUERIES["model_dtree"] = _model_query("dtree")
QUERIES["model_rf"] = _model_query("rf")
QUERIES["model_gbt"] = _model_query("hist_gbm")
QUERIES["model_linear_svc_calibrated"] = _model_query("lsvc")
QUERIES["model_isotonic"] = _model_query("sgd_cal")


def encoded_split(spark, sf_dir):
    """(training, test) rows of the binary target's random split, encoded, and the experiment's settings."""
    from apsight.plans import experiment as X, folds
    from apsight.session import written
    cfg = X.ExperimentConfig(split_modes=("random",))
    d, classes = X.prepare(Fixtures(spark, sf_dir).ml, cfg)
    enc = folds.encode_runs(written(folds.runs(written(d, "prepared"), cfg), "runs"), cfg, classes, ("full",))
    rows = lambda role: enc.where(F.col("role") == role).drop("run", "variant", "role")
    return rows("train"), rows("test"), cfg


@query("sgd_rounds")
def q_sgd_rounds(spark, sf_dir):
    """L2: the loss of every round on the rows learned from and held back, and the round whose coefficients stay."""
    from apsight.plans.models import fit_model
    train, _, cfg = encoded_split(spark, sf_dir)
    rounds = fit_model("sgd", train, 2, cfg.seed, key=cfg.key).models[0].history()
    least = min((b, i) for i, _, b in rounds)[1] if rounds else None
    return spark.createDataFrame([(i, a, b, i == least) for i, a, b in rounds], "round int, train_loss double, held_loss double, kept boolean")


@query("saved_model_scores", O.with_ml() + f"""
select row_id, cast(label_sensitive_binary as integer) as y, true as same
from ({_STRAT_ORACLE}) where is_test and label_sensitive_binary is not null""")
def q_saved_model_scores(spark, sf_dir):
    """A calibrated model saved with its calibrators and loaded again scores every test row the same."""
    from apsight.plans.models import Fitted, fit_model
    train, test, cfg = encoded_split(spark, sf_dir)
    fitted = fit_model("sgd_cal", train, 2, cfg.seed, key=cfg.key)
    path = _scratch(spark, "model")
    fitted.save(path)
    both = Fitted.load(path).score(fitted.score(test).select(*test.columns, F.col("score").alias("before")))
    return both.select(cfg.key, F.col("label").cast("int").alias("y"), F.col("score").eqNullSafe(F.col("before")).alias("same"))


@query("weight_sweep")
def q_weight_sweep(spark, sf_dir):
    """Three models x four class-weight options, 12 rows; boosting runs all its 300 rounds."""
    from apsight.plans import experiment as X
    return X.weight_sweep(Fixtures(spark, sf_dir).ml, X.SWEEP_MODELS, X.ExperimentConfig())


@query("experiment_metrics")
def q_experiment_metrics(spark, sf_dir):
    """E1 on both targets: random split and state folds, feature mode 'both'."""
    from apsight.plans import experiment as X
    ml = Fixtures(spark, sf_dir).ml
    out = None
    for target in ("label_sensitive_binary", "label_target_main"):
        cfg = X.ExperimentConfig(target=target, models=("sgd",), split_modes=("random", "state"))
        m = X.run_experiment(ml, cfg, run_id="experiment")
        out = m if out is None else out.unionByName(m)
    return out


# ------------------------------------------------------ incremental enrichment (streaming)

@query("stream_enrichment", ORACLES["geocode_join"])
def q_stream_enrichment(spark, sf_dir):
    """Derived sightings written as TSV files, enriched by the streaming runner
    (availableNow trigger), integrated rows read back: must equal the batch result."""
    from apsight.streaming.enrich_stream import start_enrichment_stream
    fx = Fixtures(spark, sf_dir)
    raw_dir, out_dir, ckpt = _scratch(spark, "stream-raw"), _scratch(spark, "stream-out"), _scratch(spark, "stream-ckpt")
    raw_text(fx).write.mode("overwrite").option("sep", "\t").csv(raw_dir)
    q = start_enrichment_stream(spark, raw_dir, fx.oui, fx.geocode_responses, out_dir, ckpt)
    q.awaitTermination()
    return spark.read.parquet(f"{out_dir}/integrated").drop("batch_id")


# ------------------------------------------------- more sources and encoders

# Registry text derived from the suppliers: every 7th supplier is listed again
# later with another vendor (the later line wins), every 11th supplier also
# gets a line without a tab (skipped).
_REG_LINES = """
select line_no, line from (
  select s_suppkey * 3 as line_no, prefix || chr(9) || vendor as line from oui
  union all
  select 1000000000 + s_suppkey * 3 + 1, lower(prefix) || chr(9) || 'Relabelled ' || vendor from oui where s_suppkey % 7 = 0
  union all
  select s_suppkey * 3 + 2, 'junk line ' || cast(s_suppkey as varchar(20)) from oui where s_suppkey % 11 = 0)"""


@query("oui_registry_scan", O.oracle_with(["oui"], extra=[("lines", _REG_LINES)]) + """
select upper(split_part(line, chr(9), 1)) as prefix, arg_max(substr(line, instr(line, chr(9)) + 1), line_no) as vendor
from lines where instr(line, chr(9)) > 0 group by 1""")
def q_oui_registry_scan(spark, sf_dir):
    """Registry lines written as text files in line order, read with the S2
    reader; the result is the prefix -> vendor map after 'later line wins'."""
    from apsight.sources import readers
    fx = Fixtures(spark, sf_dir)
    lines = spark.sql(_REG_LINES.replace("from oui", "from {oui}").replace("chr(9)", "char(9)"), oui=fx.oui)
    path = _scratch(spark, "oui-registry")
    lines.orderBy("line_no").select("line").write.mode("overwrite").text(path)  # range-sorted files, in order by name
    reg = readers.read_oui_registry(spark, path)
    return reg.groupBy("prefix").agg(F.max_by("vendor", "line_no").alias("vendor"))


@query("weight_options", O.with_ml() + "".join(f", {n} as ({q})\n" for n, q in _TRAIN_TEST) + """
select 'balanced' as option, label_sensitive_binary as label,
  sum(count(*)) over () / (count(*) over () * count(*)) as weight from train group by 2
union all select o, l, w from (values ('{0: 1, 1: 5}', 0, 1.0), ('{0: 1, 1: 5}', 1, 5.0), ('{0: 1, 1: 10}', 0, 1.0),
  ('{0: 1, 1: 10}', 1, 10.0), ('{0: 1, 1: 20}', 0, 1.0), ('{0: 1, 1: 20}', 1, 20.0)) as t(o, l, w)""")
def q_weight_options(spark, sf_dir):
    """The weight each class gets under each class-weight option, on train."""
    from apsight.operators import encode
    from apsight.plans.experiment import WEIGHT_OPTIONS
    train, _ = split_frames(Fixtures(spark, sf_dir))
    out = None
    for opt in WEIGHT_OPTIONS:
        if opt == "balanced":
            w = encode.balanced_class_weights(train, "label_sensitive_binary").select(
                F.lit("balanced").alias("option"), F.col("label_sensitive_binary").alias("label"), "weight")
        else:
            lab = train.select(F.col("label_sensitive_binary").alias("label")).distinct()
            w = encode.with_weights(lab, "label", opt, "weight").select(F.lit(str(opt)).alias("option"), "label", "weight")
        out = w if out is None else out.unionByName(w)
    return out


@query("target_encode_state", O.with_ml() + f", folds as ({_FOLDS_SQL})" + """
, f as (select m.*, folds.fold from mlf m join folds on m.add_state is not distinct from folds.add_state)
select t.row_id, t.fold,
  (select sum(label_sensitive_binary) from f f2 where f2.fold <> t.fold) / (select count(*) from f f2 where f2.fold <> t.fold) as te_state
from f t""")
def q_target_encode_state(spark, sf_dir):
    """state encoding under state folds: every test state is unseen in its
    training folds, so it gets the training mean."""
    from apsight.operators import encode, splits
    fx = Fixtures(spark, sf_dir)
    rows = ml_rows(fx)
    fm = splits.shuffled_group_folds(fx.ml, "add_state", k=5)
    a = splits.assign_folds(rows, fm, "add_state")
    out = None
    for k in range(5):
        enc = encode.target_encode_apply(a.where(F.col("fold") == k), a.where(F.col("fold") != k),
                                         "add_state", "label_sensitive_binary", "te_state")
        out = enc if out is None else out.unionByName(enc)
    return out.select("row_id", "fold", "te_state")


@query("results_sink", O.with_us() + "\nunion all\n".join(
    f"select 'distribution' as \"table\", '{c}' as \"column\", cast(\"{c}\" as varchar) as value, count(*) as count, "
    f"count(*) / sum(count(*)) over () as proportion from us group by \"{c}\"" for c in _DIST_COLS)
    + "\nunion all\nselect 'frequent_names', 'name', name, count(*), null from us group by name having count(*) > 5")
def q_results_sink(spark, sf_dir):
    """Result tables written as one long table partitioned by table name, read back."""
    from apsight.sources import sinks
    us = us_rows(Fixtures(spark, sf_dir))
    names = profile.frequent_values(us, "name", 5).select(
        F.lit("name").alias("column"), F.col("name").alias("value"), "count")
    path = _scratch(spark, "results")
    sinks.write_results({"distribution": profile.distributions(us), "frequent_names": names}, path)
    return spark.read.parquet(path).select("table", "column", "value", "count", "proportion")


@query("group_kfold", O.with_ml().replace("with ", "with recursive ", 1) + """
, sized as (select add_state, count(*) as n, row_number() over (order by count(*) desc, coalesce(add_state, 'None')) as i from mlf group by 1)
, steps as (
  select cast(0 as bigint) as i, [0, 0, 0, 0, 0]::bigint[] as sizes, cast(null as varchar) as add_state, cast(-1 as integer) as fold
  union all
  select s.i, [case when j = list_position(p.sizes, list_min(p.sizes)) then p.sizes[j] + s.n else p.sizes[j] end for j in [1, 2, 3, 4, 5]],
    s.add_state, cast(list_position(p.sizes, list_min(p.sizes)) - 1 as integer)
  from steps p join sized s on s.i = p.i + 1)
select add_state, fold from steps where i > 0""")
def q_group_kfold(spark, sf_dir):
    """Group k-fold (largest groups first to the emptiest fold)."""
    from apsight.operators import splits
    return splits.group_kfold(ml_rows(Fixtures(spark, sf_dir)), "add_state", 5)


@query("distinct_vendors", O.with_ml() + "select count(distinct vendor_clean) as n_distinct from mlf")
def q_distinct_vendors(spark, sf_dir):
    """Exact distinct vendors of the modelling rows."""
    return profile.distinct_count(ml_rows(Fixtures(spark, sf_dir)), "vendor_clean")


@query("top5_vendors", O.with_ml() + """
select vendor_clean, count(*) as count from mlf group by 1 order by count desc, vendor_clean limit 5""")
def q_top5_vendors(spark, sf_dir):
    """The five most frequent vendors (a top-k report: the limit is the feature)."""
    return profile.top_values(ml_rows(Fixtures(spark, sf_dir)), "vendor_clean", 5)


@query("experiment_tuned")
def q_experiment_tuned(spark, sf_dir):
    """E2: 'sgd_fixed' is fitted on the whole training fold and judged at 0.5;
    'sgd' is fitted on training minus a 10 % stratified validation slice and
    judged at the validation's best-macro-F1 threshold. Random split and state
    folds; rows only (learned models)."""
    from apsight.plans import experiment as X
    cfg = X.ExperimentConfig(models=("sgd", "sgd_fixed"), split_modes=("random", "state"),
                             threshold_mode="best_f1")
    return X.run_experiment(Fixtures(spark, sf_dir).ml, cfg, run_id="tuned")


# ---------------------------------------------- entry 1 fed to entry 2, and sorted tables (A2-A5, K1, K3)

CROSSTAB_TOP = 20  # so that the top-N rule binds at every scale


def _sorted_part(name: str, columns: str, source: str, order: str) -> str:
    return f"select '{name}' as \"table\", row_number() over (order by {order}) as row_no, {columns} from ({source})"


def _profile_oracle() -> str:
    dist = " union all ".join(
        f"select '{c}' as \"column\", cast(\"{c}\" as varchar) as value, count(*) as count, count(*) / sum(count(*)) over () as proportion from us group by \"{c}\""
        for c in profile.PROFILE_COLUMNS)
    yes = """select class as value, count(*) as count, cast(case when class is null then 0 else count(*) filter (where type = 'yes') end as bigint) as yes_count,
      case when class is not null and count(*) filter (where type = 'yes') > 0 then count(*) filter (where type = 'yes') / count(*) end as yes_proportion
      from us group by class"""
    names = "select name as value, count(*) as count from us group by name having count(*) > 5"
    none = "cast(null as varchar)"
    parts = [
        _sorted_part("distribution", f"\"column\", value, {none} as right_value, count, proportion, cast(null as bigint) as yes_count", dist,
                     "\"column\", count desc, value nulls first"),
        _sorted_part("yes_per_class", f"'class' as \"column\", value, {none} as right_value, count, yes_proportion, yes_count", yes,
                     "yes_count desc, value nulls first"),
        _sorted_part("frequent_names", f"'name' as \"column\", value, {none} as right_value, count, cast(null as double), cast(null as bigint)", names,
                     "count desc, value nulls first")]
    for a, b in profile.CROSS_TABS:
        src = f"""select cast({a} as varchar) as lv, cast({b} as varchar) as rv, count(*) as count, count(*) / (select count(*) from us) as proportion
          from us group by {a}, {b} order by count desc, lv nulls first, rv nulls first limit {CROSSTAB_TOP}"""
        parts.append(_sorted_part(f"cross_{a}_x_{b}", f"{none} as \"column\", lv, rv, count, proportion, cast(null as bigint)", src,
                                  "count desc, lv nulls first, rv nulls first"))
    return _geo_oracle(""", us as (select vendor, mac_flags, vendor_src,""" + _JSON_SELECT + """
from tag where reason is null and lower(json_extract_string(body, '$.address.country_code')) = 'us')
""").replace("\n, us as", ", us as") + "\nunion all\n".join(parts)


@query("profile_sorted_tables", _profile_oracle())
def q_profile_sorted_tables(spark, sf_dir):
    """Enriched sightings (entry 1) profiled over all nine columns (entry 2) in one pass; every table written in
    its order and read back with its row numbers."""
    from apsight.operators import geocode
    from apsight.plans import profiling
    from apsight.sources import sinks
    path = _scratch(spark, "sorted-profile")
    names = profiling.sorted_profile(geocode.integrated_rows(tagged(Fixtures(spark, sf_dir))), path, crosstab_limit=CROSSTAB_TOP)
    kinds = {"column": "string", "value": "string", "left_value": "string", "right_value": "string", "count": "long",
             "proportion": "double", "yes_count": "long", "yes_proportion": "double"}
    out = None
    for name in names:
        t = sinks.read_sorted(spark, path, name)
        col = lambda c, t=t: F.col(c) if c in t.columns else F.lit(None).cast(kinds[c])
        part = t.select(F.lit(name).alias("table"), "row_no", col("column").alias("column"), F.coalesce(col("value"), col("left_value")).alias("value"),
                        col("right_value").alias("right_value"), "count", F.coalesce(col("proportion"), col("yes_proportion")).alias("proportion"),
                        col("yes_count").alias("yes_count"))
        out = part if out is None else out.unionByName(part)
    return out


@query("sorted_metrics", _runs_oracle() + """
select run_id, model, fold, accuracy, macro_f1, row_number() over (order by run_id, model, fold) as row_no,
  row_number() over (order by macro_f1 desc, run_id, model, fold) as place from runs""")
def q_sorted_metrics(spark, sf_dir):
    """K3: the metric rows of both runs, appended per run (S11), sorted by several keys, written in that order and
    read back; ``place`` is the ranking by macro F1."""
    from apsight.operators.ranks import global_rank
    from apsight.sources import sinks
    fx = Fixtures(spark, sf_dir)
    path, sorted_path = _scratch(spark, "metrics"), _scratch(spark, "sorted-metrics")
    for run_id, t in RUNS:
        sinks.append_run(fold_metrics(fx, t), path, run_id)
    keys = [F.asc(c) for c in ("run_id", "model", "fold")]
    table, _ = global_rank(spark.read.parquet(path), [F.desc("macro_f1"), *keys], "place")
    sinks.write_sorted({"metrics": (table, keys)}, sorted_path)
    return sinks.read_sorted(spark, sorted_path, "metrics").select("run_id", "model", "fold", "accuracy", "macro_f1", "row_no", "place")

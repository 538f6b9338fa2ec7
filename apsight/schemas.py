"""Declared schemas (nothing is inferred)."""

from pyspark.sql import types as T

S, L, I, D = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()

# Raw sightings TSV, positional. Every column is read as text; the epoch and the
# point are parsed with try_cast so a bad row goes to the dead letter instead
# of failing the job.
# Fixed values in this module: the column names of the files and of the response bodies.
RAW_SIGHTINGS = T.StructType([
    T.StructField("epochtime", S), T.StructField("bssid", S), T.StructField("latlong", S),
    T.StructField("c3", S), T.StructField("c4", S), T.StructField("altitude", S),
])

ADDRESS = T.StructType([T.StructField(n, S) for n in (
    "road", "neighbourhood", "town", "county", "state", "ISO3166-2-lvl4", "postcode", "country",
    "country_code")])

# Leaves are read as text, whatever their JSON type; ``geocode.json_fields`` casts them.
GEOCODE_BODY = T.StructType([
    T.StructField(n, S) for n in ("place_id", "osm_type", "osm_id", "class", "type", "place_rank", "importance",
                                  "addresstype", "name", "display_name")
] + [T.StructField("address", ADDRESS), T.StructField("_corrupt_record", S)])

GEOCODE_RESPONSES = T.StructType([
    T.StructField("lat", D), T.StructField("lon", D), T.StructField("status", I), T.StructField("body", S),
])

# Integrated output: 27 columns, order as written by the enrichment.
INTEGRATED_FIELDS = [
    ("epochtime", L), ("bssid", S), ("lat", D), ("lon", D), ("altitude", S), ("vendor", S),
    ("mac_flags", I), ("vendor_src", I), ("place_id", L), ("osm_type", S), ("osm_id", L),
    ("class", S), ("type", S), ("place_rank", I), ("importance", D), ("addresstype", S),
    ("name", S), ("display_name", S), ("add_road", S), ("add_neighbourhood", S), ("add_town", S),
    ("add_county", S), ("add_state", S), ("add_ISO3166v14", S), ("add_postcode", S),
    ("add_country", S), ("add_country_code", S),
]
INTEGRATED = T.StructType([T.StructField(n, t) for n, t in INTEGRATED_FIELDS])

DEAD_LETTER = T.StructType(list(RAW_SIGHTINGS.fields) + [
    T.StructField("error_code", I), T.StructField("reason", S)])

METRICS = T.StructType([
    T.StructField("run_id", S), T.StructField("target", S), T.StructField("split_mode", S),
    T.StructField("fold_id", I), T.StructField("model", S), T.StructField("feature_mode", S),
    T.StructField("n_train", L), T.StructField("n_test", L), T.StructField("best_threshold", D),
    T.StructField("val_macro_f1", D), T.StructField("accuracy", D), T.StructField("macro_f1", D),
    T.StructField("weighted_f1", D), T.StructField("pr_auc", D), T.StructField("roc_auc", D),
])

"""Sighting parsing and geocode enrichment.

The reference calls a reverse geocoder per row over HTTP. Here the responses
are data: a table ``(lat, lon, status, body)``. Sightings are joined to it on
the exact point, the JSON body is parsed with ``from_json`` and every row is
tagged with a ``reason``: null (good), ``bad_row``, ``no_response``,
``http_<status>``, ``empty_body`` or ``bad_json``. The good rows form the
integrated table, the others the dead letter; both come from one plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apsight import schemas
from apsight.operators.joins import left_join_spread
from apsight.operators.vendor import vendor_lookup

_JSON_OPTS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}


def parse_sightings(raw: DataFrame) -> DataFrame:
    """Raw text columns -> typed epoch and point; ``bad_row`` when unparsable."""
    parts = raw.select("*", F.split(F.col("latlong"), ",").alias("_ll"))  # split once a row
    part = lambda i: F.when(F.size("_ll") == 2, F.get("_ll", F.lit(i)).try_cast("double"))
    return parts.select(*raw.columns, F.col("epochtime").try_cast("bigint").alias("_epoch"), part(0).alias("lat"), part(1).alias("lon"))


def dedupe_responses(responses: DataFrame) -> DataFrame:
    """One response per point: a 200 is preferred, then the larger body text.

    The body is parsed and typed here, once per point, so JSON cost follows the
    number of distinct points rather than the number of sightings: ``_status``,
    ``_fault`` (why the response is of no use, else null) and the fields.
    """
    best = F.max_by(F.struct("status", "body"),
                    F.struct((F.col("status") == 200).cast("int"), F.coalesce("body", F.lit(""))))
    parsed = (responses.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).groupBy("lat", "lon").agg(best.alias("_r"))
              .select(F.col("lat").alias("_rlat"), F.col("lon").alias("_rlon"), F.col("_r.status").alias("_status"),
                      F.col("_r.body").alias("_body"), parse_body(F.col("_r.body")).alias("_j")))
    fault = (F.when(F.col("_status").isNull(), F.lit("no_response"))
             .when(F.col("_status") != 200, F.concat(F.lit("http_"), F.col("_status").cast("string")))
             .when(F.coalesce(F.col("_body"), F.lit("")) == "", F.lit("empty_body"))
             .when(F.col("_j._corrupt_record").isNotNull(), F.lit("bad_json")))
    return parsed.select("_rlat", "_rlon", "_status", fault.alias("_fault"), *json_fields(F.col("_j")))


def parse_body(body) -> F.Column:
    return F.from_json(body, schemas.GEOCODE_BODY, _JSON_OPTS)


def with_parsed(responses: DataFrame, out: str = "_j") -> DataFrame:
    """Responses with their parsed bodies, each body parsed once. A table may lie in one row group, which one task
    would read and parse alone: the rows are dealt out first."""
    tasks = responses.sparkSession.sparkContext.defaultParallelism
    shared = responses.repartition(max(tasks, int(responses.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return shared.withColumn(out, parse_body(F.col("body")))


def json_fields(j: F.Column) -> list[F.Column]:
    """The 10 top-level and 9 address fields, named as in the integrated table."""
    a = j.getField("address")
    kinds = dict(schemas.INTEGRATED_FIELDS)

    def typed(name: str) -> F.Column:
        text, kind = j.getField(name), kinds[name]
        if kind.typeName() in ("integer", "long"):  # 12, "12" and 12.0 are the same number; 12.5 is none
            number = text.try_cast("decimal(38,9)")
            text = F.when(number == F.floor(number), number)
        return text.try_cast(kind)

    # fixed values: the names of the response body and of the integrated table
    top = [typed(n).alias(n) for n in ("place_id", "osm_type", "osm_id", "class", "type", "place_rank",
                                              "importance", "addresstype", "name", "display_name")]
    addr = [a.getField(src).alias(dst) for src, dst in (
        ("road", "add_road"), ("neighbourhood", "add_neighbourhood"), ("town", "add_town"),
        ("county", "add_county"), ("state", "add_state"), ("ISO3166-2-lvl4", "add_ISO3166v14"),
        ("postcode", "add_postcode"), ("country", "add_country"), ("country_code", "add_country_code"))]
    return top + addr


def enrich(raw: DataFrame, registry: DataFrame, responses: DataFrame, points: DataFrame | None = None) -> DataFrame:
    """Tagged enrichment: integrated columns + raw columns + error_code + reason. ``points``: the deduplicated responses,
    where they are kept for several plans.

    The planner chooses both joins by the measured size of the build side; in a
    shuffle join AQE splits a hot point on the sighting side, and rows without a
    point are spread (``left_join_spread``).
    """
    with_vendor = vendor_lookup(parse_sightings(raw), registry)
    resp = dedupe_responses(responses) if points is None else points
    j = left_join_spread(with_vendor, resp, [("lat", "_rlat"), ("lon", "_rlon")])
    bad_row = F.col("_epoch").isNull() | F.col("lat").isNull() | F.col("lon").isNull() | F.col("bad_bssid")
    reason = (F.when(bad_row, F.lit("bad_row")).when(F.col("_rlat").isNull(), F.lit("no_response")).otherwise(F.col("_fault")))
    error_code = F.when(F.col("_status") != 200, F.col("_status"))
    return j.select(
        F.col("_epoch").alias("epoch"), "lat", "lon", "altitude", "vendor", "mac_flags", "vendor_src",
        *resp.columns[4:], *[F.col(f.name).alias(f"raw_{f.name}") for f in schemas.RAW_SIGHTINGS.fields],
        error_code.cast("int").alias("error_code"), reason.alias("reason"))


def integrated_rows(tagged: DataFrame) -> DataFrame:
    """Good rows in the 27-column integrated layout."""
    good = tagged.where(F.col("reason").isNull())
    return good.select(*[
        (F.col("epoch") if n == "epochtime" else F.col("raw_bssid") if n == "bssid" else F.col(n)).cast(t).alias(n)
        for n, t in schemas.INTEGRATED_FIELDS])


def dead_letter_rows(tagged: DataFrame) -> DataFrame:
    """Failed rows: the original raw columns, the HTTP status and the reason."""
    bad = tagged.where(F.col("reason").isNotNull())
    return bad.select(*[F.col(f"raw_{f.name}").alias(f.name) for f in schemas.RAW_SIGHTINGS.fields],
                      "error_code", "reason")


def run_counters(tagged: DataFrame) -> DataFrame:
    """processed / failed geocode / failed vendor, as one aggregate."""
    return tagged.agg(
        F.count(F.lit(1)).alias("processed"),
        F.count_if(F.col("reason").isNotNull() & (F.col("reason") != "bad_row")).alias("failed_geo"),
        F.count_if(F.col("reason") == "bad_row").alias("bad_rows"),
        F.count_if(F.col("vendor") == "NaN").alias("failed_vendor"))

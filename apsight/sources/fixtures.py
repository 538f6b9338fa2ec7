"""Inputs derived from the driver tables (TPC-H-like parquet).

The reference ships no input data, so sightings, the OUI registry, the alias
table, geocoder responses and the modelling table are *derived* from the
driver tables. Each derivation is one SQL text with ``{table}`` placeholders:
Spark runs it through ``spark.sql(text, table=DataFrame)``, and the DuckDB
oracle runs the very same text with the placeholders replaced by view names,
so both engines start from identical rows.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession

DRIVER_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# One registry prefix per supplier. The two flag bits of the first octet are
# cleared (second hex digit in 0/4/8/C) so that flipped sightings need the
# bit-flip search.
OUI_SQL = """
select s_suppkey, s_nationkey, s_suppkey as line_no,
  upper(substr(md5('oui-' || cast(s_suppkey as varchar(20))),1,1))
  || substr('048C', cast(s_suppkey % 4 as int)+1, 1) || '-'
  || upper(substr(md5('oui-' || cast(s_suppkey as varchar(20))),3,2)) || '-'
  || upper(substr(md5('oui-' || cast(s_suppkey as varchar(20))),5,2)) as prefix,
  case cast(s_suppkey % 10 as int) when 0 then 'Cisco Systems, Inc' when 1 then 'Cisco  MERAKI'
    when 2 then 'TP-Link Systems Inc.' when 3 then 'Nokia' when 4 then 'Apple, Inc.'
    when 5 then 'Sonos Inc.' else 'Vendor ' || cast(s_suppkey as varchar(20)) end as vendor
from {supplier}
"""

# Sightings: l_orderkey % 4 picks no flip / multicast / local / both; every
# 17th order has an unknown prefix. The point id (for geocoding) is the part.
AP_SQL = """
select l_orderkey*8 + l_linenumber as ap_id, l_orderkey, l_linenumber, l_partkey as point_id,
  case when l_orderkey % 17 = 0 then 'FF:FF:FF' else
    substr(o.prefix,1,1) || substr('0123456789ABCDEF',
      instr('0123456789ABCDEF', substr(o.prefix,2,1)) + cast(l_orderkey % 4 as int), 1)
    || ':' || substr(o.prefix,4,2) || ':' || substr(o.prefix,7,2) end
  || ':00:' || upper(substr(md5(cast(l_orderkey as varchar(20))),1,2)) || ':0' || cast(l_linenumber as varchar(4)) as bssid,
  p_type as class,
  case when p_size % 3 = 0 then 'yes' else 'size' || cast(p_size % 5 as varchar(4)) end as type,
  l_returnflag as addresstype, p_brand as name, n_name as add_state,
  case when r_name = 'AMERICA' then 'US' when r_name = 'ASIA' then null else 'xx' end as add_country_code
from {lineitem} l join {oui} o on l_suppkey = o.s_suppkey join {part} on l_partkey = p_partkey
  join {nation} on o.s_nationkey = n_nationkey join {region} on n_regionkey = r_regionkey
"""

# Modelling rows, one per order (row_id unique). 'unknown' = '4-NOT SPECIFIED'.
# The binary label mixes state, vendor and noise of the key; neither numeric column holds it.
ML_SQL = """
select o_orderkey as row_id, v.vendor as vendor_clean, n_name as add_state,
  case when o_orderpriority = '4-NOT SPECIFIED' then 'unknown' else lower(substr(o_orderpriority,3)) end as label_target_main,
  case when (n_nationkey % 5) * 6 + (v.s_suppkey % 4) * 6 + (o_orderkey * 7919) % 97 >= 110 then 1 else 0 end as label_sensitive_binary,
  cast(floor(o_totalprice) as bigint) % 31 as place_rank, o_totalprice / 500000 as importance,
  cast(o_orderkey % 101 as double) / 101 as score
from {orders} join {customer} on o_custkey = c_custkey join {nation} on c_nationkey = n_nationkey
  join {oui} v on v.s_suppkey = o_custkey % (select count(*) from {supplier})
"""

# A small alias table (canonical name, alias text, line order).
# 'Cisco  MERAKI' in the registry only matches 'Cisco Meraki' after case and
# blank folding; 'Nokia' is listed twice, the later line wins.
ALIAS_SQL = """
select canonical, alias, line_no from (values
  ('Cisco', 'Cisco', 1),
  ('Cisco', 'Cisco Systems, Inc', 2),
  ('Cisco', 'Cisco Meraki', 3),
  ('TP-Link', 'TP-Link', 4),
  ('TP-Link', 'TP-Link Systems Inc.', 5),
  ('Apple', 'Apple', 6),
  ('Apple', 'Apple, Inc.', 7),
  ('Sonos', 'Sonos Inc.', 8),
  ('Nokia Networks', 'Nokia', 9),
  ('Nokia', 'Nokia', 10)
) as t(canonical, alias, line_no)
"""

# Raw sightings in the positional layout of the TSV (epoch, bssid, "lat,lon",
# two unused columns, altitude). One point per part; lat/lon are exact
# doubles in both engines (integer / 1000).
RAW_SQL = """
select cast(l_orderkey * 1000 + l_linenumber as bigint) + 1700000000000 as epochtime,
  a.bssid,
  20 + cast(a.point_id as double) / 1000 as lat,
  -70 - cast(a.point_id % 997 as double) / 100 as lon,
  case when l_linenumber = 7 then null else cast(l_linenumber * 10 as varchar(8)) end as altitude,
  a.ap_id, a.point_id
from {ap} a
"""

# Geocoder responses, one per point that has one: status 500 for points
# % 13 = 0, no response for % 19 = 0, a body that is not JSON for % 23 = 0,
# a body without "address" for % 29 = 0. Bodies are built by concatenation,
# so both engines hold the same text.
GEOCODE_SQL = """
select 20 + cast(p_partkey as double) / 1000 as lat,
  -70 - cast(p_partkey % 997 as double) / 100 as lon,
  case when p_partkey % 13 = 0 then 500 else 200 end as status,
  case when p_partkey % 13 = 0 then ''
       when p_partkey % 23 = 0 then 'not json <' || cast(p_partkey as varchar(20)) || '>'
       else '{{"place_id": ' || cast(p_partkey * 7 as varchar(20))
         || ', "osm_type": "way", "osm_id": ' || cast(p_partkey * 11 as varchar(20))
         || ', "class": "' || lower(substr(p_type, 1, instr(p_type, ' ') - 1))
         || '", "type": "' || case when p_size % 3 = 0 then 'yes' else 'size' || cast(p_size % 5 as varchar(4)) end
         || '", "place_rank": ' || cast(p_size % 31 as varchar(4))
         || ', "importance": ' || cast(p_size as varchar(8)) || '.25'
         || ', "addresstype": "' || p_container_like || '"'
         || ', "name": "' || p_brand || '"'
         || ', "display_name": "' || p_name || '"'
         || case when p_partkey % 29 = 0 then '' else
              ', "address": {{"road": "Road ' || cast(p_partkey % 50 as varchar(8))
              || '", "town": "Town ' || cast(p_partkey % 40 as varchar(8))
              || '", "county": "County ' || cast(p_partkey % 30 as varchar(8))
              || '", "state": "' || n_name
              || '", "ISO3166-2-lvl4": "US-' || substr(n_name, 1, 2)
              || '", "postcode": "' || cast(10000 + p_partkey % 89999 as varchar(8))
              || '", "country": "' || r_name
              || '", "country_code": "' || case when r_name = 'AMERICA' then 'us' else 'xx' end || '"}}' end
         || '}}' end as body
from (select p.*, case when p_size % 2 = 0 then 'building' else 'road' end as p_container_like,
        cast(p_partkey % 25 as int) as p_nation from {part} p) pp
  join {nation} on p_nation = n_nationkey join {region} on n_regionkey = r_regionkey
where p_partkey % 19 <> 0
"""

# Scored rows for the evaluation operators: three deterministic scorers of the
# binary label (uninformative, blended with the price, place rank) and a
# multiclass prediction that is right on every third row.
SCORED_SQL = """
select row_id, add_state, label_sensitive_binary as y, label_target_main,
  score as s_uniform,
  (importance + score) / 2 as s_blend,
  cast(place_rank as double) / 30 as s_rank,
  case when row_id % 3 = 0 then label_target_main
       else case cast(row_id % 4 as int) when 0 then 'high' when 1 then 'low' when 2 then 'medium' else 'urgent' end
  end as pred_target
from {ml} where vendor_clean is not null and add_state is not null
"""

# name -> (sql text, dependencies in the order they must be defined)
FIXTURE_SQL = {
    "oui": (OUI_SQL, ["supplier"]),
    "ap": (AP_SQL, ["lineitem", "oui", "part", "nation", "region"]),
    "ml": (ML_SQL, ["orders", "customer", "nation", "oui", "supplier"]),
    "alias": (ALIAS_SQL, []),
    "raw": (RAW_SQL, ["ap"]),
    "geocode_responses": (GEOCODE_SQL, ["part", "nation", "region"]),
    "scored": (SCORED_SQL, ["ml"]),
}


class Fixtures:
    """Driver tables and derived input frames of one scale-factor folder, each opened on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._cache: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._cache and name in DRIVER_TABLES:
            self._cache[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")  # opened on first use
        elif name not in self._cache:
            sql, deps = FIXTURE_SQL[name]
            self._cache[name] = self.spark.sql(sql, **{d: self.table(d) for d in deps})
        return self._cache[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name in FIXTURE_SQL or name in DRIVER_TABLES:
            return self.table(name)
        raise AttributeError(name)


def _order(names: list[str]) -> list[str]:
    seen: list[str] = []

    def visit(n: str) -> None:
        if n in DRIVER_TABLES or n in seen:
            return
        for d in FIXTURE_SQL[n][1]:
            visit(d)
        seen.append(n)

    for n in names:
        visit(n)
    return seen


def oracle_with(names: list[str], extra: list[tuple[str, str]] | None = None) -> str:
    """``WITH`` clause defining the named fixtures for DuckDB (plain view names).

    ``extra`` appends further (name, sql) CTEs written directly for the oracle.
    """
    parts = []
    for n in _order(names):
        sql, deps = FIXTURE_SQL[n]
        parts.append(f"{n} as ({sql.format(**{d: d for d in deps})})")
    for n, sql in extra or []:
        parts.append(f"{n} as ({sql})")
    return "with " + ",\n".join(parts) + "\n" if parts else ""

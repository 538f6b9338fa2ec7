"""DuckDB-side building blocks for the oracle SQL of each registered query.

These are written independently of the Spark operators (brute force where the
Spark side is clever) so that the side-by-side check means something.
"""

from __future__ import annotations

from apsight.sources.fixtures import oracle_with

# Vendor lookup by brute force: the four candidate keys joined one by one
# against the registry (last line wins per prefix).
REGISTRY_ORACLE = """
select upper(prefix) as prefix, arg_max(vendor, line_no) as vendor
from oui where vendor is not null and vendor <> 'NaN' group by 1
"""

def vendor_oracle(src: str) -> str:
    """Brute-force vendor lookup over the rows of ``src`` (needs ``registry``)."""
    return VENDOR_ORACLE.replace("__SRC__", src)


VENDOR_ORACLE = """
select a.*, coalesce(r0.vendor, r1.vendor, r2.vendor, r3.vendor, 'NaN') as vendor,
  cast(case when a.n_parts < 3 then 0 else a.f & 3 end as integer) as mac_flags,
  cast(case when r0.vendor is not null then 1 when r1.vendor is not null then 2
       when r2.vendor is not null then 3 when r3.vendor is not null then 4 else 0 end as integer) as vendor_src
from (
  select ap.*, len(p) as n_parts,
    case when len(p) >= 3 then ('0x' || p[1])::BIGINT end as f,
    case when len(p) >= 3 then '-' || p[2] || '-' || p[3] end as tail
  from (select *, string_split(replace(upper(trim(bssid)), '-', ':'), ':') as p from __SRC__) ap
) a
left join registry r0 on r0.prefix = printf('%02X', xor(a.f, 0)) || a.tail
left join registry r1 on r1.prefix = printf('%02X', xor(a.f, 1)) || a.tail
left join registry r2 on r2.prefix = printf('%02X', xor(a.f, 2)) || a.tail
left join registry r3 on r3.prefix = printf('%02X', xor(a.f, 3)) || a.tail
"""

INTEGRATED_ORACLE = VENDOR_ORACLE.replace("__SRC__", "ap")

ALIAS_ORACLE = """
select key, arg_max(canonical, ord) as canonical from (
  select trim(regexp_replace(lower(coalesce(alias, '')), '\\s+', ' ', 'g')) as key, canonical,
         cast(line_no as double) as ord from alias
  union all
  select trim(regexp_replace(lower(coalesce(canonical, '')), '\\s+', ' ', 'g')), canonical,
         min(line_no) - 0.5 from alias group by canonical
) where key <> '' group by key
"""


def with_integrated(*more: str, extra: list[tuple[str, str]] | None = None) -> str:
    return oracle_with(["ap", "oui", *more],
                       extra=[("registry", REGISTRY_ORACLE), ("integrated", INTEGRATED_ORACLE), *(extra or [])])


def with_us() -> str:
    return oracle_with(["ap", "oui"], extra=[
        ("registry", REGISTRY_ORACLE), ("integrated", INTEGRATED_ORACLE),
        ("us", "select * from integrated where lower(add_country_code) = 'us'")])


def with_ml() -> str:
    return oracle_with(["ml"], extra=[
        ("mlf", "select * from ml where vendor_clean is not null and add_state is not null")])

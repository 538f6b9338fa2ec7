"""Vendor lookup from the MAC prefix with flag-bit tolerance (J1) and
vendor-name canonicalisation through an alias table (J2, P15).

J1 design: the four candidates (as is, multicast flipped, local flipped, both
flipped) differ only in the two low bits of the first octet. The registry is
therefore grouped by its *base key* (first octet with those bits cleared), and
the search is done there, once per base key: for each of the four low-bit
patterns the first candidate's vendor and source code. A sighting then needs one
equi-join on the base key and one array access. No exploding, no per-row Python,
one (normally broadcast) hash join; sightings without a usable prefix are spread
over the shuffle if there is one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apsight.functions.mac import hex2, parse_hex, with_mac_fields
from apsight.functions.text import normalize_vendor
from apsight.operators.joins import left_join_spread

UNKNOWN_VENDOR = "NaN"


def registry_lookup(registry: DataFrame, prefix: str = "prefix", vendor: str = "vendor",
                    order: str | None = "line_no") -> DataFrame:
    """Registry ``(prefix, vendor[, line order])`` -> ``(_oui_base, _best)``:
    ``_best`` holds (vendor, src) for each low-bit pattern of a sighting.

    Prefixes are upper-cased; a later line overrides an earlier one for the
    same prefix. Entries whose key could never equal a formatted sighting key
    (not three '-' parts, first part not canonical two-digit hex) are dropped,
    as are vendors equal to the unknown marker.
    """
    reg = registry.select(F.upper(F.col(prefix)).alias("_prefix"), F.col(vendor).alias("_vendor"),
                          (F.col(order) if order else F.lit(0)).alias("_ord"))
    reg = (reg.where(F.col("_vendor").isNotNull() & (F.col("_vendor") != UNKNOWN_VENDOR))
           .groupBy("_prefix").agg(F.max_by("_vendor", "_ord").alias("_vendor")))
    parts = F.split("_prefix", "-")
    first = parse_hex(F.get(parts, 0))
    reg = (reg.where((F.size(parts) == 3) & first.isNotNull() & (hex2(first) == F.get(parts, 0)))
           .select(F.concat_ws("-", hex2(first.bitwiseAND(-4)), F.get(parts, 1), F.get(parts, 2)).alias("_oui_base"),
                   first.bitwiseAND(3).cast("int").alias("_low"), "_vendor"))
    slots = reg.groupBy("_oui_base").agg(
        *[F.max(F.when(F.col("_low") == i, F.col("_vendor"))).alias(f"_v{i}") for i in range(4)])

    def found(low: int):
        """The first mask whose slot is filled."""
        src = F.coalesce(*[F.when(F.col(f"_v{low ^ mask}").isNotNull(), mask + 1) for mask in range(4)])
        return F.struct(F.coalesce(*[F.col(f"_v{low ^ mask}") for mask in range(4)]).alias("vendor"), src.alias("src"))

    return slots.select("_oui_base", F.array(*[found(low) for low in range(4)]).alias("_best"))


def vendor_lookup(sightings: DataFrame, registry: DataFrame, bssid: str = "bssid",
                  lookup: DataFrame | None = None, pad_octets: bool = False) -> DataFrame:
    """Add ``vendor`` ('NaN' when unknown), ``mac_flags`` and ``vendor_src``.

    vendor_src: 1 as is, 2 multicast bit flipped, 3 local bit flipped, 4 both,
    0 no match. A BSSID with fewer than three parts gives ('NaN', 0, 0). A
    BSSID whose first octet is not hex is flagged in ``bad_bssid`` (the
    enrichment sends it to the dead letter). ``pad_octets`` pads unpadded
    second/third octets so that ``0:b:86`` can match ``00-0B-86``.
    """
    if lookup is None:
        lookup = registry_lookup(registry)
    plain = sightings.drop("vendor", "mac_flags", "vendor_src")
    s = with_mac_fields(plain, bssid, pad_octets, base_key="_base", low_bits="_lowb", mac_flags="mac_flags", bad="bad_bssid")
    j = left_join_spread(s, lookup, [("_base", "_oui_base")])
    hit = j.select("*", F.get("_best", F.col("_lowb")).alias("_hit"))
    return hit.select(*plain.columns, F.coalesce("_hit.vendor", F.lit(UNKNOWN_VENDOR)).alias("vendor"), "mac_flags",
                      F.coalesce("_hit.src", F.lit(0)).cast("int").alias("vendor_src"), "bad_bssid")


def alias_lookup_table(aliases: DataFrame, canonical: str = "canonical", alias: str = "alias",
                       order: str = "line_no", include_canonical: bool = True) -> DataFrame:
    """``(canonical, alias, line order)`` -> unique ``(_alias_key, _canonical)``.

    Each canonical name is also its own alias, placed just before the first line
    of its group; later lines win for a repeated alias; empty keys are dropped.
    """
    rows = aliases.select(F.col(canonical).alias("_canonical"), F.col(alias).alias("_alias"),
                          F.col(order).cast("double").alias("_ord"))
    if include_canonical:
        selfs = (rows.groupBy("_canonical").agg(F.min("_ord").alias("_ord"))
                 .select("_canonical", F.col("_canonical").alias("_alias"), (F.col("_ord") - 0.5).alias("_ord")))
        rows = rows.unionByName(selfs)
    keyed = rows.select(normalize_vendor(F.col("_alias")).alias("_alias_key"), "_canonical", "_ord")
    return (keyed.where(F.col("_alias_key") != "")
            .groupBy("_alias_key").agg(F.max_by("_canonical", "_ord").alias("_canonical")))


def canonicalize_vendor(df: DataFrame, aliases: DataFrame, vendor: str = "vendor",
                        out: str = "vendor_clean") -> DataFrame:
    """``out = coalesce(canonical(normalised vendor), vendor)``."""
    side = alias_lookup_table(aliases)
    keyed = df.withColumn("_vkey", normalize_vendor(F.col(vendor)))
    j = keyed.join(side, keyed["_vkey"] == side["_alias_key"], "left")
    return j.select(*[keyed[c] for c in df.columns if c != out],
                    F.coalesce(F.col("_canonical"), F.col(vendor)).alias(out))


def alias_rows(spark, mapping: dict[str, list[str]]) -> DataFrame:
    """Alias table ``(canonical, alias, line_no)`` from a ``{canonical: [aliases]}``
    mapping, in the mapping's order. A canonical name without aliases gets one
    row with a null alias (it still maps to itself)."""
    rows, n = [], 0
    for canonical, aliases in mapping.items():
        for a in (aliases or [None]):
            n += 1
            rows.append((canonical, a, n))
    return spark.createDataFrame(rows, "canonical string, alias string, line_no long")

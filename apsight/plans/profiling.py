"""Entry 2 of the reference: profile the enriched sightings of one country.

The reference scans its input once per result table (15 scans). Here one
aggregate over the filtered rows (``profile.Cube``) counts everything, and each
table is cut out of its checkpointed rows. Results go to one long table
partitioned by table name (S10), or in order with ranks (K1).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apsight.operators import profile
from apsight.sources import sinks

NEEDED = ("class", "type", "addresstype", "vendor", "vendor_src", "mac_flags", "add_state", "add_county",
          "add_town", "name", "add_country_code")


def profile_tables(integrated: DataFrame, country: str = "us", crosstab_limit: int = 5000) -> dict[str, DataFrame] | None:
    """All result tables as DataFrames (None when no row passes the filter)."""
    cols = profile.present(integrated, NEEDED)
    cube = profile.Cube(profile.country_filter(integrated.select(*cols), country))
    if not cube.total:
        return None
    out: dict[str, DataFrame] = {"distribution": cube.distributions()}
    if "class" in cols and "type" in cols:
        out["yes_per_class"] = cube.yes_share().select(
            F.lit("class").alias("column"), F.col("class").alias("value"),
            F.col("total_in_class").alias("count"), "yes_count", "yes_proportion")
    for left, right in cube.pairs:
        ct = cube.crosstab(left, right, crosstab_limit)
        out[f"cross_{left}_x_{right}"] = ct.select(
            F.col(left).cast("string").alias("left_value"), F.col(right).cast("string").alias("right_value"),
            "count", F.col("proportion_of_total").alias("proportion"),
            F.col(f"proportion_within_{left}").alias("proportion_within_left"),
            F.col(f"proportion_within_{right}").alias("proportion_within_right"))
    if cube.name:
        out["frequent_names"] = cube.frequent_values(5).select(
            F.lit("name").alias("column"), F.col("name").alias("value"), "count")
    out["_total"] = cube.rows([]).select("count")
    return out


def sorted_profile(integrated: DataFrame, out_path: str, country: str = "us", crosstab_limit: int = 5000, fmt: str = "parquet") -> list[str]:
    """Every result table written in its order (K1): by count, the shares of 'yes' by their count, ties by value."""
    tables = profile_tables(integrated, country, crosstab_limit) or {}
    tables.pop("_total", None)
    ordered = {}
    for name, df in tables.items():
        first = [F.asc("column")] if name == "distribution" else []
        count = F.desc("yes_count") if name == "yes_per_class" else F.desc("count")
        values = [F.asc_nulls_first(c) for c in ("left_value", "right_value", "value") if c in df.columns]
        ordered[name] = (df, [*first, count, *values])
    sinks.write_sorted(ordered, out_path, fmt)
    return list(ordered)


def run_profile(integrated: DataFrame, out_path: str, country: str = "us", fmt: str = "parquet") -> int:
    """Write every result table under ``out_path`` (long parquet, or one TSV
    folder per table with ``fmt="tsv"``); returns the filtered row count."""
    tables = profile_tables(integrated, country)
    if tables is None:
        return 0
    total = tables.pop("_total").first()["count"]
    sinks.write_results(tables, out_path, fmt)
    return total

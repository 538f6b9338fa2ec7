"""Join helpers: a broadcast hint only for a side whose size the caller has bounded; null-safe joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Row bound under which a side of known size is hinted (label maps, category
# lists, fold tables that the caller built). A side of unknown size carries no
# hint and is not counted: the planner and AQE choose by its measured bytes.
DEFAULT_BROADCAST_ROWS = 2_000_000


def bounded_broadcast(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS,
                      known_rows: int | None = None) -> tuple[DataFrame, bool]:
    """Return ``(side, hinted)``; hinted only if ``known_rows`` bounds it within ``max_rows``."""
    if known_rows is not None and known_rows <= max_rows:
        return F.broadcast(df), True
    return df, False


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` where null equals null; the keys of ``left`` are kept."""
    renamed = right
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"_right_{k}")
    j = left.join(renamed, [left[k].eqNullSafe(renamed[f"_right_{k}"]) for k in keys], how)
    return j.drop(*[f"_right_{k}" for k in keys])


#: Shuffle keys that rows without a usable key are spread over.
SPREAD = 4096


def left_join_spread(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]]) -> DataFrame:
    """Left join on ``keys`` (left, right); rows of ``left`` with a null key match nothing.

    A shuffle join would send all of these to one partition, so they get a second
    key: a hash of the whole row, where rows with a key have 0.
    """
    lacks = F.lit(False)
    for a, _ in keys:
        lacks = lacks | left[a].isNull()
    spread = F.when(lacks, F.pmod(F.xxhash64(*[left[c] for c in left.columns]), F.lit(SPREAD)) + 1).otherwise(F.lit(0).cast("long"))
    routed = left.select("*", spread.alias("_route"))
    # always 0, but no constant: the optimizer would turn that into a filter and drop the key
    side = right.select("*", F.pmod(F.xxhash64(*[right[b] for _, b in keys]), F.lit(1)).alias("_route_0"))
    on = [routed[a] == side[b] for a, b in keys] + [routed["_route"] == side["_route_0"]]
    return routed.join(side, on, "left").drop("_route", "_route_0")

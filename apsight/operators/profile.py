"""Profiling of enriched sightings: filters, distributions, cross-tabs,
frequent names, coverage (A1-A9, W1-W2, K1-K2, P9, J4).

The reference scans its file once per result table; here ``Cube`` counts all
columns, all pairs, the names and the total as grouping sets of one aggregate
(one scan, one Expand, partial aggregation before the shuffle). Its rows are
checkpointed and the tables are cut out of them: a cross-tab's marginals are the
single columns' rows, joined to the pairs, so no task gathers the pairs of a hot
value, and shares need no window.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apsight.session import ensure_checkpoint_dir

# The profiled columns and the cross-tab pairs of the reference.
PROFILE_COLUMNS = ("class", "type", "addresstype", "vendor", "vendor_src", "mac_flags",
                   "add_state", "add_county", "add_town")
CROSS_TABS = (("vendor", "type"), ("type", "addresstype"), ("vendor", "addresstype"))


def present(df: DataFrame, cols) -> list[str]:
    """Optional-column guard: keep only the columns the frame has (no job)."""
    have = set(df.columns)
    return [c for c in cols if c in have]


def country_filter(df: DataFrame, code: str = "us", col: str = "add_country_code") -> DataFrame:
    """Rows whose lower-cased country code equals ``code``; skipped if absent."""
    if col not in df.columns:
        return df
    return df.where(F.lower(F.col(col)) == code)


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"))


class Cube:
    """Counts of all result tables of a profile, from one pass over ``df``.

    ``frame`` has the grouped columns, ``_set`` (grouping id), ``count`` and
    ``_yes`` (rows whose ``type`` is 'yes'). A real null is a group of its own:
    the grouping id tells it apart from a column that is not grouped.
    """

    def __init__(self, df: DataFrame, columns=PROFILE_COLUMNS, pairs=CROSS_TABS, name: str = "name"):
        ensure_checkpoint_dir(df.sparkSession)
        self.columns = present(df, columns)
        self.pairs = [p for p in pairs if len(present(df, p)) == 2]
        self.name = name if name in df.columns else None
        sides = [c for p in self.pairs for c in p]
        self.all = list(dict.fromkeys([*self.columns, *sides, *([name] if self.name else [])]))
        sets = [[c] for c in self.all] + [list(p) for p in self.pairs] + [[]]
        yes = F.count_if(F.col("type") == "yes") if "type" in df.columns else F.lit(0).cast("long")
        self.counts = df.groupingSets(sets, *self.all).agg(  # the one pass
            F.count(F.lit(1)).alias("count"), yes.alias("_yes"), F.grouping_id(*self.all).alias("_set"))
        self.frame = self.counts.checkpoint(eager=True)
        first = self.rows([]).select("count").first()
        self.total = first["count"] if first else 0

    def rows(self, grouped: list[str]) -> DataFrame:
        """The rows of one grouping set."""
        last = len(self.all) - 1
        return self.frame.where(F.col("_set") == sum(1 << (last - i) for i, c in enumerate(self.all) if c not in grouped))

    def distributions(self) -> DataFrame:
        """Long table ``(column, value, count, proportion)`` for every column; ``value`` is the text form."""
        last = len(self.all) - 1
        ids = {c: sum(1 << (last - i) for i, o in enumerate(self.all) if o != c) for c in self.columns}
        own = self.frame.where(F.col("_set").isin(list(ids.values())))
        pick = lambda f: reduce(lambda acc, c: acc.when(F.col("_set") == ids[c], f(c)), self.columns[1:],
                                F.when(F.col("_set") == ids[self.columns[0]], f(self.columns[0])))
        return own.select(pick(F.lit).alias("column"), pick(lambda c: F.col(c).cast("string")).alias("value"), "count",
                          (F.col("count") / F.lit(self.total)).alias("proportion"))

    def yes_share(self, cls: str = "class") -> DataFrame:
        """Per class: total, number of ``type == 'yes'`` rows, and their share (see ``yes_share``)."""
        return _yes_columns(self.rows([cls]), cls, "count", "_yes")

    def crosstab(self, left: str, right: str, limit: int | None = 5000) -> DataFrame:
        """Pair counts with shares of the total and within each side, top ``limit`` (see ``crosstab``)."""
        return _crosstab_shares(self.rows([left, right]).select(left, right, "count"), self.rows([left]).select(F.col(left).alias("_left_value"), F.col("count").alias("_in_left")),
                                self.rows([right]).select(F.col(right).alias("_right_value"), F.col("count").alias("_in_right")), left, right, F.lit(self.total), limit)

    def frequent_values(self, min_count: int = 5) -> DataFrame:
        """Names that occur more than ``min_count`` times (null is a value here)."""
        return self.rows([self.name]).where(F.col("count") > min_count).select(self.name, "count")


def distributions(df: DataFrame, columns=PROFILE_COLUMNS) -> DataFrame:
    """Long table ``(column, value, count, proportion)`` for every column of ``df``."""
    return Cube(df, columns, (), "").distributions()


def yes_share(df: DataFrame, cls: str = "class", typ: str = "type") -> DataFrame:
    """Per class: total, number of ``type == 'yes'`` rows, and their share.

    Same rows as totals LEFT JOIN yes-counts on class: a null class matches
    nothing (yes_count 0), and the share is null, not 0, where no 'yes' exists.
    """
    g = df.groupBy(cls).agg(F.count(F.lit(1)).alias("count"), F.count_if(F.col(typ) == "yes").alias("_yes"))
    return _yes_columns(g, cls, "count", "_yes")


def _yes_columns(g: DataFrame, cls: str, total: str, yes_of: str) -> DataFrame:
    yes = F.when(F.col(cls).isNull(), F.lit(0)).otherwise(F.col(yes_of))
    return g.select(cls, F.col(total).alias("total_in_class"), yes.cast("long").alias("yes_count"),
                    F.when(F.col(cls).isNotNull() & (F.col(yes_of) > 0), F.col(yes_of) / F.col(total)).alias("yes_proportion"))


def crosstab(df: DataFrame, left: str, right: str, total: int | None = None,
             limit: int | None = 5000) -> DataFrame:
    """Pair counts with shares of the total and within each side, top ``limit``.

    Marginals are computed on all pairs before the limit; the limit keeps the
    largest counts with the pair as tie-break (TakeOrderedAndProject). They are
    aggregates of the pair counts joined back null-safe, so the pairs of a hot
    value are not gathered in one task. Without a known ``total`` it is the sum
    of the pair counts (every row is in exactly one pair), a scalar subquery.
    """
    g = df.groupBy(left, right).agg(F.count(F.lit(1)).alias("count"))
    tot = F.lit(total) if total is not None else g.agg(F.sum("count")).scalar()
    by_left = g.groupBy(F.col(left).alias("_left_value")).agg(F.sum("count").alias("_in_left"))
    by_right = g.groupBy(F.col(right).alias("_right_value")).agg(F.sum("count").alias("_in_right"))
    return _crosstab_shares(g, by_left, by_right, left, right, tot, limit)


def _crosstab_shares(pairs: DataFrame, by_left: DataFrame, by_right: DataFrame, left: str, right: str, total: Column, limit: int | None) -> DataFrame:
    both = (pairs.join(by_left, pairs[left].eqNullSafe(F.col("_left_value")))
            .join(by_right, pairs[right].eqNullSafe(F.col("_right_value"))))
    out = both.select(pairs[left], pairs[right], pairs["count"], (pairs["count"] / total).alias("proportion_of_total"),
                      (pairs["count"] / F.col("_in_left")).alias(f"proportion_within_{left}"),
                      (pairs["count"] / F.col("_in_right")).alias(f"proportion_within_{right}"))
    if limit is not None:
        out = out.orderBy(F.desc("count"), F.asc_nulls_first(left), F.asc_nulls_first(right)).limit(limit)
    return out


def frequent_values(df: DataFrame, col: str = "name", min_count: int = 5) -> DataFrame:
    """Values occurring more than ``min_count`` times (null is a value here)."""
    return (df.groupBy(col).agg(F.count(F.lit(1)).alias("count"))
            .where(F.col("count") > min_count))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Counts per non-null value (pandas-style: nulls skipped)."""
    return df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("count"))


def top_n_coverage(df: DataFrame, col: str, n: int) -> DataFrame:
    """Share of non-null rows that fall in the ``n`` most frequent values.

    The top n is a distributed top-k (``orderBy().limit()``: each partition
    keeps its n best, then they are merged); totals are one aggregate. The two
    one-row results are combined by a union and an aggregate, not a join.
    """
    counts = value_counts(df, col)
    top = counts.orderBy(F.desc("count"), F.asc(col)).limit(n)
    part_top = top.agg(F.sum("count").cast("long").alias("covered"),
                       F.lit(None).cast("long").alias("total"), F.lit(None).cast("long").alias("n_values"))
    part_all = counts.agg(F.lit(None).cast("long").alias("covered"), F.sum("count").cast("long").alias("total"),
                          F.count(F.lit(1)).alias("n_values"))
    both = part_top.unionByName(part_all).agg(
        F.coalesce(F.max("covered"), F.lit(0)).cast("long").alias("covered"),
        F.max("total").alias("total"), F.max("n_values").alias("n_values"))
    return both.select(F.lit(n).alias("top_n"), "n_values", "covered", "total",
                       (F.col("covered") / F.col("total")).alias("coverage"))


def values_for_share(df: DataFrame, col: str, share: float = 0.95) -> DataFrame:
    """Number of most frequent values needed to reach ``share`` of the rows:
    (#values whose cumulative share is <= share) + 1, as in the reference.

    Values are grouped by their count first: there are at most sqrt(2 * rows)
    distinct counts, and the running sum runs over those, not over values.
    Inside a group of m values with the same count c, the cumulative share
    after j of them is (before + j * c) / total, so the number of them within
    ``share`` is found arithmetically, then checked against the same double
    comparison one step either way.
    """
    counts = value_counts(df, col)
    by_count = counts.groupBy("count").agg(F.count(F.lit(1)).alias("_m"))
    desc = Window.orderBy(F.desc("count")).rowsBetween(Window.unboundedPreceding, -1)
    g = by_count.select("count", "_m",
                        F.coalesce(F.sum(F.col("count") * F.col("_m")).over(desc), F.lit(0)).alias("_before"),
                        F.sum(F.col("count") * F.col("_m")).over(Window.partitionBy()).alias("_total"))
    c, m, before, total = F.col("count"), F.col("_m"), F.col("_before"), F.col("_total")
    within = lambda j: ((before + j * c) / total) <= F.lit(share)
    j0 = F.least(F.greatest(F.floor((F.lit(share) * total - before) / c).cast("long"), F.lit(0)), m)
    j1 = (F.when((j0 < m) & within(j0 + 1), j0 + 1)
          .when((j0 > 0) & ~within(j0), j0 - 1).otherwise(j0))
    return g.agg((F.sum(j1) + 1).cast("long").alias("n_values_for_share"),
                 F.sum("_m").cast("long").alias("n_values"))


def distinct_count(df: DataFrame, col: str, approx: bool = False, rsd: float = 0.01) -> DataFrame:
    """Number of distinct non-null values: exact, or HyperLogLog++ when
    ``approx`` (no shuffle of the values themselves, fixed-size sketches)."""
    agg = F.approx_count_distinct(col, rsd) if approx else F.count_distinct(col)
    return df.agg(agg.alias("n_distinct"))


def top_values(df: DataFrame, col: str, n: int = 5) -> DataFrame:
    """The ``n`` most frequent non-null values (ties: smaller value first)."""
    return value_counts(df, col).orderBy(F.desc("count"), F.asc(col)).limit(n)

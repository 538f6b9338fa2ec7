"""Summaries over metric tables (A12, A13, J5, U1): all inputs here are small
(one row per run x model x fold), but everything stays a DataFrame plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

METRIC_COLS = ("accuracy", "macro_f1", "weighted_f1", "pr_auc", "roc_auc")


def mean_metrics(metrics: DataFrame, by: list[str], cols=METRIC_COLS, digits: int = 4) -> DataFrame:
    """Mean of each metric per group, rounded."""
    return metrics.groupBy(*by).agg(*[F.round(F.avg(c), digits).alias(c) for c in cols])


def best_per_group(metrics: DataFrame, by: list[str], metric: str, tie_break: list[str]) -> DataFrame:
    """The row with the highest ``metric`` per group; ties go to the smallest
    ``tie_break`` values (a total order, so the pick is repeatable)."""
    w = Window.partitionBy(*by).orderBy(F.desc_nulls_last(metric), *[F.asc(c) for c in tie_break])
    return metrics.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def merge_summaries(key: str, parts: list[tuple[str, DataFrame]]) -> DataFrame:
    """Full outer merge of summaries on ``key``, other columns prefixed."""
    renamed = [df.select(F.col(key), *[F.col(c).alias(prefix + c) for c in df.columns if c != key])
               for prefix, df in parts]
    return reduce(lambda a, b: a.join(b, on=key, how="full_outer"), renamed)


def concat_results(frames: list[DataFrame]) -> DataFrame:
    """Concatenate result lists with differing columns (missing -> null)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)

"""Classification metrics as aggregates.

Everything derives from small aggregated frames:
* the confusion matrix ``(by..., actual, predicted, n)`` (M1) gives accuracy,
  per-class precision/recall/F1, macro and weighted F1 and the report (M2-M5);
* AP and ROC-AUC (M6, M7) come from ``groupBy(by..., score)`` sums with prefix
  sums in descending score order over a range shuffle by (by, score): totals of
  each range -> offsets (one row per group and range), then windows *inside*
  ranges. No window ever orders all rows of a group in one task.

Nulls: a null label or predicted value is a class of its own in the confusion
matrix, a null group is a group. A score that is null or NaN is lower than
every other score and never reaches a threshold, in every operator; its row is
counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apsight.operators.joins import bounded_broadcast, null_safe_join
from apsight.session import ensure_checkpoint_dir

MAX_LABELS = 1000  # a guard that raises: a confusion matrix lists every pair


def usable_score(score: str) -> Column:
    """The score as a double, null where it is null or NaN."""
    x = F.col(score).cast("double")
    return F.when(~F.isnan(x), x)


def _labels(df: DataFrame, cols: list[str]) -> list:
    vals = set()
    for c in cols:
        rows = df.select(c).distinct().limit(MAX_LABELS + 1).collect()
        vals |= {r[0] for r in rows}
    if len(vals) > MAX_LABELS:
        raise ValueError("too many distinct labels for a confusion matrix")
    return sorted((v for v in vals if v is not None), key=lambda v: (str(type(v)), v)) + [None] * (None in vals)


def confusion(df: DataFrame, actual: str, predicted: str, by: list[str] | None = None,
              labels: list | None = None) -> DataFrame:
    """Long confusion matrix with zero cells: ``(by..., actual, predicted, n)``.

    ``labels`` defaults to the sorted union of actual and predicted values, null
    last if it occurs (a bounded list). Zero cells come from exploding the label pairs on the
    distinct groups, not from a join of data with data.
    """
    by = by or []
    labels = labels if labels is not None else _labels(df, [actual, predicted])
    counts = df.groupBy(*by, actual, predicted).agg(F.count(F.lit(1)).alias("n"))
    kinds = counts.schema[actual].dataType, counts.schema[predicted].dataType
    pairs = F.array(*[F.struct(F.lit(a).cast(kinds[0]).alias("a"), F.lit(p).cast(kinds[1]).alias("p")) for a in labels for p in labels])
    groups = counts.select(*by).distinct() if by else df.sparkSession.range(1).select()
    grid = groups.select(*by, F.explode(pairs).alias("_pair")).select(
        *by, F.col("_pair.a").alias(actual), F.col("_pair.p").alias(predicted))
    side, _ = bounded_broadcast(counts.withColumnRenamed("n", "_n"))
    keys = [*by, actual, predicted]
    j = grid.join(side, [grid[k].eqNullSafe(side[k]) for k in keys], "left")
    return j.select(*[grid[k] for k in keys], F.coalesce(F.col("_n"), F.lit(0)).cast("long").alias("n"))


def class_stats(conf: DataFrame, actual: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """Per class: tp, fp, fn, support, predicted count, precision, recall, f1
    (0 where undefined) and ``present`` (in actual or predicted)."""
    by = by or []
    hit = F.when(F.col(actual).eqNullSafe(F.col(predicted)), F.col("n"))
    as_actual = conf.select(*by, F.col(actual).alias("cls"), F.col("n").alias("support"), hit.alias("tp"), F.lit(0).cast("long").alias("n_pred"))
    as_predicted = conf.select(*by, F.col(predicted).alias("cls"), F.lit(0).cast("long").alias("support"), F.lit(0).cast("long").alias("tp"),
                               F.col("n").alias("n_pred"))
    s = as_actual.unionByName(as_predicted).groupBy(*by, "cls").agg(*[F.sum(c).alias(c) for c in ("support", "tp", "n_pred")])
    tp = F.coalesce("tp", F.lit(0))
    sup = F.coalesce("support", F.lit(0))
    npred = F.coalesce("n_pred", F.lit(0))
    fp, fn = npred - tp, sup - tp
    return s.select(*by, "cls", tp.cast("long").alias("tp"), fp.cast("long").alias("fp"),
                    fn.cast("long").alias("fn"), sup.cast("long").alias("support"),
                    npred.cast("long").alias("n_pred"),
                    F.coalesce(F.try_divide(tp, npred), F.lit(0.0)).alias("precision"),
                    F.coalesce(F.try_divide(tp, sup), F.lit(0.0)).alias("recall"),
                    F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1"),
                    ((sup + npred) > 0).alias("present"))


def summary(conf: DataFrame, actual: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """(by..., n, accuracy, macro_f1, weighted_f1). Macro F1 averages classes
    present in actual or predicted values."""
    by = by or []
    cs = class_stats(conf, actual, predicted, by).where("present")
    return cs.groupBy(*by).agg(
        F.sum("support").cast("long").alias("n"),
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        F.avg("f1").alias("macro_f1"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"))


def report(conf: DataFrame, actual: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """Classification report rows ``(by..., class, precision, recall, f1, support)``:
    one per class, then 'accuracy' (its value in all four columns, as the
    reference's CSV shows), 'macro avg' and 'weighted avg'."""
    by = by or []
    cs = class_stats(conf, actual, predicted, by).where("present")
    per = cs.select(*by, F.col("cls").cast("string").alias("class"), "precision", "recall", "f1",
                    F.col("support").cast("double").alias("support"))
    g = cs.groupBy(*by)
    acc = g.agg((F.sum("tp") / F.sum("support")).alias("v")).select(
        *by, F.lit("accuracy").alias("class"), *[F.col("v").alias(c) for c in ("precision", "recall", "f1", "support")])
    macro = g.agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"),
                  F.avg("f1").alias("f1"), F.sum("support").cast("double").alias("support")).select(
        *by, F.lit("macro avg").alias("class"), "precision", "recall", "f1", "support")
    wsum = lambda c: F.sum(F.col(c) * F.col("support")) / F.sum("support")
    weighted = g.agg(wsum("precision").alias("precision"), wsum("recall").alias("recall"),
                     wsum("f1").alias("f1"), F.sum("support").cast("double").alias("support")).select(
        *by, F.lit("weighted avg").alias("class"), "precision", "recall", "f1", "support")
    return per.unionByName(acc).unionByName(macro).unionByName(weighted)


# ------------------------------------------------------------ ranking metrics

def score_groups(df: DataFrame, y: str, score: str, by: list[str] | None = None) -> DataFrame:
    """(by..., score, pos, neg) — ties collapse into one row; unusable scores form the row with a null score.
    Rows without a label carry no evidence for a ranking and count in neither."""
    by = by or []
    return df.groupBy(*by, usable_score(score).alias("score")).agg(
        F.coalesce(F.sum(F.col(y).cast("long")), F.lit(0)).alias("pos"),
        F.coalesce(F.sum((1 - F.col(y)).cast("long")), F.lit(0)).alias("neg"))


def ranked_groups(df: DataFrame, y: str, score: str, by: list[str] | None = None) -> DataFrame:
    """``score_groups`` in ranges of (by, descending score), checkpointed, with the range's number ``_piece``.

    Ranges are the partitions of one range shuffle, so their number grows with
    the data and none holds more than its share of a group, however large.
    Pieces are numbered by partition: the checkpoint fixes them for all readers.
    """
    by = by or []
    ensure_checkpoint_dir(df.sparkSession)
    ordered = score_groups(df, y, score, by).repartitionByRange(*[F.asc(b) for b in by], F.desc_nulls_last("score"))
    return ordered.withColumn("_piece", F.spark_partition_id()).checkpoint(eager=True)


def _prefix(g: DataFrame, by: list[str]) -> DataFrame:
    """Add inclusive cumulative ``cum_pos`` and ``cum_cnt`` in descending score order, null scores last, to
    ``ranked_groups``: sums inside each piece and, before it, the totals of its group's earlier pieces."""
    tot = g.groupBy(*by, "_piece").agg(F.sum("pos").alias("_bp"), F.sum(F.col("pos") + F.col("neg")).alias("_bc"))
    ow = Window.partitionBy(*by).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)  # a row per shuffle partition
    offs = tot.select(*by, "_piece", F.coalesce(F.sum("_bp").over(ow), F.lit(0)).alias("_op"),
                      F.coalesce(F.sum("_bc").over(ow), F.lit(0)).alias("_oc"))
    j = null_safe_join(g, offs, [*by, "_piece"])
    w = Window.partitionBy(*by, "_piece").orderBy(F.desc_nulls_last("score")).rowsBetween(Window.unboundedPreceding, 0)
    return j.select(*g.columns, (F.col("_op") + F.sum("pos").over(w)).alias("cum_pos"),
                    (F.col("_oc") + F.sum(F.col("pos") + F.col("neg")).over(w)).alias("cum_cnt"))


def binary_confusion_from_groups(g: DataFrame, threshold, by: list[str] | None = None,
                                 actual: str = "y", predicted: str = "pred") -> DataFrame:
    """2 x 2 confusion ``(by..., actual, predicted, n)`` at ``score >= threshold``
    from score groups (see ``score_groups``): conditional sums, no second scan.
    ``threshold`` is a number, or a frame ``(by..., threshold)`` with one
    threshold per group."""
    by = by or []
    if isinstance(threshold, DataFrame):
        g = null_safe_join(g, threshold.select(*by, F.col("threshold").alias("_thr")), by)
        hit = F.coalesce(F.col("score") >= F.col("_thr"), F.lit(False))
    else:
        hit = F.coalesce(F.col("score") >= F.lit(float(threshold)), F.lit(False))
    c = g.groupBy(*by).agg(
        F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("_tp"),
        F.sum(F.when(hit, F.col("neg")).otherwise(0)).alias("_fp"),
        F.sum(F.when(~hit, F.col("pos")).otherwise(0)).alias("_fn"),
        F.sum(F.when(~hit, F.col("neg")).otherwise(0)).alias("_tn"))
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(p).alias("p"), F.col(n).alias("n"))
                      for a, p, n in ((1, 1, "_tp"), (0, 1, "_fp"), (1, 0, "_fn"), (0, 0, "_tn"))])
    return c.select(*by, F.explode(cells).alias("_c")).select(
        *by, F.col("_c.a").alias(actual), F.col("_c.p").alias(predicted), F.col("_c.n").cast("long").alias("n"))


def rank_metrics(df: DataFrame, y: str, score: str, by: list[str] | None = None, digits: int = 9,
                 groups: DataFrame | None = None) -> DataFrame:
    """(by..., pr_auc, roc_auc). AP = sum over distinct scores of
    (R_i - R_{i-1}) * P_i; ROC-AUC counts ties as half. Both are null unless the
    labels hold both classes (0 and 1). ``groups`` reuses a ``ranked_groups`` frame."""
    by = by or []
    p = _prefix(groups if groups is not None else ranked_groups(df, y, score, by), by)
    above = F.col("cum_pos") - F.col("pos")
    auc_term = F.col("neg").cast("decimal(38,0)") * (2 * above + F.col("pos")).cast("decimal(38,0)")
    agg = p.groupBy(*by).agg(
        F.sum("pos").alias("_P"), F.sum("neg").alias("_N"),
        F.sum(F.try_divide(F.col("pos") * F.col("cum_pos"), F.col("cum_cnt"))).alias("_ap"),
        F.sum(auc_term).alias("_auc"))
    ok = (F.col("_P") > 0) & (F.col("_N") > 0)
    pr = F.when(ok, F.round(F.col("_ap") / F.col("_P"), digits))
    roc = F.when(ok, F.col("_auc").cast("double") / (F.lit(2.0) * F.col("_P").cast("double") * F.col("_N").cast("double")))
    return agg.select(*by, pr.alias("pr_auc"), roc.alias("roc_auc"))


# --------------------------------------------------------------- diagnostics

def score_bands(df: DataFrame, score: str, by: list[str] | None = None,
                low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Shares of scores below ``low``, between, and above ``high``."""
    by = by or []
    n = F.count(F.lit(1))
    return df.groupBy(*by).agg(
        (F.count_if(F.col(score) < low) / n).alias("share_low"),
        (F.count_if((F.col(score) >= low) & (F.col(score) <= high)) / n).alias("share_mid"),
        (F.count_if(F.col(score) > high) / n).alias("share_high"))


def score_histogram(df: DataFrame, y: str, score: str, by: list[str] | None = None, bins: int = 100) -> DataFrame:
    """Per group and label: ``bins`` equal-width bins over that label's own
    observed score range (as a per-label histogram does), count and density =
    count / (n_label * width). Bin numbers are 1-based; a value is placed as
    NumPy's uniform-bin histogram places it: floor((x - lo) * bins / (hi - lo)),
    moved by one where that disagrees with the edges lo + i * width, and the
    maximum falls in the last bin."""
    by = by or []
    keys = [*by, y]
    rng = df.groupBy(*keys).agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
    side, _ = bounded_broadcast(rng)
    j = df.join(side, keys)
    lo, hi, x = F.col("_lo"), F.col("_hi"), F.col(score)
    width = (hi - lo) / F.lit(float(bins))
    edge = lambda i: i.cast("double") * width + lo
    i0 = F.least(F.greatest(F.floor((x - lo) * F.try_divide(F.lit(float(bins)), hi - lo)), F.lit(0)), F.lit(bins - 1))
    i1 = F.when(x < edge(i0), i0 - 1).when((x >= edge(i0 + 1)) & (i0 != bins - 1), i0 + 1).otherwise(i0)
    b = F.when(hi == lo, F.lit(1)).otherwise(i1 + 1)
    h = j.groupBy(*by, F.col(y).alias("label"), b.cast("int").alias("bin"), "_lo", "_hi").agg(
        F.count(F.lit(1)).alias("count"))
    n_label = F.sum("count").over(Window.partitionBy(*by, "label"))
    w = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    return h.select(*by, "label", "bin", "count",
                    (F.col("count") / (n_label * F.when(w > 0, w).otherwise(F.lit(1.0)))).alias("density"))


def pairwise_agreement(df: DataFrame, pred_cols: list[str]) -> DataFrame:
    """Share of rows on which each pair of prediction columns agrees (one pass)."""
    pairs = [(a, b) for i, a in enumerate(pred_cols) for b in pred_cols[i + 1:]]
    agg = df.agg(*[F.avg((F.col(a) == F.col(b)).cast("int")).alias(f"{a}__{b}") for a, b in pairs])
    stacked = F.explode(F.array(*[F.struct(F.lit(a).alias("model_a"), F.lit(b).alias("model_b"),
                                           F.col(f"{a}__{b}").alias("agreement")) for a, b in pairs]))
    return agg.select(stacked.alias("_p")).select("_p.*")


def predict_at(score: Column, threshold: float) -> Column:
    return predict_at_column(score, F.lit(float(threshold)))


def predict_at_column(score: Column, threshold: Column) -> Column:
    x = score.cast("double")
    return F.coalesce((x >= threshold) & ~F.isnan(x), F.lit(False)).cast("int")

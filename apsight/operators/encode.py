"""Feature encoding.

Encoders are *fitted* on training rows only, as small per-category tables
(one row per category, or per category and cross-fit fold), and *applied* by a
join whose build side is counted before it is broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from apsight.functions.hashing import hash32
from apsight.operators.joins import bounded_broadcast

INFREQUENT = "__infrequent__"


# ----------------------------------------------------------- labels and weights

def index_labels(df: DataFrame, label: str, out: str = "label_idx") -> DataFrame:
    """Text labels -> 0-based codes in alphabetical order (repeatable ids)."""
    from pyspark.ml.feature import StringIndexer
    idx = StringIndexer(inputCol=label, outputCol=out, stringOrderType="alphabetAsc",
                        handleInvalid="keep").fit(df)
    return idx.transform(df)


def balanced_class_weights(train: DataFrame, label: str) -> DataFrame:
    """(label, n_c, weight) with weight = n / (k * n_c), computed on train rows."""
    g = train.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    allw = Window.partitionBy()  # one row per class: a tiny frame
    return g.select(label, "n_c",
                    (F.sum("n_c").over(allw) / (F.count(F.lit(1)).over(allw) * F.col("n_c"))).alias("weight"))


def class_balance(train: DataFrame, label: str) -> DataFrame:
    """Positives, negatives, positive share and the neg/pos ratio (boosting weight)."""
    return train.agg(
        F.count_if(F.col(label) == 1).alias("n_pos"), F.count_if(F.col(label) == 0).alias("n_neg"),
        (F.count_if(F.col(label) == 1) / F.count(F.lit(1))).alias("pos_share"),
        (F.count_if(F.col(label) == 0) / F.count_if(F.col(label) == 1)).alias("neg_pos_ratio"))


def with_weights(df: DataFrame, label: str, weights, out: str = "weight") -> DataFrame:
    """Attach a weight column from a small ``(label, weight)`` frame or a dict
    ``{label: weight}``."""
    if isinstance(weights, dict):
        expr = None
        for k, v in weights.items():
            expr = (F.when(F.col(label) == k, F.lit(float(v))) if expr is None
                    else expr.when(F.col(label) == k, F.lit(float(v))))
        return df.withColumn(out, expr.otherwise(F.lit(1.0)))
    side, _ = bounded_broadcast(weights.select(F.col(label).alias("_wl"), F.col("weight").alias("_w")))
    return df.join(side, df[label] == side["_wl"], "left").select(
        *[df[c] for c in df.columns], F.coalesce("_w", F.lit(1.0)).alias(out))


# ----------------------------------------------------------- capped one-hot (F1)

def ohe_vocabulary(train: DataFrame, col: str, max_categories: int) -> DataFrame:
    """Per train value: (value, count, kept). When the number of values reaches
    ``max_categories`` only the ``max_categories - 1`` most frequent values are
    kept (among equal counts the alphabetically later one); the rest share the
    infrequent column. Nulls are not values (filtered upstream).

    The kept list is a distributed top-k of at most ``max_categories - 1`` rows,
    broadcast back onto the per-value counts; no window ranks all values.
    """
    counts = train.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("count"))
    n_values = counts.count()
    if n_values < max_categories:
        return counts.select(F.col(col).alias("value"), "count", F.lit(True).alias("kept"))
    top = counts.orderBy(F.desc("count"), F.desc(col)).limit(max_categories - 1).select(F.col(col).alias("_kept"))
    side, _ = bounded_broadcast(top, known_rows=max_categories - 1)
    j = counts.join(side, counts[col] == side["_kept"], "left")
    return j.select(F.col(col).alias("value"), "count", F.col("_kept").isNotNull().alias("kept"))


def ohe_bucket(df: DataFrame, col: str, vocab: DataFrame, out: str = "bucket") -> DataFrame:
    """Value -> itself when kept, else the infrequent bucket (if one exists);
    unseen values with no infrequent bucket get null (an all-zero row)."""
    has_infrequent = vocab.where(~F.col("kept")).limit(1).count() > 0
    side, _ = bounded_broadcast(vocab.where("kept").select(F.col("value").alias("_kv")))
    j = df.join(side, df[col] == side["_kv"], "left")
    bucket = F.when(F.col("_kv").isNotNull(), F.col(col))
    if has_infrequent:
        bucket = bucket.otherwise(F.lit(INFREQUENT))
    return j.select(*[df[c] for c in df.columns], bucket.alias(out))


def ohe_stages(col: str, vocab: DataFrame, out: str):
    """Spark ML stages for the bucketed column: StringIndexer + OneHotEncoder
    (alphabetical ids, no dropped column). The bucketing itself is
    ``ohe_bucket``, applied before the pipeline."""
    from pyspark.ml.feature import OneHotEncoder, StringIndexer
    return [StringIndexer(inputCol=col, outputCol=f"{out}_idx", stringOrderType="alphabetAsc",
                          handleInvalid="keep"),
            OneHotEncoder(inputCol=f"{out}_idx", outputCol=out, dropLast=True)]


# ------------------------------------------------------- target encoding

def cross_fit_fold(df: DataFrame, key: str, k: int = 5, seed=42, out: str = "cf_fold") -> DataFrame:
    return df.withColumn(out, F.pmod(hash32(F.col(key), f"cf{seed}"), F.lit(k)).cast("int"))


def smoothed(n, s, n_all, s_all):
    """lambda * mean_c + (1 - lambda) * mean with lambda = n*tau2 / (var_c + n*tau2),
    tau2 and var_c population variances of a 0/1 target (p * (1 - p))."""
    mean_c = s / n
    mean = s_all / n_all
    var_c = mean_c * (1 - mean_c)
    tau2 = mean * (1 - mean)
    lam = (n * tau2) / (var_c + n * tau2)
    return F.when(n.isNull() | (n == 0), mean).when(var_c + n * tau2 == 0, mean_c) \
        .otherwise(lam * mean_c + (1 - lam) * mean)


def _targets(y) -> dict:
    """Normalise ``y`` to {output suffix: 0/1 column}."""
    if isinstance(y, str):
        return {"": F.col(y)}
    return dict(y)


def target_encoding_table(train: DataFrame, col: str, y, prefix: str = "te") -> tuple[DataFrame, dict]:
    """Full-train encoding table ``(_tv, <prefix><suffix>...)`` for one or more
    0/1 targets (one aggregate for all of them) and the overall means.

    ``y`` is a column name, or a dict {suffix: 0/1 column expression}.
    """
    tg = _targets(y)
    per = train.groupBy(F.col(col).alias("_tv")).agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(c.cast("long")).alias(f"_s{i}") for i, c in enumerate(tg.values())])
    tot = per.agg(F.sum("_n").alias("_N"), *[F.sum(f"_s{i}").alias(f"_S{i}") for i in range(len(tg))]).first()
    n_all = F.lit(tot["_N"])
    table = per.select("_tv", *[smoothed(F.col("_n"), F.col(f"_s{i}"), n_all, F.lit(tot[f"_S{i}"])).alias(prefix + k)
                                for i, k in enumerate(tg)])
    means = {prefix + k: (tot[f"_S{i}"] / tot["_N"] if tot["_N"] else None) for i, k in enumerate(tg)}
    return table, means


def target_encode_apply(df: DataFrame, train: DataFrame, col: str, y, out: str) -> DataFrame:
    """Encode ``df`` (e.g. test rows) with statistics of all training rows;
    unseen values get the overall mean. ``y`` as in ``target_encoding_table``
    (then ``out`` is the prefix of the output columns)."""
    table, means = target_encoding_table(train, col, y, out)
    side, _ = bounded_broadcast(table)
    j = df.join(side, df[col] == side["_tv"], "left")
    return j.select(*[df[c] for c in df.columns if c not in means],
                    *[F.coalesce(F.col(o), F.lit(m).cast("double")).alias(o) for o, m in means.items()])


def crossfit_table(stats: DataFrame, col: str, y, prefix: str = "te", fold: str = "cf_fold") -> DataFrame:
    """Out-of-fold encodings ``(_tv, _tf, <prefix><suffix>...)``: for rows in
    fold f, statistics of the other folds, obtained by subtracting the fold's
    sums from the totals (one aggregate for all folds and targets)."""
    tg = _targets(y)
    k = len(tg)
    pf = stats.groupBy(F.col(col).alias("_tv"), F.col(fold).alias("_tf")).agg(
        F.count(F.lit(1)).alias("_n_vf"), *[F.sum(c.cast("long")).alias(f"_s_vf{i}") for i, c in enumerate(tg.values())])
    by_v = Window.partitionBy("_tv")
    allw = Window.partitionBy()
    # windows run over (value x fold) rows: bounded by #categories * k folds
    t = pf.select("_tv", "_tf", (F.sum("_n_vf").over(by_v) - F.col("_n_vf")).alias("_n"),
                  *[(F.sum(f"_s_vf{i}").over(by_v) - F.col(f"_s_vf{i}")).alias(f"_s{i}") for i in range(k)])
    fold_tot = pf.groupBy("_tf").agg(F.sum("_n_vf").alias("_nf"), *[F.sum(f"_s_vf{i}").alias(f"_sf{i}") for i in range(k)])
    fold_tot = fold_tot.select("_tf", (F.sum("_nf").over(allw) - F.col("_nf")).alias("_tot_n"),
                               *[(F.sum(f"_sf{i}").over(allw) - F.col(f"_sf{i}")).alias(f"_tot_s{i}") for i in range(k)])
    return t.join(fold_tot, "_tf").select(
        "_tv", "_tf", *[smoothed(F.col("_n"), F.col(f"_s{i}"), F.col("_tot_n"), F.col(f"_tot_s{i}")).alias(prefix + name)
                        for i, name in enumerate(tg)])


def target_encode_crossfit(train: DataFrame, col: str, y, out: str, fold: str = "cf_fold",
                           stats: DataFrame | None = None) -> DataFrame:
    """Out-of-fold encoding of training rows (see ``crossfit_table``). ``stats``
    is the frame the statistics come from (default: ``train`` itself); pass the
    un-joined base frame when encoding several features one after another so
    the plan stays linear."""
    table = crossfit_table(stats if stats is not None else train, col, y, out, fold)
    outs = [c for c in table.columns if c not in ("_tv", "_tf")]
    side, _ = bounded_broadcast(table)
    j = train.join(side, (train[col] == side["_tv"]) & (train[fold] == side["_tf"]), "left")
    return j.select(*[train[c] for c in train.columns if c not in outs], *outs)


def target_encode_multiclass(df: DataFrame, train: DataFrame, col: str, label: str,
                             classes: list, prefix: str) -> DataFrame:
    """One encoding column per class (class indicator as target), fitted on
    train with one aggregate: ``<prefix>_<class>``."""
    tg = {f"_{c}": (F.col(label) == F.lit(c)).cast("int") for c in classes}
    return target_encode_apply(df, train, col, tg, prefix)


# ------------------------------------------------------------------- scaling

def scale_by_std(df: DataFrame, train: DataFrame, cols: list[str], suffix: str = "_scaled") -> DataFrame:
    """Divide by the population standard deviation on train (no centring).
    A zero deviation leaves the column unchanged (scale 1)."""
    stds = train.agg(*[F.stddev_pop(c).alias(c) for c in cols]).first()
    out = df
    for c in cols:
        s = stds[c] if stds[c] else 1.0
        out = out.withColumn(f"{c}{suffix}", F.col(c) / F.lit(float(s)))
    return out

"""All folds of an experiment encoded in one pass (E1, E2, E3; F1-F7).

A *run* is one fold of one split; every row stands once in each run, as train,
val or test row. All encoders of all runs come from one aggregate per feature
over (run, variant, value, inner fold): out-of-fold statistics by subtracting an
inner fold from its run, whole-training statistics and one-hot vocabularies by
summing over the inner folds. The encoded rows are written once, partitioned by
run, so the modelling frame is read a fixed number of times, whatever the folds.

Variants: ``full`` learns from all training rows of a run, ``fit`` from those
that are no validation rows (where thresholds are tuned).
"""

from __future__ import annotations

import uuid

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apsight.operators import encode, splits
from apsight.operators.joins import bounded_broadcast, null_safe_join
from apsight.session import scratch_path

RUN = ["run", "variant"]
#: Rows of an encoding table (a run, value and inner fold each) that is broadcast, or hashed a partition at a time.
BROADCAST_ROWS, HASHED_ROWS = 100_000, 20_000_000


def runs(d: DataFrame, cfg) -> DataFrame:
    """``d`` once per run: columns cf (inner fold of a row), run (``<split>_<fold>``) and role (train, val, test)."""
    parts = []
    d = encode.cross_fit_fold(d, cfg.key, 5, cfg.seed, "cf")  # once a row, not once a run
    for mode in cfg.split_modes:
        if mode == "random":
            hold = splits.plain_holdout(d, cfg.key, 0.2, cfg.seed) if cfg.random_split == "plain" else \
                splits.stratified_holdout(d, "label", cfg.key, 0.2, cfg.seed)
            role = F.when(F.col("is_test"), "test").otherwise("train")
            parts.append(hold.select(*d.columns, F.lit("random_1").alias("run"), role.alias("role")))
        elif mode == "state":
            clean = splits.clean_group_key(d, cfg.state, "_grp")
            if cfg.min_group_rows:
                clean = splits.small_group_filter(clean, "_grp", cfg.min_group_rows)
            fmap = state_folds(clean, cfg)
            k = fmap.agg(F.max("fold")).first()[0] + 1
            each = splits.assign_folds(clean, fmap, "_grp").select("*", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("_f"))
            role = F.when(F.col("fold") == F.col("_f"), "test").otherwise("train")
            parts.append(each.select(*d.columns, F.concat(F.lit("state_"), F.col("_f") + 1).alias("run"), role.alias("role")))
        else:
            raise ValueError(f"unknown split mode {mode!r}")
    x = parts[0]
    for p in parts[1:]:
        x = x.unionByName(p)
    if cfg.train_cap is not None and "state" in cfg.split_modes:  # the cap holds for state folds; a run of fewer rows keeps them all
        capped = x.where("role = 'train' and run like 'state%'")
        inside = splits.mark_first_n(capped, ["run"], cfg.key, f"sample{cfg.seed}", lambda n: min(n, cfg.train_cap))
        x = x.where("not (role = 'train' and run like 'state%')").unionByName(inside.where("_in").drop("_in"))
    if cfg.threshold_mode:
        train = x.where("role = 'train'")
        if cfg.random_split == "plain":
            marked = splits.plain_holdout(train, cfg.key, 0.1, cfg.seed + 1, "_val")
        else:
            marked = splits.mark_first_n(train, ["run", "label"], cfg.key, f"strat{cfg.seed + 1}", lambda n: splits.test_count(n, 0.1), "_val")
        marked = marked.withColumn("role", F.when(F.col("_val"), "val").otherwise("train")).drop("_val")
        x = x.where("role = 'test'").unionByName(marked)
    return x


def state_folds(clean: DataFrame, cfg) -> DataFrame:
    """(group, fold): stratified, or plain group folds where there are too few groups for them; or shuffled."""
    if cfg.state_folds == "shuffled":
        return splits.shuffled_group_folds(clean, "_grp", cfg.n_state_folds, cfg.seed)
    if cfg.state_folds == "group_kfold":
        return splits.group_kfold(clean, "_grp", cfg.n_state_folds)
    return splits.stratified_group_folds(clean, "_grp", "label", cfg.n_state_folds)


def feature_stats(train: DataFrame, feature: str, targets: list[Column]) -> DataFrame:
    """(run, variant, value, cf, n, s0, s1, ...): the one aggregate that all encoders of a feature come from."""
    return train.groupBy(*RUN, F.col(feature).alias("value"), "cf").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(t.cast("long")).alias(f"s{i}") for i, t in enumerate(targets)])


def target_tables(stats: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """Encodings (run, variant, value, cf, <names>) and overall means (run, variant, <names>).

    ``cf`` is the inner fold whose rows the encoding is for (statistics of the
    others), or -1 for rows that are not trained on (statistics of all).
    """
    sums = ["n", *[f"s{i}" for i in range(len(names))]]
    every = Window.partitionBy(*RUN, "value")  # an inner fold a row
    out_of = stats.select(*RUN, "value", "cf", *[(F.sum(c).over(every) - F.col(c)).alias(c) for c in sums])
    whole = stats.groupBy(*RUN, "value").agg(*[F.sum(c).alias(c) for c in sums]).select(*RUN, "value", F.lit(-1).alias("cf"), *sums)
    per = stats.groupBy(*RUN, "cf").agg(*[F.sum(c).alias(f"all_{c}") for c in sums])  # runs x inner folds
    run_of = Window.partitionBy(*RUN)
    rest = per.select(*RUN, "cf", *[(F.sum(f"all_{c}").over(run_of) - F.col(f"all_{c}")).alias(f"all_{c}") for c in sums])
    total = per.groupBy(*RUN).agg(*[F.sum(f"all_{c}").alias(f"all_{c}") for c in sums])
    totals = rest.unionByName(total.select(*RUN, F.lit(-1).alias("cf"), *[f"all_{c}" for c in sums]))
    smoothed = [encode.smoothed(F.col("n"), F.col(f"s{i}"), F.col("all_n"), F.col(f"all_s{i}")).alias(name) for i, name in enumerate(names)]
    table = out_of.unionByName(whole).join(totals, [*RUN, "cf"]).select(*RUN, "value", "cf", *smoothed)
    means = total.select(*RUN, *[(F.col(f"all_s{i}") / F.col("all_n")).alias(f"mean_{name}") for i, name in enumerate(names)])
    return table, means


def one_hot_index(stats: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(run, variant, value, place) of the training values and (run, variant, other): the place of infrequent values
    where there are any (then also that of unseen ones). Places follow the alphabet of the buckets."""
    counts = stats.groupBy(*RUN, "value").agg(F.sum("n").alias("n"))
    values = counts.groupBy(*RUN).agg(F.count(F.lit(1)).alias("n_values"))
    first = Window.partitionBy(*RUN).orderBy(F.desc("n"), F.desc("value"))
    top = counts.withColumn("rank", F.row_number().over(first)).where(F.col("rank") < most)  # limited within each task first
    all_kept = values.where(F.col("n_values") < most).select(*RUN)
    bucketed = values.where(F.col("n_values") >= most).select(*RUN, F.lit(encode.INFREQUENT).alias("bucket"))
    buckets = top.select(*RUN, F.col("value").alias("bucket")).unionByName(bucketed)
    placed = buckets.withColumn("place", (F.row_number().over(Window.partitionBy(*RUN).orderBy("bucket")) - 1).cast("double"))  # most rows a run
    other = placed.join(bucketed.select(*RUN), RUN, "left_semi").where(F.col("bucket") == encode.INFREQUENT).select(*RUN, F.col("place").alias("other"))
    other = other.unionByName(all_kept.select(*RUN, F.lit(None).cast("double").alias("other")))
    named = placed.select(*RUN, F.col("bucket").alias("value"), "place")
    return named, other


def sided(table: DataFrame, most: int) -> DataFrame:
    """The table side of a join, of ``most`` rows at most: sent to all tasks, or hashed in each partition rather than sorted
    together with the rows; the planner chooses above both bounds."""
    side, sent = bounded_broadcast(table, BROADCAST_ROWS, most)
    return side if sent or most > HASHED_ROWS else side.hint("shuffle_hash")


def encode_runs(x: DataFrame, cfg, classes: list, variants: tuple[str, ...]) -> DataFrame:
    """The encoded rows of all runs, written once: run, variant, role, key, label, features, weight (balanced within
    the run's training rows; 1 for others)."""
    spark = x.sparkSession
    in_variant = F.when((F.col("variant") == "full") & (F.col("role") == "val"), "train").otherwise(F.col("role"))
    xv = x.select("*", F.explode(F.array(*[F.lit(v) for v in variants])).alias("variant")).withColumn("role", in_variant)
    if "cf" not in x.columns:
        xv = encode.cross_fit_fold(xv, cfg.key, 5, cfg.seed, "cf")
    train = xv.where("role = 'train'")
    many = len(classes) > 2
    targets = [(F.col("label") == float(i)).cast("int") for i in range(len(classes))] if many else [F.col("label").cast("int")]
    rows = xv.withColumn("cf", F.when(F.col("role") == "train", F.col("cf")).otherwise(F.lit(-1)))
    cols: list[str] = []
    numeric = cfg.numeric_columns(x.drop("cf"))
    for feature in dict.fromkeys((cfg.vendor, cfg.state)):
        stats = feature_stats(train, feature, targets).checkpoint(eager=True)
        table, names = None, []
        if cfg.feature_mode in ("target_enc", "both"):
            names = [f"te_{feature}_{i}" for i in range(len(classes))] if many else [f"te_{feature}"]
            table, means = target_tables(stats, names)
        one_hot = feature == cfg.vendor and cfg.feature_mode in ("ohe", "both")
        if one_hot:
            named, other = one_hot_index(stats, cfg.ohe_max)
            table = named if table is None else null_safe_join(table, named, [*RUN, "value"], "left")
        if table is not None:  # all that a row takes from its value, in one join
            table = sided(table.withColumnRenamed("value", feature), 2 * stats.count())
            rows = null_safe_join(rows, table, [*RUN, feature, *(["cf"] if names else [])], "left")
        if one_hot:
            rows = rows.join(F.broadcast(other), RUN, "left")  # a row a run
            rows = rows.withColumn("ohe_place", F.coalesce("place", "other", F.lit(float(cfg.ohe_max)))).drop("place", "other")
            sizes = spark.range(cfg.ohe_max).select(F.col("id").cast("double").alias("ohe_place"))
            rows = OneHotEncoder(inputCol="ohe_place", outputCol="ohe_vendor", dropLast=True, handleInvalid="keep").fit(sizes).transform(rows)
            cols.append("ohe_vendor")
        if names:
            rows = rows.join(F.broadcast(means), RUN, "left")  # a row a run
            rows = rows.select(*[c for c in rows.columns if c not in names and not c.startswith("mean_te_")],
                               *[F.coalesce(c, f"mean_{c}").alias(c) for c in names])
            cols += names
    if cfg.scale_numeric and numeric:
        dev = train.groupBy(*RUN).agg(*[F.stddev_pop(c).alias(f"dev_{c}") for c in numeric])
        rows = rows.join(F.broadcast(dev), RUN, "left")  # a row a run
        for c in numeric:
            rows = rows.withColumn(c, F.col(c) / F.when(F.col(f"dev_{c}") > 0, F.col(f"dev_{c}")).otherwise(1.0))
    per = train.groupBy(*RUN, "label").agg(F.count(F.lit(1)).alias("n_c"))  # a row per run and class
    of = Window.partitionBy(*RUN)
    weights = per.select(*RUN, "label", (F.sum("n_c").over(of) / (F.count(F.lit(1)).over(of) * F.col("n_c"))).alias("weight"))
    rows = rows.join(F.broadcast(weights), [*RUN, "label"], "left")
    rows = VectorAssembler(inputCols=[*cols, *numeric], outputCol="features", handleInvalid="keep").transform(rows)
    weight = F.when(F.col("role") == "train", F.col("weight")).otherwise(1.0)
    path = scratch_path(spark, f"encoded-{uuid.uuid4().hex[:12]}")
    rows.select(*RUN, "role", cfg.key, "label", "features", weight.alias("weight")).write.partitionBy(*RUN, "role").parquet(path)
    return spark.read.parquet(path)

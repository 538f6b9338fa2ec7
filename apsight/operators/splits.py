"""Repeatable samples, holdouts and fold assignments.

Randomness is replaced by a per-row hash of a unique key, so every split is a
pure function of the data and a seed.

Exact "first n by hash" per group (fixed-size sample, stratified holdout) is
found without sorting a group in one task: counts per (group, hash bucket) are
refined over up to three levels of 4096 buckets; only those bounded histograms
reach the driver, and the last, small candidate set is ranked with a window.
Membership is then a broadcast-join filter against one cut row per group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from apsight.functions.hashing import HASH_SPACE, hash32
from apsight.operators.joins import bounded_broadcast
from apsight.operators.ranks import global_rank

BUCKETS = 4096
FINAL_RANK_ROWS = 200_000
MAX_GROUPS = 10_000
#: Largest groups that are assigned to folds one by one on the driver; all others are dealt out by rank.
HEAVY_GROUPS = 10_000


def _null_safe_on(left: DataFrame, right: DataFrame, cols: list[str]) -> Column:
    cond = F.lit(True)
    for c in cols:
        cond = cond & left[c].eqNullSafe(right[c])
    return cond


def first_n_cut(df: DataFrame, group_cols: list[str], key: str, salt, targets) -> DataFrame:
    """Cut rows ``(group..., _cut_h, _cut_key, _take)``: a row of group g is among
    the first ``targets[g]`` rows ordered by (hash, key) iff
    ``(h, key) <= (_cut_h, _cut_key)``; ``_take`` marks groups taking any row.

    ``targets`` maps a tuple of group values to a row count (bounded by the
    number of groups, e.g. classes), or is a function of the group size (then
    the sizes come from the first histogram, saving a scan). Per level, Spark counts rows per (group,
    bucket) of the still-open hash range and finds, with a cumulative window over
    the <= 4096 buckets of each group, the bucket where the count crosses the
    target: one row per group reaches the driver.
    """
    spark: SparkSession = df.sparkSession
    base = df.select(*group_cols, F.col(key).alias("_key"), hash32(F.col(key), salt).alias("_h"))
    gschema = [T.StructField(c, f.dataType) for c in group_cols for f in df.schema.fields if f.name == c]
    if callable(targets):
        # targets depend on the group sizes: read the sizes off the first-level
        # histogram (a small persisted frame) instead of scanning once more
        targets, state, first = _first_level(spark, base, group_cols, gschema, targets)
    else:
        state, first = {g: (0, HASH_SPACE, n) for g, n in targets.items() if n > 0}, None
    if len(targets) > MAX_GROUPS:
        raise ValueError("too many groups for a per-group cut")
    done: dict[tuple, tuple] = {}
    for level in range(3):
        if level == 0 and first is not None:
            state, final, whole = first
            for g in whole:
                done[g] = (HASH_SPACE, None)
            if final:
                done.update(_rank_inside(spark, base, group_cols, gschema, final))
            continue
        if not state:
            break
        width = {g: max(1, (hi - lo + BUCKETS - 1) // BUCKETS) for g, (lo, hi, _) in state.items()}
        srows = [(*g, lo, hi, width[g], need) for g, (lo, hi, need) in state.items()]
        sdf = spark.createDataFrame(srows, T.StructType(gschema + [
            T.StructField("_lo", T.LongType()), T.StructField("_hi", T.LongType()),
            T.StructField("_w", T.LongType()), T.StructField("_need", T.LongType())]))
        side, _ = bounded_broadcast(sdf, known_rows=len(srows))
        j = base.join(side, _null_safe_on(base, side, group_cols), "inner")
        j = j.where((F.col("_h") >= F.col("_lo")) & (F.col("_h") < F.col("_hi")))
        gcols = [base[c] for c in group_cols]
        hist = j.groupBy(*gcols, "_lo", "_w", "_need",
                         ((F.col("_h") - F.col("_lo")) / F.col("_w")).cast("long").alias("_b")).agg(
            F.count(F.lit(1)).alias("_n"))
        cross = _crossings(hist, group_cols)
        found = {}
        for r in cross:
            g = tuple(r[c] for c in group_cols)
            blo = r["_lo"] + r["_b"] * r["_w"]
            found[g] = (blo, min(state[g][1], blo + r["_w"]), r["_need"] - (r["_cum"] - r["_n"]), r["_n"])
        for g in state:
            if g not in found:  # fewer rows than asked: the whole group is taken
                done[g] = (HASH_SPACE, None)
        state, final = {}, {}
        for g, (lo, hi, need, n) in found.items():
            if n <= FINAL_RANK_ROWS or hi - lo <= 1:
                final[g] = (lo, hi, need)
            else:
                state[g] = (lo, hi, need)
        if final:
            done.update(_rank_inside(spark, base, group_cols, gschema, final))
    if state:  # not narrowed enough after three levels (pathological): rank what is left
        done.update(_rank_inside(spark, base, group_cols, gschema, state))
    rows = [(*g, h, k, True) for g, (h, k) in done.items()]
    rows += [(*g, -1, None, False) for g, n in targets.items() if n <= 0]
    key_type = dict((f.name, f.dataType) for f in df.schema.fields)[key]
    return spark.createDataFrame(rows, T.StructType(gschema + [
        T.StructField("_cut_h", T.LongType()), T.StructField("_cut_key", key_type),
        T.StructField("_take", T.BooleanType())]))


def _crossings(hist: DataFrame, group_cols: list[str]) -> list:
    """Rows of a (group, bucket) histogram where the running count reaches ``_need``."""
    w = Window.partitionBy(*group_cols).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    cum = hist.select(*group_cols, "_lo", "_w", "_need", "_b", "_n", F.sum("_n").over(w).alias("_cum"))
    return cum.where((F.col("_cum") - F.col("_n") < F.col("_need")) & (F.col("_cum") >= F.col("_need"))).collect()


def _first_level(spark, base, group_cols, gschema, target_fn):
    """Level one with size-dependent targets: one scan builds the histogram;
    group sizes and the crossing buckets are read from it."""
    width = HASH_SPACE // BUCKETS
    hist = base.groupBy(*group_cols, (F.col("_h") / F.lit(width)).cast("long").alias("_b")).agg(
        F.count(F.lit(1)).alias("_n")).persist()
    try:
        sizes = {tuple(r[c] for c in group_cols): r["_t"] for r in
                 hist.groupBy(*group_cols).agg(F.sum("_n").alias("_t")).limit(MAX_GROUPS + 1).collect()}
        if len(sizes) > MAX_GROUPS:
            raise ValueError("too many groups for a per-group cut")
        targets = {g: int(target_fn(n)) for g, n in sizes.items()}
        need = spark.createDataFrame([(*g, n) for g, n in targets.items() if n > 0],
                                     T.StructType(gschema + [T.StructField("_need", T.LongType())]))
        side, _ = bounded_broadcast(need, known_rows=len(targets))
        h = hist.join(side, _null_safe_on(hist, side, group_cols), "inner").select(
            *[hist[c] for c in group_cols], F.lit(0).cast("long").alias("_lo"), F.lit(width).cast("long").alias("_w"),
            "_need", "_b", "_n")
        cross = _crossings(h, group_cols)
    finally:
        hist.unpersist()
    state, final, found = {}, {}, set()
    for r in cross:
        g = tuple(r[c] for c in group_cols)
        found.add(g)
        blo = r["_b"] * width
        rng = (blo, min(HASH_SPACE, blo + width), r["_need"] - (r["_cum"] - r["_n"]))
        (final if r["_n"] <= FINAL_RANK_ROWS else state)[g] = rng
    whole = [g for g, n in targets.items() if n > 0 and g not in found]
    return targets, state, (state, final, whole)


def _rank_inside(spark, base, group_cols, gschema, ranges: dict) -> dict:
    """Exact (hash, key) of the ``need``-th row inside each group's small range."""
    srows = [(*g, lo, hi, need) for g, (lo, hi, need) in ranges.items()]
    sdf = spark.createDataFrame(srows, T.StructType(gschema + [
        T.StructField("_lo", T.LongType()), T.StructField("_hi", T.LongType()),
        T.StructField("_need", T.LongType())]))
    side, _ = bounded_broadcast(sdf, known_rows=len(srows))
    j = base.join(side, _null_safe_on(base, side, group_cols), "inner")
    j = j.where((F.col("_h") >= F.col("_lo")) & (F.col("_h") < F.col("_hi")))
    w = Window.partitionBy(*[base[c] for c in group_cols]).orderBy("_h", "_key")
    picked = (j.select(*[base[c] for c in group_cols], "_h", "_key", "_need",
                       F.row_number().over(w).alias("_rn"))
              .where(F.col("_rn") == F.col("_need")).collect())
    return {tuple(r[c] for c in group_cols): (r["_h"], r["_key"]) for r in picked}


def mark_first_n(df: DataFrame, group_cols: list[str], key: str, salt, targets,
                 out: str = "_in") -> DataFrame:
    """Add boolean ``out``: row is among the first targets[group] by (hash, key)."""
    cut = first_n_cut(df, group_cols, key, salt, targets)
    side, _ = bounded_broadcast(cut)
    h = hash32(F.col(key), salt)
    j = df.join(side, _null_safe_on(df, side, group_cols), "left")
    inside = F.coalesce(F.col("_take"), F.lit(False)) & F.coalesce(
        (h < F.col("_cut_h")) | ((h == F.col("_cut_h")) & (F.col(key) <= F.col("_cut_key")))
        | (F.col("_cut_h") == F.lit(HASH_SPACE)), F.lit(False))
    return j.select(*[df[c] for c in df.columns], inside.alias(out))


def group_sizes(df: DataFrame, group_cols: list[str], max_groups: int = MAX_GROUPS) -> dict:
    """Row count per group (bounded: errors out beyond ``max_groups``)."""
    rows = df.groupBy(*group_cols).count().limit(max_groups + 1).collect()
    if len(rows) > max_groups:
        raise ValueError(f"more than {max_groups} groups")
    return {tuple(r[c] for c in group_cols): r["count"] for r in rows}


def sample_fixed(df: DataFrame, n: int, key: str, seed=42) -> DataFrame:
    """min(n, rows) rows with the smallest (hash(key, seed), key)."""
    marked = mark_first_n(df.withColumn("_all", F.lit(1)), ["_all"], key, f"sample{seed}", lambda total: min(n, total))
    return marked.where("_in").drop("_in", "_all")


def test_count(n_c: int, test_size: float = 0.2) -> int:
    """Rows of a class put in test: round half up of test_size * n_c, in integers."""
    tenths = round(test_size * 10)
    if abs(tenths / 10 - test_size) < 1e-12:
        return (tenths * n_c + 5) // 10
    return int(test_size * n_c + 0.5)


def stratified_holdout(df: DataFrame, label: str, key: str, test_size: float = 0.2, seed=42,
                       out: str = "is_test") -> DataFrame:
    """Exact per-class test counts, members chosen by hash rank inside the class."""
    return mark_first_n(df, [label], key, f"strat{seed}", lambda n: test_count(n, test_size), out)


def plain_holdout(df: DataFrame, key: str, test_size: float = 0.2, seed=42, out: str = "is_test") -> DataFrame:
    """Unstratified: test iff hash/2^32 < test_size (no job needed)."""
    return df.withColumn(out, hash32(F.col(key), f"plain{seed}") < F.lit(int(test_size * HASH_SPACE)))


def drop_unknown(df: DataFrame, col: str = "label_target_main", unknown: str = "unknown",
                 keep_null: bool = False) -> DataFrame:
    """Remove the unknown class. ``keep_null=True`` is the pandas rule
    (``!= 'unknown'`` keeps nulls); False the Polars rule (null dropped)."""
    if keep_null:
        return df.where(~F.col(col).eqNullSafe(F.lit(unknown)))
    return df.where(F.col(col) != unknown)


def small_group_filter(df: DataFrame, group: str, min_rows: int = 5000) -> DataFrame:
    """Keep rows of groups with at least ``min_rows`` rows (semi join on a
    per-group count; the count side has one row per group)."""
    big = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_rows).select(group)
    # one row per kept group: broadcast behind the count check, so a hot group
    # is never shuffled into one task by a sort-merge semi join
    side, _ = bounded_broadcast(big)
    return df.join(side, on=group, how="left_semi")


def clean_group_key(df: DataFrame, group: str, out: str = "_group") -> DataFrame:
    """upper(trim(group)); rows with a null/empty key are removed."""
    k = F.upper(F.trim(F.col(group)))
    return df.withColumn(out, k).where(F.col(out).isNotNull() & (F.col(out) != ""))


def shuffled_group_folds(df: DataFrame, group: str, k: int = 5, seed=42) -> DataFrame:
    """Distinct groups in hash order cut into k near-equal lists (first
    ``n % k`` lists one longer). Null is a group. Returns (group, fold 0..k-1).

    Groups are ranked by a range shuffle: no window holds them all.
    """
    h = hash32(F.coalesce(F.col(group).cast("string"), F.lit("<null>")), f"groups{seed}")
    ranked, n = global_rank(df.select(group).distinct(), [h, F.col(group)], "_rank")
    q, r = divmod(n, k)
    i = F.col("_rank") - 1
    late = (i - r * (q + 1)) / q if q else F.lit(0)
    fold = F.when(i < r * (q + 1), (i / (q + 1)).cast("long")).otherwise(r + late.cast("long"))
    return ranked.select(group, fold.cast("int").alias("fold"))


def assign_folds(df: DataFrame, folds: DataFrame, group: str) -> DataFrame:
    """Attach the fold of each row's group (null-safe; fold map is small)."""
    side, _ = bounded_broadcast(folds.withColumnRenamed(group, "_fg"))
    j = df.join(side, df[group].eqNullSafe(side["_fg"]), "left")
    return j.drop("_fg")


def stratified_group_folds(df: DataFrame, group: str, label: str, k: int = 5, heavy: int = HEAVY_GROUPS) -> DataFrame:
    """Stratified group k-fold, deterministic (D2): k = min(k, #groups), fewer
    than 3 groups is an error. Returns (group, fold).

    The ``heavy`` largest groups are assigned greedily on the driver: in order of
    descending spread of their class counts (tie: name), each to the fold that
    minimises the mean over classes of the standard deviation of per-fold class
    shares; ties: fewer rows, lower fold. All further groups are no larger: they
    are dealt out to the folds in order of their class counts, so groups of equal
    counts spread evenly, by one distributed rank.
    """
    import numpy as np

    counts = df.groupBy(group, label).agg(F.count(F.lit(1)).alias("_n"))
    totals = counts.groupBy(label).agg(F.sum("_n").alias("_n")).limit(MAX_GROUPS + 1).collect()  # a row a class
    if len(totals) > MAX_GROUPS:
        raise ValueError("too many classes for stratified folds")
    vectors = counts.groupBy(group).agg(F.sum("_n").alias("_total"), F.sort_array(F.collect_list(F.struct(label, "_n"))).alias("_counts"))
    ranked, n_groups = global_rank(vectors, [F.desc("_total"), F.asc(group)], "_rank")
    if n_groups < 3:
        raise ValueError("need at least 3 groups for group folds")
    k = min(k, n_groups)
    classes = sorted((r[label] for r in totals), key=lambda c: (c is None, c))
    ci = {c: i for i, c in enumerate(classes)}
    class_tot = np.zeros(len(classes))
    for r in totals:
        class_tot[ci[r[label]]] = r["_n"]
    rows = ranked.where(F.col("_rank") <= heavy).collect()
    groups = sorted((r[group] for r in rows), key=lambda g: (g is None, g))
    gi = {g: i for i, g in enumerate(groups)}
    m = np.zeros((len(groups), len(classes)))
    for r in rows:
        for c in r["_counts"]:
            m[gi[r[group]], ci[c[label]]] += c["_n"]
    fold_counts = np.zeros((k, len(classes)))
    assign = {}
    for i in sorted(range(len(groups)), key=lambda i: (-float(np.std(m[i])), str(groups[i]))):
        best = None
        for f in range(k):
            fold_counts[f] += m[i]
            shares = fold_counts / np.where(class_tot > 0, class_tot, 1)
            cand = (float(np.mean(np.std(shares, axis=0))), float(fold_counts[f].sum()), f)
            fold_counts[f] -= m[i]
            if best is None or cand < best:
                best = cand
        fold_counts[best[2]] += m[i]
        assign[groups[i]] = best[2]
    light = ranked.where(F.col("_rank") > heavy).select(group, "_counts")
    return _with_light(df, group, assign, light if n_groups > heavy else None, [F.col("_counts"), F.asc(group)], fold_counts.sum(axis=1).tolist())


def group_kfold(df: DataFrame, group: str, k: int = 5, heavy: int = HEAVY_GROUPS) -> DataFrame:
    """Group k-fold without classes. Returns (group, fold).

    The ``heavy`` largest groups go, largest first, each to the fold with the
    fewest rows so far (tie: lower fold). All further groups are no larger and
    are dealt out in order of size, forwards and backwards in turn, by one
    distributed rank.
    """
    sizes_of = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    ranked, n_groups = global_rank(sizes_of, [F.desc("_n"), F.coalesce(F.col(group).cast("string"), F.lit("None"))], "_rank")
    if n_groups < k:
        raise ValueError("fewer groups than folds")
    sizes, assign = [0] * k, {}
    for r in sorted(ranked.where(F.col("_rank") <= heavy).collect(), key=lambda r: r["_rank"]):
        f = min(range(k), key=lambda i: (sizes[i], i))
        sizes[f] += r["_n"]
        assign[r[group]] = f
    light = ranked.where(F.col("_rank") > heavy).select(group, "_n")
    return _with_light(df, group, assign, light if n_groups > heavy else None, [F.desc("_n"), F.asc(group)], sizes)


def _with_light(df: DataFrame, group: str, assign: dict, light: DataFrame | None, order: list[Column], sizes: list) -> DataFrame:
    """The assigned groups, and the light ones dealt to the folds in ``order``, emptiest fold first, back and forth."""
    schema = T.StructType([T.StructField(group, df.schema[group].dataType), T.StructField("fold", T.IntegerType())])
    heavy = df.sparkSession.createDataFrame(list(assign.items()), schema)
    if light is None:
        return heavy
    k = len(sizes)
    folds = F.array(*[F.lit(f) for f in sorted(range(k), key=lambda f: (sizes[f], f))])
    dealt, _ = global_rank(light, order, "_deal")
    lap, seat = F.floor((F.col("_deal") - 1) / k), (F.col("_deal") - 1) % k
    at = F.when(lap % 2 == 0, seat).otherwise(k - 1 - seat).cast("int")
    return heavy.unionByName(dealt.select(group, F.get(folds, at).alias("fold")))

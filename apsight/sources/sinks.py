"""Sinks (S8-S13). All writes are whole-table, idempotent (overwrite or a
run_id partition), so a retried job after executor loss rewrites the same
files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apsight import schemas
from apsight.operators.ranks import global_rank


def write_integrated(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """27 integrated columns; parquet by default, TSV with a '#' header on request."""
    out = df.select(*[F.col(n).cast(t) for n, t in schemas.INTEGRATED_FIELDS])
    if fmt == "parquet":
        out.write.mode("overwrite").parquet(path)
    else:
        (out.write.mode("overwrite").option("sep", "\t").option("header", True)
         .option("nullValue", "").option("emptyValue", "").csv(path))


def write_dead_letter(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    out = df.select(*[f.name for f in schemas.DEAD_LETTER.fields])
    if fmt == "parquet":
        out.write.mode("overwrite").parquet(path)
    else:
        out.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def write_results(tables: dict[str, DataFrame], path: str, fmt: str = "parquet") -> None:
    """Result tables as one long table partitioned by table name (parquet), or
    as one headed tab-separated folder per table (``fmt="tsv"``, the layout of
    per-table text outputs).

    For parquet the inputs are unioned by name; missing columns become null.
    """
    if fmt == "tsv":
        for name, df in tables.items():
            (df.write.mode("overwrite").option("sep", "\t").option("header", True)
             .option("nullValue", "").csv(f"{path}/{name}"))
        return
    frames = [df.withColumn("table", F.lit(name)) for name, df in tables.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    out.write.mode("overwrite").partitionBy("table").parquet(path)


def write_sorted(tables: dict[str, tuple[DataFrame, list]], path: str, fmt: str = "parquet") -> None:
    """Result tables in their order (K1, K3): each (frame, order) gets ``row_no``, its global rank, and is
    written range-sorted under ``path/table=<name>``; ``read_sorted`` gives the rows back with their order.
    ``fmt="tsv"`` writes headed tab-separated files instead, in order by file name."""
    for name, (df, order) in tables.items():
        ranked, _ = global_rank(df, order, "row_no")
        out = ranked.repartitionByRange("row_no").sortWithinPartitions("row_no").write.mode("overwrite")
        if fmt == "tsv":
            out.option("sep", "\t").option("header", True).option("nullValue", "").csv(f"{path}/{name}")
        else:
            out.parquet(f"{path}/table={name}")


def read_sorted(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One table of ``write_sorted`` in its order."""
    return spark.read.parquet(f"{path}/table={name}").orderBy("row_no")


def append_run(df: DataFrame, path: str, run_id: str) -> None:
    """Append one run's rows (metrics / confusion / report) under ``run_id``.

    Dynamic partition overwrite makes a retried run replace its own partition.
    """
    (df.withColumn("run_id", F.lit(run_id)).write
     .option("partitionOverwriteMode", "dynamic").mode("overwrite")
     .partitionBy("run_id").parquet(path))


def latest_run(metrics: DataFrame, run_col: str = "run_id") -> DataFrame:
    """Rows of the newest run (run ids sort as text)."""
    newest = metrics.agg(F.max(run_col).alias("_newest"))
    return metrics.join(F.broadcast(newest), F.col(run_col) == F.col("_newest"), "left_semi")


def save_pipeline_model(model, path: str) -> None:
    model.write().overwrite().save(path)

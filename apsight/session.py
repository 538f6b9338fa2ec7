"""Session helpers: one place for the configuration the operators assume."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # HotSpot does not JIT-compile methods above 8000 bytes of bytecode; wide
    # enrichment stages otherwise run as one huge interpreted method.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # the driver keeps plan descriptions of finished executions for status
    # reporting; long-running sessions with many small jobs keep fewer
    "spark.sql.ui.retainedExecutions": "100",
    "spark.ui.retainedJobs": "200",
    "spark.ui.retainedStages": "200",
    # checkpoint files go when the frames that read them are gone
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}

# SQL confs applied at runtime to a session someone else built (e.g. a driver),
# only where the session still has Spark's default value.
RUNTIME_SQL_DEFAULTS = {"spark.sql.codegen.hugeMethodLimit": ("65535", "8000")}


def apply_runtime_defaults(spark: SparkSession) -> None:
    for key, (spark_default, ours) in RUNTIME_SQL_DEFAULTS.items():
        if spark.conf.get(key, spark_default) == spark_default:
            spark.conf.set(key, ours)


def get_session(master: str | None = None, app: str = "apsight",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the defaults above.

    ``master`` is only set when given: on a cluster the launcher decides it.
    """
    builder = SparkSession.builder.appName(app)
    conf = dict(DEFAULTS)
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            # local mode: the driver JVM does all the work (executors included)
            conf["spark.driver.memory"] = "16g"
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    apply_runtime_defaults(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, creating a local one only if unset.

    On a cluster ``spark.checkpoint.dir`` names a shared (HDFS/S3/...) folder and
    is used as is; if it is unset there, this fails rather than fall back to a
    machine-local folder. Only in local mode (tests) a scratch folder is made.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        master = spark.sparkContext.master or ""
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError("spark.checkpoint.dir is not set: on a cluster it must name a shared folder "
                               "(HDFS/S3/...); a machine-local folder would not survive executor loss")
        path = tempfile.mkdtemp(prefix="apsight-ckpt-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written intermediate tables."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, name) if "://" not in base else base.rstrip("/") + "/" + name


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared checkpoint folder by columns: later reads take only the columns they use."""
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex[:12]}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BATCH_BYTES, BATCH_ROWS = "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def counted_batches(spark: SparkSession, row_bytes: int):
    """Within, Arrow batches end by their rows alone, if a full one stays under the limit of bytes anyway: Spark adds up
    the bytes of a batch after every row, which takes several times as long as the row."""
    every = {r["key"]: r["value"] for r in spark.sql(f"set {BATCH_BYTES}").collect() + spark.sql(f"set {BATCH_ROWS}").collect()}
    limit, rows = every[BATCH_BYTES], int(every[BATCH_ROWS])
    known = re.fullmatch(r"(\d+)b?", limit)  # an older Spark has no such limit
    if not known or rows <= 0 or rows * row_bytes > int(known[1]):
        yield
        return
    spark.conf.set(BATCH_BYTES, str(2 ** 31 - 1))
    try:
        yield
    finally:
        spark.conf.set(BATCH_BYTES, limit)


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package: Spark sends a zip of its sources to every executor, once a session."""
    context = spark.sparkContext
    if getattr(context, "_apsight_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="apsight-"), "apsight.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(package):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                z.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(target)
    context._apsight_shipped = True


def scale_settings(input_bytes: int, total_cores: int, executor_memory_gb: float = 16.0,
                   cores_per_executor: int = 4) -> dict[str, str]:
    """Sizing for a cluster run, derived from the input size and the core count.

    * file splits: large enough that the scan has a few waves of tasks (not
      hundreds of thousands of tiny ones), small enough that one task's share
      of executor memory holds a split: between 128 MB and 1 GB;
    * shuffle partitions: the big shuffles here are the non-broadcast geocode
      join and the grouping-set aggregates (partially aggregated first), so the
      initial count targets ~256 MB per partition of the input and AQE
      coalesces what turns out smaller; skewed partitions are split by AQE.
    """
    mb = 1024 * 1024
    per_task_mem = executor_memory_gb * 1024 * mb / max(1, cores_per_executor)
    waves = 3
    split = input_bytes / max(1, total_cores * waves)
    split = int(min(max(split, 128 * mb), 1024 * mb, per_task_mem / 2))
    shuffle_parts = max(total_cores, min(200_000, input_bytes // (256 * mb) + 1))
    return {
        "spark.sql.files.maxPartitionBytes": str(split),
        "spark.sql.shuffle.partitions": str(int(shuffle_parts)),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 * mb),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(512 * mb),
        "spark.sql.autoBroadcastJoinThreshold": str(64 * mb),
    }

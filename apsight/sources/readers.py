"""Sources (S1-S7): every reader declares its schema and stays splittable."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apsight import schemas

_STRIP = r"^\s+|\s+$"


def read_raw_sightings(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated sightings; '#' lines skipped; undecodable bytes replaced;
    CSV quoting as the usual tab-separated writers produce it ('"' quotes,
    doubled inside).

    Columns are kept as text (see ``schemas.RAW_SIGHTINGS``); rows with fewer
    columns get nulls, which the enrichment classifies as ``bad_row``.
    """
    return (spark.read.schema(schemas.RAW_SIGHTINGS)
            .option("sep", "\t").option("comment", "#").option("mode", "PERMISSIVE")
            .option("quote", '"').option("escape", '"').option("encoding", "UTF-8")
            .csv(path))


def read_oui_registry(spark: SparkSession, path: str) -> DataFrame:
    """OUI registry text: ``prefix<TAB>vendor`` per line -> (prefix, vendor, line_no).

    Lines without a tab are skipped; the line is stripped and split once; the
    prefix is upper-cased. ``line_no`` orders duplicates (later wins) over any
    number of files and splits: (file path, start of the split in the file,
    place in the split), compared in that order. A split is read by one task
    from its first line on, so ids given in the scan ascend within it.
    """
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
                     F.monotonically_increasing_id().alias("place"))
    raw = spark.read.text(path).select(F.col("value"), place.alias("line_no"))
    raw = raw.where(F.col("value").contains("\t"))
    stripped = F.regexp_replace("value", _STRIP, "")
    parts = F.split(stripped, "\t", 2)
    return (raw.select(parts.alias("p"), "line_no").where(F.size("p") == 2)
            .select(F.upper(F.get("p", 0)).alias("prefix"), F.get("p", 1).alias("vendor"), "line_no"))


def read_alias_table(spark: SparkSession, path: str) -> DataFrame:
    """(canonical, alias, line_no) from parquet, or from a headed CSV."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    return spark.read.schema("canonical string, alias string, line_no long").option("header", True).csv(path)


def read_integrated_tsv(spark: SparkSession, path: str) -> DataFrame:
    """The 27-column integrated TSV (header line, tab, empty cell = null).

    Cells that do not parse as their declared type become null (PERMISSIVE).
    """
    return (spark.read.schema(schemas.INTEGRATED)
            .option("header", True).option("sep", "\t").option("quote", '"').option("escape", '"')
            .option("nullValue", "").option("mode", "PERMISSIVE")
            .csv(path))


def read_table(spark: SparkSession, path: str, tsv_schema=None) -> DataFrame:
    """Scan by suffix: ``.parquet`` -> parquet, anything else -> integrated TSV."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    if tsv_schema is None:
        return read_integrated_tsv(spark, path)
    return spark.read.schema(tsv_schema).option("header", True).option("sep", "\t").csv(path)


def preview(df: DataFrame, n_names: int = 20, n_rows: int = 5) -> tuple[int, list[str], DataFrame]:
    """Schema look: column count, the first names, and a ``limit(n_rows)`` frame."""
    return len(df.columns), df.columns[:n_names], df.limit(n_rows)

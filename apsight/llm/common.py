"""Helpers shared by the operators: Arrow row mapping, bounded caches, scratch tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from apsight.session import ensure_checkpoint_dir, ship

#: Rows turned into Python objects at a time: bounds a worker's memory beside the Arrow batch.
SLICE_ROWS = 256

#: Whitespace of the contracts: space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder of ``spark.checkpoint.dir`` (set only where unset)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: cuts lineage, survives executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_documents(docs: DataFrame, rows: Callable[[Iterator[tuple]], Iterator[tuple]], fields: list[T.StructField],
                  columns: tuple[str, ...] = ("doc_id", "text"), keep_id: bool = True) -> DataFrame:
    """Run ``rows`` over the rows of each partition as Python tuples of ``columns``.

    Only ``columns`` reach Python, so extra columns of ``docs`` never clash with
    the results. ``rows`` yields tuples for ``doc_id`` (unless ``keep_id`` is
    False) and ``fields``. Rows are streamed: at most one Arrow batch and
    ``SLICE_ROWS`` decoded rows are held.
    """
    ship(docs.sparkSession)
    picked = docs.select(*columns)
    schema = T.StructType(([T.StructField("doc_id", picked.schema["doc_id"].dataType)] if keep_id else []) + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)

        def source() -> Iterator[tuple]:
            for batch in batches:
                for at in range(0, batch.num_rows, SLICE_ROWS):
                    part = batch.slice(at, SLICE_ROWS)
                    yield from zip(*(c.to_pylist() for c in part.columns), strict=True)

        held: list[tuple] = []
        size = 0
        for row in rows(source()):
            held.append(row)
            size += sum(len(x) for x in row if isinstance(x, (bytes, str)))
            if len(held) >= 1024 or size >= 1 << 23:
                yield _batch(held, arrow)
                held, size = [], 0
        if held:
            yield _batch(held, arrow)

    return picked.mapInArrow(run, schema)


def _batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    cols = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)


class TwoGenerations(dict):
    """A bounded cache: when ``limit`` entries are reached they become the old generation.

    ``self`` is the young generation; a miss looks in the old one before it
    calls ``make``, so frequent keys survive and memory stays below two
    generations.
    """

    def __init__(self, make: Callable, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self.keep(key, value)
        return value

    def keep(self, key, value) -> None:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value


def held_out(doc_id, parts: int = 3, part: int = 1):
    """Fold rule of the language contract: crc32 of the id as text, modulo ``parts``."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts == part, F.lit(False))

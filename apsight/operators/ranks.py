"""Global ranks without a window over all rows.

One range shuffle puts the rows in order; a row's place in its partition and the
sizes of the partitions before it (one number a partition) give its rank.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apsight.session import ensure_checkpoint_dir

_PLACE_BITS = 33  # monotonically_increasing_id: partition above, place in the partition below


def global_rank(df: DataFrame, order: list[Column], out: str = "rank") -> tuple[DataFrame, int]:
    """``df`` with the 1-based rank of each row by ``order``, and the number of rows.

    The ordered rows are checkpointed, so every reader sees the same ranks. Rows
    that are equal in ``order`` share a partition and are ranked in any order.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = ordered.withColumn("_place", F.monotonically_increasing_id()).checkpoint(eager=True)
    piece = F.shiftright("_place", _PLACE_BITS)
    sizes = sorted(tuple(r) for r in placed.groupBy(piece.alias("p")).count().collect())  # a row per partition
    ends = list(accumulate(n for _, n in sizes))
    before = spark.createDataFrame([(p, end - n) for (p, n), end in zip(sizes, ends)], "_piece long, _before long")
    ranked = placed.withColumn("_piece", piece).join(F.broadcast(before), "_piece")  # bounded by the partitions
    rank = F.col("_before") + F.col("_place").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)) + 1
    return ranked.select(*df.columns, rank.alias(out)), ends[-1] if ends else 0

"""Operator 13: exact duplicates by counting quotient filters, confirmed on the texts' bytes.

Texts are equal if they are identical once white space (space, controls 9 to 13)
is taken out. Each text has a 64-bit fingerprint. Every partition builds counting
quotient filters of its fingerprints, one for each range of their high bits, and
the filters of a range are merged by their sorted remainders. Nothing is lost:
a filter lists exactly the fingerprints that went in, with their counts.

Fingerprints counted once are unique texts. Those counted more often set bits in
a routing bitmap of fixed size (``ROUTE_BITS``), and only texts whose bit is set
go on to verification, which groups whole texts by their bytes (combined within
a task first, so a text held by a third of all rows is shuffled once a task). A
SHA-256 names each verified text; were one to name two texts, this raises.

A filter of n fingerprints has quotients of about log2(4n/3) bits, and slots of
remainders with three bits beside each: *occupied* (of the quotient with the
slot's number), *run end*, and *counter* (the slot holds the count of the
remainder before it). A run (the remainders of one quotient, ascending) stands
in its quotient's slot or, if that is taken, behind the runs before it.

Of equal texts the row stays with the most code points in the original text,
then the smallest doc_id (null after all others); of rows alike in both, one.

Defined cases: a null text is the empty text; a text of white space alone equals
the empty text; rows that share a ``doc_id`` each get a row; long texts are
hashed and compared whole; other columns are not looked at; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apsight.llm.common import ship, written

#: The routing bitmap has 2 ** ROUTE_BITS bits (4 MB are broadcast), however many fingerprints set them.
ROUTE_BITS = 25
#: Fingerprints that a task holds before it writes out its filters.
FILTER_ROWS = 1 << 20
#: Fingerprints that a merged filter holds on average, at most.
RANGE_ROWS = 1 << 18
_BUCKET_BITS = 15  # bits of one bitmap of bitmap_construct_agg

FILTER = "range int, range_bits int, quotient_bits int, occupied binary, run_ends binary, counters binary, slots binary"


# ---- counting quotient filters ------------------------------------------------------------------------------------

def build(fps: np.ndarray, counts: np.ndarray, range_bits: int) -> tuple[int, bytes, bytes, bytes, bytes]:
    """(quotient bits, occupied, run ends, counters, slots) of distinct ascending fingerprints that share their
    ``range_bits`` high bits."""
    repeated = counts > 1
    n = len(fps) + int(repeated.sum())
    q = min(max(int(np.ceil(np.log2(max(n, 1) / 0.75))), 1), 63 - range_bits)
    r = 64 - range_bits - q
    quotient = (fps >> np.uint64(r)).astype(np.int64) & ((1 << q) - 1)
    remainder = fps & np.uint64((1 << r) - 1)
    of = np.repeat(np.arange(len(fps)), 1 + repeated)  # the fingerprint of each slot: its remainder, then maybe its count
    is_count = np.zeros(n, bool)
    is_count[1:] = of[1:] == of[:-1]
    home = quotient[of]
    order = np.arange(n)
    place = order + np.maximum.accumulate(home - order)  # own slot, or the first free one behind
    size = max(1 << q, int(place[-1]) + 1)
    slots, counters, run_ends, occupied = np.zeros(size, "<u8"), np.zeros(size, bool), np.zeros(size, bool), np.zeros(size, bool)
    slots[place] = np.where(is_count, counts[of].astype(np.uint64), remainder[of])
    counters[place] = is_count
    run_ends[place[np.append(home[1:] != home[:-1], True)]] = True
    occupied[quotient] = True
    return q, *(np.packbits(x).tobytes() for x in (occupied, run_ends, counters)), slots.tobytes()


def listed(of_range: int, range_bits: int, q: int, occupied: bytes, run_ends: bytes, counters: bytes, slots: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The ascending fingerprints of a filter, and their counts."""
    values = np.frombuffer(slots, "<u8")
    occupied, ends, is_count = (np.unpackbits(np.frombuffer(x, np.uint8), count=len(values)).astype(bool) for x in (occupied, run_ends, counters))
    quotient, end = np.flatnonzero(occupied), np.flatnonzero(ends)  # the n-th occupied quotient has the n-th run
    start = np.maximum(quotient, np.append(-1, end[:-1]) + 1)
    length = end - start + 1
    place = np.arange(int(length.sum())) + np.repeat(start - (np.cumsum(length) - length), length)
    home = np.repeat(quotient, length)
    own = ~is_count[place]
    r = 64 - range_bits - q
    fps = (home[own].astype(np.uint64) << np.uint64(r)) | values[place[own]]
    fps |= np.uint64(of_range) << np.uint64(64 - range_bits)
    counts = np.ones(len(fps), np.int64)
    counts[np.cumsum(own)[~own] - 1] = values[place[~own]].astype(np.int64)
    return fps, counts


def merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Ascending lists of fingerprints with counts as one; counts of the same fingerprint add up."""
    fps, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(fps, kind="stable")  # merges the runs that are sorted already
    fps, counts = fps[order], counts[order]
    first = np.flatnonzero(np.append(True, fps[1:] != fps[:-1]))
    return fps[first], np.add.reduceat(counts, first)


def filters(keys: DataFrame, range_bits: int, filter_rows: int = FILTER_ROWS) -> DataFrame:
    """One merged filter for each range of the high bits of ``keys.fp`` (columns of FILTER)."""
    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            fps, counts = np.unique(np.concatenate(held), return_counts=True)
            ranges = (fps >> np.uint64(64 - range_bits)).astype(np.int64)
            cuts = np.flatnonzero(np.append(True, ranges[1:] != ranges[:-1])).tolist()
            for a, b in zip(cuts, [*cuts[1:], len(fps)], strict=True):
                yield _filter_batch(int(ranges[a]), range_bits, fps[a:b], counts[a:b])

        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            n += batch.num_rows
            if n >= filter_rows:
                yield from out()
                held, n = [], 0
        if n:
            yield from out()

    def merged(table: pa.Table) -> pa.Table:
        rows = list(zip(*(c.to_pylist() for c in table.columns), strict=True))
        return pa.Table.from_batches([_filter_batch(rows[0][0], range_bits, *merge([listed(*row) for row in rows]))])

    ship(keys.sparkSession)
    return keys.select("fp").mapInArrow(built, FILTER).groupBy("range").applyInArrow(merged, FILTER)


def _filter_batch(of_range: int, range_bits: int, fps: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    q, *parts = build(fps, counts, range_bits)
    numbers = [pa.array([x], pa.int32()) for x in (of_range, range_bits, q)]
    return pa.RecordBatch.from_arrays([*numbers, *(pa.array([x], pa.binary()) for x in parts)],
                                      names=["range", "range_bits", "quotient_bits", "occupied", "run_ends", "counters", "slots"])


def counted(merged: DataFrame, at_least: int = 2) -> DataFrame:
    """fp, n of the fingerprints that merged filters count ``at_least`` times."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fps, counts = listed(*row)
                keep = counts >= at_least
                yield pa.RecordBatch.from_arrays([pa.array(fps[keep].view(np.int64)), pa.array(counts[keep])], names=["fp", "n"])

    return merged.mapInArrow(run, "fp long, n long")


# ---- routing and verification -------------------------------------------------------------------------------------

def normalised(text: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", "")


def _fingerprint(norm: Column, bits: int) -> Column:
    return F.xxhash64(norm).bitwiseAND(F.lit(-1 << (64 - bits)).cast("long"))


def routing(repeated: DataFrame, route_bits: int = ROUTE_BITS) -> DataFrame:
    """The bitmap of the high bits of ``repeated.fp``: at most 2 ** (route_bits - 15) rows of 4 KB."""
    slot = F.shiftrightunsigned("fp", 64 - route_bits)
    bit = slot.bitwiseAND(F.lit((1 << _BUCKET_BITS) - 1))
    return repeated.groupBy(F.shiftright(slot, _BUCKET_BITS).alias("route__bucket")).agg(F.bitmap_construct_agg(bit).alias("route__bits"))


def _by_route(rows: DataFrame, bitmap: DataFrame, how: str, route_bits: int) -> DataFrame:
    """``rows`` whose fingerprint's bit is set (left_semi) or not (left_anti)."""
    slot = F.shiftrightunsigned(rows["fp"], 64 - route_bits)
    at = slot.bitwiseAND(F.lit((1 << _BUCKET_BITS) - 1))
    byte = F.conv(F.hex(F.substr("route__bits", (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.call_function("getbit", byte, at.bitwiseAND(F.lit(7)).cast("int")) == 1
    return rows.join(F.broadcast(bitmap), (F.shiftright(slot, _BUCKET_BITS) == F.col("route__bucket")) & bit, how)


def exact_duplicates(docs: DataFrame, bits: int = 64, route_bits: int = ROUTE_BITS) -> DataFrame:
    """doc_id, text_sha256, n_chars, keep_id, group_size, kept for every row of ``docs``.

    ``bits`` is the length of the fingerprints; the result is the same for any.
    """
    spark = docs.sparkSession
    texts = docs.select("doc_id", "text", normalised("text").alias("norm"))
    # row numbers are fixed by writing them: they tell rows alike in all columns apart
    keys = written(texts.select("doc_id", _fingerprint(F.col("norm"), bits).alias("fp"), F.sha2(F.col("norm").cast("binary"), 256).alias("sha"),
                                F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"),
                                F.monotonically_increasing_id().alias("row")), "exact-keys")
    wanted = max(keys.count() // RANGE_ROWS, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    merged = filters(keys, min((wanted - 1).bit_length(), 24))
    bitmap = written(routing(counted(merged), route_bits), "exact-routes")

    routed = _by_route(texts.select("norm", _fingerprint(F.col("norm"), bits).alias("fp")), bitmap, "left_semi", route_bits)
    same = routed.groupBy("fp", F.sha2(F.col("norm").cast("binary"), 256).alias("sha"), "norm").agg(F.count("*").alias("n"))
    verified = written(same.select("fp", "sha", "n"), "exact-verified")  # a row for each distinct text
    if not verified.groupBy("fp", "sha").count().where("count > 1").isEmpty():
        raise RuntimeError("two texts share a SHA-256")

    several = _by_route(keys, bitmap, "left_semi", route_bits)
    best = several.groupBy("fp", "sha").agg(F.min(F.struct((-F.col("n_chars")).alias("chars"), F.isnull("doc_id").alias("no_id"), "doc_id", "row")).alias("best"))
    # a table of its own: the join below is then of plain shuffles, and Spark splits the side of a hot text
    groups = written(verified.where("n > 1").join(best, ["fp", "sha"]), "exact-groups")
    single = F.col("n").isNull()
    judged = several.join(groups, ["fp", "sha"], "left").select(
        "doc_id", F.col("sha").alias("text_sha256"), "n_chars", F.when(single, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), (single | (F.col("row") == F.col("best.row"))).alias("kept"))
    alone = _by_route(keys, bitmap, "left_anti", route_bits).select(
        "doc_id", F.col("sha").alias("text_sha256"), "n_chars", F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    return judged.unionByName(alone)

"""Operator 6: document fingerprints from closed syncmers of words. DataFrame functions only.

A k-mer of ``K`` consecutive words is an anchor if the least hash among its
inner runs of ``S`` words lies at its first or last place. Whether it is one
depends on these words alone, so an edit moves no anchor elsewhere. The
fingerprint holds all of a text's distinct anchor hashes (40 bits), each with
the word position where it first occurs (22 bits; later positions count as the
last). An anchor whose hash the other text has too is shifted by the difference
of the two positions; it matches if one of the ``BESIDE`` shared anchors before
or after it in the text is shifted alike, within ``NEAR`` words, or if it is the
only one shared: text put in or taken out moves all that follows together, and
hides nothing. The likeness is twice the matches over all anchors of both.

Defined cases: a null text is the empty text; a text of fewer than ``K`` words
has its whole word sequence as its one anchor; texts without words have the
empty fingerprint, alike (1.0) to each other and to nothing else; rows that
share a ``doc_id`` follow each other by a hash of their texts; null ids come
first; an empty table gives none.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, S, NEAR, BESIDE = 4, 2, 64, 2
POSITION_BITS = 22
_GAP = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, _GAP), "")


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with column ``name``: sorted longs (hash << POSITION_BITS | position) of the anchors of column ``text``."""
    hashes, runs, at = (f"{name}__{x}" for x in ("words", "runs", "anchors"))
    df = df.withColumn(hashes, F.transform(words_of(F.col(text)), lambda w: F.xxhash64(w)))
    n = F.size(hashes)
    item = lambda column, i: F.get(F.col(column), i)
    inner = K - S + 1
    run = F.transform(F.sequence(F.lit(0), n - S), lambda i: F.xxhash64(*[item(hashes, i + j) for j in range(S)]))
    df = df.withColumn(runs, F.when(n >= K, run))
    whole = F.xxhash64(F.array_join(F.transform(F.col(hashes), lambda h: h.cast("string")), " "))

    def packed(value: Column, i: Column) -> Column:
        place = F.least(i, F.lit((1 << POSITION_BITS) - 1)).cast("long")
        return F.shiftleft(F.shiftrightunsigned(value, 24), POSITION_BITS).bitwiseOR(place)

    def anchor(i: Column) -> Column:
        values = [item(runs, i + j) for j in range(inner)]
        ends = F.least(values[0], values[-1])
        parts = [item(runs, i + j) for j in [*range(0, K - S, S), K - S]]
        least = ends <= F.least(*values[1:-1]) if inner > 3 else ends <= values[1] if inner == 3 else F.lit(True)
        return F.when(least, packed(F.xxhash64(*parts), i))

    anchors = F.sort_array(F.array_compact(F.transform(F.sequence(F.lit(0), n - K), anchor)))
    df = df.withColumn(at, F.when(n >= K, anchors).when(n > 0, F.array(packed(whole, F.lit(0)))).otherwise(F.array().cast("array<bigint>")))
    first = F.filter(F.col(at), lambda v, i: (i == 0) | (F.shiftright(v, POSITION_BITS) != F.shiftright(item(at, i - 1), POSITION_BITS)))
    return df.withColumn(name, first).drop(hashes, runs, at)


def with_likeness(df: DataFrame, one: str, two: str, name: str) -> DataFrame:
    """``df`` with column ``name``: likeness (0 to 1) of the fingerprint columns ``one`` and ``two``."""
    merged, shared = f"{name}__merged", f"{name}__shared"
    # hash, position, and 1 for the second text: a shared hash stands twice in a row
    both = F.concat(F.transform(one, lambda v: F.shiftleft(v, 1)), F.transform(two, lambda v: F.shiftleft(v, 1) + 1))
    df = df.withColumn(merged, F.sort_array(both))
    top_position = 1 << POSITION_BITS

    def place(v: Column) -> Column:
        return F.shiftright(v, 1).bitwiseAND(top_position - 1)

    def pair(v: Column, i: Column) -> Column:
        """Position in the first text, then the shift (made positive), of a shared hash."""
        before = F.get(F.col(merged), i - 1)
        same = (i > 0) & (F.shiftright(v, POSITION_BITS + 1) == F.shiftright(before, POSITION_BITS + 1))
        second = v.bitwiseAND(F.lit(1)) == 1
        at, other = F.when(second, place(before)).otherwise(place(v)), F.when(second, place(v)).otherwise(place(before))
        return F.when(same, F.shiftleft(at, POSITION_BITS + 1).bitwiseOR(at - other + top_position))

    df = df.withColumn(shared, F.sort_array(F.array_compact(F.transform(F.col(merged), pair))))

    def hit(v: Column, i: Column) -> Column:
        shift = lambda x: x.bitwiseAND(2 * top_position - 1)
        beside = [F.when(i + j >= 0, F.get(F.col(shared), i + j)) for j in range(-BESIDE, BESIDE + 1) if j]
        return functools.reduce(Column.__or__, [F.coalesce(F.abs(shift(v) - shift(x)) <= NEAR, F.lit(False)) for x in beside], F.size(shared) == 1)

    matches = F.size(F.filter(F.col(shared), hit))
    value = F.when(F.size(merged) > 0, 2 * matches / F.size(merged)).when(F.size(one) + F.size(two) == 0, 1.0).otherwise(0.0)
    return df.withColumn(name, value.cast("double")).drop(merged, shared)


def as_text(fingerprint: str) -> Column:
    """16 hex digits an anchor."""
    return F.array_join(F.transform(F.col(fingerprint), lambda v: F.lower(F.lpad(F.hex(v), 16, "0"))), "")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and the fingerprint of every text."""
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return with_fingerprint(df, "text", "anchors").select("doc_id", "anchors", as_text("anchors").alias("fingerprint"))


def _search(key: Column, firsts: list[int], lo: int, hi: int) -> Column:
    """Index of the last of ``firsts[lo:hi]`` that is not above ``key``, as a balanced tree of conditions."""
    if hi - lo <= 1:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(key < F.lit(firsts[mid]), _search(key, firsts, lo, mid)).otherwise(_search(key, firsts, mid, hi))


def with_successor(docs: DataFrame) -> tuple[DataFrame, Window]:
    """(rows, window): every document in a bucket of neighbours by id, with the first of the next bucket as a guest.

    Buckets are cut at quantiles of the ids (only these go to the driver, four a
    shuffle partition), so the texts are shuffled once and no window spans the
    table. Column ``guest`` marks the rows that are there only to be a successor.
    """
    spark = docs.sparkSession
    least = -(1 << 63)
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(least)).alias("key"))
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = df.agg(F.percentile_approx("key", [i / n for i in range(1, n)], max(10_000, 20 * n)).alias("cuts")).first().cuts or []
    cuts = [least, *sorted({int(c) for c in cuts} - {least})]
    found = df.groupBy(_search(F.col("key"), cuts, 0, len(cuts)).alias("bucket")).agg(F.min("key").alias("first")).collect()
    firsts = sorted(r["first"] for r in found) or [least]
    bucket = _search(F.col("key"), firsts, 0, len(firsts))
    df = df.withColumn("bucket", bucket)
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("guest"))
    guest = F.struct(F.pmod(F.col("bucket") - 1, F.lit(len(firsts))).alias("bucket"), F.lit(True).alias("guest"))
    places = F.when(F.col("key").isin(firsts), F.array(own, guest)).otherwise(F.array(own))
    df = df.withColumn("place", F.explode(places)).select("doc_id", "text", "key", "place.bucket", "place.guest", F.xxhash64("text").alias("tie"))
    return df, Window.partitionBy("bucket").orderBy("guest", "key", "tie")


def compared_with_edit(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, anchors and edited_anchors, near_edited, near_next.

    The edited text has its last half replaced by as much of the beginning of
    the next document by id (after the last: the first).
    """
    df, order = with_successor(docs)
    half = F.floor(F.col("n_chars") / 2).cast("int")
    df = df.withColumn("next_text", F.lead("text").over(order)).withColumn("n_chars", F.length("text").cast("long"))
    kept, brought = F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring(F.col("next_text"), F.lit(1), half)
    df = df.withColumn("edited", F.coalesce(F.concat(kept, brought), F.lit("")))
    df = df.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    df = with_fingerprint(with_fingerprint(df, "text", "anchors"), "edited", "edited_anchors").drop("text", "next_text", "edited")
    df = df.withColumn("next_anchors", F.lead("anchors").over(order)).where(~F.col("guest"))
    df = with_likeness(with_likeness(df, "anchors", "edited_anchors", "near_edited"), "anchors", "next_anchors", "near_next")
    return df.select("doc_id", "n_chars", "edited_sha256", "anchors", "edited_anchors", "near_edited", "near_next")

"""Operator 3: token ids in a word-aligned binary format (Simple-8b).

Format. A file set is a Parquet table (Spark commits it, so a lost executor
leaves no half file). One row is one block of whole documents:

* ``part``, ``block``: rank of the block; documents ascend through the blocks;
* ``first``: ids of the part before this block; ``n_ids``: ids in the block;
* ``doc_ids``, ``doc_lens``: the documents in the block and their id counts;
* ``words``: little-endian 64-bit words; ``marks``: for every ``MARK``-th word
  the pair (word, ids before it) as little-endian unsigned 32-bit numbers, so
  that a slice is decoded without the words before it.

A word's four high bits select how many ids of which width fill the other 60
(lowest bits first). Selector 0 is the escape: the next word is one raw 64-bit
id. The last word of a block may be filled with zeros; ``n_ids`` cuts them.

Defined cases: a null text is the empty text and gets only the end id; rows
that share a ``doc_id`` stay separate documents, ordered by text (null first);
null ids come first; an empty table gives an empty file set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from apsight.llm.common import map_documents, scratch
from apsight.llm.pieces import PieceEncoder

# Fixed values of Simple-8b: id widths and the count of ids a word then holds, by selector 1..15.
WIDTHS = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
COUNTS = np.array([120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
ESCAPE = 0
MARK = 512
#: Ids after which a block ends with the document that reaches them.
BLOCK_IDS = 1 << 16

_LIMITS = np.array([1 << int(w) for w in WIDTHS], dtype=np.uint64)
_NEED = np.searchsorted(_LIMITS, np.arange(1 << 17, dtype=np.uint64), side="right").astype(np.int8)
_STEPS = np.append(COUNTS, 1).astype(np.uint8)
_PER_SELECTOR = np.concatenate([[1], COUNTS])


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids (any unsigned 64-bit values) -> (words, marks)."""
    ids = np.ascontiguousarray(ids, dtype=np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros((0, 2), np.uint32)
    most = int(COUNTS.max())
    need = np.full(n + most, -1, np.int8)  # index of the least width that holds the id; past the end anything fits
    need[:n] = _NEED[ids] if int(ids.max()) < len(_NEED) else np.searchsorted(_LIMITS, ids, side="right")
    best = np.full(n, len(WIDTHS), np.int8)
    widest = {1: need}  # greatest need among the next 1, 2, 4, ... ids
    for k in range(len(WIDTHS) - 1, -1, -1):  # narrower widths hold more ids, so later wins
        c = int(COUNTS[k])
        p = 1
        while 2 * p <= c:
            if 2 * p not in widest:
                widest[2 * p] = np.maximum(widest[p][:-p], widest[p][p:])
            p *= 2
        w = widest[p]
        np.putmask(best, np.maximum(w[:n], w[c - p:c - p + n]) <= k, k)
    step = _STEPS[best].tobytes()
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i += step[i]
    starts = np.array(starts)
    kind = best[starts]
    place = np.cumsum(1 + (kind == len(WIDTHS))) - (1 + (kind == len(WIDTHS)))  # an escape takes two words
    words = np.zeros(int(place[-1]) + 1 + int(kind[-1] == len(WIDTHS)), np.uint64)
    padded = np.append(ids, np.zeros(int(COUNTS.max()), np.uint64))
    for k in np.unique(kind):
        which = np.flatnonzero(kind == k)
        if k == len(WIDTHS):
            words[place[which] + 1] = ids[starts[which]]
            continue
        values = padded[starts[which][:, None] + np.arange(COUNTS[k])]
        shifts = (np.arange(COUNTS[k]) * WIDTHS[k]).astype(np.uint64)
        words[place[which]] = np.bitwise_or.reduce(values << shifts, axis=1) | np.uint64((int(k) + 1) << 60)
    marks = np.stack([place[::MARK], starts[::MARK]], axis=1).astype(np.uint32)
    return words, marks


def unpack(words: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` ids of ``words``, decoded with one scatter per selector."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    for i in np.flatnonzero(selector == ESCAPE):  # a word after an escape holds an id, not a selector
        if not raw[i] and i + 1 < len(words):
            raw[i + 1] = True
    count = np.where(raw, 1, _PER_SELECTOR[selector])
    count[(selector == ESCAPE) & ~raw] = 0
    start = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), np.uint64)
    out[start[raw]] = words[raw]
    for s in np.unique(selector[~raw]):
        if s == ESCAPE:
            continue
        which = np.flatnonzero((selector == s) & ~raw)
        width, k = int(WIDTHS[s - 1]), int(COUNTS[s - 1])
        shifts = (np.arange(k) * width).astype(np.uint64)
        values = (words[which][:, None] >> shifts) & np.uint64((1 << width) - 1)
        out[(start[which][:, None] + np.arange(k)).ravel()] = values.ravel()
    return out[:n]


def unpack_slice(words: np.ndarray, marks: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Ids ``lo`` to ``hi`` (exclusive) of a block, decoded from the mark before ``lo``."""
    if hi <= lo:
        return np.zeros(0, np.uint64)
    a = int(np.searchsorted(marks[:, 1], lo, side="right")) - 1
    b = int(np.searchsorted(marks[:, 1], hi, side="left"))
    word, before = int(marks[a, 0]), int(marks[a, 1])
    end = int(marks[b, 0]) if b < len(marks) else len(words)
    return unpack(words[word:end], hi - before)[lo - before:]


BLOCK_FIELDS = [
    T.StructField("part", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("first", T.LongType()),
    T.StructField("n_ids", T.LongType()), T.StructField("doc_ids", T.ArrayType(T.LongType())),
    T.StructField("doc_lens", T.ArrayType(T.LongType())), T.StructField("words", T.BinaryType()), T.StructField("marks", T.BinaryType()),
]


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end_id: int = 0, block_ids: int = BLOCK_IDS) -> None:
    """Encode every text and write the file set to ``path`` (a shared folder), ids ascending by ``doc_id``.

    One range shuffle by ``doc_id``; a task streams its sorted rows and holds one block.
    """
    def blocks(rows: Iterator[tuple]) -> Iterator[tuple]:
        encode = PieceEncoder.cached(vocabulary)
        part, block, first = TaskContext.get().partitionId(), 0, 0
        end = np.array([end_id], "<u4").tobytes()
        held, doc_ids, lens = [], [], []

        def close():
            ids = np.frombuffer(b"".join(held), "<u4")
            words, marks = pack(ids)
            return (part, block, first, len(ids), list(doc_ids), list(lens), words.astype("<u8").tobytes(), marks.astype("<u4").tobytes())

        size = 0
        for doc_id, data in encode.rows(rows):
            data += end
            held.append(data)
            doc_ids.append(doc_id)
            lens.append(len(data) // 4)
            size += len(data) // 4
            if size >= block_ids:
                yield close()
                block, first, size = block + 1, first + size, 0
                held, doc_ids, lens = [], [], []
        if doc_ids:
            yield close()

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    map_documents(ordered, blocks, BLOCK_FIELDS, keep_id=False).write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a file set: doc_id, start (ids before it), ids (little-endian unsigned 32-bit)."""
    blocks = spark.read.schema(T.StructType(BLOCK_FIELDS)).parquet(path)
    # one row per written part: bounded by the writer's tasks, two numbers each
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = blocks.join(F.broadcast(base), "part").select((F.col("base") + F.col("first")).alias("start"), "n_ids", "doc_ids", "doc_lens", "words")

    def documents(rows: Iterator[tuple]) -> Iterator[tuple]:
        for start, n, doc_ids, lens, words in rows:
            ids = unpack(np.frombuffer(words, "<u8"), n).astype("<u4")
            at = 0
            for doc_id, length in zip(doc_ids, lens, strict=True):
                yield doc_id, start + at, ids[at:at + length].tobytes()
                at += length

    fields = [T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("ids", T.BinaryType())]
    return map_documents(placed, documents, fields, columns=("start", "n_ids", "doc_ids", "doc_lens", "words"), keep_id=False)


def token_files(spark: SparkSession, docs: DataFrame, vocabulary: str, end_id: int = 0) -> DataFrame:
    """Write the file set to a new shared folder and read it back."""
    path = scratch(spark, "token-files")
    write_token_files(docs, path, vocabulary, end_id)
    return read_token_files(spark, path)

"""Operator 7: packing token documents into sequences with a bounded set of open windows.

Each task keeps at most ``open_windows`` windows. A document's ids are cut into
pieces of a whole window and one remainder; a piece goes to the open window
that it fills best (least room left). If it fits none and all windows are open,
the fullest is emitted. The windows still open at the end of each task are
leftovers: they are few (``open_windows`` per task), are moved whole, and merged
by a second best-fit pass over groups of ``MERGE_TASKS`` tasks, so neither pass
holds more than a fixed number of windows.

Sequences are padded to ``size`` unless their length is a power of two.

Defined cases: a null or empty text is a document of the end id alone; rows that
share a ``doc_id`` are packed separately; an empty table gives no sequence.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from apsight.llm.common import map_documents, written
from apsight.llm.pieces import PieceEncoder

#: Tasks whose leftover windows are merged together (times open_windows rows at most).
MERGE_TASKS = 64


class OpenWindows:
    """Best fit over a bounded number of windows; a window is (fill, key, items)."""

    def __init__(self, size: int, limit: int):
        self.size, self.limit = size, limit
        self.order: list[tuple[int, int]] = []  # (fill, key), ascending
        self.items: dict[int, list] = {}
        self.made = 0

    def place(self, length: int, item) -> tuple[int, int, list] | None:
        """Put an item into a window; the window that had to be emitted for it, or None."""
        if length == self.size:  # fills a window of its own: no open one is in its way
            self.made += 1
            return self.size, self.made - 1, [(0, item)]
        out = None
        # fullest window with room: the last one whose fill is at most size - length
        at = bisect.bisect_right(self.order, (self.size - length, 1 << 62)) - 1
        if at >= 0:
            fill, key = self.order.pop(at)
        else:
            if len(self.order) >= self.limit:
                out = self._emit(-1)
            fill, key, self.made = 0, self.made, self.made + 1
            self.items[key] = []
        self.items[key].append((fill, item))
        if fill + length == self.size:
            full = (self.size, key, self.items.pop(key))
            if out is None:
                return full
            # both must go: put the full one back as the fullest, it is emitted by the next call or drained
            self.items[key] = full[2]
        bisect.insort(self.order, (fill + length, key))
        return out

    def _emit(self, at: int) -> tuple[int, int, list]:
        fill, key = self.order.pop(at)
        return fill, key, self.items.pop(key)

    def drain(self) -> Iterator[tuple[int, int, list]]:
        while self.order:
            yield self._emit(-1)


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole windows, then the remainder."""
    return [(s, min(size, n - s)) for s in range(0, n, size)]


PIECE_FIELDS = [
    T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType()),
    T.StructField("doc_tokens", T.LongType()), T.StructField("task", T.IntegerType()), T.StructField("window", T.LongType()),
    T.StructField("offset", T.LongType()), T.StructField("fill", T.LongType()), T.StructField("open", T.BooleanType()),
]


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 1, size: int = 2048, open_windows: int = 64) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id,
    offset, sequence_tokens, padded_to.

    The placed pieces are written once to the shared folder; leftovers are
    re-placed from their fills alone, and join the pieces by window.
    """
    def place(rows: Iterator[tuple]) -> Iterator[tuple]:
        encode = PieceEncoder.cached(vocabulary)
        end, task = np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId()
        windows = OpenWindows(size, open_windows)

        def out(window, is_open: bool):
            fill, key, items = window
            for offset, (doc_id, start, length, ids, n) in items:
                yield doc_id, start, length, ids, n, task, key, offset, fill, is_open

        for doc_id, data in encode.rows(rows):
            data += end
            n = len(data) // 4
            for start, length in cut(n, size):
                done = windows.place(length, (doc_id, start, length, data[4 * start:4 * (start + length)], n))
                if done:
                    yield from out(done, False)
        for window in windows.drain():
            yield from out(window, window[0] < size)

    pieces = written(map_documents(docs, place, PIECE_FIELDS), "packed-pieces")
    left = pieces.where("open").groupBy("task", "window").agg(F.first("fill").alias("fill"))
    key_schema = "task int, window long, sequence_id long, base long, total long"

    def merge(key: tuple, leftovers: pd.DataFrame) -> pd.DataFrame:
        rows = leftovers.sort_values(["fill", "task", "window"], ascending=[False, True, True])
        again, moved = OpenWindows(size, len(rows) + 1), []

        def take(window):
            fill, k, items = window
            for base, (task, name) in items:
                moved.append((task, name, -1 - (int(key[0]) << 32 | k), base, fill))

        for task, name, fill in rows[["task", "window", "fill"]].itertuples(index=False):
            done = again.place(int(fill), (int(task), int(name)))
            if done:
                take(done)
        for window in again.drain():
            take(window)
        return pd.DataFrame(moved, columns=["task", "window", "sequence_id", "base", "total"])

    moved = left.groupBy(F.floor(F.col("task") / MERGE_TASKS).cast("long").alias("lot")).applyInPandas(merge, key_schema)
    own = (F.col("task").cast("long") * (1 << 32)) + F.col("window")
    closed = pieces.where(~F.col("open")).withColumns({"sequence_id": own, "base": F.lit(0).cast("long"), "total": F.col("fill")})
    # only leftovers are shuffled: at most open_windows windows a task
    reopened = pieces.where("open").join(moved, ["task", "window"])
    joined = closed.unionByName(reopened, allowMissingColumns=True)
    power = F.col("total").bitwiseAND(F.col("total") - 1) == 0
    return joined.select("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", (F.col("offset") + F.col("base")).alias("offset"),
                         F.col("total").alias("sequence_tokens"), F.when(power, F.col("total")).otherwise(F.lit(size).cast("long")).alias("padded_to"))

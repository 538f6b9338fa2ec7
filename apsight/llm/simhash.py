"""Operator 10: near-duplicate documents by SimHash, found with Golay-code keys.

Fingerprints of all texts are reduced to their distinct values. Two values link
if they differ in at most four of 64 bits. The bits are cut into segments of 22,
21 and 21 and each segment, filled with zeros to 23, is decoded by the binary
Golay code, whose balls of radius 3 tile the space: a segment has one nearest
codeword and, if that lies at distance 3, five more at distance 4. Which keys
find every link (errors per segment, four in all):

* the two segments with the fewest errors have at most (1, 1), except for
  (0, 2, 2). With at most one error a value's nearest codeword lies within 4 of
  its partner, so one side stores its nearest codewords for each pair of
  segments (``index``) and the other asks for all within 4 (``probe``);
* for (0, 2, 2): halfway between two values two bits apart lies a third whose
  nearest codeword is within 4 of both, so both list all codewords within 4 of
  one segment beside the exact bits of another.

Values that share a key are compared, and each key yields the edges of a
spanning forest of its true links, never all pairs. A run longer than
``RUN_ROWS`` is not held: its rows go on in numbered chunks, and every pair of
chunks is compared by a task of its own. Components come from rounds of
large-star and small-star steps over written edge tables.

Defined cases: a null text is the empty text; texts without words have
fingerprint zero and link like any other; null ids are the smallest id only
where no other exists (they are not counted by ``min``); rows that share a
``doc_id`` each get a row; an empty table gives none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from apsight.llm.common import WORD, map_documents, ship, written

SEED = 42
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # (first bit, bits)
RUN_ROWS = 1 << 14
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
_WORDS = re.compile(WORD)


# ---- fingerprints -------------------------------------------------------------------------------------------------

def fingerprint(text: str | None, shingle: int = 4) -> int:
    """A bit is 1 if it is set in more than half of the shingles' hashes (repeats count)."""
    import xxhash

    words = _WORDS.findall((text or "").translate(_LOWER))
    if not words:
        return 0
    joined = " ".join(words).encode()
    plain = len(joined) == sum(map(len, words)) + len(words) - 1
    ends = np.cumsum([len(w if plain else w.encode()) + 1 for w in words])
    k = min(shingle, len(words))
    starts = [0, *ends[: len(words) - k].tolist()]
    digest = xxhash.xxh64_intdigest
    sums, n = np.zeros(64, np.int64), len(words) - k + 1
    stops = (ends[k - 1:] - 1).tolist()
    for at in range(0, n, 1 << 14):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at:at + (1 << 14)], stops[at:at + (1 << 14)], strict=True)], "<u8")
        sums += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * sums > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id, text_hash (Spark's xxhash64 of the text) and the 64-bit fingerprint (as a signed long)."""
    def rows(source: Iterator[tuple]) -> Iterator[tuple]:
        import xxhash

        for doc_id, text in source:
            same = SEED if text is None else xxhash.xxh64_intdigest(text.encode(), SEED)
            yield doc_id, _signed(same), _signed(fingerprint(text, shingle))

    return map_documents(docs, rows, [T.StructField("text_hash", T.LongType()), T.StructField("fp", T.LongType())])


def _signed(x: int) -> int:
    return x - (x >> 63 << 64)


# ---- Golay keys ---------------------------------------------------------------------------------------------------

_GENERATOR = 0b110001110101  # fixed value: a generator polynomial of the binary Golay code of length 23


def _remainder(v: np.ndarray) -> np.ndarray:
    """Syndrome of 23-bit words: the remainder by the generator polynomial."""
    v = v.astype(np.int64).copy()
    for bit in range(22, 10, -1):
        v ^= np.where(v >> bit & 1, _GENERATOR << (bit - 11), 0)
    return v


class Golay:
    """For each of the 2048 syndromes the error patterns of weight up to 4: one, or one of weight 3 and five of weight 4."""

    def __init__(self):
        bits = 1 << np.arange(23)
        two = np.array([a | b for i, a in enumerate(bits) for b in bits[i + 1:]])
        low = np.concatenate([[0], bits, two])
        three = np.unique([p | b for p in two.tolist() for b in bits.tolist() if not p & b])
        four = np.unique([p | q for i, p in enumerate(two.tolist()) for q in two.tolist()[i + 1:] if not p & q])
        self.nearest = np.zeros(2048, np.int64)
        for patterns in (low, three):
            self.nearest[_remainder(patterns)] = patterns
        s = _remainder(four)
        order = np.argsort(s, kind="stable")
        self.count = np.bincount(s, minlength=2048)  # 0 or 5
        self.first = np.cumsum(self.count) - self.count
        self.further = four[order]

    def index(self, v: np.ndarray) -> np.ndarray:
        """The number (upper 12 bits) of the nearest codeword."""
        return (v ^ self.nearest[_remainder(v)]) >> 11

    def lists(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, number) of every codeword within 4 of each word."""
        s = _remainder(v)
        more = self.count[s]
        rows = np.repeat(np.arange(len(v)), more)
        at = np.arange(len(rows)) - np.repeat(np.cumsum(more) - more, more) + np.repeat(self.first[s], more)
        return np.concatenate([np.arange(len(v)), rows]), np.concatenate([v ^ self.nearest[s], v[rows] ^ self.further[at]]) >> 11


_golay: list[Golay] = []


def golay() -> Golay:
    if not _golay:
        _golay.append(Golay())
    return _golay[0]


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, row, probe?) of distinct fingerprints: every pair within four bits shares a key, where one of the two
    is an index row, or the kind of key has index rows only."""
    code = golay()
    parts = [((fps >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    near = [code.index(p) for p in parts]
    lists = [code.lists(p) for p in parts]
    keys, rows, probes = [], [], []
    for kind, (a, b) in enumerate(((0, 1), (0, 2), (1, 2))):
        keys.append(near[a] << 12 | near[b] | kind << 56)
        rows.append(np.arange(len(fps)))
        probes.append(np.zeros(len(fps), bool))
        (ra, ca), (rb, cb) = lists[a], lists[b]
        order = np.argsort(rb, kind="stable")
        per = np.bincount(rb, minlength=len(fps))
        begin = np.cumsum(per) - per
        ia = np.repeat(np.arange(len(ra)), per[ra])  # all combinations of the two lists of a row
        ib = order[np.arange(len(ia)) - np.repeat(np.cumsum(per[ra]) - per[ra], per[ra]) + np.repeat(begin[ra], per[ra])]
        k = ca[ia] << 12 | cb[ib] | kind << 56
        new = k != keys[-1][ra[ia]]  # the index row itself is there already
        keys.append(k[new])
        rows.append(ra[ia][new])
        probes.append(np.ones(int(new.sum()), bool))
    for kind, (exact, listed) in enumerate(((0, 1), (1, 2), (2, 0)), start=3):
        r, c = lists[listed]
        keys.append(parts[exact][r] << 12 | c | kind << 56)
        rows.append(r)
        probes.append(np.zeros(len(r), bool))
    return np.concatenate(keys), np.concatenate(rows), np.concatenate(probes)


# ---- links within a key -------------------------------------------------------------------------------------------

def forest(left: np.ndarray, right: np.ndarray | None, bits: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among ``left`` (or between ``left`` and ``right``).

    Breadth first over the values not yet reached: a value is compared only with
    those, so a dense group costs about one pass over it.
    """
    values = np.unique(left if right is None else np.concatenate([left, right])).astype(np.uint64)
    if right is None:
        sides = np.full(len(values), 3, np.int8)
    else:
        sides = (np.isin(values, left) + 2 * np.isin(values, right)).astype(np.int8)
    edges: list[tuple[int, int]] = []
    rest = np.arange(len(values))
    while len(rest) > 1:
        front, rest = [int(rest[0])], rest[1:]
        while front and len(rest):
            v = front.pop()
            hit = np.bitwise_count(values[rest] ^ values[v]) <= bits
            if right is not None:
                hit &= (sides[rest] | sides[v]) == 3
            if hit.any():
                new = rest[hit].tolist()
                edges += [(int(values[v]), int(values[u])) for u in new]
                front += new
                rest = rest[~hit]
    return edges


EDGE = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()),
                     T.StructField("key", T.LongType()), T.StructField("chunk", T.IntegerType())])


def _edges(runs: Iterator[tuple[int, np.ndarray, np.ndarray]], bits: int) -> Iterator[tuple]:
    """Rows of EDGE of short runs: links (key null)."""
    for _, fps, probe in runs:
        if probe.all() or len(fps) < 2:
            continue
        for a, b in forest(fps, None, bits):
            yield _signed(a), _signed(b), None, None


def links(fps: DataFrame, bits: int = 4, run_rows: int = RUN_ROWS) -> DataFrame:
    """Edges (a, b) of distinct fingerprints ``fps.fp`` that connect whatever is linked within ``bits`` (at most 4)."""
    if bits > 4:
        raise ValueError("the keys find links of at most four bits")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1 << 12):  # about 100 keys a value
                v = batch.slice(at, 1 << 12).column(0).to_numpy(zero_copy_only=False)
                key, row, probe = keys_of(v.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(v[row]), pa.array(probe)], names=["key", "fp", "probe"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held, long_run = None, [], 0  # rows of the run that the last batch ended in

        def rows(key, fp, probe) -> Iterator[tuple]:
            nonlocal held_key, held, long_run
            cuts = np.flatnonzero(np.diff(key)) + 1
            begin = np.concatenate([[0], cuts]) if len(key) else np.zeros(0, int)
            end = np.concatenate([cuts, [len(key)]]) if len(key) else begin
            size = end - begin
            # inner runs with one value or without an index row cannot link: dropped at once
            able = (size > 1) & ~np.logical_and.reduceat(probe, begin)
            able[[0, -1]] = True
            for i in np.flatnonzero(able).tolist():
                a, b = int(begin[i]), int(end[i])
                if held_key != key[a]:
                    yield from flush()
                    held_key = key[a]
                held.append((fp[a:b], probe[a:b]))
                if long_run or sum(len(x) for x, _ in held) > run_rows:
                    yield from overflow(False)

        def overflow(last: bool) -> Iterator[tuple]:
            nonlocal held, long_run
            f = np.concatenate([x for x, _ in held]) if held else np.zeros(0, np.int64)
            while len(f) >= run_rows or last and len(f):
                for v in f[:run_rows].tolist():
                    yield v, None, int(held_key), long_run
                long_run += 1
                f = f[run_rows:]
            held = [(f, np.zeros(len(f), bool))] if len(f) else []
            long_run = max(long_run, 1)

        def flush() -> Iterator[tuple]:
            nonlocal held, long_run, held_key
            if long_run:
                yield from overflow(True)
            elif held:
                f, p = (np.concatenate(x) for x in zip(*held, strict=True))
                yield from _edges(iter([(held_key, f.view(np.uint64), p)]), bits)
            held, long_run, held_key = [], 0, None

        def out(found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
            from itertools import batched

            from pyspark.sql.pandas.types import to_arrow_schema

            arrow = to_arrow_schema(EDGE)
            for some in batched(found, 1 << 14):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), arrow, strict=True)], schema=arrow)

        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if batch.num_rows:
                yield from out(rows(*cols))
        yield from out(flush())

    ship(fps.sparkSession)
    # a value becomes a hundred rows: a fixed number of tasks, not one by the size of the values
    spread = fps.select("fp").repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    rows = spread.mapInArrow(keyed, "key long, fp long, probe boolean")
    sorted_rows = rows.repartition("key").sortWithinPartitions("key")
    found = written(sorted_rows.mapInArrow(compared, EDGE), "simhash-edges")
    short = found.where("key is null").select("a", "b")
    return short.unionByName(_long_runs(found, bits)).distinct()


def _long_runs(found: DataFrame, bits: int) -> DataFrame:
    """Links of the runs that were too long for one task: each pair of their chunks is a group of its own."""
    chunks = found.where("key is not null").select("key", "chunk", F.col("a").alias("fp"))
    most = chunks.groupBy("key").agg(F.max("chunk").alias("most"))
    other = F.explode(F.sequence(F.lit(0), F.col("most"))).alias("other")
    paired = chunks.join(most, "key").select("key", "chunk", "fp", other).select(
        "key", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), (F.col("chunk") <= F.col("other")).alias("in_i"),
        (F.col("chunk") >= F.col("other")).alias("in_j"), "fp")

    def compare(table: pa.Table) -> pa.Table:
        fp = table["fp"].to_numpy().view(np.uint64)
        a, b = table["in_i"].to_numpy(zero_copy_only=False), table["in_j"].to_numpy(zero_copy_only=False)
        same = bool((a & b).all())
        edges = [(_signed(x), _signed(y)) for x, y in forest(fp[a], None if same else fp[b], bits)]
        return pa.table({"a": pa.array([x for x, _ in edges], pa.int64()), "b": pa.array([y for _, y in edges], pa.int64())})

    return paired.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long")


# ---- components ---------------------------------------------------------------------------------------------------

def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node that it reaches.

    Alternating large-star and small-star steps; each step's edges are written to
    the shared folder, and it ends when a round leaves them as they were.
    """
    both = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "star")
    state = None
    for _ in range(rounds):
        # large star: every larger neighbour of a node links to the smallest of the node and its neighbours
        around = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = around.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = around.where("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a node and its smaller neighbours link to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
        small = large.join(least, F.col("a") == F.col("n"))
        both = written(small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
                       .unionByName(least.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct(), "star")
        now = tuple(both.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    roots = both.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(both.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicates(docs: DataFrame, shingle: int = 4, bits: int = 4) -> DataFrame:
    """doc_id, text_hash, fp (signed long), root (smallest linked fingerprint) and component_id (smallest doc_id
    reachable) for every row of ``docs``."""
    fps = written(fingerprints(docs, shingle), "simhash")
    firsts = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-values")
    roots = components(links(firsts, bits))
    best = firsts.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = best.groupBy("root").agg(F.min("first").alias("component_id"))
    found = best.join(least, "root").select(F.col("fp").alias("value"), "root", "component_id")
    return fps.join(found, F.col("fp") == F.col("value")).select("doc_id", "text_hash", "fp", "root", "component_id")


def keep_one(docs: DataFrame, shingle: int = 4, bits: int = 4) -> DataFrame:
    """The rows of ``docs`` of which each component keeps one, with all their columns: that of the smallest doc_id
    (null only where no other exists), of several such the one of the least hash of its text, of equal rows one."""
    found = written(near_duplicates(docs, shingle, bits), "simhash-groups")
    smallest = F.col("doc_id").eqNullSafe(F.col("component_id"))
    able = found.where(smallest)  # one row of each component, unless ids repeat or are null
    several = written(able.groupBy("root").agg(F.min("text_hash").alias("least"), F.count("*").alias("n")).where("n > 1"), "simhash-several")
    tied = able.join(several, "root")
    key = [F.col("doc_id").alias("one__id"), F.col("text_hash").alias("one__hash")]
    gone = found.where(~smallest).select(*key).unionByName(tied.where("text_hash <> least").select(*key)).distinct()
    same = docs["doc_id"].eqNullSafe(F.col("one__id")) & (F.xxhash64(docs["text"]) == F.col("one__hash"))
    kept = docs.join(gone, same, "left_anti")
    repeats = written(tied.where("text_hash = least").select(*key).distinct(), "simhash-repeats")
    if repeats.isEmpty():
        return kept
    again = kept["doc_id"].eqNullSafe(F.col("one__id")) & (F.xxhash64(kept["text"]) == F.col("one__hash"))
    return kept.join(repeats, again, "left_anti").unionByName(kept.join(repeats, again, "left_semi").dropDuplicates(["doc_id", "text"]))

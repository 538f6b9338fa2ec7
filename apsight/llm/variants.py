"""Operator 11: spelling variants of the words of a corpus by a dictionary of trie node pairs.

Words are the maximal runs of ``[A-Za-z\\u00C0-\\u00FF]`` of whole texts, A-Z
lower-cased (a 199th of the occurrences has a letter deleted by the contract),
of at least six code points and five occurrences. Two are near if they differ by
exactly one inserted, deleted or replaced code point.

The words are the paths of a trie, and read backwards those of a second one. All
nodes of both are numbered, so that a number stands for one prefix or one suffix.
A word gives a pair (prefix node, suffix node) for each of its positions skipped
and for each place where a letter could be inserted. Then exactly:

* words that skip to the same pair differ by one replaced letter;
* a word whose gap has the pair that another skips to lacks that letter. A
  letter can be skipped in several places of ``aa``; only the first counts.

Words that skip to one pair differ in one letter, so a pair has at most as many
as the alphabet (90), and at most one gap (the word without the letter). Each
word of a pair learns the number of its near words there and the best of them:
no pairs of words are listed.

**Numbering.** Words are cut into ranges at a sample of words chosen by hash (the
bounds: about ``PARTS`` a shuffle partition, sent to every task). A task walks its
sorted range; a prefix that it shares with the word before has a number, others
get a new one. A prefix that two ranges share is a prefix of the bound between
them: prefixes of bounds have numbers of their own, the same in every task.

A word's form is its near word of largest n (ties: smallest in code-point order)
if that n is at least five times its own, so forms ascend and end in a root,
found by pointer doubling.

Defined cases: a null text has no words; a null doc_id is named by nothing before
the colon; rows that share a ``doc_id`` count each; texts and words of any length
are taken whole (a word's work grows with its length, not the square); other
columns are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterable, Iterator

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from apsight.llm.common import map_documents, written

LEAST_LENGTH = 6
LEAST_COUNT = 5
#: A form has at least so many times the occurrences.
FORM_FACTOR = 5
#: Ranges of words for each shuffle partition.
PARTS = 4
_UPPER, _LOWER = (bytes(range(a, a + 26)).decode() for a in (65, 97))
_GAP, _SKIP, _FIRST = 0, 1, 2  # roles of a word in a pair: gap, skipped letter, first skipped letter of a run of equal ones


# ---- words --------------------------------------------------------------------------------------------------------

def occurrences(docs: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """word: every occurrence of at least ``least_length`` code points, after the contract's deletions."""
    runs = F.regexp_extract_all("text", F.lit(f"([A-Za-zÀ-ÿ]{{{least_length},}})"), F.lit(1))
    run = docs.select("doc_id", F.explode(runs).alias("run")).select("doc_id", F.translate("run", _UPPER, _LOWER).alias("run"))
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run"))
    h = F.crc32(name.cast("binary"))
    at = (h % F.length("run")).cast("int")
    less = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    return run.select(F.when(h % 199 == 0, less).otherwise(F.col("run")).alias("word")).where(F.length("word") >= least_length)


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n."""
    return occurrences(docs, least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


# ---- trie nodes ---------------------------------------------------------------------------------------------------

def shared(a: str, b: str) -> int:
    """Length of the common prefix."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    step = 8  # words part early: gallop, then halve
    while low + step < high and a[low:low + step] == b[low:low + step]:
        low, step = low + step, 2 * step
    high = min(high, low + step)
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def trie_nodes(words: Iterable[str], first: int, bounds: list[str] = (), bound_nodes: list[list[int]] = ()) -> Iterator[list[int]]:
    """For each of the ascending ``words``: the numbers of its prefixes of length 0, 1, ... New ones count up from ``first``."""
    before, nodes = "", []
    for word in words:
        same = nodes[:shared(before, word) + 1]
        at = bisect.bisect_right(bounds, word)
        for i in (at - 1, at):  # the longest prefix shared with any bound is shared with a neighbour
            if 0 <= i < len(bounds) and (k := shared(bounds[i], word) + 1) > len(same):
                same = bound_nodes[i][:k]
        new = len(word) + 1 - len(same)
        before, nodes = word, same + list(range(first, first + new))
        first += new
        yield nodes


def numbered(words: DataFrame, least_rows: int | None = None) -> DataFrame:
    """Rows (key, carried) of distinct keys -> place (ascends with key), carried, nodes (numbers of the key's
    prefixes of length 0, 1, ...) and first (per letter: unlike the one before?)."""
    spark = words.sparkSession
    wanted = PARTS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    step = max(words.count() // wanted, 1) if least_rows is None else least_rows
    # about `wanted` words, whatever the size of the vocabulary
    bounds = sorted(r.key for r in words.where(F.pmod(F.xxhash64("key"), F.lit(step)) == 0).select("key").collect())

    def ranged(rows: Iterator[tuple]) -> Iterator[tuple]:
        for key, carried in rows:
            yield bisect.bisect_right(bounds, key), key, carried

    def walk(rows: Iterator[tuple]) -> Iterator[tuple]:
        bound_nodes = list(trie_nodes(bounds, 1 << 62))
        part, at, held = None, 0, []

        def keys() -> Iterator[str]:
            for row in rows:
                held.append(row)
                yield row[1]

        for nodes in trie_nodes(keys(), TaskContext.get().partitionId() + 1 << 40, bounds, bound_nodes):
            of, key, carried = held.pop()
            part, at = of, at + 1 if of == part else 0
            yield of << 40 | at, carried, nodes, [i == 0 or key[i - 1] != c for i, c in enumerate(key)]

    carried = T.StructField("carried", words.schema["carried"].dataType)
    cut = map_documents(words, ranged, [T.StructField("part", T.LongType()), T.StructField("key", T.StringType()), carried], columns=("key", "carried"), keep_id=False)
    ordered = cut.repartition("part").sortWithinPartitions("part", "key")
    fields = [T.StructField("place", T.LongType()), carried, T.StructField("nodes", T.ArrayType(T.LongType())), T.StructField("first", T.ArrayType(T.BooleanType()))]
    return map_documents(ordered, walk, fields, columns=("part", "key", "carried"), keep_id=False)


# ---- near words ---------------------------------------------------------------------------------------------------

def node_pairs(tries: DataFrame) -> DataFrame:
    """(prefix, suffix, member) of words (place, n, forward, backward, first): a row per letter and per gap."""
    length = F.size("first")

    def pair(i: Column, suffix: Column, role: Column) -> Column:
        member = F.struct((-F.col("n")).alias("less"), F.col("place"), role.alias("role"))
        return F.struct(F.get("forward", i).alias("prefix"), F.get("backward", suffix).alias("suffix"), member.alias("member"))

    skips = F.transform(F.sequence(F.lit(0), length - 1), lambda i: pair(i, length - 1 - i, F.when(F.get("first", i), _FIRST).otherwise(_SKIP)))
    gaps = F.transform(F.sequence(F.lit(0), length), lambda i: pair(i, length - i, F.lit(_GAP)))
    return tries.select(F.explode(F.concat(skips, gaps)).alias("pair")).select("pair.*")


def near_words(pairs: DataFrame) -> DataFrame:
    """place, n_near, and best (less = -n, place) of the words that have near ones. A pair has at most 91 members."""
    met = pairs.groupBy("prefix", "suffix").agg(F.sort_array(F.collect_list("member")).alias("all")).where(F.size("all") > 1)
    parted = met.select("all", F.filter("all", lambda m: m["role"] != _GAP).alias("skips"), F.filter("all", lambda m: m["role"] == _FIRST).alias("firsts"),
                        F.get(F.filter("all", lambda m: m["role"] == _GAP), F.lit(0)).alias("gap"))

    def plain(m: Column) -> Column:
        return F.when(m.isNotNull(), F.struct(m["less"].alias("less"), m["place"].alias("place")))

    def learned(m: Column) -> Column:
        top = F.get("skips", F.lit(0))
        other = F.when(top["place"] == m["place"], F.get("skips", F.lit(1))).otherwise(top)
        shorter = F.when(m["role"] == _FIRST, F.col("gap"))
        n = F.when(m["role"] == _GAP, F.size("firsts")).otherwise(F.size("skips") - 1 + shorter.isNotNull().cast("int"))
        best = F.when(m["role"] == _GAP, plain(F.get("firsts", F.lit(0)))).otherwise(F.least(plain(other), plain(shorter)))
        return F.struct(m["place"].alias("place"), n.alias("n"), best.alias("best"))

    each = parted.select(F.explode(F.transform("all", learned)).alias("x")).select("x.*").where("n > 0")
    return each.groupBy("place").agg(F.sum("n").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(place, root) of forms (place, form), whose chains end: pointers are doubled until none leads on."""
    now = written(forms.select("place", F.col("form").alias("root")), "variant-roots")
    while True:
        on = now.select(F.col("place").alias("next__place"), F.col("root").alias("next__root"))
        led = now.join(on, F.col("root") == F.col("next__place"), "left")
        after = written(led.select("place", F.coalesce("next__root", "root").alias("root"), F.col("next__root").isNotNull().alias("on")), "variant-roots")
        now = after.select("place", "root")
        if after.where("on").isEmpty():
            return now


def spelling_variants(docs: DataFrame, factor: int = FORM_FACTOR, least_rows: int | None = None) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of ``docs``. ``least_rows`` sets the words between bounds (tests)."""
    words = written(vocabulary(docs), "variant-words")
    forward = numbered(words.select(F.col("word").alias("key"), F.struct("word", "n").alias("carried")), least_rows)
    forward = written(forward.select("place", "carried.*", F.col("nodes").alias("forward"), "first"), "variant-forward")
    listed = forward.select("place", "word", "n")
    backward = numbered(listed.select(F.reverse("word").alias("key"), F.col("place").alias("carried")), least_rows)
    tries = forward.join(backward.select(F.col("carried").alias("place"), F.col("nodes").alias("backward")), "place")
    near = written(near_words(node_pairs(tries)), "variant-near")
    judged = written(listed.join(near, "place", "left").select(
        "place", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(-F.col("best.less") >= factor * F.col("n"), F.col("best")).alias("best")), "variant-forms")
    ends = roots(judged.where("best is not null").select("place", F.col("best.place").alias("form")))

    def named(c: str) -> DataFrame:
        return listed.select(F.col("place").alias(f"{c}__place"), F.col("word").alias(c))

    return (judged.join(ends, "place", "left").join(named("form"), F.col("best.place") == F.col("form__place"), "left")
            .join(named("root_word"), F.col("root") == F.col("root_word__place"), "left")
            .select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", (-F.col("best.less")).alias("form_n")))

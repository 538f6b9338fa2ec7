"""Operator 1: quality rules as a short-circuit cascade.

Every rule is a test on a document's lazily computed measures. On a bounded
sample each rule is timed alone and its share of rejections is counted; the
rules then run in the order of rejections per second, and a document stops at
the first that rejects it. The verdict is the conjunction, so the order changes
the work, never the result. The sample is the first rows of the table: it only
decides the order.

Defined cases: a null or empty text has no words and fails ``few_words``; equal
rows are judged alike; an empty table gives no rows and keeps the written order.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from apsight.llm.common import WORD, map_documents, ship

_WORDS = re.compile(WORD)
_VISIBLE = re.compile(r"[^\x20\x09-\x0D]")
_CAPITALS = re.compile(r"[A-Z]+")
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Bounds of the sample that orders the rules: rows, and code points of a row.
SAMPLE_ROWS, SAMPLE_CHARS = 200, 100_000


class Measures:
    """Measures of one text, each computed when a rule first asks for it."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[str]:
        return _WORDS.findall(self.text)

    @cached_property
    def word_chars(self) -> int:
        return sum(map(len, self.words))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        return [line for line in self.text.split("\n") if _VISIBLE.search(line)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside windows of five words that occur twice or more in the text."""
        words = self.words
        windows = list(zip(*(words[i:] for i in range(WINDOW)), strict=False))
        if len(set(windows)) == len(windows):
            return 0
        times = Counter(windows)
        covered, until = 0, 0
        for i, w in enumerate(windows):
            if times[w] > 1:
                covered += i + WINDOW - max(i, until)
                until = i + WINDOW
        return covered

    @cached_property
    def n_capitals(self) -> int:
        return sum(map(len, _CAPITALS.findall(self.text)))


@dataclass(frozen=True)
class Rule:
    """``rejects(measures)``; ``base`` rules are those of the contract."""

    name: str
    rejects: Callable[[Measures], bool]
    base: bool = False


RULES = (
    Rule("few_words", lambda m: len(m.words) < 10, True),
    Rule("repeated_passages", lambda m: 100 * m.n_repeat_words > 20 * len(m.words), True),
    Rule("symbols", lambda m: 10 * m.n_symbols > len(m.words)),
    Rule("duplicate_lines", lambda m: 2 * m.n_dup_lines > len(m.lines)),
    Rule("capitals", lambda m: 2 * m.n_capitals > m.word_chars),
    Rule("word_length", lambda m: not 2 * len(m.words) <= m.word_chars <= 20 * len(m.words)),
)


def order_rules(texts: list[str | None], rules: tuple[Rule, ...] = RULES) -> list[Rule]:
    """Rules by rejections per second on the sample, most first; a tie keeps the given order."""
    if not texts:
        return list(rules)
    score = {}
    for rule in rules:
        began = time.perf_counter()
        rejected = sum(rule.rejects(Measures(t)) for t in texts)
        score[rule.name] = rejected / max(time.perf_counter() - began, 1e-9)
    return sorted(rules, key=lambda r: -score[r.name])


def sample(docs: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> list[str | None]:
    return [r.text for r in docs.select("text").where((F.length("text") <= chars) | F.col("text").isNull()).limit(rows).collect()]


def first_failed(measures: Measures, rules: list[Rule]) -> str | None:
    """Name of the first rule that rejects; the rest are not evaluated."""
    return next((r.name for r in rules if r.rejects(measures)), None)


def cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with all their columns."""
    ship(docs.sparkSession)
    ordered, at = order_rules(sample(docs), rules), docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                yield part.filter(pa.array([first_failed(Measures(t), ordered) is None for t in part.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the base measures, base_failed and kept for every row.

    ``kept`` runs the cascade; the measures that the report needs are computed
    beside it for every document.
    """
    ordered = order_rules(sample(docs), rules)
    base = {r.name for r in rules if r.base}

    def rows(source: Iterator[tuple]) -> Iterator[tuple]:
        extra = [r for r in ordered if r.name not in base]
        for doc_id, text in source:
            m = Measures(text)
            failed = any(r.rejects(m) for r in ordered if r.name in base)
            kept = not failed and first_failed(m, extra) is None
            yield doc_id, len(m.words), m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words, failed, kept

    longs = [T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return map_documents(docs, rows, [*longs, T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())])

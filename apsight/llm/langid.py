"""Operator 8: language identification by a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time on a bounded
sample of labelled rows: ``PER_LANG`` documents of each language (least hashes
of the id), of each one stretch of ``STRETCH`` code points at a hashed place.
It labels every byte of every text, in windows of ``WINDOW`` bytes, and a
document's probability of a language is the mean over all its bytes.

Defined cases: null texts and texts without a letter are ``und`` with score 0;
so is everything if no labelled row can be learned from. Only ``text`` is an
input of a prediction. Rows that share a ``doc_id`` each get a row. An empty
table gives none.
"""

from __future__ import annotations

import functools
import itertools
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from apsight.llm.common import held_out, map_documents, ship
from apsight.llm.recurrent import GRU, Adam, Bidirectional

#: Languages that are learned, at most; more raise.
MOST_LANGS = 1000
#: Bounds of the training sample: documents of each language, code points of each.
PER_LANG, STRETCH = 500, 1024
#: Parts of the hash range from which the sample is drawn.
PLACES = 1 << 40
HIDDEN, WINDOW = 8, 128
#: Windows that go through the network together.
TOGETHER = 1024
TRAIN_STEPS, TRAIN_WINDOWS, TRAIN_LENGTH = 500, 192, 32
UNKNOWN = "und"


class Model:
    """A trained network and its languages; small enough to travel with each task."""

    def __init__(self, langs: list[str], net: Bidirectional):
        self.langs, self.net = langs, net

    def pooled(self, texts: list[str]) -> np.ndarray:
        """Mean probability of each language over the bytes of each text: (texts, languages)."""
        data = [np.frombuffer(t.encode(), np.uint8) for t in texts]
        sums = np.zeros((len(texts), len(self.langs)))
        count = [-(-len(d) // WINDOW) for d in data]
        owner = np.repeat(np.arange(len(texts)), count)
        padded = np.zeros((len(owner), WINDOW), np.uint8)
        at = 0
        for d, k in zip(data, count, strict=True):
            padded[at:at + k].reshape(-1)[: len(d)] = d
            at += k
        size = np.array([len(d) for d in data])
        first = np.cumsum(count) - count
        used = np.minimum(WINDOW, size[owner] - (np.arange(len(owner)) - first[owner]) * WINDOW)
        for lo in range(0, len(owner), TOGETHER):
            hi = min(lo + TOGETHER, len(owner))
            s = self.net.scores(np.ascontiguousarray(padded[lo:hi].T))
            s -= s.max(axis=1, keepdims=True)
            np.exp(s, out=s)
            s /= s.sum(axis=1, keepdims=True)
            if (used[lo:hi] < WINDOW).any():
                s *= (np.arange(WINDOW)[:, None] < used[None, lo:hi])[:, None, :]
            by_window = s.sum(axis=0, dtype=np.float64)
            for c in range(len(self.langs)):
                sums[:, c] += np.bincount(owner[lo:hi], by_window[c], minlength=len(texts))
        return sums / np.maximum(size, 1)[:, None]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        able = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        if able and self.langs:
            p = self.pooled([texts[i] for i in able])
            for i, c in zip(able, p.argmax(axis=1).tolist(), strict=True):
                out[i] = (self.langs[c], 0.0)
            for i, v in zip(able, p.max(axis=1).tolist(), strict=True):
                out[i] = (out[i][0], min(1.0, v))
        return out


def train(samples: list[tuple[str, str]], seed: int = 7) -> Model:
    """A model from (language, text) pairs; languages in alphabetical order, drawn equally often."""
    langs = sorted({lang for lang, text in samples if text})
    rng = np.random.default_rng(seed)
    net = Bidirectional(GRU, 256, HIDDEN, max(len(langs), 1), rng)
    if len(langs) < 2:
        return Model(langs, net)
    # texts of a language in one strip of bytes, sorted so that the row order of the sample does not matter
    strips = [np.frombuffer("\n".join(sorted(t for k, t in samples if k == lang and t)).encode(), np.uint8) for lang in langs]
    strips = [np.resize(s, max(len(s), TRAIN_LENGTH + 1)) for s in strips]
    adam = Adam(net.parameters(), 0.02)
    for step in range(TRAIN_STEPS):
        label = rng.integers(len(langs), size=TRAIN_WINDOWS)
        steps = np.stack([strips[k][(a := rng.integers(len(strips[k]) - TRAIN_LENGTH)):a + TRAIN_LENGTH] for k in label], axis=1)
        scores, kept = net.forward(steps)
        p = np.exp(scores - scores.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[:, label, np.arange(TRAIN_WINDOWS)] -= 1
        adam.step(net.backward(steps, kept, p / p[:, 0].size), scale=1 - 0.9 * step / TRAIN_STEPS)
    return Model(langs, net)


def training_rows(docs: DataFrame, per_lang: int = PER_LANG, stretch: int = STRETCH) -> list[tuple[str, str]]:
    """(language, stretch of text) of the sample; never of held-out documents."""
    able = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id")).select("doc_id", "lang")
    place = F.pmod(F.xxhash64("doc_id"), F.lit(PLACES))
    counts = {r.lang: r["count"] for r in able.groupBy("lang").count().limit(MOST_LANGS + 1).collect()}
    if len(counts) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages to learn")
    # about twice as many as needed by a share of the hash range, so that no task ranks a language
    shares = [(F.col("lang") == lang) & (place < min(PLACES, max(1, 2 * per_lang * PLACES // n))) for lang, n in counts.items()]
    if not shares:
        return []
    near = sorted((r.lang, r.place, r.doc_id) for r in able.where(functools.reduce(operator.or_, shares)).select("lang", place.alias("place"), "doc_id").distinct().collect())
    chosen = [r[2] for _, some in itertools.groupby(near, key=lambda r: r[0]) for r in itertools.islice(some, per_lang)]
    if not chosen:
        return []
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(1)), F.greatest(F.length("text") - stretch, F.lit(1)).cast("long")) + 1
    part = F.substring(F.col("text"), place.cast("int"), F.lit(stretch))
    rows = docs.where(F.col("doc_id").isin(chosen) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    one = rows.select("lang", "doc_id", part.alias("part")).groupBy("lang", "doc_id").agg(F.min("part").alias("part"))  # however often an id repeats
    return [(r.lang, r.part) for r in one.collect() if any(map(str.isalpha, r.part))]


def _sized(texts: Iterator, size: int = 1 << 19) -> Iterator[list]:
    held, n = [], 0
    for x in texts:
        held.append(x)
        n += len(x[-1] or "")
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    model = model or train(training_rows(docs))

    def rows(source: Iterator[tuple]) -> Iterator[tuple]:
        for group in _sized(source):
            for (doc_id, _), (lang, score) in zip(group, model.predict([t for _, t in group]), strict=True):
                yield doc_id, lang, score

    return map_documents(docs, rows, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def keep_identified(docs: DataFrame, least: float = 0.4, model: Model | None = None) -> DataFrame:
    """The rows of ``docs`` whose language is known with a score of ``least`` or more, with all their columns.

    If there was nothing to learn from (no usable label), no language is known
    and every row with a letter stays: a text is not dropped for want of labels.
    """
    ship(docs.sparkSession)
    model, at = model or train(training_rows(docs)), docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                found = model.predict(part.column(at).to_pylist())
                if model.langs:
                    stays = [lang != UNKNOWN and score >= least for lang, score in found]
                else:
                    stays = [any(map(str.isalpha, t or "")) for t in part.column(at).to_pylist()]
                yield part.filter(pa.array(stays, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)

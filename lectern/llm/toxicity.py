"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A text is lower-cased and cut into words of letters and digits.  A word's subwords are its 3 to 5 byte character
n-grams, word ends included; each hashes to a row of an embedding table.  The embeddings in a window of ``WINDOW`` words are
averaged (a word that repeats the one before it counts once), and a linear softmax over that mean gives the window's class.  A text is as toxic as its worst window, so
a few words in a long text aren't diluted.  Embeddings and softmax are trained jointly in numpy: first on bags of
whole texts, then on each text's worst window.  As a misspelled or newly built word shares most n-grams with the known one,
it shares its vectors.

The fit takes a bounded sample, the first ``FIT_ROWS`` ids of each class by hash order among those with a text of at most
``FIT_CHARS`` characters, one text for each id; scoring reads whole texts.  As softmax and mean are linear, executors need one number for each table row (1 MB).

Defined results: null and empty texts, and texts without a letter or digit, get the score of an empty bag; repeated rows are
scored each, and in the fit the one with the least text hash stands for its id; a label of 1 outweighs another of 0 for the same id;
labels of one class only, or none, give every text the share of toxic labels (0 without labels); an empty table gives no row;
a null label or id is no label; ``score`` ignores other columns, and ``keep_clean`` carries them, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import release_caches, slices

BUCKETS_LOG2 = 18
DIMENSIONS = 8
GRAMS = (3, 4, 5)
WINDOW = 8
FIT_ROWS = 2000
FIT_CHARS = 20_000
EPOCHS_BAG, EPOCHS_WINDOW = 1, 8
#: Small samples are gone through more often, to make at least so many steps.
STEPS = 300
BATCH = 64
THRESHOLD = 0.7

#: Text bytes that are scored at once: their subwords' arrays take some fifty times that.
SLICE = 1 << 20

_WORD_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 32 for b in range(256))


@dataclass
class Model:
    """``embeddings`` (buckets x dimensions), ``softmax`` (dimensions x 2), ``bias`` (2); ``constant`` if there was no fit."""

    embeddings: np.ndarray
    softmax: np.ndarray
    bias: np.ndarray
    constant: float | None = None

    def gram_scores(self) -> tuple[np.ndarray, float]:
        """What each table row adds to the log-odds of class 1, and the log-odds of an empty bag."""
        way = (self.softmax[:, 1] - self.softmax[:, 0]).astype(np.float32)
        return self.embeddings @ way, float(self.bias[1] - self.bias[0])


@dataclass
class Bags:
    """Subwords of some texts: the table row and the word of each, the words' ends in them, each text's first word."""

    grams: np.ndarray
    words: np.ndarray  # of each gram
    first: np.ndarray  # of each text, and the end


def bags(texts: list[str | None]) -> Bags:
    raw = []
    for t in texts:
        w = (t or "").lower().encode().translate(_WORD_BYTES).split()
        raw.append(b" " + b" ".join(x for x, before in zip(w, [b"", *w], strict=False) if x != before) + b" ")
    buffer = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.cumsum([len(r) for r in raw])
    blank = buffer == 32
    starts = np.zeros(len(buffer), bool)
    starts[1:] = blank[:-1] & ~blank[1:]
    number = np.cumsum(starts) - 1  # of the word, for each of its bytes and the blank after it
    first = np.concatenate([[0], np.cumsum(starts)[ends - 1]]) if len(raw) else np.zeros(1, np.int64)
    grams, words = [], []
    wide = buffer.astype(np.uint32)
    inner = np.zeros(len(buffer), np.uint8)
    for n in GRAMS:
        m = len(buffer) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        for k in range(n):
            h *= np.uint32(0x01000193)
            h += wide[k : k + m]
        inner = blank[1 : 1 + m].copy()
        for k in range(2, n - 1):
            inner |= blank[k : k + m]
        at = np.flatnonzero(~inner)
        h = h[at]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        grams.append(h >> np.uint32(32 - BUCKETS_LOG2))
        words.append(number[at + 1])
    if not grams:
        return Bags(np.zeros(0, np.uint32), np.zeros(0, np.int64), first)
    return Bags(np.concatenate(grams), np.concatenate(words), first)


def worst_windows(found: Bags, scores: np.ndarray, empty: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text the log-odds of its worst window, and that window's first word and the word after it."""
    n_words = int(found.first[-1])
    sums = np.concatenate([[0.0], np.cumsum(np.bincount(found.words, scores[found.grams], n_words))])
    sizes = np.concatenate([[0], np.cumsum(np.bincount(found.words, minlength=n_words))])
    count = np.diff(found.first)
    windows = np.maximum(count - WINDOW + 1, np.minimum(count, 1))
    text = np.repeat(np.arange(len(count)), windows)
    begin = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows) + found.first[:-1][text]
    end = np.minimum(begin + WINDOW, found.first[1:][text])
    value = (sums[end] - sums[begin]) / np.maximum(sizes[end] - sizes[begin], 1)
    best = np.full(len(count), -np.inf)
    np.maximum.at(best, text, value)
    hit = np.flatnonzero(value == best[text])[::-1]
    a, b = np.zeros(len(count), np.int64), np.zeros(len(count), np.int64)
    a[text[hit]], b[text[hit]] = begin[hit], end[hit]
    return np.where(count > 0, best, 0.0) + empty, a, b


def fit(texts: list[str], labels: list[int], seed: int = 7) -> Model:
    y = np.asarray(labels, np.float64)
    size = 1 << BUCKETS_LOG2
    if not len(y) or y.min() == y.max():
        zero = np.zeros((size, DIMENSIONS), np.float32)
        return Model(zero, np.zeros((DIMENSIONS, 2)), np.zeros(2), float(y.mean()) if len(y) else 0.0)
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.01, (size, DIMENSIONS)).astype(np.float32)
    softmax = rng.normal(0, 0.3, (DIMENSIONS, 2))
    model = Model(table, softmax, np.zeros(2))
    seen = np.full(size, 1e-8, np.float32)  # squared steps, for each table row
    seen_w = np.full((DIMENSIONS, 2), 1e-8)
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    order = rng.permutation(len(y))
    often = max(1, -(-STEPS // ((EPOCHS_BAG + EPOCHS_WINDOW) * -(-len(y) // BATCH))))
    epochs = often * (EPOCHS_BAG + EPOCHS_WINDOW)
    for epoch in range(epochs):
        rate = 0.5 * (1 - epoch / epochs)
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            found = bags([texts[i] for i in rows])
            scores, empty = model.gram_scores()
            if epoch < EPOCHS_BAG * often:
                a, b = found.first[:-1], found.first[1:]
                text = np.repeat(np.arange(len(rows)), np.diff(found.first))[found.words]
                use, grams = text, found.grams
                sizes = np.maximum(np.bincount(use, minlength=len(rows)), 1)
                odds = np.bincount(use, scores[grams], len(rows)) / sizes + empty
            else:
                odds, a, b = worst_windows(found, scores, empty)
                text = np.repeat(np.arange(len(rows)), np.diff(found.first))[found.words]
                inside = (found.words >= a[text]) & (found.words < b[text])
                use, grams = text[inside], found.grams[inside]
                sizes = np.maximum(np.bincount(use, minlength=len(rows)), 1)
            p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
            error = (p - y[rows]) * weight[rows]
            pull = np.bincount(grams, (error / sizes)[use], size)  # of each table row
            hit = np.flatnonzero(pull)
            way = model.softmax[:, 1] - model.softmax[:, 0]
            grad_w = np.outer(model.embeddings[hit].T @ pull[hit], [-1.0, 1.0])
            seen[hit] += pull[hit] ** 2
            step = (rate * pull[hit] / np.sqrt(seen[hit])).astype(np.float32)
            model.embeddings[hit] -= step[:, None] * way.astype(np.float32)
            seen_w += grad_w**2
            model.softmax -= 0.1 * rate * grad_w / np.sqrt(seen_w)
            model.bias += 0.5 * rate * np.array([1.0, -1.0]) * error.mean()
        order = rng.permutation(len(y))
    return model


def held_out(doc_id: Column) -> Column:
    """Rows never fitted: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, chars: int = FIT_CHARS) -> Model:
    """Fit on at most ``rows`` labelled texts of each class (not held out, lowest hashes first)."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", "toxic")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(~held_out(F.col("doc_id")))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter(F.char_length("text") <= chars)
    known = known.join(texts.select("doc_id"), "doc_id", "left_semi")
    order = F.xxhash64(F.col("doc_id").cast("string"))
    ids = None
    for c in (0, 1):
        part = known.filter(F.col("toxic") == c).orderBy(order, "doc_id").limit(rows)
        ids = part if ids is None else ids.unionByName(part)
    # at most twice `rows` ids are broadcast, and one text for each is collected
    own = F.min(F.struct(F.xxhash64("text").alias("hash"), "text", "toxic")).alias("own")
    found = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(own).select("doc_id", "own.text", "own.toxic").collect()
    found.sort(key=lambda r: r["doc_id"])
    return fit([r["text"] for r in found], [r["toxic"] for r in found])


def _scorer(docs: DataFrame, model: Model):
    shared = docs.sparkSession.sparkContext.broadcast((*model.gram_scores(), model.constant))

    def scores_of(texts: list[str | None]) -> np.ndarray:
        scores, empty, constant = shared.value
        if constant is not None:
            return np.full(len(texts), constant)
        odds, _, _ = worst_windows(bags(texts), scores, empty)
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))

    return scores_of


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score``: the probability of class 1, for each row."""
    scores_of = _scorer(docs, model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches()
        for part in slices(batches, size=SLICE):
            values = pa.array(scores_of(part.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), values], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, score double")


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score is below the threshold, with all their columns."""
    scores_of = _scorer(docs, model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches()
        for part in slices(batches, size=SLICE):
            yield part.filter(pa.array(scores_of(part.column("text").to_pylist()) < threshold))

    return docs.mapInArrow(run, docs.schema)

"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams (with word edges) hashed to embedding rows; a window
of words is the average of the bags of its different words; two output vectors and a softmax give the classes. Rows and
outputs are trained together by gradient descent in numpy on a bounded sample of labelled
windows, in one task; only the finished weights come to the driver. A misspelt insult shares most n-grams with the word it stands for.

Labels belong to whole documents, insults to a few words. So a first model, trained on all
sampled windows, drops those windows of toxic documents that look clean and are not their
document's worst; a second model is trained on the rest. A document's score is that of its worst
window, so that length does not dilute it. As the output layer is linear, scoring needs one
number per word: the sum of its n-grams' contributions.

Null and empty texts have no words and score 0. Repeated rows are scored each. Without labelled
rows of both classes every score is 0. Columns other than those named are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelquant.llm.common import distinct_words, objects, over_batches

GRAMS = (3, 4, 5)
BUCKETS = 1 << 18
DIMENSIONS = 12
WINDOW = 32
STRIDE = 16
#: A window of fewer n-grams is averaged as if neutral ones filled it up to this number, so that a
#: text of few (different) words is not judged by the chance of one n-gram.
LEAST_GRAMS = 500
#: Bound of the training sample: windows of toxic and of clean documents.
MAX_TOXIC, MAX_CLEAN = 12_000, 24_000
#: Bound of the labelled documents of each class that these are taken from.
MAX_DOCUMENTS = 8_000
EPOCHS = 6
#: Small samples are gone through more often, to this number of batches.
LEAST_BATCHES = 1_000
RATE = 0.5
ROW_RATE = 20.0
OUTPUT_RATE = 4.0
DECAY = 1e-4
BATCH = 64
#: Texts whose words are found, words whose n-grams are taken, and windows whose margins are summed, at once.
TEXTS_AT_ONCE, WORDS_AT_ONCE, WINDOWS_AT_ONCE = 1_024, 8_192, 128
THRESHOLD = 0.7
MOST_CACHED = 1 << 17
_SPACES = np.arange(256, dtype=np.uint8)
_SPACES[0x09:0x0E] = 0x20
EDGE = ".,;:!?\"'()[]{}*#%&$<>|"


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers and hash buckets of all n-grams of ``<word>``, whole words included."""
    marked = [f"<{w.strip(EDGE).lower()}>" for w in words]
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(marked), dtype=np.int32), lengths)
    left = np.repeat(ends, lengths) - np.arange(len(codes))
    ids, buckets = [], []
    h = np.zeros(len(codes), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        h[:len(codes) - n + 1] = (h[:len(codes) - n + 1] * np.uint64(0x100000001B3)
                                  + codes[n - 1:] + np.uint64(1))
        if n in GRAMS:
            at = np.flatnonzero((left >= n))
            ids.append(owner[at])
            buckets.append(_bucket(h[at] + np.uint64(n)))
    return np.concatenate(ids), np.concatenate(buckets)


def _bucket(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ (h >> np.uint64(32))) & np.uint64(BUCKETS - 1)).astype(np.int32)


@dataclass(frozen=True)
class Model:
    """``weight``: each bucket's contribution to the margin of class 1; ``bias`` its constant."""

    weight: np.ndarray
    bias: float
    scale: float
    shift: float


@dataclass(frozen=True)
class Windows:
    """Training windows as numbers: each window's document, label and different words, and each word's
    n-gram buckets. Words and buckets lie one behind the other, with the edges of their owners."""

    document: np.ndarray
    label: np.ndarray
    words: np.ndarray
    word_edges: np.ndarray
    buckets: np.ndarray
    bucket_edges: np.ndarray

    @staticmethod
    def of(document: np.ndarray, texts: pa.Array, label: np.ndarray) -> Windows:
        # Some texts at a time; their words are numbered by the first place in all texts.
        found = []
        for low in range(0, len(label), TEXTS_AT_ONCE):
            some = distinct_words(texts.slice(low, TEXTS_AT_ONCE), _SPACES)
            found.append((some.distinct, some.number, np.diff(some.edges)))
            del some
            pa.default_memory_pool().release_unused()
        numbered = pa.concat_arrays([x[0] for x in found] or [pa.array([], pa.large_binary())]).dictionary_encode()
        distinct, size = numbered.dictionary, max(len(numbered.dictionary), 1)
        words, each, at = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)], 0
        for own, number, lengths in found:
            number = numbered.indices[at:at + len(own)].to_numpy()[number]
            at += len(own)
            once = np.unique(np.repeat(np.arange(len(lengths)), lengths) * size + number)
            words.append((once % size).astype(np.int32))
            each.append(np.bincount(once // size, minlength=len(lengths)))
        parts, counts = [np.zeros(0, np.int32)], [np.zeros(int(not len(distinct)), np.int64)]
        for low in range(0, len(distinct), WORDS_AT_ONCE):
            some = [w.decode() for w in objects(distinct.slice(low, WORDS_AT_ONCE))]
            ids, buckets = grams(some)
            parts.append(buckets[np.argsort(ids, kind="stable")])
            counts.append(np.bincount(ids, minlength=len(some)))
        return Windows(document, label, np.concatenate(words), np.cumsum(np.concatenate(each)),
                       np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(counts))]))

    def of_windows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The buckets of the windows ``at``, one behind the other, and each window's number of them."""
        counts = self.word_edges[at + 1] - self.word_edges[at]
        words = self.words[_runs(self.word_edges[at], counts)]
        sizes = self.bucket_edges[words + 1] - self.bucket_edges[words]
        owner = np.repeat(np.arange(len(at)), counts)
        return (self.buckets[_runs(self.bucket_edges[words], sizes)],
                np.bincount(owner, sizes, len(at)).astype(np.int64))

    def margins(self, at: np.ndarray, weight: np.ndarray, bias: float) -> np.ndarray:
        out = np.zeros(len(at))
        for low in range(0, len(at), WINDOWS_AT_ONCE):
            rows, sizes = self.of_windows(at[low:low + WINDOWS_AT_ONCE])
            sums = np.bincount(np.repeat(np.arange(len(sizes)), sizes), weight[rows], len(sizes))
            out[low:low + WINDOWS_AT_ONCE] = sums / np.maximum(sizes, LEAST_GRAMS) + bias
        return out


def _runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, .. of every run, one behind the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(lengths.sum())


def _fit(windows: Windows, at: np.ndarray, seed: int) -> tuple[np.ndarray, float]:
    """Bucket weights and bias from the windows ``at``; one without n-grams has a mean of zero."""
    labels = windows.label[at]
    rng = np.random.default_rng(seed)
    # The rows are ``decay * table``: all of them decay in every step, which costs one number.
    table, decay = rng.uniform(-1, 1, (BUCKETS, DIMENSIONS)), 1.0
    table /= DIMENSIONS
    out, bias = np.zeros((DIMENSIONS, 2)), np.zeros(2)
    share = max(labels.mean(), 1e-6)
    importance = np.where(labels == 1, 0.5 / share, 0.5 / max(1 - share, 1e-6))
    epochs = max(EPOCHS, -(-LEAST_BATCHES * BATCH // len(at)))
    total = epochs * len(at)
    for epoch in range(epochs):
        order = rng.permutation(len(at))
        for low in range(0, len(order), BATCH):
            rate = RATE * (1 - (epoch * len(at) + low) / total)
            batch = order[low:low + BATCH]
            rows, sizes = windows.of_windows(at[batch])
            owner = np.repeat(np.arange(len(batch)), sizes)
            mean = np.zeros((len(batch), DIMENSIONS))
            some = np.flatnonzero(sizes)
            if len(some):
                mean[some] = np.add.reduceat(table[rows], (np.cumsum(sizes) - sizes)[some])
            mean *= decay / np.maximum(sizes, LEAST_GRAMS)[:, None]
            logits = mean @ out + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(batch)), labels[batch]] -= 1
            p *= importance[batch][:, None]
            back = p @ out.T / np.maximum(sizes, LEAST_GRAMS)[:, None]
            out -= rate * OUTPUT_RATE * mean.T @ p / len(batch)
            bias -= rate * p.mean(0)
            if len(rows):
                # A row's steps are summed before they are taken.
                by_row = np.argsort(rows, kind="stable")
                rows = rows[by_row]
                first = np.flatnonzero(np.diff(rows, prepend=-1))
                table[rows[first]] -= rate * ROW_RATE / decay * np.add.reduceat(back[owner[by_row]], first)
            decay *= 1 - rate * DECAY
    table *= decay
    return table @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0])


class Scorer:
    """Margins of texts under a model, remembering each word's contribution."""

    def __init__(self, weight: np.ndarray, bias: float) -> None:
        self.weight, self.bias = weight, bias
        self.index: dict[str, int] = {}
        self.sums = self.counts = np.zeros(0)

    def margins(self, texts: list[str | None]) -> list[float | None]:
        """The largest window margin of each text; None without words."""
        split = [(t or "").split() for t in texts]
        if len(self.index) > MOST_CACHED:
            self.index, self.sums, self.counts = {}, np.zeros(0), np.zeros(0)
        fresh = list({w for x in split for w in x if w not in self.index})
        if fresh:
            ids, buckets = grams(fresh)
            self.index.update(zip(fresh, range(len(self.index), len(self.index) + len(fresh)), strict=True))
            self.sums = np.concatenate([self.sums, np.bincount(ids, self.weight[buckets], len(fresh))])
            self.counts = np.concatenate([self.counts, np.bincount(ids, minlength=len(fresh))])
        out = []
        for x in split:
            if not x:
                out.append(None)
                continue
            at = np.fromiter(map(self.index.__getitem__, x), np.int64, len(x))
            order = np.argsort(at, kind="stable")
            before = np.full(len(at), -1)
            again = at[order[1:]] == at[order[:-1]]
            before[order[1:][again]] = order[:-1][again]
            starts = np.arange(0, max(1, len(x) - WINDOW + STRIDE), STRIDE)
            place = starts[:, None] + np.arange(WINDOW)
            inside = place < len(x)
            place = np.minimum(place, len(x) - 1)
            once = inside & (before[place] < starts[:, None])
            n = np.maximum((self.counts[at][place] * once).sum(1), LEAST_GRAMS)
            out.append(float(((self.sums[at][place] * once).sum(1) / n).max() + self.bias))
        return out


def train(windows: Windows, seed: int = 5) -> Model | None:
    """A model; None unless both classes occur."""
    known = np.flatnonzero(np.diff(windows.word_edges))
    label, document = windows.label, windows.document.astype(np.int64)
    # Every fifth document only sets the threshold, which margins of fitted windows would put too low.
    fifth = (document & 0xFFFFFFFF) * 2654435761 % (1 << 32) % 5 == 0
    apart, fitted = known[fifth[known]], known[~fifth[known]]
    if len(set(label[fitted])) < 2 or len(set(label[apart])) < 2:
        apart = fitted = known
    if len(set(label[fitted])) < 2:
        return None
    weight, bias = _fit(windows, fitted, seed)
    margins = windows.margins(fitted, weight, bias)
    toxic = label[fitted] == 1
    sure = np.quantile(margins[~toxic], 0.99)
    worst = _best(document[fitted], margins)
    weight, bias = _fit(windows, fitted[~toxic | (margins > sure) | (margins >= worst)], seed + 1)
    margins = windows.margins(apart, weight, bias)
    toxic = label[apart] == 1
    # A document has many clean windows and its worst one counts, so the threshold lies above
    # nearly all of them: a quarter of the way to the worst windows of the middle toxic document.
    # (Of a long toxic document the sample may hold clean windows only, so no low quantile is used.)
    clean = np.quantile(margins[~toxic], 0.9995)
    _, one = np.unique(document[apart][toxic], return_index=True)
    middle = max(np.median(_best(document[apart][toxic], margins[toxic])[one]), clean + 1.0)
    step = (middle - clean) / 4
    return Model(weight.astype(np.float32), bias, 3.0 / step, clean + step)


def _best(document: np.ndarray, margins: np.ndarray) -> np.ndarray:
    """For every window, the highest margin of its document's windows."""
    _, place = np.unique(document, return_inverse=True)
    best = np.full(place.max(initial=-1) + 1, -np.inf)
    np.maximum.at(best, place, margins)
    return best[place]


def held_out() -> F.Column:
    return F.coalesce(F.expr("crc32(CAST(doc_id AS string)) % 3 = 1"), F.lit(False))


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, piece, toxic: MAX_TOXIC and MAX_CLEAN windows at most, chosen by a hash of document and place,
    toxic ones first and in the order of their hashes, in one partition.

    They come from MAX_DOCUMENTS labelled documents of each class at most, chosen by a hash of the
    id; that bound makes the list of chosen ids small enough to be broadcast.
    """
    marked = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(~held_out()).groupBy(
        "doc_id").agg(F.max("toxic").alias("toxic")).withColumn("h", F.xxhash64("doc_id"))
    chosen = marked.where("toxic = 1").orderBy("h", "doc_id").limit(MAX_DOCUMENTS).unionByName(
        marked.where("toxic = 0").orderBy("h", "doc_id").limit(MAX_DOCUMENTS)).select("doc_id", "toxic")
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(
        "doc_id", "toxic", F.split("text", r"[\s]+").alias("w"))
    pieces = texts.select("doc_id", "toxic", F.posexplode(F.expr(
        f"transform(sequence(0, greatest(size(w) - 1, 0), {WINDOW}), i -> array_join(slice(w, i + 1, {WINDOW}), ' '))"
    )).alias("place", "piece")).withColumn("h", F.xxhash64("doc_id", "place"))
    return pieces.where("toxic = 1").orderBy("h", "doc_id", "place").limit(MAX_TOXIC).unionByName(
        pieces.where("toxic = 0").orderBy("h", "doc_id", "place").limit(MAX_CLEAN)).coalesce(1).sortWithinPartitions(
        F.desc("toxic"), "h", "doc_id", "place").select("doc_id", "piece", "toxic")


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The model from the bounded sample; one task trains it, and it alone comes to the driver.

    Without labelled rows, or with rows of one class only, there is no model.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [batch for batch in batches if batch.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        del held
        document, label = (table.column(c).to_numpy().astype(np.int64) for c in ("doc_id", "toxic"))
        windows = Windows.of(document, pa.concat_arrays(table.column("piece").chunks), label)
        del table
        pa.default_memory_pool().release_unused()  # the worker lives on
        model = train(windows)
        if model is not None:
            yield pa.RecordBatch.from_pylist([{
                "weight": model.weight.tobytes(), "bias": model.bias, "scale": float(model.scale),
                "shift": float(model.shift)}])

    found = sample(docs, labels).mapInArrow(run, "weight binary, bias double, scale double, shift double").collect()
    return Model(np.frombuffer(found[0].weight, np.float32), *found[0][1:]) if found else None


_scorers: dict[str, Scorer] = {}


def _scorer(name: str, shared: Broadcast) -> Scorer:
    """The worker's scorer of one model."""
    if name not in _scorers:
        _scorers.clear()
        _scorers[name] = Scorer(*shared.value)
    return _scorers[name]


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score of the whole text, predicted (1 from THRESHOLD on)."""
    frame = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if model is None:
        return frame.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    shared = docs.sparkSession.sparkContext.broadcast((model.weight, model.bias))
    name = uuid.uuid4().hex
    scale, shift = model.scale, model.shift

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        margins = _scorer(name, shared).margins(batch.column("text").to_pylist())
        known = np.array([-np.inf if m is None else m for m in margins])
        p = 1 / (1 + np.exp(-np.clip(scale * (known - shift) + np.log(THRESHOLD / (1 - THRESHOLD)), -50, 50)))
        p[np.isinf(known)] = 0.0
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))],
            ["doc_id", "score", "predicted"])

    return over_batches(frame, run, "doc_id bigint, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns."""
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast((model.weight, model.bias))
    name = uuid.uuid4().hex
    least = model.shift
    text = docs.columns.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        margins = _scorer(name, shared).margins(batch.column(text).to_pylist())
        return batch.filter(pa.array([m is None or m < least for m in margins]))

    return over_batches(docs, run, docs.schema)

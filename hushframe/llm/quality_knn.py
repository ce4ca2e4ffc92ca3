"""Quality classifier by nearest-neighbour voting over latent-semantic vectors.

A text's terms are its words (hashed into buckets), trigrams of character classes and shares of repeated words, counted
over its whole UTF-8 bytes. A bounded sample of labelled texts gives inverse document frequencies and, by a truncated
SVD, the latent space: its axes come from subspace iteration, in which executors multiply their part of the sample and
only sums of TERMS x RANK reach the driver. The sample's vectors are broadcast (2 * SAMPLE * RANK floats at most). Every
text is projected and compared with all of them by exact blocked cosines; its nearest neighbours vote, weighted by a
power of their similarity. All that are as near as the last of them, to 5 decimals, vote too, so ties don't matter.

Null and empty texts, and texts when there are no labels, get the labelled share of good texts. Of conflicting labels of
one doc_id the lower counts. Repeated rows are scored each. Columns other than doc_id and text are never looked at. An
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from .common import drop, freeing, materialize, slices, text_rows, utf8_batch
from .rolling import separated, word_hashes

#: Labelled texts of each label that are learnt from, at most; dimensions; neighbours that vote; power of the similarity.
SAMPLE, RANK, NEIGHBOURS, POWER = 2048, 48, 15, 8
THRESHOLD = 0.3
#: Buckets of words, and their weight against shapes.
WORDS, WORD_WEIGHT = 2048, 0.5
#: Axes beyond RANK and rounds of the subspace iteration; parts that the sample is kept in.
SPARE, ROUNDS, PARTS = 16, 6, 8

_CLASSES, _BINS = 12, 8
_SHAPES = _CLASSES**3
TERMS = _SHAPES + 2 * _BINS + WORDS
_SEGMENT = 1 << 20


def _classes() -> np.ndarray:
    """Character class of each byte: lower, upper, above ASCII, digit, space, newline, sentence ends, and other signs by kind."""
    out = np.full(256, 7, np.int64)
    out[97:123], out[65:91], out[128:], out[48:58], out[32], out[[9, 10, 11, 12, 13]] = 0, 1, 0, 2, 3, 4
    for kind, signs in enumerate((b".,;:?", b"!", b"'\"()-", b"|/\\<>[]{}_", b"#$%&*+=@^~`"), 5):
        out[list(signs)] = kind if kind < 7 else kind + 1
    return out


def term_shares(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Square roots of each text's shares of terms, a row for each text."""
    n = len(offsets) - 1
    counts = np.zeros(n * _SHAPES, np.float32)
    kinds = _classes()
    for at in range(0, max(0, len(data) - 2), _SEGMENT):
        part = kinds[data[at : at + _SEGMENT + 2]]
        place = np.arange(at, at + len(part) - 2)
        row = np.searchsorted(offsets, place, "right") - 1
        inside = place + 2 < offsets[row + 1]
        shape = (part[:-2] * _CLASSES + part[1:-1]) * _CLASSES + part[2:]
        counts += np.bincount((row * _SHAPES + shape)[inside], minlength=n * _SHAPES)
    out = np.zeros((n, TERMS), np.float32)
    counts = counts.reshape(n, _SHAPES)
    out[:, :_SHAPES] = np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))
    start, word = word_hashes(separated(data, offsets))
    first = np.searchsorted(start, offsets + np.arange(n + 1))
    for i in range(n):
        w = word[first[i] : first[i + 1]]
        if len(w):
            held = np.bincount((w >> np.uint64(40)).astype(np.int64) % WORDS, minlength=WORDS)
            out[i, -WORDS:] = WORD_WEIGHT * np.sqrt(held / len(w))
        if len(w) > 1:
            repeated = (w[1:] == w[:-1]).mean()
            known = len(np.unique(w)) / len(w)
            out[i, _SHAPES + min(_BINS - 1, int(repeated * 2 * _BINS))] = 0.3
            out[i, _SHAPES + _BINS + min(_BINS - 1, int(known * _BINS))] = 0.1
    return out


class Model:
    """idf of the terms, the axes of the latent space (TERMS x RANK), the sample's unit vectors in it and their labels."""

    def __init__(self, prior: float, idf: np.ndarray | None = None):
        self.prior, self.idf = prior, np.ones(TERMS, np.float32) if idf is None else idf.astype(np.float32)
        self.axes, self.vectors, self.labels = np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0, np.float32)

    def weighted(self, shares: np.ndarray) -> np.ndarray:
        rows = shares * self.idf
        return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)

    def project(self, shares: np.ndarray) -> np.ndarray:
        rows = self.weighted(shares) @ self.axes
        return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)

    def score(self, shares: np.ndarray) -> np.ndarray:
        out = np.full(len(shares), self.prior)
        if not len(self.vectors):
            return out
        cosine = np.round(self.project(shares) @ self.vectors.T, 5)
        k = min(NEIGHBOURS, cosine.shape[1])
        last = np.partition(cosine, -k, axis=1)[:, -k]
        weight = np.where(cosine >= last[:, None], np.maximum(cosine, 0), 0).astype(float) ** POWER
        total = weight.sum(axis=1)
        some = (total > 0) & (shares > 0).any(axis=1)
        out[some] = ((weight @ self.labels) / np.maximum(total, 1e-300))[some]
        return np.clip(out, 0, 1)


def _shares(batch) -> np.ndarray:
    return np.array([np.frombuffer(x.as_buffer(), np.float32) for x in batch.column("shares")]).reshape(-1, TERMS)


def _summed(sample: DataFrame, shape: tuple[int, ...], part) -> np.ndarray:
    """The sum over the sample's Arrow batches of what part makes of their shares, added up in each task first."""

    def run(batches):
        total = np.zeros(shape)
        for batch in batches:
            for x in slices([batch], 512):
                total += part(_shares(x))
        yield pa.RecordBatch.from_arrays([pa.array([total.astype("<f8").tobytes()], pa.binary())], ["total"])

    out = np.zeros(shape)
    for r in sample.select("shares").mapInArrow(run, "total binary").toLocalIterator():  # a row for each of PARTS
        out += np.frombuffer(r.total, "<f8").reshape(shape)
    return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """Learn from at most SAMPLE texts of each label, chosen by a hash of doc_id, of those whose crc32(doc_id) mod 5 isn't 0."""
    spark = docs.sparkSession
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).cast("int").alias("label"))
    known = known.filter("label in (0, 1)").filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    total = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    prior = total.get(1, 0) / sum(total.values()) if total else 0.5
    chosen = None
    for value in (0, 1):
        part = known.filter(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
        chosen = part if chosen is None else chosen.union(part)
    texts = text_rows(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))

    def run(batches):
        for batch in slices(batches, 256):
            shares = term_shares(*utf8_batch(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array([s.tobytes() for s in shares], pa.binary())], ["doc_id", "label", "shares"])

    sample = materialize(texts.mapInArrow(run, "doc_id long, label int, shares binary").repartition(PARTS, "doc_id"), "sample")
    n = sample.count()
    if not n:
        return Model(prior)
    model = Model(prior, np.log(1 + n / (1 + _summed(sample, (TERMS,), lambda x: (x > 0).sum(axis=0)))))
    width = min(RANK + SPARE, n)
    axes = np.linalg.qr(np.random.default_rng(7).normal(size=(TERMS, width)))[0]
    for turn in range(ROUNDS):
        held = spark.sparkContext.broadcast((model, axes.astype(np.float32)))

        def turned(x, held=held):
            rows, axes = held.value[0].weighted(x), held.value[1]
            return rows.T @ (rows @ axes)

        product = _summed(sample, (TERMS, width), turned)
        if turn == ROUNDS - 1:  # the axes within the subspace, strongest first
            inner = axes.T @ product
            axes = axes @ np.linalg.eigh((inner + inner.T) / 2)[1][:, ::-1]
        else:
            axes = np.linalg.qr(product)[0]
        held.destroy()
    model.axes = axes[:, :RANK].astype(np.float32)
    held = spark.sparkContext.broadcast(model)

    def projected(batches):
        for batch in batches:
            for x in slices([batch], 512):
                yield pa.RecordBatch.from_arrays([x.column("doc_id"), x.column("label"), pa.array([v.tobytes() for v in held.value.project(_shares(x))], pa.binary())], ["doc_id", "label", "vector"])

    rows = sorted(sample.mapInArrow(projected, "doc_id long, label int, vector binary").collect())  # at most 2 * SAMPLE short vectors
    drop(sample)
    model.vectors = np.array([np.frombuffer(r.vector, np.float32) for r in rows])
    model.labels = np.array([r.label for r in rows], np.float32)
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, uid, score)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 128):
                part = batch.slice(at, 128)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("uid"), pa.array(held.value.score(term_shares(*utf8_batch(part.column("text")))))], ["doc_id", "uid", "score"])

    return text_rows(docs).mapInArrow(freeing(run), "doc_id long, uid long, score double")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs whose score reaches the threshold, scored and filtered in one pass; all their columns stay."""
    held = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 128):
                part = batch.slice(at, 128)
                score = held.value.score(term_shares(*utf8_batch(part.column("text").fill_null(""))))
                yield part.filter(pa.array(score >= threshold))

    return docs.mapInArrow(freeing(run), docs.schema)

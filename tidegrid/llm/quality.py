"""Quality scores by Bradley-Terry ranking.

A pair of labelled documents, one of each label, says which is preferred. The probability of that
preference is the logistic function of the difference of their scores, a score is linear in features
of the text, and the weights minimise the logistic loss over feature differences. A quantile of the
scores of the labelled documents becomes the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm import words

#: At most so many labelled documents are fitted, chosen by a hash of doc_id, and so many pairs of them.
MAX_LABELLED, MAX_PAIRS = 20_000, 60_000
THRESHOLD = 0.3
_SHAPES = 64
_KIND = np.zeros(256, np.int64)  # 0 space, 1 lower, 2 upper, 3 digit, 4 sentence mark, 5 other mark, 6 beyond ASCII
_KIND[33:127] = 5
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 1, 2, 3
_KIND[[ord(c) for c in ".,;:?'-"]] = 4
_KIND[128:] = 6


def _features(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row for each text: shares of kinds of characters, words and lines, repeats, and word shapes."""
    n = len(bounds) - 1
    size = np.diff(bounds)
    owner = np.repeat(np.arange(n), size)
    kind = _KIND[data]
    chars = np.bincount(owner * 7 + kind, minlength=7 * n).reshape(n, 7)
    share = chars / np.maximum(size, 1)[:, None]
    doc, h = words.hashed_words(data, bounds)
    count = np.bincount(doc, minlength=n)
    w = np.maximum(count, 1)

    def distinct(d: np.ndarray, x: np.ndarray) -> np.ndarray:
        order = np.lexsort((x, d))
        d, x = d[order], x[order]
        new = np.ones(len(x), bool)
        new[1:] = (x[1:] != x[:-1]) | (d[1:] != d[:-1])
        return np.bincount(d[new], minlength=n)

    d3, s3 = words.shingles(doc, h, 3)
    n3 = np.maximum(np.bincount(d3, minlength=n), 1)
    ended = data == 10
    lines = np.bincount(owner[ended], minlength=n) + 1
    # a shape: the kinds of characters of a word, runs counted once
    change = np.ones(len(data), bool)
    change[1:] = (kind[1:] != kind[:-1]) | (owner[1:] != owner[:-1])
    k, o = kind[change], owner[change]
    inside = k > 0
    start = inside.copy()
    start[1:] &= ~inside[:-1] | (o[1:] != o[:-1])
    k, o = k[inside], o[inside]
    heads = np.flatnonzero(start[inside])
    place = np.arange(len(k)) - np.repeat(heads, np.diff([*heads, len(k)]))
    code = np.add.reduceat(words.mixed((place.astype(np.uint64) << np.uint64(3)) + k.astype(np.uint64)), heads) if len(heads) else np.zeros(0, np.uint64)
    shape = (words.mixed(code) >> np.uint64(58)).astype(np.int64)
    at = o[heads]
    shapes = np.bincount(at * _SHAPES + shape, minlength=_SHAPES * n).reshape(n, _SHAPES) / np.maximum(np.bincount(at, minlength=n), 1)[:, None]
    own = distinct(doc, h) / w
    plain = [np.log1p(count), np.log1p(size), size / w, own, own * np.log1p(count), distinct(d3, s3) / n3, np.log1p(w / lines), count == 0]
    return np.column_stack([*plain, share, np.sqrt(share), np.sqrt(shapes)]).astype(np.float64)


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    spread: float

    def score(self, features: np.ndarray) -> np.ndarray:
        """0 to 1, THRESHOLD at the cut."""
        z = np.clip((features - self.mean) / self.scale, -8, 8) @ self.weights
        return 1 / (1 + np.exp(-np.clip((z - self.cut) / self.spread + np.log(THRESHOLD / (1 - THRESHOLD)), -30, 30)))


def fit(features: np.ndarray, label: np.ndarray, seed: int = 11, ridge: float = 3e-3) -> Model:
    """Newton steps on the logistic loss of differences of pairs, one document of each label.

    The threshold is that quantile of all scores which tells the labels apart best, each label
    counting the same. With one label only (or none), every score is the same and above the threshold.
    """
    d = features.shape[1]
    mean = features.mean(0) if len(features) else np.zeros(d)
    scale = features.std(0) + 1e-6 if len(features) else np.ones(d)
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        return Model(mean, scale, np.zeros(d), 0.0 if len(bad) and not len(good) else -1.0, 1.0)
    rng, x = np.random.default_rng(seed), np.clip((features - mean) / scale, -8, 8)
    pairs = min(MAX_PAIRS, 20 * len(features))
    diff = x[rng.choice(good, pairs)] - x[rng.choice(bad, pairs)]
    w = np.zeros(d)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(diff @ w, -30, 30)))
        step = np.linalg.solve((diff * (p * (1 - p))[:, None]).T @ diff / pairs + ridge * np.eye(d), diff.T @ (1 - p) / pairs - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-4:
            break
    z = x @ w
    quantiles = np.quantile(z, np.linspace(0, 1, 1001))
    right = np.array([(z[good] >= c).mean() + (z[bad] < c).mean() for c in quantiles])
    best = quantiles[right >= right.max() - 1e-9]
    return Model(mean, scale, w, float(best.mean()), float(max(z.std() / 3, 1e-6)))


def _sampled(batches: Iterator[pa.RecordBatch], wanted) -> Iterator[pa.RecordBatch]:
    ids = np.array(wanted.value, np.int64)
    for batch in batches:
        batch = batch.filter(pc.is_in(batch.column(0), pa.array(ids)))
        for part, data, bounds in words.chunks(batch, "text"):
            rows = _features(data, bounds)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(rows), pa.list_(pa.float64()))], ["doc_id", "x"])


def _scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, bounds in words.chunks(batch, "text"):
            score = model.score(_features(data, bounds))
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(part.num_columns)), pa.array(score)], [*part.schema.names, "score"])


def trained(docs: DataFrame, labels: DataFrame, folds: int = 5) -> Model:
    """A model of labels (doc_id, quality) from documents whose crc32 of doc_id is not 0 modulo folds.

    MAX_LABELLED documents at most are fitted, the first by a hash of doc_id. A doc_id with both
    labels, or none, teaches nothing; of several documents of one doc_id the one of the least features does.
    """
    spark = docs.sparkSession
    sure = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("top")).where("quality = top")
    kept = sure.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds != 0)
    label = {r[0]: r[1] for r in kept.select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED).collect()}
    wanted = spark.sparkContext.broadcast(sorted(label))
    found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(partial(_sampled, wanted=wanted), "doc_id long, x array<double>")
    # as many rows as labels were chosen: of rows that share a doc_id one teaches
    rows = sorted((r[0], tuple(r[1])) for r in found.groupBy("doc_id").agg(F.min("x").alias("x")).collect())
    width = _features(np.zeros(0, np.uint8), np.zeros(2, np.int64)).shape[1]
    return fit(np.array([x for _, x in rows], np.float64).reshape(-1, width), np.array([label[i] for i, _ in rows]))


def quality(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs.

    held_out: crc32 of doc_id as text is 0 modulo folds (false without doc_id); such rows teach
    nothing. predicted is 1 from a score of THRESHOLD on. Repeated rows get the same score, other
    columns are ignored, empty tables give no rows, and without labels every score is the same.
    """
    model = trained(docs, labels, folds)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(partial(_scored_slim, model=model), "doc_id long, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0, F.lit(False))
    return slim.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def _scored_slim(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for out in _scored(batches, model):
        yield out.select(["doc_id", "score"])


def good_documents(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """docs without those that the model rejects; all columns stay."""
    model = trained(docs, labels, folds)
    plain = docs.select(*docs.columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema) + ", score double"
    return plain.mapInArrow(partial(_scored, model=model), schema).where(F.col("score") >= THRESHOLD).select(*docs.columns)

"""Quality classifier: support vectors over Naive Bayes features.

Indicators of hashed word and punctuation uni- and bigrams are scaled by class log-count ratios and given to a linear
hinge-loss model, which is fitted by dual coordinate descent. The fit uses at most ``max_labelled`` labelled rows (a
sample by the hash of the id) with at most ``max_bytes`` of features; the score of a document is one sparse product against broadcast weights, so scoring is
one narrow pass over the corpus. Labels have two columns, quality and toxic; each has a model of its own over the same
features, and a document is kept if it is of good quality and not toxic. As few rows are toxic, and some of these in a few
words only, the border of that model is where ``FALSE`` of the labelled rows that aren't and that it wasn't fitted on lie
beyond, if that is below 0.

Defined results: a null text has a null score and is rejected; a text without tokens scores the bias; a very long text is
scored whole; a score that ties with the threshold is kept, one that ties with the toxic border isn't toxic; labels with a null
id or class are left out; rows that repeat are scored alike, and count once in the fit; with one class or no labels at all (or no column
``toxic``), every text has the score 0 of that model, by which it is kept. Other columns are carried (:func:`keep_good`) or ignored (:func:`score`).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import PIECE, HashCache, hashed_tokens, mix, slices

BITS = 18
MAX_LABELLED = 12_000
MAX_BYTES = 192 << 20  # of features that reach the driver
THRESHOLD = 0.0
FALSE = 0.01
TOXIC = 0.0  # scores above are toxic


@dataclass
class Model:
    weights: np.ndarray  # of indicators, ratios included
    bias: float
    toxic: Model | None = None  # its scores above 0 are toxic


def features(texts: list[str | None], cache: HashCache, bits: int = BITS) -> list[np.ndarray]:
    """The distinct hashed uni- and bigrams of each text."""
    flat, at = hashed_tokens(texts, cache, PIECE)
    if not len(flat):
        return [np.zeros(0, np.uint32)] * len(texts)
    shift = np.uint64(64 - bits)
    one = (mix(flat) >> shift).astype(np.uint32)
    two = (mix(flat[:-1] * np.uint64(0x9E3779B97F4A7C15) + flat[1:]) >> shift).astype(np.uint32)
    # words that repeat at once share one bigram, and runs of three and four of them another, whatever the word
    again = flat[:-1] == flat[1:]
    two[again] = 1
    three = np.flatnonzero(again[:-1] & again[1:])
    two[three] = 2
    two[three[np.isin(three + 1, three)]] = 3
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        x = np.concatenate([one[a:b], two[a : b - 1]]) if b > a else one[:0]
        x.sort()
        out.append(x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x)
    return out


def fit(rows: list[np.ndarray], good: np.ndarray, bits: int = BITS, smooth: float = 1.0, cost: float = 1.0, blend: float = 0.75, epochs: int = 12, seed: int = 1) -> Model:
    """Log-count ratios, then dual coordinate descent on the L1-hinge dual; ``blend`` interpolates with the ratios' mean weight."""
    y = np.where(good > 0, 1.0, -1.0)
    size = 1 << bits
    if not len(rows) or abs(y.sum()) == len(y):
        return Model(np.zeros(size, np.float32), 0.0)
    p, q = np.full(size, smooth), np.full(size, smooth)
    for x, s in zip(rows, y):
        (p if s > 0 else q)[x] += 1
    ratio = np.where(p + q > 2 * smooth, np.log((p / p.sum()) / (q / q.sum())), 0.0)  # nothing is known of what no labelled row has
    norm = [1 / np.sqrt(max(1, len(x))) for x in rows]
    values = [ratio[x] * n for x, n in zip(rows, norm)]
    diagonal = np.array([v @ v + 1.0 for v in values])
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * len(y) * cost  # classes weigh alike
    w, bias, alpha = np.zeros(size), 0.0, np.zeros(len(rows))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(rows)):
            x, v = rows[i], values[i]
            gradient = y[i] * (w[x] @ v + bias) - 1
            new = min(max(alpha[i] - gradient / diagonal[i], 0.0), share[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[x] += step * v
                bias += step
                most = max(most, abs(step))
                alpha[i] = new
        if most < 1e-3:
            break
    used = np.abs(w) > 0
    mean = np.abs(w[used]).mean() if used.any() else 0.0
    return Model((ratio * (blend * w + (1 - blend) * mean)).astype(np.float32), float(bias))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", toxic_col: str = "toxic", max_labelled: int = MAX_LABELLED, bits: int = BITS, max_bytes: int = MAX_BYTES) -> Model:
    """Fits on the labelled documents, at most ``max_labelled`` of them and, in the same order, ``max_bytes`` of their features: these, not the corpus, bound the driver's share."""
    toxic = F.col(toxic_col) if toxic_col in labels.columns else F.lit(None)
    picked = (
        labels.select(F.col(id_col).cast("long").alias("i"), F.col(label_col).cast("int").alias("y"), toxic.cast("int").alias("z"))
        .where("i IS NOT NULL AND (y IS NOT NULL OR z IS NOT NULL)")
        .groupBy("i").agg(F.min("y").alias("y"), F.max("z").alias("z"))
        .orderBy(F.xxhash64("i"), "i").limit(max_labelled)
    )
    slim = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).where("t IS NOT NULL")
    joined = slim.join(F.broadcast(picked), "i").select("i", "y", "z", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = HashCache()
        for whole in batches:
            for b in slices(whole, "t", 4 << 20):
                x = features(b.column(3).to_pylist(), cache, bits)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([v.tobytes() for v in x], pa.binary())], names=["i", "y", "z", "x"])

    # documents that repeat in full count once, so this is about max_labelled rows, and one window over them is small
    sized = joined.mapInArrow(run, "i long, y int, z int, x binary").dropDuplicates(["i", "x"])
    upto = Window.orderBy(F.xxhash64("i"), "i", "x").rowsBetween(Window.unboundedPreceding, 0)
    got = sized.withColumn("upto", F.sum(F.octet_length("x")).over(upto)).where(F.col("upto") <= max_bytes).drop("upto").toArrow()
    ids = got.column("i").to_numpy()
    order = np.argsort(ids, kind="stable")  # the same fit whatever order the rows came in
    x = got.column("x").to_pylist()

    def labelled(label: str) -> tuple[list[np.ndarray], np.ndarray]:
        y = np.array(got.column(label).to_pylist(), object)[order]
        has = np.flatnonzero([v is not None for v in y])
        return [np.frombuffer(x[k], np.uint32) for k in order[has]], y[has].astype(np.int64)

    model = fit(*labelled("y"), bits)
    rows, bad = labelled("z")
    model.toxic = fit(rows, bad, bits)
    model.toxic.bias -= _border(rows, bad, bits)
    return model


def _border(rows: list[np.ndarray], bad: np.ndarray, bits: int) -> float:
    """The score that ``FALSE`` of the other rows exceed under a model fitted on two thirds, at most 0."""
    held = np.arange(len(rows)) % 3 == 2
    part = fit([rows[k] for k in np.flatnonzero(~held)], bad[~held], bits)
    fine = _products([rows[k] for k in np.flatnonzero(held & (bad <= 0))], part)
    return min(0.0, float(np.quantile(fine, 1 - FALSE, method="higher"))) if len(fine) else 0.0


def _scores(texts: list[str | None], model: Model, cache: HashCache) -> np.ndarray:
    return _both(texts, model, cache)[0]


def _both(texts: list[str | None], model: Model, cache: HashCache) -> tuple[np.ndarray, np.ndarray]:
    """Scores of quality and of toxicity."""
    rows = features(texts, cache, int(len(model.weights)).bit_length() - 1)
    return _products(rows, model), _products(rows, model.toxic) if model.toxic else np.zeros(len(rows))


def _products(rows: list[np.ndarray], model: Model) -> np.ndarray:
    length = np.array([len(x) for x in rows], np.int64)
    if not length.sum():
        return np.full(len(rows), model.bias)
    total = np.concatenate(([0.0], np.cumsum(model.weights[np.concatenate(rows)], dtype=np.float64)))
    end = np.cumsum(length)
    return np.round((total[end] - total[end - length]) / np.sqrt(np.maximum(length, 1)) + model.bias, 6)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, toxic_score, kept) for every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = HashCache()
        for whole in batches:
            for b in slices(whole, "text", 4 << 20):
                texts = b.column(1)
                s, z = _both(texts.to_pylist(), sent.value, cache)
                null = texts.is_null().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, mask=null), pa.array(z, mask=null), pa.array((s >= threshold) & (z <= TOXIC) & ~null)], names=["doc_id", "score", "toxic_score", "kept"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double, toxic_score double, kept boolean")


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``threshold`` and isn't toxic, all columns as they were."""
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = HashCache()
        for whole in batches:
            for b in slices(whole, text_col, 4 << 20):
                texts = b.column(at)
                s, z = _both(texts.to_pylist(), sent.value, cache)
                yield b.filter(pa.array((s >= threshold) & (z <= TOXIC) & ~texts.is_null().to_numpy(zero_copy_only=False)))

    return docs.mapInArrow(run, docs.schema)

"""Toxicity by a classifier chain.

Categories are predicted one after another by linear (logistic) models on hashed words; the models of later categories
also read the probabilities of earlier ones. In training these are out-of-fold: FOLDS models, each fitted without a
fold, predict that fold, so that a later model learns from probabilities as uncertain as those it will meet.

The models are fitted on the driver, on at most SAMPLE labelled documents, those of the least hash of their id: a fixed
number of words, weights and steps whatever the input."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import words as W
from gridloom.llm.workers import prepare, tidy

SAMPLE = 4_000
#: Words, and their first so many bytes, are hashed to 2**FEATURE_BITS features.
BEGINNINGS, FEATURE_BITS = (4, 5, 6), 20
FOLDS = 3
#: A chance dependence this strong has a probability of about 4e-8 a word.
MIN_CHI2 = 30.0
STEPS, PENALTY = 150, 0.2
_DIM = 1 << FEATURE_BITS


def features(column: pa.Array, used: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """For each text, its distinct hashed words and word beginnings; used: which of all are of interest."""
    for g in W.groups(column, W.ALNUM):
        parts, bounds = [g.hashes()], g.bounds()
        for k in BEGINNINGS:
            salt = np.uint64(0x9E3779B97F4A7C15 * k & 0xFFFFFFFFFFFFFFFF)
            parts.append(W.mix(W.span_hashes(g.buf, g.starts, np.minimum(g.starts + k, g.ends)) ^ salt))
        f = (np.stack(parts) >> np.uint64(64 - FEATURE_BITS)).astype(np.int32)
        if used is None:
            for r in range(g.rows):
                yield np.unique(f[:, bounds[r] : bounds[r + 1]])
            continue
        which, word = np.nonzero(used[f])
        hits = f[which, word]
        row = g.row[word]
        order = np.lexsort((hits, row))
        row, hits = row[order], hits[order]
        cuts = np.searchsorted(row, np.arange(g.rows + 1))
        for r in range(g.rows):
            yield np.unique(hits[cuts[r] : cuts[r + 1]])


@dataclass
class Linear:
    weights: np.ndarray
    chain: np.ndarray
    bias: float

    def scores(self, flat: np.ndarray, begin: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(self.weights[flat])])
        z = sums[begin[1:]] - sums[begin[:-1]] + self.bias + earlier @ self.chain
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def chi_square(seen: np.ndarray, seen_positive: np.ndarray, n: int, positive: float) -> np.ndarray:
    """For each word, of the two-by-two table of its presence and the label."""
    expected = seen * positive / max(n, 1)
    spread = expected * (1 - positive / max(n, 1)) * (1 - seen / max(n, 1))
    return np.where((seen >= 5) & (spread > 0), (seen_positive - expected) ** 2 / np.maximum(spread, 1e-12), 0.0)


def fit_linear(flat: np.ndarray, begin: np.ndarray, earlier: np.ndarray, y: np.ndarray) -> Linear:
    """Logistic regression by Adam on all rows at once, with a quadratic penalty, on the features whose presence depends
    on the label beyond chance (chi-square over MIN_CHI2), as rare words would learn single labels by heart."""
    row = np.repeat(np.arange(len(y), dtype=np.int32), np.diff(begin))
    chosen = np.flatnonzero(chi_square(np.bincount(flat, minlength=_DIM), np.bincount(flat, y[row], minlength=_DIM), len(y), y.sum()) > MIN_CHI2)
    place = np.full(_DIM, -1)
    place[chosen] = np.arange(len(chosen))
    keep = place[flat] >= 0
    row, col, m = row[keep], place[flat[keep]], len(chosen)
    w, bias = np.zeros(m + earlier.shape[1]), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    first, second = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, STEPS + 1):
        z = np.bincount(row, w[col], minlength=len(y)) + earlier @ w[m:] + bias
        off = 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))) - y
        grad = np.concatenate([np.bincount(col, off[row], minlength=m), earlier.T @ off, [off.sum()]])
        grad[:-1] += PENALTY * w
        grad /= max(len(y), 1)
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad * grad
        step = 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-9)
        w, bias = w - step[:-1], bias - float(step[-1])
    weights = np.zeros(_DIM)
    weights[chosen] = w[:m]
    return Linear(weights, w[m:], bias)


def fit_chain(texts: list[str], labels: np.ndarray) -> list[Linear]:
    """One model a column of labels (0 and 1), in order."""
    parts = list(features(pa.array(texts, pa.string())))
    begin, flat = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64), np.concatenate([*parts, np.zeros(0, np.int32)])
    n, fold = len(texts), np.arange(len(texts)) % FOLDS
    earlier, models = np.zeros((n, 0)), []

    def rows(which: np.ndarray):
        some = [flat[begin[i] : begin[i + 1]] for i in which]
        return np.concatenate([*some, np.zeros(0, np.int32)]), np.concatenate([[0], np.cumsum([len(s) for s in some])]).astype(np.int64)

    for k in range(labels.shape[1]):
        y = labels[:, k].astype(float)
        models.append(fit_linear(flat, begin, earlier, y))
        out = np.zeros(n)
        for f in range(FOLDS if k + 1 < labels.shape[1] else 0):
            train, test = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            model = fit_linear(*rows(train), earlier[train], y[train])
            out[test] = model.scores(*rows(test), earlier[test])
        earlier = np.column_stack([earlier, out])
    return models


def sample(docs: DataFrame, labels: DataFrame, categories: list[str], most: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Texts and labels of at most `most` documents of which all categories are labelled. The ids are picked first, so
    that only the sample's texts are moved. Of several rows of an id, in either table, one is taken."""
    known = F.lit(True)
    for c in categories:
        known &= F.col(c).isNotNull()
    picked = labels.where(known & F.col("doc_id").isNotNull()).dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    picked = picked.select(F.col("doc_id").alias("__id"), *[F.col(c).cast("int").alias(f"__{c}") for c in categories])
    rows = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("__id"))
    rows = rows.select("__id", F.col("text").cast("string").alias("text"), *[f"__{c}" for c in categories]).dropDuplicates(["__id"]).toPandas().sort_values("__id")
    return rows.text.tolist(), (rows[[f"__{c}" for c in categories]].to_numpy() > 0).astype(int)


def predict(docs: DataFrame, models: list[Linear], categories: list[str], threshold: float = 0.5) -> DataFrame:
    """The rows of docs with a column p_<category> for each and `toxic_pred` (the last one's probability is at least the
    threshold). A null or empty text has probability 0 in all; texts of any length are read whole. Columns of these names
    are replaced, others and repeated rows kept."""
    spark: SparkSession = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(models)
    new = [*(f"p_{c}" for c in categories), "toxic_pred"]
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in new))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + [f"`{c}` double" for c in new[:-1]] + ["toxic_pred boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used = np.any([m.weights != 0 for m in shared.value], axis=0)
        for b in batches:
            parts = list(features(b.column("text"), used))
            begin = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
            flat = np.concatenate([*parts, np.zeros(0, np.int32)])
            earlier = np.zeros((b.num_rows, 0))
            for model in shared.value:
                earlier = np.column_stack([earlier, model.scores(flat, begin, earlier)])
            earlier[[not t for t in b.column("text").to_pylist()]] = 0.0
            cols = [pa.array(earlier[:, k]) for k in range(earlier.shape[1])]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols, pa.array(earlier[:, -1] >= threshold)], [*b.schema.names, *new])

    return docs.mapInArrow(tidy(run), schema)


def toxicity(docs: DataFrame, labels: DataFrame, categories: list[str], threshold: float = 0.5) -> DataFrame:
    """Fits the chain on labels (doc_id and a column of 0 and 1 for each category) and predicts docs. Without a labelled
    document all probabilities are those of an unfitted model, 0.5, cut to `toxic_pred` false."""
    texts, y = sample(docs, labels, categories)
    if not texts:
        models = [Linear(np.zeros(_DIM), np.zeros(k), 0.0) for k in range(len(categories))]
        return predict(docs, models, categories, 1.0)
    return predict(docs, fit_chain(texts, y), categories, threshold)

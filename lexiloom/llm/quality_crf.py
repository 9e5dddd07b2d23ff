"""Quality classifier: a linear-chain conditional random field labels every line good or bad.

A line's features are its own shape (characters, words, repetitions) and those of the lines before and
after it. Forward-backward marginals of label good, weighted by line length, average to the document's
raw quality; a logistic curve fitted on the training documents turns that into a probability.

Training: labelled documents outside the held-out fold (crc32 of the doc_id as text, modulo 4, is 2), at
most ``sample`` of them in the order of a hash of the doc_id; executors turn them into features. Every line
carries its document's label. Inputs are texts alone: labels, language, source and doc_id never are.

Defined results: NULL and empty texts are one empty line and get a score; without labels of both kinds all
scores are the share of good labels (0.5 without any); NULL doc_ids are never held out; repeated rows get equal
scores; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import release, small_batches, stored

FOLDS, HELD, SAMPLE, THRESHOLD = 4, 2, 4000, 0.7
#: Features that a line also sees of its neighbours.
BASE = 16
FEATURES = 3 * BASE + 3
SYMBOLS = re.compile(r"[^\w\s]{2,}")
LONE = re.compile(r"(?<!\S)[^\w\s]+(?!\S)")
CHARS = re.compile(r"[^\w\s]")
DIGITS = re.compile(r"\d")


def line_shape(line: str) -> list[float]:
    words = line.split()
    n, chars = len(words), len(line)
    if not n:
        return [0.0] * (BASE - 1) + [1.0]
    lower = line.lower()
    kinds = len(set(lower.split()))
    twice = sum(a == b for a, b in zip(words, words[1:]))
    upper = sum(w.isupper() for w in words if len(w) > 1)
    capital = sum(w[0].isupper() for w in words)
    solid = chars - n + 1
    punctuation = len(CHARS.findall(line))
    doubled = len(SYMBOLS.findall(line))
    return [
        np.log1p(chars),
        np.log1p(n),
        solid / n / 10,
        punctuation / solid,
        doubled / n,
        len(LONE.findall(line)) / n,
        len(DIGITS.findall(line)) / solid,
        upper / n,
        capital / n,
        1 - kinds / n,
        (1 - kinds / n) * np.log1p(n),
        twice / n,
        float(line[-1] in ".!?"),
        float(doubled > 2),
        max(map(len, words)) / 30,
        0.0,
    ]


def document_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Features of each line that has words (one empty line if none has), and the lines' lengths."""
    lines = [x for x in (text or "").split("\n") if x.strip()] or [""]
    shape = np.array([line_shape(x) for x in lines], np.float32)
    size = np.array([len(x) + 1 for x in lines], np.float64)
    none = np.zeros((1, BASE), np.float32)
    before, after = np.vstack([none, shape[:-1]]), np.vstack([shape[1:], none])
    edge = np.zeros((len(lines), 3), np.float32)
    edge[0, 0] = edge[-1, 1] = 1
    edge[1:, 2] = [a == b for a, b in zip(lines, lines[1:])]
    return np.hstack([shape, before, after, edge]), size


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # of label good against bad, the constant last
    change: np.ndarray  # 2 x 2, from label to label
    slope: float
    shift: float
    constant: float | None = None  # the score of every text, if nothing could be learnt


def batches_of(lengths: np.ndarray, cells: int = 200_000) -> list[np.ndarray]:
    """Indexes of documents of like length, few enough to be padded together."""
    order, out, lo = np.argsort(lengths, kind="stable"), [], 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and (hi + 1 - lo) * lengths[order[hi]] <= cells:
            hi += 1
        out.append(order[lo:hi])
        lo = hi
    return out


def forward_backward(unary: np.ndarray, lengths: np.ndarray, change: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of padded documents (n, lines): marginals of good, expected changes (n, 2, 2), log normalisers.

    ``unary`` is the score of label good; label bad scores 0.
    """
    n, m = unary.shape
    emit = np.stack([np.zeros_like(unary), unary], 2)
    alpha, beta = np.empty((n, m, 2)), np.zeros((n, m, 2))
    alpha[:, 0] = emit[:, 0]
    for t in range(1, m):
        step = alpha[:, t - 1, :, None] + change
        alpha[:, t] = np.logaddexp(step[:, 0], step[:, 1]) + emit[:, t]
    for t in range(m - 2, -1, -1):
        step = change + (emit[:, t + 1] + beta[:, t + 1])[:, None, :]
        beta[:, t] = np.where((t + 1 < lengths)[:, None], np.logaddexp(step[..., 0], step[..., 1]), 0)
    end = alpha[np.arange(n), lengths - 1]
    z = np.logaddexp(end[:, 0], end[:, 1])
    good = np.exp(np.minimum(0, alpha[:, :, 1] + beta[:, :, 1] - z[:, None]))
    pairs = np.zeros((n, 2, 2))
    for t in range(1, m):
        joint = alpha[:, t - 1, :, None] + change + (emit[:, t] + beta[:, t])[:, None, :] - z[:, None, None]
        pairs += np.where((t < lengths)[:, None, None], np.exp(np.minimum(0, joint)), 0)
    return good, pairs, z


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def raw_quality(docs: list[tuple[np.ndarray, np.ndarray]], model: Model) -> np.ndarray:
    """Length-weighted mean marginal of each document, as a logit."""
    if not docs:
        return np.zeros(0)
    lengths = np.array([len(s) for _, s in docs])
    unary = (np.vstack([x for x, _ in docs]) - model.mean) / model.scale @ model.weights[:-1] + model.weights[-1]
    first, out = np.concatenate([[0], np.cumsum(lengths)]), np.empty(len(docs))
    for group in batches_of(lengths):
        m = lengths[group].max()
        padded = np.zeros((len(group), m))
        for i, d in enumerate(group):
            padded[i, : lengths[d]] = unary[first[d] : first[d + 1]]
        good, _, _ = forward_backward(padded, lengths[group], model.change)
        for i, d in enumerate(group):
            size = docs[d][1]
            out[d] = good[i, : lengths[d]] @ size / size.sum()
    out = np.clip(out, 1e-6, 1 - 1e-6)
    return np.log(out / (1 - out))


def fit(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rounds: int = 120, ridge: float = 1e-3) -> Model:
    """Maximum likelihood with a ridge by Adam over all documents, then the logistic curve by Newton's method."""
    zeros = np.zeros(FEATURES)
    if len(set(labels.tolist())) < 2:
        return Model(zeros, zeros + 1, np.zeros(FEATURES + 1), np.zeros((2, 2)), 1, 0, float(labels.mean()) if len(labels) else 0.5)
    lengths = np.array([len(s) for _, s in docs])
    x = np.vstack([d for d, _ in docs]).astype(np.float64)
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-6] = 1
    x = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    first = np.concatenate([[0], np.cumsum(lengths)])
    groups = []
    for group in batches_of(lengths, 50_000):
        rows = np.full((len(group), lengths[group].max()), -1)
        for i, d in enumerate(group):
            rows[i, : lengths[d]] = np.arange(first[d], first[d + 1])
        groups.append((group, rows, rows >= 0))
    # each document weighs the same, whatever its number of lines
    share = np.repeat(1 / lengths, lengths)
    per = 1 / lengths
    y = np.repeat(labels, lengths).astype(np.float64)
    w, change = np.zeros(FEATURES + 1), np.zeros((2, 2))
    state = [np.zeros(FEATURES + 5) for _ in range(2)]
    for step in range(1, rounds + 1):
        u, good, moves = x @ w, np.zeros(len(x)), np.zeros((2, 2))
        for group, rows, real in groups:
            g, pairs, _ = forward_backward(np.where(real, u[rows], 0), lengths[group], change)
            good[rows[real]] = g[real]
            seen = np.zeros((len(group), 2, 2))
            seen[np.arange(len(group)), labels[group], labels[group]] = lengths[group] - 1
            moves += ((pairs - seen) * per[group][:, None, None]).sum(0)
        grad = np.concatenate([x.T @ ((good - y) * share) / len(docs) + ridge * w, (moves / len(docs)).ravel() + 0.05 * change.ravel()])
        state[0] = 0.9 * state[0] + 0.1 * grad
        state[1] = 0.99 * state[1] + 0.01 * grad**2
        move = 0.1 * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-8)
        w, change = w - move[:-4], change - move[-4:].reshape(2, 2)
    model = Model(mean, scale, w, change, 1.0, 0.0)
    raw = raw_quality(docs, model)
    z, b = np.stack([raw, np.ones_like(raw)], 1), np.array([1.0, 0.0])
    for _ in range(25):
        p = sigmoid(z @ b)
        hess = (z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2)
        b -= np.linalg.solve(hess, z.T @ (p - labels) + 1e-2 * (b - [1, 0]))
    model.slope, model.shift = float(b[0]), float(b[1])
    return model


def scores(texts: list[str | None], model: Model) -> np.ndarray:
    if model.constant is not None:
        return np.full(len(texts), model.constant)
    return sigmoid(raw_quality([document_features(t) for t in texts], model) * model.slope + model.shift)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled documents outside the held-out fold."""
    chosen = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)").where(~held_out(F.col("doc_id")))
    chosen = chosen.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(stored(chosen, "sample")), "doc_id")

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [document_features(t) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "quality": b["quality"], "x": [x.tobytes() for x, _ in made], "size": [s.tobytes() for _, s in made]})

    got = rows.mapInPandas(features, "doc_id long, quality int, x binary, size binary").collect()
    got.sort(key=lambda r: (r.doc_id, bytes(r.x)))
    made = [(np.frombuffer(r.x, np.float32).reshape(-1, FEATURES), np.frombuffer(r["size"], np.float64)) for r in got]
    labels_of = np.array([r.quality for r in got], np.int64)
    del got
    model = fit(made, labels_of)
    # the driver keeps no room of the training through later stages
    del made
    release()
    return model


def score(docs: DataFrame, model: Model, *, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with columns score (double) and predicted (int)."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            parts = [scores(texts.iloc[lo : lo + 256].tolist(), model) for lo in range(0, len(texts), 256)]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))
        release()

    small_batches(docs.sparkSession)
    mark = F.pandas_udf(run, "double")
    out = docs.withColumn("score", mark(F.coalesce("text", F.lit(""))))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))

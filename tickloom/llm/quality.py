"""A quality classifier learned from trusted positives and unlabelled text.

A linear score over frequencies of byte-class trigrams, shares of byte classes and of repeated words is fitted by minimising the non-negative unbiased risk
pi * E_P[l(g, +1)] + max(0, E_U[l(g, -1)] - pi * E_P[l(g, -1)])
with logistic loss, pi being the share of positives in unlabelled text, estimated from margins that models of the other
half of the texts give. A second such fit of two numbers makes margins scores. No label but the trusted 1 is used. As the score is linear in
frequencies, their part of it is the mean of the weights at a text's trigrams: one look-up for each byte of whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.bytetext import Powers, pieces, raw, words

FEATURES = 4096
SHAPES = 67
#: How much features count before learning: thousands of rare trigrams little each, repeated words most.
EMPHASIS = np.concatenate([np.full(FEATURES, 0.03), np.ones(64), np.full(3, 3.0)])


def _byte_classes() -> np.ndarray:
    """64 classes: letters a-z, a capital, a digit, line break, blank, each ASCII sign, bytes of other scripts."""
    out = np.full(256, 63, np.uint8)
    out[97:123] = np.arange(26)
    out[65:91] = 26
    out[48:58] = 27
    out[[10, 13]] = 28
    out[[9, 11, 12, 32]] = 29
    signs = [b for b in range(33, 127) if not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123)]
    out[signs] = 30 + np.arange(len(signs))
    out[0:9] = out[14:32] = 62
    return out


CLASSES = _byte_classes()
#: The feature of each of the 64**3 trigrams.
FEATURE = ((np.arange(1 << 18, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)).astype(np.int64)


def codes(data: np.ndarray) -> np.ndarray:
    c = CLASSES[data].astype(np.int32)
    return (c[:-2] << 12) | (c[1:-1] << 6) | c[2:]


def shapes(data: np.ndarray, offsets: np.ndarray, powers: Powers) -> np.ndarray:
    """Per row: square roots of the shares of the byte classes, and the shares of words that repeat the one 1, 2 or 3 before."""
    n = len(offsets) - 1
    out = np.zeros((n, SHAPES))
    length = np.diff(offsets)
    for i in range(n):
        out[i, :64] = np.bincount(CLASSES[data[offsets[i] : offsets[i + 1]]], minlength=64)
    out[:, :64] = np.sqrt(out[:, :64] / np.maximum(length, 1)[:, None])
    hashes, first = words(data, offsets, powers)
    row = np.repeat(np.arange(n), np.diff(first))
    for k in (1, 2, 3):
        same = (hashes[k:] == hashes[:-k]) & (row[k:] == row[:-k])
        out[:, 63 + k] = np.bincount(row[k:][same], minlength=n) / np.maximum(np.diff(first), 1)
    return out


def features(texts: list[str]) -> np.ndarray:
    """Rows of trigram frequencies and shapes, for learning."""
    data, offsets = raw(pa.array(texts, pa.string()))
    out = np.zeros((len(texts), FEATURES + SHAPES), np.float32)
    out[:, FEATURES:] = shapes(data, offsets, Powers())
    for i in range(len(texts)):
        k = codes(data[offsets[i] : offsets[i + 1]])
        out[i, :FEATURES] = np.bincount(FEATURE[k], minlength=FEATURES) / max(len(k), 1)
    return out


def damping(n_bytes: np.ndarray) -> np.ndarray:
    """How much a text's features count: the few bytes of a short one say little of it."""
    return n_bytes / (n_bytes + 20.0)


@dataclass
class QualityModel:
    """weights of features, their value at the mean text, bias, the prior that was used, and the map from margin to score."""

    weights: np.ndarray
    center: float
    bias: float
    prior: float
    slope: float = 1.0
    shift: float = 0.0

    def margins(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray, powers: Powers) -> np.ndarray:
        out = shapes(data, offsets, powers) @ self.weights[FEATURES:] - self.center
        length = np.diff(offsets) - 2
        some = np.flatnonzero(length > 0)
        if len(some):
            w = np.concatenate([[0.0], np.cumsum(table[codes(data)], dtype=np.float64)])
            out[some] += (w[offsets[1:][some] - 2] - w[offsets[:-1][some]]) / length[some]
        return self.bias + damping(np.diff(offsets)) * out

    def scores(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -40, 40)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The largest share of positives that the tail of the unlabelled scores allows."""
    cuts = np.quantile(positive, np.linspace(0.02, 0.6, 30))
    ratio = [(unlabelled >= c).mean() / max((positive >= c).mean(), 1e-9) for c in cuts]
    return float(np.clip(min(ratio), 0.05, 0.99))


def fit_nnpu(x: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, prior: float, epochs: int = 60, batch: int = 512, rate: float = 0.03, decay: float = 1e-4, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights and bias on scaled features x that minimise the non-negative risk over the rows named, by Adam on minibatches."""
    rng = np.random.default_rng(seed)
    w, b = np.zeros(x.shape[1]), 0.0
    m, v, step = np.zeros(len(w) + 1), np.zeros(len(w) + 1), 0
    rounds = max(1, -(-max(len(positive), len(unlabelled)) // batch))
    for epoch in range(epochs):
        for _ in range(rounds):
            xp = x[positive[rng.integers(0, len(positive), min(batch, len(positive)))]]
            xu = x[unlabelled[rng.integers(0, len(unlabelled), min(batch, len(unlabelled)))]]
            low = w.astype(np.float32)
            gp, gu = (xp @ low).astype(np.float64) + b, (xu @ low).astype(np.float64) + b
            # Losses: log(1 + e^-g) for +1 and log(1 + e^g) for -1.
            negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
            dp, du = -prior * _sigmoid(-gp) / len(gp), np.zeros(len(gu))
            if negative >= 0:
                du = _sigmoid(gu) / len(gu)
                dp -= prior * _sigmoid(gp) / len(gp)
            else:  # the risk of negatives has gone below nothing: step back along it alone
                du = -_sigmoid(gu) / len(gu)
                dp = prior * _sigmoid(gp) / len(gp)
            g = np.append(dp.astype(np.float32) @ xp + du.astype(np.float32) @ xu + decay * w, dp.sum() + du.sum())
            step += 1
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            move = rate * (1 - epoch / epochs) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            w, b = w - move[:-1], b - move[-1]
    return w, b


def _calibrate(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and shift that minimise the unbiased logistic risk of margins that their own models have not learned from (Newton steps, lightly held back)."""
    margin = np.concatenate([positive, unlabelled, positive])
    scale = max(float(margin.std()), 1e-9)
    x = np.stack([margin / scale, np.ones(len(margin))], 1)
    # pi E_P[l(+1)] + E_U[l(-1)] - pi E_P[l(-1)]; with logistic loss l(+1) - l(-1) is minus the margin.
    weight = np.concatenate([np.full(len(positive), prior / len(positive)), np.full(len(unlabelled), 1 / len(unlabelled)), np.zeros(len(positive))])
    pull = prior * x[: len(positive)].mean(0)
    t = np.array([0.0, 0.0])
    use = slice(len(positive), len(positive) + len(unlabelled))
    for _ in range(100):
        p = _sigmoid(x[use] @ t)
        grad = x[use].T @ (weight[use] * p) - pull + 1e-3 * t
        t -= np.linalg.solve((x[use] * (weight[use] * p * (1 - p))[:, None]).T @ x[use] + 1e-3 * np.eye(2), grad)
    return (float(t[0]) / scale, float(t[1])) if t[0] > 0 and np.isfinite(t).all() else (1.0, 0.0)


def fit(docs: DataFrame, labels: DataFrame, usable: Column, most: int = 1000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", seed: int = 5) -> QualityModel | None:
    """Learn from label 1 of rows where `usable` (a condition on the id) holds; None without trusted positives or other text.

    most: about so many texts of each kind (label 1, unlabelled) are taken by a hash of the id, which bounds what the
    one task that learns holds. No other label is read: texts without any are the unlabelled ones (where all have one,
    all texts are), and the share of positives among them is estimated. Ids with labels that differ are left out, as
    are null ids, texts and labels. Repeated rows count as often as they are there.
    """
    named = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("low"), F.max(label_col).cast("int").alias("high"))
    trusted = named.where((F.col("low") == 1) & (F.col("high") == 1) & usable).select("id")
    seen_ids, positives = named.agg(F.count(F.lit(1)), F.sum(((F.col("low") == 1) & (F.col("high") == 1) & usable).cast("long"))).first()
    texts = docs.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    total = docs.count()
    if not positives or not total:
        return None
    draw = F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # Bounded by about `most` ids, so it can be broadcast.
    picked = trusted.where(draw < min(1.0, most / positives))
    seen = texts.join(F.broadcast(picked), "id").select("id", "text", F.lit(1).alias("label"))
    free = total - seen_ids
    other = texts.where(draw < min(1.0, most / (free if free > 0 else total)))
    if free > 0:
        other = other.join(named.select("id"), "id", "left_anti")
    other = other.select("id", "text", F.lit(-1).alias("label"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for b in batches for r in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True))
        model = _learned([r[1] for r in rows], np.array([r[2] for r in rows], dtype=np.int64), seed)
        if model:
            yield pa.RecordBatch.from_arrays([pa.array([m.tobytes() for m in [model.weights]], pa.binary()), pa.array([[model.center, model.bias, model.prior, model.slope, model.shift]], pa.list_(pa.float64()))], names=["weights", "rest"])

    # The bounded sample is learned from in one task, which leaves the driver's memory alone.
    got = seen.unionByName(other).repartition(1).mapInArrow(learn, "weights binary, rest array<double>").first()
    if got is None:
        return None
    center, bias, prior, slope, shift = got["rest"]
    return QualityModel(np.frombuffer(bytes(got["weights"]), np.float64).copy(), center, bias, prior, slope, shift)


def _learned(texts: list[str], y: np.ndarray, seed: int) -> QualityModel | None:
    """A model from texts with labels 1 and -1 (unlabelled)."""
    if not (y == 1).any() or not (y == -1).any():
        return None
    x = features(texts)
    damp = damping(np.array([len(t.encode()) for t in texts])).astype(np.float32)
    mean = x.mean(axis=0)
    x -= mean
    scale = np.concatenate([EMPHASIS[i : i + 256] / (x[:, i : i + 256].std(axis=0) + 1e-4) for i in range(0, x.shape[1], 256)]).astype(np.float32)
    x *= scale
    x *= damp[:, None]
    positive, unlabelled = np.flatnonzero(y == 1), np.flatnonzero(y == -1)

    def crossed(prior: float) -> np.ndarray:
        """Margins of every text by a model of the other half."""
        out = np.zeros(len(y))
        for k in (0, 1):
            parts = [r[k::2] if len(r) > 1 else r for r in (positive, unlabelled)]
            w, b = fit_nnpu(x, *parts, prior, seed=seed)
            other = np.concatenate([r[1 - k :: 2] if len(r) > 1 else r for r in (positive, unlabelled)])
            out[other] = x[other] @ w.astype(np.float32) + b
        return out

    margin = crossed(0.5)
    prior = estimate_prior(margin[positive], margin[unlabelled])
    margin = crossed(prior)
    w, b = fit_nnpu(x, positive, unlabelled, prior, seed=seed)
    slope, shift = _calibrate(margin[positive], margin[unlabelled], prior)
    return QualityModel((w * scale).astype(np.float64), float((w * scale) @ mean), float(b), float(prior), slope, shift)


def score(docs: DataFrame, model: QualityModel | None, keep: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, score (0 to 1) and the columns in `keep`; from the whole text alone.

    A null text counts as empty; an empty one gets the score of the bias. Without a model every score is 0.5.
    Rows keep their multiplicity; a null id stays null.
    """
    extra = [c for c in keep if c != id_col]
    schema = ", ".join([f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}", "score double", *(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in extra)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, powers = (model.weights[FEATURE].astype(np.float32), Powers()) if model else (None, None)
        for batch in batches:
            for part in pieces(batch, "_text"):
                data, offsets = raw(part.column("_text"))
                s = model.scores(model.margins(data, offsets, table, powers)) if model else np.full(part.num_rows, 0.5)
                yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(s, pa.float64()), *(part.column(c) for c in extra)], names=[id_col, "score", *extra])

    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), *extra)
    return slim.mapInArrow(run, schema)


def keep(docs: DataFrame, model: QualityModel | None, threshold: float, text_col: str = "text") -> DataFrame:
    """The rows of docs whose score is `threshold` or more, with all their columns; all rows without a model."""
    if model is None:
        return docs
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, powers = model.weights[FEATURE].astype(np.float32), Powers()
        for batch in batches:
            for part in pieces(batch, at):
                s = model.scores(model.margins(*raw(part.column(at)), table, powers))
                yield part.filter(pa.array(s >= threshold))

    return docs.mapInArrow(run, docs.schema)

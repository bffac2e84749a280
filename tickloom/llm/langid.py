"""Language identification with a byte convolutional network, written and trained in numpy.

Texts are cut into windows of a fixed number of bytes. Filters of several widths slide over one-hot bytes,
each filter keeps its largest response in the window, and a softmax layer names the language; a text's
probabilities are the mean over all its windows, by their length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.bytetext import pieces, raw

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 8
#: What a text without a letter, or a null one, gets.
UNKNOWN = "und"


def windows(data: np.ndarray, offsets: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows filled up with zeros, row of each, bytes in each): all bytes of all rows, in order."""
    length = np.diff(offsets)
    many = -(-length // size)
    row = np.repeat(np.arange(len(length)), many)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    start = offsets[:-1][row] + nth * size
    used = np.minimum(size, offsets[1:][row] - start)
    padded = np.concatenate([data, np.zeros(size, np.uint8)])
    out = np.lib.stride_tricks.sliding_window_view(padded, size)[start]
    short = used < size
    out[short] *= np.arange(size) < used[short, None]
    return out, row, used


@dataclass
class ByteNet:
    """filters[w]: (width, 256, FILTERS); then bias, ReLU, and a dense softmax layer."""

    labels: list[str]
    filters: list[np.ndarray]
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray

    def tables(self) -> list[list[tuple[int, int, np.ndarray]]]:
        """For each width, (offset, bytes it spans, responses): two bytes are looked up at once."""
        out = []
        for f in self.filters:
            parts = []
            for k in range(0, len(f), 2):
                if k + 1 < len(f):
                    parts.append((k, 2, (f[k][:, None, :] + f[k + 1][None, :, :]).reshape(65536, -1).astype(np.float32)))
                else:
                    parts.append((k, 1, f[k].astype(np.float32)))
            out.append(parts)
        return out

    def pooled(self, x: np.ndarray, tables, want_where: bool = False):
        """Largest response of each filter in each window, and where it is."""
        pair = (x[:, :-1].astype(np.int32) << 8) | x[:, 1:]
        best, where = [], []
        for f, parts in zip(self.filters, tables, strict=True):
            span = x.shape[1] - len(f) + 1
            total = None
            for k, n, t in parts:
                got = np.take(t, (pair if n == 2 else x)[:, k : k + span], axis=0)
                total = got if total is None else np.add(total, got, out=total)
            if want_where:
                at = total.argmax(axis=1)
                where.append(at)
                best.append(np.take_along_axis(total, at[:, None, :], 1)[:, 0])
            else:
                best.append(total.max(axis=1))
        return np.concatenate(best, 1), where

    def probabilities(self, x: np.ndarray, tables=None, block: int = 256) -> np.ndarray:
        tables = tables or self.tables()
        out = np.zeros((len(x), len(self.labels)), np.float32)
        for i in range(0, len(x), block):
            h = np.maximum(self.pooled(x[i : i + block], tables)[0] + self.bias, 0)
            out[i : i + block] = _softmax(h @ self.dense + self.dense_bias)
        return out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(x: np.ndarray, y: np.ndarray, labels: list[str], epochs: int = 12, batch: int = 128, rate: float = 0.01, seed: int = 7) -> ByteNet:
    """Adam on the cross entropy of windows x with label numbers y, classes weighed evenly."""
    rng = np.random.default_rng(seed)
    n_filters = FILTERS * len(WIDTHS)
    net = ByteNet(labels, [rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS], np.zeros(n_filters, np.float32), rng.normal(0, 0.3, (n_filters, len(labels))).astype(np.float32), np.zeros(len(labels), np.float32))
    weigh = len(y) / np.maximum(np.bincount(y, minlength=len(labels)), 1) / len(labels)
    params = [*net.filters, net.bias, net.dense, net.dense_bias]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(y), batch):
            idx = order[i : i + batch]
            xb, yb = x[idx], y[idx]
            pooled, where = net.pooled(xb, net.tables(), True)
            h = np.maximum(pooled + net.bias, 0)
            dz = _softmax(h @ net.dense + net.dense_bias)
            dz[np.arange(len(yb)), yb] -= 1
            dz *= (weigh[yb] / len(yb))[:, None].astype(np.float32)
            dh = (dz @ net.dense.T) * (h > 0)
            grads = []
            for w, (f, at) in enumerate(zip(net.filters, where, strict=True)):
                g, part = np.zeros_like(f), dh[:, w * FILTERS : (w + 1) * FILTERS]
                cols = np.broadcast_to(np.arange(FILTERS), at.shape)
                for k in range(len(f)):
                    np.add.at(g[k], (np.take_along_axis(xb, at + k, 1), cols), part)
                grads.append(g)
            grads += [dh.sum(0), h.T @ dz, dz.sum(0)]
            step += 1
            lr = rate * (1 - epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for p, g, a, b in zip(params, grads, m, v, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= (lr * a / (np.sqrt(b) + 1e-7)).astype(np.float32)
    return net


def fit(docs: DataFrame, usable: Column, per_label: int = 600, windows_per_text: int = 8, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", seed: int = 7) -> ByteNet | None:
    """Learn from rows where `usable` holds and label and text are not null; None if there are none.

    per_label: about so many texts of each label are taken, by a hash of the id, and windows_per_text windows spread
    over each of them; this bounds what the driver holds by the number of labels alone.
    """
    rows = docs.where(usable & F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("label"))
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    draw = F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.create_map(*[c for k, n in sorted(counts.items()) for c in (F.lit(k), F.lit(min(1.0, per_label / n)))])
    took = rows.where(draw < share[F.col("label")]).select(F.xxhash64("id", F.lit(seed)).alias("h"), "text", "label").collect()
    took = sorted(((r["h"], r["label"], r["text"]) for r in took), key=lambda r: (r[0], r[1], r[2]))
    labels, rng = sorted(counts), np.random.default_rng(seed)
    xs, ys = [], []
    for _, label, text in took:
        b = np.frombuffer(text.encode(), np.uint8)
        x, _, used = windows(b, np.array([0, len(b)]))
        x = x[used >= 1]
        pick = np.sort(rng.permutation(len(x))[:windows_per_text])
        xs.append(x[pick])
        ys += [labels.index(label)] * len(pick)
        if len(b) > 24:  # short texts occur too
            at = int(rng.integers(0, len(b) - 16))
            cut = np.zeros((1, WINDOW), np.uint8)
            part = b[at : at + int(rng.integers(8, 64))]
            cut[0, : len(part)] = part
            xs.append(cut)
            ys.append(labels.index(label))
    if not ys:
        return None
    return train(np.concatenate(xs), np.array(ys), labels, seed=seed)


def identify(docs: DataFrame, net: ByteNet | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, lang_pred, score (the label's probability), n_windows.

    Nothing but the text decides. A null text or one without a letter gets `und` and score 0, as does every
    text if nothing could be learned. Rows keep their multiplicity; a null id stays null.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "lang_pred", "score", "n_windows"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.tables() if net else None
        for batch in batches:
            for part in pieces(batch, "text"):
                data, offsets = raw(part.column("text"))
                x, row, used = windows(data, offsets)
                n = part.num_rows
                many = np.bincount(row, minlength=n)
                whole = data.tobytes()
                # ASCII letters settle nearly every text; only the rest is looked at letter by letter.
                has = np.concatenate([[0], np.cumsum(((data | 32) >= 97) & ((data | 32) <= 122))])
                lettered = has[offsets[1:]] > has[offsets[:-1]]
                for i in np.flatnonzero(~lettered & (many > 0)):
                    lettered[i] = any(c.isalpha() for c in whole[offsets[i] : offsets[i + 1]].decode())
                if net is None or not len(x):
                    pred, score = [UNKNOWN] * n, np.zeros(n)
                else:
                    p = net.probabilities(x, tables) * used[:, None]
                    total = np.stack([np.bincount(row, p[:, k], n) for k in range(len(net.labels))], 1) / np.maximum(np.diff(offsets), 1)[:, None]
                    best = total.argmax(1)
                    pred = [net.labels[b] if ok else UNKNOWN for b, ok in zip(best, lettered, strict=True)]
                    score = np.where(lettered, np.clip(total[np.arange(n), best], 0, 1), 0)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(many, pa.int64())], names=names)

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double, n_windows bigint")

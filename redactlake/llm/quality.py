"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded; learned filters run over overlapping chunks that cover the whole text; each filter's responses are
max-pooled in a chunk. The greatest, mean and least pooled response over a text's chunks go into one logistic unit.
The last chunk ends at the text's end, so all chunks of a longer text are full. Fitted by Adam on the driver, on a
sample of labelled rows of bounded number, each with its whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import as_strided
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactlake.llm.common import carried, pieces, small_batches, utf8

CHUNK, STEP = 256, 192
WIDTH, STRIDE = 8, 2
#: Labelled texts for fitting.
SAMPLE_ROWS = 2000
#: Chunks convolved, and gradients carried back, at a time.
AT_ONCE, GRADIENTS = 256, 1 << 16


@dataclass
class Model:
    embed: np.ndarray  # byte (256: none) x size
    kernel: np.ndarray  # WIDTH * size x filters
    bias: np.ndarray  # filters
    out: np.ndarray  # 3 * filters
    base: np.ndarray  # 1
    mean: np.ndarray  # of the pooled features in the sample
    scale: np.ndarray

    @property
    def learned(self) -> list[np.ndarray]:
        return [self.embed, self.kernel, self.bias, self.out, self.base]


def chunks(data: bytes) -> np.ndarray:
    """The text's chunks, padded with 256 where it is shorter than one."""
    n = len(data)
    if n <= CHUNK:
        out = np.full((1, CHUNK), 256, "i2")
        out[0, :n] = np.frombuffer(data, "u1")
        return out
    starts = np.r_[np.arange(0, n - CHUNK, STEP), n - CHUNK]
    return np.frombuffer(data, "u1")[starts[:, None] + np.arange(CHUNK)].astype("i2")


def _windows(x: np.ndarray, embed: np.ndarray) -> np.ndarray:
    """(chunks, positions, WIDTH * size): what the filters see."""
    e = np.ascontiguousarray(embed[x])
    n, size = len(x), embed.shape[1]
    return as_strided(e, (n, (CHUNK - WIDTH) // STRIDE + 1, WIDTH * size), (e.strides[0], STRIDE * size * e.itemsize, e.itemsize))


def pooled(model: Model, x: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """The greatest response of each filter in each chunk, and its position."""
    best, where = [], []
    for i in range(0, len(x), AT_ONCE):
        r = np.ascontiguousarray(_windows(x[i : i + AT_ONCE], model.embed)) @ model.kernel
        best.append(r.max(1))
        if places:
            where.append(r.argmax(1))
    return np.maximum(np.concatenate(best) + model.bias, 0), np.concatenate(where) if places else None


def _features(p: np.ndarray, starts: np.ndarray) -> np.ndarray:
    counts = np.diff(np.r_[starts, len(p)])[:, None]
    return np.concatenate([np.maximum.reduceat(p, starts), np.add.reduceat(p, starts) / counts, np.minimum.reduceat(p, starts)], 1)


def scores(model: Model, texts: list[bytes]) -> np.ndarray:
    """Probability of label 1 of each text."""
    if not texts:
        return np.empty(0)
    x = [chunks(t) for t in texts]
    starts = np.r_[0, np.cumsum([len(c) for c in x])[:-1]]
    f = _features(pooled(model, np.concatenate(x))[0], starts)
    z = ((f - model.mean) / model.scale) @ model.out + model.base
    return 1 / (1 + np.exp(-np.clip(z.astype("f8"), -30, 30)))


def fit(texts: list[bytes], labels: list[int], size: int = 8, filters: int = 32, epochs: int = 12, rate: float = 0.01, seed: int = 0) -> Model:
    """Adam on log loss. With no labels it gives a half, with one class nearly that."""
    rng = np.random.default_rng(seed)
    f4 = lambda *s, by=1.0: (rng.standard_normal(s) * by).astype("f4")
    model = Model(f4(257, size, by=0.5), f4(WIDTH * size, filters, by=0.2), np.zeros(filters, "f4"), f4(3 * filters, by=0.1), np.zeros(1, "f4"), np.zeros(3 * filters, "f4"), np.ones(3 * filters, "f4"))
    y = np.asarray(labels, "f4")
    if len(set(labels)) < 2:
        model.out[:] = 0
        model.base[0] = 0 if not labels else 4 if labels[0] else -4
        return model
    x = [chunks(t) for t in texts]
    first = _features(pooled(model, np.concatenate(x[:256]))[0], np.r_[0, np.cumsum([len(c) for c in x[:256]])[:-1]])
    model.mean, model.scale = first.mean(0), first.std(0) + 0.1
    share = y.mean()
    model.base[0] = np.log(share / (1 - share))
    m1, m2, step = [np.zeros_like(p) for p in model.learned], [np.zeros_like(p) for p in model.learned], 0
    rounds = epochs * -(-len(x) // 32)
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(len(x)), -(-len(x) // 32)):
            step += 1
            own = [x[i] for i in batch]
            counts = np.array([len(c) for c in own])
            starts, c = np.r_[0, np.cumsum(counts)[:-1]], np.concatenate(own)
            p, where = pooled(model, c, True)
            doc = np.repeat(np.arange(len(batch)), counts)
            f = (_features(p, starts) - model.mean) / model.scale
            z = f @ model.out + model.base
            dz = (1 / (1 + np.exp(-z)) - y[batch]) / len(batch)
            df = dz[:, None] * model.out / model.scale
            k = filters
            top, low = np.maximum.reduceat(p, starts), np.minimum.reduceat(p, starts)
            dp = (p == top[doc]) * df[doc, :k] + df[doc, k : 2 * k] / counts[doc, None] + (p == low[doc]) * df[doc, 2 * k :]
            dp *= p > 0
            # Only where a filter was greatest does a gradient go on.
            kernel, embed = np.zeros_like(model.kernel), np.zeros_like(model.embed)
            rows, cols = np.nonzero(dp)
            for i in range(0, len(rows), GRADIENTS):
                row, col = rows[i : i + GRADIENTS], cols[i : i + GRADIENTS]
                seen = c[row[:, None], where[row, col][:, None] * STRIDE + np.arange(WIDTH)]
                g = dp[row, col]
                flat = model.embed[seen].reshape(len(row), WIDTH * size)
                for j in range(filters):
                    kernel[:, j] += g[col == j] @ flat[col == j]
                parts = (g[:, None] * model.kernel.T[col]).reshape(-1, size)
                for j in range(size):
                    embed[:, j] += np.bincount(seen.ravel(), parts[:, j], 257)
            lr = rate * min(1, 2 * (1 - step / (rounds + 1)))
            for q, (value, grad) in enumerate(zip(model.learned, [_but_padding(embed), kernel, dp.sum(0), f.T @ dz + 1e-4 * model.out, dz.sum(keepdims=True)], strict=True)):
                m1[q] = 0.9 * m1[q] + 0.1 * grad
                m2[q] = 0.999 * m2[q] + 0.001 * grad**2
                value -= (lr * (m1[q] / (1 - 0.9**step)) / (np.sqrt(m2[q] / (1 - 0.999**step)) + 1e-8)).astype("f4")
    return model


def _but_padding(grad: np.ndarray) -> np.ndarray:
    """The embedding of the padding stays as it is."""
    grad[256] = 0
    return grad


def sample(documents: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", label: str = "quality", rows: int = SAMPLE_ROWS) -> tuple[list[bytes], list[int]]:
    """The whole texts and labels of at most `rows` labelled ids, chosen by a hash of the id, whatever their length.

    Null labels, ids and texts take no part; of several labels of an id the greatest counts, rows that repeat an id and
    a text count once. Empty tables give empty lists.
    """
    chosen = labels.where(F.col(label).isNotNull() & F.col(doc).isNotNull()).groupBy(F.col(doc).alias("doc")).agg(F.max(label).alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc"), "doc").limit(rows)
    found = documents.where(F.col(text).isNotNull()).select(F.col(doc).alias("doc"), utf8(text).alias("data")).join(F.broadcast(chosen), "doc").select("doc", "data", "label")
    got = sorted({(r[0], bytes(r[1]), r[2]) for r in found.collect()}, key=lambda r: (str(r[0]), r[1]))
    return [r[1] for r in got], [int(r[2]) for r in got]


def score(df: DataFrame, model: Model, text: str = "text", to: str = "score") -> DataFrame:
    """df with the probability of label 1, from the whole text alone. Null texts count as empty, every row gets a score,
    equal texts the same one. A column named as `to` is replaced, others may have any name; empty tables give none."""
    small_batches(df.sparkSession)
    source, schema = carried(df, text, to)
    schema = schema.add(to, "double")

    def work(batches):
        for b in pieces(batches, "data", 1 << 20):
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(scores(model, b.column(b.num_columns - 1).to_pylist()), pa.float64())], names=schema.names)

    return source.mapInArrow(work, schema)

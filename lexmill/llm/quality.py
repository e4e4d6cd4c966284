"""Quality classifier by positive-unlabelled learning.

A small network scores character statistics of the whole text. It is trained on the driver by minimising the
non-negative unbiased risk: trusted positives are rows labelled good, unlabelled rows are web text whatever its label,
and the class prior is estimated from the two samples (the smallest ratio of their tail shares under a classifier that
tells them apart, which is where unlabelled text looks least like anything else). The negative part of the risk is kept
from falling below zero by stepping back whenever it does. Labels of bad text are not used at all: with the logistic
loss, the minimum of the risk is the log odds of good text under that prior, so the score is their logistic function.

Training reads bounded samples chosen by hashes of doc_id and text (``positives``, ``unlabelled``); scoring reads every
whole text. Held-out rows (crc32 of doc_id mod 4 is 2) and rows without doc_id are never trained on.

Defined cases: null and empty texts are scored as empty; labels other than 1 are ignored, but a doc_id
labelled both 0 and 1 is no positive; without labelled positives every score is 0.5; repeated rows get equal scores; an empty
table gives an empty result; columns named score or predicted give way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lexmill.llm import textbytes as tb
from lexmill.llm.sampling import thin, trainable

#: Classes of bytes: 0 lower case, 1 upper case, 2 digit, 3 blank, 4 line end, 5 above ASCII, 6 control, 7 on: each mark.
BYTE_CLASS = np.full(256, 6, np.int64)
BYTE_CLASS[97:123], BYTE_CLASS[65:91], BYTE_CLASS[48:58], BYTE_CLASS[[32, 9]], BYTE_CLASS[10], BYTE_CLASS[128:] = 0, 1, 2, 3, 4, 5
_MARKS = [b for b in range(33, 127) if not chr(b).isalnum()]
BYTE_CLASS[_MARKS] = np.arange(7, 7 + len(_MARKS))
CLASSES = 7 + len(_MARKS)
COARSE = np.minimum(BYTE_CLASS, 7)
DENSE = 7
WIDTH = CLASSES + 64 + DENSE


def features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A row of WIDTH statistics for each text: shares of byte classes and of their pairs, and shapes of words."""
    n = len(offs) - 1
    size = np.diff(offs)
    out = np.zeros((n, WIDTH), np.float32)
    if not len(data):
        return out
    doc = np.repeat(np.arange(n), size)
    share = 1.0 / np.maximum(size, 1)[:, None]
    out[:, :CLASSES] = np.bincount(doc * CLASSES + BYTE_CLASS[data], minlength=n * CLASSES).reshape(n, -1) * share
    coarse = COARSE[data]
    same = doc[1:] == doc[:-1]
    pairs = (doc[1:] * 64 + coarse[:-1] * 8 + coarse[1:])[same]
    out[:, CLASSES : CLASSES + 64] = np.bincount(pairs, minlength=n * 64).reshape(n, -1) * share
    words, bounds = tb.word_hashes(data, offs)
    count = np.diff(bounds)
    solid = np.bincount(doc, weights=~tb.SPACE[data], minlength=n)
    distinct = np.array([len(np.unique(words[a:b])) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())], float)
    lines = np.bincount(doc, weights=data == 10, minlength=n) + 1
    marks = np.bincount(doc, weights=coarse == 7, minlength=n)
    dense = np.stack([np.log1p(count), np.log1p(size), solid / np.maximum(count, 1), distinct / np.maximum(count, 1), np.log1p(count / lines), marks / np.maximum(count, 1), distinct / np.sqrt(np.maximum(count, 1))], axis=1)
    out[:, CLASSES + 64 :] = dense
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    prior: float = 0.5

    def raw(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum((np.clip((x - self.mean) / self.scale, -8, 8)) @ self.w1 + self.b1, 0)
        return h @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.raw(x).astype(np.float64))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def estimate_prior(good: np.ndarray, some: np.ndarray) -> float:
    """The share of positives among ``some``: the least ratio of tail shares of the two samples' classifier outputs."""
    if len(good) < 20 or len(some) < 20:
        return 0.5
    cuts = np.quantile(good, np.linspace(0.0, 0.9, 46))
    p = np.array([(good >= c).mean() for c in cuts])
    u = np.array([(some >= c).mean() for c in cuts])
    slack = np.sqrt(1 / len(good)) + np.sqrt(1 / len(some))
    return float(np.clip(((u + 0.5 * slack * (1 - p)) / p).min(), 0.02, 0.98))


def slopes(f: np.ndarray, k: int, prior: float | None) -> np.ndarray:
    """The risk's gradient by the outputs ``f``, of k positives and then of unlabelled rows.

    If the negative part, the unlabelled rows' loss without the positives' share of it, is below zero, the step goes
    back from it. With no prior: plain logistic loss of positives against unlabelled rows.
    """
    up, un = -_sigmoid(-f), _sigmoid(f)  # slopes of the logistic losses of +1 and of -1
    u, g = len(f) - k, np.empty_like(f)
    if prior is None:
        g[:k], g[k:] = up[:k] / k, un[k:] / u
        return g
    low = np.logaddexp(0, f)
    if low[k:].mean() - prior * low[:k].mean() >= 0:
        g[:k], g[k:] = prior * (up[:k] - un[:k]) / k, un[k:] / u
    else:
        g[:k], g[k:] = prior * un[:k] / k, -un[k:] / u
    return g


def _fit(pos: np.ndarray, unl: np.ndarray, prior: float | None, hidden: int, steps: int, rate: float, seed: int, model: Model | None = None) -> Model:
    """Minimise the non-negative risk; with no prior, plain logistic loss of positives against unlabelled rows."""
    rng = np.random.default_rng(seed)
    every = np.concatenate([pos, unl])
    mean, scale = every.mean(0), every.std(0) + 1e-3
    p_all, u_all = (np.clip((x - mean) / scale, -8, 8).astype(np.float64) for x in (pos, unl))
    w = [rng.normal(0, np.sqrt(2 / WIDTH), (WIDTH, hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), hidden), np.zeros(1)]
    m, v = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
    for step in range(1, steps + 1):
        p, u = p_all[rng.integers(0, len(p_all), 256)], u_all[rng.integers(0, len(u_all), 256)]
        x = np.concatenate([p, u])
        h = np.maximum(x @ w[0] + w[1], 0)
        f = h @ w[2] + w[3]
        g = slopes(f, len(p), prior)
        gh = np.outer(g, w[2]) * (h > 0)
        grads = [x.T @ gh + 1e-4 * w[0], gh.sum(0), h.T @ g + 1e-4 * w[2], np.array([g.sum()])]
        for i, d in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * d
            v[i] = 0.999 * v[i] + 0.001 * d * d
            w[i] -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, w[0].astype(np.float32), w[1].astype(np.float32), w[2].astype(np.float32), float(w[3][0]), prior=0.5 if prior is None else prior)


def train(pos: np.ndarray, unl: np.ndarray, hidden: int = 32, steps: int = 1500, seed: int = 5) -> Model | None:
    if not len(pos) or not len(unl):
        return None
    half_p, half_u = np.arange(len(pos)) % 2 == 0, np.arange(len(unl)) % 2 == 0
    prior = 0.5
    if half_p.sum() >= 20 and half_u.sum() >= 20:
        apart = _fit(pos[half_p], unl[half_u], None, hidden, 600, 3e-3, seed)
        prior = estimate_prior(apart.raw(pos[~half_p]), apart.raw(unl[~half_u]))
    return _fit(pos, unl, prior, hidden, steps, 3e-3, seed)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offs in tb.chunks(*tb.text_bytes(batch.column(1))):
            x = features(data, offs)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([r.tobytes() for r in x], pa.binary())], ["kind", "x"])


def fit_quality(docs: DataFrame, labels: DataFrame, positives: int = 4000, unlabelled: int = 8000, seed: int = 11) -> Model | None:
    """Train on ``docs`` (doc_id, text) and ``labels`` (doc_id, quality)."""
    rows = docs.select("doc_id", "text").where(trainable(F.col("doc_id")))
    marked = labels.where(trainable(F.col("doc_id")) & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("kind"))
    chosen = thin(marked.where(F.col("kind") == 1).select("doc_id"), None, positives, seed)
    # the labelled sample is of bounded size, and so may be broadcast; a doc_id of very many rows is thinned once more
    known = thin(rows.join(F.broadcast(chosen), "doc_id"), None, positives, seed).select(F.lit(1).alias("kind"), "text")
    web = thin(rows, None, unlabelled, seed + 1).select(F.lit(2).alias("kind"), "text")
    got = known.unionByName(web).mapInArrow(_featured, "kind int, x binary").collect()
    by = {k: _rows([r.x for r in got if r.kind == k], seed) for k in (1, 2)}
    return train(by[1], by[2])


def _rows(raw: list[bytes], seed: int) -> np.ndarray:
    """The feature rows in an order that depends on their values only, so that training repeats."""
    x = np.frombuffer(b"".join(sorted(raw)), np.float32).reshape(len(raw), WIDTH)
    return x[np.random.default_rng(seed).permutation(len(x))]


def _scored(shared, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            scores = np.full(batch.num_rows, 0.5)
            if model is not None:
                for a, b, data, offs in tb.chunks(*tb.text_bytes(batch.column(at))):
                    scores[a:b] = model.score(features(data, offs))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], [*batch.schema.names, "score"])

    return run


def score_documents(docs: DataFrame, model: Model | None, cut: float = 0.7) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 if the score reaches ``cut``, else 0)."""
    base = docs.drop("score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = base.mapInArrow(_scored(shared, base.columns.index("text")), StructType([*base.schema.fields, StructField("score", DoubleType())]))
    return out.withColumn("predicted", F.when(F.col("score") >= cut, 1).otherwise(0))

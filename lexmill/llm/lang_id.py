"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads running text: a text's lower-cased UTF-8 bytes, blanks, marks and all, in consecutive windows of about
``STRIDE`` bytes cut on character bounds. A forward and a backward gated recurrence see every byte of a window, across
words, and a softmax over both states labels every position. A document's probabilities are the mean over the positions
that hold bytes of letters. Training is numpy on the driver: backpropagation through time with Adam over windows of a
bounded, hash-chosen sample of rows (``docs_per_lang`` documents a language, ``windows`` windows of each, drawn from the
whole text); prediction reads every whole text, and keeps nothing between batches.

Defined cases: null text or text without any letter is ``und`` with score 0; null languages are not learned; without
training rows everything is ``und``; ties go to the language first in code point order; repeated rows get equal results;
an empty table gives an empty result; columns named lang_pred or score give way; NUL characters count as blanks. The
softmax needs few languages: over a thousand distinct values of lang are refused.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from lexmill.llm.sampling import thin, trainable
from lexmill.llm.textbytes import text_bytes

#: Bytes from one window's start to the next, up to a character's bound; columns of a window; windows run at once.
STRIDE, STEPS, ROWS = 61, 64, 1024
SLAB = 8 << 20
LETTER = np.zeros(256, bool)
LETTER[97:123] = LETTER[128:] = True


def _sig(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + np.float32(0.5)


@dataclass
class Direction:
    """A gated recurrence: input weights by byte (256 x 3H), state weights (H x 3H) and state bias of the candidate."""

    e: np.ndarray
    u: np.ndarray
    b: np.ndarray

    def run(self, x: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, list]:
        """States (steps, rows, H) of byte columns ``x``; rows that are not live keep their state."""
        hid = self.u.shape[0]
        h, out, tape = np.zeros((x.shape[1], hid), self.u.dtype), [], []
        for t in range(x.shape[0]):
            i, s = self.e[x[t]], h @ self.u
            zr = _sig(i[:, : 2 * hid] + s[:, : 2 * hid])
            z, r = zr[:, :hid], zr[:, hid:]
            c = s[:, 2 * hid :] + self.b
            n = np.tanh(i[:, 2 * hid :] + r * c)
            new = np.where(live[t][:, None], n + z * (h - n), h)
            tape.append((h, z, r, c, n))
            out.append(new)
            h = new
        return np.stack(out), tape

    def back(self, x: np.ndarray, live: np.ndarray, tape: list, d_out: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Gradients of e, u and b by backpropagation through time."""
        hid = self.u.shape[0]
        de, du, db = np.zeros_like(self.e), np.zeros_like(self.u), np.zeros_like(self.b)
        carry, inputs = np.zeros_like(d_out[0]), np.empty((*x.shape, 3 * hid), self.u.dtype)
        for t in range(x.shape[0] - 1, -1, -1):
            h, z, r, c, n = tape[t]
            d = carry + d_out[t]
            on = live[t][:, None]
            dn, dz = d * (1 - z) * on, d * (h - n) * on
            da = dn * (1 - n * n)
            dr, dc = da * c, da * r
            di = np.concatenate([dz * z * (1 - z), dr * r * (1 - r), da], axis=1)
            ds = np.concatenate([di[:, : 2 * hid], dc], axis=1)
            inputs[t] = di
            du += h.T @ ds
            db += dc.sum(0)
            carry = np.where(on, d * z, d) + ds @ self.u.T
        order = np.argsort(x, axis=None, kind="stable")
        seen, first = np.unique(x.ravel()[order], return_index=True)
        de[seen] = np.add.reduceat(inputs.reshape(-1, 3 * hid)[order], first)
        return de, du, db


@dataclass
class Network:
    langs: list[str]
    ahead: Direction
    behind: Direction
    w: np.ndarray
    c: np.ndarray

    def positions(self, x: np.ndarray, live: np.ndarray) -> np.ndarray:
        """Probabilities (steps, rows, languages) at every position of byte columns ``x``."""
        return _softmax(self._states(x, live)[0] @ self.w + self.c)

    def _states(self, x: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, list, list]:
        f, tape_f = self.ahead.run(x, live)
        g, tape_g = self.behind.run(x[::-1], live[::-1])
        return np.concatenate([f, g[::-1]], axis=2), tape_f, tape_g

    def step(self, x: np.ndarray, live: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy over live positions, and its gradients in the order of ``weights``."""
        h, tape_f, tape_g = self._states(x, live)
        p = _softmax(h @ self.w + self.c)
        total = max(1, int(live.sum()))
        loss = -np.log(np.maximum(p[:, np.arange(len(y)), y][live], 1e-12)).sum() / total
        d = p.copy()
        d[:, np.arange(len(y)), y] -= 1
        d = d * live[:, :, None] / p.dtype.type(total)
        flat, hf = d.reshape(-1, d.shape[2]), h.reshape(-1, h.shape[2])
        dh = d @ self.w.T
        hid = self.ahead.u.shape[0]
        grads = [hf.T @ flat, flat.sum(0), *self.ahead.back(x, live, tape_f, dh[:, :, :hid]), *self.behind.back(x[::-1], live[::-1], tape_g, dh[::-1, :, hid:])]
        return float(loss), grads

    def weights(self) -> list[np.ndarray]:
        return [self.w, self.c, self.ahead.e, self.ahead.u, self.ahead.b, self.behind.e, self.behind.u, self.behind.b]


class _Fast:
    """A direction for prediction: gates apart, so that all arrays are contiguous, and without a tape.

    A gate is (1 + tanh(a / 2)) / 2: the halves are in the weights. Byte 0, which pads, keeps the state as it is.
    """

    def __init__(self, d: Direction):
        hid = d.u.shape[0]
        cut = lambda a, k, by: np.ascontiguousarray(a[:, k * hid : (k + 1) * hid] * np.float32(by), np.float32)
        self.e = [cut(d.e, 0, 0.5), cut(d.e, 1, 0.5), cut(d.e, 2, 1)]
        self.u = [cut(d.u, k, 0.5) for k in range(3)]
        self.b = (d.b * 0.5).astype(np.float32)
        self.e[0][0] = 30.0

    def states(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """The states at each step of byte columns ``x``; each is overwritten by the one after the next."""
        n, hid = x.shape[1], len(self.b)
        h, new = np.zeros((n, hid), np.float32), np.empty((n, hid), np.float32)
        z, r, c, i = (np.empty((n, hid), np.float32) for _ in range(4))
        for at in x.astype(np.intp):
            for s, e, u in zip((z, r), self.e, self.u):
                np.matmul(h, u, out=s)
                s += np.take(e, at, axis=0, out=i, mode="clip")
                np.tanh(s, out=s)
                s += 1.0
            np.matmul(h, self.u[2], out=c)
            c += self.b
            c *= r
            c += np.take(self.e[2], at, axis=0, out=i, mode="clip")
            np.tanh(c, out=c)
            np.subtract(h, c, out=new)
            z *= 0.5
            new *= z
            new += c
            h, new = new, h
            yield h


class Reader:
    """A network for prediction."""

    def __init__(self, net: Network):
        self.langs, hid = net.langs, net.ahead.u.shape[0]
        self.ahead, self.behind = _Fast(net.ahead), _Fast(net.behind)
        self.w, self.c = [np.ascontiguousarray(w.T, np.float32) for w in (net.w[:hid], net.w[hid:])], net.c.astype(np.float32)[:, None]

    def letter_sums(self, x: np.ndarray) -> np.ndarray:
        """For each row of byte columns ``x`` (0 pads) the probabilities summed over its letters' positions."""
        later = [self.w[1] @ h.T for h in self.behind.states(x[::-1])]
        sums, letters = np.zeros((len(self.c), x.shape[1]), np.float32), LETTER[x].astype(np.float32)
        for a, b, on in zip(self.ahead.states(x), reversed(later), letters):
            p = self.w[0] @ a.T
            p += b
            p += self.c
            p -= p.max(axis=0)
            np.exp(p, out=p)
            p *= on / p.sum(axis=0)
            sums += p
        return sums.T


def _softmax(a: np.ndarray) -> np.ndarray:
    a = np.exp(a - a.max(axis=-1, keepdims=True))
    return a / a.sum(axis=-1, keepdims=True)


def fresh(langs: list[str], hidden: int = 24, seed: int = 3, dtype=np.float32) -> Network:
    rng = np.random.default_rng(seed)
    one = lambda: Direction(rng.normal(0, 0.3, (256, 3 * hidden)).astype(dtype), rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden)).astype(dtype), np.zeros(hidden, dtype))
    return Network(langs, one(), one(), rng.normal(0, 0.2, (2 * hidden, len(langs))).astype(dtype), np.zeros(len(langs), dtype))


def columns(windows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Windows as byte columns (steps, rows), and which positions are live."""
    lens = np.array([len(w) for w in windows], np.int64)
    steps = max(1, int(lens.max(initial=1)))
    x = np.frombuffer(b"".join(w.ljust(steps, b"\0") for w in windows), np.uint8).reshape(len(windows), steps).T
    return x, np.arange(steps)[:, None] < lens


def lowered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the lower-cased texts, NULs as blanks, and each text's bounds."""
    data, offs = text_bytes(pc.utf8_lower(texts.fill_null("").cast(pa.large_string())))
    return np.where(data == 0, np.uint8(32), data), offs


def window_bounds(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and text of each window of all texts: they tile the texts and cut no character."""
    count = -(-np.diff(offs) // STRIDE)
    text = np.repeat(np.arange(len(count)), count)
    start = offs[text] + STRIDE * (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count))
    for _ in range(3):
        start = start - ((data[start] & 0xC0 == 0x80) & (start > offs[text]))
    end = np.append(start[1:], offs[-1])
    last = np.append(text[1:] != text[:-1], True) if len(text) else np.zeros(0, bool)
    return start, np.where(last, offs[text + 1], end) - start if len(text) else start, text


def window_columns(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The windows as byte columns (STEPS, windows), padded by 0."""
    at = start[None, :] + np.arange(STEPS)[:, None]
    return np.where(np.arange(STEPS)[:, None] < length, data[np.minimum(at, len(data) - 1)], np.uint8(0))


def train(langs: list[str], sample: list[tuple[str, bytes]], hidden: int = 16, steps: int = 150, batch: int = 96, seed: int = 3) -> Network:
    """Fit on (language, window) pairs; each language is drawn equally often."""
    rng = np.random.default_rng(seed)
    net = fresh(langs, hidden, seed)
    by = [[w for lang, w in sample if lang == name] for name in langs]
    w = net.weights()
    m, v = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
    for step in range(1, steps + 1):
        y = rng.integers(0, len(langs), batch)
        x, live = columns([by[k][rng.integers(0, len(by[k]))] for k in y])
        _, grads = net.step(x, live, y)
        rate = 0.01 * min(1.0, step / 30) * (1 - 0.9 * step / steps)
        for i, d in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * d
            v[i] = 0.99 * v[i] + 0.01 * d * d
            w[i] -= (rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)).astype(w[i].dtype)
    return net


def pooled(net: Reader, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Each text's mean probabilities over its letters' positions, zeros where it has none."""
    n = len(offs) - 1
    sums, start_length_text = np.zeros((n, len(net.langs))), window_bounds(data, offs)
    for k in range(0, len(start_length_text[0]), ROWS):
        start, length, text = (x[k : k + ROWS] for x in start_length_text)
        got = net.letter_sums(window_columns(data, start, length))
        heads = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
        sums[text[heads]] += np.add.reduceat(got.astype(np.float64), heads)
    letters = np.diff(np.append(0, np.cumsum(LETTER[data]))[offs])
    return sums / np.maximum(letters, 1)[:, None]


def has_letter(texts: pa.Array) -> np.ndarray:
    """Whether each text holds a letter of any script."""
    found = pc.match_substring_regex(texts.fill_null(""), r"\pL").to_numpy(zero_copy_only=False).astype(bool)
    for i in np.flatnonzero(~found).tolist():
        found[i] = any(map(str.isalpha, texts[i].as_py() or ""))
    return found


def _predict(shared, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = None if shared.value is None else Reader(shared.value)
        for batch in batches:
            lang, score = [], []
            texts = batch.column(at)
            a = 0
            while a < batch.num_rows:  # slabs of bounded bytes
                size, b = 0, a
                while b < batch.num_rows and (b == a or size < SLAB):
                    part = texts.slice(b, 256)
                    size, b = size + part.nbytes, b + len(part)
                part = texts.slice(a, b - a)
                means = pooled(net, *lowered(part)) if net is not None else np.zeros((len(part), 1))
                best, known = means.argmax(1), has_letter(part) & (means.max(1) > 0)
                lang += [net.langs[i] if k else "und" for i, k in zip(best, known)]
                score += [float(min(1.0, m[i])) if k else 0.0 for m, i, k in zip(means, best, known)]
                a = b
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    return run


def _sampled(windows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, out = [], []
            for i, lang in enumerate(batch.column(0).to_pylist()):
                data, offs = lowered(batch.column(1).slice(i, 1))
                start, length, _ = window_bounds(data, offs)
                rng = np.random.default_rng(zlib.crc32(data))
                letters = np.append(0, np.cumsum(LETTER[data]))
                full = np.flatnonzero(letters[start + length] > letters[start])
                found = [data[start[k] : start[k] + length[k]].tobytes() for k in full[rng.permutation(len(full))[:windows]]]
                langs += [lang] * len(found)
                out += found
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(out, pa.binary())], ["lang", "w"])

    return run


def fit_languages(docs: DataFrame, docs_per_lang: int = 400, windows: int = 24, seed: int = 17) -> Network | None:
    """Train on ``docs`` (doc_id, text, lang)."""
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), "text").where(trainable(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    got = thin(rows, "lang", docs_per_lang, seed).select("lang", "text").mapInArrow(_sampled(windows), "lang string, w binary").collect()
    sample = sorted((r.lang, bytes(r.w)) for r in got)
    langs = sorted({lang for lang, _ in sample})
    return train(langs, sample) if langs else None


def predict_languages(docs: DataFrame, net: Network | None) -> DataFrame:
    """``docs`` with lang_pred and score."""
    base = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(net)
    return base.mapInArrow(_predict(shared, base.columns.index("text")), StructType([*base.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())]))

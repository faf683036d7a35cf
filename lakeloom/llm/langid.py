"""Language identification by a bidirectional gated recurrent network over bytes.

Two GRUs read windows of a text's bytes forwards and backwards; at every
position their states give a probability of each language, and a document's
probability is the mean over its positions.  Trained here in numpy by
backpropagation through time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.llm import common

#: Bytes of a window, states of a direction, windows computed at once.
WINDOW, STATES, AT_ONCE = 64, 8, 4096
#: Bound of the training sample: documents of a language, and bytes of their whole texts; passes over them.
FIT_DOCS, FIT_BYTES, EPOCHS, SEED = 400, 1 << 19, 4, 5
#: Distinct languages up to which their counts are broadcast.
BROADCAST_ROWS = 100_000
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or (not text.isascii() and any(c.isalpha() for c in text.decode("utf-8", "replace")))


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows (zero-padded rows of bytes), their lengths, and where each text's windows begin."""
    data, off = common.concatenated(texts)
    size = np.diff(off)
    count = -(-size // WINDOW)
    begin = np.concatenate([[0], np.cumsum(count)])
    rows = np.zeros((int(begin[-1]), WINDOW), np.uint8)
    text = np.repeat(np.arange(len(texts)), size)
    rows.reshape(-1)[begin[text] * WINDOW + np.arange(len(data)) - off[text]] = data
    w = np.repeat(np.arange(len(texts)), count)
    length = np.minimum(WINDOW, size[w] - (np.arange(len(w)) - begin[w]) * WINDOW)
    return rows, length, begin


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.multiply(x, 0.5, out=x)
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    return x


class Model:
    """Two GRUs and a softmax.  Arrays of states have a column per window."""

    def __init__(self, languages: list[str], seed: int = SEED):
        r = np.random.default_rng(seed)
        h, n = STATES, len(languages)
        self.languages = languages
        self.p = {}
        for d in "fb":
            self.p |= {f"{d}e": r.normal(0, 0.5, (3 * h, 256)), f"{d}u": r.normal(0, h**-0.5, (3 * h, h)), f"{d}n": np.zeros((h, 1))}
        self.p |= {"o": r.normal(0, (2 * h) ** -0.5, (n, 2 * h)), "c": np.zeros((n, 1))}
        self.p = {k: x.astype(np.float32) for k, x in self.p.items()}

    def _states(self, x: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States after each byte of x (position, window); with ``keep``, what going back needs."""
        h, p = STATES, self.p
        e, u, bias = p[f"{d}e"], p[f"{d}u"], p[f"{d}n"]
        state = np.zeros((h, x.shape[1]), e.dtype)
        out = np.empty((len(x), h, x.shape[1]), e.dtype)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            inputs, own = e.take(x[t], 1), u @ state
            gates = inputs[: 2 * h]
            gates += own[: 2 * h]
            gates = _sigmoid(gates)
            inner = own[2 * h :] + bias
            fresh = gates[:h] * inner
            fresh += inputs[2 * h :]
            np.tanh(fresh, out=fresh)
            after = state - fresh
            after *= gates[h:]
            after += fresh
            if keep is not None:
                keep.append((t, state, gates, inner, fresh))
            out[t] = state = after
        return out

    def _log_free(self, s: np.ndarray) -> np.ndarray:
        """Probabilities (position, language, window) from states."""
        y = self.p["o"] @ s
        y += self.p["c"]
        y -= y.max(1, keepdims=True)
        np.exp(y, out=y)
        y /= y.sum(1, keepdims=True)
        return y

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        x = np.ascontiguousarray(rows.T)
        return self._log_free(np.concatenate([self._states(x, "f"), self._states(x, "b")], 1))

    def positions(self, text: bytes) -> np.ndarray:
        """The language (as its number) of every byte of a text."""
        rows, _, _ = windows([text])
        return self.probabilities(rows).argmax(1).T.reshape(-1)[: len(text)] if len(rows) else np.zeros(0, np.int64)

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Probabilities (text, language): means over all positions; empty texts have zeros."""
        rows, length, begin = windows(texts)
        total = np.zeros((len(rows), len(self.languages)))
        for k in range(0, len(rows), AT_ONCE):
            y = self.probabilities(rows[k : k + AT_ONCE])
            y *= (np.arange(WINDOW)[:, None] < length[k : k + AT_ONCE])[:, None]
            total[k : k + AT_ONCE] = y.sum(0).T
        summed = np.concatenate([np.zeros((1, total.shape[1])), np.cumsum(total, 0)])
        sums = summed[begin[1:]] - summed[begin[:-1]]
        return np.clip(sums / np.maximum(1, [len(t) for t in texts])[:, None], 0, 1)

    def gradients(self, rows: np.ndarray, length: np.ndarray, label: np.ndarray) -> tuple[dict, float]:
        """By backpropagation through time, of the mean cross-entropy over positions."""
        h, x, keep = STATES, np.ascontiguousarray(rows.T), {"f": [], "b": []}
        s = np.concatenate([self._states(x, d, keep[d]) for d in "fb"], 1)
        y = self._log_free(s)
        real = (np.arange(len(x))[:, None] < length).astype(y.dtype)
        each = np.arange(len(label))
        loss = -(np.log(y[:, label, each] + 1e-30) * real).sum() / real.sum()
        y[:, label, each] -= 1
        y *= (real / real.sum())[:, None]
        flat = lambda z: z.transpose(1, 0, 2).reshape(z.shape[1], -1)
        grad = {"o": flat(y) @ flat(s).T, "c": y.sum((0, 2))[:, None]}
        ds = self.p["o"].T @ y
        for k, d in enumerate("fb"):
            u = self.p[f"{d}u"]
            back, du, dn = np.zeros((h, len(label)), y.dtype), np.zeros_like(u), np.zeros((h, 1), y.dtype)
            de = np.zeros((len(x), 3 * h, len(label)), y.dtype)
            for t, state, gates, inner, fresh in reversed(keep[d]):
                after = ds[t, k * h : (k + 1) * h] + back
                r, z = gates[:h], gates[h:]
                d_fresh = after * (1 - z) * (1 - fresh * fresh)
                de[t, :h] = d_fresh * inner * r * (1 - r)
                de[t, h : 2 * h] = after * (state - fresh) * z * (1 - z)
                de[t, 2 * h :] = d_fresh
                own = de[t].copy()
                own[2 * h :] *= r
                du += own @ state.T
                dn += own[2 * h :].sum(1, keepdims=True)
                back = after * z + u.T @ own
            each_byte = x.reshape(-1)
            grad[f"{d}u"], grad[f"{d}n"] = du, dn
            grad[f"{d}e"] = np.stack([np.bincount(each_byte, row, 256) for row in flat(de)])
        return grad, float(loss)

    def fit(self, rows: np.ndarray, length: np.ndarray, label: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Model:
        r = np.random.default_rng(seed)
        m, v, step = {k: np.zeros_like(x) for k, x in self.p.items()}, {k: np.zeros_like(x) for k, x in self.p.items()}, 0
        for epoch in range(epochs):
            order = r.permutation(len(rows))
            for k in range(0, len(order), 256):
                some = order[k : k + 256]
                grad, _ = self.gradients(rows[some], length[some], label[some])
                step += 1
                rate = 0.02 * (1 - epoch / epochs) + 0.001
                norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
                for n, g in grad.items():
                    g = g * min(1.0, 1.0 / (norm + 1e-9))
                    m[n] += 0.1 * (g - m[n])
                    v[n] += 0.005 * (g * g - v[n])
                    self.p[n] = (self.p[n] - rate * (m[n] / (1 - 0.9**step)) / (np.sqrt(v[n] / (1 - 0.995**step)) + 1e-7)).astype(np.float32)
        return self


def trained(docs: DataFrame, fit_docs: int = FIT_DOCS, lang_col: str = "lang") -> Model | None:
    """The model, from texts whose language is known and whose remainder is not 0; None without any.

    Every language is learned, from whole texts of about ``fit_docs``
    documents of each, drawn by the hash of id and text, and of these as many
    as fit into FIT_BYTES (a text that alone is larger is not learned from).
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.filter("lang is not null and length(text) > 0").filter(common.remainder(5) != 0).filter(F.octet_length("text") <= FIT_BYTES)
    counts = common.written(rows.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    counts = F.broadcast(counts) if counts.count() <= BROADCAST_ROWS else counts
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000))
    chosen = rows.join(counts, "lang").filter(draw < F.col("n").cast("double") ** -1 * (1_000_000 * fit_docs)).select("lang", "text", draw.alias("drawn"))
    # The bound is by language, so that many languages do not meet in the driver at once with all their texts.
    used = F.sum(F.octet_length("text")).over(Window.partitionBy("lang").orderBy("drawn", F.xxhash64("text")))
    got = sorted((r.lang, r.text) for r in chosen.withColumn("used", used).filter(F.col("used") <= FIT_BYTES).select("lang", "text").collect())
    got = [(lang, text.encode()) for lang, text in got if has_letter(text.encode())]
    if not got:
        return None
    languages = sorted({lang for lang, _ in got})
    rows_, length, begin = windows([t for _, t in got])
    label = np.repeat(np.array([languages.index(lang) for lang, _ in got]), np.diff(begin))
    return Model(languages).fit(rows_, length, label)


def identified(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (0 to 1): one row per input row.

    ``und`` with score 0 if the text is null or has no letter, or if no
    language was learned.  Whole texts count; nothing but the text does.  Scores
    are rounded to millionths, below which they depend on how rows are batched.
    Of languages with equal probability the first by name is predicted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            names, scores, group, size = ["und"] * len(texts), np.zeros(len(texts)), [], 0
            for k, t in enumerate(texts):
                if model is not None and has_letter(t):
                    group.append(k)
                    size += len(t)
                if group and (size > 1 << 19 or k == len(texts) - 1):
                    y = model.score([texts[g] for g in group])
                    for g, row in zip(group, y, strict=True):
                        names[g], scores[g] = model.languages[int(row.argmax())], round(float(row.max()), 6)
                    group, size = [], 0
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    return common.prepared(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, lang_pred string, score double")


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    docs = common.reading(spark, sf_dir, "documents")
    return identified(docs, trained(docs)).select("doc_id", (common.remainder(5) == 0).alias("held_out"), "lang_pred", "score")

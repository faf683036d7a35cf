"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages.  Each passage is encoded from its hashed
byte bigrams and how concentrated they are; gated attention weighs the
passages; the weighted sum is scored.  Only documents have labels: the
attention learns from them which passages matter.  Trained here in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm import common
from lakeloom.llm.rules_forest import labelled

#: Bytes of a passage, bins of bigrams, widths of encoder and attention.
PASSAGE, BINS, HIDDEN, ATTENTION, EXTRA = 512, 1024, 32, 16, 5
#: Bound of the training sample: labelled documents, and bytes of one (larger ones are scored, but not learned from) and of all; passes over them.
FIT_DOCS, FIT_DOC_BYTES, FIT_BYTES, EPOCHS, SEED = 3000, 1 << 18, 8 << 20, 12, 11


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Encoder inputs of all passages, and where each text's passages begin (an empty text has one empty passage)."""
    data, off = common.concatenated(texts)
    sizes = np.diff(off)
    count = np.maximum(1, -(-sizes // PASSAGE))
    begin = np.concatenate([[0], np.cumsum(count)])
    n = int(begin[-1])
    text = np.repeat(np.arange(len(texts)), sizes)
    passage = (begin[text] + (np.arange(len(data)) - off[text]) // PASSAGE).astype(np.int64)
    length = np.bincount(passage, minlength=n).astype(np.float32)
    out = np.zeros((n, BINS + EXTRA), np.float32)
    pair = data[:-1].astype(np.uint32) << np.uint32(8) | data[1:]
    bin_ = ((pair * np.uint32(0x9E3779B1)) >> np.uint32(22)).astype(np.int64)
    inside = passage[:-1] == passage[1:]
    hist = np.bincount(passage[:-1][inside] * BINS + bin_[inside], minlength=n * BINS).reshape(n, BINS)
    share = hist / np.maximum(1, length)[:, None]
    out[:, :BINS] = np.sqrt(share) * 4
    out[:, BINS] = (share**2).sum(1) * 20
    out[:, BINS + 1] = (hist > 0).sum(1) / np.sqrt(np.maximum(1, length)) - 4
    out[:, BINS + 2] = share.max(1) * 5
    upper = (data >= 65) & (data <= 90)
    letter = upper | ((data >= 97) & (data <= 122))
    out[:, BINS + 3] = np.bincount(passage[upper], minlength=n) / np.maximum(1, np.bincount(passage[letter], minlength=n)) * 2
    out[:, BINS + 4] = np.log1p(length) - 5
    return out, begin


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    """Encoder, gated attention and score; ``fit`` learns from bags and their labels."""

    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        d, h, a = BINS + EXTRA, HIDDEN, ATTENTION
        self.p = {"w": r.normal(0, d**-0.5, (d, h)), "b": np.zeros(h), "v": r.normal(0, h**-0.5, (h, a)), "u": r.normal(0, h**-0.5, (h, a)), "q": r.normal(0, a**-0.5, a), "c": r.normal(0, h**-0.5, h), "o": np.zeros(1)}
        self.p = {k: x.astype(np.float32) for k, x in self.p.items()}

    def forward(self, x: np.ndarray, begin: np.ndarray) -> tuple:
        p, first = self.p, begin[:-1]
        h = np.tanh(x @ p["w"] + p["b"])
        t, g = np.tanh(h @ p["v"]), _sigmoid(h @ p["u"])
        e = (t * g) @ p["q"]
        bag = np.repeat(np.arange(len(first)), np.diff(begin))
        e = np.exp(e - np.maximum.reduceat(e, first)[bag])
        a = e / np.add.reduceat(e, first)[bag]
        z = np.add.reduceat(a[:, None] * h, first, axis=0)
        return h, t, g, a, bag, z, _sigmoid(z @ p["c"] + p["o"][0])

    def score(self, texts: list[bytes]) -> np.ndarray:
        return self.forward(*passages(texts))[-1] if texts else np.zeros(0)

    def gradients(self, x: np.ndarray, begin: np.ndarray, label: np.ndarray, weight: np.ndarray) -> dict:
        p = self.p
        h, t, g, a, bag, z, s = self.forward(x, begin)
        ds = ((s - label) * weight).astype(np.float32)
        dz = ds[:, None] * p["c"]
        dh = a[:, None] * dz[bag]
        da = (h * dz[bag]).sum(1)
        de = a * (da - np.add.reduceat(a * da, begin[:-1])[bag])
        dtg = de[:, None] * p["q"]
        dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
        dh += dt @ p["v"].T + dg @ p["u"].T
        dh *= 1 - h * h
        return {"w": x.T @ dh, "b": dh.sum(0), "v": h.T @ dt, "u": h.T @ dg, "q": (t * g).T @ de, "c": z.T @ ds, "o": ds.sum(keepdims=True)}

    @staticmethod
    def _bags(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All bags, made about a quarter of a megabyte at a time to keep the driver small."""
        begin = np.concatenate([[0], np.cumsum([max(1, -(-len(t) // PASSAGE)) for t in texts])])
        out, first, size = np.empty((begin[-1], BINS + EXTRA), np.float32), 0, 0
        for k, t in enumerate(texts):
            size += len(t) + PASSAGE
            if size > 1 << 18 or k == len(texts) - 1:
                out[begin[first] : begin[k + 1]] = passages(texts[first : k + 1])[0]
                first, size = k + 1, 0
        return out, begin

    def fit(self, texts: list[bytes], label: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Model:
        r = np.random.default_rng(seed)
        x, begin = self._bags(texts)
        share = np.clip(label.mean(), 0.05, 0.95)
        weight = np.where(label == 1, 0.5 / share, 0.5 / (1 - share)) ** 0.5  # halfway to equal weight
        m, v, step = {k: np.zeros_like(y) for k, y in self.p.items()}, {k: np.zeros_like(y) for k, y in self.p.items()}, 0
        for epoch in range(epochs):
            order = r.permutation(len(texts))
            for k in range(0, len(order), 64):
                bags = order[k : k + 64]
                rows = np.concatenate([np.arange(begin[b], begin[b + 1]) for b in bags])
                grad = self.gradients(x[rows], np.concatenate([[0], np.cumsum((begin[1:] - begin[:-1])[bags])]), label[bags], weight[bags])
                step += 1
                rate = 0.004 * (1 - epoch / epochs) + 0.0002
                for n, d in grad.items():
                    d = d / len(bags) + 1e-5 * self.p[n]
                    m[n] += 0.1 * (d - m[n])
                    v[n] += 0.001 * (d * d - v[n])
                    self.p[n] = (self.p[n] - rate * (m[n] / (1 - 0.9**step)) / (np.sqrt(v[n] / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
        return self


def trained(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> Model | float:
    """The model, from at most ``fit_docs`` labelled documents whose remainder is not 2, within FIT_DOC_BYTES and FIT_BYTES; without two labels, the constant score of the one there is (none: 1)."""
    sample = labelled(docs, labels, "quality", fit_docs, lambda c: common.remainder(4, c) != 2)
    got = sample.filter(F.octet_length("text") <= FIT_DOC_BYTES).collect()
    texts, marks, used = [], [], 0
    for r in sorted(got, key=lambda r: (r.doc_id * 0x9E3779B1 & 0xFFFFFFFF, r.doc_id, r.text)):
        data = r.text.encode()
        if used + len(data) <= FIT_BYTES:
            texts.append(data)
            marks.append(int(r.label == 1))
            used += len(data)
    label = np.array(marks, np.float32)
    if not len(label) or label.min() == label.max():
        return float(label[0]) if len(label) else 1.0
    return Model().fit(texts, label)


def scored(docs: DataFrame, model: Model | float, threshold: float = 0.7, carry: list[str] | None = None) -> DataFrame:
    """doc_id, score (0 to 1), predicted and, if asked for, text and the struct ``carry``: one row per input row.

    Whole texts are scored; a null text is the empty text, which is one empty
    passage.  Nothing but the text goes into a score.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    rows = common.prepared(docs, carry=carry)
    kind = StructType([*_parse_datatype_string("doc_id bigint, score double, predicted int").fields, *([rows.schema["text"], rows.schema["carry"]] if carry else [])])
    target = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            score, group, size = np.empty(len(texts)), [], 0
            for k, t in enumerate(texts):  # about a quarter of a megabyte at a time
                group.append(k)
                size += len(t) + PASSAGE
                if size > 1 << 18 or k == len(texts) - 1:
                    score[group] = model.score([texts[g] for g in group]) if isinstance(model, Model) else model
                    group, size = [], 0
            score = np.round(score, 6)  # below that, a score depends on how rows are batched
            cols = [batch.column("doc_id"), pa.array(score), pa.array((score >= threshold).astype(np.int32))] + ([batch.column("text"), batch.column("carry")] if carry else [])
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, target, strict=True)], schema=target)
        common.release()

    return rows.mapInArrow(run, kind)


def op4_quality(spark, sf_dir: str) -> DataFrame:
    docs = common.reading(spark, sf_dir, "documents")
    found = scored(docs, trained(docs, common.reading(spark, sf_dir, "labels")))
    return found.select("doc_id", (common.remainder(4) == 2).alias("held_out"), "score", "predicted")

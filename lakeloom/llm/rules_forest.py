"""Quality rules: statistics of each text, fixed rules, and an isolation forest.

The forest isolates rows by random splits of their rule statistics: a row
that few splits set apart is unlike the others.  Each tree is grown on rows
of its own, drawn by hash from all labelled rows, and the score from which a
row is rejected is the one that best parts all rows labelled bad from all good
ones while it keeps the share ``keep`` of the good ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm import common

#: Trees, rows of a tree, and the share of good rows to keep; scores are whole parts of GRADES, so their counts over all rows fit the driver.
TREES, TREE_ROWS, KEEP, SEED, GRADES = 200, 256, 0.995, 7, 1 << 16
NAMES = ("word_length", "symbols", "duplicate_lines", "upper", "distinct_words", "marks", "lone_marks")
_KIND = np.zeros(256, np.uint8)  # 1 white space, 2 symbol, 4 upper, 8 lower, 16 other mark
_KIND[[32, *range(9, 14)]] |= 1
_KIND[list(b"#*$%&|<>")] |= 2
_KIND[65:91] |= 4
_KIND[97:123] |= 8
_KIND[[c for c in range(33, 127) if not chr(c).isalnum()]] |= 16
_WINDOW = 8


def _per_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def statistics(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Counts of each text: the base columns and what the features need."""
    data, off = common.concatenated(texts)
    kind = _KIND[data]
    space = (kind & 1) > 0
    begins = ~space
    begins[1:] &= space[:-1]
    inner = off[:-1][(off[:-1] < len(data)) & (np.diff(off) > 0)]
    begins[inner] = ~space[inner]
    out = {
        "n_words": _per_text(begins, off),
        "word_chars": _per_text(~space & ((data & 0xC0) != 0x80), off),
        "n_symbols": _per_text(kind & 2 > 0, off),
        "upper": _per_text(kind & 4 > 0, off),
        "lower": _per_text(kind & 8 > 0, off),
        "marks": _per_text(kind & 16 > 0, off),
    }
    # words as numbers: equal words, equal numbers
    at = np.flatnonzero(begins)
    packed = data[~space]
    ends = np.append(np.concatenate([[0], np.cumsum(~space)])[at], len(packed)).astype(np.int32)
    words = pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(packed.tobytes())]).dictionary_encode()
    ids = words.indices.to_numpy().astype(np.uint64)
    w_off = np.concatenate([[0], np.cumsum(out["n_words"])])
    text = np.repeat(np.arange(len(texts)), out["n_words"]).astype(np.uint64)
    lone = np.flatnonzero(np.diff(ends) == 1)
    out["lone_marks"] = np.bincount(text[lone[(kind[at[lone]] & 16) > 0]].astype(np.int64), minlength=len(texts))
    both = np.unique(text << np.uint64(32) | ids)
    out["distinct_words"] = np.bincount((both >> np.uint64(32)).astype(np.int64), minlength=len(texts))
    out["n_repeat_words"] = _repeated(ids, text, w_off, len(texts))
    lines, copies = [], []
    for t in texts:
        if b"\n" not in t:
            lines.append(1)
            copies.append(0)
            continue
        full = [x for x in t.split(b"\n") if x and not x.isspace()]
        lines.append(max(1, len(full)))
        copies.append(len(full) - len(set(full)))
    out["lines"], out["n_dup_lines"] = np.array(lines), np.array(copies)
    return out


def _repeated(ids: np.ndarray, text: np.ndarray, w_off: np.ndarray, n: int) -> np.ndarray:
    """Words of each text in windows of eight words that the text holds twice or more."""
    if len(ids) < _WINDOW:
        return np.zeros(n, np.int64)
    last = len(ids) - _WINDOW
    start = np.flatnonzero(text[: last + 1] == text[_WINDOW - 1 :])
    pairs = [ids[k : k + last + 1] << np.uint64(32) | ids[k + 1 : k + last + 2] for k in range(0, _WINDOW, 2)]
    with np.errstate(over="ignore"):
        h = text[: last + 1] * np.uint64(0x9E3779B97F4A7C15)
        for p in pairs:
            h = (h ^ p) * np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(29)
    label = common.msd_groups([h[start], text[start], *[p[start] for p in pairs]])
    _, of, size = np.unique(label, return_inverse=True, return_counts=True)
    again = start[size[of] > 1] if len(start) else start
    cover = np.zeros(len(ids) + 1, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + _WINDOW, -1)
    hit = np.concatenate([[0], np.cumsum(np.cumsum(cover)[:-1] > 0)])
    return hit[w_off[1:]] - hit[w_off[:-1]]


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    words, letters = np.maximum(1, s["n_words"]), np.maximum(1, s["upper"] + s["lower"])
    return np.stack(
        [s["word_chars"] / words, s["n_symbols"] / words, s["n_dup_lines"] / s["lines"], s["upper"] / letters, s["distinct_words"] / np.sqrt(words), s["marks"] / words, s["lone_marks"] / words], 1
    ).astype(np.float32)


def base_failed(s: dict[str, np.ndarray]) -> np.ndarray:
    return (s["n_words"] < 20) | (100 * s["n_repeat_words"] > 30 * s["n_words"])


def _path(n: float) -> float:
    """Mean path of a failed search in a tree of n rows."""
    return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


class Forest:
    """Isolation forest; ``score`` is in 0 to 1, higher for rows that are set apart sooner."""

    def __init__(self, x: np.ndarray | list[np.ndarray], trees: int = TREES, rows: int = TREE_ROWS, seed: int = SEED):
        """x: the rows, or for each tree those that it draws from."""
        rng = np.random.default_rng(seed)
        pools = x if isinstance(x, list) else [x] * trees
        self.rows = min(rows, *[len(pool) for pool in pools])
        depth = max(1, int(np.ceil(np.log2(max(2, self.rows)))))
        self.depth, self.trees = depth, []
        for pool in pools:
            part = pool[rng.permutation(len(pool))[: self.rows]]
            feature, cut, child, length = [], [], [], []
            todo = [(part, 0, None)]
            while todo:
                rows_, level, parent = todo.pop()
                node = len(feature)
                if parent is not None:
                    child[parent[0]][parent[1]] = node
                feature.append(0)
                cut.append(np.inf)
                child.append([node, node])
                length.append(level + _path(len(rows_)))
                if level < depth and len(rows_) > 1:
                    low, high = rows_.min(0), rows_.max(0)
                    if len(some := np.flatnonzero(high > low)):
                        f = int(rng.choice(some))
                        at = np.float32(rng.uniform(low[f], high[f]))
                        feature[node], cut[node] = f, at
                        todo += [(rows_[rows_[:, f] < at], level + 1, (node, 0)), (rows_[rows_[:, f] >= at], level + 1, (node, 1))]
            self.trees.append((np.array(feature, np.int16), np.array(cut, np.float32), np.array(child, np.int32), np.array(length, np.float32)))

    def score(self, x: np.ndarray) -> np.ndarray:
        total, each = np.zeros(len(x)), np.arange(len(x))
        for feature, cut, child, length in self.trees:
            node = np.zeros(len(x), np.int32)
            for _ in range(self.depth):
                node = child[node, (x[each, feature[node]] >= cut[node]).astype(np.int8)]
            total += length[node]
        return 2.0 ** (-total / len(self.trees) / max(1e-9, _path(self.rows)))


def calibrated(score: np.ndarray, good: np.ndarray, bad: np.ndarray, keep: float = KEEP) -> float:
    """The score above which rows are rejected: best for both labels, but never below what keeps ``keep`` of the good rows.  score: ascending; good, bad: how many rows have it."""
    if not good.sum() or not bad.sum():
        return np.inf
    at = keep * (good.sum() - 1)  # between two good rows, as np.quantile has it
    low, high = score[np.searchsorted(np.cumsum(good), [np.floor(at), np.ceil(at)], "right")]
    right = (bad.sum() - np.cumsum(bad)) / bad.sum() + np.cumsum(good) / good.sum()
    right[score < low + (high - low) * (at - np.floor(at))] = -1
    return float(score[int(np.argmax(right))])


def drawn(rows: DataFrame, n: int) -> list[np.ndarray]:
    """For each tree about twice TREE_ROWS of the n rows (doc_id, label, x), by the hash of id and tree: all rows if there are no more."""
    share = min(1.0, 2 * TREE_ROWS / max(1, n))
    salt = np.random.default_rng(SEED).integers(0, 2**63, TREES).astype(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), np.float32).reshape(-1, len(NAMES))
            h = batch.column("doc_id").to_numpy().view(np.uint64)[:, None] ^ salt
            for prime in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
                h = (h ^ h >> np.uint64(30)) * np.uint64(prime)
            row, tree = np.nonzero((h >> np.uint64(11)).astype(np.float64) * 2.0**-53 < share)
            yield pa.RecordBatch.from_arrays([pa.array([common.packed(tree.astype(np.int16), batch.column("label").to_numpy()[row].astype(np.int32), x[row])], pa.binary())], names=["body"])

    got = [common.unpacked(r["body"], np.int16, np.int32, np.float32) for r in rows.mapInArrow(run, "body binary").collect()]
    tree, label, x = (np.concatenate([g[k] for g in got]) for k in range(3))
    x = x.reshape(-1, len(NAMES))
    order = np.lexsort([*x.T[::-1], label, tree])  # whatever task a row comes from
    ends = np.searchsorted(tree[order], np.arange(TREES + 1))
    return [x[order[ends[t] : ends[t + 1]]] for t in range(TREES)]


def labelled(docs: DataFrame, labels: DataFrame, label: str, rows: int, keep=None) -> DataFrame:
    """doc_id, text, label of at most ``rows`` labelled documents, by the hash of their id; null labels are none, of several the least counts, and of several texts of an id the one of least hash."""
    chosen = labels.select(F.col("doc_id").cast("bigint").alias("id"), F.col(label).cast("int").alias("label")).filter("label is not null and id is not null")
    if keep is not None:
        chosen = chosen.filter(keep("id"))
    chosen = chosen.groupBy("id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(rows)
    texts = common.prepared(docs)
    return texts.join(F.broadcast(chosen), texts["doc_id"] == chosen["id"]).groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "text", "label")


def judged(docs: DataFrame, labels: DataFrame, keep: float = KEEP) -> DataFrame:
    """doc_id, the base columns, base_failed, kept and the forest's score: one row per input row.

    Words are runs without ASCII white space; a null text has none.  Rows
    fail by fewer than 20 words, or more than 30 % of words in repeated
    windows; all others are kept unless the forest rejects them.  All
    labelled rows that do not fail count; null labels are none, of several
    the least counts, and of several texts of an id the one of least hash.
    Without rows of both labels the forest rejects none.  Repeated rows get
    equal results; labels (doc_id, quality 0 or 1) may name unknown
    documents.  A score that equals the threshold is kept.
    """
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    counts = ", ".join(f"{c} bigint" for c in base)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                s = statistics(part.column("text").cast(pa.binary()).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("copy"), *[pa.array(s[c].astype(np.int64)) for c in base], pa.array(base_failed(s)), pa.array(list(features(s)), pa.list_(pa.float32()))], names=["doc_id", "copy", *base, "base_failed", "x"])

    texts = common.prepared(docs).withColumn("copy", F.xxhash64("text"))
    rows = common.written(texts.mapInArrow(measure, f"doc_id bigint, copy bigint, {counts}, base_failed boolean, x array<float>"), "statistics")
    label = labels.select(F.col("doc_id").cast("bigint").alias("id"), F.col("quality").cast("int").alias("label")).filter("label is not null and id is not null").groupBy("id").agg(F.min("label").alias("label"))
    own = F.min_by(F.struct("x", "base_failed"), "copy").alias("own")
    known = rows.join(label, rows["doc_id"] == label["id"]).groupBy("doc_id", "label").agg(own)
    known = common.written(known.filter("not own.base_failed").select("doc_id", "label", "own.x"), "labelled")

    def graded(model: Forest, x: np.ndarray) -> np.ndarray:
        return np.round(model.score(x) * GRADES)

    def rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), np.float32).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([pa.array(graded(model, x)), pa.array(batch.column("label").to_numpy() == 1)], names=["grade", "good"])

    model, at = None, np.inf
    if n := known.count():
        model = Forest(drawn(known, n))
        grades = known.mapInArrow(rated, "grade double, good boolean").groupBy("grade").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
        at = calibrated(*np.array(sorted((r["grade"], r["good"], r["bad"]) for r in grades.collect())).T, keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), np.float32).reshape(-1, len(NAMES))
            grade = graded(model, x) if model else np.zeros(batch.num_rows)
            kept = ~np.array(batch.column("base_failed").to_pylist(), bool) & (grade <= at)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", *base, "base_failed")], pa.array(kept), pa.array(grade / GRADES)], names=["doc_id", *base, "base_failed", "kept", "score"])

    return rows.drop("copy").mapInArrow(run, f"doc_id bigint, {counts}, base_failed boolean, kept boolean, score double")


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judged(common.reading(spark, sf_dir, "documents"), common.reading(spark, sf_dir, "labels"))

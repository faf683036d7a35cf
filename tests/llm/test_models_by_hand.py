"""The models of op4, op7 and op8 against plain loops that are written from their definitions."""

import math

import numpy as np
import pytest

from lakeloom.llm import langid, quality_mil, rules_forest

TEXTS = [b"", b"x", b"A plain text of some words. " * 60, b"### *** $$$ " * 90, "été ß 日本 \x85".encode() * 40, b"q" * 512, b"q" * 513]


def passage(data):
    """Inputs of one passage, feature by feature."""
    n, out = max(1, len(data)), [0.0] * quality_mil.BINS
    for a, b in zip(data, data[1:]):
        out[((a << 8 | b) * 0x9E3779B1 & 0xFFFFFFFF) >> 22] += 1
    share = [x / n for x in out]
    upper, lower = sum(65 <= c <= 90 for c in data), sum(97 <= c <= 122 for c in data)
    return [4 * math.sqrt(x) for x in share] + [20 * sum(x * x for x in share), sum(x > 0 for x in out) / math.sqrt(n) - 4, 5 * max(share), 2 * upper / max(1, upper + lower), math.log1p(len(data)) - 5]


def test_quality_score_by_hand():
    m = quality_mil.Model()
    r = np.random.default_rng(4)
    m.p = {k: r.normal(0, 0.2, v.shape).astype(np.float32) for k, v in m.p.items()}
    p = {k: v.astype(np.float64) for k, v in m.p.items()}
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    for text, got in zip(TEXTS, m.score(TEXTS), strict=True):
        bag = [passage(text[k : k + quality_mil.PASSAGE]) for k in range(0, max(1, len(text)), quality_mil.PASSAGE)]
        hidden = [[math.tanh(sum(x * w for x, w in zip(row, p["w"][:, j])) + p["b"][j]) for j in range(quality_mil.HIDDEN)] for row in bag]
        energy = []
        for h in hidden:
            t = [math.tanh(sum(a * b for a, b in zip(h, p["v"][:, j]))) for j in range(quality_mil.ATTENTION)]
            g = [sigmoid(sum(a * b for a, b in zip(h, p["u"][:, j]))) for j in range(quality_mil.ATTENTION)]
            energy.append(math.exp(sum(a * b * q for a, b, q in zip(t, g, p["q"]))))
        z = [sum(e * h[j] for e, h in zip(energy, hidden)) / sum(energy) for j in range(quality_mil.HIDDEN)]
        assert sigmoid(sum(a * b for a, b in zip(z, p["c"])) + p["o"][0]) == pytest.approx(got, abs=2e-5)


def test_language_probabilities_by_hand():
    m = langid.Model(["a", "b", "c"])
    p, h = {k: v.astype(np.float64) for k, v in m.p.items()}, langid.STATES
    sigmoid = lambda x: 1 / (1 + np.exp(-x))

    def states(window, d):
        """After each byte, in the order of the text; windows are filled up with zero bytes."""
        padded = window + bytes(langid.WINDOW - len(window))
        order = range(len(padded)) if d == "f" else range(len(padded) - 1, -1, -1)
        state, out = np.zeros(h), {}
        for t in order:
            e, own = p[f"{d}e"][:, padded[t]], p[f"{d}u"] @ state
            reset, update = sigmoid(e[:h] + own[:h]), sigmoid(e[h : 2 * h] + own[h : 2 * h])
            fresh = np.tanh(e[2 * h :] + reset * (own[2 * h :] + p[f"{d}n"][:, 0]))
            state = update * state + (1 - update) * fresh
            out[t] = state
        return out

    for text, got in zip(TEXTS, m.score(TEXTS), strict=True):
        total = np.zeros(3)
        for k in range(0, len(text), langid.WINDOW):
            part = text[k : k + langid.WINDOW]
            f, b = states(part, "f"), states(part, "b")
            for t in range(len(part)):
                y = np.exp(p["o"] @ np.concatenate([f[t], b[t]]) + p["c"][:, 0])
                total += y / y.sum()
        assert got == pytest.approx(total / max(1, len(text)), abs=1e-4)


def test_forest_by_walking_its_trees():
    r = np.random.default_rng(9)
    x = r.normal(0, 1, (300, 4)).astype(np.float32)
    x[250:] = x[0]  # ties: rows that no split sets apart
    forest = rules_forest.Forest(x, trees=20, rows=64)
    assert forest.score(x) == pytest.approx(walked(forest, x), abs=1e-6)
    assert forest.score(np.array([[50, -50, 50, -50]], np.float32))[0] > forest.score(x).mean()


def walked(forest, x):
    """Each tree from its root, one comparison at a time; a leaf adds the mean path of the rows it still holds."""
    mean = lambda n: 0.0 if n < 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n
    out = []
    for row in x:
        total = 0.0
        for feature, cut, child, length in forest.trees:
            node = 0
            while math.isfinite(cut[node]):
                node = child[node][1] if row[feature[node]] >= cut[node] else child[node][0]
            total += length[node]
        out.append(2 ** (-total / len(forest.trees) / mean(forest.rows)))
    return out


def test_verdict_of_the_rules_by_hand(spark):
    """kept: base rules pass, and the walked score does not exceed the threshold that labelled rows give."""
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    label = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None}
    rows = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    s = rules_forest.statistics(list(rows.values()))
    x, failed = rules_forest.features(s), rules_forest.base_failed(s)
    train = sorted((label[i], x[k].tolist()) for k, i in enumerate(rows) if i in label and not failed[k])
    forest = rules_forest.Forest(np.array([t for _, t in train], np.float32))
    scores, good = np.array(walked(forest, np.array([t for _, t in train], np.float32))), np.array([y == 1 for y, _ in train])
    least = np.quantile(scores[good], rules_forest.KEEP)
    best = max((c for c in sorted(set(scores)) if c >= least), key=lambda c: (round((scores[~good] > c).mean() + (scores[good] <= c).mean(), 9), -c))
    want = {i: bool(not failed[k] and w <= best + 1e-9) for (k, i), w in zip(enumerate(rows), walked(forest, x), strict=True)}
    got = {r.doc_id: r.kept for r in rules_forest.judged(docs, labels).collect()}
    assert got == want and len(set(got.values())) == 2


def test_all_labelled_rows_count(spark):
    """More rows than any earlier bound: the threshold is the one of all of them, and trees' rows come from all."""
    n, r = 6000, np.random.default_rng(5)
    texts = [" ".join("".join(r.choice(list("abcdefgh#"), r.integers(2, 9))) for _ in range(30)) for _ in range(300)]
    docs = [(i, texts[i % 300] + " " + "x" * (i % 7)) for i in range(n)]
    labels = [(i, int(i % 300 >= 30 or i % 11 == 0)) for i in range(n)]
    known = spark.createDataFrame(labels, "doc_id bigint, quality int")
    got = {x.doc_id: x for x in rules_forest.judged(spark.createDataFrame(docs, "doc_id bigint, text string"), known).collect()}
    scores, good = np.array([got[i].score for i in range(n)]), np.array([y == 1 for _, y in labels])
    assert not any(x.base_failed for x in got.values())
    least = np.quantile(scores[good], rules_forest.KEEP)
    best = max((c for c in sorted(set(scores)) if c >= least), key=lambda c: (round((scores[~good] > c).mean() + (scores[good] <= c).mean(), 9), -c))
    assert [got[i].kept for i in range(n)] == (scores <= best).tolist()
    rows = spark.range(n).selectExpr("id AS doc_id", "1 AS label", "array_repeat(cast(id AS float), 7) AS x")
    pools = rules_forest.drawn(rows, n)
    assert len(pools) == rules_forest.TREES and min(map(len, pools)) >= rules_forest.TREE_ROWS and len({v for p in pools for v in p[:, 0]}) > 0.99 * n

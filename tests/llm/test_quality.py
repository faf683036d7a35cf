"""Quality rules and classifier: brute-force counts, gradients and held-out accuracy."""

import zlib
from collections import Counter

import numpy as np

from lakeloom.llm import quality_mil, queries, rules_forest

SPACE = " \t\n\x0b\x0c\r"


def words_of(t):
    return "".join(" " if c in SPACE else c for c in t or "").split(" ")


def brute(t):
    w = [x for x in words_of(t) if x]
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if [x for x in words_of(line) if x]:
            dup += line in seen
            seen.add(line)
    win = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    many = Counter(win)
    hit = {i + k for i, x in enumerate(win) if many[x] > 1 for k in range(8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), dup, len(hit)


TEXTS = ["", None, " \n\t", "one", "a b c d e f g h " * 3, "#x *y\n#x *y\n\n\n  \n  \n#x *y\r\n", "é ß 日本 \x85 x\x1cy \x0b z", "The And " * 400, "q w e r t y u i\no p\nq w e r t y u i\no p", "x" * 20000, "\x00 \x00"]


def test_base_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(1000 + k, t) for k, t in enumerate(TEXTS)] + [(None, "a b"), (1000, "")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id bigint, text string, n_words int, kept string")
    got = rules_forest.judged(df, labels).collect()
    assert len(got) == len(rows)
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got), key=str) == sorted(((i, *brute(t)) for i, t in rows), key=str)
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept)


def test_forest_parts_good_from_bad(spark):
    sf = "/root/testdata/sf0.01"
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in queries.QUERIES["op8_quality_rules"](spark, sf).collect() if r.doc_id in label and not r.base_failed]
    good, bad = [r.kept for r in got if label[r.doc_id]], [r.kept for r in got if not label[r.doc_id]]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.2


def test_without_labels_or_rows(spark):
    df = spark.createDataFrame([(1, "word " * 30), (2, None)], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert {(r.doc_id, r.base_failed) for r in rules_forest.judged(df, none).collect()} == {(1, True), (2, True)}
    assert rules_forest.judged(df.limit(0), none).count() == 0
    model = quality_mil.trained(df, none)
    assert {r.score for r in quality_mil.scored(df, model).collect()} == {1.0}
    odd = spark.createDataFrame([(1, None), (None, 1), (7, 0), (7, 1)], "doc_id bigint, quality int")
    assert quality_mil.trained(df, odd) == 1.0
    assert quality_mil.scored(df.limit(0), model).count() == 0


def test_gradients_equal_differences():
    m = quality_mil.Model()
    x, begin = quality_mil.passages([b"one two three " * 80, b"", b"### *** " * 300])
    x = x.astype(np.float64)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    label, weight = np.array([1.0, 0.0, 0.0]), np.array([1.0, 0.5, 2.0])

    def loss():
        s = m.forward(x, begin)[-1]
        return -(weight * (label * np.log(s) + (1 - label) * np.log(1 - s))).sum()

    grad = m.gradients(x, begin, label, weight)
    r = np.random.default_rng(0)
    for name, g in grad.items():
        for _ in range(5):
            at = tuple(r.integers(0, n) for n in g.shape)
            old = m.p[name][at]
            m.p[name][at] = old + 1e-4
            up = loss()
            m.p[name][at] = old - 1e-4
            down = loss()
            m.p[name][at] = old
            assert abs((up - down) / 2e-4 - g[at]) < 1e-3 * max(1, abs(g[at]))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = queries.QUERIES["op4_quality"](spark, sf).collect()
    assert len(got) == 1000
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    held = [(label[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in label]
    assert np.mean([p for y, p in held if y]) > 0.95 and np.mean([y == p for y, p in held]) > 0.93


def test_scores_of_odd_texts(spark):
    m = quality_mil.Model()
    df = spark.createDataFrame([(k, t, 0.5, 1) for k, t in enumerate(TEXTS)] + [(None, "x", None, None), (1, None, 1.0, 2)], "doc_id bigint, text string, score double, predicted int")
    got = quality_mil.scored(df, m, carry=["score"]).collect()
    assert len(got) == len(TEXTS) + 2 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (0, 1)}) == 1

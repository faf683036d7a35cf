"""Language identification: gradients, held-out accuracy, rows of all kinds."""

import zlib

import numpy as np

from lakeloom.llm import langid, queries


def test_gradients_equal_differences():
    m = langid.Model(["a", "b", "c"])
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    r = np.random.default_rng(1)
    rows, length, label = r.integers(97, 105, (5, 12)).astype(np.uint8), np.array([12, 12, 5, 1, 12]), np.array([0, 1, 2, 1, 0])
    grad, _ = m.gradients(rows, length, label)
    for name, g in grad.items():
        for _ in range(6):
            at = (r.integers(0, g.shape[0]), r.integers(97, 105) if name[1:] == "e" else r.integers(0, g.shape[1]))
            old = m.p[name][at]
            m.p[name][at] = old + 1e-5
            up = m.gradients(rows, length, label)[1]
            m.p[name][at] = old - 1e-5
            down = m.gradients(rows, length, label)[1]
            m.p[name][at] = old
            assert abs((up - down) / 2e-5 - g[at]) < 1e-6 + 1e-4 * abs(g[at])


def test_windows_hold_whole_texts():
    texts = [b"", b"x", b"y" * 64, b"z" * 65, b"w" * 700]
    rows, length, begin = langid.windows(texts)
    for k, t in enumerate(texts):
        assert b"".join(bytes(r[:n]) for r, n in zip(rows[begin[k] : begin[k + 1]], length[begin[k] : begin[k + 1]], strict=True)) == t
        assert len(langid.Model(["a", "b"]).positions(t)) == len(t)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.QUERIES["op7_language_id"](spark, sf).collect()
    assert len(got) == len(lang)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in lang[r.doc_id][1] or ""))
    held = [r.lang_pred == lang[r.doc_id][0] for r in got if r.held_out and r.lang_pred != "und"]
    assert np.mean(held) > 0.97


def test_rows_of_all_kinds(spark):
    texts = [None, "", "123 ###", "é", "日本", "a" * 5000, " \n", "x"]
    df = spark.createDataFrame([(k, t, "q", 2) for k, t in enumerate(texts)] + [(None, "abc", None, 1), (7, "x", "q", 2)], "doc_id bigint, text string, lang_pred string, score int")
    m = langid.Model(["a", "b"])
    got = langid.identified(df, m).collect()
    assert len(got) == len(texts) + 2
    assert {r.doc_id for r in got if r.lang_pred == "und"} == {0, 1, 2, 6}
    assert len({r.score for r in got if r.doc_id == 7}) == 1
    assert {r.lang_pred for r in langid.identified(df, None).collect()} == {"und"}
    assert langid.identified(df.limit(0), m).count() == 0
    assert langid.trained(df.selectExpr("doc_id", "text", "cast(null as string) AS lang")) is None

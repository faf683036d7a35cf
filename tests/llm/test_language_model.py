"""Language model: against plain loops, as a proper distribution, gradients, the base score, held-out gain."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lakeloom.llm import bpe, common, language_model as lm


@pytest.fixture(scope="module")
def small():
    codec = bpe.codec(bpe.default_vocabulary(), False)
    opens = lm.opening_ids(codec)
    texts = [b"the cat sat on the mat " * 30, b"", b"a", b"dogs and cats sat there, mostly " * 9, "été ß \xa0x y z".encode()]
    ids, begin, *_ = lm.streams(texts, codec, opens)
    return codec, opens, texts, ids, begin, lm.Model(lm.Vocabulary(ids, opens))


def test_streams_spell_the_words(small):
    codec, opens, texts, ids, begin, _ = small
    for k, t in enumerate(texts):
        mine = ids[begin[k] : begin[k + 1]]
        assert mine[-1] == lm.END and codec.decode(mine[:-1]) == b"".join(b" " + w for w in t.lower().split())


def plain(m, ids, k):
    """Log probabilities of all ids at place k of one stream."""
    v, p = m.v, m.p
    code = lambda j: v.first if j < 0 else v.input[ids[j]]
    start = max(0, k // lm.SCORED * lm.SCORED - lm.OVERLAP)
    keys = [code(j - 1) for j in range(start, k + 1)]
    s = np.array([p["q"][keys[-1]] @ p["k"][c] + p["d"][k - start - j] for j, c in enumerate(keys)])
    a = np.exp(s - s.max())
    a /= a.sum()
    h = np.tanh(p["a"][keys[-1]] + (a @ p["x"][keys]) @ p["w"])
    y = np.where(v.live, h @ p["c"] + p["cb"], -np.inf)
    y = y - np.log(np.exp(y).sum())
    z = np.where(v.valid, np.einsum("h,chm->cm", h, p["m"]) + p["mb"], -np.inf)
    with np.errstate(divide="ignore"):
        z = z - np.log(np.exp(z).sum(1, keepdims=True))
    return (y[:, None] + z)[v.cluster, v.member] + v.log_rare


def test_equals_plain_loops_and_sums_to_one(small):
    *_, ids, begin, m = small
    m.fit(ids, begin, epochs=1)
    logp, opened = m.log_p(ids, begin)
    for t in range(len(begin) - 1):
        mine = ids[begin[t] : begin[t + 1]]
        for k in sorted({0, 1, 15, 16, 31, 32, 33, 63, 64, 100, len(mine) - 1}):
            if k < len(mine):
                want = plain(m, mine, k)
                assert abs(np.exp(want).sum() - 1) < 1e-4
                assert abs(want[mine[k]] - logp[begin[t] + k]) < 1e-3
                assert abs(np.exp(want[m.v.opens]).sum() - math.exp(opened[begin[t] + k])) < 1e-4


def test_gradients_equal_differences(small):
    *_, ids, begin, _ = small
    m = lm.Model(lm.Vocabulary(ids, lm.opening_ids(small[0])))
    m.p = {k: x.astype(np.float64) for k, x in m.p.items()}
    at, _ = lm.windows(begin)
    grad, _ = m.gradients(ids, at)
    assert len(grad) == len(m.p)
    r = np.random.default_rng(0)
    for name, g in grad.items():
        hot = np.argwhere(np.abs(g) > 1e-5)
        for at_ in hot[r.permutation(len(hot))[:5]]:
            i = tuple(at_)
            old = m.p[name][i]
            m.p[name][i] = old + 1e-5
            up = m.gradients(ids, at)[1]
            m.p[name][i] = old - 1e-5
            down = m.gradients(ids, at)[1]
            m.p[name][i] = old
            assert abs((up - down) / 2e-5 - g[i]) < 1e-6 + 1e-4 * abs(g[i]), name


def base(rows):
    words = lambda t: "".join(c.lower() if c.isascii() else c for c in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in t or "")).split(" ")
    toks = [(i, [w for w in words(t) if w] + [""]) for i, t in rows]
    out = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    c = Counter(w for i, t in toks if not out(i) for w in t)
    n, v = sum(c.values()), len(c)
    return sorted(((i, out(i), len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 5)) for i, t in toks), key=str)


def test_query_and_held_out_gain(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = lm.op2_lm_score(spark, sf).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got), key=str) == base(docs)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(r.score < 0 for r in got)


def test_rows_of_all_kinds(spark):
    rows = [(1, None), (2, ""), (3, "The THE the"), (None, "x"), (4, "é\tÉ"), (4, "é\tÉ"), (5, "w" * 4000), (6, " \n"), (9, "no<|endoftext|>end")]
    df = spark.createDataFrame([(i, t, 0.0, 1) for i, t in rows], "doc_id bigint, text string, score double, n_tokens int")
    got = lm.scored(df).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got), key=str) == base(rows)
    assert len({r.score for r in got if r.doc_id == 4}) == 1
    assert lm.scored(df.limit(0)).count() == 0


def test_attention_is_worked_on_in_small_parts(small, monkeypatch):
    """Few windows' attention at once; neither gradients nor scores depend on how many, nor on windows that are not whole."""
    *_, ids, begin, _ = small
    m = lm.Model(lm.Vocabulary(ids, lm.opening_ids(small[0])))
    at, _ = lm.windows(begin)
    calls, own = [], lm.Model._attended
    monkeypatch.setattr(lm.Model, "_attended", lambda self, tables, inputs: (calls.append(len(inputs)), own(self, tables, inputs))[1])
    got = []
    for together in (3, len(at)):
        monkeypatch.setattr(lm, "TOGETHER", together)
        got.append((m.gradients(ids, at)[0], m.log_p(ids, begin)))
        assert max(calls) == together and sum(calls) == 2 * len(at)
        calls.clear()
    (grad, scores), (grad_whole, scores_whole) = got
    assert all(np.allclose(grad[k], grad_whole[k], atol=1e-6) for k in grad)
    assert all(np.allclose(a, b, atol=1e-5) for a, b in zip(scores, scores_whole, strict=True))


def test_words_are_split_once_and_listed():
    """Batches are gathered before their words are spelled; words are as plain splitting gives them, and cross no texts."""
    texts = [b"", b"A b", b"B\x0bb\x1fc \t", b"", "ÀÉ a\xa0b".encode(), b" ", b"x" * 50, b"Z[@`"]
    codes, words, n = common.word_codes(texts, True)
    want = [[w for w in re.split(rb"[\x20\x09-\x0d]+", t.lower()) if w] for t in texts]
    assert [common.listed(words)[c] for c in codes] == [w for t in want for w in t] and n.tolist() == list(map(len, want))
    assert common.listed(words) == words.to_pylist() and common.listed(words[2:4]) == words[2:4].to_pylist() and common.word_codes([])[0].size == 0
    batches = [pa.RecordBatch.from_arrays([pa.array(["a b"] * k)], names=["text"]) for k in (3, 0, 2)]
    assert list(lm.gathered(iter(batches))) == [[b"a b"] * 5]

"""Suffix de-duplication against brute force."""

import hashlib
import random

import pytest

from lakeloom.llm import suffix_dedup


def brute(rows, width):
    """(id, text) -> per row: bytes, removed, spans, kept."""
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        key = 2**63 - 1 if i is None else i
        for s in range(len(b) - width + 1):
            w = b[s : s + width]
            first[w] = min(first.get(w, key), key)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        key = 2**63 - 1 if i is None else i
        hit = bytearray(len(b))
        for s in range(len(b) - width + 1):
            if first[b[s : s + width]] < key:
                hit[s : s + width] = b"\1" * width
        runs = len([x for x in bytes(hit).split(b"\0") if x])
        out.append((i, len(b), sum(hit), runs, bytes(c for c, h in zip(b, hit) if not h)))
    return sorted(out, key=str)


def run(spark, rows, width=50, hot=None, extra=""):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = suffix_dedup.repeated_spans(df, width).collect()
    return sorted([(r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in got], key=str)


def rows_of(seed, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcé ") for _ in range(r.randint(1, 9)))
    shared = [" ".join(word() for _ in range(r.randint(8, 40))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [" ".join(word() for _ in range(r.randint(0, 30)))]
        for _ in range(r.randint(0, 3)):
            s = r.choice(shared)
            a = r.randint(0, len(s) // 3)
            parts += [s[a:], word()]
        rows.append((i * 3 % 101, "".join(parts)))
    rows += [(500, rows[3][1]), (2, rows[3][1]), (501, None), (502, ""), (503, "x"), (None, rows[4][1]), (504, "De " * 200), (505, "De " * 90), (506, "a" * 500), (506, "a" * 500), (507, "a" * 50)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = rows_of(seed)
    assert run(spark, rows) == brute(rows, 50)


def test_hot_grams_go_by_window(spark, monkeypatch):
    rows = rows_of(3)
    monkeypatch.setattr(suffix_dedup, "HOT", 3)
    import numpy as np

    # run the rounds in this process, so that the changed constant holds
    import pyarrow as pa

    from lakeloom.llm import common

    table = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] or "" for r in rows]})
    half = table.num_rows // 2
    parts = [t.sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks() for t in (table[:half], table[half:])]
    batches = [suffix_dedup._Batch(t, 50, 3) for t in parts]

    def told(sent, answer):
        back = [{common.STATE: m[common.STATE]} for m in sent]
        for k in range(3):
            who = [n for n, m in enumerate(sent) if k in m]
            for n, body in zip(who, answer(who, [sent[n][k] for n in who]), strict=True):
                back[n][k] = body
        return back

    back = told([b.gram_messages() for b in batches], suffix_dedup._repeated)
    for n, b in enumerate(batches):
        b.heard(back[n])
    assert sum(len(b.w_start) for b in batches)
    back = told([b.window_messages() for b in batches], suffix_dedup._sorted_windows(50))
    got = []
    for n, b in enumerate(batches):
        starts = b.removed(back[n])
        hit = np.zeros(len(b.data), bool)
        for s in starts:
            hit[s : s + 50] = True
        for k, r in enumerate(b.reps):
            got.append((b.ids[r], int(hit[b.offsets[k] : b.offsets[k + 1]].sum())))
    texts = {(2**63 - 1 if i is None else i): n for i, _, n, _, _ in brute(rows, 50)}
    seen = {b.ids[r] for b in batches for r in b.reps}
    assert sorted(set(got)) == sorted((i, n) for i, n in texts.items() if i in seen) and sum(n for _, n in got) > 500


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert suffix_dedup.repeated_spans(empty).count() == 0
    df = spark.createDataFrame([(1, "x" * 60, 5, "k"), (2, "x" * 60, 6, None)], "doc_id bigint, text string, n_removed int, kept string")
    got = {r.doc_id: r for r in suffix_dedup.repeated_spans(df, carry=["n_removed", "kept"]).collect()}
    assert got[2].n_removed == 60 and got[1].n_removed == 0 and got[2].carry.n_removed == 6


def test_query(spark, sf):
    got = suffix_dedup.op10_suffix_dedup(spark, sf).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {(i, b, n, s, hashlib.sha256(k).hexdigest()) for i, b, n, s, k in brute(docs, 50)}
    assert {tuple(r) for r in got} == want

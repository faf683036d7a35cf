"""The pipeline, stage by stage, against brute force."""

import numpy as np
import pytest

import corpus_pipeline as cp
from lakeloom.llm import bpe
from tests.llm.test_native import brute_leaks
from tests.llm.test_near_copies import brute as one_of_each
from tests.llm.test_suffix_dedup import brute


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    clean = [r for r in docs.orderBy("doc_id").collect() if r.n_chars < 3000][:12]
    item = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").first().text
    more = [(900_000 + k, r.text, r.lang, r.source, r.n_chars) for k, r in enumerate(clean)] + [(900_100, clean[0].text[:400] + " " + item, "en", None, 1), (900_101, None, None, "s", None), (900_102, "", "en", "s", 0), (900_103, clean[3].text, "en", "s", 1), (900_103, clean[3].text, "en", "s", 1)]
    out = [docs.unionByName(spark.createDataFrame(more, docs.schema))]
    for k, (_, stage) in enumerate(cp.STAGES):
        where = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, out[-1], sf).write.parquet(where)
        out.append(spark.read.parquet(where))
    return out, spark.read.parquet(f"{sf}/labels.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")


def rows(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_columns_stay(stages):
    out, *_ = stages
    assert all(df.columns == out[0].columns and df.dtypes == out[0].dtypes for df in out[1:-1])


def test_quality_keeps_clean_documents(stages):
    out, labels, _ = stages
    label = {r.doc_id: r.quality for r in labels.collect()}
    before, after = {i for i, _ in rows(out[0])}, {i for i, _ in rows(out[1])}
    assert np.mean([i in after for i in before if label.get(i) == 1]) > 0.95
    assert np.mean([i in after for i in before if label.get(i) == 0]) < 0.2
    assert set(rows(out[1])) <= set(rows(out[0]))


def test_one_document_of_a_group_stays(stages):
    out, *_ = stages
    before = rows(out[1])
    want = one_of_each(sorted(set(before), key=str))
    assert len(before) > len(want) and [(i, (t or "").lower()) for i, t in rows(out[2])] == want


def test_repeats_are_cut(stages):
    out, *_ = stages
    want = sorted(((i, k.decode("utf-8", "ignore")) for i, _, _, _, k in brute(rows(out[2]), 50)), key=str)
    assert [(i, t or "") for i, t in rows(out[3])] == want
    assert all(r.n_chars == len(r.text) for r in out[3].collect() if r.text)


def test_leaks_go(stages):
    out, _, bench = stages
    before = rows(out[3])
    leaks = {d for d, *_ in brute_leaks(before, [(r.item_id, r.text) for r in bench.collect()])}
    assert leaks and rows(out[4]) == [x for x in before if x[0] not in leaks]


def test_encoding_round_trips(stages):
    out, *_ = stages
    text = dict(rows(out[4]))
    got = out[5].collect()
    assert len(got) == len(rows(out[4])) and all(r.exact for r in got)
    for r in got:
        assert bpe.codec(bpe.default_vocabulary()).decode(np.frombuffer(r.ids, "<u4")).decode() == (text[r.doc_id] or "") and r.n_tokens * 4 == len(r.ids)


def test_run(spark):
    got = cp.run(spark, "/root/testdata/sf0.001")
    assert got.count() > 50


ODD = "doc_id bigint, text string, lang string, source string, n_chars bigint, __null int, __digest string, copy int, root string, __first int, key int, carry string, batch int, n int"


def test_stages_take_empty_tables_and_clashing_names(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    text = spark.read.parquet(f"{sf}/documents.parquet").filter("n_chars > 800").first().text
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    rows = [(None, text, None, None, None), (1, text, "en", "s", 3), (None, item, "en", "s", 1), (None, None, "en", "s", 0), (2, None, None, None, None), (3, "", "en", "s", 0), (3, item + " " + text[::-1], "en", "s", 1), (None, "short", "en", "s", 5), (None, "short", "en", "s", 5)]
    docs = spark.createDataFrame([(*r, 7, "d", 8, "r", 9, 10, "c", 11, 12) for r in rows], ODD)
    for name, stage in cp.STAGES:
        full, none = stage(spark, docs, sf), stage(spark, docs.limit(0), sf)
        assert none.count() == 0 and none.columns == full.columns, name
        got = full.collect()
        if stage is not cp.encoding:
            assert full.columns == docs.columns and all((r["__null"], r["__digest"], r.copy, r.root, r.key, r.carry, r.batch, r.n) == (7, "d", 8, "r", 10, "c", 11, 12) for r in got), name
        if stage is cp.decontamination:
            assert sorted(str((r.doc_id, r.text)) for r in got) == sorted(str(r[:2]) for r in rows if not r[1] or item not in r[1])
        if stage is cp.near_duplicates:
            assert sorted(str((r.doc_id, r.text)) for r in got) == sorted(map(str, [(1, text), (None, item), (2, None), (3, item + " " + text[::-1]), (None, "short")]))
        if stage in (cp.encoding, cp.repeated_passages):
            assert len(got) == len(rows)


def test_run_leaves_little_behind(spark):
    """Tables of finished stages go; what the last stage still reads stays."""
    from lakeloom.llm import common

    before = len(common._WRITTEN)
    got = cp.run(spark, "/root/testdata/sf0.001")
    left = common._WRITTEN[before:]
    assert len(left) == 1 and "benchmark-" in left[0] and got.count() > 50
    common.kept_only(spark, before)
    assert common._WRITTEN[before:] == []

"""What the language model takes from the corpus: counts of all training documents, and weights from all of them."""

import numpy as np

from lakeloom.llm import bpe, common, language_model


def test_vocabulary_counts_all_training_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    path = bpe.default_vocabulary()
    codec = bpe.codec(path, False)
    opens = language_model.opening_ids(codec)
    texts = [(r.text or "").encode() for r in docs.collect() if not language_model.held_out(r.doc_id)]
    want = np.bincount(language_model.streams(texts, codec, opens)[0], minlength=len(opens))
    rows = common.prepared(docs)
    counted = language_model.summed_up(language_model.word_counts(common.Exchange(rows, 5), 7, path))
    assert sum(n for i, n in counted.items() if i >= 0) == want.sum() and all(want[i] == n for i, n in counted.items() if i >= 0)
    assert counted[-2] == len({w for t in texts for w in t.lower().split()}) + 1
    v, whole = language_model.trained(rows, counted, path).v, language_model.Vocabulary(np.zeros(0, np.int64), opens, want)
    assert (v.input == whole.input).all() and np.allclose(v.log_rare, whole.log_rare)


def test_every_part_of_the_corpus_moves_the_weights(spark):
    """Weights after ``continued`` are the mean over parts, by windows seen."""
    path = bpe.default_vocabulary()
    docs = common.prepared(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).limit(40).repartition(3).cache()
    codec = bpe.codec(path, False)
    model = language_model.Model(language_model.Vocabulary(np.arange(1000), language_model.opening_ids(codec)))
    before = {k: x.copy() for k, x in model.p.items()}
    parts = docs.rdd.glom().collect()
    total, seen = {k: 0.0 for k in before}, 0
    for rows in parts:
        mine = language_model.Model(model.v)
        mine.p = {k: x.copy() for k, x in before.items()}
        steady = language_model.Adam(mine)
        ids, begin, *_ = language_model.streams([r.text.encode() for r in rows], codec, mine.v.opens)
        at = language_model.windows(begin)[0]
        for k in range(0, len(at), language_model.STEP):
            steady.step(mine.gradients(ids, at[k : k + language_model.STEP])[0], language_model.RATE)
        seen += len(at)
        for k in total:
            total[k] = total[k] + mine.p[k].astype(np.float64) * len(at)
    after = language_model.continued(model, docs, path, draw=1).p
    assert len(parts) == 3 and all(np.allclose(after[k], total[k] / seen, atol=1e-4) for k in total) and not np.allclose(after["w"], before["w"])


def test_model_fits_on_all_training_documents(spark):
    """The model of ``trained`` is the start's, fitted on by every training document's whole text."""
    path = bpe.default_vocabulary()
    codec = bpe.codec(path, False)
    opens = language_model.opening_ids(codec)
    docs = common.prepared(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).repartition(2).cache()
    train = docs.filter(common.remainder(7) != 2)
    count = np.bincount(language_model.streams([r.text.encode() for r in train.collect()], codec, opens)[0], minlength=len(opens))
    begun = language_model.started(train, path, count)
    before = {k: x.copy() for k, x in begun.p.items()}
    total, seen = {k: 0.0 for k in before}, 0
    for rows in train.rdd.glom().collect():
        mine = language_model.Model(begun.v)
        mine.p = {k: x.copy() for k, x in before.items()}
        steady = language_model.Adam(mine)
        ids, begin, *_ = language_model.streams([r.text.encode() for r in rows], codec, opens)
        at = language_model.windows(begin)[0]
        for k in range(0, len(at), language_model.STEP):
            steady.step(mine.gradients(ids, at[k : k + language_model.STEP])[0], language_model.RATE)
        seen += len(at)
        for k in total:
            total[k] = total[k] + mine.p[k].astype(np.float64) * len(at)
    after = language_model.trained(docs, dict(enumerate(count.tolist())), path).p
    assert all(np.allclose(after[k], total[k] / seen, atol=1e-3) for k in total)

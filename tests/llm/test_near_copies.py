"""The near-duplicate stage against brute-force Jaccard similarity."""

import random

import corpus_pipeline as cp
from lakeloom.llm import common, near_copies, simhash


def sets(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """Of each component of pairs of similarity 0.8 or more: the row of least id (none last)."""
    s, root = [sets(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            if s[x] == s[y] or 5 * len(s[x] & s[y]) >= 4 * len(s[x] | s[y]) > 0:
                root[find(x)] = find(y)
    least = {}
    for x, (i, t) in enumerate(rows):
        k = find(x)
        if k not in least or (i is None, i or 0) < (least[k][0] is None, least[k][0] or 0):
            least[k] = (i, t)
    return sorted(((i, (t or "").lower()) for i, t in least.values()), key=str)


def kept(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    return sorted(((r.doc_id, (r.text or "").lower()) for r in cp.near_duplicates(spark, docs, "").collect()), key=str)


def test_stage_equals_brute_force(spark):
    r = random.Random(5)
    words = [f"w{k}" for k in range(300)]
    line = r.choices(words, k=30)
    rows = []
    for k in range(40):
        base = r.choices(words, k=r.choice([3, 5, 12, 60, 200])) + (line if k % 2 else [])
        for _ in range(r.randrange(4)):
            near = list(base)
            for _ in range(r.randrange(1 + len(near) // 20)):
                near[r.randrange(len(near))] = r.choice(words)
            rows.append((len(rows) + 7, " ".join(near)))
        rows.append((len(rows) + 7, " ".join(base)))
    rows += [(900, None), (901, ""), (902, rows[0][1].upper()), (None, rows[1][1]), (None, "no id at all"), (None, "no id at all"), (3, "no id, other text")]
    want = brute(rows)
    assert len(want) < len(rows) - 20 and kept(spark, rows) == want


def test_near_copy_beyond_two_bits_goes(spark):
    text = [f"v{k}" for k in range(120)]
    near = text[:60] + ["other"] + text[61:]
    a, b = sets(" ".join(text)), sets(" ".join(near))
    assert len(a & b) / len(a | b) > 0.9
    assert kept(spark, [(1, " ".join(text)), (2, " ".join(near))]) == [(1, " ".join(text))]


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert kept(spark, rows) == brute(rows)


def test_groups_of_a_common_line_and_of_chains(spark):
    """Texts that all share a line, and a chain of copies whose ends are no copies of each other."""
    r = random.Random(6)
    base = [f"c{k}" for k in range(100)]
    rows = []
    for k in range(12):
        base = base[4:] + [f"x{k}{j}" for j in range(4)]
        rows.append((k, " ".join(base)))
    rows += [(100 + k, " ".join([f"p{k}", *[f"l{j}" for j in range(12)], f"q{r.random()}"])) for k in range(40)]
    want = brute(rows)
    assert len(want) == 41 and kept(spark, rows) == want


def test_prefixes_skip_texts_that_are_alone(spark):
    rows = [(k, " ".join(f"{k}a{j}" for j in range(30))) for k in range(20)] + [(20, " ".join(f"3a{j}" for j in range(29)))]
    found = near_copies.prefixes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(x.doc_id for x in found if x.prefix is not None) == [3, 20]


def test_nothing_of_the_corpus_is_broadcast(spark, monkeypatch):
    """Spark takes replicas and postings for a fraction of the rows that they are, and broadcast them through the driver."""
    plans = []

    def seen(found, texts, verified=near_copies.verified):
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        return verified(found, texts)

    monkeypatch.setattr(near_copies, "verified", seen)
    words = [f"w{k}" for k in range(60)]
    docs = [(i, " ".join([*words[:i], f"x{i}", *words[i + 1 :]])) for i in range(30)]
    simhash.similar_groups(spark.createDataFrame(docs, "doc_id bigint, text string")).count()
    prints = common.written(spark.range(50).selectExpr("xxhash64(id) AS fp", "id AS least"), "prints")
    stars = simhash.stars(prints)._jdf.queryExecution().executedPlan().toString()
    assert len(plans) == 3 and all("BroadcastHashJoin" not in p and "SortMergeJoin" in p for p in [*plans[1:], stars])

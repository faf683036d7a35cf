"""Fingerprints and components against brute force."""

import random

import numpy as np
import xxhash

from lakeloom.llm import common, simhash


def brute_print(text, k=3):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(rows):
    prints = [(i, brute_print(t)) for i, t in rows]
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(prints)):
        for y in range(x):
            if bin(prints[x][1] ^ prints[y][1]).count("1") <= 2:
                root[find(x)] = find(y)
    least = {}
    for x, (i, _) in enumerate(prints):
        if i is not None:
            least[find(x)] = min(i, least.get(find(x), i))
    return sorted(((i, format(p, "016x"), least.get(find(x))) for x, (i, p) in enumerate(prints)), key=str)


def test_replicas_meet_every_close_pair():
    r = np.random.default_rng(3)
    base = r.integers(0, 2**63, 400, dtype=np.int64) * 2 + r.integers(0, 2, 400)
    flips = [(a, b) for a in range(64) for b in range(a, 64)]
    for t in (1, 2):
        for x in base[:40]:
            near = np.array([x ^ np.int64(np.uint64(1 << a).view(np.int64)) ^ (np.int64(0) if a == b else np.uint64(1 << b).view(np.int64)) for a, b in flips if t == 2 or a == b], np.int64)
            i, anchor, centre = simhash.replicas(np.array([x]), t)
            mine = anchor[centre]
            assert len(mine) == 1
            k, theirs, _ = simhash.replicas(near, t)
            assert set(k[theirs == mine[0]]) == set(range(len(near)))


def test_links_equal_brute_force(spark):
    r = random.Random(4)
    prints = [r.getrandbits(64) for _ in range(60)]
    for p in list(prints):
        prints += [p ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for _ in range(3)] + [p ^ (7 << r.randrange(60))]
    prints = sorted({p - 2**64 if p >= 2**63 else p for p in prints})
    df = spark.createDataFrame([(p,) for p in prints], "fp bigint")
    got = {(x.a, x.b) for x in simhash.links(df).collect()}
    assert got == {(a, b) for a in prints for b in prints if a > b and bin((a ^ b) & (2**64 - 1)).count("1") <= 2}


def test_replicas_and_rows_are_not_broadcast(spark):
    """Spark takes 61 replicas for one row: within its limit by its own count, they came to gigabytes in the driver."""
    prints = common.written(spark.range(50).selectExpr("xxhash64(id) AS fp"), "prints")
    plan = simhash.links(prints)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    docs = spark.createDataFrame([(i, f"text {i % 3}") for i in range(9)], "doc_id bigint, text string")
    got = simhash.near_duplicates(docs)
    assert got.count() == 9 and "BuildLeft" not in got._jdf.queryExecution().executedPlan().toString()


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(8, 40)] + [(r.randrange(200, 400), r.randrange(200, 400)) for _ in range(120)] + [(5, 5)]
    got = {x.node: x.root for x in common.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    root = {x: x for e in edges for x in e if e[0] != e[1]}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a != b and root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    assert got == root
    assert common.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_query(spark, sf):
    got = sorted((tuple(r) for r in simhash.op9_simhash(spark, sf).collect()), key=str)
    assert got == brute_components([(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])


def test_rows_of_all_kinds(spark, tmp_path):
    long = " ".join(f"word{k}" for k in range(3000))
    rows = [(1, None), (2, ""), (3, " \n"), (None, "lone words here now"), (4, "A b"), (5, "a  B"), (6, long), (7, long + " end"), (7, long), (7, long), (8, "é É")]
    spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id bigint, text string, fp int, component_id string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted((tuple(r) for r in simhash.op9_simhash(spark, str(tmp_path)).collect()), key=str) == brute_components(rows)
    spark.createDataFrame([], "doc_id bigint, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert simhash.op9_simhash(spark, f"{tmp_path}/none").count() == 0

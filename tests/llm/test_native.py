"""URL filter and decontamination: brute force, SQL and rows of all kinds."""

import math
import random
from collections import Counter, defaultdict

import duckdb

from lakeloom.llm import decontam, queries, url_filter


def same_as_sql(spark, sf, name, tables):
    got = queries.QUERIES[name](spark, sf)
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet{'' if sf.startswith('/root') else '/*.parquet'}')")
    want = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(map(str, got.select(names).collect())) == sorted(str(r) for r in spark.createDataFrame(want.fetchall() or [], got.select(names).schema).collect())
    return got


def brute_models(urls, rules):
    def split(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        h = next((rest[:k] for k, c in enumerate(rest) if c in "/?#"), rest)
        p = rest[len(h) :]
        p = next((p[:k] for k, c in enumerate(p) if c in "?#"), p)
        low = "".join(c.lower() if c.isascii() else c for c in h)
        return low, p, low + rest[len(h) :]

    def hit(h, p):
        best = None
        for r in rules:
            v, body = r.split(" ")
            name, _, start = body.partition("/")
            if (h == name or h.endswith("." + name)) and p.startswith("/" + start) and (best is None or len(body) > len(best[1])):
                best = (v, body)
        return best or (None, None)

    rows = [(*split(u), *hit(*split(u)[:2])) for u in urls]
    grams = lambda s: [("\2" * 4 + s + "\3")[i : i + 5] for i in range(len(s) + 1)]
    counts = {v: defaultdict(Counter) for v in ("allow", "block")}
    for h, p, s, v, _ in rows:
        if v:
            for g in grams(s):
                for k in range(5):
                    counts[v][g[4 - k : 4]][g[-1]] += 1

    def prob(v, g):
        x = 1 / 256
        for k in range(5):
            c = counts[v].get(g[4 - k : 4])
            if c:
                x = (c[g[-1]] + len(c) * x) / (sum(c.values()) + len(c))
        return x

    def score(s):
        r = [round((math.log(prob("allow", g)) - math.log(prob("block", g))) * 1e6) for g in grams(s)]
        return int(math.copysign(abs(sum(r)) // len(r), sum(r)))

    scored = [score(r[2]) for r in rows]
    known = [(max(-2000, min(2000, math.floor(x / 10_000))), r[3]) for x, r in zip(scored, rows, strict=True) if r[3]]
    best = max(sorted({b for b, _ in known}), key=lambda t: (sum(b >= t and v == "allow" for b, v in known) * sum(v == "block" for _, v in known) + sum(b < t and v == "block" for b, v in known) * sum(v == "allow" for _, v in known), -t)) * 10_000
    return [(r[0], r[1], r[4], r[3] or ("allow" if x >= best else "block")) for x, r in zip(scored, rows, strict=True)]


def test_url_filter_equals_brute_force(spark, sf):
    urls = [r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()][:60]
    urls += [None, "", "nothing", "http://", "HTTP://A.ORG", "http://a.org?x", "http://A.Example.ORG/es/1", "http://example.org/es/", "x://y://b.com/de/", "http://é.com/fr/ü", "http://a.org/", "http://notorg/", "http://a.com/de", urls[0], urls[0]]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").selectExpr("*", "'x' AS host", "1 AS score")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judged(df).collect()}
    assert [got[k] for k in range(len(urls))] == brute_models(urls, url_filter.RULES)


def test_url_filter_without_rules_or_rows(spark):
    df = spark.createDataFrame([(1, "http://a.b/c"), (2, None)], "page_id bigint, url string")
    assert {r.verdict for r in url_filter.judged(df, ()).collect()} == {"allow"}
    assert url_filter.judged(df.limit(0)).count() == 0


def test_url_filter_sql(spark, sf):
    assert same_as_sql(spark, sf, "op5_url_filter", ["pages"]).filter("verdict = 'block'").count()


def brute_leaks(docs, items):
    cut = lambda t: [w for w in "".join(c if c not in " \t\n\x0b\x0c\r" else " " for c in (t or "").lower()).split(" ") if w]
    sh = lambda t: {tuple(w[i : i + 5]) for w in [cut(t)] for i in range(len(w) - 4)}
    out = {}
    for d, t in docs:
        s = sh(t)
        for i, x in items:
            if (n := len(y := sh(x))) and 10 * len(y & s) >= 8 * n:
                out[d, i] = max(out.get((d, i), (0, 0, 0)), (len(y & s) / n, len(y & s), n))
    return {(d, i, a, n) for (d, i), (_, a, n) in out.items()}


def test_leaks_equal_brute_force(spark, monkeypatch):
    r = random.Random(2)
    word = lambda: r.choice(["the", "of", "And", "x", "y", "z", "é", "to"]) + str(r.randint(0, 9))
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([4, 5, 6, 8, 9, 12, 20, 40, 60, 100])] + [(20, None), (21, ""), (None, " ".join(word() for _ in range(9))), (9, "other words stand here now too")]
    docs = [(99, None), (100, ""), (None, items[6][1])]
    for k in range(60):
        w = (r.choice(items)[1] or "").split()
        for _ in range(r.randint(0, 3)):
            if w:
                w[r.randrange(len(w))] = word()
        docs.append((k, " ".join([word() for _ in range(r.randint(0, 300))] + w) + "\n" + "\t".join(word() for _ in range(20))))
    docs += [docs[10], docs[10], (5, items[7][1].upper())]
    dd = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 AS item_id", "2 AS w")
    ii = spark.createDataFrame(items, "item_id bigint, text string")
    want = brute_leaks(docs, items)
    assert len(want) > 15
    assert {tuple(x) for x in decontam.contained(dd, ii).collect()} == want
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", 0)
    assert {tuple(x) for x in decontam.contained(dd, ii).collect()} == want


def test_leak_in_a_very_long_document_and_rows_of_one_id(spark):
    item = " ".join(f"i{k}" for k in range(30))
    long = " ".join(f"w{k % 9973}" for k in range(200_000))
    docs = spark.createDataFrame([(1, f"{long} {item} {long}"), (2, long), (None, item), (None, "clean text of no id at all"), (3, item), (3, "another text of the same id")], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, item)], "item_id bigint, text string")
    assert sorted(((r.doc_id, r.item_id) for r in decontam.contained(docs, items).collect()), key=str) == [(1, 7), (3, 7), (None, 7)]
    leaks = decontam.contained(docs, items, by_text=True)
    assert leaks.count() == 3 and leaks.columns == ["doc_id", "copy", "item_id", "n_shared", "n_shingles"]


def test_urls_of_any_length(spark):
    urls = ["http://a.org/" + "x/é😀y" * 40_000, "http://b.com/de/" + "q" * 200_000, "http://c.net/" + "q1" * 100_000]
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judged(spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")).collect()}
    assert got == {0: ("org/", "allow"), 1: ("com/de/", "block"), 2: (None, "block")}


def test_leaks_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id bigint, text string")
    assert decontam.contained(none, items).count() == 0
    assert decontam.contained(items.withColumnRenamed("item_id", "doc_id"), items.limit(0)).count() == 0


def test_leaks_sql(spark, sf):
    same_as_sql(spark, sf, "op6_decontamination", ["documents", "benchmark"])

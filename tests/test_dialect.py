"""The dialect: tokens, rewrites and meaning, without tables."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lakeloom.functions import agg, fn
from lakeloom.functions.stem import stem
from lakeloom.plans.dialect import Rewriter, similar
from lakeloom.plans.runner import run
from lakeloom.plans.tokens import DialectError, lex, parse
from lakeloom.sources import lake


def one(spark, sql):
    return [tuple(r) for r in run(spark, "/nowhere", sql).collect()]


@pytest.mark.parametrize(
    ("sql", "want"),
    [
        ("SELECT 10 / 2 AS q", [(5,)]),
        ("SELECT 7 / 2 * 2.0 AS q", [(6.0,)]),
        ("SELECT 'a''b\\n' AS s", [("a'b\\n",)]),
        ("SELECT '-- no comment' /* gone */ AS s -- gone\n", [("-- no comment",)]),
        ("SELECT n FROM (VALUES (1), (NULL), (2)) AS t(n) ORDER BY n", [(1,), (2,), (None,)]),
        ("SELECT n FROM (VALUES (1), (NULL), (2)) AS t(n) ORDER BY n DESC LIMIT 2", [(None,), (2,)]),
        ("WITH t AS (SELECT 1 AS n UNION ALL SELECT 2 UNION ALL SELECT 3) SELECT n FROM t QUALIFY row_number() OVER (ORDER BY n DESC) = 1", [(3,)]),
        ("SELECT x FROM (VALUES (3), (1), (3), (2)) AS t(x) ORDER BY x DESC FETCH FIRST 1 ROW WITH TIES", [(3,), (3,)]),
        ("SELECT sum(x) AS s FROM (VALUES (1)) AS t(x) WHERE x > 5 GROUP BY GROUPING SETS ((x), ())", [(None,)]),
        ("SELECT array_agg(x ORDER BY x) AS a FROM (VALUES (2), (NULL), (1)) AS t(x)", [([1, 2, None],)]),
        ("SELECT count(*) AS n FROM (VALUES (1)) AS t(x) WHERE x > ALL (SELECT 5 WHERE 1 = 0)", [(1,)]),
        ("SELECT 3 > ANY (SELECT NULL) IS NULL AS a, 3 = ALL (SELECT 3) AS b, 3 <> ANY (SELECT 3) AS c", [(True, True, False)]),
        ("SELECT CAST('x' AS VARCHAR(10)) || CAST(1 AS TEXT) AS s, TRY_CAST('q' AS INT) AS n", [("x1", None)]),
        ("SELECT [1, 2, 3][2] AS a, [1][5] AS b, cardinality([1, NULL]) AS c", [(2, None, 2)]),
        ("SELECT 'a.c' SIMILAR TO 'a.c' AS a, 'abc' SIMILAR TO 'a.c' AS b, 'abc' NOT SIMILAR TO '%z' AS c", [(True, False, True)]),
        ("SELECT concat('a', NULL, 1) AS a, url_encode('a b*~') AS b, mod(5, 0) AS c, sequence(5, 1) AS d, bitwise_left_shift(1, 70) AS e", [("a1", "a%20b%2A~", None, [], 0)]),
        ("SELECT date_diff('hour', TIMESTAMP '2020-01-01 10:00:00', TIMESTAMP '2020-01-02 09:00:00') AS h", [(24,)]),
        ("SELECT regexp_extract('abc', 'z') AS a, regexp_extract('k=v', 'k=(.)') AS b, regexp_replace('aaa', 'a', 'b') AS c, regexp_replace('aaa', 'a', 'b', 'g') AS d", [(None, "v", "baa", "bbb")]),
        ('SELECT "Odd name" FROM (SELECT 1 AS "Odd name") AS t', [(1,)]),
    ],
)
def test_meaning(spark, sql, want):
    assert one(spark, sql) == want


def test_errors():
    for bad in ("SELECT (1", "SELECT 1)", "SELECT * FROM t FOR VERSION AS OF 3", "SELECT x FROM t FETCH FIRST 2 ROWS WITH TIES", "SELECT " + "(" * 500 + "1" + ")" * 500, "SELECT € FROM t"):
        with pytest.raises(DialectError):
            Rewriter().sql(bad)
    with pytest.raises(ValueError):
        Rewriter().sql("SELECT date_add('week', 1, d) FROM t")


def test_radix_and_hamming_errors(spark):
    for bad in ("SELECT to_base(5, 40) AS x", "SELECT hamming_distance('a', 'bc') AS x"):
        with pytest.raises(Exception, match="radix|length"):
            one(spark, bad)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text_is_read_or_refused(text):
    try:
        parse(text)
    except DialectError:
        pass


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abc'%_-/*; \n\"", max_size=30))
def test_literals_are_untouched(text):
    sql = "SELECT '" + text.replace("'", "''") + "' AS s"
    assert [t.text for t in lex(sql) if t.kind == "string"] == ["'" + text.replace("'", "''") + "'"]


def test_similar_patterns():
    import re

    assert re.match(similar("a%b_"), "axxbz") and not re.match(similar("a%b_"), "axxb") and re.match(similar("(x|y)+"), "xyx")


def test_stems():
    assert [stem(w) for w in ("running", "ponies", "caresses", "hopping", "relational", "conditional", "happy", "sky", "agreed", "adjustment", "rate", "controll")] == ["run", "poni", "caress", "hop", "relat", "condit", "happi", "sky", "agre", "adjust", "rate", "control"]


def test_functions_for_dataframes(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (2, "b")], "k int, v string")
    assert df.select(fn("concat", "v", "'-'").alias("x")).collect()[1].x == "-"
    got = {r.k: r.a for r in df.groupBy("k").agg(agg("array_agg", "v", order_by=["v DESC"]).alias("a")).collect()}
    assert got == {1: [None, "a"], 2: ["b"]}


def test_pruning_conditions():
    plain = lambda c: [(n, op, v.text) for n, op, v in c]
    assert plain(lake.conditions("a >= 3 AND b = 'x' AND f(c) > 1 AND (d < -2 AND e = DATE '2024-01-01')")) == [("a", ">=", "3"), ("b", "=", "'x'"), ("d", "<", "-2"), ("e", "=", "'2024-01-01'")]
    assert lake.conditions("a = 1 OR b = 2") == [] and lake.conditions("NOT a = 1") == []
    assert plain(lake.conditions("t.a = 1 AND s.b = 2 AND c = 3", "t")) == [("a", "=", "1"), ("c", "=", "3")]


DAY = 86_400_000_000


@pytest.mark.parametrize(
    ("kind", "low", "high", "yes", "no"),
    [
        ("long", "9007199254740993", "9007199254740995", ["x = 9007199254740994", "x > 9007199254740994", "x <= 9007199254740993", "x = '9007199254740993'", "x = 9007199254740992e0"], ["x = 9007199254740992", "x < 9007199254740993", "x > 9007199254740995", "x > 9007199254740995.5"]),
        ("double", "1.0", "NaN", ["x = 7", "x > 1e300", "x >= 1", "x < 2"], ["x < 1", "x = 0.5", "x <= -3"]),
        ("double", "NaN", "NaN", ["x = 1", "x < 1", "x > 1"], []),
        ("timestamp_ntz", str(19723 * DAY), str(19723 * DAY), ["x <= '2024-01-01'", "x = '2024-1-1'", "x >= '2024-01-01 00:00:00'", "x = TIMESTAMP '2024-01-01 00:00:00.000000'", "x > 'now'", "x < '2024-01-01T00:00:00Z'"], ["x < '2024-01-01'", "x > '2024-01-01'", "x = '2024-01-01 00:00:00.000001'", "x >= DATE '2024-01-02'"]),
        ("timestamp", str(19723 * DAY), str(19723 * DAY), ["x > '2024-01-01 14:00:00'", "x < '2023-12-31 12:00:00'"], ["x > '2024-01-04'", "x = '2023-12-25'"]),
        ("date", str(19723 * DAY), str(19723 * DAY), ["x = '2024-1-1'", "x <= '2024-01-01'", "x > TIMESTAMP '2023-12-31 12:00:00'"], ["x > '2024-01-01'", "x < '2024-01-01'"]),
        ("string", "k", "p", ["x = 'm'", "x <= 'k'", "x = 5", r"x = 'a\\b'"], ["x < 'k'", "x > 'p'", "x = 'é'"]),
        ("decimal(30,2)", "10.10", "20.20", ["x = 10.10", "x > 20.19", "x = 1e5"], ["x > 20.20", "x < 10.1", "x = 20.21"]),
        ("float", "1.0", "16777216.0", ["x = 16777217", "x > 16777216.5"], ["x < 1"]),
        ("boolean", None, None, ["x = 1", "x = 'true'"], []),
    ],
)
def test_bounds_never_leave_out_a_match(kind, low, high, yes, no):
    entry = {"bounds": {"x_1": [low, high, kind]}}
    for text in yes:
        assert lake.may_match(entry, lake.conditions(text), {"x": ("x_1", kind)}), text
    for text in no:
        assert not lake.may_match(entry, lake.conditions(text), {"x": ("x_1", kind)}), text
    assert lake.may_match({"bounds": {"x_1": [low, high, "other"]}}, lake.conditions((no or yes)[0]), {"x": ("x_1", kind)})


@pytest.mark.parametrize("rest", ["", " WHERE c.k > 1", " ORDER BY c.x"])
def test_histograms_over_whole_partitions_count_before_they_gather(spark, rest):
    """A row carries the distinct values of its partition, not all of its values: those grew with the square of a partition."""
    spark.sql("SELECT * FROM VALUES (1, 0D), (2, NULL), (3, -0D), (5, double('NaN')), (6, 2D), (7, double('NaN')), (9, 2D), (8, 2D) AS t(k, x)").createOrReplaceTempView("counted")
    got = run(spark, "/nowhere", f"SELECT c.k, CAST(histogram(x) OVER (PARTITION BY c.k % 2) AS VARCHAR) AS h FROM counted AS c{rest}")
    assert "collect_list" not in got._jdf.queryExecution().toString()
    odd = "{0.0 -> 2, 2.0 -> 1, NaN -> 2}" if "WHERE" not in rest else "{0.0 -> 1, 2.0 -> 1, NaN -> 2}"
    want = {k: odd if k % 2 else "{2.0 -> 2}" for k in (1, 2, 3, 5, 6, 7, 8, 9) if "WHERE" not in rest or k > 1}
    assert {r.k: r.h.replace("-0.0", "0.0") for r in got.collect()} == want
    star = run(spark, "/nowhere", "SELECT *, histogram(x) OVER () AS h FROM counted")
    assert star.columns == ["k", "x", "h"] and {tuple(sorted(r.h.values())) for r in star.collect()} == {(2, 2, 3)}
    assert run(spark, "/nowhere", "SELECT a.k, histogram(b.x) OVER () AS h FROM counted AS a JOIN counted AS b ON a.k = b.k").count() == 8

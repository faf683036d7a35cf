"""URL filters: rules first, then a character language-model ratio.

Two variable-order Markov models, of the URLs that rules accept and of those
they reject, give each character a probability from contexts of 0 to 4
characters by Witten-Bell smoothing: where a context was not seen, the
shorter one decides.  A URL that no rule fits is judged by the difference of
its log-likelihoods per character, against a threshold calibrated on the
URLs that rules decide.

DataFrame operations only.  Log ratios are kept in millionths as integers, so
sums do not depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.llm import common

RULES = ("allow org/", "block example.org/es/", "block example.org/en/1", "allow com/fr/", "block com/de/")
#: Longest context, symbols that a model allows for, and bytes of distinct grams up to which their ratios are broadcast.
ORDER, SYMBOLS, BROADCAST_BYTES = 4, 256, 64 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column, Column]:
    """Host (A-Z lower-cased), path, and all that follows the scheme; empty for null or without ``://``."""
    at = F.instr(F.coalesce(url, F.lit("")), "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, "(?s)^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, "(?s)^[^/?#]*([^?#]*)", 1), rest


def rule_of(host: Column, path: Column, rules: tuple[str, ...]) -> Column:
    """The longest rule that fits, as ``allow x`` or ``block x``; else null.  Rules are tried longest first."""
    out = F.lit(None).cast("string")
    for rule in sorted(dict.fromkeys(rules), key=lambda r: len(r.split(" ", 1)[1])):
        name, _, start = rule.split(" ", 1)[1].partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + start))
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _grams(texts: DataFrame) -> DataFrame:
    """url, hit, n, gram: every character and the end, each with the four before it; linear in the text, which is taken apart once and not repeated."""
    padded = F.concat(F.lit("\x02" * ORDER), F.col("seen"), F.lit("\x03"))
    chars = F.regexp_extract_all(padded, F.lit("(?s)."), F.lit(0))
    shifted = F.arrays_zip(*[F.slice(chars, j + 1, F.length("seen") + 1) for j in range(ORDER + 1)])  # not by place: that would take the text apart again for each
    each = F.transform(shifted, lambda z: F.concat(*[z[str(j)] for j in range(ORDER + 1)]))
    return texts.select("url", "hit", "n", F.explode(each).alias("gram"))


def _ratios(grams: DataFrame, counts: DataFrame) -> DataFrame:
    """gram, r: log P(last character | those before) accepted less rejected, in millionths, of every distinct gram.

    From short grams to long ones: those of one order are summed up before
    they meet their context, so a context that all URLs share has a row for
    each symbol, not for each gram.
    """
    known = common.written(grams.select("gram").distinct().join(counts, "gram", "left").select("gram", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("good", "bad")]), "grams")
    p = None
    for k in range(ORDER + 1):
        low = known.groupBy(F.expr(f"right(gram, {k + 1})").alias("g")).agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")) if k < ORDER else known.withColumnRenamed("gram", "g")
        context = low.groupBy(F.expr(f"left(g, {k})").alias("c")).agg(*[f(x).cast("double").alias(f"{x}_{n}") for x in ("good", "bad") for n, f in (("n", F.sum), ("t", lambda x: F.sum((F.col(x) > 0).cast("bigint"))))])
        each = low.withColumn("c", F.expr(f"left(g, {k})")).join(context, "c")
        if k:
            each = each.withColumn("s", F.expr(f"right(g, {k})")).join(p, "s")
        else:
            each = each.withColumns({"p_good": F.lit(1.0 / SYMBOLS), "p_bad": F.lit(1.0 / SYMBOLS)})
        smoothed = [F.when(F.col(f"{x}_n") > 0, (F.col(x).cast("double") + F.col(f"{x}_t") * F.col(f"p_{x}")) / (F.col(f"{x}_n") + F.col(f"{x}_t"))).otherwise(F.col(f"p_{x}")).alias(f"p_{x}") for x in ("good", "bad")]
        p = each.select(F.col("g").alias("s"), *smoothed)
    return p.select(F.col("s").alias("gram"), F.round((F.log("p_good") - F.log("p_bad")) * 1e6).cast("bigint").alias("r"))


def judged(pages: DataFrame, rules: tuple[str, ...] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, score: one row per input row.

    rule: the longest that fits, without its verdict, else null.  score: log
    likelihood ratio per character in millionths, null where a rule decides.
    A null url, or one without ``://``, has empty host and path and is judged
    by the models as an empty string.  Repeated rows get equal results.  Work
    is linear in the length of a url.  Null ids stay; extra columns are left out.
    Where rules accept none, or reject none, the threshold is 0.
    """
    host, path, rest = parts(F.col(f"`{url_col}`"))
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), host.alias("host"), path.alias("path"), rest.alias("rest"))
    rows = rows.withColumn("hit", rule_of(F.col("host"), F.col("path"), rules)).withColumn("seen", F.concat("host", F.expr("substring(rest, length(host) + 1)")))
    texts = common.written(rows.groupBy("seen", "hit").agg(F.count("*").alias("n")).withColumn("url", F.monotonically_increasing_id()), "urls")
    good = F.startswith("hit", F.lit("allow"))
    grams = _grams(texts)
    counts = grams.filter("hit is not null").groupBy("gram").agg(F.sum(F.when(good, F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(good, 0).otherwise(F.col("n"))).alias("bad"))
    ratios = common.written(_ratios(grams, counts), "ratios")
    size = ratios.agg(F.sum(F.octet_length("gram") + 24).alias("b")).first()["b"] or 0
    ratios = F.broadcast(ratios) if size <= BROADCAST_BYTES else ratios
    scored = grams.join(ratios, "gram").groupBy("url", "hit", "n").agg(F.expr("sum(r) div count(*)").alias("score"))
    scored = common.written(scored, "scores")
    at = calibrated(scored.filter("hit is not null").select((F.startswith("hit", F.lit("allow"))).alias("good"), "score", "n"))
    verdicts = scored.filter("hit is null").select("url", "score").join(texts.select("url", F.col("seen").alias("s")), "url")
    out = rows.join(verdicts, rows["hit"].isNull() & (rows["seen"] == verdicts["s"]), "left")
    verdict = F.when(F.col("hit").isNotNull(), F.split_part("hit", F.lit(" "), F.lit(1))).when(F.col("score") >= at, "allow").otherwise("block")
    return out.select("page_id", "host", "path", F.expr("substring(hit, 7)").alias("rule"), verdict.alias("verdict"), "score")


def calibrated(scored: DataFrame) -> int:
    """The score, on a grid of hundredths within -20 to 20, that best divides accepted from rejected (balanced accuracy; the least of equals)."""
    from pyspark.sql import Window

    grid = F.least(F.greatest(F.floor(F.col("score") / 10_000), F.lit(-2000)), F.lit(2000)).cast("bigint")
    bins = scored.groupBy(grid.alias("bin")).agg(F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("good"), 0).otherwise(F.col("n"))).alias("b"))
    before = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # at most 4,001 rows
    best = bins.select("bin", F.sum("a").over(Window.partitionBy()).alias("all_a"), F.sum("b").over(Window.partitionBy()).alias("all_b"), F.coalesce(F.sum("a").over(before), F.lit(0)).alias("lost"), F.coalesce(F.sum("b").over(before), F.lit(0)).alias("caught"))
    top = best.filter("all_a > 0 and all_b > 0").withColumn("right", F.expr("(all_a - lost) * cast(all_b as decimal(20,0)) + caught * cast(all_a as decimal(20,0))")).orderBy(F.desc("right"), "bin").first()
    return 0 if top is None else int(top["bin"]) * 10_000


def op5_url_filter(spark, sf_dir: str) -> DataFrame:
    return judged(common.reading(spark, sf_dir, "pages"))


ORACLE = r"""
WITH p AS (
  SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, rest, translate(regexp_extract(rest, '^([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') AS path FROM p),
rules(rule, verdict) AS (VALUES ('org/', 'allow'), ('example.org/es/', 'block'), ('example.org/en/1', 'block'), ('com/fr/', 'allow'), ('com/de/', 'block')),
r AS (SELECT rule, verdict, split_part(rule, '/', 1) AS rh, substr(rule, instr(rule, '/')) AS rp FROM rules),
h AS (SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS v
  FROM (SELECT DISTINCT host, path FROM q) JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY host, path),
u AS (SELECT page_id, q.host, q.path, rule, v, q.host || substr(rest, length(q.host) + 1) AS seen FROM q LEFT JOIN h ON q.host = h.host AND q.path = h.path),
g AS (SELECT page_id, v, substr(repeat(chr(2), 4) || seen || chr(3), i, 5) AS gram FROM (SELECT page_id, v, seen, unnest(range(1, length(seen) + 2)) AS i FROM u)),
c5 AS (SELECT gram, count(*) FILTER (v = 'allow') AS a, count(*) FILTER (v = 'block') AS b FROM g WHERE v IS NOT NULL GROUP BY gram),
low AS (SELECT k, right(gram, k + 1) AS g, sum(a) AS a, sum(b) AS b FROM c5, range(5) t(k) GROUP BY ALL),
ctx AS (SELECT k, left(g, k) AS c, sum(a) AS an, sum(b) AS bn, count(*) FILTER (a > 0) AS at_, count(*) FILTER (b > 0) AS bt FROM low GROUP BY ALL),
asked AS (SELECT gram, k, right(gram, k + 1) AS g FROM (SELECT DISTINCT gram FROM g), range(5) t(k)),
e AS (SELECT gram, asked.k, coalesce(a, 0)::DOUBLE AS a, coalesce(b, 0)::DOUBLE AS b, coalesce(an, 0)::DOUBLE AS an, coalesce(bn, 0)::DOUBLE AS bn, coalesce(at_, 0)::DOUBLE AS at_, coalesce(bt, 0)::DOUBLE AS bt
  FROM asked LEFT JOIN low ON asked.k = low.k AND asked.g = low.g LEFT JOIN ctx ON asked.k = ctx.k AND left(asked.g, asked.k) = ctx.c),
f AS (SELECT gram, list_reduce(list_prepend({'x': 0.0::DOUBLE, 'p': 1.0/256, 'n': 0.0::DOUBLE, 't': 0.0::DOUBLE}, list({'x': a, 'p': 0.0::DOUBLE, 'n': an, 't': at_} ORDER BY k)),
    lambda s, o: {'x': 0.0::DOUBLE, 'p': CASE WHEN o.n > 0 THEN (o.x + o.t * s.p) / (o.n + o.t) ELSE s.p END, 'n': 0.0::DOUBLE, 't': 0.0::DOUBLE}).p AS pa,
  list_reduce(list_prepend({'x': 0.0::DOUBLE, 'p': 1.0/256, 'n': 0.0::DOUBLE, 't': 0.0::DOUBLE}, list({'x': b, 'p': 0.0::DOUBLE, 'n': bn, 't': bt} ORDER BY k)),
    lambda s, o: {'x': 0.0::DOUBLE, 'p': CASE WHEN o.n > 0 THEN (o.x + o.t * s.p) / (o.n + o.t) ELSE s.p END, 'n': 0.0::DOUBLE, 't': 0.0::DOUBLE}).p AS pb
  FROM e GROUP BY gram),
s AS (SELECT page_id, CAST(trunc(sum(CAST(round((ln(pa) - ln(pb)) * 1e6) AS BIGINT)) // count(*)) AS BIGINT) AS fl, sum(CAST(round((ln(pa) - ln(pb)) * 1e6) AS BIGINT)) AS sm, count(*) AS n FROM g JOIN f USING (gram) GROUP BY page_id),
sc AS (SELECT page_id, CAST(sign(sm) * (abs(sm) // n) AS BIGINT) AS score FROM s),
bins AS (SELECT greatest(least(CAST(floor(score / 10000.0) AS BIGINT), 2000), -2000) AS bin, count(*) FILTER (v = 'allow') AS a, count(*) FILTER (v = 'block') AS b FROM sc JOIN u USING (page_id) WHERE v IS NOT NULL GROUP BY 1),
w AS (SELECT bin, sum(a) OVER () AS aa, sum(b) OVER () AS bb, coalesce(sum(a) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lost,
  coalesce(sum(b) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caught FROM bins),
thr AS (SELECT coalesce((SELECT bin * 10000 FROM w WHERE aa > 0 AND bb > 0 ORDER BY (aa - lost) * bb + caught * aa DESC, bin LIMIT 1), 0) AS at_)
SELECT page_id, host, path, rule, CASE WHEN v IS NOT NULL THEN v WHEN score >= at_ THEN 'allow' ELSE 'block' END AS verdict,
  CASE WHEN v IS NULL THEN score END AS score
FROM u JOIN sc USING (page_id), thr
"""

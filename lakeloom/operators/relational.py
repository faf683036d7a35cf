"""DataFrame operators that SQL text alone does not give: ties, peers, as-of and range joins, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_ties(df: DataFrame, column: str, n: int, descending: bool = False) -> DataFrame:
    """The first n rows by a column and all that tie with the last; NULLs come last (first if descending).

    A top-k gives the last key; one filter then finds the ties.  No global
    window, so no single task sees all rows.
    """
    order = F.desc_nulls_first(column) if descending else F.asc_nulls_last(column)
    top = [r[0] for r in df.select(column).orderBy(order).limit(n).collect()] if n > 0 else []
    if not top:
        return df.limit(0)
    c, last = F.col(column), top[-1]
    if last is None:
        return df.filter(c.isNull()) if descending else df
    return df.filter((c >= F.lit(last)) | c.isNull()) if descending else df.filter(c <= F.lit(last))


def groups_frame(df: DataFrame, value: Column, partition: list[str], order: list[Column], start: int, end: int, name: str) -> DataFrame:
    """An aggregate over a GROUPS frame: peers get a dense rank, and the rank a RANGE frame."""
    ranked = df.withColumn("__peer", F.dense_rank().over(Window.partitionBy(*partition).orderBy(*order)))
    return ranked.withColumn(name, value.over(Window.partitionBy(*partition).orderBy("__peer").rangeBetween(start, end))).drop("__peer")


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """For each left row, the values of the latest right row of its key at or before its time (NULLs without one).

    One union, one shuffle by key, one sorted pass; no join of pairs.  A NULL
    key equals no other.
    """
    right = right.dropna(subset=by)
    l_rows = left.select(*[F.col(c) for c in by], F.col(left_time).alias("__t"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__row"), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("__v"))
    r_rows = right.select(*[F.col(c) for c in by], F.col(right_time).alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(l_rows.schema["__row"].dataType).alias("__row"), F.struct(*values).alias("__v"))
    w = Window.partitionBy(*by).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = l_rows.unionByName(r_rows).withColumn("__v", F.last("__v", ignorenulls=True).over(w)).filter("__side = 1")
    return out.select("__row.*", *[F.col(f"__v.{v}").alias(f"{v}_asof" if v in left.columns else v) for v in values])


#: Pairs of a point and a range of its bin that a task of a range join compares, about.
PAIRS = 20_000_000


def range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: float, on: list[str] | None = None) -> DataFrame:
    """Points inside [low, high] of ranges, by bins of ``width``: an equi-join on bins instead of a nested loop.

    A range is copied to each bin it touches, so choose a width near the usual
    range; points are never copied.  Bins with more than PAIRS pairs are dealt
    to several tasks: points by their content, ranges to all of these.  Copies
    are never broadcast.  Pairs are counted first, by bins.
    """
    bins = lambda c: F.floor(F.col(c).cast("double") / width)
    p = points.withColumn("__bin", bins(point))
    r = ranges.withColumn("__bin", F.explode(F.sequence(bins(low), bins(high))))
    keys = [*(on or []), "__bin"]
    inside = (F.col(point) >= F.col(low)) & (F.col(point) <= F.col(high))
    pairs = p.groupBy(*keys).agg(F.count("*").cast("double").alias("__p")).join(r.groupBy(*keys).agg(F.count("*").cast("double").alias("__r")), keys).withColumn("__salts", F.ceil(F.col("__p") * F.col("__r") / PAIRS))
    parts = pairs.agg(F.sum("__salts"), F.max("__salts")).first()
    if (parts[1] or 1) == 1:
        return p.join(r.hint("merge"), keys).filter(inside).drop("__bin")
    large = pairs.filter("__salts > 1").select(*keys, "__salts")  # few: each has more than PAIRS pairs
    salts = F.coalesce(F.col("__salts"), F.lit(1))
    p = p.join(large, keys, "left").withColumn("__salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in points.columns]), salts)).drop("__salts")
    r = r.join(large, keys, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1))).drop("__salts")
    keys = [*keys, "__salt"]
    n = min(2 * int(parts[0]), 20_000)  # given, as Spark would put together what has few bytes, however many pairs it makes
    return p.repartition(n, *keys).join(r.repartition(n, *keys).hint("merge"), keys).filter(inside).drop("__bin", "__salt")


def histogram(df: DataFrame, by: list[str], column: str, name: str = "histogram") -> DataFrame:
    """MAP of value to count per group, in two levels: values are counted before they are gathered."""
    counted = df.filter(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("__n"))
    return counted.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(column), F.col("__n"))))).alias(name))


def salted_join(left: DataFrame, right: DataFrame, on: list[str], salts: int = 16, how: str = "inner") -> DataFrame:
    """An equi-join whose hot keys are spread: left rows get a salt from their content, right rows are copied to all salts.

    Only for joins that give each copy of a right row no row of its own: inner, left, semi and anti.  The copies are
    never broadcast: Spark takes them for no larger than the rows they are made from.
    """
    if how.replace("_", "").removesuffix("outer") not in ("inner", "left", "semi", "leftsemi", "anti", "leftanti"):
        raise ValueError(f"a salted join cannot be {how}: right rows are copied")
    l_rows = left.withColumn("__salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)))
    r_rows = right.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    return l_rows.join(r_rows.hint("merge"), [*on, "__salt"], how).drop("__salt")

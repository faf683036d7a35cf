"""The function library: ``fn`` for DataFrames, macros for SQL text, and the few Python functions Spark has no expression for."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from lakeloom.functions import macros


def fn(name: str, *args: str) -> Column:
    """A function of the library over SQL texts: ``fn("date_diff", "'day'", "a", "b")``."""
    return F.expr(macros.apply(name, list(args)))


def agg(name: str, *args: str, distinct: bool = False, order_by: list[str] | None = None, where: str = "") -> Column:
    """An aggregate of the library: ``agg("array_agg", "x", order_by=["k DESC"])``."""
    keys = [(k.split()[0], [w.upper() for w in k.split()[1:]]) for k in order_by or []]
    return F.expr(macros.aggregate(name, list(args), distinct, keys, where, ""))


def register(spark: SparkSession) -> None:
    """Registers the Arrow-batched functions, once a session: Unicode normal forms, BLAKE2, HMAC and stems."""
    from lakeloom.functions.vectorized import FUNCTIONS

    if spark.catalog.functionExists("lakeloom_word_stem"):
        return
    for name, (f, kind) in FUNCTIONS.items():
        spark.udf.register(f"lakeloom_{name}", F.pandas_udf(f, kind))

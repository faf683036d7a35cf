"""Layout of rows on disk: Z-order keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def zorder_key(df: DataFrame, columns: list[str], bits: int = 8) -> Column:
    """A Morton key: bits of the columns' approximate ranks, interleaved.

    Ranks come from quantiles over the table, so skewed columns spread well.
    There are at most 8 bits for a column, and fewer where all columns together
    would have more than 63.
    """
    if not columns or not 1 <= bits <= 8:
        raise ValueError("a Z-order needs a column, and 1 to 8 bits for each")
    bits = max(1, min(bits, 63 // len(columns)))
    numeric = df.select(*[_number(df, c).alias(f"c{k}") for k, c in enumerate(columns)])
    steps = 1 << bits
    cuts = numeric.agg(*[F.percentile_approx(f"c{k}", [i / steps for i in range(1, steps)], 10_000).alias(f"c{k}") for k in range(len(columns))]).first()
    out = F.lit(0).cast("bigint")
    ranks = [_rank(_number(df, c), cuts[k]) for k, c in enumerate(columns)]
    for bit in range(bits):
        for k, r in enumerate(ranks):
            out = out + F.shiftleft(F.shiftright(r, bit).bitwiseAND(F.lit(1)).cast("bigint"), bit * len(columns) + k)
    return out


def _rank(value: Column, cuts: list[float] | None) -> Column:
    """How many cuts are at or below the value."""
    if not cuts:
        return F.lit(0)
    return F.coalesce(F.size(F.filter(F.array(*[F.lit(float(v)) for v in dict.fromkeys(cuts)]), lambda v: v <= value)), F.lit(0))


def _number(df: DataFrame, name: str) -> Column:
    kind = dict(df.dtypes)[name]
    if kind == "string":
        return F.conv(F.hex(F.substring(F.col(name), 1, 6)), 16, 10).cast("double")
    return F.unix_micros(F.col(name).cast("timestamp")).cast("double") if kind.startswith(("date", "timestamp")) else F.col(name).cast("double")

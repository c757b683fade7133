"""As-of and interval joins: by carrying forward along an order, and by buckets of the order.  Rows meet, never pairs of groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prefix_scan import WIDTH, running

c = F.col
#: Microseconds.
HOUR = 3_600_000_000


def as_of(left: DataFrame, right: DataFrame, by: list[str], left_at: str, right_at: str, values: list[str], strict: bool = False, width: int | None = None, levels: int = 2) -> DataFrame:
    """left with `values` of the last right row of equal `by` at or before left_at (strict: before it); null if there is none.

    Of right rows at one place the largest by `values` counts.  Both sides become one sequence and the last right row
    is carried forward in blocks (prefix_scan), so a key with very many rows on either side is split.  Places are whole
    numbers or timestamps; a null place finds nothing, a null key only its like.  width: of a block, in whole numbers or
    microseconds (an hour, if it is not given).
    """
    timed = dict(left.dtypes)[left_at].startswith(("timestamp", "date"))
    width = width or (HOUR if timed else WIDTH)
    place = lambda df, at: F.unix_micros(c(at).cast("timestamp")) if timed else c(at).cast("long")
    own = right.groupBy(*by, place(right, right_at).alias("__at")).agg(F.max(F.struct(*values)).alias("__right")).filter("__at is not null")
    kind = own.select(c("__right").alias("__r")).schema["__r"].dataType
    # At one place a right row stands before left rows, or behind them if strict.
    rows = left.withColumns({"__at": place(left, left_at), "__side": F.lit(1), "__right": F.lit(None).cast(kind)})
    rows = rows.unionByName(own.withColumn("__side", F.lit(2 if strict else 0)), allowMissingColumns=True)
    seen = running(rows, by, ["__at", "__side"], lasts={"__right": c("__right")}, width=width, levels=levels)
    return seen.filter("__side = 1").select(*left.columns, *(c("__right")[v].alias(v) for v in values))


def within(points: DataFrame, intervals: DataFrame, by: list[str], at: str, start: str, end: str, step: int, values: list[str]) -> DataFrame:
    """points with `values` of each interval of equal `by` that holds them (start <= at < end); points in none are left out.

    Places are numbers.  Every interval is dealt to the buckets of `step` that it touches and every point to its own, so
    what meets is close: with step near the usual length an interval lies in two buckets or so.
    """
    bucket = lambda x: F.floor(x / step).cast("long")
    spread = intervals.filter(c(start) < c(end)).select(*by, c(start).alias("__start"), c(end).alias("__end"), *values)
    spread = spread.withColumn("__bucket", F.explode(F.sequence(bucket(c("__start")), bucket(c("__end")))))
    return points.withColumn("__bucket", bucket(c(at))).join(spread, [*by, "__bucket"]).filter((c("__start") <= c(at)) & (c(at) < c("__end"))).select(*points.columns, *values)


def seconds(column: str) -> Column:
    """A time as seconds, for `within`."""
    return F.unix_micros(c(column).cast("timestamp")) / 1_000_000

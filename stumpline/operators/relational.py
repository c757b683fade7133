"""Small operators over any table: keep-last, filling gaps, ties at the top, samples, paging, set cover."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col


def keep_last(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key by a total order (give enough columns to break ties)."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__place", place).filter(c("__place") == 1).drop("__place")


def fill_gaps(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """existing and those rows of new whose key it lacks (what is there wins)."""
    return existing.unionByName(new.join(existing.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def replace_keys(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """existing without the keys of new, and new."""
    return existing.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def ties_at_top(df: DataFrame, value: str, key: str | None = None) -> DataFrame:
    """All rows that share the largest value (of each key): a maximum and a join, no global sort."""
    if key is None:
        return df.join(df.agg(F.max(value).alias(value)), value, "left_semi")
    return df.join(df.groupBy(key).agg(F.max(value).alias(value)), [key, value], "left_semi")


def top_and_bottom(df: DataFrame, order: list[Column], reverse: list[Column], k: int) -> DataFrame:
    """The first k and the last k rows of an order, each once."""
    return df.orderBy(*order).limit(k).unionByName(df.orderBy(*reverse).limit(k)).distinct()


def top_each(df: DataFrame, key: str, order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key (Spark keeps k rows a task before it shuffles)."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("place", place.cast("long")).filter(c("place") <= k)


def page(df: DataFrame, order: list[Column], number: int, size: int) -> tuple[DataFrame, bool]:
    """Page `number` (from 1) of an order, and whether there are more rows after it."""
    rows = df.orderBy(*order).offset((number - 1) * size).limit(size + 1)
    return rows.limit(size), rows.count() > size


def evenly_spaced(df: DataFrame, group: list[str], order: str, k: int) -> DataFrame:
    """k rows of each group at even distances, first and last among them."""
    w = Window.partitionBy(*group)
    x = df.withColumns({"__i": F.row_number().over(w.orderBy(order)) - 1, "__n": F.count(F.lit(1)).over(w)})
    slot = lambda i: F.floor(i * (k - 1) / F.greatest(c("__n") - 1, F.lit(1)))
    keep = (c("__n") <= k) | (c("__i") == 0) | (slot(c("__i")) > slot(c("__i") - 1))
    return x.filter(keep).drop("__i", "__n")


def union_all(frames: list[DataFrame]) -> DataFrame:
    """UNION ALL BY NAME: what a table lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def share_within(df: DataFrame, group: list[str], by: list[str]) -> DataFrame:
    """Counts of (by, group) and their share, in per cent, of their `by`."""
    n = df.groupBy(*by, *group).agg(F.count(F.lit(1)).alias("n"))
    # Totals are joined, not taken over a window: one value of `by` may have very many rows.
    whole = df.groupBy(*(c(k).alias(f"__{k}") for k in by)).agg(F.count(F.lit(1)).alias("__n"))
    same = [c(k).eqNullSafe(c(f"__{k}")) for k in by]
    return n.join(whole, reduce(lambda a, b: a & b, same)).withColumn("pct", F.lit(100.0) * c("n") / c("__n")).drop("__n", *(f"__{k}" for k in by))


def set_cover(sets: DataFrame, name: str, member: str, weight: Column | None = None, most: int = 100) -> list[tuple]:
    """Greedy weighted cover: again and again the set with the largest weight of members not yet covered.

    One aggregation for each set chosen (most at most); only the chosen name reaches the driver.  Ties: smaller name.
    """
    left = sets.select(name, member, (weight if weight is not None else F.lit(1)).alias("__w")).distinct().persist()
    chosen: list[tuple] = []
    try:
        covered = None
        while len(chosen) < most:
            open_ = left if covered is None else left.join(covered, member, "left_anti")
            best = open_.groupBy(name).agg(F.sum("__w").alias("gain")).orderBy(c("gain").desc(), name).first()
            if best is None:
                break
            chosen.append((best[0], best[1]))
            covered = left.filter(c(name).isin(*(x for x, _ in chosen))).select(member).distinct()
    finally:
        left.unpersist()
    return chosen


def search(df: DataFrame, columns: list[str], words: str) -> DataFrame:
    """Rows whose columns together hold every word of the search, upper and lower case alike."""
    from ..functions.columns import all_words_in

    return df.filter(all_words_in(F.concat_ws(" ", *(c(x).cast("string") for x in columns)), words))


def bag_differences(ours: DataFrame, reference: DataFrame, columns: list[str]) -> DataFrame:
    """columns, side (extra in ours, missing from it, shared), n: two bags of rows compared with their numbers, nulls alike."""
    a, b = ours.select(*columns), reference.select(*columns)
    sides = (("extra", a.exceptAll(b)), ("missing", b.exceptAll(a)), ("shared", a.intersectAll(b)))
    return union_all([df.withColumn("side", F.lit(name)) for name, df in sides]).groupBy(*columns, "side").agg(F.count(F.lit(1)).alias("n"))


def top_per_row(left: DataFrame, right: DataFrame, left_key: str, right_key: str, order: list[Column], k: int, columns: list[str]) -> DataFrame:
    """left with `columns` of the first k right rows of its key: a lateral join, which Spark turns into a rank and a hash join."""
    own = right.where(c(right_key) == c("__of").outer()).orderBy(*order).limit(k).select(*columns)
    return left.withColumn("__of", c(left_key)).lateralJoin(own).drop("__of")


def above_mean(df: DataFrame, reference: DataFrame, key: str, value: str) -> DataFrame:
    """Rows whose value is above the mean of their key in reference (df itself, say): a correlated scalar subquery, which becomes a join.

    The key goes by a name of its own outside, as a name that both sides have is taken for the inner one.
    """
    mean = reference.where(c(key) == c("__of").outer()).select(F.avg(value))
    return df.withColumn("__of", c(key)).where(c(value) > mean.scalar()).drop("__of")


def with_any(left: DataFrame, right: DataFrame, left_key: str, right_key: str, test: Column) -> DataFrame:
    """Rows of left with a right row of their key that passes the test: EXISTS, a semi join."""
    return left.withColumn("__of", c(left_key)).where(right.where((c(right_key) == c("__of").outer()) & test).exists()).drop("__of")

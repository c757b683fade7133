"""Comparing sources: rebuilt cards against official ones, irregular overs, commentary alignment, match lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import as_count, count_where, score_text
from .prefix_scan import running

c = F.col


def differences(ours: DataFrame, reference: DataFrame, keys: list[str], values: list[str], outer: bool = True) -> DataFrame:
    """Rows by keys whose values disagree (null-safe), with both values and `status`: differs, missing or extra.

    outer=False looks from the reference only, so that extra rows of ours do not count.
    """
    a = ours.select(*keys, *(c(v).alias(f"{v}_ours") for v in values), F.lit(True).alias("__a"))
    b = reference.select(*keys, *(c(v).alias(f"{v}_ref") for v in values), F.lit(True).alias("__b"))
    x = b.join(a, keys, "full_outer" if outer else "left")
    same = F.lit(True)
    for v in values:
        same &= c(f"{v}_ours").eqNullSafe(c(f"{v}_ref"))
    status = F.when(c("__a").isNull(), "missing").when(c("__b").isNull(), "extra").when(~same, "differs")
    return x.withColumn("status", status).filter(c("status").isNotNull()).drop("__a", "__b")


def reconcile(parts: dict[str, tuple[DataFrame, DataFrame, list[str], list[str]]], match: str, explained: DataFrame | None = None) -> DataFrame:
    """One row per match of the references: number of differences by part, and status exact, explained or unexplained.

    parts: name -> (ours, reference, keys, values); explained: match column of matches whose differences are known.
    """
    every, found = None, None
    for name, (ours, reference, keys, values) in parts.items():
        own = reference.select(match).distinct()
        every = own if every is None else every.union(own)
        diff = differences(ours.join(own, match, "left_semi"), reference, keys, values).groupBy(match).agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit(name))
        found = diff if found is None else found.unionByName(diff)
    counts = found.groupBy(match).agg(*(F.coalesce(F.sum(F.when(c("part") == p, c("n"))), F.lit(0)).alias(p) for p in parts))
    out = every.distinct().join(counts, match, "left").fillna(0, list(parts))
    total = sum((c(p) for p in parts), F.lit(0))
    known = F.lit(False)
    if explained is not None:
        out = out.join(explained.select(match).distinct().withColumn("__known", F.lit(True)), match, "left")
        known = c("__known").isNotNull()
    out = out.withColumn("status", F.when(total == 0, "exact").when(known, "explained").otherwise("unexplained"))
    return out.drop("__known") if explained is not None else out


def irregular_overs(d: DataFrame, legal_balls: int = 6) -> DataFrame:
    """Overs whose number of legal balls is not the usual one."""
    return d.groupBy("match_id", "inning", "over_number").agg(count_where(c("is_legal")).alias("legal")).filter(c("legal") != legal_balls)


def by_occurrence(left: DataFrame, right: DataFrame, group: list[str], label: str, order: str, columns: list[str]) -> DataFrame:
    """left with `columns` of right: in groups of equal length by position, in others by nth occurrence of the label.

    order: column that orders both sides within a group.
    """
    pos, nth = Window.partitionBy(*group).orderBy(order), Window.partitionBy(*group, label).orderBy(order)
    number = lambda df: df.withColumns({"__pos": F.row_number().over(pos), "__nth": F.row_number().over(nth), "__n": F.count(F.lit(1)).over(Window.partitionBy(*group))})
    a, b = number(left), number(right)
    sizes = b.select(*group, c("__n").alias("__m")).distinct()
    a = a.join(sizes, group, "left")
    key = lambda even: F.when(even, F.concat(F.lit("#"), c("__pos").cast("string"))).otherwise(F.concat_ws("#", F.lit("label"), c(label), c("__nth").cast("string")))
    a = a.withColumn("__key", key(c("__n").eqNullSafe(c("__m"))))
    both_sizes = a.select(*group, c("__n").alias("__m")).distinct()
    b = b.join(both_sizes, group, "left").withColumn("__key", key(c("__n").eqNullSafe(c("__m"))))
    found = b.select(*group, "__key", *(c(x).alias(f"right_{x}") for x in columns))
    return a.join(found, [*group, "__key"], "left").drop("__pos", "__nth", "__n", "__m", "__key")


def nearest_day(left: DataFrame, right: DataFrame, keys: list[str], left_day: str, right_day: str, right_id: str, days: int = 1) -> DataFrame:
    """left with the right row of equal keys whose day is nearest, within `days`: the exact day first, then the earlier, then the smaller id.

    The range condition is turned into equality on days: right comes to one row for each key and day, these rows are dealt
    to the days around them, and left meets at most one of them.  So the work grows with the rows, not with their pairs.
    """
    day = c(right_day).cast("date").alias("__day")
    own = right.groupBy(*keys, day).agg(F.min(F.struct(c(right_day).alias("matched_day"), c(right_id).alias("matched_id"))).alias("r"))
    around = F.explode(F.transform(F.sequence(F.lit(-days), F.lit(days)), lambda k: F.struct(F.date_add("__day", k).alias("day"), F.abs(k).alias("gap"))))
    spread = own.select(*keys, "r", around.alias("at"))
    best = F.min(F.struct(c("at.gap").alias("gap"), c("r.matched_day"), c("r.matched_id"))).alias("best")
    found = spread.groupBy(*keys, c("at.day").alias("__day")).agg(best)
    out = left.withColumn("__day", c(left_day).cast("date")).join(found, [*keys, "__day"], "left")
    return out.select(*left.columns, "best.matched_id", "best.matched_day", c("best.gap").alias("gap"))


def running_score(x: DataFrame, group: list[str], order: str, runs: Column, wicket: Column) -> DataFrame:
    """Score so far as text ('57/2'), runs over wickets, for every row of an ordered group."""
    x = running(x, group, [order], sums={"__runs": runs, "__down": as_count(wicket)})
    return x.withColumn("score", score_text(c("__runs"), c("__down"))).drop("__runs", "__down")


def internal_check(d: DataFrame, totals: DataFrame) -> DataFrame:
    """Innings whose balls do not add up to the stated total (totals: match_id, inning, runs)."""
    ours = d.groupBy("match_id", "inning").agg(F.sum("runs_total").alias("runs"), F.sum(c("runs_bat") + c("extras")).alias("parts"))
    x = totals.select("match_id", "inning", c("runs").alias("stated")).join(ours, ["match_id", "inning"], "left")
    return x.filter(~c("runs").eqNullSafe(c("stated")) | ~c("runs").eqNullSafe(c("parts")))

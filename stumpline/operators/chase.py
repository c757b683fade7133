"""Chases over by over: totals, what is still required, and the win probability that a feed brings along."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import as_count, count_where, ratio

c = F.col
INNINGS = ("match_id", "inning")


def targets(totals: DataFrame, stated: Column | None = None) -> DataFrame:
    """match_id, inning, target: from the second innings on the stated target, else one more than the first innings' runs.

    totals: match_id, inning (from 1), runs, and what `stated` reads.
    """
    first = F.max(F.when(c("inning") == 1, c("runs"))).over(Window.partitionBy("match_id")) + 1
    return totals.select(*INNINGS, F.when(c("inning") > 1, first if stated is None else F.coalesce(stated, first)).alias("target"))


def requirements(d: DataFrame, target: DataFrame, balls: int | Column = 120) -> DataFrame:
    """Runs, wickets, totals, rate and balls left after each over, and for a chase the runs and the rate required.

    target: match_id, inning, target and what `balls`, the innings' length in legal balls, reads.  The required rate is null
    once no ball is left.
    """
    o = d.groupBy(*INNINGS, "over_number").agg(F.sum("runs_total").alias("runs"), count_where(c("is_wicket")).alias("wickets"), F.sum(as_count(c("is_legal"))).alias("legal"))
    w = Window.partitionBy(*INNINGS).orderBy("over_number").rowsBetween(Window.unboundedPreceding, 0)
    o = o.withColumns({"total": F.sum("runs").over(w), "down": F.sum("wickets").over(w), "bowled": F.sum("legal").over(w)}).join(target, list(INNINGS), "left")
    length = F.lit(balls) if isinstance(balls, int) else balls
    o = o.withColumn("balls_left", F.greatest(length - c("bowled"), F.lit(0)).cast("long"))
    required = F.when(c("target") > 0, F.greatest(c("target") - c("total"), F.lit(0)))
    return o.select(
        *INNINGS, "over_number", "runs", "wickets", "total", "down", F.coalesce(ratio(c("total"), c("bowled"), 6, 2), F.lit(0.0)).alias("run_rate"),
        "balls_left", required.alias("required"), ratio(required, c("balls_left"), 6, 2).alias("required_rate"),
    )


def chase_states(overs: DataFrame) -> DataFrame:
    """The requirement after an innings' last over; an innings that is no chase, or is won, has no row.

    overs: as `requirements` or `play_by_play.feed_overs` return them.  An over without number comes first.
    """
    last = F.max_by(F.struct("required", "balls_left", "required_rate"), F.coalesce("over_number", F.lit(0))).alias("last")
    return overs.groupBy(*INNINGS).agg(last).select(*INNINGS, "last.*").filter("required <> 0")


def win_probability(overs: DataFrame, team: str) -> DataFrame:
    """match_id, inning, over_number, win_prob of one team through whole matches.

    A feed's number is that of the side that bats, so it is turned round in the innings in which the team bowls.
    """
    own = F.when(c("team") == team, c("win_prob")).otherwise(F.lit(100.0) - c("win_prob"))
    return overs.select(*INNINGS, "over_number", own.alias("win_prob"))

"""A stored match as one nested row: official card by innings, balls with the running score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import overs_text, ratio, score_text

c = F.col


def _overs(balls: Column) -> Column:
    balls = F.coalesce(balls, F.lit(0))
    return F.when(balls % 6 == 0, (balls / 6).cast("long").cast("string")).otherwise(overs_text(balls))


def _listed(df: DataFrame, keys: list[str], order: str, values: list[Column], name: str) -> DataFrame:
    """One row for each key with an array of structs in order."""
    rows = F.array_sort(F.collect_list(F.struct(c(order).alias("__o"), F.struct(*values).alias("v"))))
    return df.groupBy(*keys).agg(F.transform(rows, lambda x: x["v"]).alias(name))


def match_details(matches: DataFrame, log: DataFrame, inns: DataFrame, batting: DataFrame, bowling: DataFrame, balls: DataFrame) -> DataFrame:
    """One row for each match that was loaded (status ok or partial): its columns, `innings` and `balls` as arrays.

    What is gathered into one row is one match.  Give `matches` filtered to the matches wanted; the rest is joined to it.
    Bowlers keep the order of their names, as an official card's rows carry no number.
    """
    keys = ["match_id", "inning"]
    m = matches.join(log.filter(c("status").isin("ok", "partial")).select("match_id", "status"), "match_id")
    wanted = m.select("match_id")
    own = lambda df: df.join(wanted, "match_id", "left_semi")
    rate = lambda a, b, k: ratio(c(a), c(b), k, 2)
    bat = _listed(own(batting), keys, "position", [c("player").alias("name"), c("dismissal"), c("runs"), c("balls"), c("fours"), c("sixes"), rate("runs", "balls", 100).alias("strike_rate"), (~c("is_out")).alias("not_out")], "batters")
    bowl = _listed(own(bowling), keys, "player", [c("player").alias("name"), _overs(c("balls")).alias("overs"), c("conceded").alias("runs"), c("wickets"), rate("conceded", "balls", 6).alias("economy"), c("dots")], "bowlers")
    i = own(inns).join(bat, keys, "left").join(bowl, keys, "left")
    cards = _listed(i, ["match_id"], "inning", [c("inning").alias("number"), c("team"), c("runs"), c("wickets"), _overs(c("balls")).alias("overs"), c("extras"), c("is_super_over"), score_text(c("runs"), c("wickets")).alias("score"), c("batters"), c("bowlers")], "innings")
    w = Window.partitionBy(*keys).orderBy("sequence").rowsBetween(Window.unboundedPreceding, 0)
    b = own(balls).withColumn("score", score_text(F.sum("runs_total").over(w), F.count_if("is_wicket").over(w)))
    event = F.when(c("is_wicket"), "W").when(c("is_six"), "6").when(c("is_four"), "4").otherwise(c("runs_total").cast("string"))
    b = b.withColumn("place", F.struct("inning", "sequence"))
    said = _listed(b, ["match_id"], "place", [F.concat_ws("-", "match_id", "inning", "sequence").alias("id"), c("inning"), c("over_label").alias("label"), event.alias("event"), c("runs_total").alias("runs"), c("runs_bat").alias("batter_runs"), c("is_wicket").alias("wicket"), (c("is_four") | c("is_six")).alias("boundary"), c("short_text").alias("title"), c("commentary").alias("text"), c("score"), c("batter"), c("bowler"), c("dismissal_type"), c("is_legal")], "balls")
    return m.join(cards, "match_id", "left").join(said, "match_id", "left")

"""Hat-tricks, awards, substitutes, partnerships, par by over, style coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import count_where, franchise, ratio
from ..plans.archive import Archive
from .innings import partnerships

c = F.col


def hat_tricks(a: Archive, team: str | None = None, limit: int = 100) -> DataFrame:
    """Three wickets of a bowler on consecutive deliveries of a match (a wide between them breaks it; four in four count once)."""
    d = a.d.filter(c("bowling_team") == team) if team else a.d
    w = Window.partitionBy("match_id", "bowler_id").orderBy("inning", "sequence")
    x = d.select("match_id", "bowler_id", "bowler", "bowling_team", "batting_team", "start_date", (c("bowler_wicket") & F.lag("bowler_wicket", 1).over(w) & F.lag("bowler_wicket", 2).over(w)).alias("third"))
    out = x.filter("third").groupBy("match_id", "bowler_id").agg(F.max("bowler").alias("bowler"), F.max("bowling_team").alias("team"), F.max("batting_team").alias("against"), F.min("start_date").alias("start_date"))
    return out.orderBy(c("start_date").desc(), "match_id", "bowler_id").limit(limit)


def hat_trick_counts(a: Archive, team: str | None = None) -> DataFrame:
    """Hat-tricks by bowler (matches with one)."""
    return hat_tricks(a, team, 2**31 - 1).groupBy("bowler_id").agg(F.max("bowler").alias("bowler"), F.count(F.lit(1)).alias("hattricks")).orderBy(c("hattricks").desc(), "bowler_id")


def awards(a: Archive, team: str | None = None, player: int | None = None, limit: int = 20) -> DataFrame:
    """Player-of-the-match awards: count and latest date, over all or for a team or player."""
    w = a.awards.join(a.matches.select("match_id", "start_date", "year"), "match_id")
    w = w.filter(c("player_id") == player) if player is not None else w
    if team:
        sides = a.d.select("match_id", c("batter_id").alias("player_id"), c("batting_team").alias("team")).union(a.d.select("match_id", "bowler_id", "bowling_team")).filter(c("team") == team).select("match_id", "player_id").distinct()
        w = w.join(sides, ["match_id", "player_id"], "left_semi")
    out = w.groupBy("player_id").agg(F.max("player").alias("player"), F.count(F.lit(1)).alias("awards"), F.max("start_date").alias("latest"))
    return out.orderBy(c("awards").desc(), c("latest").desc(), "player_id").limit(limit)


def impact_substitutes(a: Archive, team: str | None = None, sort: str = "times", limit: int = 20) -> DataFrame:
    """Substitutes by what they did in the matches they came on in; sort: times, runs or wkts."""
    s = a.subs.filter(c("reason") == "impact_player").join(a.matches.select("match_id"), "match_id", "left_semi")
    s = s.filter(franchise(c("team")) == team) if team else s
    came = s.select("match_id", c("player_in_id").alias("player_id"))
    bat = came.join(a.d.withColumnRenamed("batter_id", "player_id"), ["match_id", "player_id"]).groupBy("player_id").agg(F.sum("runs_bat").alias("runs"), count_where(~c("is_wide")).alias("balls_faced"))
    bowl = came.join(a.d.withColumnRenamed("bowler_id", "player_id"), ["match_id", "player_id"]).groupBy("player_id").agg(count_where(c("bowler_wicket")).alias("wkts"), ratio(F.sum("bowler_runs"), count_where(c("is_legal")), 6, 2).alias("economy"))
    times = s.groupBy(c("player_in_id").alias("player_id")).agg(F.max("player_in").alias("player"), F.count(F.lit(1)).alias("times"))
    out = times.join(bat, "player_id", "left").join(bowl, "player_id", "left")
    zero = lambda x: F.coalesce(c(x), F.lit(0)).alias(x)
    out = out.select("player_id", "player", "times", zero("runs"), zero("balls_faced"), zero("wkts"), "economy")
    return out.orderBy(c(sort).desc(), "player_id").limit(limit)


def _stands(a: Archive, wicket: int | None, team: str | None, innings: int | None) -> DataFrame:
    p = partnerships(a.d)
    for key, value in (("wicket", wicket), ("team", team), ("inning", innings)):
        p = p.filter(c(key) == value) if value is not None else p
    return p


def top_partnerships(a: Archive, wicket: int | None = None, team: str | None = None, innings: int | None = None, limit: int = 20) -> DataFrame:
    out = _stands(a, wicket, team, innings).join(a.matches.select("match_id", "start_date"), "match_id")
    return out.select("match_id", "inning", "wicket", "pair", "runs", "balls", "team", "opposition", "start_date").orderBy(c("runs").desc(), "start_date", "inning", "wicket").limit(limit)


def pair_partnerships(a: Archive, wicket: int | None = None, team: str | None = None, innings: int | None = None, least: int = 5, limit: int = 20) -> DataFrame:
    """Pairs of batters by the runs of all their stands."""
    out = _stands(a, wicket, team, innings).filter(F.size("ids") == 2).groupBy("ids").agg(
        F.max("pair").alias("pair"), F.count(F.lit(1)).alias("stands"), F.sum("runs").alias("runs"), ratio(F.sum("runs"), F.count(F.lit(1)), 1, 1).alias("avg_stand"), F.max("runs").alias("best"), count_where(c("runs") >= 100).alias("hundred_stands"), ratio(F.sum("runs"), F.sum("balls"), 100, 1).alias("rate"),
    )
    return out.filter(c("stands") >= least).orderBy(c("runs").desc(), "ids").limit(limit).drop("ids")


def par_by_over(a: Archive) -> DataFrame:
    """Average runs and wickets of each over number."""
    inns = F.count_distinct(F.struct("match_id", "inning"))
    return a.d.groupBy("over_number").agg(ratio(F.sum("runs_total"), inns, 1, 2).alias("runs"), ratio(count_where(c("is_wicket")), inns, 1, 3).alias("wickets")).orderBy("over_number")


def style_coverage(a: Archive) -> DataFrame:
    """Share of balls whose bowling kind, and whose batting hand, is known."""
    s = a.styles
    x = a.d.join(s.select(c("player_id").alias("bowler_id"), "bowl_kind"), "bowler_id", "left").join(s.select(c("player_id").alias("batter_id"), "bat_hand"), "batter_id", "left")
    n = F.count(F.lit(1))
    known = lambda k: F.coalesce(c(k), F.lit("")) != ""
    return x.agg(n.alias("balls"), ratio(count_where(known("bowl_kind")), n, 100, 1).alias("bowl_kind_pct"), ratio(count_where(known("bat_hand")), n, 100, 1).alias("bat_hand_pct"))


def fielding(d: DataFrame, fielders: DataFrame, limit: int = 20) -> DataFrame:
    """Catches, run outs and stumpings by fielder (fielders: match_id, inning, fielder_id, fielder, kind, substitute)."""
    kind = c("kind")
    out = fielders.join(d.select("match_id").distinct(), "match_id", "left_semi").filter(c("fielder_id").isNotNull()).groupBy("fielder_id").agg(
        F.max("fielder").alias("fielder"), count_where(kind.isin("caught", "caught and bowled")).alias("catches"), count_where(kind == "run out").alias("run_outs"), count_where(kind == "stumped").alias("stumpings"),
    )
    return out.withColumn("dismissals", c("catches") + c("run_outs") + c("stumpings")).orderBy(c("dismissals").desc(), "fielder_id").limit(limit)

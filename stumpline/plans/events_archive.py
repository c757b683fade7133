"""The tables of an archive read out of the `events` table: each event a ball, each day a match, each half day an innings.

`short` reads the same events as matches of 240 balls instead, so that matches grow in number, not in length.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import as_count, franchise, ground, phase
from .archive import Archive

c = F.col
TEAMS = ("KXIP", "DD", "MI", "CSK", "RCB", "KKR", "RR", "SRH")
VENUES = ("Feroz Shah Kotla, Delhi", "Eden Gardens, Kolkata", "Wankhede Stadium, Mumbai", "Sardar Patel Stadium, Ahmedabad", "Sheikh Zayed Stadium, Abu Dhabi")
BALLS_IN_INNINGS = 160


def _pick(values: tuple[str, ...], index) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (index % len(values) + 1).cast("int"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.datediff(c("ts").cast("date"), F.lit("2000-01-01").cast("date")).cast("long")
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("day", day)


@dataclass(frozen=True)
class Shape:
    """Where a ball lies in its match, who bowls it and what is scored off the bat (0 off a wide anyway)."""

    inning: Column
    over: Column
    bowler: Column
    runs: Column


def by_day() -> Shape:
    """Half days as innings, hours as overs."""
    return Shape(F.floor(F.hour("ts") / 12) + 1, F.hour("ts") % 12 + 1, c("event_id") % 20, F.floor("value") % 5 + c("user_id") % 3)


def by_number() -> Shape:
    """120 events as an innings of 20 overs; two overs of five are tight (a run now and then, no boundary)."""
    over = F.floor(c("event_id") / 6)
    return Shape(F.floor(c("event_id") / 120) % 2 + 1, over % 20 + 1, over % 11, F.when((over % 5).isin(1, 2), F.when(c("value") > 80, 1).otherwise(0)).otherwise(F.floor("value") % 5 + c("user_id") % 3))


def deliveries(ev: DataFrame, shape: Shape | None = None) -> DataFrame:
    e, u, shape = c("event_id"), c("user_id"), shape or by_day()
    is_wide = c("event_type") == "error"
    is_noball = (c("event_type") == "signup") & (e % 4 == 0)
    out = c("event_type") == "purchase"
    kind = F.when(out, _pick(("run out", "bowled", "caught", "lbw"), e))
    long = lambda x: x.cast("long")
    d = ev.select(
        c("day").alias("match_id"), c("ts").cast("date").alias("start_date"), long(2000 + F.weekofyear("ts")).alias("year"), long(shape.inning).alias("inning"), e.alias("sequence"), long(shape.over).alias("over_number"),
        u.alias("batter_id"), F.concat(F.lit("Batter "), u.cast("string")).alias("batter"), long(shape.bowler).alias("bowler_id"), F.concat(F.lit("Bowler "), long(shape.bowler).cast("string")).alias("bowler"),
        long(F.when(is_wide, 0).otherwise(shape.runs)).alias("runs_bat"), as_count(is_wide).alias("wide_runs"), as_count(is_noball).alias("noball_runs"), as_count(~is_wide & (e % 17 == 0)).alias("bye_runs"), as_count(~is_wide & (e % 19 == 0)).alias("legbye_runs"),
        F.lit(0).cast("long").alias("penalty_runs"), is_wide.alias("is_wide"), is_noball.alias("is_noball"), (~is_wide & ~is_noball).alias("is_legal"), out.alias("is_wicket"), kind.alias("dismissal_type"),
        F.when(out, F.when(e % 5 == 0, u + 1).otherwise(u)).alias("player_out_id"), c("props").alias("commentary"), c("day"),
    )
    extras = c("wide_runs") + c("noball_runs") + c("bye_runs") + c("legbye_runs")
    d = d.withColumns({
        "extras": extras, "runs_total": c("runs_bat") + extras, "bowler_runs": c("runs_bat") + c("wide_runs") + c("noball_runs"), "is_four": c("runs_bat") == 4, "is_six": c("runs_bat") == 6,
        "bowler_wicket": c("is_wicket") & (c("dismissal_type") != "run out"), "player_out": F.concat(F.lit("Batter "), c("player_out_id").cast("string")), "phase": phase(c("over_number"), 4, 9),
    })
    first, second = franchise(_pick(TEAMS, c("day"))), franchise(_pick(TEAMS, c("day") + 1 + c("day") % 7))
    bats = c("inning") == 1
    venue = _pick(VENUES, c("day"))
    return d.withColumns({"batting_team": F.when(bats, first).otherwise(second), "bowling_team": F.when(bats, second).otherwise(first), "venue": venue, "ground": ground(venue), "match_title": _title()}).drop("day")


def _title() -> F.Column:
    k = c("day") % 15
    return F.when(k == 14, "Final").when(k == 13, "Qualifier 1").when(k == 12, "Eliminator").otherwise(F.concat(F.lit("Match "), k.cast("string")))


def matches(ev: DataFrame) -> DataFrame:
    d = c("day")
    m = ev.groupBy("day").agg(F.min(c("ts").cast("date")).alias("start_date"), F.min(2000 + F.weekofyear("ts")).cast("long").alias("year"))
    m = m.withColumns({"team1": _pick(TEAMS, d), "team2": _pick(TEAMS, d + 1 + d % 7)})
    m = m.withColumn("winner", F.when(d % 10 == 0, "").when(d % 3 == 0, c("team2")).otherwise(c("team1")))
    margin = F.when(c("winner") == c("team1"), F.concat(F.lit(" won by "), (d % 40 + 1).cast("string"), F.lit(" runs"))).otherwise(F.concat(F.lit(" won by "), (d % 9 + 1).cast("string"), F.lit(" wickets")))
    text = F.when(c("winner") == "", "No result").when(d % 13 == 1, "Match tied").otherwise(F.concat(c("winner"), margin))
    text = F.concat(text, F.when(d % 9 == 0, " (D/L method)").otherwise(""))
    return m.select(d.alias("match_id"), "start_date", "year", "team1", "team2", "winner", text.alias("status_text"), _title().alias("title"), _pick(VENUES, d).alias("venue"))


#: Balls of an innings of `short`, wides and no-balls among them.
SHORT_BALLS = 120


def short(spark: SparkSession, sf_dir: str) -> Archive:
    """Deliveries and matches of 240 events each, in the order of their numbers; six batters to a side."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").withColumns({"day": F.floor(c("event_id") / (2 * SHORT_BALLS)), "user_id": c("user_id") % 6})
    return Archive(deliveries(ev, by_number()), matches(ev))


def archive(spark: SparkSession, sf_dir: str) -> Archive:
    ev = events(spark, sf_dir)
    m = matches(ev)
    d = c("match_id")
    info = m.select("match_id", F.when(d % 2 == 0, c("team1")).otherwise(c("team2")).alias("toss_winner"), F.when(d % 3 == 0, "bat").otherwise("field").alias("toss_decision"))
    awards = m.select("match_id", (d % 11).alias("player_id"), F.concat(F.lit("Batter "), (d % 11).cast("string")).alias("player"))
    balls = deliveries(ev)
    subs = balls.filter("sequence % 97 = 0").select("match_id", "inning", "sequence", c("batting_team").alias("team"), c("batter_id").alias("player_in_id"), c("batter").alias("player_in"), F.when(c("sequence") % 2 == 0, "impact_player").otherwise("concussion").alias("reason"))
    players = ev.select(c("user_id").alias("player_id")).union(ev.select(c("event_id") % 20)).distinct()
    styles = players.select("player_id", F.when(c("player_id") % 3 == 0, "left").otherwise("right").alias("bat_hand"), F.when(c("player_id") % 7 == 0, "").when(c("player_id") % 2 == 0, "spin").otherwise("pace").alias("bowl_kind"))
    return Archive(balls, m, info, awards, subs, styles, balls)

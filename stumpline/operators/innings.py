"""Views over deliveries: batting and bowling innings, match state, partnerships, home grounds, cards.

A deliveries table has one row per ball (see sources.schemas.DELIVERY for the columns) and is enriched once by
`enriched`.  All views are lazy.  Running state goes by blocks of balls (prefix_scan), so an innings may have any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import as_count, count_where, franchise, ground, phase
from .prefix_scan import running

c = F.col


def one_source(canonical: DataFrame, fallback: DataFrame, match: str = "match_id", names: tuple[str, str] = ("canonical", "fallback")) -> DataFrame:
    """Deliveries of one source for each match: the canonical one where it has the match, else the fallback.

    Columns are matched by name; what a source lacks is null (penalty runs of the fallback are 0).
    """
    rest = fallback.join(canonical.select(match).distinct(), match, "left_anti")
    out = canonical.withColumn("source", F.lit(names[0])).unionByName(rest.withColumn("source", F.lit(names[1])), allowMissingColumns=True)
    return out.withColumn("penalty_runs", F.coalesce(c("penalty_runs"), F.lit(0))) if "penalty_runs" in out.columns else out


def display_names(full: DataFrame, short: DataFrame | None = None) -> DataFrame:
    """player_id, name: the full spelling if one is known, else the short one."""
    out = full.select("player_id", c("name").alias("full"), F.lit(None).cast("string").alias("short"))
    if short is not None:
        out = out.unionByName(short.select("player_id", F.lit(None).cast("string").alias("full"), c("name").alias("short")))
    return out.filter("player_id is not null").groupBy("player_id").agg(F.coalesce(F.max("full"), F.max("short")).alias("name"))


def enriched(deliveries: DataFrame, matches: DataFrame, names: DataFrame, year: Column | None = None, phase_of: Column | None = None) -> DataFrame:
    """Deliveries without super overs, with names, opponent, the bowler's runs, year, ground and phase.

    matches and names are dimensions; Spark broadcasts them by their size.
    """
    m = matches.select("match_id", F.coalesce(year, F.year("start_date")).cast("long").alias("year") if year is not None else F.year("start_date").cast("long").alias("year"), "start_date", "venue", c("title").alias("match_title"), franchise(c("team1")).alias("__t1"), franchise(c("team2")).alias("__t2"))
    out = deliveries.filter("inning <= 2").join(m, "match_id")
    for who in ("batter", "bowler", "player_out"):
        named = names.select(c("player_id").alias(f"{who}_id"), c("name").alias("__name"))
        out = out.join(named, f"{who}_id", "left").withColumn(who, F.coalesce(c("__name"), c(who))).drop("__name")
    team = franchise(c("batting_team"))
    return out.withColumns({
        "batting_team": team, "bowling_team": F.when(c("__t1") == team, c("__t2")).otherwise(c("__t1")),
        "bowler_runs": c("runs_total") - c("bye_runs") - c("legbye_runs") - F.coalesce(c("penalty_runs"), F.lit(0)),
        "ground": ground(c("venue")), "phase": phase(c("over_number")) if phase_of is None else phase_of,
    }).drop("__t1", "__t2")


def batting_innings(d: DataFrame) -> DataFrame:
    """One row per match, innings and batter who faced a ball or was out (a run out at the other end without a ball counts)."""
    faced = d.groupBy("match_id", "inning", c("batter_id").alias("player_id")).agg(
        F.max("year").alias("f_year"), F.max("batter").alias("f_player"), F.max("batting_team").alias("f_team"), F.sum("runs_bat").alias("runs"),
        count_where(~c("is_wide")).alias("balls"), count_where(c("is_four")).alias("fours"), count_where(c("is_six")).alias("sixes"), F.min("sequence").alias("first_ball"),
    )
    out = d.filter(c("is_wicket") & c("player_out_id").isNotNull()).groupBy("match_id", "inning", c("player_out_id").alias("player_id"))
    out = out.agg(F.max("year").alias("o_year"), F.max("player_out").alias("o_player"), F.max("batting_team").alias("o_team"))
    both = faced.join(out, ["match_id", "inning", "player_id"], "full_outer")
    zero = lambda x: F.coalesce(c(x), F.lit(0)).alias(x)
    either = lambda x: F.coalesce(c(f"f_{x}"), c(f"o_{x}")).alias(x)
    return both.select("match_id", "inning", "player_id", either("year"), either("player"), either("team"), zero("runs"), zero("balls"), zero("fours"), zero("sixes"), c("o_year").isNotNull().alias("is_out"), "first_ball")


def bowling_innings(d: DataFrame) -> DataFrame:
    return d.groupBy("match_id", "inning", c("bowler_id").alias("player_id")).agg(
        F.max("year").alias("year"), F.max("bowler").alias("player"), F.max("bowling_team").alias("team"), count_where(c("is_legal")).alias("balls"),
        F.sum("bowler_runs").alias("conceded"), count_where(c("bowler_wicket")).alias("wickets"), F.min("sequence").alias("first_ball"),
    )


def innings_totals(d: DataFrame) -> DataFrame:
    """One row per innings: teams, runs, wickets, legal balls, extras by kind."""
    return d.groupBy("match_id", "inning").agg(
        F.max("year").alias("year"), F.max("batting_team").alias("team"), F.max("bowling_team").alias("opposition"), F.sum("runs_total").alias("runs"), count_where(c("is_wicket")).alias("wickets"), count_where(c("is_legal")).alias("balls"),
        F.sum("extras").alias("extras"), F.sum("wide_runs").alias("wides"), F.sum("noball_runs").alias("noballs"), F.sum("bye_runs").alias("byes"), F.sum("legbye_runs").alias("legbyes"), F.max("ground").alias("ground"), F.max("match_title").alias("match_title"),
    )


def match_state(d: DataFrame, balls_in_innings: int = 120) -> DataFrame:
    """d with the state before each ball: score, wickets, legal balls, target chase figures, the batter's ball number."""
    x = running(d, ["match_id", "inning"], ["sequence"], before={"score_before": c("runs_total"), "wkts_before": as_count(c("is_wicket")), "legal_before": as_count(c("is_legal"))})
    x = running(x, ["match_id", "inning", "batter_id"], ["sequence"], sums={"bat_ball_no": as_count(~c("is_wide"))})
    first = d.filter("inning = 1").groupBy("match_id").agg(F.sum("runs_total").alias("first_total"))
    needed = c("first_total") + 1 - c("score_before")
    left = F.lit(balls_in_innings) - c("legal_before")
    return x.join(first, "match_id", "left").withColumns({
        "needed": F.when(c("inning") == 2, needed), "balls_left": left, "wkts_in_hand": F.lit(10) - c("wkts_before"),
        "rrr": F.when((c("inning") == 2) & (left > 0), F.lit(6.0) * needed / left),
    })


def partnerships(d: DataFrame) -> DataFrame:
    """One row per stand: deliveries of an innings with as many wickets down; pair names those who faced."""
    return match_state(d).groupBy("match_id", "inning", (c("wkts_before") + 1).alias("wicket")).agg(
        F.max("year").alias("year"), F.max("batting_team").alias("team"), F.max("bowling_team").alias("opposition"), F.sum("runs_total").alias("runs"), F.sum(as_count(c("is_legal"))).alias("balls"),
        F.array_sort(F.collect_set("batter_id")).alias("ids"), F.array_join(F.array_sort(F.collect_set("batter")), " & ").alias("pair"), F.bool_or("is_wicket").alias("ended"),
    )


def with_sides(matches: DataFrame) -> DataFrame:
    """Two rows per match, one for each team: team, opponent, winner under their present codes, ground."""
    m = matches.withColumns({"t1": franchise(c("team1")), "t2": franchise(c("team2")), "won": franchise(F.coalesce(c("winner"), F.lit(""))), "ground": ground(c("venue"))})
    return m.withColumn("side", F.explode(F.array(F.struct(c("t1").alias("team"), c("t2").alias("opponent")), F.struct(c("t2").alias("team"), c("t1").alias("opponent"))))).select("*", "side.*").drop("side")


def home_grounds(matches: DataFrame, least: int = 4, share: float = 0.25, neutral_years: tuple[int, ...] = (2009, 2020, 2021, 2022)) -> DataFrame:
    """year, team, ground: where a team played most in a season, if often enough (ties: first by name)."""
    played = with_sides(matches).groupBy("year", "team", "ground").agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("year", "team")
    ranked = played.withColumns({"all": F.sum("n").over(own), "place": F.row_number().over(own.orderBy(c("n").desc(), "ground"))})
    return ranked.filter((c("place") == 1) & (c("n") >= least) & (c("n") >= share * c("all")) & ~c("year").isin(*neutral_years)).select("year", "team", "ground")


def scorecards(d: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rebuilt innings, batting and bowling cards of all matches."""
    bowling = d.groupBy("match_id", "inning", c("bowler_id").alias("player_id")).agg(
        F.max("bowler").alias("player"), count_where(c("is_legal")).alias("balls"), F.sum("bowler_runs").alias("conceded"), count_where(c("bowler_wicket")).alias("wickets"), count_where(c("is_wide")).alias("wides"),
        count_where(c("is_noball")).alias("noballs"), count_where(c("is_legal") & (c("runs_total") == 0)).alias("dots_total"), count_where(c("is_legal") & (c("bowler_runs") == 0)).alias("dots_charged"), count_where(c("is_legal") & (c("runs_bat") == 0)).alias("dots_bat"),
    )
    return innings_totals(d), batting_innings(d), bowling

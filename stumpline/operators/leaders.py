"""Leaderboards, a player's seasons and phases, matchups, season summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import count_where, overs_text, phase_order, ratio, score_text
from ..plans.archive import Archive
from .innings import batting_innings, bowling_innings, innings_totals

c = F.col


def batting_figures() -> list[Column]:
    outs = count_where(c("is_out"))
    return [
        F.sum("runs").alias("runs"), F.count(F.lit(1)).alias("inns"), outs.alias("outs"), ratio(F.sum("runs"), outs, 1, 2).alias("avg"), ratio(F.sum("runs"), F.sum("balls"), 100, 2).alias("sr"),
        count_where(c("runs").between(50, 99)).alias("fifties"), count_where(c("runs") >= 100).alias("hundreds"), F.sum("fours").alias("fours"), F.sum("sixes").alias("sixes"), F.max("runs").alias("hs"),
    ]


def bowling_figures() -> list[Column]:
    best = F.max_by(score_text(c("wickets"), c("conceded")), F.struct(c("wickets"), -c("conceded")))
    return [
        F.sum("wickets").alias("wkts"), overs_text(F.sum("balls")).alias("overs"), F.sum("conceded").alias("runs"), ratio(F.sum("conceded"), F.sum("balls"), 6, 2).alias("econ"),
        ratio(F.sum("conceded"), F.sum("wickets"), 1, 2).alias("avg"), ratio(F.sum("balls"), F.sum("wickets"), 1, 1).alias("sr"), count_where(c("wickets") >= 4).alias("four_wkts"), best.alias("best"),
    ]


#: Sort key -> columns in order; a minus sign means descending.  Nulls come last, the player's id breaks ties.
BATTING_SORTS = {"runs": "-runs -sr", "sr": "-sr -runs", "avg": "-avg -runs", "sixes": "-sixes -runs", "fours": "-fours -runs", "fifties": "-fifties -runs", "hundreds": "-hundreds -runs", "hs": "-hs -runs"}
BOWLING_SORTS = {"wkts": "-wkts econ", "econ": "econ -wkts", "avg": "avg -wkts", "sr": "sr -wkts", "4w": "-four_wkts -wkts"}
RATE_SORTS = {"sr", "avg", "econ"}


def order(keys: str) -> list[Column]:
    return [c(k[1:]).desc_nulls_last() if k[0] == "-" else c(k).asc_nulls_last() for k in keys.split()]


def top_batters(a: Archive, sort: str = "runs", team: str | None = None, least_balls: int | None = None, one_season: bool = False, limit: int = 20) -> DataFrame:
    """Batters by one of BATTING_SORTS; rates need 100 balls in a season, 500 over all, unless least_balls says otherwise."""
    floor = least_balls if least_balls is not None else (100 * (1 if one_season else 5) if sort in RATE_SORTS else 0)
    inns = batting_innings(a.d)
    inns = inns.filter(c("team") == team) if team else inns
    out = inns.groupBy("player_id").agg(F.max("player").alias("player"), *batting_figures(), F.sum("balls").alias("balls")).filter(c("balls") >= floor)
    return out.orderBy(*order(BATTING_SORTS[sort] + " player_id")).limit(limit)


def top_bowlers(a: Archive, sort: str = "wkts", team: str | None = None, least_balls: int | None = None, one_season: bool = False, limit: int = 20) -> DataFrame:
    """Bowlers by one of BOWLING_SORTS; rates need 120 balls in a season, 600 over all, unless least_balls says otherwise."""
    floor = least_balls if least_balls is not None else (120 * (1 if one_season else 5) if sort in RATE_SORTS else 0)
    inns = bowling_innings(a.d)
    inns = inns.filter(c("team") == team) if team else inns
    out = inns.groupBy("player_id").agg(F.max("player").alias("player"), F.count(F.lit(1)).alias("inns"), *bowling_figures(), F.sum("balls").alias("balls")).filter(c("balls") >= floor)
    return out.orderBy(*order(BOWLING_SORTS[sort] + " player_id")).limit(limit)


def _rollup_year(df: DataFrame, *figures: Column) -> DataFrame:
    """Figures by year with a row 'Total' (told by grouping, so a null year cannot be taken for it)."""
    out = df.rollup("year").agg(F.grouping("year").alias("__total"), *figures)
    label = F.when(c("__total") == 1, "Total").otherwise(c("year").cast("string"))
    return out.orderBy("__total", "year").withColumn("year", label).drop("__total")


def batting_by_year(a: Archive, player: int) -> DataFrame:
    return _rollup_year(batting_innings(a.d).filter(c("player_id") == player), *batting_figures())


def bowling_by_year(a: Archive, player: int) -> DataFrame:
    return _rollup_year(bowling_innings(a.d).filter(c("player_id") == player), F.count(F.lit(1)).alias("inns"), *bowling_figures())


def batting_by_phase(a: Archive, player: int) -> DataFrame:
    """A batter's phases; outs are all dismissals of the player, at either end."""
    faced, dot = ~c("is_wide"), ~c("is_wide") & (c("runs_bat") == 0)
    own = a.d.filter(c("batter_id") == player).groupBy("phase").agg(
        F.sum("runs_bat").alias("runs"), count_where(faced).alias("balls"), ratio(F.sum("runs_bat"), count_where(faced), 100, 2).alias("sr"), ratio(count_where(dot), count_where(faced), 100, 1).alias("dot_pct"), count_where(c("is_four") | c("is_six")).alias("boundaries"),
    )
    outs = a.d.filter((c("player_out_id") == player) & c("is_wicket")).groupBy("phase").agg(F.count(F.lit(1)).alias("outs"))
    return own.join(outs, "phase", "left").withColumn("outs", F.coalesce("outs", F.lit(0))).orderBy(phase_order(c("phase")))


def bowling_by_phase(a: Archive, player: int) -> DataFrame:
    legal = count_where(c("is_legal"))
    return a.d.filter(c("bowler_id") == player).groupBy("phase").agg(
        legal.alias("balls"), F.sum("bowler_runs").alias("runs"), ratio(F.sum("bowler_runs"), legal, 6, 2).alias("econ"), ratio(count_where(c("is_legal") & (c("runs_total") == 0)), legal, 100, 1).alias("dot_pct"), count_where(c("bowler_wicket")).alias("wkts"),
    ).orderBy(phase_order(c("phase")))


def matchup(a: Archive, batter: int, bowler: int) -> DataFrame:
    """A batter against a bowler by year; outs are the batter's dismissals credited to this bowler."""
    faced, dot = count_where(~c("is_wide")), count_where(~c("is_wide") & (c("runs_bat") == 0))
    return _rollup_year(
        a.d.filter((c("batter_id") == batter) & (c("bowler_id") == bowler)), faced.alias("balls"), F.sum("runs_bat").alias("runs"), count_where(c("bowler_wicket") & (c("player_out_id") == batter)).alias("outs"),
        ratio(F.sum("runs_bat"), faced, 100, 2).alias("sr"), ratio(dot, faced, 100, 1).alias("dot_pct"), count_where(c("is_four")).alias("fours"), count_where(c("is_six")).alias("sixes"),
    )


def over_leaders(a: Archive, role: str = "bat", first_over: int = 1, last_over: int = 20, innings: int | None = None, phase: str | None = None, sort: str | None = None, least_balls: int = 60, limit: int = 20) -> DataFrame:
    """Leaders in a range of overs, a phase or an innings.

    Batters sort by sr or runs, bowlers by econ or wkts.  `outs` counts dismissals of the striker only.
    """
    d = a.d.filter(c("over_number").between(first_over, last_over))
    d = d.filter(c("inning") == innings) if innings else d
    d = d.filter(c("phase") == phase) if phase else d
    if role == "bat":
        faced = count_where(~c("is_wide"))
        out = d.groupBy(c("batter_id").alias("player_id")).agg(
            F.max("batter").alias("player"), F.sum("runs_bat").alias("runs"), faced.alias("balls"), ratio(F.sum("runs_bat"), faced, 100, 2).alias("sr"), count_where(c("is_six")).alias("sixes"),
            ratio(count_where(~c("is_wide") & (c("runs_bat") == 0)), faced, 100, 1).alias("dot_pct"), count_where(c("is_wicket") & (c("player_out_id") == c("batter_id"))).alias("outs"),
        )
        keys = {"sr": "-sr -balls", "runs": "-runs -balls"}[sort or "sr"]
    else:
        legal = count_where(c("is_legal"))
        out = d.groupBy(c("bowler_id").alias("player_id")).agg(
            F.max("bowler").alias("player"), count_where(c("bowler_wicket")).alias("wkts"), legal.alias("balls"), F.sum("bowler_runs").alias("runs"), ratio(F.sum("bowler_runs"), legal, 6, 2).alias("econ"),
            ratio(count_where(c("is_legal") & (c("runs_total") == 0)), legal, 100, 1).alias("dot_pct"),
        )
        keys = {"econ": "econ", "wkts": "-wkts econ"}[sort or "econ"]
    return out.filter(c("balls") >= least_balls).orderBy(*order(keys + " player_id")).limit(limit)


def season_summary(a: Archive) -> DataFrame:
    """By year: matches listed and with balls, run rate, average first innings, highest total, sixes."""
    listed = a.matches.groupBy("year").agg(F.count(F.lit(1)).alias("matches"))
    inns = innings_totals(a.d).groupBy("year").agg(
        F.count_distinct("match_id").alias("with_balls"), ratio(F.sum("runs"), F.sum("balls"), 6, 2).alias("run_rate"), ratio(F.sum(F.when(c("inning") == 1, c("runs"))), count_where(c("inning") == 1), 1, 1).alias("avg_1st_inns"), F.max("runs").alias("highest"),
    )
    sixes = a.d.filter("is_six").groupBy("year").agg(F.count(F.lit(1)).alias("sixes"))
    out = listed.join(inns, "year", "left").join(sixes, "year", "left")
    return out.withColumns({"with_balls": F.coalesce("with_balls", F.lit(0)), "sixes": F.coalesce("sixes", F.lit(0))}).orderBy("year")


def find_players(a: Archive, wanted: str, limit: int = 25) -> DataFrame:
    """Players by part of the name or by id, with their innings with bat and ball and their span of years."""
    from ..functions.columns import contains_text

    bat = batting_innings(a.d).groupBy("player_id").agg(F.max("player").alias("player"), F.count(F.lit(1)).alias("bat_inns"), F.lit(0).cast("long").alias("bowl_inns"), F.min("year").alias("low"), F.max("year").alias("high"))
    bowl = bowling_innings(a.d).groupBy("player_id").agg(F.max("player").alias("player"), F.lit(0).cast("long").alias("bat_inns"), F.count(F.lit(1)).alias("bowl_inns"), F.min("year").alias("low"), F.max("year").alias("high"))
    out = bat.unionByName(bowl).groupBy("player_id").agg(F.max("player").alias("player"), F.sum("bat_inns").alias("bat_inns"), F.sum("bowl_inns").alias("bowl_inns"), F.min("low").alias("first_year"), F.max("high").alias("last_year"))
    return out.filter(contains_text(c("player"), wanted) | (c("player_id").cast("string") == wanted)).orderBy((c("bat_inns") + c("bowl_inns")).desc(), "player_id").limit(limit)


def resolve_player(a: Archive, wanted: str) -> tuple[int, str] | list[tuple[int, str]]:
    """(id, name), or the candidates if several or none fit: by id, exact name, part of it, surname with initials."""
    rows = [(r.player_id, r.player) for r in find_players(a, wanted, 50).select("player_id", "player").collect()]
    exact = [r for r in rows if str(r[0]) == wanted or (r[1] or "").lower() == wanted.lower()]
    if len(exact) == 1:
        return exact[0]
    if len(rows) == 1:
        return rows[0]
    if not rows and " " in wanted.strip():
        first, last = wanted.split()[0], wanted.split()[-1]
        short = [(r.player_id, r.player) for r in find_players(a, last, 50).select("player_id", "player").collect() if r.player and r.player[0].lower() == first[0].lower() and r.player.lower().endswith(last.lower())]
        return short[0] if len(short) == 1 else short
    return rows

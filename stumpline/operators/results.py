"""Match-level facts: close results, totals defended or chased, match lists, head to head, seasons of a team, finals, toss."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import contains_text, count_where, franchise, ground, is_final, is_playoff, rain_revised, ratio, won_by
from ..plans.archive import Archive
from .innings import home_grounds, innings_totals, with_sides

c = F.col


def staged(matches: DataFrame, stage: str | None) -> DataFrame:
    """Matches of a stage: None for all, 'final' or 'playoff'."""
    if stage is None:
        return matches
    return matches.filter({"final": is_final, "playoff": is_playoff}[stage](c("title")))


def _listed(m: DataFrame) -> DataFrame:
    return m.select("match_id", "start_date", "title", franchise(c("team1")).alias("team1"), franchise(c("team2")).alias("team2"), c("status_text").alias("result"))


def _close(a: Archive, what: str, value: int, stage: str | None) -> DataFrame:
    m = staged(a.matches, stage).filter(~rain_revised(c("status_text")))
    return m.filter(won_by(c("status_text"), what) < value)


def close_by_runs(a: Archive, value: int, stage: str | None = None) -> DataFrame:
    """Matches won by fewer than `value` runs, latest first; rain-revised results are left out."""
    return _listed(_close(a, "run", value, stage)).orderBy(c("start_date").desc(), "match_id")


def close_by_wickets(a: Archive, value: int, stage: str | None = None) -> DataFrame:
    """How many matches were won by fewer than `value` wickets."""
    return _close(a, "wicket", value, stage).agg(F.count(F.lit(1)).alias("matches"))


def tied(a: Archive, stage: str | None = None) -> DataFrame:
    return _listed(staged(a.matches, stage).filter(c("status_text").ilike("%tied%"))).orderBy(c("start_date").desc(), "match_id")


def _totals(a: Archive, over: int) -> DataFrame:
    first, second = c("inning") == 1, c("inning") == 2
    return a.d.groupBy("match_id").agg(
        F.sum(F.when(first, c("runs_total"))).alias("first"), F.max(F.when(first, c("batting_team"))).alias("bat_first"), F.max(F.when(second, c("batting_team"))).alias("chaser"),
        F.sum(F.when(second & (c("over_number") < over), c("runs_total"))).alias("before_over"),
    )


def _played(a: Archive, over: int, stage: str | None) -> DataFrame:
    m = staged(a.matches, stage).filter(~rain_revised(c("status_text"))).select("match_id", "start_date", c("status_text").alias("result"), franchise(c("winner")).alias("won"))
    return _totals(a, over).join(m, "match_id")


def defended_under(a: Archive, value: int, stage: str | None = None) -> DataFrame:
    """First-innings totals below `value` that won, by team."""
    out = _played(a, 1, stage).filter((c("first") < value) & (c("won") == c("bat_first"))).groupBy(c("bat_first").alias("team"))
    return out.agg(F.count(F.lit(1)).alias("times"), F.max("first").alias("highest_defended"), F.min("first").alias("lowest_defended")).orderBy(c("times").desc(), "team")


def chased_over(a: Archive, value: int, stage: str | None = None) -> DataFrame:
    """Targets (total + 1) of `value` or more that were reached, by team."""
    out = _played(a, 1, stage).filter((c("first") + 1 >= value) & (c("won") == c("chaser"))).groupBy(c("chaser").alias("team"))
    return out.agg(F.count(F.lit(1)).alias("times"), F.max("first").alias("highest_target"), F.min("first").alias("lowest_target")).orderBy(c("times").desc(), "team")


def needed_at_over(a: Archive, over: int, stage: str | None = None, limit: int = 20) -> DataFrame:
    """Most runs still needed at the start of an over in chases that were won."""
    needed = c("first") + 1 - F.coalesce(c("before_over"), F.lit(0))
    out = _played(a, over, stage).filter(c("won") == c("chaser")).select("match_id", c("chaser").alias("team"), needed.alias("needed"), "start_date", "result")
    return out.orderBy(c("needed").desc(), "match_id").limit(limit)


def innings_over(a: Archive, value: int, side: str = "bat", innings: int | None = None, stage: str | None = None) -> DataFrame:
    """Innings totals of `value` or more scored (side bat) or conceded (bowl), by team."""
    inns = innings_totals(a.d).filter(c("runs") >= value)
    inns = inns.filter(c("inning") == innings) if innings else inns
    team = c("team") if side == "bat" else c("opposition")
    m = staged(a.matches, stage).select("match_id", franchise(c("winner")).alias("won"))
    out = inns.select("match_id", "runs", team.alias("team")).join(m, "match_id").groupBy("team")
    return out.agg(F.count(F.lit(1)).alias("times"), count_where(c("won") == c("team")).alias("won_match"), F.max("runs").alias("highest")).orderBy(c("times").desc(), "team")


def match_list(a: Archive, sources: DataFrame | None = None, team: str | None = None, versus: str | None = None, limit: int = 100) -> DataFrame:
    """Matches in order of date; `data` tells the source of the balls (sources: match_id, source) or 'no balls'."""
    m = _listed(a.matches)
    for code in (team, versus):
        m = m.filter((c("team1") == code) | (c("team2") == code)) if code else m
    sources = a.d.groupBy("match_id").agg(F.lit("deliveries").alias("source")) if sources is None else sources.groupBy("match_id").agg(F.min("source").alias("source"))
    return m.join(sources, "match_id", "left").withColumn("data", F.coalesce("source", F.lit("no balls"))).drop("source").orderBy("start_date", "match_id").limit(limit)


def champions(a: Archive) -> DataFrame:
    """Finals (title exactly 'Final'): champion and runner-up by year."""
    m = a.matches.filter(c("title") == "Final")
    won, t1, t2 = (franchise(c(x)) for x in ("winner", "team1", "team2"))
    return m.select("year", won.alias("champion"), F.when(won == t1, t2).otherwise(t1).alias("runner_up"), c("status_text").alias("result"), ground(c("venue")).alias("ground"), "match_id").orderBy("year", "match_id")


def titles(a: Archive, limit: int = 20) -> DataFrame:
    """Titles by team, with their years in order of date."""
    years = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_date", "match_id", "year"))), lambda x: x["year"].cast("string")), ", ")
    out = a.matches.filter(c("title") == "Final").groupBy(franchise(c("winner")).alias("team")).agg(F.count(F.lit(1)).alias("titles"), years.alias("years"))
    return out.orderBy(c("titles").desc(), "team").limit(limit)


def team_seasons(a: Archive, team: str) -> DataFrame:
    """A team's record by year with how far it came, and a row 'Total' with its titles."""
    g = with_sides(a.matches).filter(c("team") == team)
    won, none = c("won") == team, c("won") == ""
    final = c("title") == "Final"
    finish = F.when(F.bool_or(final & won), "Champions").when(F.bool_or(final), "Runner-up").when(F.bool_or(is_playoff(c("title"))), "Playoffs").otherwise("League stage")
    s = g.groupBy("year").agg(F.count(F.lit(1)).alias("played"), count_where(won).alias("won"), count_where(~won & ~none).alias("lost"), count_where(none).alias("no_result"), finish.alias("finish"))
    total = s.agg(*(F.sum(x).alias(x) for x in ("played", "won", "lost", "no_result")), F.concat(count_where(c("finish") == "Champions").cast("string"), F.lit(" titles")).alias("finish")).filter("played is not null")
    out = s.withColumn("year", c("year").cast("string")).unionByName(total.withColumn("year", F.lit("Total")))
    return out.select("year", "played", "won", "lost", "no_result", ratio(c("won"), c("won") + c("lost"), 100, 1).alias("win_pct"), "finish").orderBy("year")


def head_to_head(a: Archive, team1: str, team2: str) -> DataFrame:
    """Matches between two teams by year, with a row 'Total'; columns team1_won and team2_won."""
    g = with_sides(a.matches).filter((c("team") == team1) & (c("opponent") == team2))
    out = g.rollup("year").agg(F.grouping("year").alias("__total"), F.count(F.lit(1)).alias("played"), count_where(c("won") == team1).alias("team1_won"), count_where(c("won") == team2).alias("team2_won"), count_where(c("won") == "").alias("no_result"))
    return out.orderBy("__total", "year").withColumn("year", F.when(c("__total") == 1, "Total").otherwise(c("year").cast("string"))).drop("__total")


def home_record(a: Archive, least: int = 10, worst: bool = False, limit: int = 20, home: dict | None = None) -> DataFrame:
    """Records at home and away; home: parameters of home_grounds."""
    h = home_grounds(a.matches, **(home or {}))
    own, other = (h.select(c("year").alias("year"), c("team").alias(k), c("ground").alias(f"{k}_home")) for k in ("team", "opponent"))
    s = with_sides(a.matches.filter(c("winner") != "")).join(own, ["year", "team"], "left").join(other, ["year", "opponent"], "left")
    place = F.when(c("team_home") == c("ground"), "home").when(c("opponent_home") == c("ground"), "away").otherwise("neutral")
    s = s.withColumn("place", place)
    count = lambda p, also=F.lit(True): count_where((c("place") == p) & also)
    won = c("won") == c("team")
    out = s.groupBy("team").agg(count("home").alias("home_played"), count("home", won).alias("home_won"), ratio(count("home", won), count("home"), 100, 1).alias("home_win_pct"), count("away").alias("away_played"), ratio(count("away", won), count("away"), 100, 1).alias("away_win_pct"))
    key = c("home_win_pct").asc_nulls_last() if worst else c("home_win_pct").desc_nulls_last()
    return out.filter(c("home_played") >= least).orderBy(key, "team").limit(limit)


def toss(a: Archive, by: str | None = None, venue: str | None = None, least: int = 1, limit: int = 50) -> DataFrame:
    """What toss winners chose and won, over all or by season, venue or team; rain-revised results are left out."""
    m = a.matches.filter((c("winner") != "") & ~rain_revised(c("status_text"))).join(a.info, "match_id")
    m = m.filter(contains_text(ground(c("venue")), venue) | contains_text(c("venue"), venue)) if venue else m
    key = {None: F.lit("all"), "season": c("year").cast("string"), "venue": ground(c("venue")), "team": franchise(c("toss_winner"))}[by]
    field, bat = c("toss_decision") == "field", c("toss_decision") == "bat"
    won = franchise(c("toss_winner")) == franchise(c("winner"))
    n = F.count(F.lit(1))
    out = m.groupBy(key.alias(by or "scope")).agg(
        n.alias("matches"), ratio(count_where(field), n, 100, 1).alias("chose_field_pct"), ratio(count_where(won), n, 100, 1).alias("toss_winner_won_pct"),
        ratio(count_where(field & won), count_where(field), 100, 1).alias("won_pct_when_fielding"), ratio(count_where(bat & won), count_where(bat), 100, 1).alias("won_pct_when_batting"),
    )
    return out.filter(c("matches") >= least).orderBy(*([c(by)] if by == "season" else [c("matches").desc(), c(by or "scope")])).limit(limit)

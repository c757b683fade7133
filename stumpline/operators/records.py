"""Records, milestones, the nth match of a player, rebuilt cards of one match."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import as_count, contains_text, count_where, innings_text, overs_text, phase_order, ratio, score_text
from ..plans.archive import Archive
from .innings import batting_innings, bowling_innings, innings_totals
from .results import _listed

c = F.col


def highest_totals(a: Archive, limit: int = 5) -> DataFrame:
    out = innings_totals(a.d).select("match_id", "inning", "team", score_text(c("runs"), c("wickets")).alias("score"), overs_text(c("balls")).alias("overs"), "year", c("match_title").alias("match"), "runs")
    return out.orderBy(c("runs").desc(), "match_id", "inning").limit(limit)


def highest_scores(a: Archive, limit: int = 5) -> DataFrame:
    out = batting_innings(a.d).select("match_id", "player_id", "player", "team", innings_text(c("runs"), c("is_out")).alias("score"), "runs", "balls", ratio(c("runs"), c("balls"), 100, 1).alias("sr"), "sixes", "year")
    return out.orderBy(c("runs").desc(), "balls", "match_id", "player_id").limit(limit)


def best_figures(a: Archive, limit: int = 5) -> DataFrame:
    out = bowling_innings(a.d).select("match_id", "inning", "player_id", "player", score_text(c("wickets"), c("conceded")).alias("figures"), overs_text(c("balls")).alias("overs"), "wickets", "conceded", "year")
    return out.orderBy(c("wickets").desc(), "conceded", "match_id", "inning", "player_id").limit(limit)


def fastest_to(a: Archive, runs: int = 50, limit: int = 5) -> DataFrame:
    """Fewest balls in which a batter reached `runs` in an innings."""
    w = Window.partitionBy("match_id", "inning", "batter_id").orderBy("sequence").rowsBetween(Window.unboundedPreceding, 0)
    x = a.d.select("match_id", "inning", "batter_id", "batter", "year", F.sum("runs_bat").over(w).alias("so_far"), F.sum(as_count(~c("is_wide"))).over(w).alias("faced"))
    out = x.filter(c("so_far") >= runs).groupBy("match_id", "inning", c("batter_id").alias("player_id")).agg(F.max("batter").alias("player"), F.min("faced").alias("balls"), F.max("year").alias("year"))
    return out.orderBy("balls", "year", "match_id", "inning", "player_id").limit(limit)


def most_sixes(a: Archive, limit: int = 5) -> DataFrame:
    out = batting_innings(a.d).select("match_id", "player_id", "player", "team", "sixes", innings_text(c("runs"), c("is_out")).alias("score"), "runs", "balls", "year")
    return out.orderBy(c("sixes").desc(), c("runs").desc(), "match_id", "player_id").limit(limit)


#: Innings-level counts that milestones can be set on.
COUNTS = {
    "runs": lambda: c("runs"), "fifties": lambda: as_count(c("runs").between(50, 99)), "hundreds": lambda: as_count(c("runs") >= 100), "sixes": lambda: c("sixes"),
    "fours": lambda: c("fours"), "ducks": lambda: as_count((c("runs") == 0) & c("is_out")), "wickets": lambda: c("wickets"),
}


def milestone_innings(a: Archive, stat: str, value: int, limit: int = 20) -> DataFrame:
    """Fewest innings in which a player came to `value` of a COUNTS statistic over the career."""
    inns = bowling_innings(a.d) if stat == "wickets" else batting_innings(a.d)
    inns = inns.join(a.matches.select("match_id", "start_date"), "match_id")
    w = Window.partitionBy("player_id").orderBy("start_date", "match_id", "inning")
    x = inns.select("player_id", "player", "start_date", F.row_number().over(w).cast("long").alias("nth"), F.sum(COUNTS[stat]()).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("so_far"))
    out = x.filter(c("so_far") >= value).groupBy("player_id").agg(F.max("player").alias("player"), F.min("nth").alias("innings"), F.min("start_date").alias("reached_on"))
    return out.orderBy("innings", "reached_on", "player_id").limit(limit)


def milestone_balls(a: Archive, value: int, limit: int = 20) -> DataFrame:
    """Fewest legal balls in which a bowler came to `value` wickets over the career."""
    # Careers run over matches; only the match in which the value is reached is walked ball by ball.
    legal, taken = as_count(c("is_legal")), as_count(c("bowler_wicket"))
    games = a.d.groupBy("bowler_id", "start_date", "match_id").agg(F.sum(legal).alias("b"), F.sum(taken).alias("w"))
    before = Window.partitionBy("bowler_id").orderBy("start_date", "match_id").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda x: F.coalesce(F.sum(x).over(before), F.lit(0))
    games = games.withColumns({"b0": zero("b"), "w0": zero("w")}).filter((c("w0") < value) & (c("w0") + c("w") >= value))
    w = Window.partitionBy("bowler_id", "match_id").orderBy("sequence").rowsBetween(Window.unboundedPreceding, 0)
    last = a.d.join(games.select("bowler_id", "match_id", "b0", "w0"), ["bowler_id", "match_id"])
    x = last.select("bowler_id", "bowler", "start_date", (c("b0") + F.sum(legal).over(w)).alias("bowled"), (c("w0") + F.sum(taken).over(w)).alias("taken"))
    out = x.filter(c("taken") >= value).groupBy(c("bowler_id").alias("player_id")).agg(F.max("bowler").alias("player"), F.min("bowled").alias("balls"), F.min("start_date").alias("reached_on"))
    return out.orderBy("balls", "reached_on", "player_id").limit(limit)


def nth_match(a: Archive, player: int, nth: int) -> DataFrame:
    """The nth match in which the player batted or bowled, and the figures in it (role batting or bowling)."""
    bat = batting_innings(a.d).filter(c("player_id") == player).select("match_id", F.lit("batting").alias("role"), c("runs").cast("string").alias("figures"), "balls", "fours", "sixes")
    none = F.lit(None).cast("long")
    bowl = bowling_innings(a.d).filter(c("player_id") == player).select("match_id", F.lit("bowling").alias("role"), score_text(c("wickets"), c("conceded")).alias("figures"), "balls", none.alias("fours"), none.alias("sixes"))
    both = bat.unionByName(bowl)
    games = both.select("match_id").distinct().join(_listed(a.matches), "match_id")
    games = games.withColumn("n", F.row_number().over(Window.partitionBy(F.lit(player)).orderBy("start_date", "match_id")).cast("long"))  # one player's matches
    return games.filter(c("n") == nth).join(both, "match_id").orderBy("role")


def match_batting(a: Archive, match: int, card: DataFrame | None = None) -> DataFrame:
    """Batting card of a match: the official dismissal text (card: inning, player_id, dismissal, position) or one built from the balls."""
    d = a.d.filter(c("match_id") == match)
    how = d.filter("is_wicket").groupBy("inning", c("player_out_id").alias("player_id")).agg(F.max("dismissal_type").alias("kind"), F.max("bowler").alias("by"), F.bool_or("bowler_wicket").alias("credited"))
    out = batting_innings(d).join(how, ["inning", "player_id"], "left")
    text = F.when(c("kind").isNull(), "not out").when(c("credited"), F.concat(c("kind"), F.lit(" b "), c("by"))).otherwise(c("kind"))
    place = F.lit(99)
    if card is not None:
        out = out.join(card.select("inning", "player_id", c("dismissal").alias("official"), "position"), ["inning", "player_id"], "left")
        text, place = F.coalesce(c("official"), text), F.coalesce(c("position"), place)
    return out.withColumn("place", place).orderBy("inning", "place", c("first_ball").asc_nulls_last()).select("inning", "player", text.alias("dismissal"), "runs", "balls", "fours", "sixes", ratio(c("runs"), c("balls"), 100, 1).alias("sr"))


def match_bowling(a: Archive, match: int) -> DataFrame:
    """Bowling card of a match in order of first ball."""
    out = bowling_innings(a.d.filter(c("match_id") == match)).orderBy("inning", "first_ball")
    return out.select("inning", "player", overs_text(c("balls")).alias("overs"), "conceded", "wickets", ratio(c("conceded"), c("balls"), 6, 2).alias("econ"))


def match_phases(a: Archive, match: int) -> DataFrame:
    out = a.d.filter(c("match_id") == match).groupBy("inning", "phase").agg(F.sum("runs_total").alias("runs"), count_where(c("is_wicket")).alias("wkts"), ratio(F.sum("runs_total"), count_where(c("is_legal")), 6, 2).alias("run_rate"), count_where(c("is_four")).alias("fours"), count_where(c("is_six")).alias("sixes"))
    return out.orderBy("inning", phase_order(c("phase")))


def commentary_search(a: Archive, match: int | None = None, wanted: str = "", innings: int | None = None, width: int = 140, limit: int = 100) -> DataFrame:
    """Commentary lines with a text in them, cut to `width` characters (0: whole)."""
    x = a.d if a.commentary is None else a.commentary
    x = x.filter(c("match_id") == match) if match is not None else x
    x = x.filter(c("inning") == innings) if innings else x
    x = x.filter(contains_text(c("commentary"), wanted)) if wanted else x
    text = F.when(F.length("commentary") > width, F.concat(F.substring("commentary", 1, width), F.lit("..."))).otherwise(c("commentary")) if width else c("commentary")
    return x.orderBy("match_id", "sequence").select("match_id", "inning", "over_number", "sequence", text.alias("text")).limit(limit)

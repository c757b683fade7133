"""The delivery source: nested JSON match files to deliveries, match rows and match facts, by explode.

Files are split over tasks by Spark (one file is one row), dimensions such as the person register are joined, and all
steps are column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import as_count, initials, overs_text
from ..operators import chase
from .schemas import DELIVERY, MATCH_FILE, REGISTER

c = F.col
#: Kinds of dismissal credited to the bowler, kinds that are no wicket, codes of teams by full name.
BOWLER_KINDS = ("bowled", "caught", "caught and bowled", "lbw", "stumped", "hit wicket")
NO_WICKET = ("retired hurt", "retired not out")
TEAM_CODES = {
    "Chennai Super Kings": "CSK", "Deccan Chargers": "DCH", "Delhi Capitals": "DC", "Delhi Daredevils": "DD", "Gujarat Lions": "GL", "Gujarat Titans": "GT", "Kings XI Punjab": "KXIP", "Kochi Tuskers Kerala": "Kochi",
    "Kolkata Knight Riders": "KKR", "Lucknow Super Giants": "LSG", "Mumbai Indians": "MI", "Pune Warriors": "PWI", "Punjab Kings": "PBKS", "Rajasthan Royals": "RR", "Rising Pune Supergiant": "RPS",
    "Rising Pune Supergiants": "RPS", "Royal Challengers Bangalore": "RCB", "Royal Challengers Bengaluru": "RCB", "Sunrisers Hyderabad": "SRH",
}


def team_code(name: Column) -> Column:
    """Code of a team by its full name; initials of an unknown one; '' for none."""
    table = F.create_map(*(F.lit(x) for pair in TEAM_CODES.items() for x in pair))
    return F.when(F.coalesce(name, F.lit("")) == "", "").otherwise(F.coalesce(table[name], initials(name)))


def read_matches(spark: SparkSession, path: str) -> DataFrame:
    """match_id (from the file's numeric name), info, innings of all match files below a path."""
    df = spark.read.schema(MATCH_FILE).option("multiLine", True).option("pathGlobFilter", "*.json").json(path)
    stem = F.regexp_extract(c("_metadata.file_name"), r"^(\d+)\.json$", 1)
    return df.select(F.nullif(stem, F.lit("")).try_cast("long").alias("match_id"), "info", "innings").filter("match_id is not null")


def read_register(spark: SparkSession, path: str) -> DataFrame:
    """identifier, id: people whose second-source key is a number."""
    df = spark.read.schema(REGISTER).option("header", True).option("enforceSchema", False).csv(path)
    return df.filter(c("key_cricinfo").rlike(r"^\d+$")).select("identifier", c("key_cricinfo").cast("long").alias("id"))


def people(matches: DataFrame, register: DataFrame) -> DataFrame:
    """match_id, name, person_id: the register's id, else the negative of the hexadecimal identifier."""
    p = matches.select("match_id", F.explode("info.registry.people").alias("name", "identifier"))
    return p.join(register, "identifier", "left").select("match_id", "name", F.coalesce(c("id"), -F.conv("identifier", 16, 10).cast("long")).alias("person_id"))


def _with_ids(df: DataFrame, who: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Adds an id column for each name column."""
    for name, out in columns.items():
        df = df.join(who.select("match_id", c("name").alias(name), c("person_id").alias(out)), ["match_id", name], "left")
    return df


def _exploded(matches: DataFrame) -> DataFrame:
    """match_id, inning, over_number (from 1), position in the over (from 1), team, ball."""
    x = matches.select("match_id", F.posexplode("innings").alias("i", "inn"))
    x = x.select("match_id", (c("i") + 1).cast("long").alias("inning"), c("inn.team").alias("team"), F.explode("inn.overs").alias("o"))
    x = x.select("match_id", "inning", "team", (c("o.over") + 1).cast("long").alias("over_number"), F.posexplode("o.deliveries").alias("p", "ball"))
    x = x.withColumn("ball_in_over", (c("p") + 1).cast("long")).drop("p")
    return x.withColumn("sequence", c("inning") * 100000 + c("over_number") * 100 + c("ball_in_over"))


def _described() -> Column:
    plural = lambda n, word: F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n > 1, "s").otherwise(""))
    names = F.create_map(*(F.lit(x) for x in ("wides", "wide", "noballs", "no ball", "byes", "bye", "legbyes", "leg bye", "penalty", "penalty")))
    each = F.transform(F.map_entries("ball.extras"), lambda e: F.concat(e["value"].cast("string"), F.lit(" "), names[e["key"]], F.when((e["value"] > 1) & (e["key"] != "noballs"), "s").otherwise("")))
    bat = c("ball.runs.batter")
    extra = F.concat(F.array_join(each, ", "), F.when(bat > 0, F.concat(F.lit(", "), plural(bat, "run"))).otherwise(""))
    what = F.when(c("is_wicket"), "OUT").when(c("is_six"), "SIX").when(c("is_four"), "FOUR").when(F.size("ball.extras") > 0, extra).when(bat > 0, plural(bat, "run")).otherwise("no run")
    return F.concat(c("bowler"), F.lit(" to "), c("batter"), F.lit(", "), what)


def deliveries(matches: DataFrame, register: DataFrame) -> DataFrame:
    """The canonical fact table (schema DELIVERY)."""
    x = _exploded(matches)
    extra = lambda k: F.coalesce(F.try_element_at("ball.extras", F.lit(k)), F.lit(0)).cast("long")
    num = lambda k: F.coalesce(c(f"ball.runs.{k}"), F.lit(0)).cast("long")
    rope = ~F.coalesce(c("ball.runs.non_boundary"), F.lit(False))
    first = F.get("ball.wickets", F.lit(0))
    kind = F.lower(F.coalesce(first["kind"], F.lit("")))
    wicket = first.isNotNull() & ~kind.isin(*NO_WICKET)
    x = x.withColumns({"wide_runs": extra("wides"), "nb": extra("noballs"), "b0": extra("byes"), "legbye_runs": extra("legbyes"), "penalty_runs": extra("penalty"), "runs_bat": num("batter")})
    # Old files score a no-ball with byes as no-ball runs only: one is the no-ball, the rest are byes.
    old = (c("nb") > 1) & (c("runs_bat") == 0) & (c("b0") == 0) & (c("legbye_runs") == 0)
    x = x.withColumns({
        "noball_runs": F.when(old, F.lit(1)).otherwise(c("nb")).cast("long"), "bye_runs": F.when(old, c("nb") - 1).otherwise(c("b0")), "is_wide": c("wide_runs") > 0, "is_noball": c("nb") > 0, "is_legal": (c("wide_runs") == 0) & (c("nb") == 0),
        "is_four": (c("runs_bat") == 4) & rope, "is_six": (c("runs_bat") == 6) & rope, "is_wicket": wicket, "bowler_wicket": wicket & kind.isin(*BOWLER_KINDS), "dismissal_type": kind,
        "player_out": F.coalesce(first["player_out"], F.lit("")), "batter": F.coalesce(c("ball.batter"), F.lit("")), "bowler": F.coalesce(c("ball.bowler"), F.lit("")), "non_striker": F.coalesce(c("ball.non_striker"), F.lit("")),
        "runs_total": num("total"), "score_value": num("total"), "extras": num("extras"), "batting_team": team_code(c("team")),
    })
    sofar = F.sum(as_count(c("is_legal"))).over(Window.partitionBy("match_id", "inning", "over_number").orderBy("ball_in_over").rowsBetween(Window.unboundedPreceding, 0))
    label = F.concat((c("over_number") - 1).cast("string"), F.lit("."), (sofar + as_count(~c("is_legal"))).cast("string"))
    x = x.withColumns({"over_label": F.coalesce(F.nullif(c("ball.actual_delivery"), F.lit("")), label), "short_text": _described(), "commentary": F.lit("")})
    x = _with_ids(x, people(matches, register), {"batter": "batter_id", "bowler": "bowler_id", "player_out": "player_out_id"})
    return x.select(*(c(f.name).cast(f.dataType).alias(f.name) for f in DELIVERY))


def facts(matches: DataFrame, register: DataFrame) -> dict[str, DataFrame]:
    """info (toss, method), awards, fielding and subs; the last two carry the delivery's sequence."""
    who = people(matches, register)
    blank = lambda x: F.coalesce(c(x), F.lit(""))
    info = matches.select("match_id", team_code(c("info.toss.winner")).alias("toss_winner"), blank("info.toss.decision").alias("toss_decision"), blank("info.outcome.method").alias("method"))
    awards = _with_ids(matches.select("match_id", F.explode("info.player_of_match").alias("player")), who, {"player": "player_id"})
    x = _exploded(matches)
    w = x.select("match_id", "inning", "sequence", F.explode("ball.wickets").alias("w")).select("*", F.explode("w.fielders").alias("f")).filter("coalesce(f.name, '') <> ''")
    fielding = w.select("match_id", "inning", "sequence", c("f.name").alias("fielder"), F.coalesce("f.substitute", F.lit(False)).alias("substitute"), F.lower(blank("w.kind")).alias("kind"), blank("w.player_out").alias("player_out"))
    fielding = _with_ids(fielding, who, {"fielder": "fielder_id", "player_out": "player_out_id"})
    s = x.select("match_id", "inning", "sequence", F.explode("ball.replacements.match").alias("r"))
    subs = s.select("match_id", "inning", "sequence", team_code(c("r.team")).alias("team"), blank("r.in").alias("player_in"), blank("r.out").alias("player_out"), blank("r.reason").alias("reason"))
    subs = _with_ids(subs, who, {"player_in": "player_in_id", "player_out": "player_out_id"})
    return {"info": info, "awards": awards, "fielding": fielding, "subs": subs}


def match_rows(matches: DataFrame) -> DataFrame:
    """One row per match: teams, winner, result text, title, venue with city, date, season."""
    o = c("info.outcome")
    winner, method, eliminator, result = (F.coalesce(o[k], F.lit("")) for k in ("winner", "method", "eliminator", "result"))
    code, tie_code = team_code(winner), team_code(eliminator)
    unit = F.get(F.map_keys(o["by"]), F.lit(0))
    n = F.get(F.map_values(o["by"]), F.lit(0))
    margin = F.concat(code, F.lit(" won by "), n.cast("string"), F.lit(" "), F.when(n == 1, F.regexp_replace(unit, "s$", "")).otherwise(unit), F.when(method != "", F.concat(F.lit(" ("), method, F.lit(")"))).otherwise(""))
    plain = F.concat(code, F.lit(" won"), F.when(eliminator != "", " (Super Over)").otherwise(""))
    tie = F.concat(F.lit("Match tied"), F.when(eliminator != "", F.concat(F.lit(" ("), tie_code, F.lit(" won the Super Over)"))).otherwise(""))
    other = F.when(result != "", F.concat(F.upper(F.substring(result, 1, 1)), F.lower(F.substr(result, F.lit(2))))).otherwise("No result")
    text = F.when((winner != "") & (F.size(o["by"]) > 0), margin).when(winner != "", plain).when(result == "tie", tie).otherwise(other)
    event = c("info.event")
    title = F.coalesce(F.nullif(event["stage"], F.lit("")), F.concat(F.lit("Match "), event["match_number"].cast("string")), F.lit(""))
    venue, city = F.coalesce(c("info.venue"), F.lit("")), F.coalesce(c("info.city"), F.lit(""))
    team = lambda i: team_code(F.get("info.teams", F.lit(i)))
    return matches.select(
        "match_id", F.coalesce("info.season", F.lit("")).alias("season"), F.lit("").alias("series_path"), F.lit("").alias("match_path"), title.alias("title"), F.get("info.dates", F.lit(0)).try_cast("date").alias("start_date"),
        F.when((city != "") & ~F.contains(venue, city), F.concat(venue, F.lit(", "), city)).otherwise(venue).alias("venue"), team(0).alias("team1"), team(1).alias("team2"),
        F.when(winner != "", code).when(result == "tie", tie_code).otherwise("").alias("winner"), text.alias("status_text"), F.lit("T20").alias("format"), F.lit("FINISHED").alias("stage"), F.lit(False).alias("is_cancelled"),
    )


def _heads(matches: DataFrame) -> DataFrame:
    """Innings that are no super over: match_id, at (place in the file), inning (place among them), team, stated, length."""
    x = matches.select("match_id", (F.lit(6) * F.coalesce(F.nullif("info.overs", F.lit(0)), F.lit(20))).alias("length"), F.posexplode("innings").alias("i", "inn"))
    x = x.filter(~F.coalesce("inn.super_over", F.lit(False))).select("match_id", (c("i") + 1).cast("long").alias("at"), "length", team_code(c("inn.team")).alias("team"), c("inn.target.runs").cast("long").alias("stated"))
    return x.withColumn("inning", F.row_number().over(Window.partitionBy("match_id").orderBy("at")).cast("long"))


def scorecards_with_targets(matches: DataFrame, balls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Innings (runs, wickets, overs, balls, extras, fours, sixes, target) and overs (with what is required) of match files.

    Super overs are left out.  balls: as `deliveries` returns them.  The target is the file's, else the first innings' runs
    plus one; the first innings has none.
    """
    heads = _heads(matches)
    d = balls.withColumnRenamed("inning", "at").join(heads, ["match_id", "at"])
    sums = d.groupBy("match_id", "inning").agg(
        F.sum("runs_total").alias("runs"), F.count_if("is_wicket").alias("wickets"), F.count_if("is_legal").alias("balls"), F.sum("extras").alias("extras"), F.count_if("is_four").alias("fours"), F.count_if("is_six").alias("sixes"),
    )
    inns = heads.select("match_id", "inning", "team", "stated", "length").join(sums, ["match_id", "inning"], "left").fillna(0, ["runs", "wickets", "balls", "extras", "fours", "sixes"])
    aims = chase.targets(inns, c("stated")).join(inns.select("match_id", "inning", "length"), ["match_id", "inning"])
    overs = chase.requirements(d, aims, c("length"))
    card = inns.join(aims.drop("length"), ["match_id", "inning"]).withColumn("overs", overs_text(c("balls")))
    return card.select("match_id", "inning", "team", "runs", "wickets", "overs", "balls", "extras", "fours", "sixes", "target"), overs


def archive_index(matches: DataFrame, register: DataFrame) -> DataFrame:
    """One row for each match file, all that a list of matches shows; write it partitioned by season and look up by filter."""
    card, _ = scorecards_with_targets(matches, deliveries(matches, register))
    rows = F.array_sort(F.collect_list(F.struct("inning", "team", "runs", "wickets", "overs")))
    inns = card.groupBy("match_id").agg(F.transform(rows, lambda x: x.dropFields("inning")).alias("innings"))
    toss = F.when(F.coalesce("info.toss.winner", F.lit("")) == "", "Unavailable").otherwise(F.concat(team_code(c("info.toss.winner")), F.lit(" won the toss and chose to "), F.coalesce("info.toss.decision", F.lit(""))))
    text = match_rows(matches).select("match_id", c("status_text").alias("result"), c("title").alias("stage"))
    out = matches.select(
        "match_id", F.concat(c("match_id").cast("string"), F.lit(".json")).alias("file"), F.substring(F.get("info.dates", F.lit(0)), 1, 4).try_cast("long").alias("season"), "info.dates", "info.teams", F.coalesce("info.venue", F.lit("")).alias("venue"),
        F.coalesce("info.city", F.lit("")).alias("city"), c("info.outcome.winner").alias("winner"), toss.alias("toss"), "info.player_of_match",
    )
    return out.join(text, "match_id").join(inns, "match_id", "left")


def load(spark: SparkSession, path: str, register_path: str):
    """An Archive over a folder of match files."""
    from ..operators.innings import display_names, enriched
    from ..plans.archive import Archive

    files, register = read_matches(spark, path), read_register(spark, register_path)
    rows = match_rows(files).withColumn("year", F.year("start_date").cast("long"))
    balls, extra = deliveries(files, register), facts(files, register)
    names = display_names(balls.select(c("batter_id").alias("player_id"), c("batter").alias("name")).union(balls.select("bowler_id", "bowler")))
    return Archive(enriched(balls, rows, names), rows, extra["info"], extra["awards"], extra["subs"], None, None)

"""The second source: play-by-play items with commentary, official cards, player styles."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import keep_last
from .schemas import CARD_PAGE, MATCH_ENTRY, PLAY_ITEM, SCORECARD

c = F.col
#: Codes and words of bowling styles.
PACE_CODES = ("rf", "rfm", "rmf", "rm", "lf", "lfm", "lmf", "lm", "rsm", "lsm")
SPIN_CODES = ("ob", "lb", "lbg", "sla", "slc", "lws", "rob", "lbs")
SPIN_WORDS = ("offbreak", "legbreak", "googly", "orthodox", "wrist-spin", "wrist spin", "chinaman", "slow left-arm")
#: Names under which feeds give a fall's score, number, over and player, in order of preference.
FALL_SCORE = ("score", "teamScore", "runs", "totalRuns", "fowRuns", "fowScore")
WICKET_SCORE = ("score", "teamScore", "runs", "totalRuns", "inningRuns")
FALL_NUMBER = ("wicketNumber", "wicketNum", "wickets", "fowWicketNum")
WICKET_NUMBER = ("wicketNumber", "wicketNum", "wickets")
FALL_OVERS, WICKET_OVERS = ("overs", "over", "fowOvers"), ("overs", "over", "ballOvers")
FALL_PLAYER = ("player", "athlete", "batsman", "dismissedBatsman")
PLAYER_NAME, FLAT_NAME = ("longName", "displayName", "name"), ("playerName", "batterName", "dismissedPlayer")
FALL_TEXT, TEXT_PARTS = ("dismissalText", "dismissalComment"), ("long", "commentary", "short")


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of all feeds below a path, one JSON object a line."""
    return spark.read.schema(PLAY_ITEM).json(path)


def _number(x: Column) -> Column:
    return F.coalesce(x, F.lit(0)).cast("long")


def _id(person: str) -> Column:
    raw = c(f"{person}.athlete.id")
    return F.when(raw.rlike(r"^\d+$"), raw.cast("long"))


def _name(person: str) -> Column:
    return F.coalesce(F.nullif(c(f"{person}.athlete.displayName"), F.lit("")), c(f"{person}.athlete.name"), F.lit(""))


def deliveries(items: DataFrame) -> DataFrame:
    """Items to balls: placeholders out, the last of items with the same id, extras from the score where parts are missing."""
    x = items.filter((_number(c("over.ball")) != 0) | (F.trim(F.coalesce("shortText", F.lit(""))) != ""))
    x = keep_last(x, ["match_id", "id"], [c("sequence").desc(), F.to_json(F.struct("*")).desc()])
    play = F.lower(F.coalesce("playType.description", F.lit("")))
    score, bat = _number(c("scoreValue")), _number(c("batsman.runs"))
    parts = {k: _number(c(f"over.{k}")) for k in ("wide", "noBall", "byes", "legByes")}
    missing = (sum(parts.values(), F.lit(0)) == 0) & (score > bat)
    own = lambda k, word: F.when(missing & (play == word), score - bat).otherwise(parts[k])
    kind = F.lower(F.coalesce("dismissal.type", F.lit("")))
    flagged = F.coalesce("dismissal.dismissal", F.lit(False))
    x = x.select(
        "match_id", F.coalesce(F.nullif("innings.number", F.lit(0)), c("period"), F.lit(0)).cast("long").alias("inning"), F.coalesce("sequence", F.lit(0)).alias("sequence"), c("over.number").cast("long").alias("over_number"), c("over.ball").cast("long").alias("ball_in_over"),
        F.coalesce(c("over.actual").cast("string"), F.lit("")).alias("over_label"), F.coalesce(F.nullif("team.abbreviation", F.lit("")), c("team.displayName"), F.lit("")).alias("batting_team"), _id("batsman").alias("batter_id"), _name("batsman").alias("batter"),
        _name("otherBatsman").alias("non_striker"), _id("bowler").alias("bowler_id"), _name("bowler").alias("bowler"), score.alias("score_value"), bat.alias("runs_bat"), own("wide", "wide").alias("wide_runs"), own("noBall", "no ball").alias("noball_runs"),
        own("byes", "bye").alias("bye_runs"), own("legByes", "leg bye").alias("legbye_runs"), play.alias("__play"), (flagged & ~kind.startswith("retired not out")).alias("is_wicket"), F.coalesce("dismissal.bowled", F.lit(False)).alias("__bowled"),
        F.coalesce("dismissal.type", F.lit("")).alias("dismissal_type"), F.when(flagged, _id("dismissal.batsman")).alias("player_out_id"), F.when(flagged, _name("dismissal.batsman")).otherwise("").alias("player_out"),
        F.coalesce("shortText", F.lit("")).alias("short_text"), F.coalesce("text", F.lit("")).alias("commentary"),
    )
    extras = c("wide_runs") + c("noball_runs") + c("bye_runs") + c("legbye_runs")
    wide, noball = (c("wide_runs") > 0) | (c("__play") == "wide"), (c("noball_runs") > 0) | (c("__play") == "no ball")
    return x.withColumns({
        "extras": extras, "runs_total": c("runs_bat") + extras, "is_wide": wide, "is_noball": noball, "is_legal": ~wide & ~noball, "is_four": c("__play") == "four", "is_six": c("__play") == "six", "bowler_wicket": c("is_wicket") & c("__bowled"),
    }).drop("__play", "__bowled")


def read_cards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCORECARD).json(path)


def official_cards(cards: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Innings, batting (who did not bat is left out) and bowling rows of official cards."""
    x = cards.select("match_id", F.posexplode("content.innings").alias("i", "inn")).withColumn("inning", F.coalesce("inn.inningNumber", c("i") + 1).cast("long"))
    fields = ("runs", "wickets", "balls", "extras", "byes", "legbyes", "wides", "noballs", "penalties")
    inns = x.select("match_id", "inning", F.coalesce(F.nullif("inn.team.abbreviation", F.lit("")), c("inn.team.name"), F.lit("")).alias("team"), *(c(f"inn.{f}").alias(f) for f in fields), (F.coalesce("inn.isSuperOver", F.lit(False)) | (c("inning") > 2)).alias("is_super_over"))
    name = lambda p: F.coalesce(F.nullif(c(f"{p}.longName"), F.lit("")), c(f"{p}.name"), F.lit("")).alias("player")
    b = x.select("match_id", "inning", F.posexplode("inn.inningBatsmen").alias("p", "b")).filter("b.runs is not null")
    text = F.coalesce(F.nullif("b.dismissalText.long", F.lit("")), c("b.dismissalText.short"), F.lit(""))
    batting = b.select("match_id", "inning", (c("p") + 1).cast("long").alias("position"), c("b.player.objectId").alias("player_id"), name("b.player"), c("b.runs").alias("runs"), c("b.balls").alias("balls"), c("b.fours").alias("fours"), c("b.sixes").alias("sixes"), F.coalesce("b.isOut", F.lit(False)).alias("is_out"), F.trim(text).alias("dismissal"))
    w = x.select("match_id", "inning", F.explode("inn.inningBowlers").alias("w")).filter("w.balls is not null or w.overs is not null")
    bowling = w.select("match_id", "inning", c("w.player.objectId").alias("player_id"), name("w.player"), *(c(f"w.{f}").alias(f) for f in ("balls", "conceded", "wickets", "wides", "noballs", "dots")))
    return inns, batting, bowling


def styles(cards: DataFrame) -> DataFrame:
    """player_id, name, bat_hand, bowl_style, bowl_kind, bowl_arm of every player on the cards."""
    players = F.concat(F.transform("inn.inningBatsmen", lambda b: b["player"]), F.transform("inn.inningBowlers", lambda b: b["player"]))
    p = cards.select(F.explode("content.innings").alias("inn")).select(F.explode(players).alias("p")).select("p.*").filter("objectId is not null and battingStyles is not null")
    p = keep_last(p, ["objectId"], [F.to_json(F.struct("*")).desc()])  # the same one of several on every run
    return classified(p).select(c("objectId").alias("player_id"), F.coalesce("longName", "name", F.lit("")).alias("name"), "bat_hand", "bowl_style", "bowl_kind", "bowl_arm")


def classified(p: DataFrame) -> DataFrame:
    """Adds hand, style, kind and arm: from the long text where there is one, else from the code."""
    words = F.lower(F.array_join(F.coalesce(F.nullif("longBattingStyles", F.array().cast("array<string>")), c("battingStyles"), F.array().cast("array<string>")), " "))
    hand = F.when(words.rlike("left|lhb"), "left").when(words.rlike("right|rhb"), "right").otherwise("")
    style = F.lower(F.coalesce(F.get("longBowlingStyles", F.lit(0)), F.lit("")))
    code = F.lower(F.coalesce(F.get("bowlingStyles", F.lit(0)), F.lit("")))
    kind = F.when(style.rlike("|".join(SPIN_WORDS)), "spin").when(style.rlike("fast|medium"), "pace").otherwise("")
    arm = F.when(F.contains(style, F.lit("left-arm")), "left").when(F.contains(style, F.lit("right-arm")) | (kind == "spin"), "right").otherwise("")
    code_kind = F.when(code.isin(*SPIN_CODES), "spin").when(code.isin(*PACE_CODES), "pace").otherwise("")
    code_arm = F.when(code.rlike("^(l|sla|slc)") & ~code.isin("lb", "lbg", "lbs"), "left").when(code != "", "right").otherwise("")
    long = style != ""
    return p.withColumns({"bat_hand": hand, "bowl_style": F.when(long, style).otherwise(code), "bowl_kind": F.when(long, kind).otherwise(code_kind), "bowl_arm": F.when(long, arm).otherwise(code_arm)})


def styles_anywhere(texts: DataFrame, text: str = "value", order: str = "path") -> DataFrame:
    """As `styles`, from JSON of any shape: every object with battingStyles and a numeric objectId, however deep it lies.

    Of several objects of one player the last in the last text (by `order`) counts; a text that is no JSON has none.
    """

    def players(node: object) -> Iterator[dict]:
        if isinstance(node, dict):
            if "battingStyles" in node and str(node.get("objectId") or "").isdigit():
                yield {"objectId": int(node["objectId"]), **{k: node.get(k) for k in ("longName", "name", "battingStyles", "longBattingStyles", "bowlingStyles", "longBowlingStyles")}}
            node = list(node.values())
        if isinstance(node, list):
            for part in node:
                yield from players(part)

    fields = "objectId bigint, longName string, name string, battingStyles array<string>, longBattingStyles array<string>, bowlingStyles array<string>, longBowlingStyles array<string>"

    @F.udf(f"array<struct<{fields.replace(' ', ':').replace(',:', ',')}>>", useArrow=True)
    def found(raw: str | None) -> list[dict]:
        try:
            return list(players(json.loads(raw or "null")))
        except ValueError:
            return []

    p = texts.select(c(order).alias("__text"), F.posexplode(found(c(text))).alias("__at", "p")).select("__text", "__at", "p.*")
    p = keep_last(p, ["objectId"], [c("__text").desc(), c("__at").desc()])
    name = F.coalesce(F.nullif("longName", F.lit("")), c("name"), F.lit("")).alias("name")
    return classified(p).select(c("objectId").alias("player_id"), name, "bat_hand", "bowl_style", "bowl_kind", "bowl_arm")


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """Entries of season lists below a path, one JSON object a line, with season and series_path."""
    return spark.read.schema(MATCH_ENTRY).json(path)


def _first_named(*candidates: Column) -> Column:
    """The first that is neither null nor empty, else ''."""
    return F.coalesce(*(F.nullif(x, F.lit("")) for x in candidates), F.lit(""))


def ingestable() -> Column:
    """Whether a list's entry is a finished match of the format that was not cancelled."""
    finished = F.coalesce(c("stage") == "FINISHED", F.lit(False)) | F.coalesce(c("state") == "POST", F.lit(False))
    return (F.upper(F.coalesce("format", F.lit(""))) == "T20") & ~F.coalesce("isCancelled", F.lit(False)) & finished


def match_entries(entries: DataFrame) -> DataFrame:
    """Match rows of the second source, all entries; filter with `ingestable()` before."""
    team = lambda i: _first_named(*(F.get("teams", F.lit(i))["team"][k] for k in ("abbreviation", "name", "longName")))
    won = F.filter(F.coalesce("teams", F.array()), lambda t: t["team"]["id"] == c("winnerTeamId"))
    last = F.get(won, F.size(won) - 1)["team"]
    blank = lambda x: F.coalesce(c(x), F.lit("")).alias(x)
    return entries.select(
        c("objectId").alias("match_id"), blank("season"), blank("series_path"), F.concat_ws("-", F.coalesce("slug", F.lit("None")), c("objectId").cast("string")).alias("match_path"), blank("title"),
        F.substring("startDate", 1, 10).try_cast("date").alias("start_date"), _first_named(c("ground.longName"), c("ground.name")).alias("venue"), team(0).alias("team1"), team(1).alias("team2"),
        _first_named(last["abbreviation"], last["name"]).alias("winner"), F.coalesce("statusText", F.lit("")).alias("status_text"), blank("format"), blank("stage"), F.coalesce("isCancelled", F.lit(False)).alias("is_cancelled"),
    )


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CARD_PAGE).json(path)


def _page_innings(pages: DataFrame) -> DataFrame:
    x = pages.select("match_id", F.posexplode("content.innings").alias("i", "inn"))
    return x.select("match_id", F.coalesce("inn.inningNumber", c("i") + 1).cast("long").alias("inning"), "inn")


def feed_overs(pages: DataFrame) -> DataFrame:
    """The feed's own overs: runs, totals, rates, what is required, win probability of the side that bats, projected score."""
    x = _page_innings(pages).select("match_id", "inning", _first_named(c("inn.team.abbreviation"), c("inn.team.name"), c("inn.team.longName")).alias("team"), F.explode("inn.inningOvers").alias("o"))
    names = {"overNumber": "over_number", "overRuns": "runs", "overWickets": "wickets", "totalRuns": "total", "totalWickets": "down", "overRunRate": "run_rate", "requiredRuns": "required", "requiredRunRate": "required_rate", "remainingBalls": "balls_left"}
    return x.select("match_id", "inning", "team", *(c(f"o.{k}").alias(v) for k, v in names.items()), c("o.predictions.winProbability").alias("win_prob"), c("o.predictions.score").alias("projected"))


def _told(raw: Column, names: tuple[str, ...]) -> Column:
    """The first of the names in a map that says something (null, '', 0 and false do not)."""
    value = lambda k: F.try_element_at(raw, F.lit(k))
    return F.coalesce(*(F.when(~value(k).isin("", "0", "0.0", "false", "{}", "[]"), value(k)) for k in names))


def _parts(text: Column) -> Column:
    return F.from_json(F.when(text.startswith("{"), text), "map<string,string>")


def merged_falls(pages: DataFrame) -> DataFrame:
    """Falls of wickets joined with the list of wickets by position: score, wicket, overs, batter, dismissal.

    What neither list tells is '-' (score, overs), the position (wicket), 'Unknown' (batter) or '' (dismissal).
    """
    x = _page_innings(pages).select("match_id", "inning", c("inn.inningWickets").alias("wickets"), F.posexplode("inn.inningFallOfWickets").alias("at", "fall"))
    x = x.withColumn("w", F.get("wickets", c("at")))
    either = lambda a, b: F.coalesce(_told(c("fall"), a), _told(c("w"), b))
    player = lambda raw: F.coalesce(_told(_parts(_told(raw, FALL_PLAYER)), PLAYER_NAME), _told(raw, FLAT_NAME))
    text = F.coalesce(_told(c("w"), FALL_TEXT), _told(c("fall"), FALL_TEXT), F.lit(""))
    said = F.when(text.startswith("{"), F.coalesce(_told(_parts(text), TEXT_PARTS), F.lit(""))).otherwise(text)
    return x.select(
        "match_id", "inning", (c("at") + 1).cast("long").alias("position"), F.coalesce(either(FALL_SCORE, WICKET_SCORE), F.lit("-")).alias("score"), F.coalesce(either(FALL_NUMBER, WICKET_NUMBER).try_cast("long"), c("at") + 1).cast("long").alias("wicket"),
        F.coalesce(either(FALL_OVERS, WICKET_OVERS), F.lit("-")).alias("overs"), F.coalesce(player(c("w")), player(c("fall")), F.lit("Unknown")).alias("batter"), said.alias("dismissal"),
    )

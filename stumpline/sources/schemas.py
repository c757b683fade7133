"""Explicit schemas of the sources; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

_STR, _LONG, _INT, _BOOL = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k.rstrip("_"), v) for k, v in fields.items()])


_DELIVERY = _struct(
    batter=_STR, bowler=_STR, non_striker=_STR, actual_delivery=_STR, runs=_struct(batter=_INT, extras=_INT, total=_INT, non_boundary=_BOOL), extras=T.MapType(_STR, _INT),
    wickets=T.ArrayType(_struct(player_out=_STR, kind=_STR, fielders=T.ArrayType(_struct(name=_STR, substitute=_BOOL)))),
    replacements=_struct(match=T.ArrayType(T.StructType([T.StructField(x, _STR) for x in ("team", "in", "out", "reason")]))),
)
#: One match file of the delivery source.
MATCH_FILE = _struct(
    info=_struct(
        dates=T.ArrayType(_STR), season=_STR, overs=_INT, venue=_STR, city=_STR, teams=T.ArrayType(_STR), event=_struct(stage=_STR, match_number=_INT), toss=_struct(winner=_STR, decision=_STR),
        outcome=_struct(winner=_STR, by=T.MapType(_STR, _INT), result=_STR, eliminator=_STR, method=_STR), player_of_match=T.ArrayType(_STR), registry=_struct(people=T.MapType(_STR, _STR)),
    ),
    meta=_struct(data_version=_STR),
    innings=T.ArrayType(_struct(team=_STR, super_over=_BOOL, target=_struct(runs=_INT), overs=T.ArrayType(_struct(over=_INT, deliveries=T.ArrayType(_DELIVERY))))),
)
REGISTER = _struct(identifier=_STR, name=_STR, key_cricinfo=_STR)

_PERSON = _struct(athlete=_struct(id=_STR, displayName=_STR, name=_STR), runs=_INT)
#: One item of the second source's play-by-play feed.
PLAY_ITEM = _struct(
    match_id=_LONG, id=_STR, sequence=_LONG, scoreValue=_INT, shortText=_STR, text=_STR, period=_INT, playType=_struct(description=_STR), team=_struct(abbreviation=_STR, displayName=_STR), innings=_struct(number=_INT),
    over=_struct(number=_INT, ball=_INT, actual=T.DoubleType(), wide=_INT, noBall=_INT, byes=_INT, legByes=_INT), batsman=_PERSON, otherBatsman=_PERSON, bowler=_PERSON, dismissal=_struct(dismissal=_BOOL, bowled=_BOOL, type=_STR, batsman=_PERSON),
)

_CARD_PLAYER = _struct(objectId=_LONG, longName=_STR, name=_STR, battingStyles=T.ArrayType(_STR), longBattingStyles=T.ArrayType(_STR), bowlingStyles=T.ArrayType(_STR), longBowlingStyles=T.ArrayType(_STR))
#: The official card of a match.
SCORECARD = _struct(
    match_id=_LONG,
    content=_struct(
        innings=T.ArrayType(_struct(
            inningNumber=_INT, team=_struct(abbreviation=_STR, name=_STR), runs=_LONG, wickets=_LONG, balls=_LONG, extras=_LONG, byes=_LONG, legbyes=_LONG, wides=_LONG, noballs=_LONG, penalties=_LONG, isSuperOver=_BOOL,
            inningBatsmen=T.ArrayType(_struct(player=_CARD_PLAYER, runs=_LONG, balls=_LONG, fours=_LONG, sixes=_LONG, isOut=_BOOL, dismissalText=_struct(long=_STR, short=_STR))),
            inningBowlers=T.ArrayType(_struct(player=_CARD_PLAYER, balls=_LONG, overs=T.DoubleType(), conceded=_LONG, wickets=_LONG, wides=_LONG, noballs=_LONG, dots=_LONG)),
        ))
    ),
)

_RAW = T.MapType(_STR, _STR)
#: An official card's page with overs, win probability and wickets; falls and wickets keep whatever names a feed gives them.
CARD_PAGE = _struct(
    match_id=_LONG,
    content=_struct(
        innings=T.ArrayType(_struct(
            inningNumber=_INT, team=_struct(abbreviation=_STR, name=_STR, longName=_STR), inningFallOfWickets=T.ArrayType(_RAW), inningWickets=T.ArrayType(_RAW),
            inningOvers=T.ArrayType(_struct(
                overNumber=_LONG, overRuns=_LONG, overWickets=_LONG, totalRuns=_LONG, totalWickets=_LONG, overRunRate=T.DoubleType(), requiredRuns=_LONG, requiredRunRate=T.DoubleType(), remainingBalls=_LONG,
                predictions=_struct(winProbability=T.DoubleType(), score=T.DoubleType()),
            )),
        ))
    ),
)
_TEAM = _struct(id=_LONG, abbreviation=_STR, name=_STR, longName=_STR)
#: One entry of the second source's list of a season's matches.
MATCH_ENTRY = _struct(
    objectId=_LONG, slug=_STR, title=_STR, startDate=_STR, ground=_struct(longName=_STR, name=_STR), teams=T.ArrayType(_struct(team=_TEAM)), winnerTeamId=_LONG, statusText=_STR, format=_STR, stage=_STR, state=_STR, isCancelled=_BOOL,
    season=_STR, series_path=_STR,
)

#: The canonical fact table: one row per ball.
DELIVERY = T.StructType(
    [T.StructField(x, _LONG) for x in ("match_id", "inning", "sequence", "over_number", "ball_in_over")]
    + [T.StructField("over_label", _STR), T.StructField("batting_team", _STR), T.StructField("batter_id", _LONG), T.StructField("batter", _STR), T.StructField("non_striker", _STR), T.StructField("bowler_id", _LONG), T.StructField("bowler", _STR)]
    + [T.StructField(x, _LONG) for x in ("runs_total", "score_value", "runs_bat", "extras", "wide_runs", "noball_runs", "bye_runs", "legbye_runs", "penalty_runs")]
    + [T.StructField(x, _BOOL) for x in ("is_legal", "is_wide", "is_noball", "is_four", "is_six", "is_wicket", "bowler_wicket")]
    + [T.StructField("dismissal_type", _STR), T.StructField("player_out_id", _LONG), T.StructField("player_out", _STR), T.StructField("short_text", _STR), T.StructField("commentary", _STR)]
)

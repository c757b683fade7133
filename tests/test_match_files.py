"""A made-up match through the loader: every scoring rule, then the invariants between views."""

import json

import pytest
from pyspark.sql import functions as F

from stumpline.operators import families, innings, match_flow, records, results
from stumpline.plans.slices import SliceSpec, slice_stats
from stumpline.sources import match_files

A, B = "Mumbai Indians", "Royal Challengers Bangalore"


def ball(batter, bowler, bat=0, extras=None, other="Zed", wickets=None, **more):
    extras = extras or {}
    return {"batter": batter, "bowler": bowler, "non_striker": other, "runs": {"batter": bat, "extras": sum(extras.values()), "total": bat + sum(extras.values()), **more.pop("runs", {})}, **({"extras": extras} if extras else {}), **({"wickets": wickets} if wickets else {}), **more}


def out(player, kind, *fielders):
    return [{"player_out": player, "kind": kind, "fielders": [{"name": f} for f in fielders]}]


def match(date, winner=A, **outcome):
    first = [
        {"over": 0, "deliveries": [ball("Ann", "Bob", extras={"byes": 1})] + [ball("Ann", "Bob") for _ in range(5)]},  # maiden with a bye
        {"over": 1, "deliveries": [ball("Ann", "Cid", extras={"wides": 1}), ball("Ann", "Cid", 1, {"noballs": 1}), ball("Ann", "Cid", 4, runs={"non_boundary": True}), ball("Ann", "Cid", 4), ball("Ann", "Cid", 6), ball("Ann", "Cid", extras={"legbyes": 1}), ball("Ann", "Cid", extras={"noballs": 5}), ball("Ann", "Cid", extras={"penalty": 5}), ball("Ann", "Cid")]},
        {"over": 2, "deliveries": [ball("Ann", "Bob", wickets=out("Zed", "run out", "Eve")), ball("Ann", "Bob", wickets=out("Ann", "caught", "Eve")), ball("Fay", "Bob", wickets=out("Fay", "retired hurt")), ball("Gus", "Bob", wickets=out("Gus", "retired out"))]},
        {"over": 6, "deliveries": [ball("Hal", "Cid", wickets=out("Hal", "bowled")), ball("Ivy", "Cid", wickets=out("Ivy", "lbw")), ball("Jon", "Cid", wickets=out("Jon", "stumped", "Eve")), *(ball("Kim", "Cid", 1) for _ in range(4))]},
    ]
    second = [{"over": 0, "deliveries": [ball("Bob", "Ann", 6, replacements={"match": [{"team": B, "in": "Sub", "out": "Cid", "reason": "impact_player"}]}), *(ball("Bob", "Ann", 4) for _ in range(5))]}]
    people = {n: f"{i:08x}" for i, n in enumerate("Ann Bob Cid Eve Fay Gus Hal Ivy Jon Kim Zed".split(), 1)}
    return {
        "info": {"dates": [date], "season": "2024", "venue": "Feroz Shah Kotla", "city": "Delhi", "teams": [A, B], "event": {"stage": "Final"}, "toss": {"winner": A, "decision": "bat"}, "outcome": {"winner": winner, "by": {"runs": 1}, **outcome}, "player_of_match": ["Ann"], "registry": {"people": people}},
        "innings": [{"team": A, "overs": first}, {"team": B, "overs": second}, {"team": A, "super_over": True, "overs": second}],
    }


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    home = tmp_path_factory.mktemp("matches")
    for name, m in {"101": match("2024-05-26"), "102": match("2024-05-27", method="D/L"), "notes": {}}.items():
        (home / f"{name}.json").write_text(json.dumps(m))
    register = tmp_path_factory.mktemp("register") / "people.csv"
    register.write_text("identifier,name,key_cricinfo\n00000001,Ann,7001\n00000002,Bob,7002\n00000003,Cid,\n")
    return match_files.load(spark, str(home), str(register))


def one(df, **keys):
    for k, v in keys.items():
        df = df.filter(F.col(k) == v)
    return df.collect()[0]


def test_scoring_rules(archive):
    d = archive.d.filter("match_id = 101")
    assert d.count() == 26 + 6 and d.filter("inning > 2").count() == 0
    old = one(d, sequence=100207)
    assert (old.noball_runs, old.bye_runs, old.bowler_runs) == (1, 4, 1)
    assert not one(d, sequence=100203).is_four and one(d, sequence=100204).is_four
    assert one(d, sequence=100208).bowler_runs == 0
    assert [r.is_wicket for r in d.filter("over_number = 3").orderBy("sequence").collect()] == [True, True, False, True]
    assert [r.bowler_wicket for r in d.filter("over_number = 3").orderBy("sequence").collect()] == [False, True, False, False]
    assert one(d, sequence=100101).over_label == "0.1" and one(d, sequence=100201).over_label == "1.1" and one(d, sequence=100203).over_label == "1.1"
    assert {r.ground for r in d.collect()} == {"Arun Jaitley Stadium"} and one(d, sequence=100701).phase == "middle"
    assert one(d, sequence=100201).bowler_id == -3 and one(d, sequence=100201).batter_id == 7001
    assert one(d, sequence=100201).short_text == "Cid to Ann, 1 wide" and one(d, sequence=100205).short_text == "Cid to Ann, SIX"


def test_match_rows_and_facts(archive):
    rows = {r.match_id: r for r in archive.matches.collect()}
    assert set(rows) == {101, 102}
    assert rows[101].status_text == "MI won by 1 run" and rows[102].status_text == "MI won by 1 run (D/L)"
    assert rows[101].venue == "Feroz Shah Kotla, Delhi" and rows[101].title == "Final" and (rows[101].team1, rows[101].team2) == ("MI", "RCB")
    assert [(r.team, r.player_in, r.player_in_id, r.sequence) for r in archive.subs.filter("match_id = 101 and inning = 2").collect()] == [("RCB", "Sub", None, 200101)]
    assert one(archive.awards, match_id=101).player_id == 7001
    assert one(archive.info, match_id=102).method == "D/L"


def test_innings_of_a_run_out_without_a_ball(archive):
    zed = one(innings.batting_innings(archive.d), match_id=101, player="Zed")
    assert (zed.runs, zed.balls, zed.is_out) == (0, 0, True)


def test_invariants(archive):
    d = archive.d
    totals = {(r.match_id, r.inning): r for r in innings.innings_totals(d).collect()}
    bat = {(r.match_id, r.inning): r.s for r in innings.batting_innings(d).groupBy("match_id", "inning").agg(F.sum("runs").alias("s")).collect()}
    bowl = {(r.match_id, r.inning): r.s for r in innings.bowling_innings(d).groupBy("match_id", "inning").agg(F.sum("conceded").alias("s")).collect()}
    stands = {(r.match_id, r.inning): r.s for r in innings.partnerships(d).groupBy("match_id", "inning").agg(F.sum("runs").alias("s")).collect()}
    penalties = {(r.match_id, r.inning): r.s for r in d.groupBy("match_id", "inning").agg(F.sum("penalty_runs").alias("s")).collect()}
    for k, t in totals.items():
        parts = d.filter((F.col("match_id") == k[0]) & (F.col("inning") == k[1])).agg(F.sum("runs_total") - F.sum("runs_bat")).first()[0]
        assert bat[k] + parts == t.runs == stands[k]
        assert bowl[k] + t.byes + t.legbyes + penalties[k] == t.runs


def test_hat_trick_maiden_and_fall(archive):
    assert [(r.match_id, r.bowler) for r in families.hat_tricks(archive).orderBy("match_id").collect()] == [(101, "Cid"), (102, "Cid")]
    assert [(r.match_id, r.player_id) for r in match_flow.maidens(archive.d).filter("inning = 1 and match_id = 101").collect()] == [(101, 7002)]
    falls = match_flow.fall_of_wickets(archive.d).filter("match_id = 101").orderBy("wicket").collect()
    assert [r.wicket for r in falls] == [1, 2, 3, 4, 5, 6] and falls[0].player_out == "Zed" and falls[0].score.endswith("/1")


def test_rain_revised_results_are_left_out(archive):
    assert [r.match_id for r in results.close_by_runs(archive, 2).collect()] == [101]
    assert one(results.toss(archive), scope="all").matches == 1
    assert results.champions(archive).count() == 2


def test_cards(archive):
    card = {r.player: r.dismissal for r in records.match_batting(archive, 101).filter("inning = 1").collect()}
    assert card["Zed"] == "run out" and card["Ann"] == "caught b Bob" and card["Kim"] == "not out" and card["Gus"] == "retired out"
    assert records.nth_match(archive, 7001, 2).filter("role = 'batting'").collect()[0].match_id == 102


def test_slice_dismissals_belong_to_the_player_out(archive):
    rows = {r.name: r for r in slice_stats(archive, SliceSpec(metric="runs", limit=None)).collect()}
    assert rows["Ann"].W == 2 and "Zed" not in rows
    zero = slice_stats(archive, SliceSpec(metric="strike_rate", shrink=True, least_balls=0, limit=None)).collect()
    league = sum(r.R for r in zero) / sum(r.B for r in zero) * 100
    for r in zero:
        assert min(r.value, league) - 0.02 <= r.shrunk <= max(r.value, league) + 0.02


def test_slice_rules():
    assert SliceSpec(subject="bowler", metric="average").metric == "bowling_average"
    for bad in ({"subject": "batter", "metric": "economy"}, {"overs": (6, 1)}, {"phase": "lunch"}, {"subject": "league", "players": (1,)}, {"split": "moon"}):
        with pytest.raises(ValueError):
            SliceSpec(**bad)
    said = SliceSpec(metric="strike_rate", phase="death", vs=3, venue="Eden", rrr_min=9.0).describe()
    assert all(x in said for x in ("strike_rate", "death", "3", "Eden", "9.0"))


def test_impact_of_wickets_cancels_out(archive):
    d = archive.d.filter("is_wicket = bowler_wicket")
    w = match_flow.impact_board(d, 1000.0).agg(F.sum("impact")).first()[0]
    flat = match_flow.impact_board(d, 0.0).agg(F.sum("impact")).first()[0]
    assert abs(w - flat) < 0.1

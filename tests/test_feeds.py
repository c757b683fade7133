"""Second-source pages and lists, cards with targets, nested matches, misspelt codes."""

import json

import pytest

from stumpline.operators import chase, fuzzy
from stumpline.sources import details, match_files, play_by_play


def write(path, *rows):
    path.write_text("\n".join(json.dumps(r) for r in rows))
    return str(path)


def over(number, bat=1, legal=6, **extras):
    ball = {"batter": "Ann", "bowler": "Bob", "non_striker": "Zed", "runs": {"batter": bat, "extras": 0, "total": bat}}
    return {"over": number, "deliveries": [ball] * legal}


def match_file(innings, **info):
    return {"info": {"dates": ["2024-05-26"], "teams": ["Mumbai Indians", "Delhi Capitals"], "venue": "Eden Gardens", "overs": 20, "toss": {"winner": "Mumbai Indians", "decision": "bat"}, "outcome": {"winner": "Mumbai Indians", "by": {"runs": 6}}, "player_of_match": ["Ann"], "registry": {"people": {"Ann": "0000000a", "Bob": "0000000b"}}, **info}, "innings": innings}


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    home = tmp_path_factory.mktemp("files")
    first, second = {"team": "Mumbai Indians", "overs": [over(0, 2), over(1, 1)]}, {"team": "Delhi Capitals", "overs": [over(0, 1), over(1, 1, 3)]}
    tie = {"team": "Delhi Capitals", "super_over": True, "overs": [over(0, 6)]}
    write(home / "1.json", match_file([first, second, tie]))
    write(home / "2.json", match_file([first, {**second, "target": {"runs": 10, "overs": 2}}], overs=2, toss={}))
    write(home / "3.json", match_file([first]))
    register = home / "people.csv"
    register.write_text("identifier,name,key_cricinfo\n")
    return match_files.read_matches(spark, str(home)), match_files.read_register(spark, str(register))


def test_targets_and_super_overs(files):
    matches, register = files
    card, overs = match_files.scorecards_with_targets(matches, match_files.deliveries(matches, register))
    got = {(r.match_id, r.inning): (r.team, r.runs, r.wickets, r.overs, r.target) for r in card.collect()}
    assert got == {(1, 1): ("MI", 18, 0, "2.0", None), (1, 2): ("DC", 9, 0, "1.3", 19), (2, 1): ("MI", 18, 0, "2.0", None), (2, 2): ("DC", 9, 0, "1.3", 10), (3, 1): ("MI", 18, 0, "2.0", None)}
    asked = {(r.match_id, r.inning, r.over_number): (r.total, r.balls_left, r.required, r.required_rate) for r in overs.collect()}
    assert asked[1, 1, 2] == (18, 108, None, None) and asked[1, 2, 1] == (6, 114, 13, 0.68) and asked[1, 2, 2] == (9, 111, 10, 0.54)
    assert asked[2, 2, 2] == (9, 3, 1, 2.0) and asked[2, 1, 2][1] == 0
    assert [(r.match_id, r.inning, r.required) for r in chase.chase_states(overs).orderBy("match_id").collect()] == [(1, 2, 10), (2, 2, 1)]


def test_archive_index(files):
    rows = {r.match_id: r for r in match_files.archive_index(*files).collect()}
    assert [(i.team, i.runs, i.overs) for i in rows[1].innings] == [("MI", 18, "2.0"), ("DC", 9, "1.3")]
    assert (rows[1].file, rows[1].season, rows[1].result, rows[1].toss, rows[2].toss) == ("1.json", 2024, "MI won by 6 runs", "MI won the toss and chose to bat", "Unavailable")


def test_list_entries(spark, tmp_path):
    teams = [{"team": {"id": 1, "abbreviation": "MI"}}, {"team": {"id": 2, "name": "Delhi"}}]
    kinds = [{"format": "T20", "stage": "FINISHED"}, {"format": "ODI", "stage": "FINISHED"}, {"format": "T20", "stage": "SCHEDULED", "state": "PRE"}, {"format": "T20", "stage": "FINISHED", "isCancelled": True}, {"format": "t20", "state": "POST"}, {}]
    path = write(tmp_path / "e.json", *({"objectId": i, "slug": "a-vs-b", "startDate": "2024-05-26T14:00:00Z", "teams": teams, "winnerTeamId": 2, "ground": {"name": "Eden"}, "season": "2024", **k} for i, k in enumerate(kinds)))
    rows = play_by_play.match_entries(play_by_play.read_entries(spark, path).filter(play_by_play.ingestable())).orderBy("match_id").collect()
    assert [r.match_id for r in rows] == [0, 4]
    r = rows[0]
    assert (r.match_path, str(r.start_date), r.venue, r.team1, r.team2, r.winner, r.is_cancelled) == ("a-vs-b-0", "2024-05-26", "Eden", "MI", "Delhi", "Delhi", False)


def test_pages(spark, tmp_path):
    falls = [{"fowRuns": 12, "overs": 1.4}, {"runs": 0, "player": {"name": "Solo"}}, {"score": 40, "wicketNum": 5}]
    wickets = [{"player": {"longName": "Ann A"}, "dismissalText": {"short": "c", "long": "c Bob b Cid"}, "score": 99}, {"dismissalText": "run out", "totalRuns": 30, "ballOvers": 4.1}]
    overs = [{"overNumber": 2, "totalRuns": 20, "requiredRuns": 5, "remainingBalls": 8, "requiredRunRate": 3.75, "predictions": {"winProbability": 70}}, {"overNumber": 1, "totalRuns": 9, "requiredRuns": 16}]
    first = {"inningNumber": 1, "team": {"abbreviation": "MI"}, "inningOvers": [{"overNumber": 1, "predictions": {"winProbability": 40}}], "inningFallOfWickets": falls, "inningWickets": wickets}
    second = {"team": {"name": "DC"}, "inningOvers": overs}
    pages = play_by_play.read_pages(spark, write(tmp_path / "p.json", {"match_id": 9, "content": {"innings": [first, second]}}))
    got = [(r.score, r.wicket, r.overs, r.batter, r.dismissal) for r in play_by_play.merged_falls(pages).orderBy("position").collect()]
    assert got == [("12", 1, "1.4", "Ann A", "c Bob b Cid"), ("30", 2, "4.1", "Solo", "run out"), ("40", 5, "-", "Unknown", "")]
    feed = play_by_play.feed_overs(pages)
    assert [tuple(r) for r in chase.chase_states(feed).collect()] == [(9, 2, 5, 8, 3.75)]
    assert [r.win_prob for r in chase.win_probability(feed, "DC").orderBy("inning", "over_number").collect()] == [60.0, None, 70.0]


def test_styles_in_any_json(spark):
    deep = {"a": [{"b": {"battingStyles": ["lhb"], "longBattingStyles": ["left-hand bat"], "objectId": 5, "name": "Old", "bowlingStyles": ["ob"]}}]}
    later = [[{"battingStyles": ["rhb"], "objectId": "5", "longName": "New", "longBowlingStyles": ["Right-arm Fast"]}, {"battingStyles": [], "objectId": "x"}]]
    df = spark.createDataFrame([("1", json.dumps(deep)), ("2", json.dumps(later)), ("3", "{broken"), ("4", None)], "path string, value string")
    assert [tuple(r) for r in play_by_play.styles_anywhere(df).collect()] == [(5, "New", "right", "right-arm fast", "pace", "right")]
    assert [tuple(r) for r in play_by_play.styles_anywhere(df.filter("path <> '2'")).collect()] == [(5, "Old", "left", "ob", "spin", "right")]


def test_misspelt_codes(spark):
    df = spark.createDataFrame([(1, "rcv against csk"), (2, "ask the mib"), (3, None), (4, "kkl kkl")], "id long, t string")
    got = sorted(tuple(r) for r in fuzzy.misspelt_codes(df, "id", "t", ["RCB", "CSK", "KKR", "MI"], known=["the"]).collect())
    assert got == [(1, "RCV", "RCB"), (2, "MIB", "MI"), (4, "KKL", "KKR")]


def test_nested_match(spark, files):
    matches, register = files
    d = match_files.deliveries(matches, register)
    rows = match_files.match_rows(matches)
    log = spark.createDataFrame([(1, "ok"), (2, "failed"), (3, "partial")], "match_id long, status string")
    inns = spark.createDataFrame([(1, 1, "MI", 18, 0, 12, 0, False), (1, 2, "DC", 9, 0, 9, 0, False)], "match_id long, inning long, team string, runs long, wickets long, balls long, extras long, is_super_over boolean")
    bat = spark.createDataFrame([(1, 1, 2, "B", 0, 0, 0, 0, True, "b Cid"), (1, 1, 1, "A", 18, 12, 0, 0, False, "")], "match_id long, inning long, position long, player string, runs long, balls long, fours long, sixes long, is_out boolean, dismissal string")
    bowl = spark.createDataFrame([(1, 1, "Bob", 12, 18, 0, 0)], "match_id long, inning long, player string, balls long, conceded long, wickets long, dots long")
    got = {r.match_id: r for r in details.match_details(rows, log, inns, bat, bowl, d).collect()}
    assert set(got) == {1, 3} and got[3].innings is None and len(got[3].balls) == 12
    a, b = got[1].innings
    assert (a.overs, b.overs, a.score, [x.name for x in a.batters], a.batters[0].strike_rate, a.batters[1].strike_rate, a.bowlers[0].economy, b.batters) == ("2", "1.3", "18/0", ["A", "B"], 150.0, None, 9.0, None)
    assert got[1].balls[11].score == "18/0" and got[1].balls[12].score == "1/0" and got[1].balls[0].id == "1-1-100101" and got[1].balls[0].event == "2"
    assert got[1].balls[0].label == "0.1"

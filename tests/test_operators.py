"""Second source, sinks, reconciliation, small operators, streams."""

import datetime as dt
import json
import random

import pytest
from helpers import SF
from pyspark.sql import functions as F

from stumpline.functions import columns as col
from stumpline.operators import innings, match_flow, reconcile, relational
from stumpline.plans import events_archive
from stumpline.plans.catalog import QUERIES
from stumpline.sources import play_by_play, sinks
from stumpline.streaming import live


def values(spark, *columns):
    return list(spark.range(1).select(*columns).first())


def test_column_helpers(spark):
    lit = F.lit
    assert values(spark, col.rounded(lit(1.005), 2), col.ratio(lit(1), lit(0)), col.overs_text(lit(17)), col.franchise(lit("DD")), col.ground(lit("Feroz Shah Kotla, Delhi"))) == [1.0, None, "2.5", "DC", "Arun Jaitley Stadium"]
    assert values(spark, col.won_by(lit("MI won by 7 runs"), "run"), col.won_by(lit("tied"), "run"), col.rain_revised(lit("x (D/L method)")), col.is_final(lit("FINAL")), col.is_playoff(lit("Qualifier 2"))) == [7, None, True, True, True]
    assert values(spark, col.contains_text(lit("100% Sure"), "0% s"), col.contains_text(lit("100x"), "0%"), col.slug(lit("A & B!")), col.initials(lit("new york old boys club")), col.trailing_number(lit("a-vs-b-123"))) == [True, False, "a-b", "NYOB", 123]
    assert values(spark, col.without_tags(lit("<p>a&nbsp;<b>b</b> &amp; c</p>")), col.all_words_in(lit("Big Red Bus"), "bus RED"), col.phase(lit(6)), col.phase(lit(16))) == ["a b & c", True, "powerplay", "death"]


ITEM = {"match_id": 1, "innings": {"number": 1}, "batsman": {"athlete": {"id": "5", "displayName": "Ann"}}, "bowler": {"athlete": {"id": "6", "name": "Bob"}}, "team": {"abbreviation": "MI"}}


def item(id_, seq, score, play, bat=None, **more):
    return {**ITEM, "id": id_, "sequence": seq, "scoreValue": score, "playType": {"description": play}, "shortText": "x", "over": {"number": 1, "ball": seq, **more.pop("over", {})}, **({"batsman": {**ITEM["batsman"], "runs": bat}} if bat is not None else {}), **more}


def test_play_by_play(spark, tmp_path):
    items = [
        {**ITEM, "id": "0", "sequence": 0, "over": {"number": 0, "ball": 0}, "shortText": " "}, item("1", 1, 4, "four", 4), item("1", 2, 4, "four", 4), item("2", 3, 1, "wide"), item("3", 4, 1, "no ball", 0, over={"noBall": 1, "byes": 4}),
        item("4", 5, 0, "out", 0, dismissal={"dismissal": True, "bowled": True, "type": "Bowled", "batsman": {"athlete": {"id": "5"}}}), item("5", 6, 0, "out", 0, dismissal={"dismissal": True, "type": "retired not out (hurt)"}),
    ]
    (tmp_path / "feed.json").write_text("\n".join(map(json.dumps, items)))
    d = {r.sequence: r for r in play_by_play.deliveries(play_by_play.read_items(spark, str(tmp_path))).collect()}
    assert set(d) == {2, 3, 4, 5, 6} and d[2].is_four and d[2].batter_id == 5 and d[2].bowler == "Bob"
    assert (d[3].wide_runs, d[3].is_legal, d[4].noball_runs, d[4].bye_runs, d[4].runs_total) == (1, False, 1, 4, 5)
    assert d[5].bowler_wicket and d[5].player_out_id == 5 and not d[6].is_wicket and d[6].dismissal_type.startswith("retired")


def test_cards_and_styles(spark, tmp_path):
    player = lambda i, bat, bowl, code: {"objectId": i, "longName": f"P{i}", "battingStyles": ["x"], "longBattingStyles": [bat], "longBowlingStyles": bowl, "bowlingStyles": code}
    inn = {
        "inningNumber": 1, "team": {"abbreviation": "MI"}, "runs": 10, "wickets": 1,
        "inningBatsmen": [{"player": player(1, "left-hand bat", ["right-arm offbreak"], []), "runs": 10, "balls": 9, "isOut": True, "dismissalText": {"long": " b Bob "}}, {"player": player(2, "right-hand bat", [], ["lfm"])}],
        "inningBowlers": [{"player": player(3, "rhb", ["slow left-arm orthodox"], []), "balls": 6, "conceded": 10}, {"player": player(4, "", [], [])}],
    }
    (tmp_path / "cards.json").write_text(json.dumps({"match_id": 9, "content": {"innings": [inn]}}))
    cards = play_by_play.read_cards(spark, str(tmp_path))
    inns, batting, bowling = play_by_play.official_cards(cards)
    assert (inns.count(), batting.count(), bowling.count()) == (1, 1, 1) and batting.first().dismissal == "b Bob"
    s = {r.player_id: (r.bat_hand, r.bowl_kind, r.bowl_arm) for r in play_by_play.styles(cards).collect()}
    assert s == {1: ("left", "spin", "right"), 2: ("right", "pace", "left"), 3: ("right", "spin", "left"), 4: ("", "", "")}


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *r: spark.createDataFrame(list(r), "match_id long, v string")
    sinks.replace_matches(rows((1, "a"), (2, "b")), path)
    sinks.replace_matches(rows((2, "c"), (2, "d")), path)
    sinks.add_missing(rows((1, "never"), (3, "e")), path)
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "c"), (2, "d"), (3, "e")]
    season = str(tmp_path / "s")
    sinks.write_by_season(rows((1, "a")).withColumn("year", F.lit(2020)), season)
    sinks.write_by_season(rows((2, "b")).withColumn("year", F.lit(2021)), season)
    sinks.write_by_season(rows((3, "c")).withColumn("year", F.lit(2021)), season)
    assert sorted(r.match_id for r in spark.read.parquet(season).collect()) == [1, 3]
    text = sinks.console(sinks.block("T", rows((1, None), (22, "b")).orderBy("match_id")))
    assert text.splitlines()[0] == "T" and " 1  -" in text
    log = sinks.ingest_log(rows((1, "a")), spark.createDataFrame([(1, 1), (2, 5)], "match_id long, items long"))
    assert {r.match_id: r.status for r in log.collect()} == {1: "ok", 2: "no_balls"}


def test_reconcile_notices_one_lost_ball(spark):
    d = events_archive.archive(spark, SF).d
    totals = innings.innings_totals(d)
    parts = lambda x: {"innings": (innings.innings_totals(x), totals, ["match_id", "inning"], ["runs", "balls"])}
    assert {r.status for r in reconcile.reconcile(parts(d), "match_id").collect()} == {"exact"}
    lost = d.filter("is_legal").first()
    found = reconcile.reconcile(parts(d.filter(F.col("sequence") != lost.sequence)), "match_id").filter("status <> 'exact'").collect()
    assert [(r.match_id, r.innings) for r in found] == [(lost.match_id, 1)]


def test_set_cover(spark):
    sets = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("b", 3), ("b", 4), ("c", 4)], "s string, m long")
    assert relational.set_cover(sets, "s", "m") == [("b", 3), ("a", 1)]


def walked(balls, limit, target):
    """Shifts of one innings by a walk over its balls in plain Python: (kind, first, last, wickets, runs, favours, magnitude)."""
    if len(balls) < 12:
        return []
    legal, runs, down, at = [0], [0], [0], {}
    for i, b in enumerate(balls):
        legal.append(legal[-1] + b.is_legal)
        runs.append(runs[-1] + b.runs_total)
        down.append(down[-1] + b.is_wicket)
        at.setdefault(b.over_number, []).append(i)
    rate, bat, bowl = runs[-1] / max(legal[-1], 1), balls[0].batting_team, balls[0].bowling_team
    span = lambda i, j: (legal[j + 1] - legal[i], runs[j + 1] - runs[i], down[j + 1] - down[i])
    found = []

    def note(kind, i, j, favours, size):
        found.append((kind, i + 1, j + 1, span(i, j)[2], span(i, j)[1], favours, int(abs(size) * 10 + 0.5 + 1e-9) / 10 * (1 if size >= 0 else -1)))

    group = []
    for i in [*(k for k, b in enumerate(balls) if b.is_wicket), None]:
        if group and (i is None or legal[i + 1] - legal[group[-1] + 1] > 9):
            n, r, w = span(group[0], group[-1])
            if len(group) > 2 or (len(group) == 2 and n <= 6):
                note("wicket_cluster", group[0], group[-1], bowl, 8 * w + rate * max(n, 1) - r)
            group = []
        group.append(i)
    for kind in ("scoring_burst", "squeeze"):
        good = []
        for o in sorted(at):
            _, r, _ = span(at[o][0], at[o][-1])
            four = any(balls[i].is_four or balls[i].is_six for i in at[o])
            if r >= max(10, 1.4 * 6 * rate) if kind == "scoring_burst" else not four and r <= 0.6 * 6 * rate:
                good.append(o)
        while good:
            n = 1
            while n < len(good) and good[n] == good[0] + n:
                n += 1
            i, j = at[good[0]][0], at[good[n - 1]][-1]
            q, r, w = span(i, j)
            if kind == "scoring_burst" and (n > 1 or r >= 20) and w <= 1:
                note(kind, i, j, bat, r - rate * q - 8 * w)
            if kind == "squeeze" and n > 1:
                note(kind, i, j, bowl, rate * q - r + 8 * w)
            good = good[n:]
    sixth = [i for i, b in enumerate(balls) if b.is_legal and legal[i + 1] % 6 == 0] if target else []
    for i, j in zip(sixth, sixth[2:], strict=False):
        left, need = limit - legal[i + 1], (target or 0) - runs[i + 1]
        if left > 0 and need > 0 and 6 * need / left <= 18:
            q, r, w = span(i + 1, j)
            swing = round(r - need / left * q - 8 * w, 1)
            if abs(swing) >= 12:
                note("chase_swing", i + 1, j, bat if swing > 0 else bowl, abs(swing))
    for i, b in enumerate(balls):
        if any(x in (b.said or "").lower() for x in ("dropped", "missed the stumping", "grassed")):
            note("missed_chance", i, i, bat, 6.0)
    order = ["wicket_cluster", "scoring_burst", "squeeze", "chase_swing", "missed_chance"]
    kept = []
    for x in sorted(found, key=lambda x: (-x[6], order.index(x[0]), x[1])):
        if not any(x[1] <= k[2] and k[1] <= x[2] and (x[0] == k[0] or x[5] == k[5]) for k in kept):
            kept.append(x)
    return kept


def test_shifts_are_those_of_a_walk_over_balls(spark):
    d = events_archive.archive(spark, "/root/testdata/sf0.01").d
    said = F.when(F.col("sequence") % 31 == 0, "Dropped at slip").when(F.col("sequence") % 37 == 0, "he missed the stumping").otherwise("turned away")
    d = d.withColumn("said", said).withColumn("runs_total", F.when(F.col("over_number").between(4, 5) & ~F.col("is_wicket"), F.col("runs_total") * 4).when(F.col("over_number").between(7, 8), F.col("runs_total") * 0).otherwise(F.col("runs_total")).cast("long"))
    d = d.withColumns({k: F.col(k) & ~F.col("over_number").between(7, 8) for k in ("is_four", "is_six")})
    innings_ = {}
    for r in d.orderBy("match_id", "inning", "sequence").collect():
        innings_.setdefault((r.match_id, r.inning), []).append(r)
    want = {}
    for (m, i), balls in innings_.items():
        want[m, i] = walked(balls, 160, sum(b.runs_total for b in innings_[m, 1]) + 1 if i == 2 else None)
    got = {}
    for r in sorted(match_flow.innings_shifts(d, 160, "said").collect(), key=lambda r: r.place):
        got.setdefault((r.match_id, r.inning), []).append((r.kind, r.first_ball, r.last_ball, r.wickets, r.runs, r.favours, r.magnitude))
    assert {x[0] for v in want.values() for x in v} == set(match_flow.KINDS)
    assert got == {k: v for k, v in want.items() if v}
    top = match_flow.match_shifts(d, 160, 6, "said").collect()
    for m in {k[0] for k in want}:
        best = sorted(((-x[6], i, n, x) for i in (1, 2) for n, x in enumerate(want.get((m, i), []))), key=lambda x: x[:3])[:6]
        mine = sorted((r for r in top if r.match_id == m), key=lambda r: r.moment)
        assert [(r.inning, r.first_ball) for r in mine] == sorted((x[1], x[3][1]) for x in best)
        assert [r.magnitude for r in mine if r.decisive] == [best[0][3][6]]


def test_shifts_are_chosen_in_a_stream_of_chains(spark):
    """Chains of any number and length, against each with each; and no group of rows is built for a chain."""
    rng, names = random.Random(7), ("a", "b", None)
    rows = []
    for match, spread in ((1, 30), (2, 300), (3, 60000), (None, 60)):
        for inning in (1, 2):
            for first in sorted(rng.sample(range(spread * 2), 50)):
                last = first + rng.choice((0, 2, 15, min(spread, 300)))
                rows.append((match, inning, rng.choice(match_flow.KINDS), first, last, 1, 1, 0, 0, 0, rng.choice(names), float(rng.randrange(6))))
    found = spark.createDataFrame(rows, "match_id long, inning long, kind string, first_ball long, last_ball long, first_over long, last_over long, wickets long, runs long, balls long, favours string, magnitude double")
    want = {}
    for r in sorted(rows, key=lambda r: (-r[11], match_flow.KINDS.index(r[2]), r[3])):
        kept = want.setdefault(r[:2], [])
        if all(r[3] > k[4] or k[3] > r[4] or (r[2] != k[2] and r[10] != k[10]) for k in kept):
            kept.append(r)
    apart = match_flow._apart(found)
    assert apart.select("match_id", "inning", "island").distinct().count() > 50
    got = match_flow._chosen(apart).drop("island").select(*found.columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((r for v in want.values() for r in v), key=repr)
    plan = match_flow.match_shifts(events_archive.archive(spark, SF).d, 160)._jdf.queryExecution().toString()
    assert "FlatMapGroupsInPandas" not in plan


def test_momentum_and_impact_by_hand(spark):
    rows = []
    for inning, overs in ((1, [(6, 0), (12, 1), (0, 2)]), (2, [(9, 0), (3, 1)])):
        k = 0
        for o, (runs, wickets) in enumerate(overs, 1):
            for ball in range(6):
                k += 1
                out = ball < wickets
                rows.append((1, inning, k, o, runs // 6 + (ball < runs % 6), True, False, out, out, 10 * inning + (o if out else 0), 10 * inning + (o if out else 0), 90 + inning))
    d = spark.createDataFrame(rows, "match_id long, inning long, sequence long, over_number long, runs_total long, is_legal boolean, is_wide boolean, is_wicket boolean, bowler_wicket boolean, batter_id long, player_out_id long, bowler_id long")
    d = d.withColumns({"runs_bat": F.col("runs_total"), "bowler_runs": F.col("runs_total")})
    flow = {(r.inning, r.over_number): r.momentum for r in match_flow.momentum(d).collect()}
    m1 = 0.3 * (6 - 6)
    m2 = 0.3 * (12 - 6 - 8) + 0.7 * m1
    assert flow[1, 1] == m1 and abs(flow[1, 2] - m2) < 1e-4 and abs(flow[1, 3] - (0.3 * (0 - 6 - 16) + 0.7 * m2)) < 1e-4
    par = 30 / 30
    board = {(r.inning, r.player_id, r.role): r.impact for r in match_flow.impact_board(d).collect()}
    balls = lambda i, who, what: sum(what(r) for r in rows if r[1] == i and r[9] == who)
    assert board[1, 10, "bat"] == balls(1, 10, lambda r: r[4]) - par * balls(1, 10, lambda r: 1)  # never out: 1 is charged nothing
    assert board[1, 12, "bat"] == round(2 - par - 12, 1) and board[1, 91, "bowl"] == round(par * 18 - 18 + 12 * 3, 1)


def test_cues_are_of_the_surface_not_of_strokes(spark):
    from stumpline.operators import grounds

    found = lambda t: [r.cue for r in grounds.cue_counts(spark.createDataFrame([(t,)], "t string"), "t").collect()]
    assert found("pitches outside off and turns away") == ["turn"] and found("a length ball that swings away late") == ["seam or swing"] and found("it climbs on him") == ["bounce"]
    for stroke in ("turned away to fine leg", "turned away for one to deep backward square", "turned square for a single", "swung away over long on", "it has been swung away over midwicket", "the bat turns in the hands", "the towel fell off"):
        assert found(stroke) == [], stroke
    chance = lambda t: spark.createDataFrame([(t,)], "t string").filter(F.col("t").rlike("(?i)" + match_flow.MISSED_CHANCE)).count()
    assert all(chance(t) for t in ("put down at slip", "Grassed!", "spilled by the keeper", "missed the stumping", "missed run-out", "a reprieve", "decision overturned")) and not chance("a fine catch")


def test_verdict_of_a_pitch():
    from stumpline.operators import grounds

    phases = [{"rr_here": 9.5, "rr_league": 8.0}, {"rr_here": None, "rr_league": 7.0}]
    kinds = [{"kind": "pace", "balls": 60, "econ_here": 9.0, "econ_league": 8.0}, {"kind": "spin", "balls": 24, "econ_here": 6.0, "econ_league": 7.5}]
    said = grounds.pitch_verdict(phases, kinds, {"wickets_here": 6, "bowled_lbw_pct_here": 50.0, "bowled_lbw_pct_league": 30.0}, [{"cue": "turn", "mentions": 2}, {"cue": "dew", "mentions": 1}], 9)
    assert said == "high-scoring; spin did better than usual; many bowled and lbw; commentary speaks of turn"
    assert grounds.pitch_verdict([], [], None, [], 0) == "no commentary" and grounds.pitch_verdict([], [], None, [], 3) == "not enough ball data"


def test_by_occurrence_uses_labels_where_counts_differ(spark):
    left = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (1, "x", 3), (2, "x", 1), (2, "y", 2)], "g long, l string, o long")
    right = spark.createDataFrame([(1, "y", 1, "R1"), (1, "x", 2, "R2"), (2, "q", 1, "S1"), (2, "q", 2, "S2")], "g long, l string, o long, v string")
    got = {(r.g, r.o): r.right_v for r in reconcile.by_occurrence(left, right, ["g"], "l", "o", ["v"]).collect()}
    assert got == {(1, 1): "R2", (1, 2): "R1", (1, 3): None, (2, 1): "S1", (2, 2): "S2"}


def days_apart(spark):
    """Two hundred rows of one key and day on either side, and rows at its edges; without a key or a day there is no match."""
    day = lambda n, hour=0: dt.datetime(2024, 1, n, hour)
    left = [("a", day(10, k % 24), k) for k in range(200)] + [("a", day(9), 300), ("a", day(11), 301), ("a", day(13), 302), ("b", day(10), 303), (None, day(10), 304), ("a", None, 305), ("c", day(20), 306), ("c", day(20), 307)]
    right = [("a", day(10, 5), 1000 + k) for k in range(200)] + [("a", day(10, 4), 1500), ("c", day(21), 5), ("c", day(19, 3), 9), ("c", day(19, 3), 8), (None, day(10), 1), ("c", None, 2)]
    return left, right, spark.createDataFrame(left, "k string, at timestamp_ntz, id long"), spark.createDataFrame(right, "k string, day timestamp_ntz, other long")


def test_nearest_day_as_brute_force(spark):
    left, right, a, b = days_apart(spark)
    want = {}
    for k, at, i in left:
        near = [(abs((day.date() - at.date()).days), day, other) for key, day, other in right if at and day and k and key == k and abs((day.date() - at.date()).days) <= 1]
        want[i] = min(near, default=(None, None, None))
    got = reconcile.nearest_day(a, b, ["k"], "at", "day", "other")
    assert got.columns == ["k", "at", "id", "matched_id", "matched_day", "gap"]
    assert {r.id: (r.gap, r.matched_day, r.matched_id) for r in got.collect()} == want and got.count() == len(left)


def test_nearest_day_joins_no_pairs_of_a_day(spark):
    _, _, a, b = days_apart(spark)
    got = reconcile.nearest_day(a, b, ["k"], "at", "day", "other")
    got.collect()
    nodes, made = [got._jdf.queryExecution().executedPlan()], []
    while nodes:
        n = nodes.pop()
        if n.nodeName() == "AdaptiveSparkPlan" or n.nodeName().endswith("QueryStage"):
            nodes.append(n.executedPlan() if n.nodeName() == "AdaptiveSparkPlan" else n.plan())
        elif "Join" in n.nodeName():
            made.append(n.metrics().apply("numOutputRows").value())
        nodes += [n.children().apply(i) for i in range(n.children().size())]
    assert made and max(made) <= a.count()


def test_whole_pairs_have_every_order(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    got = QUERIES["asof_day_pair_whole"](spark, SF)
    assert got.join(orders, "o_orderkey").count() == got.count() == orders.count()


def test_whole_tables_are_reconciled_and_filled(spark, tmp_path):
    spark.createDataFrame([(1, 10.0), (1, 5.5), (2, 4.0), (9, 1.0), (5, None)], "l_orderkey long, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    day = dt.datetime(2000, 5, 1)
    spark.createDataFrame([(1, 7, day, 15.5), (2, 7, day, 5.0), (3, 8, day, 2.0), (5, 6, day, None)], "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    got = {tuple(r) for r in QUERIES["null_safe_reconcile_whole"](spark, str(tmp_path)).collect()}
    assert got == {("order", 2, "differs"), ("order", 3, "missing"), ("order", 9, "extra"), ("customer", 7, "differs"), ("customer", 8, "missing"), ("customer", None, "extra"), ("year", 2000, "differs"), ("year", None, "extra")}
    assert {tuple(r) for r in QUERIES["fill_gaps_whole"](spark, str(tmp_path)).collect()} == {(1, 2), (2, 1), (3, 0), (5, 1), (9, 1)}


def test_page_and_samples(spark):
    df = spark.range(10)
    rows, more = relational.page(df, [F.col("id")], 3, 4)
    assert [r.id for r in rows.collect()] == [8, 9] and not more
    assert sorted(r.id for r in relational.top_and_bottom(df, [F.col("id")], [F.col("id").desc()], 2).collect()) == [0, 1, 8, 9]
    union = relational.union_all([spark.range(1).toDF("id"), spark.range(1).select("id", F.lit("a").alias("x"))])
    assert {tuple(r) for r in union.collect()} == {(0, None), (0, "a")}


@pytest.mark.parametrize("name", ["windows", "sessions", "dedup"])
def test_streams_agree_with_batch(spark, name, tmp_path):
    path = f"{SF}/events.parquet"
    batch = spark.read.parquet(path)
    stream = spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet(SF)
    if name == "windows":
        df, want = live.windowed_runs(stream, "value"), batch.groupBy(F.window("ts", "1 hour")).count().count()
    elif name == "sessions":
        df, want = live.sessions(stream, "user_id", "6 hours"), batch.groupBy("user_id", F.session_window("ts", "6 hours")).count().count()
    else:
        df, want = live.deduplicated(stream.union(stream), ["event_id"], late="40 days"), batch.count()
    q = df.writeStream.format("memory").queryName(f"live_{name}").outputMode("append" if name == "dedup" else "complete").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True)
    q.start().awaitTermination()
    assert spark.table(f"live_{name}").count() == want


def test_adhoc_sql_and_views(spark):
    from stumpline.plans import views

    a = events_archive.archive(spark, SF)
    assert views.ask(spark, a, "select count(*) n from matches;").first().n == a.matches.count()
    assert {"deliveries", "matches"} <= {r.table for r in views.columns(spark, a).collect()}
    for bad in ("drop table matches", "", "select 1; select 2"):
        with pytest.raises(ValueError, match="SELECT"):
            views.ask(spark, a, bad)


def test_a_table_left_by_a_crash_comes_back(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/t.old")
    assert sinks.recovered(spark, f"file://{tmp_path}/t") and spark.read.parquet(f"{tmp_path}/t").count() == 3
    assert not sinks.recovered(spark, f"file://{tmp_path}/none")

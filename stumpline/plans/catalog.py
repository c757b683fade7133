"""The registered queries: every operator family on the tables at hand (events as deliveries, the others as they are)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import count_where, overs_text, rounded, without_tags
from ..operators import chase, families, grounds, innings, leaders, match_flow, reconcile, records, relational, results
from . import events_archive, further, views
from .archive import Archive
from .oracles import ORACLES
from .slice_queries import CHASE_SQL, SLICE_SQL, SLICES
from .slices import SliceSpec, slice_stats

c = F.col
Query = Callable[[SparkSession, str], DataFrame]
#: The match, batter, bowler, ground and teams that single-subject queries are about.
MATCH, BATTER, BOWLER, GROUND = 8767, 7, 3, "Eden Gardens"


#: A statement for ad-hoc SQL: a join of two views, grouped, with HAVING.
ADHOC = """
SELECT m.year, d.batting_team AS team, count(*) AS balls, sum(d.runs_total) AS runs, count(DISTINCT d.match_id) AS games
FROM deliveries d JOIN matches m ON m.match_id = d.match_id WHERE d.is_legal AND d.over_number > 6 GROUP BY m.year, d.batting_team HAVING count(*) > 5
"""


def on_archive(f: Callable[[Archive], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(events_archive.archive(spark, sf_dir))


def on_table(name: str, f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def on_tables(names: str, f: Callable[..., DataFrame]) -> Query:
    return lambda spark, sf_dir: f(*(spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names.split()))


def _slice(**spec) -> Query:
    return on_archive(lambda a: slice_stats(a, SliceSpec(**spec), events_archive.BALLS_IN_INNINGS))


def _state(a: Archive) -> DataFrame:
    x = innings.match_state(a.d, events_archive.BALLS_IN_INNINGS)
    return x.select("match_id", "inning", "sequence", "score_before", "wkts_before", "legal_before", "bat_ball_no", "needed", "balls_left", "wkts_in_hand", rounded(c("rrr"), 6).alias("rrr"))


def _reconcile_lines(lineitem: DataFrame) -> DataFrame:
    k = c("l_orderkey")
    ours = lineitem.filter(k % 5 != 0).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n")).withColumn("n", F.when(k % 7 != 0, c("n")))
    ref = lineitem.filter((k % 3 != 0) & (k % 7 != 0)).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n")).withColumn("n", F.when(k % 11 == 0, c("n") + 1).otherwise(c("n")))
    out = reconcile.differences(ours, ref, ["l_orderkey"], ["n"])
    status = F.when(c("n_ref").isNull(), "extra").when(c("n_ours").isNull(), "missing").otherwise("differs")
    return out.filter(~c("n_ours").eqNullSafe(c("n_ref"))).select("l_orderkey", status.alias("status"))


def _reconcile_whole(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """Sums of all lines against the totals of all orders, order by order, by customer and by year."""
    heads = orders.select("o_orderkey", c("o_custkey").alias("customer"), F.year("o_orderdate").cast("long").alias("year"), "o_totalprice")
    lines = lineitem.groupBy(c("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("price")).join(heads.drop("o_totalprice"), "o_orderkey", "left")

    def level(name: str, key: str) -> DataFrame:
        total = lambda df, price: df.groupBy(c(key).alias("key")).agg(F.round(F.sum(price), 2).alias("total"))
        return reconcile.differences(total(lines, "price"), total(heads, "o_totalprice"), ["key"], ["total"]).select(F.lit(name).alias("level"), "key", "status")

    return relational.union_all([level("order", "o_orderkey"), level("customer", "customer"), level("year", "year")])


def _occurrences(conversations: DataFrame) -> DataFrame:
    right = conversations.filter(~((c("conv_id") % 3 == 0) & (c("turn") == 1)))
    return reconcile.by_occurrence(conversations.select("conv_id", "turn", "role"), right, ["conv_id"], "role", "turn", ["turn"])


def _two_sources(events: DataFrame) -> DataFrame:
    cols = ["user_id", "event_type"]
    both = innings.one_source(events.filter("event_type = 'purchase'").select(*cols), events.filter("event_type = 'click'").select(*cols), "user_id")
    return both.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("source").alias("source"))


def _thrice(nation: DataFrame) -> DataFrame:
    name = lambda k, v: nation.select(c("n_nationkey").alias(k), c("n_name").alias(v))
    x = nation.select("n_nationkey", (c("n_nationkey") + 1).alias("k1"), (c("n_nationkey") * 2).alias("k2"))
    return x.join(name("k1", "next_name"), "k1", "left").join(name("k2", "twice_name"), "k2", "left").select("n_nationkey", "next_name", "twice_name")


def _self_join(a: Archive) -> DataFrame:
    inns = innings.innings_totals(a.d)
    first = inns.filter("inning = 1").select("match_id", c("team").alias("first_team"), c("runs").alias("first_runs"))
    return first.join(inns.filter("inning = 2").select("match_id", c("team").alias("second_team"), c("runs").alias("second_runs")), "match_id", "left")


def _years(orders: DataFrame, customer: DataFrame) -> DataFrame:
    year = F.year("o_orderdate").cast("long").alias("year")
    wanted = orders.filter("o_totalprice > 300000").join(customer.filter("c_nationkey = 3"), c("o_custkey") == c("c_custkey")).select(year).distinct()
    return orders.select(year).join(wanted, "year", "left_semi").groupBy("year").agg(F.count(F.lit(1)).alias("n"))


def _nearest(orders: DataFrame) -> DataFrame:
    out = reconcile.nearest_day(orders.filter("o_orderkey % 50 = 0"), orders.filter("o_orderkey % 2 = 1"), ["o_orderpriority"], "o_orderdate", "o_orderdate", "o_orderkey")
    return out.select("o_orderkey", "matched_id", c("gap").cast("long").alias("gap"))


def _nearest_whole(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Every order with the line of its priority, among all lines, that is shipped nearest to its day."""
    shipped = lineitem.join(orders.select(c("o_orderkey").alias("l_orderkey"), "o_orderpriority"), "l_orderkey")
    out = reconcile.nearest_day(orders, shipped, ["o_orderpriority"], "o_orderdate", "l_shipdate", "l_orderkey")
    return out.select("o_orderkey", "matched_id", c("gap").cast("long").alias("gap"))


def _gaps(customer: DataFrame) -> DataFrame:
    tag = lambda df, t: df.select("c_custkey", "c_nationkey", F.lit(t).cast("long").alias("t"))
    both = relational.fill_gaps(tag(customer.filter("c_custkey % 2 = 0"), 0), tag(customer.filter("c_custkey % 3 = 0"), 1), ["c_custkey"])
    return both.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.sum("t").alias("new_rows"))


def _gaps_whole(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """Number of lines of every order: those that lines name, and those of orders that no line names."""
    named = lineitem.groupBy(c("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    return relational.fill_gaps(named, orders.select("o_orderkey", F.lit(0).cast("long").alias("n")), ["o_orderkey"])


def _cues(documents: DataFrame) -> DataFrame:
    return grounds.cue_counts(documents, "text", {"and then": r"\b(and|und) th", "not been": r"(^| )be( |$)", "never": r"\bqqqq\b"})


def _sessions(events: DataFrame) -> DataFrame:
    s = events.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", c("w.start").alias("session_start"), "n")


def _shares(events: DataFrame) -> DataFrame:
    return relational.share_within(events, ["event_type"], ["user_id"]).withColumn("pct", rounded(c("pct"), 8))


def _priorities(orders: DataFrame) -> DataFrame:
    digit = F.nullif(F.regexp_extract("o_orderpriority", r"^(\d)-", 1), F.lit("")).try_cast("long")
    return orders.filter(~c("o_orderpriority").rlike("NOT")).groupBy(digit.alias("priority")).agg(F.count(F.lit(1)).alias("n"))


def _brands(lineitem: DataFrame, part: DataFrame, supplier: DataFrame) -> DataFrame:
    x = lineitem.join(part, c("l_partkey") == c("p_partkey")).join(supplier.filter("s_acctbal > 0"), c("l_suppkey") == c("s_suppkey"))
    return x.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


def _deduped(lineitem: DataFrame) -> DataFrame:
    order = [c(x).desc() for x in ("l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")]
    return relational.keep_last(lineitem, ["l_orderkey", "l_linenumber"], order).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


def _shifts(a: Archive) -> DataFrame:
    return match_flow.match_shifts(a.d, events_archive.BALLS_IN_INNINGS)


def _said(a: Archive) -> DataFrame:
    """Balls with a sentence of commentary for every seventh, as the archive's own is no prose."""
    texts = F.array(*map(F.lit, ("Dropped at long-on", "missed the stumping", "a fine stroke", "grassed by the keeper", "review, overturned", "turns away sharply")))
    said = F.when(c("sequence") % 7 == 0, F.element_at(texts, (c("sequence") % 6 + 1).cast("int"))).otherwise("")
    return match_flow.balls_so_far(a.d.withColumn("said", said), "said")


def _surface_cues(a: Archive) -> DataFrame:
    """Cues of the built-in list in sentences picked by the balls' numbers."""
    texts = ("pitches on leg and turns away", "turned away for one to deep fine leg", "it has been swung away over long on", "swings away late", "some dew about", "kept low", "climbs at the batter", "slow pitch, held up", "flat track, batting paradise", "no cue here")
    return grounds.cue_counts(a.d.select(F.element_at(F.array(*map(F.lit, texts)), (c("sequence") % 10 + 1).cast("int")).alias("t")), "t")


def _reconciled(a: Archive) -> DataFrame:
    """Cards rebuilt from nine in ten balls against cards of all balls."""
    cards = lambda d: innings.scorecards(d)
    (i, b, w), (ri, rb, rw) = cards(a.d.filter("sequence % 10 <> 3 or match_id % 2 = 0")), cards(a.d)
    keys = ["match_id", "inning", "player_id"]
    return reconcile.reconcile({"innings": (i, ri, keys[:2], ["runs", "wickets", "balls"]), "batting": (b, rb, keys, ["runs", "balls", "is_out"]), "bowling": (w, rw, keys, ["balls", "conceded", "wickets"])}, "match_id", a.matches.filter("match_id % 5 = 0"))


def _required(a: Archive) -> DataFrame:
    totals = a.d.groupBy("match_id", "inning").agg(F.sum("runs_total").alias("runs"))
    return chase.requirements(a.d, chase.targets(totals), events_archive.BALLS_IN_INNINGS)


QUERIES: dict[str, Query] = {
    "leader_runs": on_archive(leaders.top_batters),
    "leader_rate_floor": on_archive(lambda a: leaders.top_batters(a, "sr", least_balls=30)),
    "leader_sixes_team": on_archive(lambda a: leaders.top_batters(a, "sixes", team="DC")),
    "best_figures": on_archive(leaders.top_bowlers),
    "leader_economy": on_archive(lambda a: leaders.top_bowlers(a, "econ", least_balls=10)),
    "full_outer_innings": on_archive(lambda a: innings.batting_innings(a.d).drop("first_ball")),
    "bowling_innings": on_archive(lambda a: innings.bowling_innings(a.d).drop("first_ball")),
    "rollup_year": on_archive(lambda a: leaders.batting_by_year(a, BATTER)),
    "rollup_year_bowling": on_archive(lambda a: leaders.bowling_by_year(a, BOWLER)),
    "player_phases": on_archive(lambda a: leaders.batting_by_phase(a, BATTER)),
    "bowler_phases": on_archive(lambda a: leaders.bowling_by_phase(a, BOWLER)),
    "matchup": on_archive(lambda a: leaders.matchup(a, BATTER, BOWLER)),
    "season_summary": on_archive(leaders.season_summary),
    "phase_leaders": on_archive(lambda a: leaders.over_leaders(a, phase="death", least_balls=5)),
    "overs_leaders": on_archive(lambda a: leaders.over_leaders(a, "bowl", 3, 8, innings=2, sort="wkts", least_balls=5)),
    "find_players": on_archive(lambda a: leaders.find_players(a, "ler 1")),
    "results_close_runs": on_archive(lambda a: results.close_by_runs(a, 20)),
    "results_close_wickets": on_archive(lambda a: results.close_by_wickets(a, 6)),
    "results_tied": on_archive(results.tied),
    "results_defended_under": on_archive(lambda a: results.defended_under(a, 100_000)),
    "results_chased_over": on_archive(lambda a: results.chased_over(a, 20)),
    "results_needed_at_over": on_archive(lambda a: results.needed_at_over(a, 8)),
    "results_scored_over": on_archive(lambda a: results.innings_over(a, 40)),
    "results_conceded_over": on_archive(lambda a: results.innings_over(a, 40, "bowl", innings=2)),
    "match_list": on_archive(lambda a: results.match_list(a, team="MI")),
    "champions": on_archive(results.champions),
    "string_agg_ordered": on_archive(results.titles),
    "union_total": on_archive(lambda a: results.team_seasons(a, "MI")),
    "head_to_head": on_archive(lambda a: results.head_to_head(a, "MI", "CSK")),
    "home_ground": on_archive(lambda a: innings.home_grounds(a.matches, least=1)),
    "home_record": on_archive(lambda a: results.home_record(a, 1, home={"least": 1})),
    "toss_split": on_archive(lambda a: results.toss(a, "venue")),
    "record_totals": on_archive(records.highest_totals),
    "record_scores": on_archive(records.highest_scores),
    "record_figures": on_archive(records.best_figures),
    "record_sixes": on_archive(records.most_sixes),
    "fastest_fifty": on_archive(lambda a: records.fastest_to(a, 8)),
    "milestone_innings": on_archive(lambda a: records.milestone_innings(a, "runs", 50)),
    "milestone_ducks": on_archive(lambda a: records.milestone_innings(a, "ducks", 2)),
    "milestone_wickets": on_archive(lambda a: records.milestone_innings(a, "wickets", 10)),
    "milestone_balls": on_archive(lambda a: records.milestone_balls(a, 10)),
    "nth_match": on_archive(lambda a: records.nth_match(a, BATTER, 3)),
    "match_card_batting": on_archive(lambda a: records.match_batting(a, MATCH)),
    "match_card_bowling": on_archive(lambda a: records.match_bowling(a, MATCH)),
    "match_card_phases": on_archive(lambda a: records.match_phases(a, MATCH)),
    "commentary_search": on_archive(lambda a: records.commentary_search(a, wanted="9}", innings=1, width=7, limit=50)),
    "venue_table": on_archive(grounds.venues),
    "ground_seasons": on_archive(lambda a: grounds.ground_seasons(a, GROUND)),
    "grouping_sets_phase": on_archive(lambda a: grounds.ground_phases(a, GROUND)),
    "share_within_group": on_archive(lambda a: grounds.ground_dismissals(a, GROUND)),
    "ground_pace_spin": on_archive(lambda a: grounds.ground_pace_spin(a, GROUND)),
    "pitch_phases": on_archive(lambda a: grounds.pitch_phases(a, MATCH)),
    "pitch_kinds": on_archive(lambda a: grounds.pitch_kinds(a, MATCH)),
    "pitch_wickets": on_archive(lambda a: grounds.pitch_wickets(a, MATCH)),
    "pitch_cues": on_table("documents", _cues),
    "surface_cues": on_archive(_surface_cues),
    "adhoc_sql": lambda spark, sf_dir: views.ask(spark, events_archive.archive(spark, sf_dir), ADHOC),
    "match_state": on_archive(_state),
    "partnerships": on_archive(lambda a: innings.partnerships(a.d).select("match_id", "inning", "wicket", "runs", "balls", "pair", "ended")),
    "partnership_top": on_archive(families.top_partnerships),
    "partnership_pairs": on_archive(lambda a: families.pair_partnerships(a, least=1)),
    "hattricks": on_archive(lambda a: families.hat_tricks(a, limit=100_000)),
    "awards_topk": on_archive(families.awards),
    "impact_subs": on_archive(families.impact_substitutes),
    "par_by_over": on_archive(families.par_by_over),
    "style_coverage": on_archive(families.style_coverage),
    "irregular_overs": on_archive(lambda a: reconcile.irregular_overs(a.d)),
    "running_score": on_archive(lambda a: reconcile.running_score(a.d, ["match_id", "inning"], "sequence", c("runs_total"), c("is_wicket")).select("match_id", "inning", "sequence", "score")),
    "over_series": on_archive(lambda a: match_flow.over_series(a.d)),
    "worm": on_archive(lambda a: match_flow.worm(a.d)),
    "fall_of_wickets": on_archive(lambda a: match_flow.fall_of_wickets(a.d)),
    "ewma_momentum": on_archive(lambda a: match_flow.momentum(a.d)),
    "shift_wicket_cluster": on_archive(lambda a: match_flow.wicket_clusters(match_flow.balls_so_far(a.d))),
    "shift_burst": on_archive(lambda a: match_flow.bursts(match_flow.balls_so_far(a.d), rate=1.1)),
    "shift_squeeze": on_archive(lambda a: match_flow.squeezes(match_flow.balls_so_far(a.d), rate=1.0)),
    "shift_chase": on_archive(lambda a: match_flow.chase_swings(match_flow.balls_so_far(a.d), a.d, events_archive.BALLS_IN_INNINGS, swing=3)),
    "shift_chance": on_archive(lambda a: match_flow.missed_chances(_said(a))),
    "shifts_greedy": on_archive(_shifts),
    "impact_board": on_archive(lambda a: match_flow.impact_board(a.d)),
    "key_moments": on_archive(lambda a: match_flow.key_moments(a.d)),
    "maidens": on_archive(lambda a: match_flow.maidens(a.d)),
    "reconcile_cards": on_archive(_reconciled),
    "over_requirements": on_archive(_required),
    "chase_states": on_archive(lambda a: chase.chase_states(_required(a))),
    **{name: _slice(**spec) for name, spec in SLICES.items()},
    "slice_career": _slice(metric="strike_rate", least_balls=30),
    "slice_season": _slice(subject="bowler", metric="wickets", per="season"),
    "slice_match": _slice(subject="batting_team", metric="runs", per="match", phase="middle"),
    "slice_split": _slice(subject="league", metric="run_rate", split="venue"),
    "slice_result": _slice(subject="bowling_team", metric="economy", split="result", limit=None),
    "slice_state": _slice(metric="boundary_pct", innings=2, rrr_min=1.0, wickets_in_hand=(-60, 8), least_balls=3),
    "slice_styles": _slice(metric="average", bat_hand="left", split="bowl_kind", least_balls=0),
    "slice_high_score": _slice(metric="high_score", overs=(1, 6)),
    "slice_counts": _slice(metric="ducks", per="season"),
    "slice_adjusted": _slice(metric="strike_rate", adjust=True, least_balls=30),
    "slice_shrunk": _slice(metric="strike_rate", shrink=True, least_balls=30),
    "scan_filter_project": on_table("part", lambda t: t.filter(c("p_name").ilike("%ring%") & c("p_size").between(5, 40)).select("p_partkey", F.upper("p_name").alias("name"), F.when(c("p_size") < 10, "small").when(c("p_size") <= 30, "medium").otherwise("large").alias("size_class"))),
    "macro_normalise": on_table("nation", lambda t: t.select("n_nationkey", F.concat(F.when(F.split_part("n_name", F.lit("_"), F.lit(1)) == "NATION", "N").otherwise(c("n_name")), F.split_part("n_name", F.lit("_"), F.lit(2))).alias("code"))),
    "replace_columns": on_tables("customer nation", lambda t, n: t.withColumns({"c_name": F.lower("c_name"), "c_acctbal": rounded(c("c_acctbal"), 2) * 2}).join(n, c("c_nationkey") == c("n_nationkey")).drop("n_nationkey", "n_regionkey")),
    "regex_margin": on_table("orders", _priorities),
    "inner_join_dim": on_tables("lineitem part supplier", _brands),
    "triple_dim_join": on_table("nation", _thrice),
    "self_join_innings": on_archive(_self_join),
    "anti_source_union": on_table("events", _two_sources),
    "semi_years": on_tables("orders customer", _years),
    "null_safe_reconcile": on_table("lineitem", _reconcile_lines),
    "null_safe_reconcile_whole": on_tables("lineitem orders", _reconcile_whole),
    "occurrence_merge": on_table("conversations", _occurrences),
    "asof_day_pair": on_table("orders", _nearest),
    "asof_day_pair_whole": on_tables("orders lineitem", _nearest_whole),
    "filtered_aggs": on_table("lineitem", lambda t: t.groupBy("l_returnflag").agg(count_where(c("l_linestatus") == "O").alias("open_lines"), F.sum(F.when(c("l_quantity") > 25, c("l_linenumber"))).alias("big_lines"), F.round(F.var_pop(F.when(c("l_quantity") > 25, c("l_linenumber"))), 6).alias("spread"))),
    "distinct_tuple": on_table("lineitem", lambda t: t.groupBy("l_returnflag").agg(F.count_distinct(F.struct("l_partkey", "l_suppkey")).alias("pairs"))),
    "list_distinct_sorted": on_table("orders", lambda t: t.groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), "|").alias("priorities"))),
    "overs_text": on_table("events", lambda t: t.groupBy("user_id").agg(overs_text(F.count(F.lit(1))).alias("overs"))),
    "event_share": on_table("events", _shares),
    "dedupe_keep_last": on_table("lineitem", _deduped),
    "topk_tiebreak": on_table("customer", lambda t: relational.top_each(t, "c_mktsegment", [c("c_nationkey").desc(), c("c_custkey")], 3).select("c_mktsegment", "place", "c_custkey", "c_nationkey")),
    "ties_at_top": on_table("part", lambda t: relational.ties_at_top(t, "p_size", "p_brand").select("p_brand", "p_partkey", "p_size")),
    "evenly_spaced": on_table("events", lambda t: relational.evenly_spaced(t, ["user_id"], "event_id", 5).select("user_id", "event_id")),
    "keyword_search": on_table("part", lambda t: relational.search(t, ["p_name", "p_brand", "p_type"], "ring economy").select("p_partkey", "p_name", "p_type")),
    "fill_gaps": on_table("customer", _gaps),
    "fill_gaps_whole": on_tables("lineitem orders", _gaps_whole),
    "page_of_orders": on_table("orders", lambda t: t.orderBy(c("o_orderdate").desc(), "o_orderkey").offset(50).limit(25).select("o_orderkey", "o_orderdate")),
    "tumbling_batch": on_table("events", lambda t: t.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(c("w.start").alias("hour_start"), "event_type", "n")),
    "session_batch": on_table("events", _sessions),
    "json_props": on_table("events", lambda t: t.groupBy((F.get_json_object("props", "$.k").cast("long") % 10).alias("k")).agg(F.count(F.lit(1)).alias("n"))),
    **further.QUERIES,
    "html_text": on_table("pages", lambda t: t.select("page_id", F.length(without_tags(c("html"))).cast("long").alias("n_chars"))),
}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return ORACLES | SLICE_SQL | CHASE_SQL | further.ORACLES

"""Queries of ladders, as-of and interval joins, set algebra, subqueries and evaluation, each with SQL that asks the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation, innings, ladder, match_flow, nearest, relational
from ..sources import paged_feed
from ..sources.sinks import shared_folder
from . import events_archive, views
from .oracles import BASE, ORACLES as KNOWN, sql
from .slice_queries import innings_that
from .slices import SliceSpec, slice_stats

c = F.col

#: Ad-hoc SQL that groups by the two SQL functions.
ADHOC = """
SELECT franchise(m.team1) AS team, ground(m.venue) AS played_at, count(*) AS games, min(m.start_date) AS since
FROM matches m GROUP BY franchise(m.team1), ground(m.venue)
"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def adhoc_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.ask(spark, events_archive.archive(spark, sf_dir), ADHOC)


def asof_click(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every purchase with its user's last click at or before it."""
    ev = _events(spark, sf_dir)
    clicks = ev.filter("event_type = 'click'").select("user_id", c("ts").alias("click_ts"), c("event_id").alias("click_id"))
    return nearest.as_of(ev.filter("event_type = 'purchase'"), clicks, ["user_id"], "ts", "click_ts", ["click_id"]).select("event_id", "user_id", "click_id")


def asof_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order with the customer's order before it (of another day)."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    earlier = orders.select("o_custkey", c("o_orderdate").alias("at"), c("o_orderkey").alias("previous"))
    return nearest.as_of(orders, earlier, ["o_custkey"], "o_orderdate", "at", ["previous"], strict=True, width=30 * 24 * nearest.HOUR).select("o_orderkey", "o_custkey", "previous")


def interval_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user in the six hours from each purchase on: their number and value by purchase."""
    ev = _events(spark, sf_dir).withColumn("at", nearest.seconds("ts"))
    spans = ev.filter("event_type = 'purchase'").select("user_id", c("event_id").alias("purchase_id"), c("at").alias("low"), (c("at") + 21600).alias("high"))
    met = nearest.within(ev.select("user_id", "at", "event_id", "value"), spans, ["user_id"], "at", "low", "high", 21600, ["purchase_id"])
    return met.groupBy("purchase_id").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


#: Sources of the ladder: the five kinds of events, the best first, each without some of its fields.
RUNGS = ("view", "click", "signup", "purchase", "error")


def ladder_five(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By day and half of it: the kind of event that covers its users best, each user's fields filled from the other kinds."""
    ev = events_archive.events(spark, sf_dir).withColumns({"inning": F.floor(F.hour("ts") / 12).cast("long"), "k": F.get_json_object("props", "$.k").cast("long")})
    own = lambda i, name: ev.filter(c("event_type") == name).select(
        "day", "inning", "user_id", F.when(c("event_id") % 5 != i, c("value")).alias("value"), F.when(c("event_id") % 3 != i % 3, c("k")).alias("k"), F.when(c("event_id") % 2 == i % 2, c("event_id")).alias("last_id"),
    )
    return ladder.ladder({name: own(i, name) for i, name in enumerate(RUNGS)}, ["day", "inning"], ["user_id"], ["value", "k", "last_id"], least=0.8)


def bag_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of orders against days of shipping, with their numbers: more orders, more shipments, and what pairs off."""
    orders, lines = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem"))
    day = lambda df, x: df.select(c(x).cast("date").alias("day"))
    return relational.bag_differences(day(orders, "o_orderdate"), day(lines, "l_shipdate"), ["day"])


def lateral_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer with an order, and their two largest."""
    customer, orders = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "orders"))
    return relational.top_per_row(customer.select("c_custkey"), orders, "c_custkey", "o_custkey", [c("o_totalprice").desc(), c("o_orderkey")], 2, ["o_orderkey", "o_totalprice"])


def scalar_above_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders above the mean of their customer."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("cents", F.round(c("o_totalprice") * 100).cast("long"))
    return relational.above_mean(orders, orders, "o_custkey", "cents").select("o_orderkey", "o_custkey")


def exists_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with an order above 300000."""
    customer, orders = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "orders"))
    return relational.with_any(customer, orders, "c_custkey", "o_custkey", c("o_totalprice") > 300000).select("c_custkey", "c_nationkey")


def answer_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as answers: a user's day is a group of questions of one meaning, props what was named."""
    named = lambda x: F.array(F.concat(F.lit("n"), (x % 3).cast("string")), F.concat(F.lit("N"), (x % 4).cast("string")))
    answers = events_archive.events(spark, sf_dir).select(
        F.concat_ws("/", c("user_id").cast("string"), c("day").cast("string")).alias("group"), c("event_type").alias("expect"), F.when(c("event_type") != "error", c("value") > 8).alias("ok"),
        (c("event_id") % 2).cast("string").alias("signature"), evaluation.entity_match(F.when(c("event_id") % 4 > 0, named(c("event_id"))), named(c("user_id"))).alias("entities_ok"),
    )
    return evaluation.report(answers)


def paged_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events stored as pages of a feed that has a match a day, read back page by page, parsed and audited."""
    ev = _events(spark, sf_dir)
    item = F.to_json(F.struct(c("event_id").cast("string").alias("id"), c("event_id").alias("sequence"), F.round(c("value") * 100).cast("int").alias("scoreValue"), c("event_type").alias("shortText"), c("props").alias("text")))
    feed = paged_feed.answers(ev.withColumn("day", F.date_diff(c("ts").cast("date"), F.lit("2000-01-01").cast("date"))).withColumn("item", item), "day", [c("event_id"), c("item")], 100)
    path = shared_folder(spark, "pages")
    spark.dataSource.register(paged_feed.PagedFeed)
    feed.write.format("paged_feed").mode("append").save(path)
    pages = paged_feed.read_pages(spark, path)
    told = paged_feed.play_items(pages).groupBy("match_id").agg(F.sum("scoreValue").alias("cents"), F.max("sequence").alias("last_id"), F.count_distinct("shortText").alias("kinds"), F.sum(F.length("text")).alias("text_length"))
    return paged_feed.feed_status(pages).join(told, "match_id", "left")


def _short(f):
    return lambda spark, sf_dir: f(events_archive.short(spark, sf_dir).d)


#: Flow of matches of 240 balls, by the detectors' own constants.
SHORT = {
    "short_squeeze": _short(lambda d: match_flow.squeezes(match_flow.balls_so_far(d))),
    "short_burst": _short(lambda d: match_flow.bursts(match_flow.balls_so_far(d))),
    "short_chase": _short(lambda d: match_flow.chase_swings(match_flow.balls_so_far(d), d, events_archive.SHORT_BALLS)),
    "short_cluster": _short(lambda d: match_flow.wicket_clusters(match_flow.balls_so_far(d))),
    "short_maidens": _short(match_flow.maidens),
    "short_worm": _short(match_flow.worm),
    "short_falls": _short(match_flow.fall_of_wickets),
    "short_moments": _short(match_flow.key_moments),
    "short_partnerships": _short(lambda d: innings.partnerships(d).select("match_id", "inning", "wicket", "runs", "balls", "pair", "ended")),
    "short_fifties": lambda spark, sf_dir: slice_stats(events_archive.short(spark, sf_dir), SliceSpec(metric="fifties"), events_archive.SHORT_BALLS),
    "short_shifts": _short(lambda d: match_flow.match_shifts(d, events_archive.SHORT_BALLS)),
}
QUERIES = SHORT | {f.__name__: f for f in (adhoc_functions, asof_click, asof_order, interval_hours, ladder_five, bag_days, lateral_top, scalar_above_mean, exists_large, answer_report, paged_days)}

_RUNG = "CASE event_type " + " ".join(f"WHEN '{n}' THEN {i}" for i, n in enumerate(RUNGS)) + " END"
_PICK = ", ".join(f"arg_max({f}, (-rank, {f})) FILTER ({f} IS NOT NULL) AS {f}, min(rank) FILTER ({f} IS NOT NULL) AS r_{f}" for f in ("value", "k", "last_id"))
_NAMED = lambda x: f"['n' || ({x} % 3), 'n' || ({x} % 4)]"
_SET = lambda x: f"list_sort(list_distinct({x}))"
_RATE = "round(1e2 * \"right\" / nullif(n, 0), 1) AS rate"



def _changed(text: str, *pairs: tuple[str, str]) -> str:
    for old, new in pairs:
        if old not in text:
            raise ValueError(f"no {old!r} in the SQL")
        text = text.replace(old, new)
    return text


#: The same views over matches of 240 events.
_SHORT_BASE = _changed(
    BASE, ("SELECT *, date_diff('day', DATE '2000-01-01', CAST(ts AS DATE)) AS day", "SELECT * REPLACE (user_id % 6 AS user_id), event_id // 240 AS day"), ("hour(ts) // 12 + 1 AS inning", "event_id // 120 % 2 + 1 AS inning"), ("hour(ts) % 12 + 1 AS over_number", "event_id // 6 % 20 + 1 AS over_number"),
    ("event_id % 20 AS bowler_id, 'Bowler ' || (event_id % 20) AS bowler", "event_id // 6 % 11 AS bowler_id, 'Bowler ' || (event_id // 6 % 11) AS bowler"),
    ("ELSE CAST(floor(value) AS BIGINT) % 5 + user_id % 3 END AS runs_bat", "WHEN event_id // 6 % 5 IN (1, 2) THEN CASE WHEN value > 80 THEN 1 ELSE 0 END ELSE CAST(floor(value) AS BIGINT) % 5 + user_id % 3 END AS runs_bat"),
)


def _of_short(name: str, *pairs: tuple[str, str]) -> str:
    return _changed(KNOWN[name], (BASE, _SHORT_BASE), *pairs)


SHORT_SQL = {
    "short_squeeze": _of_short("shift_squeeze", ("1.0::DOUBLE * rate", "0.6::DOUBLE * rate")),
    "short_burst": _of_short("shift_burst", ("1.1::DOUBLE * rate", "1.4::DOUBLE * rate")),
    "short_chase": _of_short("shift_chase", ("160", "120"), (")) >= 3", ")) >= 12")),
    "short_cluster": _of_short("shift_wicket_cluster"),
    "short_maidens": _of_short("maidens"),
    "short_worm": _of_short("worm"),
    "short_falls": _of_short("fall_of_wickets"),
    "short_moments": _of_short("key_moments"),
    "short_partnerships": _of_short("partnerships"),
    "short_fifties": _changed(innings_that("runs BETWEEN 50 AND 99"), (BASE, _SHORT_BASE)),
}
ORACLES = SHORT_SQL | {
    "paged_days": """
WITH e AS (SELECT *, date_diff('day', DATE '2000-01-01', CAST(ts AS DATE)) AS match_id FROM events)
SELECT match_id, count(DISTINCT event_id) AS items, CAST(ceil(count(*) / 100e0) AS BIGINT) AS pages, count(*) AS expected, CAST(0 AS BIGINT) AS missing_pages,
       CASE WHEN count(DISTINCT event_id) < count(*) THEN 'partial' ELSE 'ok' END AS status, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents, max(event_id) AS last_id, count(DISTINCT event_type) AS kinds, CAST(sum(length(props)) AS BIGINT) AS text_length
FROM e GROUP BY match_id""",
    "adhoc_functions": sql("SELECT w1 AS team, ground AS played_at, count(*) AS games, min(start_date) AS since FROM g GROUP BY 1, 2"),
    "asof_click": "SELECT p.event_id, p.user_id, k.event_id AS click_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') k ON p.user_id = k.user_id AND p.ts >= k.ts",
    "asof_order": "SELECT o.o_orderkey, o.o_custkey, previous FROM orders o ASOF LEFT JOIN (SELECT o_custkey, o_orderdate, max(o_orderkey) AS previous FROM orders GROUP BY ALL) p ON o.o_custkey = p.o_custkey AND o.o_orderdate > p.o_orderdate",
    "interval_hours": "SELECT p.event_id AS purchase_id, count(*) AS n, min(e.event_id) AS first_id, max(e.event_id) AS last_id FROM events p JOIN events e ON e.user_id = p.user_id AND e.ts >= p.ts AND e.ts < p.ts + INTERVAL 6 HOUR WHERE p.event_type = 'purchase' GROUP BY 1",
    "ladder_five": f"""
WITH s AS (SELECT date_diff('day', DATE '2000-01-01', CAST(ts AS DATE)) AS day, hour(ts) // 12 AS inning, user_id, event_type AS source, {_RUNG} AS rung, event_id, value AS v, CAST(json_extract_string(props, '$.k') AS BIGINT) AS kk FROM events),
f AS (SELECT day, inning, user_id, source, rung, CASE WHEN event_id % 5 <> rung THEN v END AS value, CASE WHEN event_id % 3 <> rung % 3 THEN kk END AS k, CASE WHEN event_id % 2 = rung % 2 THEN event_id END AS last_id FROM s),
n AS (SELECT day, inning, source, rung, count(DISTINCT user_id) AS n FROM f GROUP BY ALL),
b AS (SELECT day, inning, min(rung) AS own, arg_min(source, rung) AS source FROM (SELECT *, max(n) OVER (PARTITION BY day, inning) AS most FROM n) WHERE n * 1e0 / most >= 0.8 GROUP BY ALL),
m AS (SELECT f.day, f.inning, user_id, b.source, rung = own AS has, CASE WHEN rung = own THEN -1 ELSE rung END AS rank, value, k, last_id FROM f JOIN b USING (day, inning)),
a AS (SELECT day, inning, user_id, source, bool_or(has) AS has, {_PICK} FROM m GROUP BY ALL)
SELECT day, inning, user_id, source, value, k, last_id, CAST(coalesce(r_value >= 0, FALSE) AS BIGINT) + CAST(coalesce(r_k >= 0, FALSE) AS BIGINT) + CAST(coalesce(r_last_id >= 0, FALSE) AS BIGINT) AS borrowed FROM a WHERE has""",
    "html_text": "SELECT page_id, length(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)), '&amp;', '&'), '\\s+', ' ', 'g'))) AS n_chars FROM pages",
    "bag_days": """
WITH a AS (SELECT CAST(o_orderdate AS DATE) AS day FROM orders), b AS (SELECT CAST(l_shipdate AS DATE) AS day FROM lineitem)
SELECT day, side, count(*) AS n FROM (
  SELECT day, 'extra' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)
  UNION ALL SELECT day, 'missing' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)
  UNION ALL SELECT day, 'shared' FROM (SELECT * FROM a INTERSECT ALL SELECT * FROM b)) GROUP BY ALL""",
    "lateral_top": "SELECT c_custkey, o_orderkey, o_totalprice FROM (SELECT c_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY c_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM customer JOIN orders ON o_custkey = c_custkey) WHERE k <= 2",
    "scalar_above_mean": "SELECT o_orderkey, o_custkey FROM (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders) o WHERE cents > (SELECT avg(CAST(round(o_totalprice * 100) AS BIGINT)) FROM orders p WHERE p.o_custkey = o.o_custkey)",
    "exists_large": "SELECT c_custkey, c_nationkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)",
    "answer_report": f"""
WITH a AS (
  SELECT user_id || '/' || date_diff('day', DATE '2000-01-01', CAST(ts AS DATE)) AS g, event_type AS expect, CASE WHEN event_type <> 'error' THEN value > 8 END AS ok, event_id % 2 AS plan,
         CASE WHEN event_id % 4 > 0 THEN {_SET(_NAMED('event_id'))} = {_SET(_NAMED('user_id'))} END AS entities FROM events),
q AS (SELECT g, bool_and(ok) AS all_ok, bool_or(ok) AS any_ok, count(DISTINCT plan) = 1 AS one FROM a GROUP BY g HAVING count(*) > 1),
m AS (
  SELECT 'kind: ' || expect AS metric, count(ok) AS n, count(*) FILTER (ok) AS "right" FROM a GROUP BY expect
  UNION ALL SELECT 'groups all right', count(all_ok), count(*) FILTER (all_ok) FROM q
  UNION ALL SELECT 'groups consistent', count(all_ok), count(*) FILTER (all_ok = any_ok) FROM q
  UNION ALL SELECT 'groups of one plan', count(*), count(*) FILTER (one) FROM q
  UNION ALL SELECT 'entities', count(entities), count(*) FILTER (entities) FROM a
  UNION ALL SELECT 'all', count(ok), count(*) FILTER (ok) FROM a)
SELECT metric, n, "right", {_RATE} FROM m""",
}

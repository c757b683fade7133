"""Ladders, evaluation, bags, subqueries and SQL functions on small tables, and what their plans hold."""

import pytest
from helpers import SF
from pyspark.sql import functions as F

from stumpline.operators import evaluation, ladder, relational
from stumpline.plans import events_archive, further, views

c = F.col


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_ladder_chooses_and_fills(spark):
    """Five sources: one is whole but last, one short, one without a field, one repeats rows, one is empty."""
    make = lambda rows, schema="m int, i int, ball int, runs int, text string": spark.createDataFrame(rows, schema)
    sources = {
        "archive": make([(1, 1, 1, 4, None), (1, 1, 2, 0, "b"), (2, 1, 1, 1, "x")]),
        "feed": make([(1, 1, 1, 4, "four"), (1, 1, 2, 9, "B"), (2, 1, 1, None, "y"), (2, 1, 2, 3, None), (2, 1, 3, None, "z"), (2, 1, 3, None, "a")]),
        "commentary": spark.createDataFrame([(2, 1, 2, "two"), (2, 1, 9, "no such ball"), (3, None, 1, "only here")], "m int, i int, ball int, text string"),
        "demo": make([(2, 1, 3, 6, "demo"), (1, 1, 1, 5, "demo")]),
        "overs": make([]),
    }
    out = {tuple(r) for r in ladder.ladder(sources, ["m", "i"], ["ball"], ["runs", "text"]).collect()}
    assert out == {(1, 1, 1, "archive", 4, "four", 1), (1, 1, 2, "archive", 0, "b", 0), (2, 1, 1, "feed", 1, "y", 1), (2, 1, 2, "feed", 3, "two", 1), (2, 1, 3, "feed", 6, "z", 1), (3, None, 1, "commentary", None, "only here", 0)}
    told = ladder.scores(ladder.laddered(sources, ["m", "i"], ["ball"], ["runs", "text"]), ["m", "i"], ["ball"], ["runs", "text"])
    assert {(r.m, r.source): (r.rows, r.filled, r.share) for r in told.filter("m = 2").collect()} == {(2, "archive"): (1, 2, 1 / 3), (2, "feed"): (3, 3, 1.0), (2, "commentary"): (2, 2, 2 / 3), (2, "demo"): (1, 2, 1 / 3)}
    low = {(r.m, r.source) for r in ladder.ladder(sources, ["m", "i"], ["ball"], ["runs", "text"], least=0.3).collect()}
    assert low == {(1, "archive"), (2, "archive"), (3, "commentary")}


def test_answers_evaluated(spark):
    rows = [
        ("g1", "answer", True, "p", ["Kohli"], ["kohli", "Kohli"]), ("g1", "answer", True, "p", ["Kohli"], ["Dhoni"]), ("g2", "answer", True, "p", [], ["x"]), ("g2", "refuse", False, "q", ["a"], None),
        ("g3", "clarify", True, None, None, None), (None, "answer", None, "p", ["b", "A"], ["a", "B"]),
    ]
    df = spark.createDataFrame(rows, "group string, expect string, ok boolean, signature string, want array<string>, got array<string>")
    df = df.withColumn("entities_ok", evaluation.entity_match(c("want"), c("got")))
    assert [r.entities_ok for r in df.collect()] == [True, False, None, None, None, True] or [r.entities_ok for r in df.collect()] == [True, False, None, False, None, True]
    out = {r.metric: (r.n, r.right, r.rate) for r in evaluation.report(df).collect()}
    assert out["groups all right"] == (2, 1, 50.0) and out["groups consistent"] == (2, 1, 50.0) and out["groups of one plan"] == (2, 1, 50.0)
    assert out["all"] == (5, 4, 80.0) and out["kind: refuse"] == (1, 0, 0.0) and out["kind: answer"] == (3, 3, 100.0) and out["kind: clarify"] == (1, 1, 100.0)
    shares = [r[0] for r in df.select(evaluation.overlap(c("want"), c("got"))).collect()]
    assert shares[0] == 0.5 and shares[2] == 0.0


def test_bags_with_numbers_and_nulls(spark):
    make = lambda *rows: spark.createDataFrame([(r, 1) for r in rows], "x string, other int")
    out = {(r.x, r.side): r.n for r in relational.bag_differences(make("a", "a", "a", None, None, "b"), make("a", None, None, None, "c"), ["x"]).collect()}
    assert out == {("a", "extra"): 2, ("b", "extra"): 1, ("c", "missing"): 1, (None, "missing"): 1, ("a", "shared"): 1, (None, "shared"): 2}


def test_subqueries_become_joins(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for f in (further.lateral_top, further.scalar_above_mean, further.exists_large):
            text = plan(f(spark, SF))
            assert "NestedLoop" not in text and "Cartesian" not in text and "Join" in text
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_sql_functions_are_inlined(spark):
    a = events_archive.archive(spark, SF)
    df = views.ask(spark, a, "SELECT franchise('KXIP') AS x, franchise('MI') AS y, ground('Feroz Shah Kotla, Delhi') AS g, ground('Somewhere') AS h, franchise(NULL) AS n FROM matches LIMIT 1")
    assert tuple(df.first()) == ("PBKS", "MI", "Arun Jaitley Stadium", "Somewhere", None)
    text = plan(views.ask(spark, a, further.ADHOC))
    assert "Python" not in text and "HashAggregate" in text
    with pytest.raises(ValueError, match="SELECT"):
        views.ask(spark, a, "DROP TABLE x")

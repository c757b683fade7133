"""Running state by blocks, as-of and interval joins against plain walks and SQL; what their plans deal out."""

import random

import pytest
from helpers import SF
from pyspark.sql import functions as F

from stumpline.operators import nearest, prefix_scan
from stumpline.plans import events_archive

c = F.col


def table(seed, n=400):
    rng = random.Random(seed)
    return [(rng.choice(("a", "b", None)), rng.choice((None, *range(-30, 30))) if k % 9 == 0 else rng.randrange(-5000, 5000), k, rng.choice((None, 0, 1, 5, 7))) for k in range(n)]


def walked(rows):
    out, total, last = {}, {}, {}
    for g, at, k, v in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        before = total.get(g, 0)
        if v is not None:
            total[g] = before + v
            last[g] = v
        out[k] = (total.get(g), before, last.get(g))
    return out


@pytest.mark.parametrize(("width", "levels"), [(16, 2), (3, 3), (1, 1), (100_000, 2), (64, 0)])
def test_running_columns_as_walked(spark, width, levels):
    rows = table(width)
    df = spark.createDataFrame(rows, "g string, at long, k int, v int").repartition(5)
    out = prefix_scan.running(df, ["g"], ["at", "k"], sums={"s": c("v")}, before={"b": c("v")}, lasts={"l": c("v")}, width=width, levels=levels)
    assert out.columns == ["g", "at", "k", "v", "s", "b", "l"]
    got = {r.k: r for r in out.collect()}
    assert {k: (r.s, r.b, r.l) for k, r in got.items()} == walked(rows)
    assert all((got[k].g, got[k].at, got[k].v) == (g, at, v) for g, at, k, v in rows)


def test_running_of_nothing_and_of_wide_sums(spark):
    df = spark.createDataFrame([], "g string, at long, v int")
    assert prefix_scan.running(df, ["g"], ["at"], sums={"s": c("v")}).collect() == []
    big = spark.createDataFrame([("a", k, 2_000_000_000) for k in range(8)], "g string, at long, v int")  # sums beyond 32 bits, carried between blocks
    assert [r.s for r in prefix_scan.running(big, ["g"], ["at"], sums={"s": c("v")}, width=2).orderBy("at").collect()] == [2_000_000_000 * (k + 1) for k in range(8)]
    decimal = big.withColumn("v", c("v").cast("decimal(12,2)"))
    assert [int(r.s) for r in prefix_scan.running(decimal, ["g"], ["at"], sums={"s": c("v")}, width=2).orderBy("at").collect()] == [2_000_000_000 * (k + 1) for k in range(8)]


def test_one_innings_is_split(spark):
    """All balls in one innings: no task of the window gets more rows than a block has."""
    d = events_archive.archive(spark, SF).d.select("sequence", "runs_total").withColumn("match_id", F.lit(1))
    out = prefix_scan.running(d, ["match_id"], ["sequence"], sums={"s": c("runs_total")}, width=64)
    whole = d.agg(F.sum("runs_total")).first()[0]
    sizes = out.withColumn("part", F.floor(c("sequence") / 64)).groupBy("part").count()
    assert out.agg(F.max("s")).first()[0] == whole and sizes.agg(F.max("count")).first()[0] <= 64
    plan = out._jdf.queryExecution().executedPlan().toString()
    keys = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert keys and all("__block" in k for k in keys)  # rows go by group and block, nowhere by group alone


def test_as_of_as_walked(spark):
    rng = random.Random(2)
    left = [(rng.choice(("a", "b", None)), rng.choice((None, *range(40))), k) for k in range(120)]
    right = [(rng.choice(("a", "b", "c", None)), rng.choice((None, *range(40))), f"v{k}") for k in range(60)]
    a = spark.createDataFrame(left, "key string, at long, id int").repartition(3)
    b = spark.createDataFrame(right, "key string, seen long, v string").repartition(3)
    for strict in (False, True):
        want = {}
        for key, at, k in left:
            fits = [(s, v) for g, s, v in right if g == key and s is not None and at is not None and (s < at or (s == at and not strict))]
            want[k] = max(fits)[1] if fits else None
        for width in (4, 1 << 16):
            out = nearest.as_of(a, b, ["key"], "at", "seen", ["v"], strict, width).collect()
            assert {r.id: r.v for r in out} == want and len(out) == len(left)


def test_intervals_as_by_pairs(spark):
    rng = random.Random(3)
    points = [(rng.choice("ab"), rng.uniform(-20, 60), k) for k in range(200)]
    spans = [(rng.choice("ab"), s := rng.uniform(-20, 60), s + rng.uniform(-3, 25), f"i{k}") for k in range(40)]
    a, b = spark.createDataFrame(points, "key string, at double, id int"), spark.createDataFrame(spans, "key string, low double, high double, name string")
    want = sorted((k, name) for key, at, k in points for g, low, high, name in spans if g == key and low <= at < high)
    for step in (1, 10, 1000):
        assert sorted((r.id, r.name) for r in nearest.within(a, b, ["key"], "at", "low", "high", step, ["name"]).collect()) == want

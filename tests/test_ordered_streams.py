"""Streams with ordered state against the batch operators: shuffled batches, late balls, a restart, a replay."""

import itertools
import json
import os
import random

import pytest
from helpers import SF
from pyspark.sql import functions as F

from stumpline.operators import match_flow, reconcile
from stumpline.plans import events_archive
from stumpline.sources import feed_audit
from stumpline.streaming import ordered

c = F.col
SCHEMA = "match_id long, inning long, sequence long, ts timestamp, over_number long, runs_total long, is_wicket boolean, is_legal boolean, batting_team string, bowling_team string"
CLOCK = itertools.count()
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


@pytest.fixture(scope="module")
def balls(spark):
    ev = events_archive.events(spark, SF)
    d = events_archive.deliveries(ev).join(ev.select(c("event_id").alias("sequence"), "ts"), "sequence")
    return [tuple(r) for r in d.filter("match_id % 5 = 1").select(*NAMES).orderBy("ts").collect()]


@pytest.fixture(autouse=True)
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ordered.ROCKSDB)
    yield
    spark.conf.set(key, before) if before else spark.conf.unset(key)


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    text = "\n".join(json.dumps(dict(zip(NAMES, [x.isoformat() if hasattr(x, "isoformat") else x for x in r], strict=True))) for r in rows)
    (folder / f".{name}").write_text(text)
    at = 1_700_000_000 + next(CLOCK)  # the stream takes files in order of time
    os.utime(folder / f".{name}", (at, at))
    (folder / f".{name}").rename(folder / f"{name}.json")


def drained(spark, df, home, name):
    df.writeStream.format("parquet").option("path", str(home / name)).option("checkpointLocation", str(home / f"{name}-state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(str(home / name))


def shuffled(balls, batch, seed):
    """Batches whose balls are out of order among neighbours of two batches."""
    rng = random.Random(seed)
    keyed = sorted(balls, key=lambda r: balls.index(r) + rng.uniform(0, batch))
    return [keyed[i : i + batch] for i in range(0, len(keyed), batch)]


def far(day):
    """A ball long after all others, which moves the watermark."""
    import datetime

    return (-1, 1, 10**9 + day, datetime.datetime(2030, 1, day), 1, 0, False, True, "x", "y")


def read(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(folder))


def key(rows):
    return sorted(map(tuple, rows), key=repr)


def test_streams_equal_batches_over_shuffled_balls_and_a_restart(spark, balls, tmp_path):
    batches = shuffled(balls, max(20, len(balls) // 3), 1)
    feed = tmp_path / "feed"
    for i, rows in enumerate(batches[:2]):
        put(feed, f"a{i}", rows)
    scores = lambda: ordered.running_score(read(spark, feed), late="20 days")
    clusters = lambda: ordered.wicket_clusters(read(spark, feed), late="20 days")
    first = [drained(spark, f(), tmp_path, n).count() for f, n in ((scores, "scores"), (clusters, "clusters"))]
    for i, rows in enumerate(batches[2:]):
        put(feed, f"b{i}", rows)
    for day in (1, 2, 3):
        put(feed, f"c{day}", [far(day)])
    got = drained(spark, scores(), tmp_path, "scores").filter("match_id > 0")
    found = drained(spark, clusters(), tmp_path, "clusters").filter("match_id > 0")
    d = spark.createDataFrame(balls, SCHEMA)
    want = reconcile.running_score(d, list(match_flow.INNINGS), "sequence", c("runs_total"), c("is_wicket")).select("match_id", "inning", "sequence", "score")
    assert key(got.collect()) == key(want.collect()) and first[0] < want.count()
    x = match_flow.balls_so_far(d.withColumns({"is_four": F.lit(False), "is_six": F.lit(False), "commentary": F.lit("")}))
    shifts = match_flow.wicket_clusters(x)
    assert key(found.select(*shifts.columns).collect()) == key(shifts.collect()) and shifts.count() > 0


def test_late_balls_are_dropped(spark, balls, tmp_path):
    feed = tmp_path / "feed"
    half = len(balls) // 2
    late = balls[:5]
    put(feed, "a", balls[5:half])
    put(feed, "b", balls[half:])
    put(feed, "c", [balls[-1][:2] + (10**6, *balls[-1][3:])])  # the watermark stands at the end of b from here on
    put(feed, "d", late)
    for day in (1, 2):
        put(feed, f"e{day}", [far(day)])
    got = drained(spark, ordered.running_score(read(spark, feed), late="1 hour"), tmp_path, "out").filter("match_id > 0")
    ids = {r.sequence for r in got.collect()}
    assert ids == {b[2] for b in balls[5:]} | {10**6}


def test_feed_audit_after_a_replay(spark, balls, tmp_path):
    """Each batch is logged once, though the stream dies after writing it and comes again."""
    feed, log = tmp_path / "feed", f"file://{tmp_path}/log"
    own = [b for b in balls if b[1] == 1]
    for i in range(3):
        put(feed, f"a{i}", own[i::3])
    expected = spark.createDataFrame(own, SCHEMA).groupBy("match_id").agg(F.count(F.lit(1)).alias("items"))
    first = expected.agg(F.min("match_id")).first()[0]
    expected = expected.withColumn("items", c("items") + (c("match_id") == first).cast("long")).union(spark.createDataFrame([(-7, 3)], "match_id long, items long"))
    died = []

    def dies(batch, number):
        feed_audit.log_batch(batch, number, log)
        if number == 1 and not died:
            died.append(number)
            raise RuntimeError("lost after the batch was written")

    def run(each):
        return read(spark, feed).writeStream.foreachBatch(each).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()

    with pytest.raises(Exception, match="lost after"):
        run(dies).awaitTermination()
    run(dies).awaitTermination()
    assert died == [1]
    told = {r.match_id: (r.balls, r.status) for r in feed_audit.audit(spark, log, expected).collect()}
    n = {r.match_id: r["count"] for r in spark.createDataFrame(own, SCHEMA).groupBy("match_id").count().collect()}
    assert told == {**{m: (k, "partial" if m == first else "ok") for m, k in n.items()}, -7: (0, "no_balls")}
    assert spark.read.parquet(log).select("batch").distinct().count() == 3
    # A ball that a later batch brings again counts once.
    put(feed, "b0", own[:4])
    run(lambda b, k: feed_audit.log_batch(b, k, log)).awaitTermination()
    assert {r.match_id: (r.balls, r.status) for r in feed_audit.audit(spark, log, expected).collect()} == told

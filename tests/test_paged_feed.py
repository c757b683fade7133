"""The paged feed: batch, stream and write agree; short, missing and broken pages are told."""

import json

import pytest
from pyspark.sql import functions as F

from stumpline.sources import paged_feed, play_by_play

PUSH = "spark.sql.python.filterPushdown.enabled"


def put(home, fetch, match, *pages, whole=True):
    folder = home / str(fetch) / str(match)
    folder.mkdir(parents=True, exist_ok=True)
    for n, body in enumerate(pages, 1):
        if body is not None:
            (folder / f"{n}.json").write_text(body if isinstance(body, str) else json.dumps(body))
    if whole:
        (home / str(fetch) / "_SUCCESS").touch()


def page(items, count, pages):
    return {"commentary": {"items": items, "count": count, "pageCount": pages}}


def ball(i, score=1, **more):
    return {"id": i, "sequence": i, "scoreValue": score, "shortText": f"ball {i}", "period": 1, "over": {"number": 1, "ball": i % 6 + 1}, "batsman": {"runs": score, "athlete": {"id": "7", "displayName": "Ann Ü"}}, **more}


@pytest.fixture
def feed(tmp_path):
    home = tmp_path / "feed"
    put(home, 1, 11, page([ball(1), ball(2)], 4, 2), page([ball(3), ball(4)], 4, 2))
    put(home, 1, 12, page([ball(1), ball(2)], 4, 2))  # the second page never came
    put(home, 1, 13, {"code": 2404})
    put(home, 1, 14, "<html>busy", {"message": "later"})
    put(home, 1, 15, page([ball(1)], 3, 1))  # fewer items than the feed counts
    put(home, 1, 16, page([], 0, 1))
    return home


def status(pages, listed=None):
    return {r.match_id: (r.items, r.pages, r.expected, r.missing_pages, r.status) for r in paged_feed.feed_status(pages, listed).collect()}


FIRST = {11: (4, 2, 4, 0, "ok"), 12: (2, 1, 4, 1, "partial"), 13: (0, 0, None, 0, "no_balls"), 14: (0, 0, None, 0, "error"), 15: (1, 1, 3, 0, "partial"), 16: (0, 1, 0, 0, "no_balls")}


def test_status_of_each_match(spark, feed):
    pages = paged_feed.read_pages(spark, str(feed))
    assert status(pages) == FIRST
    listed = spark.createDataFrame([(11,), (99,), (99,)], "match_id long")
    assert status(pages, listed) == FIRST | {99: (0, 0, None, 0, "no_balls")}
    assert {r.match_id for r in paged_feed.to_fetch(spark.range(11, 18).toDF("match_id"), paged_feed.feed_status(pages)).collect()} == {12, 13, 14, 15, 16, 17}
    assert status(paged_feed.read_pages(spark, f"file://{feed}", 1)) == FIRST


def test_a_later_fetch_mends_an_earlier_one(spark, feed):
    put(feed, 2, 12, page([ball(1, 6), ball(2)], 3, 2), page([ball(3)], 3, 2))
    put(feed, 10, 14, page([ball(5), ball(5, 4)], 1, 1))
    put(feed, 11, 16, page([ball(9)], 1, 1), whole=False)  # without a marker it does not count
    pages = paged_feed.read_pages(spark, str(feed))
    assert status(pages) == FIRST | {12: (3, 2, 3, 0, "ok"), 14: (1, 1, 1, 0, "ok")}
    runs = {(r.match_id, r.sequence): r.scoreValue for r in paged_feed.play_items(pages).collect()}
    assert runs[12, 1] == 6 and runs[12, 3] == 1 and runs[14, 5] in (1, 4)


def test_pages_become_deliveries(spark, feed):
    d = play_by_play.deliveries(paged_feed.play_items(paged_feed.read_pages(spark, str(feed))))
    assert {(r.match_id, r.sequence, r.runs_bat, r.batter) for r in d.filter("match_id = 11").collect()} == {(11, i, 1, "Ann Ü") for i in range(1, 5)}


def test_season(spark, feed, tmp_path):
    entries = [{"objectId": i, "format": "T20", "stage": "FINISHED", "season": "2024", "teams": []} for i in (11, 12, 99)] + [{"objectId": 15, "format": "ODI", "stage": "FINISHED", "teams": []}]
    (tmp_path / "list.json").write_text("\n".join(map(json.dumps, entries)))
    matches, balls, log = paged_feed.ingest(spark, str(feed), play_by_play.read_entries(spark, str(tmp_path / "list.json")))
    assert {r.match_id for r in matches.collect()} == {11, 12, 99}
    assert {(r.match_id, r["count"]) for r in balls.groupBy("match_id").count().collect()} == {(11, 4), (12, 2)}
    assert {r.match_id: r.status for r in log.collect()} == {11: "ok", 12: "partial", 99: "no_balls"}


def test_match_filter_leaves_pages_unread(spark, feed):
    before = spark.conf.get(PUSH)
    spark.conf.set(PUSH, "true")
    try:
        pages = paged_feed.read_pages(spark, str(feed), 1)
        assert pages.rdd.getNumPartitions() == 8
        for condition, parts, rows in (("match_id = 11", 2, 4), ("match_id in (11, 15)", 3, 5), ("match_id in (11, 15) and match_id = 15 and page = 1", 1, 1)):
            some = pages.filter(condition)
            assert (some.rdd.getNumPartitions(), some.count()) == (parts, rows)
        assert {r.match_id for r in pages.filter("match_id = 11").collect()} == {11} and pages.filter("match_id = 77").count() == 0
    finally:
        spark.conf.set(PUSH, before)


def test_partitions_are_ranges_of_pages(feed):
    parts = paged_feed.page_ranges(str(feed), [1], None, 3)
    assert [len(p.pages) for p in parts] == [3, 3, 2] and parts[0].pages == [(1, 11, 1), (1, 11, 2), (1, 12, 1)]


def test_stream_equals_batch_and_resumes(spark, feed, tmp_path):
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    spark.dataSource.register(paged_feed.PagedFeed)

    def run():
        s = spark.readStream.format("paged_feed").load(str(feed)).writeStream.format("parquet").option("checkpointLocation", check).trigger(availableNow=True).start(out)
        s.awaitTermination()
        return spark.read.parquet(out)

    run()
    put(feed, 2, 12, page([ball(1, 6), ball(2)], 3, 2), page([ball(3)], 3, 2))
    got = run()
    want = paged_feed.read_pages(spark, str(feed))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect()))
    assert run().count() == want.count()
    assert status(got) == FIRST | {12: (3, 2, 3, 0, "ok")}


def test_write_and_read_back(spark, tmp_path):
    path = str(tmp_path / "new")
    items = spark.range(57).select((F.col("id") % 2 + 1).alias("m"), F.col("id"), F.to_json(F.struct("id", F.lit('quote " and\nline').alias("text"))).alias("item"))
    spark.dataSource.register(paged_feed.PagedFeed)
    for _ in range(2):
        paged_feed.answers(items, "m", [F.col("id")], 10).write.format("paged_feed").mode("append").save(path)
    assert paged_feed.whole_fetches(path) == [1, 2]
    pages = paged_feed.read_pages(spark, path)
    assert status(pages) == {1: (29, 3, 29, 0, "ok"), 2: (28, 3, 28, 0, "ok")}
    assert {r.text for r in paged_feed.play_items(pages).collect()} == {'quote " and\nline'}
    assert [r.sequence for r in paged_feed.play_items(paged_feed.read_pages(spark, str(tmp_path / "none"))).collect()] == []

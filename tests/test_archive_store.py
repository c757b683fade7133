"""Bucketed archive: versions switched by one pointer, and plans without an exchange."""

import pytest
from helpers import SF
from pyspark.sql import Window
from pyspark.sql import functions as F

from stumpline.operators import innings
from stumpline.plans import events_archive, views
from stumpline.sources.archive_store import ArchiveStore, replaced

c = F.col


@pytest.fixture
def store(spark, tmp_path):
    return ArchiveStore(spark, f"file://{tmp_path}/archive", buckets=4)


@pytest.fixture
def tables(spark):
    a = events_archive.archive(spark, SF)
    return {name: getattr(a, field) for name, field in views.VIEWS.items()}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_windows_and_joins_by_match_need_no_exchange(spark, store, tables):
    store.rebuild(tables)
    t = store.tables()
    d = t["deliveries"]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        upto = d.withColumn("total", F.sum("runs_total").over(Window.partitionBy("match_id", "inning").orderBy("sequence")))
        first = d.filter("inning = 1").groupBy("match_id").agg(F.sum("runs_total").alias("first_total"))
        chased = d.filter("inning = 2").join(first, "match_id").join(t["matches"], "match_id")
        for df in (upto, first, chased):
            assert "Exchange" not in plan(df) and "Bucketed: true" in plan(df)
        want = tables["deliveries"].withColumn("total", F.sum("runs_total").over(Window.partitionBy("match_id", "inning").orderBy("sequence")))
        key = lambda df: sorted(map(tuple, df.select("match_id", "inning", "sequence", "total").collect()))
        assert key(upto) == key(want)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    files = [f for f in d.inputFiles()]
    assert len(files) <= 4  # one for each bucket


def test_a_reader_keeps_its_version(spark, store, tables):
    with pytest.raises(ValueError, match="no archive"):
        store.tables()
    store.rebuild(tables)
    old = store.tables()
    n, games = old["deliveries"].count(), old["matches"].count()
    first = old["matches"].agg(F.min("match_id")).first()[0]
    less = {k: v.filter(c("match_id") != first) if "match_id" in v.columns else v for k, v in old.items()}
    store.rebuild(less)
    assert old["deliveries"].count() == n and old["matches"].count() == games  # opened before: all old
    new = store.tables()
    assert new["matches"].count() == games - 1 and new["deliveries"].filter(c("match_id") == first).count() == 0  # all new


def test_a_rebuild_that_dies_is_not_seen(spark, store, tables):
    store.rebuild(tables)
    now = store.version()
    broken = tables | {"zz_last": tables["matches"].select(F.raise_error(F.lit("lost")).alias("x"))}
    with pytest.raises(Exception, match="lost"):
        store.rebuild(broken)
    assert store.version() == now and len(store.versions()) == 2
    assert store.tables()["matches"].count() == tables["matches"].count()
    gone = store.forget(keep=0)
    assert len(gone) == 1 and store.versions() == [now.split("\t")[0]]
    assert store.tables()["matches"].count() == tables["matches"].count()


def test_another_session_knows_the_buckets(spark, store, tables):
    store.rebuild(tables)
    name = store.version().split("\t")[0]
    for t in tables:  # as a session that did not write it: nothing in the catalog
        spark.sql(f"DROP TABLE {name}_{t}")
    d = ArchiveStore(spark, store.home, buckets=4).tables()["deliveries"]
    df = d.groupBy("match_id", "inning").agg(F.sum("runs_total").alias("n"))
    assert "Exchange" not in plan(df) and df.count() == tables["deliveries"].select("match_id", "inning").distinct().count()


def test_matches_replaced_in_a_rebuild(spark, store, tables):
    store.rebuild(tables)
    one = tables["deliveries"].agg(F.min("match_id")).first()[0]
    news = {"deliveries": tables["deliveries"].filter(c("match_id") == one).withColumn("runs_total", c("runs_total") + 100)}
    store.rebuild(replaced(store.tables(), news))
    d, was = store.tables()["deliveries"], tables["deliveries"]
    assert d.count() == was.count()
    total = lambda df: {r[0]: r[1] for r in df.groupBy("match_id").agg(F.sum("runs_total")).collect()}
    a, b = total(d), total(was)
    assert {k for k in a if a[k] != b[k]} == {one}
    assert innings.innings_totals(d).count() == innings.innings_totals(was).count()

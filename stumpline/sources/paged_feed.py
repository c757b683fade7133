"""A feed that answers in pages, as a Python data source: stored pages are read in batch or as a stream, and written.

Pages lie as `<path>/<fetch>/<match_id>/<page>.json`, each the whole answer of the feed: `{"commentary": {"items": [...],
"count": all items of the match, "pageCount": its pages}}`, or an error with a `code`.  A fetch is one round of asking,
numbered upwards; it counts once its marker `_SUCCESS` is there.  A match may be fetched again, and then an item's latest
fetch is taken, as a page can change between two rounds.

Register with `spark.dataSource.register(PagedFeed)`, then `spark.read.format("paged_feed").load(path)`.  A partition is a
range of `pages_per_task` pages.  A condition `match_id = n` or `match_id IN (...)` leaves other matches' pages unread where
spark.sql.python.filterPushdown.enabled is true (read_pages asks the session).  The stream's offset is the number of the last whole fetch.  Folders are reached
through Arrow's file systems (a local path, file:, hdfs:, s3:, gs:), in the driver and in the executors alike, which need this package (--py-files).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from ..operators.relational import keep_last
from . import play_by_play
from .schemas import PLAY_ITEM

c = F.col
#: Fixed value: the code under which a feed says that it has no data for a match.
NOT_FOUND = 2404
MARKER = "_SUCCESS"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
#: One row an item; a page without items has one row without an item.  problem: not_found, incomplete (no commentary) or null.
PAGES = "fetch bigint, match_id bigint, page int, pages bigint, expected bigint, problem string, item string"
#: What is written: the whole answer of each page.
ANSWERS = "match_id bigint, page int, body string"


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    path = re.sub(r"^(?:file:/*)?/", "file:///", path.rstrip("/"))
    return fs.FileSystem.from_uri(path)


def _folders(store: fs.FileSystem, path: str) -> list[fs.FileInfo]:
    return store.get_file_info(fs.FileSelector(path, allow_not_found=True))


def whole_fetches(path: str) -> list[int]:
    """Numbers of the fetches that have their marker, in order."""
    store, root = _store(path)
    found = sorted(int(f.base_name) for f in _folders(store, root) if f.type == fs.FileType.Directory and f.base_name.isdigit())
    return [n for n in found if store.get_file_info(f"{root}/{n}/{MARKER}").type == fs.FileType.File]


@dataclass
class PageRange(InputPartition):
    """(fetch, match_id, page) of consecutive stored pages."""

    pages: list[tuple[int, int, int]]


def page_ranges(path: str, fetches: list[int], matches: set[int] | None, size: int) -> list[PageRange]:
    """All pages of these fetches in order, those of a few matches only if told, in ranges of `size`."""
    store, root = _store(path)
    out = []
    for n in fetches:
        for folder in _folders(store, f"{root}/{n}"):
            if folder.base_name.isdigit() and (matches is None or int(folder.base_name) in matches):
                names = (re.fullmatch(r"(\d+)\.json", f.base_name) for f in _folders(store, folder.path))
                out += [(n, int(folder.base_name), int(name[1])) for name in names if name]
    out.sort()
    return [PageRange(out[i : i + size]) for i in range(0, len(out), size)]


def page_rows(body: str) -> Iterator[tuple]:
    """(pages, expected, problem, item) of one answer."""
    try:
        answer = json.loads(body)
    except ValueError:
        answer = None
    answer = answer if isinstance(answer, dict) else {}
    if answer.get("code") == NOT_FOUND:
        yield None, None, "not_found", None
    elif not isinstance(answer.get("commentary"), dict):
        yield None, None, "incomplete", None
    else:
        part = answer["commentary"]
        head = (int(part.get("pageCount") or 1), int(part.get("count") or 0), None)
        items = part.get("items") or [None]
        yield from ((*head, None if i is None else json.dumps(i, ensure_ascii=False)) for i in items)


def _read(path: str, part: PageRange) -> Iterator[pa.RecordBatch]:
    """One record batch a page."""
    store, root = _store(path)
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string())
    names = [x.split()[0] for x in PAGES.split(", ")]
    for fetch, match, page in part.pages:
        with store.open_input_stream(f"{root}/{fetch}/{match}/{page}.json") as f:
            rows = [(fetch, match, page, *r) for r in page_rows(f.read().decode("utf-8", "replace"))]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


class _Reader(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size
        self.matches: set[int] | None = None

    def partitions(self) -> list[PageRange]:
        return page_ranges(self.path, whole_fetches(self.path), self.matches, self.size) or [PageRange([])]

    def read(self, partition: PageRange) -> Iterator[pa.RecordBatch]:
        return _read(self.path, partition)


class _MatchReader(_Reader):
    """A reader that takes conditions on match_id over (Spark refuses such a reader where pushdown is off)."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            own = isinstance(f, (EqualTo, In)) and f.attribute == ("match_id",)
            if not own:
                yield f
                continue
            wanted = {x for x in ([f.value] if isinstance(f, EqualTo) else f.value) if x is not None}
            self.matches = wanted if self.matches is None else self.matches & wanted


class _StreamReader(DataSourceStreamReader):
    """Whole fetches by number; a fetch whose marker comes after that of a later number is not read any more."""

    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def initialOffset(self) -> dict:
        return {"fetch": -1}

    def latestOffset(self) -> dict:
        return {"fetch": max(whole_fetches(self.path), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[PageRange]:
        new = [n for n in whole_fetches(self.path) if start["fetch"] < n <= end["fetch"]]
        return page_ranges(self.path, new, None, self.size) or [PageRange([])]

    def read(self, partition: PageRange) -> Iterator[pa.RecordBatch]:
        return _read(self.path, partition)


class _Writer(DataSourceWriter):
    """Stores answers as pages of one fetch.  A task that runs again writes the same files; the marker comes last."""

    def __init__(self, path: str, fetch: int):
        self.path, self.fetch = path, fetch

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        store, root = _store(self.path)
        for row in iterator:
            folder = f"{root}/{self.fetch}/{row.match_id}"
            store.create_dir(folder, recursive=True)
            with store.open_output_stream(f"{folder}/{row.page}.json") as f:
                f.write((row.body or "").encode())
        return WriterCommitMessage()

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = _store(self.path)
        store.create_dir(f"{root}/{self.fetch}", recursive=True)
        with store.open_output_stream(f"{root}/{self.fetch}/{MARKER}"):
            pass

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """Without a marker the fetch is not there for readers."""


class PagedFeed(DataSource):
    """Options: path, pages_per_task (64), push (true: conditions on match_id choose pages), fetch (of a write: its number, by default the next one)."""

    @classmethod
    def name(cls) -> str:
        return "paged_feed"

    def schema(self) -> str:
        return PAGES

    def _size(self) -> int:
        return max(1, int(self.options.get("pages_per_task", 64)))

    def reader(self, schema) -> _Reader:
        kind = _MatchReader if self.options.get("push", "false") == "true" else _Reader
        return kind(self.options["path"], self._size())

    def streamReader(self, schema) -> _StreamReader:
        return _StreamReader(self.options["path"], self._size())

    def writer(self, schema, overwrite: bool) -> _Writer:
        path = self.options["path"]
        number = self.options.get("fetch")
        return _Writer(path, max(whole_fetches(path), default=0) + 1 if number is None else int(number))


def answers(items: DataFrame, match: str, order: list, size: int = 25) -> DataFrame:
    """match_id, page, body: items (a column of JSON text `item`) as a feed would answer, `size` to a page in that order."""
    x = items.select(c(match).cast("long").alias("match_id"), "item", F.struct(*order).alias("at"))
    x = x.withColumn("n", F.row_number().over(Window.partitionBy("match_id").orderBy("at")) - 1)
    count = x.groupBy("match_id").agg(F.count(F.lit(1)).alias("count"))
    page = x.groupBy("match_id", (F.floor(c("n") / size) + 1).cast("int").alias("page")).agg(F.array_sort(F.collect_list(F.struct("n", "item")))["item"].alias("items"))
    body = F.concat(F.lit('{"commentary":{"count":'), c("count"), F.lit(',"pageCount":'), F.ceil(c("count") / size), F.lit(',"items":['), F.array_join("items", ","), F.lit("]}}"))
    return page.join(count, "match_id").select("match_id", "page", body.alias("body"))


def read_pages(spark: SparkSession, path: str, pages_per_task: int = 64) -> DataFrame:
    spark.dataSource.register(PagedFeed)
    return spark.read.format("paged_feed").option("pages_per_task", pages_per_task).option("push", spark.conf.get(PUSHDOWN)).load(path)


def latest_items(pages: DataFrame) -> DataFrame:
    """fetch, match_id, id, item: each item of a match once, as its latest fetch has it (then its highest page)."""
    x = pages.filter("item is not null").withColumn("id", F.get_json_object("item", "$.id"))
    return keep_last(x, ["match_id", "id"], [c("fetch").desc(), c("page").desc(), c("item").desc()]).select("fetch", "match_id", "id", "item")


def play_items(pages: DataFrame) -> DataFrame:
    """Items as play_by_play.deliveries takes them."""
    return latest_items(pages).select("match_id", F.from_json("item", PLAY_ITEM).alias("i")).select(*(c("match_id") if f.name == "match_id" else c(f"i.{f.name}") for f in PLAY_ITEM.fields))


def feed_status(pages: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """match_id, items, pages, expected, missing_pages, status of every match fetched, and of every match of listed.

    Status: no_balls (the feed has none, or none came), error (pages without commentary and no items), partial (fewer
    items than the feed counts, or a page missing or unreadable), ok.  The count is that of the latest fetch; a page
    counts as there if any fetch has it.
    """
    items = latest_items(pages).groupBy("match_id").agg(F.count(F.lit(1)).alias("items"))
    told = F.struct("fetch", "page")
    whole = F.when(c("problem").isNull(), c("page"))
    seen = pages.groupBy("match_id").agg(
        F.count_distinct(whole).alias("pages"), F.max_by("expected", F.when(c("expected").isNotNull(), told)).alias("expected"), F.max_by("pages", F.when(c("pages").isNotNull(), told)).alias("of"),
        F.bool_or(F.coalesce(c("problem") == "not_found", F.lit(False))).alias("unknown"), F.bool_or(F.coalesce(c("problem") == "incomplete", F.lit(False))).alias("broken"),
    )
    x = seen.join(items, "match_id", "left")
    if listed is not None:
        x = listed.select("match_id").distinct().join(x, "match_id", "full")
    zero = lambda k: F.coalesce(c(k), F.lit(0).cast("long"))
    missing = F.greatest(zero("of") - zero("pages"), F.lit(0).cast("long"))
    status = (
        F.when((zero("items") == 0) & F.coalesce(c("broken"), F.lit(False)) & ~F.coalesce(c("unknown"), F.lit(False)), "error").when(zero("items") == 0, "no_balls").when((zero("items") < zero("expected")) | (missing > 0), "partial").otherwise("ok")
    )
    return x.select("match_id", zero("items").alias("items"), zero("pages").alias("pages"), "expected", missing.alias("missing_pages"), status.alias("status"))


def to_fetch(listed: DataFrame, status: DataFrame | None = None) -> DataFrame:
    """Listed matches that are not whole yet: those never fetched, and those partial, in error or without balls."""
    return listed if status is None else listed.join(status.filter("status = 'ok'").select("match_id"), "match_id", "left_anti")


def ingest(spark: SparkSession, path: str, entries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A season from its stored list and pages: matches, their deliveries, and the log by match.

    entries: the season's list (play_by_play.read_entries); what is no match to ingest is left out, and so are the
    balls of matches that it does not list.
    """
    matches = play_by_play.match_entries(entries.filter(play_by_play.ingestable()))
    listed = matches.select("match_id").distinct()
    pages = read_pages(spark, path).join(listed, "match_id", "left_semi")
    return matches, play_by_play.deliveries(play_items(pages)), feed_status(pages, listed)

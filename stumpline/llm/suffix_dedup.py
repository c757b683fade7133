"""Substring deduplication on bytes with suffix sorting by difference covers.

A byte goes if a string of WINDOW bytes that covers it also starts anywhere else.

Spark brings together what can be equal: every window has an anchor (the smallest hash of GRAM bytes inside it), equal
windows have equal anchors at the same place, and only anchors that occur again are followed.  The text around such an
anchor (all windows that it represents) is one segment; segments travel by anchor.  A task takes whole anchors, a few
megabytes at a time, and sorts their window starts blockwise, one suffix bucket (anchor, place of the anchor in the
window) after the other in the order of bucket numbers:

* ranks of the cover sample are computed first: positions whose remainder modulo PERIOD lies in the difference cover
  COVER are ranked by their first 64 bytes and then by doubling (strides 57, 114, 228) to a depth of 463 bytes;
* a bucket is sorted by three-way partitioning.  Two suffixes are compared by eight words of 8 bytes; if these tie, the
  cover has a shift below PERIOD that takes both into the sample, whose ranks decide;
* neighbours in a bucket that agree over WINDOW bytes are repeats.

Memory is bounded by the text of one anchor (equal segments count once) or CHUNK bytes, whichever is more.  An anchor
with more than `hot` occurrences does not go to one task: its windows are compared by their SHA-free 64-bit hashes in
an aggregation with partial counts, the exact way for the rest.

Equal texts, known by their whole SHA-256, are handled once: they repeat as a whole if they have WINDOW bytes.

Defined results: null text is empty; texts shorter than WINDOW stay; matches never cross documents; rows that repeat a
doc_id are documents of their own; empty table, empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, arrow_map, buffers, pieces, prefix_hash, range_hash, spans, stored, strings
from .winnow import anchors, fetched, numbered, text_digest

WINDOW, GRAM = 400, 48
PART = 1 << 20
CHUNK = 2 << 20
NOTHING = hashlib.sha256(b"").hexdigest()
#: A perfect difference set; each difference modulo 57 occurs once.
PERIOD, COVER = 57, (0, 1, 3, 13, 32, 36, 43, 52)
STRIDES = (57, 114, 228)
DEPTH = 64 + sum(STRIDES)


def shifts() -> np.ndarray:
    """[a, b]: the smallest shift that takes positions with remainders a and b both into the cover."""
    out = np.full((PERIOD, PERIOD), -1, np.int64)
    inside = np.isin(np.arange(PERIOD), COVER)
    for d in range(PERIOD - 1, -1, -1):
        a = inside[(np.arange(PERIOD) + d) % PERIOD]
        out[np.ix_(a, a)] = d
    return out


SHIFT = shifts()


def dense(*keys: np.ndarray) -> np.ndarray:
    """Dense ranks of rows by keys, the last first (as lexsort has it)."""
    order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= k[order[1:]] != k[order[:-1]]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


class CoverSuffixes:
    """Suffixes of a byte string, comparable through the ranks of a cover sample."""

    def __init__(self, text: np.ndarray):
        n = len(text)
        padded = np.concatenate((text, np.zeros(DEPTH + 128, np.uint8)))
        self.words = np.empty(n + DEPTH + 64, np.uint64)
        for r in range(8):
            part = padded[r:]
            self.words[r::8] = part[: len(part) // 8 * 8].view(">u8")[: len(self.words[r::8])]
        sample = np.flatnonzero(np.isin(np.arange(n + PERIOD) % PERIOD, COVER))
        place = np.full(n + PERIOD + sum(STRIDES) + 1, -1, np.int64)
        place[sample] = np.arange(len(sample))
        rank = dense(*(self.words[sample + 8 * w] for w in range(7, -1, -1)))
        for stride in STRIDES:
            later = place[sample + stride]
            rank = dense(np.where(later >= 0, rank[later], -1), rank)
        self.rank = np.zeros(n + PERIOD, np.int32)
        self.rank[sample] = rank

    def compared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 as suffix a is below, equal to (over DEPTH bytes) or above suffix b."""
        out = np.zeros(len(a), np.int8)
        open_ = np.arange(len(a))
        for w in range(8):
            x, y = self.words[a[open_] + 8 * w], self.words[b[open_] + 8 * w]
            out[open_] = (x > y).astype(np.int8) - (x < y)
            open_ = open_[x == y]
            if not len(open_):
                return out
        d = SHIFT[a[open_] % PERIOD, b[open_] % PERIOD]
        x, y = self.rank[a[open_] + d], self.rank[b[open_] + d]
        out[open_] = (x > y).astype(np.int8) - (x < y)
        return out

    def same(self, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
        """Whether the first `length` (a multiple of 8) bytes agree."""
        out = np.ones(len(a), bool)
        open_ = np.arange(len(a))
        for w in range(length // 8):
            equal = self.words[a[open_] + 8 * w] == self.words[b[open_] + 8 * w]
            out[open_[~equal]] = False
            open_ = open_[equal]
        return out

    def sort_buckets(self, starts: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order of the suffixes by bucket and content, and whether each equals the one before it over DEPTH bytes."""
        order = np.argsort(bucket, kind="stable")
        group = np.cumsum(np.diff(bucket[order], prepend=bucket[order[:1]]) != 0) if len(order) else bucket
        equal = np.zeros(len(order), bool)
        live = np.arange(len(order))
        while True:
            # Of the open places keep those in groups of two or more.
            g = group[live]
            head = np.flatnonzero(np.diff(g, prepend=-1))
            size = np.diff(np.append(head, len(g)))
            keep = np.repeat(size > 1, size)
            live, g = live[keep], g[keep]
            if not len(live):
                return order, equal
            head = np.flatnonzero(np.diff(g, prepend=-1))
            size = np.diff(np.append(head, len(g)))
            pivot = np.repeat(starts[order[live[head + size // 2]]], size)
            way = self.compared(starts[order[live]], pivot)
            turn = np.lexsort((way, g))
            order[live], way = order[live][turn], way[turn]
            # Groups split in three; what equals its pivot is done.
            new = np.ones(len(live), bool)
            new[1:] = (g[1:] != g[:-1]) | (way[1:] != way[:-1])
            equal[live[~new & (way == 0)]] = True
            first = live[np.flatnonzero(new)]
            group[live] = np.repeat(first, np.diff(np.append(np.flatnonzero(new), len(live)))) + len(order)  # unique, ascending
            live = live[way != 0]


def repeated_windows(segments: list[bytes], anchor: np.ndarray, place: np.ndarray, times: np.ndarray, window: int) -> list[np.ndarray]:
    """For each distinct segment of some anchors, whether each of its windows starts anywhere else too.

    place: where the anchor lies in the first window; times: how often the segment occurs.
    """
    size = np.array([len(s) for s in segments], np.int64)
    at = np.concatenate(([0], np.cumsum(size)))
    counts = size - window + 1
    starts = spans(at[:-1], counts)
    owner = np.repeat(np.arange(len(size)), counts)
    bucket = anchor[owner] * (window + 1) + place[owner] - (starts - at[owner])
    again = times[owner] > 1
    alone = np.bincount(anchor)[anchor] == 1
    use = np.flatnonzero(~alone[owner])
    if len(use):
        suffixes = CoverSuffixes(np.frombuffer(b"".join(segments), np.uint8))
        order, equal = suffixes.sort_buckets(starts[use], bucket[use])
        s, b = starts[use][order], bucket[use][order]
        ask = np.flatnonzero((b[1:] == b[:-1]) & ~equal[1:]) + 1
        equal[ask] = suffixes.same(s[ask], s[ask - 1], window)
        both = equal.copy()
        both[:-1] |= equal[1:]
        again[use[order[both]]] = True
    ends = np.concatenate(([0], np.cumsum(counts)))
    return [again[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8)))
    return edge[::2], edge[1::2]


def _grams(data: np.ndarray) -> np.ndarray:
    """Hashes of the GRAM bytes from each place on (0 where too few are left)."""
    out = np.zeros(len(data), np.uint64)
    if len(data) >= GRAM:
        prefix = prefix_hash(data)
        first = np.arange(len(data) - GRAM + 1)
        out[: len(first)] = range_hash(prefix, first, first + GRAM)
    return out


def _base(docs: DataFrame, key: str, text: str, window: int) -> DataFrame:
    """doc_id, n_bytes, sha, fps (anchors of all windows; one that occurs twice is there twice)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 1, PART):
                data, at = buffers(batch.column(1))
                grams = _grams(data)
                start, place, window_at = anchors(grams, at, GRAM, window)
                new = np.ones(len(place), bool)
                new[1:] = place[1:] != place[:-1]
                fp_at = np.concatenate(([0], np.cumsum(new)))[window_at]
                shas = [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(fp_at, pa.int32()), pa.array(grams[place[new]].view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at)), pa.array(shas, pa.string()), lists], ["doc_id", "n_bytes", "sha", "fps"])

    columns = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return arrow_map(columns, run, "doc_id long, n_bytes long, sha string, fps array<long>")


def _windows(batch: pa.RecordBatch, window: int):
    """Bytes, text offsets, and of the windows with an anchor in the list column 2: text row, start, anchor's place and hash."""
    data, at = buffers(batch.column(1))
    grams = _grams(data)
    start, place, window_at = anchors(grams, at, GRAM, window)
    fps, hit = grams[place].view(np.int64), np.zeros(len(start), bool)
    lists = batch.column(2)
    values, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy(zero_copy_only=False)
    for i in range(batch.num_rows):
        own = slice(window_at[i], window_at[i + 1])
        hit[own] = np.isin(fps[own], values[ends[i] : ends[i + 1]])
    row = np.repeat(np.arange(batch.num_rows), np.diff(window_at))
    return data, at, row[hit], start[hit], place[hit], fps[hit]


def _segments(held: DataFrame, window: int) -> DataFrame:
    """anchor, place, segment, tids and starts (packed numbers) of the occurrences: equal segments of a part are one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 1, PART):
                data, at, row, start, place, fps = _windows(batch, window)
                if not len(start):
                    continue
                head = np.flatnonzero((np.diff(place, prepend=-1) != 0) | (np.diff(start, prepend=-2) != 1))
                last = np.append(head[1:], len(start)) - 1
                first, end = start[head], start[last] + window
                kind = range_hash(prefix_hash(data), first, end) + (place[head] - first).astype(np.uint64)
                _, one, which = np.unique(kind, return_index=True, return_inverse=True)
                order = np.argsort(which, kind="stable")
                group_at = np.concatenate(([0], np.cumsum(np.bincount(which))))
                tids = batch.column(0).to_numpy()[row[head]][order]
                local = (first - at[row[head]])[order].astype(np.int64)
                texts = [data[a:b].tobytes() for a, b in zip(first[one].tolist(), end[one].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(fps[head[one]]), pa.array((place[head] - first)[one].astype(np.int32)), pa.array(texts, pa.binary()), strings(tids.view(np.uint8), group_at * 8), strings(local.view(np.uint8), group_at * 8)],
                    ["anchor", "place", "segment", "tids", "starts"],
                )

    return arrow_map(held, run, "anchor long, place int, segment binary, tids binary, starts binary")


def _found(segments: DataFrame, window: int, chunk: int) -> DataFrame:
    """tid, low, high: bytes to remove, from segments that lie together and sorted by anchor."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        distinct: dict[tuple, list] = {}
        for a, p, s, tids, starts in rows:
            distinct.setdefault((a, p, s), []).append((np.frombuffer(tids, np.int64), np.frombuffer(starts, np.int64)))
        names = {a: i for i, a in enumerate(dict.fromkeys(k[0] for k in distinct))}
        anchor = np.array([names[k[0]] for k in distinct])
        place = np.array([k[1] for k in distinct])
        owners = [(np.concatenate([x[0] for x in v]), np.concatenate([x[1] for x in v])) for v in distinct.values()]
        times = np.array([len(o[0]) for o in owners])
        masks = repeated_windows([k[2] for k in distinct], anchor, place, times, window)
        tid, low, high = [], [], []
        for mask, (t, s) in zip(masks, owners, strict=True):
            a, b = runs(mask)
            tid.append(np.repeat(t, len(a)))
            low.append((s[:, None] + a).reshape(-1))
            high.append((s[:, None] + b - 1 + window).reshape(-1))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (tid, low, high)], ["tid", "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held > chunk and row[0] != rows[-1][0]:
                    yield solve(rows)
                    rows, held = [], 0
                rows.append(row)
                held += len(row[2])
        if rows:
            yield solve(rows)

    return arrow_map(segments, run, "tid long, low long, high long")


def _hot_found(held: DataFrame, window: int, scratch: Scratch) -> DataFrame:
    """tid, low, high for windows of hot anchors, by counting their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 1, PART):
                data, at, row, start, _, _ = _windows(batch, window)
                hashes = range_hash(prefix_hash(data), start, start + window).view(np.int64)
                ids, local = batch.column(0).to_numpy()[row], start - at[row]
                for k in range(0, len(start), 1 << 17):
                    part = slice(k, k + (1 << 17))
                    yield pa.RecordBatch.from_arrays([pa.array(hashes[part]), pa.array(ids[part]), pa.array(local[part])], ["h", "tid", "low"])

    windows = arrow_map(held, run, "h long, tid long, low long")
    # Written out, so that the join has a shuffle on either side and a window that very many texts share is split.
    again = scratch.stored(windows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h"), "suffix-windows")
    return windows.join(again, "h").select("tid", "low", (F.col("low") + window).alias("high"))


def _cut_texts(docs: DataFrame, key: str, text: str, texts: DataFrame, window: int, chunk: int, hot: int, broadcast_rows: int, scratch: Scratch) -> DataFrame:
    """sha, n_removed, n_spans, cut_sha of the texts that lose bytes."""
    entries = texts.select("tid", F.explode("fps").alias("fp"))
    shared = scratch.stored(entries.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "suffix-anchors")
    cold, warm = (F.collect_set(F.when(c, F.col("fp"))) for c in (F.col("n") <= hot, F.col("n") > hot))
    flagged = scratch.stored(entries.join(shared, "fp").groupBy("tid").agg(cold.alias("hit"), warm.alias("hot")), "suffix-flagged")
    wanted = scratch.stored(texts.select("tid", "sha", "first").join(flagged.select("tid"), "tid"), "suffix-wanted")
    held = scratch.stored(fetched(docs, key, text, wanted, broadcast_rows, "sha", text_digest).join(flagged, "tid"), "suffix-held")
    segments = _segments(held.filter("size(hit) > 0").select("tid", "text", "hit"), window)
    found = _found(segments.repartition("anchor").sortWithinPartitions("anchor"), window, chunk)
    found = found.union(_hot_found(held.filter("size(hot) > 0").select("tid", "text", "hot"), window, scratch))
    spans_ = found.groupBy("tid").agg(F.collect_list(F.struct("low", "high")).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 1, PART):
                data, at = buffers(batch.column(1))
                lists = batch.column(2)
                low, high = (lists.values.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                ends, out = lists.offsets.to_numpy(zero_copy_only=False), []
                for i in range(batch.num_rows):
                    own, n = slice(ends[i], ends[i + 1]), int(at[i + 1] - at[i])
                    gone = np.cumsum(np.bincount(low[own], minlength=n + 1) - np.bincount(high[own], minlength=n + 1))[:n] > 0
                    out.append((int(gone.sum()), len(runs(gone)[0]), hashlib.sha256(data[at[i] : at[i + 1]][~gone]).hexdigest()))
                removed, n_spans, shas = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(shas, pa.string())], ["sha", "n_removed", "n_spans", "cut_sha"])

    lost = held.select("tid", "sha", "text").join(spans_, "tid").select("sha", "text", "spans")
    return stored(arrow_map(lost, cut, "sha string, n_removed long, n_spans long, cut_sha string"), "suffix-cut")


def suffix_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, chunk: int = CHUNK, hot: int = 50_000, broadcast_rows: int = 200_000) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs.

    window: a multiple of 8 between GRAM and DEPTH.  hot: occurrences of an anchor beyond which its windows are counted
    by hash.  broadcast_rows: most ids of texts with repeats that are broadcast to fetch them.
    """
    base = stored(_base(docs, key, text, window), "suffix-base")
    texts = base.groupBy("sha").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"), F.any_value("fps").alias("fps"))
    texts = stored(numbered(texts), "suffix-texts")
    with Scratch(docs.sparkSession) as scratch:
        done = _cut_texts(docs, key, text, texts, window, chunk, hot, broadcast_rows, scratch)
    out = base.join(texts.select("sha", "copies"), "sha").join(done, "sha", "left")
    copy = (F.col("copies") > 1) & (F.col("n_bytes") >= window)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select(
        "doc_id", "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(zero("n_removed")).alias("n_removed"), F.when(copy, F.lit(1)).otherwise(zero("n_spans")).cast("long").alias("n_spans"),
        F.when(copy, F.lit(NOTHING)).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
    )


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Substring deduplication on words with a log-structured fingerprint index.

A word goes if a window of `window` words that covers it also starts in a document of an earlier batch, or in one with
a smaller doc_id of the same batch.  In batches by ascending doc_id, as substring_dedup cuts them, that is: in a
document with a smaller doc_id.

The index takes documents in batches and decides about each batch as it comes.  Of each new text the anchors of its
windows (the smallest hash of GRAM words in each window) are its fingerprints.  A batch adds three sorted immutable
runs, Parquet tables in buckets by their key: fingerprints with the number of texts that hold them and the number of one
such text, window hashes, digests of texts.  A new run is merge-joined with the runs before it, bucket by bucket, without
a shuffle of history.  A fingerprint that is met again is a hit, and what it represents is verified: the windows at it
in the batch's texts, each by two independent 64-bit hashes of its whole word sequence, meet the window hashes of
history.  These hold all windows of hits so far; a fingerprint that is hit for the first time is in one older text only,
whose windows are added now.  With more than MAX_RUNS runs of a kind they are compacted into one.

An index in a folder given by the caller stays there: it can be opened again, in another session too, and take further
batches without the earlier documents.  A batch counts once its manifest is in place, by one rename; what a batch that died
has written is not read.  One writer at a time.  A text's number is that of its
row with the smallest doc_id; rows are numbered below 2^63, 2^33 for each task of a batch.

Equal texts, known by their whole SHA-256, are indexed once: a later copy of a text goes as a whole if it has a window's length.

Defined results: words are `[^\\x20\\x09-\\x0D]+`; null text has none; texts shorter than the window stay; a null doc_id
counts as smaller than any; rows that repeat a doc_id do not remove each other's words; empty table, empty result.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, arrow_map, buffers, delete, mixed, pieces, powers, prefix_hash, range_hash, word_bounds, work_dir
from .winnow import LEAST, anchors, text_digest

WINDOW, GRAM = 50, 10
MAX_RUNS = 2
PART = 2 << 20
#: Odd base of the hashes of word sequences, and its inverse modulo 2^64.
STEP = 0xC2B2AE3D27D4EB4F
STEP_INV = pow(STEP, -1, 1 << 64)
#: Another such base and its inverse, for the second hash of a window.
CHECK = 0x9FB21C651E98DF25
CHECK_INV = pow(CHECK, -1, 1 << 64)
#: The kinds of runs, and what each is bucketed and sorted by.
KINDS = {"grams": ("fp",), "windows": ("h", "check"), "texts": ("digest",)}
NOTHING = hashlib.sha256(b"").hexdigest()


class Words:
    """Words of the texts of a string column: start and end bytes, offsets by text, and hashes of any sequence of them."""

    def __init__(self, column: pa.Array):
        self.data, at = buffers(column)
        self.start, self.end, self.at = word_bounds(self.data, at)
        words = range_hash(prefix_hash(self.data), self.start, self.end) if len(self.start) else np.zeros(0, np.uint64)
        self.words = words
        self.sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * powers(STEP, len(words)), out=self.sums[1:])

    def hashes(self, start: np.ndarray, count: int) -> np.ndarray:
        """Hash of the `count` words from each start on (starts too near the end of all words give anything)."""
        end = np.minimum(start + count, len(self.sums) - 1)
        return mixed((self.sums[end] - self.sums[start]) * powers(STEP_INV, len(self.sums))[start])

    def checks(self, start: np.ndarray, count: int) -> np.ndarray:
        """A second, independent hash of the `count` words from each start on."""
        sums = np.zeros(len(self.words) + 1, np.uint64)
        np.cumsum(mixed(self.words ^ np.uint64(CHECK)) * powers(CHECK, len(self.words)), out=sums[1:])
        return mixed((sums[start + count] - sums[start]) * powers(CHECK_INV, len(sums))[start])

    def joined(self, words: np.ndarray) -> bytes:
        """These words with one space between them."""
        return b" ".join([self.data[a:b].tobytes() for a, b in zip(self.start[words].tolist(), self.end[words].tolist(), strict=True)])


def _base(docs: DataFrame, key: str, text: str, window: int, beyond: int) -> DataFrame:
    """doc_id, digest (of the text), text, row (a number from `beyond` on, to be written out at once), n_words, sha (of the words joined by spaces), fps (anchors, each once)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 2, PART):
                words = Words(batch.column(2))
                grams = words.hashes(np.arange(len(words.start)), GRAM)
                _, place, at = anchors(grams, words.at, GRAM, window)
                raw = words.data.tobytes()
                text_at = buffers(batch.column(2))[1].tolist()
                shas, fps, fp_at = [], [], [0]
                for i in range(batch.num_rows):
                    shas.append(hashlib.sha256(b" ".join(raw[text_at[i] : text_at[i + 1]].split())).hexdigest())
                    own = place[at[i] : at[i + 1]]
                    fps.append(np.unique(grams[own[np.diff(own, prepend=-1) != 0]]).view(np.int64) if len(own) else np.zeros(0, np.int64))
                    fp_at.append(fp_at[-1] + len(fps[-1]))
                lists = pa.ListArray.from_arrays(pa.array(fp_at, pa.int32()), pa.array(np.concatenate(fps)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.diff(words.at)), pa.array(shas, pa.string()), lists], ["doc_id", "digest", "text", "row", "n_words", "sha", "fps"])

    columns = docs.select(F.col(key).cast("long").alias("doc_id"), text_digest(F.col(text)).alias("digest"), F.col(text).alias("text"), (F.monotonically_increasing_id() + F.lit(beyond)).alias("row"))
    return arrow_map(columns, run, "doc_id long, digest string, text string, row long, n_words long, sha string, fps array<long>")


def _windows(held: DataFrame, window: int) -> DataFrame:
    """h, check, tid, first, place of the windows at the anchors `hit` of the texts held (tid, first, text, hit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 2, PART // 4):
                words = Words(batch.column(2))
                grams = words.hashes(np.arange(len(words.start)), GRAM)
                start, place, at = anchors(grams, words.at, GRAM, window)
                hit = np.zeros(len(start), bool)
                fps = grams[place].view(np.int64)
                lists = batch.column(3)
                values, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy(zero_copy_only=False)
                for i in range(batch.num_rows):
                    hit[at[i] : at[i + 1]] = np.isin(fps[at[i] : at[i + 1]], values[ends[i] : ends[i + 1]])
                row = np.repeat(np.arange(batch.num_rows), np.diff(at))[hit]
                start = start[hit]
                hashes, checks = words.hashes(start, window).view(np.int64), words.checks(start, window).view(np.int64)
                ids, firsts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                for k in range(0, len(start), 1 << 17):
                    at_ = slice(k, k + (1 << 17))
                    yield pa.RecordBatch.from_arrays([pa.array(hashes[at_]), pa.array(checks[at_]), pa.array(ids[row[at_]]), pa.array(firsts[row[at_]]), pa.array((start[at_] - words.at[row[at_]]).astype(np.int32))], ["h", "check", "tid", "first", "place"])

    return arrow_map(held.select("tid", "first", "text", "hit"), run, "h long, check long, tid long, first long, place int")


def _cut(lost: DataFrame, window: int) -> DataFrame:
    """digest, n_removed, cut_sha (of what is left) of texts without the windows that start at `places` (digest, text, places)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 1, PART):
                words, lists = Words(batch.column(1)), batch.column(2)
                values, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy(zero_copy_only=False)
                gone, shas = [], []
                for i in range(batch.num_rows):
                    n = words.at[i + 1] - words.at[i]
                    step = np.bincount(values[ends[i] : ends[i + 1]], minlength=n + 1)
                    covered = np.cumsum(step) - np.concatenate((np.zeros(window, np.int64), np.cumsum(step)))[: n + 1] > 0
                    left = np.flatnonzero(~covered[:n])
                    gone.append(n - len(left))
                    shas.append(hashlib.sha256(words.joined(words.at[i] + left)).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(gone, pa.int64()), pa.array(shas, pa.string())], ["digest", "n_removed", "cut_sha"])

    return arrow_map(lost.select("digest", "text", "places"), run, "digest string, n_removed long, cut_sha string")


class FingerprintIndex:
    """Runs, texts and decisions below one shared folder: `home`, or a new one."""

    def __init__(self, spark: SparkSession, window: int = WINDOW, max_runs: int = MAX_RUNS, home: str | None = None):
        self.spark, self.max_runs = spark, max_runs
        self.home = (home or work_dir(spark, "fingerprints")).rstrip("/")
        self.state = self._manifest() or {"window": window, "buckets": max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "numbers": 0, "batches": [], **{k: [] for k in KINDS}}
        if self.state["window"] != window:
            raise ValueError(f"the index in {self.home} is over windows of {self.state['window']} words")
        for kind in KINDS:
            for name in self.state[kind]:
                self._register(kind, name)

    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.home}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _manifest(self) -> dict | None:
        """The state after the last whole batch, None for a new index."""
        path, fs = self._path("manifests")
        if not fs.exists(path):
            return None
        names = sorted(f.getPath().getName() for f in fs.listStatus(path) if f.getPath().getName().startswith("m-"))
        return json.loads("".join(r.value for r in self.spark.read.text(f"{self.home}/manifests/{names[-1]}").collect())) if names else None

    def _commit(self, state: dict) -> None:
        """Makes this state the index's: written beside, then renamed to the next number."""
        new, fs = self._path(f"manifests/new-{uuid.uuid4().hex}")
        stream = fs.create(new, True)
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        to, _ = self._path(f"manifests/m-{len(state['batches']):09d}")
        if fs.exists(to) or not fs.rename(new, to):
            raise RuntimeError(f"another writer has added a batch to {self.home}")
        self.state = state

    def _register(self, kind: str, name: str) -> None:
        """Tells this session's catalog of a run that another session has written."""
        if not self.spark.catalog.tableExists(name):
            columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in self.spark.read.parquet(f"{self.home}/{name}").schema.fields)
            by = ", ".join(KINDS[kind])
            self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {self.state['buckets']} BUCKETS LOCATION '{self.home}/{name}'")

    def _run(self, kind: str, rows: DataFrame) -> str:
        """Writes a run: rows with one row for each key of this kind."""
        name = f"{kind}_{uuid.uuid4().hex}"
        rows.write.option("path", f"{self.home}/{name}").bucketBy(self.state["buckets"], *KINDS[kind]).sortBy(*KINDS[kind]).saveAsTable(name)
        return name

    def _runs(self, kind: str) -> list[DataFrame]:
        return [self.spark.table(name) for name in self.state[kind]]

    def _text_of(self, wanted: DataFrame, batches: list[str], broadcast_rows: int) -> DataFrame:
        """wanted (tid, first, hit) with the text; up to broadcast_rows rows of it are broadcast, and then no text is shuffled."""
        ids = F.broadcast(wanted) if wanted.count() <= broadcast_rows else wanted
        texts = self.spark.read.schema("row long, text string").parquet(*[f"{self.home}/base-{b}" for b in batches])
        return texts.withColumnRenamed("row", "tid").withColumn("text", F.coalesce("text", F.lit(""))).join(ids, "tid")

    def add(self, docs: DataFrame, key: str, text: str, broadcast_rows: int = 50_000) -> DataFrame:
        """Indexes a batch; returns doc_id, n_words, n_removed, kept_sha256 for each of its rows, stored below the index."""
        batch, window, state = uuid.uuid4().hex[:16], self.state["window"], self.state
        with Scratch(self.spark) as scratch:
            _base(docs, key, text, window, state["numbers"]).write.parquet(f"{self.home}/base-{batch}")
            base = self.spark.read.parquet(f"{self.home}/base-{batch}")
            least = F.min(F.struct(F.coalesce("doc_id", F.lit(LEAST)).alias("first"), F.col("row").alias("tid"))).alias("least")
            texts = base.groupBy("digest").agg(least, F.any_value("fps").alias("fps")).select("digest", "least.*", "fps")
            for old in self._runs("texts"):
                texts = texts.join(old.select("digest").hint("merge"), "digest", "left_anti")
            texts = scratch.stored(texts, "fingerprint-texts")
            last = base.agg(F.max("row")).first()[0]
            known = self._run("texts", texts.select("digest").repartition(state["buckets"], "digest"))
            held_by = texts.select("tid", F.explode("fps").alias("fp"))
            grams = self._run("grams", held_by.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("tid").alias("tid")))

            new = self.spark.table(grams)
            met = [new.select("fp").join(old.hint("merge"), "fp") for old in self._runs("grams")]
            earlier = scratch.stored(_union(met).groupBy("fp").agg(F.sum("n").alias("n"), F.min("tid").alias("tid")), "fingerprint-met") if met else None
            hits = new.filter("n > 1").select("fp")
            hits = scratch.stored((hits.union(earlier.select("fp")) if met else hits).distinct(), "fingerprint-hits")
            flagged = held_by.join(hits, "fp").groupBy("tid").agg(F.collect_set("fp").alias("hit"))
            wanted = scratch.stored(texts.select("tid", "first").join(flagged, "tid"), "fingerprint-wanted")
            held = scratch.stored(self._text_of(wanted, [batch], broadcast_rows), "fingerprint-held")
            found = _windows(held, window)
            every = found.select("h", "check", "first", F.lit(False).alias("old"))
            if met:  # one older text holds a fingerprint that was not a hit before
                once = earlier.filter("n = 1").groupBy("tid").agg(F.lit(0).cast("long").alias("first"), F.collect_set("fp").alias("hit"))
                once = scratch.stored(once, "fingerprint-once")
                older = _windows(self._text_of(once, state["batches"], broadcast_rows), window)
                every = every.union(older.select("h", "check", F.lit(None).cast("long").alias("first"), F.lit(True).alias("old")))
            windows = self._run("windows", every.groupBy("h", "check").agg(F.min("first").alias("least"), F.max("first").alias("most"), F.max("old").alias("old")))

            judged = self.spark.table(windows)
            for i, old in enumerate(self._runs("windows")):
                mark = old.select("h", "check", F.lit(True).alias(f"in_{i}")).hint("merge")
                judged = judged.join(mark, ["h", "check"], "left").withColumn("old", F.col("old") | F.coalesce(f"in_{i}", F.lit(False))).drop(f"in_{i}")
            # Written out, so that the join has a shuffle on either side and a passage that very many texts share is split.
            judged = scratch.stored(judged.filter("old or least < most").select("h", "check", "least", "old"), "fingerprint-windows")
            gone = found.join(judged, ["h", "check"]).filter("old or least < first").groupBy("tid").agg(F.collect_list("place").alias("places"))
            lost = held.select("tid", "text").join(gone, "tid").join(texts.select("tid", "digest"), "tid")
            cut = scratch.stored(_cut(lost, window), "fingerprint-cut")

            rows = base.join(texts.select("digest", "first"), "digest", "left").join(cut, "digest", "left")
            copy = (F.col("first").isNull() | (F.coalesce("doc_id", F.lit(LEAST)) > F.col("first"))) & (F.col("n_words") >= window)
            rows.select(
                "doc_id", "n_words", F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
                F.when(copy, F.lit(NOTHING)).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
            ).write.parquet(f"{self.home}/decided-{batch}")
        added = {kind: [*state[kind], name] for kind, name in (("grams", grams), ("windows", windows), ("texts", known))}
        spent = []
        for kind in KINDS:
            if len(added[kind]) > self.max_runs:
                spent += added[kind]
                added[kind] = [self._run(kind, _compacted(kind, [self.spark.table(n) for n in added[kind]]))]
        self._commit({**state, **added, "numbers": state["numbers"] if last is None else last + 1, "batches": [*state["batches"], batch]})
        self._drop(spent)
        return self.spark.read.schema("doc_id long, n_words long, n_removed long, kept_sha256 string").parquet(f"{self.home}/decided-{batch}")

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            delete(self.spark, f"{self.home}/{name}")

    def close(self) -> None:
        """Takes the runs from this session's catalog; the index stays in its folder."""
        for kind in KINDS:
            for name in self.state[kind]:
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def remove(self) -> None:
        """Deletes the index; decisions that add() has returned stay."""
        self._drop([name for kind in KINDS for name in self.state[kind]])
        for name in ("manifests", *(f"base-{b}" for b in self.state["batches"])):
            delete(self.spark, f"{self.home}/{name}")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _compacted(kind: str, runs: list[DataFrame]) -> DataFrame:
    """One run of several: fingerprints add up, a window counts once, texts are in one run only."""
    keys = KINDS[kind]
    if kind == "grams":
        return _union(runs).groupBy(*keys).agg(F.sum("n").alias("n"), F.min("tid").alias("tid"))
    if kind == "windows":
        return _union([r.select(*keys) for r in runs]).distinct()
    return _union(runs).distinct()


def substring_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, batches: int = 4, max_runs: int = MAX_RUNS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row of docs, which enters the index in batches by doc_id."""
    index = FingerprintIndex(docs.sparkSession, window, max_runs)
    ident = F.coalesce(F.col(key).cast("long"), F.lit(LEAST))
    cuts = docs.agg(F.percentile_approx(ident, [k / batches for k in range(1, batches)] or [1.0])).first()[0] or []
    cuts = sorted(set(cuts)) if batches > 1 else []
    rows = []
    try:
        for low, high in zip([None, *cuts], [*cuts, None], strict=True):
            batch = docs if low is None else docs.filter(ident > low)
            rows.append(index.add(batch if high is None else batch.filter(ident <= high), key, text))
    finally:
        index.remove()
    return _union(rows)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Exact deduplication as a stateful stream.

Every text leaves one line in a log: digest, doc_id and content locator (file and row).  A Structured Streaming
aggregation without watermark reads the log into RocksDB state keyed by digest; the state never expires and keeps the
largest doc_id with its locator and the number of rows.  A digest with more than one row is a hit: the texts of hits,
and of these alone, are fetched by locator and grouped by their full bytes, so that a clash of digests parts again.

Only DataFrame operations run, no Python on the executors.  Partial aggregation turns a hot text into one row a task;
the joins by digest are sort-merge joins whose hot keys AQE splits.

Defined results: null text counts as empty; an empty table gives an empty result; of rows that repeat a doc_id with
the same text one stays (the last by locator); a null doc_id ranks below all others.  Columns besides the two named
are never read, and internal names are chosen apart from theirs.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import all_columns, own_names, stored, work_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STORE = "spark.sql.streaming.stateStore"
#: Session settings while the stream runs.  All stores of an executor share one bounded native memory.  A commit writes
#: one changelog file for each partition, not a snapshot of several files; snapshots are left to the maintenance thread,
#: which comes often, so that the stores of ended streams are unloaded.  Files are not preallocated (4 MB a partition).
SETTINGS = {
    f"{STORE}.providerClass": ROCKSDB, f"{STORE}.maintenanceInterval": "15s", f"{STORE}.rocksdb.boundedMemoryUsage": "true", f"{STORE}.rocksdb.maxMemoryUsageMB": "64",
    f"{STORE}.rocksdb.writeBufferSizeMB": "4", f"{STORE}.rocksdb.changelogCheckpointing.enabled": "true", f"{STORE}.rocksdb.allowFAllocate": "false",
}


def place(docs: DataFrame, file_at: str, row_at: str) -> list[Column]:
    """Where a row's content lies, under these names; an AnalysisException if docs are not read from files."""
    at = docs.metadataColumn("_metadata")  # Spark's own, also where docs have a column of that name
    columns = [F.xxhash64(at["file_path"]).alias(file_at), at["row_index"].alias(row_at)]
    docs.select(*columns)
    return columns


def located(docs: DataFrame, columns: list[str]) -> DataFrame:
    """These columns of docs with file_at and row_at, which tell where a row's content lies."""
    try:
        return docs.select(*columns, *place(docs, "file_at", "row_at"))
    except AnalysisException:  # not read from files: put it into some
        docs = stored(docs.select(*columns), "dedup-content")
        return docs.select(*columns, *place(docs, "file_at", "row_at"))


class DedupState:
    """Digest state below one folder.  add() may be called again and again: later rows meet the state of earlier ones."""

    def __init__(self, spark: SparkSession, home: str | None = None, digest_bytes: int = 32, partition_rows: int = 100_000):
        """digest_bytes: of SHA-256 that make the state's key; a small number makes clashes, for tests.

        partition_rows: rows of the first add() for each partition of the state (some 10 MB), whose number then stays:
        at least the default parallelism and at most spark.sql.shuffle.partitions.  Every partition costs a database
        and several files, so there are no more than the rows need.
        """
        self.spark, self.home, self.digest_bytes, self.partition_rows = spark, home or work_dir(spark, "dedup-state"), digest_bytes, partition_rows

    def add(self, content: DataFrame, key: str, text: str) -> None:
        """Logs the rows of located() content and runs the stream over what is new in the log."""
        sha = F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))
        content.select(F.col(key).cast("long").alias("doc_id"), "file_at", "row_at", sha.alias("sha")).write.mode("append").parquet(f"{self.home}/log")
        log = self.spark.readStream.schema(self.log().schema).parquet(f"{self.home}/log")
        state = log.groupBy(self._digest().alias("digest")).agg(F.max(F.struct("doc_id", "file_at", "row_at")).alias("keeper"), F.count(F.lit(1)).alias("group_size"))
        most, cores = int(self.spark.conf.get("spark.sql.shuffle.partitions")), self.spark.sparkContext.defaultParallelism
        settings = SETTINGS | {"spark.sql.shuffle.partitions": str(min(most, max(cores, -(-self.log().count() // self.partition_rows))))}
        before = {k: self.spark.conf.get(k, None) for k in settings}
        for k, v in settings.items():
            self.spark.conf.set(k, v)
        try:
            state.writeStream.format("noop").outputMode("update").option("checkpointLocation", f"{self.home}/state").trigger(availableNow=True).start().awaitTermination()
        finally:
            for k, v in before.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)

    def _digest(self):
        return F.substring("sha", 1, self.digest_bytes)

    def log(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.home}/log")

    def state(self) -> DataFrame:
        """digest, keep (doc_id and locator), group_size as the state store has them."""
        return self.spark.read.format("statestore").load(f"{self.home}/state").select("key.*", "value.*").toDF("digest", "keep", "group_size")


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", digest_bytes: int = 32, broadcast_rows: int = 100_000) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, file_at, row_at.

    Of equal texts the row with the largest doc_id stays.  broadcast_rows: most locators of hits that are broadcast to
    fetch their texts (about 100 bytes each, two digests among them); more of them go through a shuffled join.
    """
    spark = docs.sparkSession
    content = located(docs, [key, text])
    index = DedupState(spark, digest_bytes=digest_bytes)
    index.add(content, key, text)
    log = index.log().withColumn("digest", index._digest())
    state = stored(index.state(), "dedup-groups")
    columns = ["doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"), "file_at", "row_at"]

    every = log.join(state, "digest")
    single = every.filter("group_size = 1").withColumns({"keep_id": F.col("doc_id"), "kept": F.lit(True)})

    hits = every.filter("group_size > 1").select("doc_id", "file_at", "row_at", "sha", "digest")
    n_hits = state.filter("group_size > 1").agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    by_place = F.broadcast(hits) if n_hits <= broadcast_rows else hits
    full = content.select("file_at", "row_at", F.coalesce(F.col(text), F.lit("")).alias("full_text")).join(by_place, ["file_at", "row_at"])
    # Written out, so that the join has a shuffle on either side and a text that very many rows share is split.
    groups = stored(full.groupBy("digest", "full_text").agg(F.max(F.struct("doc_id", "file_at", "row_at")).alias("keep"), F.count(F.lit(1)).alias("group_size")), "dedup-groups")
    checked = full.join(groups, ["digest", "full_text"]).withColumns({
        "keep_id": F.col("keep.doc_id"),
        "kept": (F.col("file_at") == F.col("keep.file_at")) & (F.col("row_at") == F.col("keep.row_at")),
    })
    return single.select(*columns).unionByName(checked.select(*columns))


def keep_unique(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the copies, all its columns kept; the locator picks the rows, so repeated doc_ids do no harm."""
    at, row, file, index = own_names(docs, "__at", "__row", "__file", "__index")
    try:
        where = place(docs, at, row)
    except AnalysisException:
        docs = stored(docs, "dedup-content")
        where = place(docs, at, row)
    kept = exact_dedup(docs, key, text).filter("kept").select(F.col("file_at").alias(file), F.col("row_at").alias(index))
    rows = docs.select(*all_columns(docs), *where)
    return rows.join(kept, (F.col(at) == F.col(file)) & (F.col(row) == F.col(index)), "left_semi").select(*all_columns(docs))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP4_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

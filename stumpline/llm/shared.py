"""Helpers that several operators of this subpackage use: shared folders, Arrow buffers, hashing, words."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes 0x09-0x0D and 0x20 separate words.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir.

    Where that is unset, a temporary folder serves a session of one process; on a cluster it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset: it must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="stumpline-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into a shared folder and reads it again: cuts lineage and survives lost executors."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of intermediate results in whatever store it lies."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Folders of intermediate results that are deleted together once what was made of them is stored elsewhere."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def folder(self, name: str) -> str:
        self.paths.append(work_dir(self.spark, name))
        return self.paths[-1]

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        """stored(), in a folder of this scratch."""
        path = self.folder(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        for p in self.paths:
            delete(self.spark, p)
        self.paths = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.clear()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application, so that their Python workers can import it."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        top = Path(__file__).resolve().parents[1]
        with zipfile.ZipFile(to := f"{tempfile.mkdtemp(prefix='stumpline-')}/{top.name}.zip", "w") as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, p.relative_to(top.parent))
        spark.sparkContext.addPyFile(to)
        _shipped.add(app)


BATCH_ROWS, ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def arrow_map(df: DataFrame, run, schema: str) -> DataFrame:
    """df.mapInArrow, with the package shipped.  A worker, which other tasks use again, gives back what a task has freed.

    Where the session has Spark's default of 10000 rows for an Arrow batch, it gets ROWS: whole texts make large rows,
    and executor and worker each hold a batch.
    """
    ship(df.sparkSession)
    if df.sparkSession.conf.get(BATCH_ROWS) == "10000":
        df.sparkSession.conf.set(BATCH_ROWS, ROWS)

    def run_and_release(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(run_and_release, schema)


def release() -> None:
    """Returns freed memory of this process to the system, where its allocators can do so."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def own_names(df: DataFrame, *names: str) -> list[str]:
    """These names, with as many underscores behind them as it takes to be none of df's columns (upper and lower case alike)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
        taken.add(name.lower())
    return out


def all_columns(df: DataFrame) -> list:
    """df's columns by name, whatever characters the names have."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def crc_mod(column: str, n: int):
    """crc32 of a number as text, modulo n; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column end to end, and the n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(at), np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def strings(data: np.ndarray, at: np.ndarray, kind=None) -> pa.Array:
    """The inverse of buffers()."""
    out = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(np.ascontiguousarray(at, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    return out.cast(kind or pa.binary())


def pieces(batch: pa.RecordBatch, column: int, most: int):
    """Parts of a record batch, each of about `most` bytes of that column (a longer text is a part of its own)."""
    _, at = buffers(batch.column(column))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        yield batch.slice(first, last - first)
        first = last


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: A random 64-bit number for each byte, and an odd base with its inverse modulo 2^64.
BYTE_CODE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2^64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 1 << 23:
            _powers[base] = have
    return have[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """n + 1 sums of code(byte i) * BASE^i: any range's polynomial hash is a difference of two of them."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODE[data] * powers(BASE, len(data)), out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges; equal bytes have equal hashes wherever they are."""
    return mixed((prefix[end] - prefix[start]) * powers(BASE_INV, len(prefix))[start] + (end - start).astype(np.uint64))


def word_bounds(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words `[^\\x20\\x09-\\x0D]+`, and the n + 1 offsets of each text's words."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    word = (data != np.uint8(32)) & (data - np.uint8(9) > np.uint8(4))
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    inner = at[(at > 0) & (at < len(data))]
    begins[inner] = word[inner]
    ends = word.copy()
    ends[:-1] &= ~word[1:]
    ends[inner - 1] = word[inner - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, at)


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; other bytes as they are."""
    return data + ((data - np.uint8(65) < np.uint8(26)).view(np.uint8) << np.uint8(5))


def spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, count of them, end to end."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    some = counts > 0
    starts, counts = starts[some], counts[some]
    out[0] = starts[0]
    out[np.cumsum(counts)[:-1]] = starts[1:] - starts[:-1] - counts[:-1] + 1
    return np.cumsum(out)

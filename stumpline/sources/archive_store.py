"""An archive on disk: tables in buckets by match, sorted, and one pointer that switches all of them together.

A rebuild writes every table into a folder of its own version, then moves the pointer there in one rename.  A reader
takes the pointer's version when it opens the archive and keeps it, so it sees all tables of one rebuild, old or new,
and a rebuild that dies leaves nothing that a reader finds.  Tables of one number of buckets meet by match without a
shuffle, and windows by match, or by match and more, need none either.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Layout:
    """How a table lies: bucketed by the first columns, sorted within buckets by the second (nothing: as it comes)."""

    by: tuple[str, ...] = ()
    order: tuple[str, ...] = ()


#: Layouts of the archive's tables.
LAYOUTS = {
    "deliveries": Layout(("match_id",), ("match_id", "inning", "sequence")), "matches": Layout(("match_id",), ("match_id",)), "match_info": Layout(("match_id",), ("match_id",)),
    "awards": Layout(("match_id",), ("match_id",)), "substitutions": Layout(("match_id",), ("match_id", "inning", "sequence")), "player_styles": Layout(),
}


class ArchiveStore:
    """Versions of an archive's tables below one folder that driver and executors share."""

    def __init__(self, spark: SparkSession, home: str, buckets: int = 64, layouts: dict[str, Layout] = LAYOUTS):
        self.spark, self.home, self.buckets, self.layouts = spark, home.rstrip("/"), buckets, layouts

    def _path(self, *parts: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join((self.home, *parts)))
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> str | None:
        """The version that the pointer names, None before the first rebuild."""
        p, fs = self._path("CURRENT")
        if not fs.exists(p):
            return None
        name, schema = self.spark.read.text(p.toString()).first()[0].split("\t")
        return f"{name}\t{schema}"

    def rebuild(self, tables: dict[str, DataFrame]) -> str:
        """Writes all tables as a new version and points to it; returns its name.

        A bucket is one file, sorted: rows are dealt out by the very hash that buckets them.
        """
        name = f"v{uuid.uuid4().hex[:16]}"
        for table, df in tables.items():
            layout, out = self.layouts.get(table, Layout()), df
            writer = out.write
            if layout.by:
                writer = df.repartition(self.buckets, *layout.by).write.bucketBy(self.buckets, *layout.by).sortBy(*layout.order)
            writer.option("path", f"{self.home}/{name}/{table}").format("parquet").saveAsTable(f"{name}_{table}")
        self._point(name, sorted(tables))
        return name

    def _point(self, name: str, tables: list[str]) -> None:
        """One rename over the pointer, which the file system does at once or not at all."""
        new, fs = self._path(f"CURRENT-{name}")
        stream = fs.create(new, True)
        stream.write(bytearray(f"{name}\t{','.join(tables)}\n".encode()))
        stream.close()
        jvm = self.spark.sparkContext._jvm
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(new, self._path("CURRENT")[0], options)

    def tables(self) -> dict[str, DataFrame]:
        """All tables of the version that the pointer names now; later rebuilds do not change them."""
        now = self.version()
        if now is None:
            raise ValueError(f"no archive at {self.home}")
        name, tables = now.split("\t")
        return {t: self._table(name, t) for t in tables.split(",")}

    def _table(self, name: str, table: str) -> DataFrame:
        """A version's table with its buckets told to this session's catalog, where it may have been written by another."""
        if not self.spark.catalog.tableExists(f"{name}_{table}"):
            path, layout = f"{self.home}/{name}/{table}", self.layouts.get(table, Layout())
            columns = self.spark.read.parquet(path).schema
            kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns)
            buckets = f" CLUSTERED BY ({', '.join(layout.by)}) SORTED BY ({', '.join(layout.order)}) INTO {self.buckets} BUCKETS" if layout.by else ""
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name}_{table} ({kept}) USING parquet{buckets} LOCATION '{path}'")
        return self.spark.table(f"{name}_{table}")

    def versions(self) -> list[str]:
        """Versions on disk, whole or not, the oldest first."""
        p, fs = self._path()
        found = [s for s in fs.listStatus(p) if s.isDirectory() and re.fullmatch("v[0-9a-f]{16}", s.getPath().getName())] if fs.exists(p) else []
        return [s.getPath().getName() for s in sorted(found, key=lambda s: s.getModificationTime())]

    def forget(self, keep: int = 1) -> list[str]:
        """Deletes all versions but the pointer's and the `keep` newest others, which readers may still use."""
        now = (self.version() or "").split("\t")[0]
        others = [v for v in self.versions() if v != now]
        gone = others[: max(0, len(others) - keep)]
        for name in gone:
            for t in self.spark.catalog.listTables():
                if t.name.startswith(f"{name}_"):
                    self.spark.sql(f"DROP TABLE IF EXISTS {t.name}")
            p, fs = self._path(name)
            fs.delete(p, True)
        return gone


def replaced(old: dict[str, DataFrame], new: dict[str, DataFrame], key: str = "match_id") -> dict[str, DataFrame]:
    """Tables for a rebuild: those of `new` replace rows of their matches, the rest of `old` stays."""
    out = dict(old)
    for name, df in new.items():
        if name in old and key in old[name].columns:
            kept = old[name].join(df.select(F.col(key)).distinct(), key, "left_anti")
            out[name] = kept.unionByName(df, allowMissingColumns=True)
        else:
            out[name] = df
    return out

"""A ladder of any number of sources: how whole each is, one of them for each group, gaps filled from the others."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

c = F.col


def laddered(sources: dict[str, DataFrame], group: list[str], row: list[str], fields: list[str]) -> DataFrame:
    """Rows of all sources, the best first by name, with `source` and its rung (0 is the best).  What a source lacks is null."""
    columns = [*group, *row, *fields]
    have = lambda df: df.select(*(n for n in columns if n in df.columns))
    rungs = [have(df).withColumns({"source": F.lit(name), "rung": F.lit(i).cast("long")}) for i, (name, df) in enumerate(sources.items())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rungs)


def scores(rows: DataFrame, group: list[str], row: list[str], fields: list[str]) -> DataFrame:
    """group, source, rung, rows, filled, share: what each source has of a group.

    rows counts the rows it has (each key once), filled the fields among them that are not null, and share is rows by
    the most that any source has.
    """
    once = rows.groupBy(*group, "source", "rung", *row).agg(*(F.count(f).alias(f) for f in fields))
    filled = reduce(lambda a, b: a + b, (F.count_if(c(f) > 0) for f in fields))
    found = once.groupBy(*group, "source", "rung").agg(F.count(F.lit(1)).alias("rows"), filled.alias("filled"))
    most = F.max("rows").over(Window.partitionBy(*group))
    return found.withColumn("share", c("rows") / most)


def chosen(scored: DataFrame, group: list[str], least: float = 0.9) -> DataFrame:
    """group, source, rung: the best source that has a share of `least` or more of its group's rows (one of them always has)."""
    return scored.filter(c("share") >= least).groupBy(*group).agg(F.min(F.struct("rung", "source")).alias("best")).select(*group, "best.source", "best.rung")


def ladder(sources: dict[str, DataFrame], group: list[str], row: list[str], fields: list[str], least: float = 0.9) -> DataFrame:
    """Rows of each group's chosen source; a field that it lacks comes from the best source that has it in the same row.

    group, row, source (chosen), fields, and `borrowed`, the number of fields from elsewhere.  Of rows that a source
    repeats the largest value of each field counts.  One aggregation by row does the filling: no source is joined.
    """
    rows = laddered(sources, group, row, fields)
    best = chosen(scores(rows, group, row, fields), group, least)
    same = reduce(lambda a, b: a & b, (c(f"r.{g}").eqNullSafe(c(f"b.{g}")) for g in group))
    met = rows.alias("r").join(best.select(*group, c("source").alias("of"), c("rung").alias("own")).alias("b"), same).select("r.*", "of", "own")
    # The chosen source stands before all others.
    rank = F.when(c("rung") == c("own"), -1).otherwise(c("rung"))
    first = lambda f: F.min(F.when(c(f).isNotNull(), F.struct(rank.alias("rank"))))
    value = lambda f: F.max_by(f, F.when(c(f).isNotNull(), F.struct((-rank).alias("rank"), c(f).alias("value"))))
    out = met.groupBy(*group, *row, c("of").alias("source")).agg(F.bool_or(c("rung") == c("own")).alias("has"), *(value(f).alias(f) for f in fields), *(first(f).alias(f"__{f}") for f in fields))
    borrowed = reduce(lambda a, b: a + b, (F.coalesce((c(f"__{f}")["rank"] >= 0).cast("long"), F.lit(0)) for f in fields))
    return out.filter("has").select(*group, *row, "source", *fields, borrowed.cast("long").alias("borrowed"))

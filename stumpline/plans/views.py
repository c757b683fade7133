"""Ad-hoc SQL over an archive: its tables as temporary views, a list of them, and one statement at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.columns import FRANCHISES, GROUNDS
from .archive import Archive

VIEWS = {"deliveries": "d", "matches": "matches", "match_info": "info", "awards": "awards", "substitutions": "subs", "player_styles": "styles"}


def register(a: Archive) -> dict[str, DataFrame]:
    """Makes the archive's tables temporary views of the session; returns them by name."""
    tables = {name: getattr(a, field) for name, field in VIEWS.items() if getattr(a, field, None) is not None}
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return tables


def _renamer(names: dict[str, str], of: str) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return f"coalesce(map({', '.join(quoted(x) for item in names.items() for x in item)})[{of}], {of})"


#: SQL functions of ad-hoc statements: parameter and what it becomes.
FUNCTIONS = {"franchise": ("code", _renamer(FRANCHISES, "code")), "ground": ("venue", _renamer(GROUNDS, "split_part(venue, ',', 1)"))}


def register_functions(spark: SparkSession) -> None:
    """franchise(code) and ground(venue) as temporary SQL functions of the session, inlined by the optimiser."""
    for name, (parameter, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameter} STRING) RETURNS STRING RETURN {body}")


def columns(spark: SparkSession, a: Archive) -> DataFrame:
    """table, place, column, type of all views."""
    rows = [(name, i, f.name, f.dataType.simpleString()) for name, df in register(a).items() for i, f in enumerate(df.schema, 1)]
    return spark.createDataFrame(rows, "table string, place int, column string, type string")


def ask(spark: SparkSession, a: Archive, statement: str) -> DataFrame:
    """The result of one SELECT (or WITH) statement over the views; other statements are an error."""
    words = statement.split(None, 1)
    if not words or words[0].lower() not in ("select", "with") or ";" in statement.rstrip().rstrip(";"):
        raise ValueError("one SELECT statement is asked for")
    register(a)
    register_functions(spark)
    return spark.sql(statement.rstrip().rstrip(";"))

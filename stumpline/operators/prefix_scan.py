"""Ordered running state of groups of any length: prefix sums and last values in two passes over blocks.

A window over a group sorts the whole group in one task.  Here rows fall into blocks by their order column, which needs
no sort; one aggregation gives each block's sum, a scan over the few blocks of a group gives what came before each, and
this enters a window over the block alone as one row in front of it.  A task so holds one block, and the rows shuffle
once, by group and block.  Group columns may be null: nothing is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col
#: Values of the order column that fall into one block.
WIDTH = 1 << 16
#: Blocks that are scanned together.
FAN = 1 << 12
FIRST = "__first"


def _window(group: list[str], block: str, order: list[str]):
    return Window.partitionBy(*group, block).orderBy(FIRST, *order)


def _with_fronts(x: DataFrame, group: list[str], order: list[str], sums: list[str], lasts: list[str], width: int, levels: int) -> tuple[DataFrame, str]:
    """x with a block column (its name is returned) and FIRST = 1, and in front of each block a row with FIRST = 0.

    This row holds in `sums` and `lasts` what the group's earlier blocks add up to and end with (null for the first
    block); it is null elsewhere.
    """
    block = f"__block{levels}"
    at = c(order[0]).cast("long")
    x = x.withColumns({block: ((at - F.pmod(at, F.lit(width))) / width).cast("long") if levels else F.lit(0).cast("long"), FIRST: F.lit(1)})
    if not levels:
        return x, block
    known = lambda n: F.when(c(n).isNotNull(), F.struct(*order))
    totals = x.groupBy(*group, block).agg(*(F.sum(n).alias(n) for n in sums), *(F.max_by(n, known(n)).alias(n) for n in lasts))
    blocks, over = _with_fronts(totals, group, [block], sums, lasts, FAN, levels - 1)
    w = _window(group, over, [block]).rowsBetween(Window.unboundedPreceding, -1)
    ahead = blocks.select(*group, block, FIRST, *(F.sum(n).over(w).alias(n) for n in sums), *(F.last(n, True).over(w).alias(n) for n in lasts)).filter(c(FIRST) == 1)
    kinds = {f.name: f.dataType for f in totals.schema}
    x = x.withColumns({n: c(n).cast(kinds[n]) for n in sums})
    given = {*group, block, *sums, *lasts}
    front = ahead.select(*(c(f.name).cast(f.dataType) if f.name in given else F.lit(0).alias(FIRST) if f.name == FIRST else F.lit(None).cast(f.dataType).alias(f.name) for f in x.schema))
    return x.unionByName(front), block


def running(
    x: DataFrame, group: list[str], order: list[str], sums: dict[str, Column] | None = None, before: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, width: int = WIDTH, levels: int = 2
) -> DataFrame:
    """x with running columns within groups by order (nulls first).

    sums: up to and with each row.  before: of the rows before it (0 for the first).  lasts: the last value that is not
    null, up to and with each row.  The first column of order is a whole number; `width` of its values make a block.
    levels: how often there are blocks: FAN blocks make one of the next level, and a task sees a group's blocks of the
    last level together.  Rows of equal order follow each other as Spark happens to read them.
    """
    sums, before, lasts = sums or {}, before or {}, lasts or {}
    added = {f"__in_{n}": v for n, v in (sums | before | lasts).items()}
    columns = [n for n in x.columns if n not in (sums | before | lasts)]
    rows, block = _with_fronts(x.withColumns(added), group, order, [f"__in_{n}" for n in (*sums, *before)], [f"__in_{n}" for n in lasts], width, levels)
    w = _window(group, block, order)
    upto, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    out = [F.sum(f"__in_{n}").over(upto).alias(n) for n in sums] + [F.coalesce(F.sum(f"__in_{n}").over(ahead), F.lit(0)).alias(n) for n in before] + [F.last(f"__in_{n}", True).over(upto).alias(n) for n in lasts]
    return rows.select(FIRST, *columns, *out).filter(c(FIRST) == 1).drop(FIRST)

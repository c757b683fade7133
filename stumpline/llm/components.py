"""Connected components of links that lie in a DataFrame, by minima over neighbours and pointer jumping.

Defined results: repeated links count once, a link of an id with itself gives that id a component of its own, links with
a null end must not be there (the callers make none), no links give no rows.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch


def components(links: DataFrame, a: str = "a", b: str = "b", repeats: bool = True, passes: int | None = None) -> DataFrame:
    """id, comp (smallest id reachable) for every id that has a link.

    Each round every id takes the smallest label among its neighbours and itself, then the label of its label.  Partial
    minima combine before the shuffle, so an id with very many links costs a task one row.  Rounds end when no label
    changes; every round is written to the shared folder, which cuts its lineage, and the one before it is deleted.

    repeats: links recur so often that telling them apart first is worth a shuffle.  passes: rounds at most; ids of one
    label are then connected all the same, but connected ids may still have several labels.
    """
    with Scratch(links.sparkSession) as scratch:
        both = links.select(F.col(a).alias("x"), F.col(b).alias("y")).union(links.select(F.col(b), F.col(a)))
        both = scratch.stored(both.distinct() if repeats else both, "links")
        held = Scratch(links.sparkSession)
        labels = held.stored(both.groupBy(F.col("x").alias("id")).agg(F.least(F.min("y"), F.col("x")).alias("comp")), "labels")
        for done in count(1):
            near = both.join(labels, both.y == labels.id).groupBy("x").agg(F.min("comp").alias("near"))
            step = labels.join(near, labels.id == near.x).select("id", F.least("comp", "near").alias("next"), F.col("comp").alias("was"))
            up = labels.select(F.col("id").alias("up_id"), F.col("comp").alias("up"))
            jumped = step.join(up, step.next == up.up_id).select("id", F.least("next", "up").alias("comp"), "was")
            later = Scratch(links.sparkSession)
            jumped = later.stored(jumped, "labels")
            held.clear()
            held, labels = later, jumped.select("id", "comp")
            if done == passes or jumped.filter("comp <> was").isEmpty():
                return labels

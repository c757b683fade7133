"""Mixing sources to target weights by entropy balancing.

The rates closest (in relative entropy) to 1 that meet token constraints are exponential tilts: a document's rate is
exp(sum of the multipliers of its groups).  The multipliers solve a smooth convex dual.  Each Newton iteration is a
Spark aggregation: documents collapse once into cells (one for each combination of group values, with their tokens);
an iteration sums the tilted tokens of the cells into gradient and Hessian, and the driver solves a system as large as
the number of constraints (bounded by max_constraints, an error beyond it).

Rates become whole copies by systematic rounding along the documents of a group ordered by size: copies of the first
k documents number floor(rate * k + 1/2).  As sizes ascend, a group's taken tokens then differ from rate * tokens by at
most one document's size (Abel summation).  Ranks come from counts of (group, size, salt) cells plus a row number
within a cell; a cell of very many rows has as many salts as its count needs, so no task ever holds a whole group.

Defined results: null text has size 0; a null group is a group of its own, last in order; a group without words has
target 0 and takes 0; empty table, empty result; rows that repeat a doc_id are rounded one by one.  Columns besides
those named are carried along by `mix` untouched.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import all_columns, own_names, stored

#: Relative weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)
WORD = r"[^\x20\x09-\x0D]+"


def water_filled(sizes: list[float], weights: list[float], total: float, limit: float) -> list[float]:
    """Shares of total by weight, none above limit * size; what is cut is shared again by weight among the others."""
    target, free, left = [0.0] * len(sizes), set(range(len(sizes))), total
    while free and left > 0:
        weight = sum(weights[i] for i in free)
        over = {i for i in free if left * weights[i] / weight > limit * sizes[i]}
        if not over:
            for i in free:
                target[i] = left * weights[i] / weight
            break
        for i in over:
            target[i] = limit * sizes[i]
        left, free = left - sum(target[i] for i in over), free - over
    return target


def balance(cells: DataFrame, groups: list[str], tokens: str, targets: dict[str, dict], tolerance: float = 1e-10, iterations: int = 60, max_constraints: int = 2000) -> dict[str, dict]:
    """Multipliers {group column: {value: multiplier}} whose tilted tokens meet the targets {group column: {value: tokens}}.

    Groups whose target is 0 get the multiplier -inf.  Columns may overlap (a source and a language constraint, say);
    their targets must then agree in sum, and the multipliers are those of the smallest Newton steps.
    """
    keys = [(g, v) for g in groups for v, t in targets[g].items() if t > 0]
    if len(keys) > max_constraints:
        raise ValueError(f"{len(keys)} constraints; max_constraints is {max_constraints}")
    at, goal = {k: i for i, k in enumerate(keys)}, np.array([targets[g][v] for g, v in keys])
    lam, spark = np.zeros(len(keys)), cells.sparkSession
    cells = cells.groupBy(*groups).agg(F.sum(tokens).alias(tokens)).persist()
    try:
        for _ in range(iterations if keys else 0):
            frame = cells.withColumn("__log_rate", F.lit(0.0))
            for g in groups:
                multiplier = spark.createDataFrame([(v, float(lam[at[g, v]]) if t > 0 else float("-inf")) for v, t in targets[g].items()], f"__v {cells.schema[g].dataType.simpleString()}, __l double")
                frame = frame.join(F.broadcast(multiplier), F.col(g).eqNullSafe(F.col("__v"))).withColumn("__log_rate", F.col("__log_rate") + F.col("__l")).drop("__v", "__l")
            frame = frame.withColumn("__tilted", F.col(tokens) * F.exp("__log_rate"))
            hessian = np.zeros((len(keys), len(keys)))
            for i, g in enumerate(groups):
                for h in groups[i:]:
                    for a, b, t in frame.groupBy(F.col(g).alias("__a"), F.col(h).alias("__b")).agg(F.sum("__tilted").alias("t")).collect():  # max_constraints ** 2 sums at most
                        if t and (g, a) in at and (h, b) in at:
                            hessian[at[g, a], at[h, b]] = hessian[at[h, b], at[g, a]] = t
            gradient = np.diag(hessian) - goal
            if np.abs(gradient).max() <= tolerance * goal.max():
                break
            lam -= np.clip(np.linalg.lstsq(hessian, gradient, rcond=1e-12)[0], -2.0, 2.0)
        else:
            if keys:
                raise ValueError(f"no balance after {iterations} Newton steps: the targets contradict each other or the tokens")
    finally:
        cells.unpersist()
    return {g: {v: float(lam[at[g, v]]) if t > 0 else float("-inf") for v, t in targets[g].items()} for g in groups}


def rounded(docs: DataFrame, group: str, size: str, rate: str, key: str, cell_rows: int = 50_000) -> DataFrame:
    """docs with `copies`: whole numbers whose tokens add up to rate * tokens in each group, to one document's size.

    cell_rows: rows of one group and size that are numbered together, about; more of them are salted by their keys.
    """
    many = docs.groupBy(F.col(group).alias("__g"), F.col(size).alias("__s")).agg(F.ceil(F.count(F.lit(1)) / cell_rows).alias("__salts")).filter("__salts > 1")
    docs = docs.join(many, F.col(group).eqNullSafe(F.col("__g")) & F.col(size).eqNullSafe(F.col("__s")), "left")
    docs = docs.withColumn("__salt", F.pmod(F.xxhash64(F.col(key)), F.coalesce("__salts", F.lit(1)))).drop("__g", "__s", "__salts")
    cell = [group, size, "__salt"]
    before = Window.partitionBy(group).orderBy(size, "__salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = docs.groupBy(*cell).agg(F.count(F.lit(1)).alias("__n")).select(*(F.col(c).alias(f"__c{i}") for i, c in enumerate(cell)), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    same = [F.col(c).eqNullSafe(F.col(f"__c{i}")) for i, c in enumerate(cell)]
    inside = F.row_number().over(Window.partitionBy(*cell).orderBy(F.col(key)))
    ranked = docs.withColumn("__inside", inside).join(offsets, same[0] & same[1] & same[2]).withColumn("__rank", F.col("__inside") + F.col("__offset"))
    upto = lambda k: F.floor(F.col(rate) * k + 0.5)
    return ranked.withColumn("copies", (upto(F.col("__rank")) - upto(F.col("__rank") - 1)).cast("long")).drop("__salt", "__n", "__offset", "__inside", "__rank", *(f"__c{i}" for i in range(3)))


def mix_rates(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", share: float = 1.5, limit: float = 2.0, max_sources: int = 2000) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies: sources share `share` times all words by WEIGHTS.

    Counts all words of all texts.  The table of sources (max_sources rows at most, an error beyond) goes to the driver.
    """
    spark = docs.sparkSession
    sizes = stored(docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size")), "mix-sizes")
    by_source = {r[0]: r[1] for r in sizes.groupBy("source").agg(F.sum("size")).limit(max_sources + 1).collect()}
    if len(by_source) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    names = sorted((s for s in by_source if s is not None)) + ([None] if None in by_source else [])  # str order is code point order
    goal = water_filled([by_source[s] for s in names], [WEIGHTS[i % len(WEIGHTS)] for i in range(len(names))], share * sum(by_source.values()), limit)
    multiplier = balance(sizes, ["source"], "size", {"source": dict(zip(names, goal, strict=True))})["source"]
    plan = spark.createDataFrame([(s, int(by_source[s]), float(t), float(min(np.exp(multiplier[s]), limit))) for s, t in zip(names, goal, strict=True)], "__source string, source_size long, target double, rate double")
    rated = sizes.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    return rounded(rated, "source", "size", "rate", "doc_id")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """docs with each row as many times as the mix takes it (0, 1 or 2), all columns as they were.

    doc_id is taken to be unique here; rows that share one are all repeated by the larger number of copies.
    """
    of, n, copy = own_names(docs, "__key", "__copies", "__copy")
    copies = mix_rates(docs, key, text, source).filter("copies > 0").groupBy(F.col("doc_id").alias(of)).agg(F.max("copies").alias(n))
    taken = docs.join(copies, F.col(key).eqNullSafe(F.col(of)))
    return taken.select(*all_columns(docs), F.explode(F.sequence(F.lit(1), F.col(n).cast("int"))).alias(copy)).select(*all_columns(docs))


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = mix_rates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rates.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "rate", "copies")

"""Evaluation of answers: consistency within groups of questions that mean the same, accuracy of what answers name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col


def entity_match(wanted: Column, got: Column) -> Column:
    """Whether two sets of names are equal (order, case and repeats aside); null where none is wanted, false where none is got."""
    own = lambda x: F.array_sort(F.array_distinct(F.transform(F.coalesce(x, F.array().cast("array<string>")), lambda n: F.lower(n))))
    return F.when(F.size(own(wanted)) > 0, own(wanted) == own(got))


def overlap(wanted: Column, got: Column) -> Column:
    """Size of the intersection of two sets by that of their union; null if both are empty."""
    return F.size(F.array_intersect(wanted, got)) / F.nullif(F.size(F.array_union(wanted, got)), F.lit(0))


def by_group(answers: DataFrame, group: str = "group", ok: str = "ok", signature: str = "signature") -> DataFrame:
    """Of each group with two answers or more: n, all_ok, consistent (all right or all wrong), same_plan (one signature)."""
    plans = F.count_distinct(F.coalesce(c(signature), F.lit("")))
    g = answers.filter(c(group).isNotNull()).groupBy(c(group).alias("group")).agg(F.count(F.lit(1)).alias("n"), F.bool_and(ok).alias("all_ok"), F.bool_or(ok).alias("any_ok"), (plans == 1).alias("same_plan"))
    return g.filter("n > 1").select("group", "n", "all_ok", (c("all_ok") == c("any_ok")).alias("consistent"), "same_plan")


def rates(answers: DataFrame, by: str, ok: str = "ok") -> DataFrame:
    """Of each kind of question (`by`): n that were judged, right among them, rate in per cent."""
    n, right = F.count(ok), F.count_if(c(ok))
    return answers.groupBy(c(by).alias("kind")).agg(n.alias("n"), right.alias("right"), F.round(F.lit(100.0) * right / F.nullif(n, F.lit(0)), 1).alias("rate"))


def report(answers: DataFrame, group: str = "group", kind: str = "expect", ok: str = "ok", signature: str = "signature", entities: str = "entities_ok") -> DataFrame:
    """metric, n, right, rate: groups all right, consistent and of one plan, entity accuracy, right by kind, all.

    ok and entities are null where they were not judged.  Every number is one aggregation over all answers.
    """
    groups = by_group(answers, group, ok, signature)
    metric = lambda df, name, column: df.agg(F.count(column).alias("n"), F.count_if(c(column)).alias("right")).select(F.lit(name).alias("metric"), "n", "right")
    out = rates(answers, kind, ok).select(F.concat(F.lit("kind: "), F.coalesce("kind", F.lit("none"))).alias("metric"), "n", "right")
    for df, name, column in ((groups, "groups all right", "all_ok"), (groups, "groups consistent", "consistent"), (groups, "groups of one plan", "same_plan"), (answers, "entities", entities), (answers, "all", ok)):
        out = out.unionByName(metric(df, name, column))
    return out.withColumn("rate", F.round(F.lit(100.0) * c("right") / F.nullif(c("n"), F.lit(0)), 1))

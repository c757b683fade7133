"""Codes that were misspelt: the closest known code to a short word."""

from __future__ import annotations

from collections.abc import Iterable
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col
LEAST_RATIO = 0.66


def likeness(a: Column, b: Column) -> Column:
    """Twice the matching characters over all characters, by longest common blocks (0 to 1; null if either is null)."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else SequenceMatcher(None, p, q).ratio() for p, q in zip(x, y, strict=True)], dtype="float64")

    return ratio(a, b)


def misspelt_codes(df: DataFrame, key: str, text: str, codes: Iterable[str], known: Iterable[str] = (), least: float = LEAST_RATIO) -> DataFrame:
    """key, word, code: words of three or four letters that are most like a code, ties to the code named first.

    The code has the word's first letter and at most one letter more or less.  known: words (aliases, everyday words)
    that are no misspelling; codes are known too.  Each different word is compared once, whatever the number of texts.
    """
    codes = list(codes)
    skip = {w.lower() for w in (*codes, *known)}
    words = df.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"\b([a-z]{3,4})\b"), 1))).alias("w")).filter(~c("w").isin(*skip))
    pairs = words.select(F.upper("w").alias("word")).distinct().select("word", F.posexplode(F.array(*map(F.lit, codes))).alias("i", "code"))
    best = pairs.withColumn("like", likeness(c("word"), c("code"))).groupBy("word").agg(F.max(F.struct("like", (-c("i")).alias("first"), "code")).alias("b"))
    near = (c("b.like") >= least) & (F.substring("word", 1, 1) == F.substring("b.code", 1, 1)) & (F.abs(F.length("word") - F.length("b.code")) <= 1)
    return words.select(key, F.upper("w").alias("word")).join(best.filter(near).select("word", "b.code"), "word").select(key, "word", "code")

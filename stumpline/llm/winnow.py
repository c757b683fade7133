"""Anchors of windows: every window of a sequence is represented by the smallest gram hash inside it.

Equal windows have equal anchors at the same place, so only windows whose anchor occurs again need a closer look.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import spans

PLACE_BITS = 28
#: Stands for a null doc_id, which counts as smaller than any.
LEAST = -(2**63)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """min(values[i : i + width]) for each i up to len - width (prefix and suffix minima of blocks)."""
    n = len(values)
    if n < width:
        return values[:0]
    padded = np.full((n + width - 1) // width * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(grams: np.ndarray, at: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For items at[i]:at[i + 1] of the sequences: starts of all windows, the place of each one's anchor, and window offsets by sequence.

    grams[p]: hash of the gram that starts at item p (anything where it would leave its sequence).  Ties go to the left.
    """
    sizes = np.diff(at)
    counts = np.maximum(sizes - window + 1, 0)
    starts = spans(at[:-1], counts)
    if not len(starts):
        return starts, starts, np.zeros(len(at), np.int64)
    mask = np.uint64((1 << PLACE_BITS) - 1)
    place = np.arange(len(grams), dtype=np.uint64)
    low = sliding_min((grams & ~mask) | (place & mask), window - gram + 1)[starts] & mask
    first = (starts.astype(np.uint64) & ~mask | low).astype(np.int64)
    first[first < starts] += 1 << PLACE_BITS
    return starts, first, np.concatenate(([0], np.cumsum(counts)))


def text_id(column):
    """The first 60 bits of a text's SHA-256 as a number (null counts as empty), as text_ids() has it in Python."""
    return F.conv(F.substring(F.sha2(F.coalesce(column, F.lit("")).cast("binary"), 256), 1, 15), 16, 10).cast("long")


def text_digest(column):
    """A text's whole SHA-256 as lowercase hex (null counts as empty)."""
    return F.sha2(F.coalesce(column, F.lit("")).cast("binary"), 256)


def numbered(texts: DataFrame, beyond: int = 0) -> DataFrame:
    """texts with a number tid for each, from `beyond` on: to be written out at once, as it differs when made again."""
    return texts.withColumn("tid", F.monotonically_increasing_id() + F.lit(beyond))


def fetched(docs: DataFrame, key: str, text: str, wanted: DataFrame, broadcast_rows: int, by: str = "tid", known=text_id) -> DataFrame:
    """tid, what else wanted has, and text of the wanted (tid, first): first is the smallest doc_id with that text.  One row for each tid.

    A null doc_id or first counts as LEAST.  Rows meet by id and by what known() says of a text (wanted's column `by`),
    as very many may share an id (or have none) or a text.  Up to broadcast_rows wanted rows (24 bytes each, and `by` if
    it is another column: 64 more) are broadcast; more go through a shuffled join.
    """
    least = F.lit(LEAST)
    names = [n for n in wanted.columns if n != "first"]
    ids = wanted.select(*names, F.coalesce("first", least).alias("__id"))
    ids = F.broadcast(ids) if wanted.count() <= broadcast_rows else ids
    texts = docs.select(F.coalesce(F.col(key).cast("long"), least).alias("__id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return texts.withColumn(by, known(F.col("text"))).join(ids, ["__id", by]).select(*names, "text").dropDuplicates(["tid"])

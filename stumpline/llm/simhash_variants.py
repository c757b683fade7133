"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint is cut into fewer segments than it may have differing bits, so that two linked fingerprints agree in one
segment but for at most one bit: with `distance` 4 there are three segments of 21 to 22 bits.  Each segment is indexed
by its one-wildcard variants, one for each bit that is left out.  Linked fingerprints share a variant, so an equality
join on variants finds every link; what meets there is verified by the number of differing bits.

Equal fingerprints travel as one.  A variant that more than `block` fingerprints share is dealt to blocks by hash, and
each pair of its blocks is one group, so a group has 2 * `block` members or so however many share the variant.  A group
of more than FEW yields a forest of its links (each new member is compared with those not yet reached), not all pairs;
components over all forests are those over all links.

Defined results: texts without words (null and empty ones among them) have fingerprint 0 and link like any other;
rows that repeat a doc_id or a text each get their row; a null doc_id counts for no component's smallest id unless all
of its ids are null (component null); empty table, empty result; other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import Scratch, arrow_map, buffers, lowered, pieces, spans, stored, word_bounds

SEED, WORDS, BITS, DISTANCE = 42, 4, 64, 4
#: Bytes of text that are hashed together, and shingles whose bits are counted together.
PART, COUNTED = 1 << 23, 1 << 18
#: Members of a group whose links are all looked at.
FEW = 8


def shingle_hashes(data: np.ndarray, at: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of all shingles of texts that lie end to end, and the n + 1 offsets of each text's shingles."""
    data = lowered(data)
    start, end, first = word_bounds(data, at)
    size = end - start
    begin = np.concatenate(([0], np.cumsum(size + 1)))[: len(size)]  # of each word where single spaces part them
    joined = np.full(int((size + 1).sum()), 32, np.uint8)
    joined[spans(begin, size)] = data[spans(start, size)]
    n_words = np.diff(first)
    n = np.where(n_words > 0, np.maximum(n_words - words + 1, 1), 0)
    head = spans(first[:-1], n)
    tail = np.minimum(head + words - 1, np.repeat(first[1:] - 1, n))
    text, digest = joined.tobytes(), xxhash.xxh64_intdigest
    h = np.fromiter((digest(text[a:b], SEED) for a, b in zip(begin[head].tolist(), (begin[tail] + size[tail]).tolist(), strict=True)), np.uint64, len(head))
    return h, np.concatenate(([0], np.cumsum(n)))


def majority(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each slice of h the 64 bits that are set in over half of its numbers."""
    counts = np.zeros((len(at) - 1, BITS), np.int64)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    for s in range(0, len(h), COUNTED):
        part, own = h[s : s + COUNTED], owner[s : s + COUNTED]
        heads = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts[own[heads]] += np.add.reduceat(bits, heads, axis=0, dtype=np.int64)
    return np.packbits(2 * counts > np.diff(at)[:, None], axis=1, bitorder="little").view("<u8").reshape(-1)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a signed number) of every row."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, 1, PART):
                h, at = shingle_hashes(*buffers(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(majority(h, at).view(np.int64))], ["doc_id", "fp"])

    return arrow_map(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), run, "doc_id long, fp long")


def segments(distance: int = DISTANCE) -> list[tuple[int, int]]:
    """(first bit, width) of the fewest segments of which one differs by one bit at most: distance < 2 * segments."""
    n = distance // 2 + 1
    cuts = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def variants(fp: Column, distance: int = DISTANCE) -> Column:
    """The one-wildcard variants of a fingerprint's segments: a struct (p, rest) for each bit p, rest being its segment without that bit."""
    out = []
    for first, width in segments(distance):
        own = F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << width) - 1 if width < BITS else -1))
        out += [F.struct(F.lit(first + k).alias("p"), own.bitwiseAND(F.lit(~(1 << k) if k < 63 else (1 << 63) - 1)).alias("rest")) for k in range(width)]
    return F.array(*out)


def forest(fp: np.ndarray, distance: int = DISTANCE) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links (a, b) of a spanning forest of the links among these fingerprints: each reached one looks at those not yet reached."""
    a, b, rest = [], [], fp
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(rest ^ x) <= distance
            if near.any():
                found = rest[near]
                a.append(np.full(len(found), x))
                b.append(found)
                queue.extend(found)
                rest = rest[~near]
    return a, b


def _group_links(group: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within groups (group: ascending numbers); those of small groups, most by far, are compared all at once."""
    heads = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    size = np.diff(np.concatenate((heads, [len(group)])))
    small = np.repeat((size > 1) & (size <= FEW), size)
    own, x = group[small], fp[small]
    a, b = [x[:0]], [x[:0]]
    for ahead in range(1, FEW):
        near = (own[ahead:] == own[:-ahead]) & (np.bitwise_count(x[ahead:] ^ x[:-ahead]) <= distance)
        a.append(x[:-ahead][near])
        b.append(x[ahead:][near])
    for s, n in zip(heads[size > FEW].tolist(), size[size > FEW].tolist(), strict=True):
        x, y = forest(fp[s : s + n], distance)
        a += x
        b += y
    return np.concatenate(a), np.concatenate(b)


def _links_of_groups(distance: int):
    """For mapInArrow over rows (p, rest, i, j, fp) sorted by group: a, b of the links that join each group's members."""

    def emitted(columns: list[np.ndarray]):
        change = np.zeros(len(columns[0]), np.int64)
        for x in columns[:4]:
            change[1:] |= x[1:] != x[:-1]
        a, b = _group_links(np.cumsum(change), columns[4].view(np.uint64), distance)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            last = np.ones(len(held[0]), bool)
            for x in held[:4]:
                last &= x == x[-1]
            cut = int(np.argmax(last))  # the last group may go on in the next batch
            if cut:
                yield emitted([x[:cut] for x in held])
                held = [x[cut:].copy() for x in held]
        if held is not None:
            yield emitted(held)

    return run


def links(distinct: DataFrame, distance: int, block: int, scratch: Scratch) -> DataFrame:
    """a, b: links that join every component of the fingerprints `fp` (each once); some links come more than once.

    block: fingerprints of a variant that are dealt to one block, about.
    """
    each = distinct.select("fp", F.explode(variants(F.col("fp"), distance)).alias("v")).select("v.p", "v.rest", "fp")
    # One row for each `block` fingerprints or more: Spark broadcasts them by the size of the table, or joins by shuffle.
    many = each.groupBy("p", "rest").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")).filter("blocks > 1")
    met = each.join(scratch.stored(many, "simhash-hot"), ["p", "rest"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    met = met.withColumns({"own": F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"), "other": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))})
    dealt = met.select("p", "rest", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    dealt = dealt.repartition("p", "rest", "i", "j").sortWithinPartitions("p", "rest", "i", "j")
    return arrow_map(dealt, _links_of_groups(distance), "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", distance: int = DISTANCE, block: int = 4096) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable by links of `distance` bits or fewer) for every row of docs."""
    rows = stored(fingerprints(docs, key, text), "simhash")
    with Scratch(docs.sparkSession) as scratch:
        distinct = scratch.stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
        found = components(links(distinct.select("fp"), distance, block, scratch))
        known = distinct.join(found, F.col("fp") == F.col("id"), "left").select("fp", "first", F.coalesce("comp", "fp").alias("comp"))
        known = scratch.stored(known, "simhash-classes")
        least = known.groupBy("comp").agg(F.min("first").alias("component_id"))
        classes = stored(known.join(least, "comp").select("fp", "component_id"), "simhash-components")
    return rows.join(classes, "fp").select("doc_id", "fp", "component_id")


def op13_simhash_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

"""Similarity join of documents on word shingles by Jaccard overlap, with signature trees.

Documents link if their sets of distinct five-word shingles overlap by three quarters or more.  The join is exact up
to 64-bit hashes of shingles and sets.

1. Equal sets become one set (`sig`, a hash of the set), so copies never meet each other.
2. Prefixes: of a set of s shingles in hash order the first s - ceil(3s/4) + k hold at least k of any partner's prefix
   (k = s // 20 + 1, but PASSAGE at least, or all that a link needs if that is less).  Prefix tokens travel once, packed
   by bucket; a bucket keeps the tokens that two sets share.  Two sets that link share the smaller k of theirs at least;
   sets with fewer shared tokens are done.  Others leave out all but one of so many tokens, those that most sets have: of
   the tokens that two share, the rarest stays in both.  Common passages go that way.
3. Stars: every set is tried against one pivot of its tokens, in a few rounds with other pivots, as long as a round still
   closes a tenth of the tokens; links that verify make components, which settles large groups of near copies with a few
   pairs a set.  About SAMPLE / 4 tokens of each set do for that, as the trees get what stars do not find.
4. Signature trees: sets that share tokens but no component yet are grouped by the pivot of these tokens, and each group
   makes a tree: leaves are sets with bitmaps of their shingles and their size, nodes hold the OR of their bitmaps and
   the range of sizes.  A dual traversal starts at (root, root) and drops a pair of nodes whose largest possible overlap
   is too small, or that lies in one component.  A group of more than BLOCK sets (or SHINGLES shingles) is split into
   blocks, and pairs of blocks are traversed apart.
5. Sets that may overlap enough by their bitmaps make candidate components; all pairs that still may link lie inside one.
   The whole sets of each travel there once, and a second tree verifies its pairs, a few at a time.  In both traversals
   what is joined is one component from then on and its pairs are dropped, so near copies give fewer rows than they are
   sets.  All links together give the components.

Defined results: words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased; null or wordless text has an empty set and
links with nothing; fewer than five words make one shingle; empty table, empty result; rows that repeat a doc_id get a
row each (they link as their texts do); a row without doc_id links as its text does and gets the smallest doc_id that its
component has, null if it has none.  Only the named columns are read.
"""

from __future__ import annotations

import uuid
from collections.abc import Generator, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import components
from .shared import Scratch, arrow_map, buffers, lowered, mixed, own_names, pieces, prefix_hash, range_hash, spans, stored, strings, word_bounds
from .winnow import LEAST, fetched, text_id

WORDS = 5
BITS = 2048
FANOUT = 8
BLOCK = 4096  # sets of a group that one tree holds; more are split into blocks
SHINGLES = 2 << 20  # shingles of a block, about
HELD = 16 << 20  # bytes of groups that are traversed together, about
PART = 1 << 20
TOKENS = 2 << 20  # prefix tokens of a bucket, about
PASSAGE = 32  # shingles that sets share without being alike
SAMPLE = 64  # of this many shingles of a set, those that are prefix tokens serve for stars
IDS = 1 << 24  # bits of the filter of wanted ids
CHUNK = 1 << 15  # bits of a row of bitmap_construct_agg
LONG = 256  # bytes of a word that is hashed as a range
#: By n: the low n bytes of eight.
LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Odd multipliers of the words of a shingle.
MIX = np.array([pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) for k in range(WORDS)], np.uint64)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of words, eight bytes at a time; equal words have equal hashes wherever they are."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    length = end - start
    out = mixed((eight[start] & LOW_BYTES[np.minimum(length, 8)]) + length.astype(np.uint64) * MIX[0])
    more, k = np.flatnonzero((length > 8) & (length <= LONG)), 8
    while len(more):
        out[more] = mixed(out[more] + MIX[1] ^ eight[start[more] + k] & LOW_BYTES[np.minimum(length[more] - k, 8)])
        k += 8
        more = more[length[more] > k]
    if len(huge := np.flatnonzero(length > LONG)):
        out[huge] = range_hash(prefix_hash(data), start[huge], end[huge])
    return out


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text end to end, and their offsets."""
    data, at = buffers(column)
    data = lowered(data)
    start, end, word_at = word_bounds(data, at)
    words = word_hashes(data, start, end)
    counts = np.diff(word_at)
    shingles = np.where(counts >= WORDS, counts - WORDS + 1, np.minimum(counts, 1))
    out_at = np.concatenate(([0], np.cumsum(shingles)))
    from_here = np.full(len(words), WORDS, np.uint64)
    for k in range(min(WORDS, len(words))):
        from_here[: len(words) - k] += words[k:] * MIX[k]
    total = from_here[spans(word_at[:-1], shingles)]
    for n in range(1, WORDS):
        few = np.flatnonzero(counts == n)
        total[out_at[few]] = n + sum(words[word_at[few] + k] * MIX[k] for k in range(n))
    hashes = mixed(total)
    for a, b in zip(out_at[:-1].tolist(), out_at[1:].tolist(), strict=True):
        hashes[a:b].sort()
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    new[out_at[:-1][shingles > 0]] = True
    kept = np.concatenate(([0], np.cumsum(new)))
    return hashes[new], kept[out_at]


def signatures(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set (as signed numbers)."""
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(hashes ^ np.uint64(0x5851F42D4C957F2D)))))
    return mixed(total[at[1:]] - total[at[:-1]] + np.diff(at).astype(np.uint64)).view(np.int64)


def least_shared(size):
    """Prefix tokens that a set of this size shares with any partner, or the partner's number if it is smaller (numbers or arrays).

    PASSAGE at least, or all that a link needs: a passage of that many shingles in two small sets is not enough then.
    """
    return np.maximum(size // 20 + 1, np.minimum(PASSAGE, (3 * size + 3) // 4))


def prefix_length(size: np.ndarray) -> np.ndarray:
    return np.minimum(size, size - (3 * size + 3) // 4 + least_shared(size))


def _least_shared(size: str) -> str:
    """least_shared() in SQL."""
    return f"greatest({size} div 20 + 1, least({PASSAGE}, (3 * {size} + 3) div 4))"


def _partners_share(n: str, size: str):
    """Whether n shared prefix tokens are enough for a link: the smallest partner has three quarters of the size."""
    return F.expr(f"{n} >= {_least_shared(f'((3 * {size} + 3) div 4)')}")


def bitmaps(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(sets, BITS / 64) words: bit h modulo BITS of every shingle."""
    out = np.zeros((len(at) - 1, BITS), bool)
    out[np.repeat(np.arange(len(at) - 1), np.diff(at)), (hashes % np.uint64(BITS)).astype(np.int64)] = True
    return np.packbits(out, axis=1).view(np.uint64)


def scaled_bitmap(hashes: np.ndarray) -> bytes:
    """Bit h modulo n of every shingle of one set; n is a power of two, the set's size and BITS at least.

    OR over rows of BITS bits gives the set's row of bitmaps().
    """
    n = max(BITS, 1 << max(0, len(hashes) - 1).bit_length())
    out = np.zeros(n, bool)
    out[(hashes % np.uint64(n)).astype(np.int64)] = True
    return np.packbits(out).tobytes()


def folded(bitmap: bytes, size: int) -> np.ndarray:
    """A scaled bitmap as words of `size` bytes in all."""
    return np.bitwise_or.reduce(np.frombuffer(bitmap, np.uint64).reshape(-1, size // 8), axis=0)


def overlap_enough(scaled: list[bytes], size: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the pairs (x, y) of large sets may overlap enough, by the larger bitmaps that these have; True for small ones."""
    keep = np.ones(len(x), bool)
    length = np.array([len(b) for b in scaled], np.int64)
    level = np.minimum(length[x], length[y])
    for n in np.unique(level[level > BITS // 8]).tolist():
        at = np.flatnonzero(level == n)
        rows, inverse = np.unique(np.concatenate((x[at], y[at])), return_inverse=True)
        maps = np.stack([folded(scaled[r], n) for r in rows.tolist()])
        i, j = inverse[: len(at)], inverse[len(at) :]
        step = max(1, (1 << 23) // n)
        for k in range(0, len(at), step):
            c = slice(k, k + step)
            a, b, s, t = maps[i[c]], maps[j[c]], size[x[at[c]]], size[y[at[c]]]
            over = np.minimum(s - np.bitwise_count(a & ~b).sum(1, dtype=np.int64), t - np.bitwise_count(b & ~a).sum(1, dtype=np.int64))
            keep[at[c]] = 7 * over >= 3 * (s + t)
    return keep


# -- signature trees ------------------------------------------------------------------------------------------------


def tree_walk(group: np.ndarray, size: np.ndarray, comp: np.ndarray, bits: np.ndarray, side: np.ndarray | None = None, most: int = 1 << 14, known: np.ndarray | None = None) -> Generator[tuple[np.ndarray, np.ndarray], bool | None, None]:
    """Pairs (i, j) of rows of one group and different components that may overlap enough, by dual traversal, `most` at a time.

    side: where given, only pairs of sides 0 and 1 count.  most: node pairs that are expanded at once.  known: other
    components, whose pairs do not count either.  Who changes comp between two steps (components may only grow together)
    sends True, and pairs that lie in one component now are dropped.
    """
    order = np.lexsort((size, group))
    g, s = group[order], size[order].astype(np.int64)
    filled = np.bitwise_count(bits[order]).sum(1, dtype=np.int64)
    c, d = comp[order], np.zeros(len(g), np.int64) if side is None else side[order]
    e = c if known is None else known[order]
    levels = [{"group": g, "bits": bits[order], "low": s, "high": s, "slack": s - filled, "c0": c, "c1": c, "d0": d, "d1": d, "e0": e, "e1": e}]
    while True:
        below = levels[-1]
        heads = np.flatnonzero(np.diff(below["group"], prepend=below["group"][:1] - 1))
        if len(heads) == len(below["group"]):
            break
        inside = np.arange(len(below["group"])) - np.repeat(heads, np.diff(np.append(heads, len(below["group"]))))
        child = np.flatnonzero(inside % FANOUT == 0)
        levels.append(
            {"group": below["group"][child], "bits": np.bitwise_or.reduceat(below["bits"], child, axis=0), "start": child, "count": np.diff(np.append(child, len(inside)))}
            | {k: np.minimum.reduceat(below[k], child) for k in ("low", "c0", "d0", "e0")}
            | {k: np.maximum.reduceat(below[k], child) for k in ("high", "slack", "c1", "d1", "e1")}
        )
    top = len(levels) - 1
    roots = np.arange(len(levels[top]["group"]))
    work = [(top, roots[k : k + most], roots[k : k + most]) for k in range(0, len(roots), most)]
    while work:
        level, a, b = work.pop()
        n = levels[level]
        apart = (n["c0"][a] != n["c0"][b]) | (n["c0"][a] != n["c1"][a]) | (n["c0"][b] != n["c1"][b])
        if known is not None:
            apart &= (n["e0"][a] != n["e0"][b]) | (n["e0"][a] != n["e1"][a]) | (n["e0"][b] != n["e1"][b])
        if side is not None:
            apart &= (n["d0"][a] != n["d1"][b]) | (n["d1"][a] != n["d0"][b])
        near = (4 * n["high"][a] >= 3 * n["low"][b]) & (4 * n["high"][b] >= 3 * n["low"][a]) & apart
        a, b = a[near], b[near]
        need = 3 * (n["low"][a] + n["low"][b])
        if level:
            common = np.bitwise_count(n["bits"][a] & n["bits"][b]).sum(1, dtype=np.int64) + np.minimum(n["slack"][a], n["slack"][b])
            keep = 7 * np.minimum(common, np.minimum(n["high"][a], n["high"][b])) >= need
            a, b = a[keep], b[keep]
            # Children of a with children of b; of one node, each pair of children once.
            ca, cb = n["count"][a], n["count"][b]
            which = np.repeat(np.arange(len(a)), ca * cb)
            inner = np.arange(len(which)) - np.repeat(np.cumsum(ca * cb) - ca * cb, ca * cb)
            x, y = n["start"][a[which]] + inner // cb[which], n["start"][b[which]] + inner % cb[which]
            once = x <= y
            x, y = x[once], y[once]
            work += [(level - 1, x[k : k + most], y[k : k + most]) for k in range(0, len(x), most)]
        else:
            two = a != b
            a, b, need = a[two], b[two], need[two]
            x, y = n["bits"][a], n["bits"][b]
            over = np.minimum(n["low"][a] - np.bitwise_count(x & ~y).sum(1, dtype=np.int64), n["low"][b] - np.bitwise_count(y & ~x).sum(1, dtype=np.int64))
            keep = 7 * over >= need
            if keep.any() and (yield order[a[keep]], order[b[keep]]):
                levels[0]["c0"] = levels[0]["c1"] = comp[order]
                for below, n in zip(levels, levels[1:], strict=False):
                    n["c0"], n["c1"] = np.minimum.reduceat(below["c0"], n["start"]), np.maximum.reduceat(below["c1"], n["start"])


def tree_pairs(group: np.ndarray, size: np.ndarray, comp: np.ndarray, bits: np.ndarray, side: np.ndarray | None = None, most: int = 1 << 14) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of tree_walk() together."""
    found = [np.zeros((2, 0), np.int64), *(np.stack(f) for f in tree_walk(group, size, comp, bits, side, most))]
    x, y = np.concatenate(found, axis=1)
    return x, y


def overlap(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets (sorted, distinct) overlap by three quarters or more."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return False
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 7 * both >= 3 * (len(x) + len(y))


class Joined:
    """Components of rows that grow together: label[row] is a number of the row's component."""

    def __init__(self, comp: np.ndarray):
        self.comps, self.of = np.unique(comp, return_inverse=True)
        self.parent = np.arange(len(self.comps))
        self.label = self.of.copy()

    def join(self, x: np.ndarray, y: np.ndarray) -> None:
        parent = self.parent.tolist()
        for a, b in zip(self.label[x].tolist(), self.label[y].tolist(), strict=True):
            while parent[a] != a:
                a = parent[a]
            while parent[b] != b:
                b = parent[b]
            parent[max(a, b)] = min(a, b)
        self.parent = np.array(parent)
        while not np.array_equal(up := self.parent[self.parent], self.parent):
            self.parent = up
        self.label[:] = self.parent[self.of]

    def settle(self, x: np.ndarray, y: np.ndarray, links) -> bool:
        """Tries the pairs (x, y) by links(x, y), those of one component never; whether any has joined two.

        Of each component one pair is tried at first, then twice as many each time: copies are joined after a few.
        """
        each, any_ = 1, False
        while True:
            apart = self.label[x] != self.label[y]
            x, y = x[apart], y[apart]
            if not len(x):
                return any_
            order = np.argsort(self.label[x], kind="stable")
            x, y = x[order], y[order]
            own = self.label[x]
            heads = np.flatnonzero(np.diff(own, prepend=-1))
            now = np.arange(len(x)) - np.repeat(heads, np.diff(np.append(heads, len(x)))) < each
            ok = links(x[now], y[now])
            if ok.any():
                self.join(x[now][ok], y[now][ok])
                any_ = True
            x, y, each = x[~now], y[~now], 2 * each

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """For each component that was joined to another one: the smallest of those joined, and itself."""
        moved = np.flatnonzero(self.parent != np.arange(len(self.parent)))
        return self.comps[self.parent[moved]], self.comps[moved]


# -- the join -------------------------------------------------------------------------------------------------------


def _sets(docs: DataFrame, key: str, text: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 2, PART):
                hashes, at = shingle_sets(batch.column(2))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(at)), pa.array(signatures(hashes, at))], ["doc_id", "tid", "n_shingles", "sig"])

    return arrow_map(docs.select(F.col(key).cast("long"), text_id(F.col(text)), text), run, "doc_id long, tid long, n_shingles long, sig long")


def _shared_tokens(docs: DataFrame, text: str, partitions: int, buckets: int) -> DataFrame:
    """token, sig, size, sets of prefix tokens that at least two sets have; sets: how many.

    Packed tokens lie sorted by bucket, so a task holds those of one bucket; copies of a set collapse as they come.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 0, PART):
                hashes, at = shingle_sets(batch.column(0))
                sig, size = signatures(hashes, at), np.diff(at)
                use = np.zeros(len(sig), bool)
                use[np.unique(sig, return_index=True)[1]] = True
                use &= size > 0
                length = prefix_length(size[use])
                tokens = hashes[spans(at[:-1][use], length)]
                owner = np.repeat(np.flatnonzero(use), length)
                bucket = ((tokens >> np.uint64(20)) % np.uint64(buckets)).astype(np.uint16 if buckets < 65536 else np.int64)
                order = np.argsort(bucket, kind="stable")
                tokens, owner, bucket = tokens[order], owner[order], bucket[order].astype(np.int64)
                if not len(tokens):
                    continue
                head = np.flatnonzero(np.diff(bucket * len(sig) + owner, prepend=-1))
                count = np.diff(np.append(head, len(tokens)))
                rows = np.flatnonzero(np.diff(bucket, prepend=-1))
                run_at = np.searchsorted(head, np.append(rows, len(tokens)))
                token_at = np.append(rows, len(tokens))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[rows].astype(np.int32)), strings(tokens.view(np.uint8), token_at * 8), strings(sig[owner[head]].view(np.uint8), run_at * 8), strings(size[owner[head]].astype(np.int32).view(np.uint8), run_at * 4), strings(count.astype(np.int32).view(np.uint8), run_at * 4)],
                    ["bucket", "tokens", "sigs", "sizes", "counts"],
                )

    def distinct(tokens: np.ndarray, sig: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """Rows (token, sig, size), each once, sorted by token."""
        order = np.lexsort((sig, tokens))
        tokens, sig, size = tokens[order], sig[order], size[order]
        new = np.ones(len(tokens), bool)
        new[1:] = (tokens[1:] != tokens[:-1]) | (sig[1:] != sig[:-1])
        return tokens[new], sig[new], size[new]

    def joined(held: list[tuple]) -> tuple[np.ndarray, ...]:
        return tuple(np.concatenate(x) for x in zip(*held, strict=True))

    def shared(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        tokens, sig, size = joined(held)
        order = np.argsort(tokens)
        tokens = tokens[order]
        same = tokens[1:] == tokens[:-1]
        again = np.zeros(len(tokens), bool)
        again[1:] |= same
        again[:-1] |= same
        at = order[again]  # few of all, and only these need be told apart
        tokens, sig, size = distinct(tokens[again], sig[at], size[at])
        head = np.flatnonzero(np.diff(tokens, prepend=tokens[:1] - 1))
        count = np.diff(np.append(head, len(tokens)))
        sets = np.repeat(count, count)
        at = np.flatnonzero(sets > 1)
        for k in range(0, len(at), 1 << 18):
            yield pa.RecordBatch.from_arrays([pa.array(x[at[k : k + (1 << 18)]]) for x in (tokens, sig, size, sets)], ["token", "sig", "size", "sets"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held, n, most = None, [], 0, TOKENS
        for batch in batches:
            # All rows of a batch lie end to end, and sorted by bucket.
            row_bucket = batch.column(0).to_numpy()
            tokens, at = buffers(batch.column(1))
            sigs, sizes, counts = (buffers(batch.column(c))[0].view(kind) for c, kind in ((2, np.int64), (3, np.int32), (4, np.int32)))
            tokens, sigs, sizes, at = tokens.view(np.int64), np.repeat(sigs, counts), np.repeat(sizes, counts), at // 8
            first = np.flatnonzero(np.diff(row_bucket, prepend=row_bucket[:1] - 1))
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(row_bucket)], strict=True):
                if row_bucket[a] != bucket and held:
                    yield from shared(held)
                    held, n, most = [], 0, TOKENS
                bucket = row_bucket[a]
                own = slice(at[a], at[b])
                held.append((tokens[own], sigs[own], sizes[own]))
                n += len(tokens[own])
                if n > most:
                    held = [distinct(*joined(held))]
                    n = len(held[0][0])
                    most = max(TOKENS, 2 * n)
        if held:
            yield from shared(held)

    packed = arrow_map(docs.select(text), pack, "bucket int, tokens binary, sigs binary, sizes binary, counts binary")
    return arrow_map(packed.repartition(partitions, "bucket").sortWithinPartitions("bucket"), unpack, "token long, sig long, size int, sets long")


def _rare_tokens(shared: DataFrame) -> DataFrame:
    """token, sig, size of the tokens that are left of each set without those that most sets have.

    Whatever links with a set shares at least n of its tokens (_partners_share).  The n - 1 that most sets have may go:
    the order is the same in all sets, so of the tokens that two share the last in it stays in both.
    """
    order = Window.partitionBy("sig").orderBy(F.desc("sets"), "token")
    return shared.withColumn("n", F.row_number().over(order)).filter(_partners_share("n", "size")).select("token", "sig", "size")


def _texts_by_filter(docs: DataFrame, key: str, text: str, first: DataFrame) -> DataFrame:
    """text of the rows of docs whose id may be one of the column first, by a filter of fixed size; a few others pass too."""
    place = lambda c: F.pmod(F.xxhash64(F.coalesce(c, F.lit(LEAST))), F.lit(IDS))
    chunks = first.select(place(F.col("first")).alias("place")).groupBy(F.expr(f"place div {CHUNK}").alias("chunk")).agg(F.bitmap_construct_agg(F.col("place") % CHUNK).alias("bitmap"))
    bitmap = np.zeros(IDS // 8, np.uint8)
    for chunk, part in chunks.collect():  # IDS / CHUNK rows at most
        bitmap[chunk * CHUNK // 8 : (chunk + 1) * CHUNK // 8] = np.frombuffer(part, np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            at = batch.column(0).to_numpy()
            yield batch.filter(pa.array((bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0)).select([1])

    return arrow_map(docs.select(place(F.col(key).cast("long")).alias("place"), F.col(text).alias("text")), run, "text string")


def _full_sets(texts: DataFrame) -> DataFrame:
    """sig, size, bits (scaled bitmap), hashes (sorted shingles) of the column text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 0, PART):
                hashes, at = shingle_sets(batch.column(0))
                bits = [scaled_bitmap(hashes[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(signatures(hashes, at)), pa.array(np.diff(at)), pa.array(bits, pa.binary()), strings(hashes.view(np.uint8), at * 8)], ["sig", "size", "bits", "hashes"])

    return arrow_map(texts.select("text"), run, "sig long, size long, bits binary, hashes binary")


def _verified(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets overlap by three quarters.

    full is bucketed by sig, so it does not move: the sets of b go to the pairs' tasks, those of a are fetched once each
    and then joined by a shuffle on both sides, where AQE splits an `a` of very many pairs.
    """

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [overlap(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.filter(pa.array(ok, pa.bool_())).select([0, 1])

    own = lambda c: full.select(F.col("sig").alias(c), F.col("hashes").alias(f"hashes_{c}")).hint("merge")
    with Scratch(pairs.sparkSession) as scratch:
        pairs = scratch.stored(pairs, "pairs")
        first = scratch.stored(pairs.select("a").distinct().join(own("a"), "a"), "pair-sets")
        whole = pairs.join(own("b"), "b").join(first, "a").select("a", "b", "hashes_a", "hashes_b")
        few = pairs.sparkSession.sparkContext.defaultParallelism  # links are small rows: a file for each core, not for each task
        return stored(arrow_map(whole, exact, "a long, b long").repartition(few), "links")


def _tree_joined(rows: DataFrame, exact: bool) -> DataFrame:
    """a, b: what joins components of sets among rows (p, i, j, blk, sig, comp, size, bits, hashes): blocks i and j of group p.

    Of one block each with each if i = j, else only pairs across; pairs of one comp never.  exact: a and b are comps that
    linked sets join.  Otherwise (without hashes) they are sets that pairs which may link by their bitmaps join.  What is
    traversed together gives each b once.
    """
    columns = ["p", "i", "j", "blk", "sig", "comp", "size", "bits", *(["hashes"] if exact else [])]

    def solve(part: pa.Table, group: np.ndarray) -> pa.RecordBatch:
        scaled = part.column("bits").to_pylist()
        bits = np.stack([folded(b, BITS // 8) for b in scaled])
        size, i, j, sig, known = (part.column(c).to_numpy().astype(np.int64) for c in ("size", "i", "j", "sig", "comp"))
        joined = Joined(known if exact else sig)
        if exact:
            data, at = buffers(part.column("hashes"))
            hashes, at = data.view(np.uint64), (at // 8).tolist()

        def links(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            ok = overlap_enough(scaled, size, x, y)
            if exact:
                ok[ok] = [overlap(hashes[at[a] : at[a + 1]], hashes[at[b] : at[b + 1]]) for a, b in zip(x[ok].tolist(), y[ok].tolist(), strict=True)]
            return ok

        # In a pair of blocks only pairs across count; in a block each with each.
        across = i != j
        side = np.where(part.column("blk").to_numpy() == i, 0, 1)
        for which, sides in ((~across, None), (across, side)):
            own = np.flatnonzero(which)
            if not len(own):
                continue
            comp = joined.label[own]
            walk = tree_walk(group[own], size[own], comp, bits[own], None if sides is None else sides[own], known=known[own])
            pairs = next(walk, None)
            while pairs is not None:
                changed = joined.settle(own[pairs[0]], own[pairs[1]], links)
                comp[:] = joined.label[own]
                try:
                    pairs = walk.send(changed)
                except StopIteration:
                    break
        return pa.RecordBatch.from_arrays([pa.array(c) for c in joined.edges()], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in _with_end(batches):
            if batch is not None:
                rest = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
                if rest.nbytes < HELD:
                    continue
            if rest is None or not rest.num_rows:
                continue
            p, i, j = (rest.column(c).to_numpy() for c in ("p", "i", "j"))
            new = np.ones(len(p), bool)
            new[1:] = (p[1:] != p[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
            upto = len(p) if batch is None else int(np.flatnonzero(new)[-1])  # the last group may go on
            if upto:
                yield solve(rest.slice(0, upto), np.cumsum(new)[:upto])
            rest = rest.slice(upto)

    return arrow_map(rows.select(*columns), run, "a long, b long")


def _blocked(groups: DataFrame, full: DataFrame, block: int, scratch: Scratch, columns: list[str]) -> DataFrame:
    """The rows of groups (p, sig, size, comp) dealt to pairs of blocks (i, j), sorted by these, with columns of full."""
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / block, F.sum("size") / SHINGLES)).cast("int")
    apart = F.min("comp") != F.max("comp")  # a group of one component has nothing to join
    count = scratch.stored(groups.groupBy("p").agg(blocks.alias("blocks"), apart.alias("apart")).filter("apart").select("p", "blocks"), "blocks")
    placed = groups.join(count, "p").withColumn("blk", F.pmod(F.xxhash64("sig", F.lit(3)), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("blk", "other"), "j": F.greatest("blk", "other")})
    return placed.join(full.select("sig", *columns), "sig").repartition(F.col("p"), F.col("i"), F.col("j")).sortWithinPartitions("p", "i", "j")


def _placed(tokens: DataFrame, comp: DataFrame) -> DataFrame:
    """token, sig, size, comp; the sets of comp (id, comp) have that component, others one of their own."""
    placed = tokens.select("token", "sig", "size").join(comp.select(F.col("id").alias("sig"), "comp"), "sig", "left")
    return placed.select("token", "sig", "size", F.coalesce("comp", "sig").alias("comp"))


def _open_rows(tokens: DataFrame, comp: DataFrame, into: Scratch) -> DataFrame:
    """token, sig, size, comp of tokens that lie in two components or more.

    Components only grow together, so what is left out stays out: the rows of one round are the tokens of the next.
    """
    with Scratch(tokens.sparkSession) as scratch:
        placed = scratch.stored(_placed(tokens, comp), "placed")
        apart = placed.groupBy("token").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("c0 <> c1").select("token")
        return into.stored(placed.join(scratch.stored(apart, "open-tokens"), "token"), "open")


def _stars(rows: DataFrame, seed: int, scratch: Scratch) -> DataFrame:
    """For each set the one pair (a, b) with the pivot, in another component, that it shares most tokens with.

    The pivot of a token is its set of smallest hash, another one for each seed.  Sets of very different size do not link,
    and those that share hardly any token of the sample seldom do: such pairs are left to the trees.
    """
    rank = F.struct(F.xxhash64("sig", F.lit(seed)), F.col("sig"), F.col("comp"), F.col("size"))
    pivots = scratch.stored(rows.groupBy("token").agg(F.min(rank).alias("r")).select("token", F.col("r.sig").alias("p"), F.col("r.comp").alias("p_comp"), F.col("r.size").alias("p_size")), "pivots")
    may = rows.join(pivots, "token").filter("comp <> p_comp AND 4 * size >= 3 * p_size AND 4 * p_size >= 3 * size")
    met = may.groupBy("sig", "p").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("s")).filter("10 * n >= least(s, 30)")
    return met.groupBy("sig").agg(F.max(F.struct("n", "p")).alias("best")).select(F.col("best.p").alias("a"), F.col("sig").alias("b"))


def _with_end(items):
    yield from items
    yield None


def _links(rows: DataFrame, held: Scratch, full: DataFrame, rounds: int, block: int) -> DataFrame:
    """All links that components need: rounds of stars, then signature trees over what is still apart.  held: has the rows.

    A round that closes less than a tenth of the rows is the last, and one after which less than a quarter is left of
    all: what other pivots would close, the trees close too.
    """
    spark = full.sparkSession
    links, comp = spark.createDataFrame([], "a long, b long"), None
    if rows.isEmpty():
        return links
    now = Scratch(spark)
    sample = now.stored(rows.filter(f"pmod(token, 1024) * size < {1024 * SAMPLE}"), "sample") if rounds else rows
    left = whole = sample.count() if rounds else 0
    for seed in range(rounds):
        if not left:
            break
        with Scratch(spark) as scratch:
            new = _verified(_stars(sample, seed, scratch), full)
        if new.isEmpty():
            break
        links = links.union(new)
        later = Scratch(spark)
        # One pass joins the stars of a round, another those of each round before; labels that fall short lose no link.
        comp = components(links, repeats=False, passes=seed + 1)
        sample = _open_rows(sample, comp, later)
        now.clear()
        now = later
        before, left = left, sample.count()
        if 10 * left > 9 * before or 4 * left < whole:
            break
    now.clear()
    with held, Scratch(spark) as scratch:
        placed = rows if comp is None else scratch.stored(_placed(rows, comp), "placed")
        pivots = placed.groupBy("token").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.min("sig").alias("p")).filter("c0 <> c1").select("token", "p")
        met = placed.join(scratch.stored(pivots, "pivots"), "token")
        groups = scratch.stored(met.groupBy("p", "sig").agg(F.max("size").alias("size"), F.max("comp").alias("comp")), "groups")
        may = components(scratch.stored(_tree_joined(_blocked(groups, full, block, scratch, ["bits"]), exact=False), "candidates"))
        sets = groups.groupBy("sig").agg(F.max("size").alias("size"), F.max("comp").alias("comp"))
        candidates = scratch.stored(sets.join(may.select(F.col("id").alias("sig"), F.col("comp").alias("p")), "sig"), "candidate-sets")
        return links.union(stored(_tree_joined(_blocked(candidates, full, block, scratch, ["bits", "hashes"]), exact=True).distinct(), "links"))


def _linked(docs: DataFrame, key: str, text: str, broadcast_rows: int, rounds: int, block: int) -> DataFrame:
    """doc_id, tid, n_shingles, component_id, kept for every row of docs."""
    spark = docs.sparkSession
    partitions = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sets = stored(_sets(docs, key, text), "sets")
    held = Scratch(spark)
    with Scratch(spark) as scratch:
        prefix = f"least(n_shingles, n_shingles - (3 * n_shingles + 3) div 4 + {_least_shared('n_shingles')})"
        tokens = sets.agg(F.coalesce(F.sum(F.expr(prefix)), F.lit(0))).first()[0]
        shared = scratch.stored(_shared_tokens(docs, text, partitions, max(partitions, -(-tokens // TOKENS))), "shared-tokens")
        rows = held.stored(_rare_tokens(shared).withColumn("comp", F.col("sig")), "tokens")

    full = f"sets_{uuid.uuid4().hex}"
    with Scratch(spark) as scratch:
        row = F.struct(F.coalesce("doc_id", F.lit(LEAST)).alias("first"), "tid")
        chosen = sets.join(rows.select("sig").distinct(), "sig", "left_semi").groupBy("sig").agg(F.min(row).alias("row"))
        chosen = scratch.stored(chosen.select("row.*"), "chosen")
        if chosen.count() <= broadcast_rows:
            whole = _full_sets(fetched(docs, key, text, chosen, broadcast_rows)).repartition(partitions, "sig")
        else:  # texts are not shuffled; a copy, or another text, may pass the filter too
            whole = _full_sets(_texts_by_filter(docs, key, text, chosen)).repartition(partitions, "sig").dropDuplicates(["sig"])
        whole.write.option("path", scratch.folder("full-sets")).bucketBy(partitions, "sig").sortBy("sig").saveAsTable(full)
        try:
            comp = components(_links(rows, held, spark.table(full), rounds, block), repeats=False)
        finally:
            spark.sql(f"DROP TABLE IF EXISTS {full}")

    known = sets.join(comp.select(F.col("id").alias("sig"), "comp"), "sig", "left").withColumn("comp", F.coalesce("comp", "sig"))
    known = stored(known, "known")
    keeper = F.min(F.struct(F.col("doc_id").isNull().alias("lost"), "doc_id", "tid"))
    least = stored(known.filter("n_shingles > 0").groupBy("comp").agg(F.min("doc_id").alias("least"), keeper.alias("keeper")), "least")
    out = known.join(least, "comp", "left")
    some = F.col("n_shingles") > 0
    return out.select(
        "doc_id", "tid", "n_shingles", F.when(some, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"),
        (~some | (F.col("keeper.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("keeper.tid") == F.col("tid")))).alias("kept"),
    )


def similar_sets(docs: DataFrame, key: str = "doc_id", text: str = "text", broadcast_rows: int = 200_000, rounds: int = 4, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) for every row of docs.

    broadcast_rows: most ids of candidate sets that are broadcast to fetch their texts; of more, a filter is broadcast.
    rounds: of stars, at most.  block: sets of a tree; a larger group is split into pairs of blocks.
    """
    return _linked(docs, key, text, broadcast_rows, rounds, block).select("doc_id", "n_shingles", "component_id")


def keep_one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", broadcast_rows: int = 200_000) -> DataFrame:
    """docs with one text of each component only, that of the smallest doc_id (null ids last).  All columns as they were.

    Rows that share both doc_id and text with the one that stays, stay with it; texts without words all stay.
    """
    of, tid = own_names(docs, "__kept", "__tid")
    kept = _linked(docs, key, text, broadcast_rows, 4, BLOCK).filter("kept").select(F.col("doc_id").alias(of), F.col("tid").alias(tid)).distinct()
    same = F.col(key).cast("long").eqNullSafe(F.col(of)) & (text_id(F.col(text)) == F.col(tid))
    return docs.join(kept, same, "left_semi")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_sets(spark.read.parquet(f"{sf_dir}/documents.parquet"))

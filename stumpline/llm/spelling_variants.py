"""Spelling variants by full neighbourhood generation.

Every word of the vocabulary emits all distinct results of one deletion, one replacement and one insertion over the
observed alphabet.  A result that is itself a word of the vocabulary is a near word; the join by equality finds it, and
no distance is ever computed.  A near word of at least `factor` times the occurrences is a word's form; following forms
ends at the root, as occurrences grow along the way.

Letters are those of ISO 8859-1, so a word travels as one byte a letter, whose order is that of code points.  Of the
results only those go through the shuffle that a Bloom filter of the vocabulary lets pass.  The filter has a fixed
size (`filter_bits`, 16 MB), lets every word of the vocabulary pass at any size, and so decides about cost alone.
A word's results are made in parts of bounded size, so a very long word does no harm.

Defined results: a null or empty text has no words; rows that repeat a doc_id count one by one; a null doc_id counts as
the empty text before the colon; empty table, empty result; other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import BASE, BASE_INV, BYTE_CODE, Scratch, arrow_map, buffers, mixed, powers, stored, strings

RUN = re.compile(rb"[a-z\xc0-\xff]+")
#: Letters of a text that are read together, words whose counts a task holds at most, and results that are made at once.
READ, HELD, AT_ONCE = 1 << 20, 200_000, 1 << 20
#: Bits of one chunk of the filter: what bitmap_construct_agg holds.
CHUNK = 32768
SEED = np.uint64(0x6A09E667F3BCC909)


def runs(text: bytes):
    """Maximal runs of letters, A-Z lower-cased, in lists for parts of about READ bytes that end between runs."""
    first = 0
    while first < len(text):
        last = first + READ
        if last < len(text):
            end = RUN.match(text, last)  # a run that the cut would part goes with this part
            last = end.end() if end else last
        yield RUN.findall(text, first, last)
        first = last


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = 5, damage: int = 97) -> DataFrame:
    """word (binary, one byte a letter), n: occurrences of words of least_length letters or more in all texts.

    Where `damage` divides the crc32 h of `<doc_id>:<run>` the run loses its letter h % length; 0 leaves runs as they are.
    """

    def run(batches):
        seen: Counter = Counter()

        def flushed():
            words = list(seen)
            out = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([seen[w] for w in words], pa.int64())], ["word", "n"])
            seen.clear()
            return out

        for batch in batches:
            for doc, said in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                letters = (said.as_py() or "").encode("latin-1", "replace").lower()  # other characters become a question mark; only A-Z have a lower case here
                for part in runs(letters):
                    for w, n in Counter(part).items():
                        if damage:
                            h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), start)
                            if h % damage == 0:
                                at = h % len(w)
                                w = w[:at] + w[at + 1 :]
                        if len(w) >= least_length:
                            seen[w] += n
                    if len(seen) > HELD:
                        yield flushed()
        yield flushed()

    counted = arrow_map(docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text")), run, "word binary, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


#: What of a hash tells its places in the filter.
PLACES = (lambda h: h, lambda h: h >> np.uint64(32), lambda h: mixed(h ^ SEED))


def _sums(word: np.ndarray) -> np.ndarray:
    """For words of one length (rows of letters): sums of code * BASE ** place over the first 0, 1, ... letters."""
    out = np.zeros((len(word), word.shape[1] + 1), np.uint64)
    np.cumsum(BYTE_CODE[word] * powers(BASE, word.shape[1]), axis=1, out=out[:, 1:])
    return out


def by_length(column: pa.Array):
    """(rows, letters) for each length: numbers of the rows and a matrix of their letters."""
    data, at = buffers(column)
    size = np.diff(at)
    for n in np.unique(size[size > 0]):
        rows = np.flatnonzero(size == n)
        yield rows, data[at[rows][:, None] + np.arange(n)]


def word_places(words: DataFrame, bits: int) -> DataFrame:
    """place: the three filter places of every word."""

    def run(batches):
        for batch in batches:
            for _, word in by_length(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([place(mixed(_sums(word)[:, -1])) & np.uint64(bits - 1) for place in PLACES]).view(np.int64))], ["place"])

    return arrow_map(words.select("word"), run, "place long")


def bloom(words: DataFrame, bits: int) -> np.ndarray:
    """The filter of all words: bits / 8 bytes, whatever the vocabulary."""
    chunks = word_places(words, bits).groupBy(F.expr(f"place div {CHUNK}").alias("chunk")).agg(F.bitmap_construct_agg(F.col("place") % CHUNK).alias("bitmap"))
    out = np.zeros(max(bits, CHUNK) // 8, np.uint8)
    for chunk, bitmap in chunks.collect():  # bits / CHUNK rows at most
        out[chunk * CHUNK // 8 : (chunk + 1) * CHUNK // 8] = np.frombuffer(bitmap, np.uint8)
    return out


def alphabet(words: DataFrame) -> list[int]:
    """Letters that the vocabulary has (256 at most)."""

    def run(batches):
        seen = np.zeros(256, bool)
        for batch in batches:
            seen[buffers(batch.column(0))[0]] = True
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(seen))], ["letter"])

    return sorted(r.letter for r in arrow_map(words.select("word"), run, "letter long").distinct().collect())


def neighbours(word: np.ndarray, letters: np.ndarray, passes):
    """(rows, results) of all distinct deletions, replacements and insertions of words of one length that `passes` lets through.

    passes: tells of an array of hashes which to keep.  A letter that equals the one before it is not deleted, and none
    is put behind its like, so each result comes once.
    """
    n, length = word.shape
    total, code, power = _sums(word), BYTE_CODE[letters], powers(BASE, length + 1)
    whole = total[:, -1]
    step = max(1, AT_ONCE // (n * len(letters)))
    for p in range(0, length, step):
        at = np.arange(p, min(p + step, length))
        first = np.ones((n, len(at)), bool)
        later = at > 0
        first[:, later] = word[:, at[later]] != word[:, at[later] - 1]
        keep = first & passes(mixed(total[:, at] + (whole[:, None] - total[:, at + 1]) * np.uint64(BASE_INV)))
        rows, i = np.nonzero(keep)
        if len(rows):
            others = np.arange(length - 1)[None, :]
            yield rows, word[rows[:, None], others + (others >= at[i][:, None])]
        other = letters != word[:, at][:, :, None]
        keep = other & passes(mixed(whole[:, None, None] + (code - BYTE_CODE[word[:, at]][:, :, None]) * power[at][:, None]))
        rows, i, c = np.nonzero(keep)
        if len(rows):
            out = word[rows]
            out[np.arange(len(rows)), at[i]] = letters[c]
            yield rows, out
    for p in range(0, length + 1, step):
        at = np.arange(p, min(p + step, length + 1))
        new = np.ones((n, len(at), len(letters)), bool)
        later = at > 0
        new[:, later] = letters != word[:, at[later] - 1][:, :, None]
        behind = total[:, at][:, :, None] + (whole[:, None] - total[:, at])[:, :, None] * np.uint64(BASE)
        rows, i, c = np.nonzero(new & passes(mixed(behind + code * power[at][:, None])))
        if len(rows):
            every = np.arange(length + 1)[None, :]
            out = word[rows[:, None], np.minimum(every - (every > at[i][:, None]), length - 1)]
            out[np.arange(len(rows)), at[i]] = letters[c]
            yield rows, out


def candidates(words: DataFrame, letters: list[int], filter_bits: int) -> DataFrame:
    """near, word: all distinct results of one edit of each word that the vocabulary's filter lets pass."""
    spark = words.sparkSession
    shared = spark.sparkContext.broadcast(bloom(words, filter_bits).tobytes())
    own = np.array(letters, np.uint8)

    def run(batches):
        bitmap = np.frombuffer(shared.value, np.uint8)

        def passes(h):
            flat = h.reshape(-1)
            left = np.arange(len(flat))
            for place in PLACES:
                at = place(flat[left]) & np.uint64(filter_bits - 1)
                left = left[(bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0]
            keep = np.zeros(len(flat), bool)
            keep[left] = True
            return keep.reshape(h.shape)

        for batch in batches:
            for _, word in by_length(batch.column(0)):
                step = max(1, AT_ONCE // (len(own) * word.shape[1]))
                for s in range(0, len(word), step):
                    part = word[s : s + step]
                    for rows, out in neighbours(part, own, passes):
                        as_column = lambda x: strings(x.reshape(-1), np.arange(len(x) + 1) * x.shape[1])
                        yield pa.RecordBatch.from_arrays([as_column(out), as_column(part[rows])], ["near", "word"])

    return arrow_map(words.select("word"), run, "near binary, word binary")


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """word, root of every word that has a form: forms are followed by doubling, as far as they go.

    Occurrences grow by `factor` from a word to its form, so the rounds are as few as the logarithm of a logarithm.
    """
    now = scratch.stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        step = scratch.stored(step, "roots")
        now = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return now


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = 5, least_count: int = 3, factor: int = 2, damage: int = 97, filter_bits: int = 1 << 27) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of least_length letters with least_count occurrences.

    filter_bits: size of the filter, a power of two.
    """
    with Scratch(docs.sparkSession) as scratch:
        words = scratch.stored(word_counts(docs, key, text, least_length, damage).filter(F.col("n") >= least_count), "spelling-words")
        if words.isEmpty():
            return docs.sparkSession.createDataFrame([], "word string, form string, root string, n long, n_near long, form_n long")
        near = candidates(words, alphabet(words), filter_bits).join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
        best = F.min(F.struct((-F.col("near_n")).alias("least"), F.col("near").alias("form")))
        met = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
        all_words = words.join(met, "word", "left")
        has = -F.col("best.least") >= factor * F.col("n")
        all_words = stored(all_words.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("best.form")).alias("form"), F.when(has, -F.col("best.least")).alias("form_n")), "spelling")
        ends = stored(roots(all_words.filter("form is not null"), scratch), "spelling-roots")
    letters = lambda name: F.decode(F.col(name), "ISO-8859-1").alias(name)
    out = all_words.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
    return out.select(letters("word"), letters("form"), letters("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Language identification by prediction by partial matching (PPM).

For every language a byte context tree of variable order (0 to 4) holds symbol counts; escape probabilities follow
method C: a context with n symbols of d kinds gives a known symbol count / (n + d) and leaves d / (n + d) to the next
shorter context; below order 0 all symbols are alike.  The statistics are frozen after training, so each tree becomes
a table of exact code lengths, and a text's code length under a language is a sum over its bytes; the shortest wins.
The score is the posterior of that language under equal priors.

Training takes a bounded sample of labelled texts, about max_docs texts and max_bytes bytes of each language and
total_bytes of all, chosen by a hash of the key.  The trees are pruned: all orders below two are kept, of order 2 the `pairs` commonest
contexts, of orders 3 and 4 the commonest whose pairs of symbols are kept and that were seen LEAST times or more, up to
`nodes` contexts in all.  What is common is judged by language (the largest share that a context has in any of them),
so a small language keeps its own.  A context that is not kept is coded by its longest kept suffix, in training and
scoring alike.  Byte values beyond the 254th that a corpus has share the last symbol.  The table of code lengths has
TABLE bytes at most: with very many languages there are fewer contexts.

Scoring is one pass over whole texts, without a shuffle: all languages share the set of contexts, so a byte costs one
context lookup and one row of code lengths.

Defined results: null text or a text without a letter gives `und` with score 0; no usable training row gives `und` for
all; repeated rows are scored one by one; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import arrow_map, buffers, crc_mod, pieces, release

ORDER = 4
PAIRS = 1023  # contexts of order 2, which get longer ones
NODES = 8192  # contexts of the tree
LEAST = 3  # times that a context of order 3 or 4 is seen
TABLE = 128 << 20  # bytes of all code lengths (four languages need some 20 MB)
BATCH = 1 << 20


class PPMModel:
    """names: languages; kind: byte -> symbol; kept: contexts by order; pair: two symbols -> pair id (0: none);
    node: two pair ids -> context; triple: symbol, pair id -> context; single: symbol -> context of order 1;
    cost: context, symbol -> bits by language."""

    def __init__(self, texts: dict[str, list[bytes]], pairs: int = PAIRS, nodes: int = NODES, table: int = TABLE):
        self.names = sorted(texts)
        streams = {n: np.frombuffer(b"".join(b"\0" * ORDER + t for t in texts[n]), np.uint8) for n in self.names}
        seen = np.zeros(256, np.int64)
        for s in streams.values():
            seen += np.bincount(s, minlength=256)
        seen[0] = 0
        used = np.flatnonzero(seen)
        self.kind = np.zeros(256, np.uint8)
        self.kind[used] = np.minimum(np.arange(1, len(used) + 1), 255)
        self.width = int(self.kind.max()) + 1
        self.most_nodes = min(nodes, table // (4 * self.width * max(len(self.names), 1)))
        self.most_pairs = min(pairs, max(0, self.most_nodes - 1 - self.width) // 2)
        self._grow({n: self.kind[s] for n, s in streams.items()})

    def _grow(self, coded: dict[str, np.ndarray]) -> None:
        width, names = self.width, self.names
        # The symbols 0 between texts are context, never counted themselves.
        told = {n: s[ORDER:] != 0 for n, s in coded.items()}

        def contexts(k: int, n: str) -> np.ndarray:
            """For each counted byte its last k symbols as a number (below 256 ** ORDER, so four bytes hold it)."""
            s, whole = coded[n], np.zeros(len(told[n]), np.uint32)
            for i in range(1, k + 1):
                whole += s[ORDER - i : len(s) - i] * np.uint32(width ** (i - 1))
            return whole[told[n]]

        def counted(k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Contexts of order k, how often each was seen, and its largest share in a language."""
            own = [np.unique(contexts(k, n), return_counts=True) for n in names]
            values, at = np.unique(np.concatenate([v for v, _ in own] or [np.zeros(0, np.int64)]), return_inverse=True)
            times, share = np.zeros(len(values), np.int64), np.zeros(len(values))
            np.add.at(times, at, np.concatenate([c for _, c in own] or [np.zeros(0, np.int64)]))
            np.maximum.at(share, at, np.concatenate([c / max(c.sum(), 1) for _, c in own] or [np.zeros(0)]))
            return values.astype(np.int64), times, share

        two = counted(2)
        pairs = np.sort(two[0][np.argsort(-two[2], kind="stable")[: self.most_pairs]])
        self.pair = np.zeros(width * width, np.int16)
        self.pair[pairs] = np.arange(1, len(pairs) + 1)
        kept = [np.zeros(1, np.int64), np.arange(width), pairs]
        deep = []
        for k in (3, 4):
            v, c, s = counted(k)
            may = (self.pair[v % width**2] > 0) & (c >= LEAST)
            if k == 4:
                may &= self.pair[v // width**2] > 0
            deep.append((v[may], s[may]))
        shares = np.concatenate([s for _, s in deep])
        room = max(0, self.most_nodes - 1 - width - len(pairs))
        least = np.partition(shares, -room)[-room] if len(shares) > room > 0 else 0.0 if room else 2.0
        kept += [v[s >= least] for v, s in deep]  # ties at the bound are all kept
        self.kept = kept
        first = np.cumsum([0, *map(len, kept)])

        def find(k: int, values: np.ndarray) -> np.ndarray:
            """Node of the longest kept suffix of contexts of k symbols."""
            if k == 0:
                return np.zeros(len(values), np.int64)
            at = np.searchsorted(kept[k], values)
            hit = (at < len(kept[k])) & (np.append(kept[k], -1)[np.minimum(at, len(kept[k]))] == values)
            out = first[k] + at
            if not hit.all():
                out[~hit] = find(k - 1, values[~hit] % width ** (k - 1))
            return out

        total = int(first[-1])
        cost = np.empty((total, width, len(names)), np.float32)
        for j, n in enumerate(names):
            symbols = coded[n][ORDER:][told[n]].astype(np.int64)
            p = np.empty((total, width))
            for k in range(ORDER + 1):
                rows = slice(first[k], first[k + 1])
                own = contexts(k, n)
                at = np.searchsorted(kept[k], own)
                hit = (at < len(kept[k])) & (np.append(kept[k], -1)[np.minimum(at, len(kept[k]))] == own)
                c = np.bincount(at[hit] * width + symbols[hit], minlength=len(kept[k]) * width).reshape(-1, width)
                d, m = (c > 0).sum(1, keepdims=True), c.sum(1, keepdims=True)
                below = np.full((1, width), 1 / width) if k == 0 else p[find(k - 1, kept[k] % width ** (k - 1))]
                p[rows] = np.where(c > 0, c / np.maximum(m + d, 1), np.where(m > 0, d / np.maximum(m + d, 1), 1.0) * below)
            cost[:, :, j] = -np.log2(p)
        self.cost = cost.reshape(total * width, len(names))
        self.single = find(1, np.arange(width)).astype(np.int32)
        size = len(pairs) + 1
        self.n_pairs = size
        values = np.concatenate(([0], pairs))
        self.node = np.empty(size * size, np.int32)
        for older in range(size):  # the pair before the last: unknown ones leave order 2
            row = find(4, values[older] * width**2 + values) if older else find(2, values.copy())
            self.node[older * size : (older + 1) * size] = row
        self.triple = np.concatenate([find(3, s * width**2 + values) for s in range(width)]).astype(np.int32)

    def bits(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Code lengths (texts, languages) of texts at[i]:at[i + 1] of data."""
        out = np.zeros((len(at) - 1, len(self.names)))
        if not len(data):
            return out
        symbols = self.kind[data].astype(np.int32)
        # Every text follows ORDER symbols 0, as in training.
        place = np.arange(len(data)) + ORDER * (1 + np.repeat(np.arange(len(at) - 1), np.diff(at)))
        padded = np.zeros(len(data) + ORDER * len(at), np.int32)
        padded[place] = symbols
        pair = np.zeros(len(padded), np.int32)
        pair[1:] = self.pair[padded[:-1] * self.width + padded[1:]]
        newer = pair[place - 1]
        older = pair[place - 3]
        node = self.node[older * self.n_pairs + newer]
        rare = np.flatnonzero(older == 0)
        node[rare] = self.triple[padded[place[rare] - 3] * self.n_pairs + newer[rare]]
        rare = np.flatnonzero(newer == 0)
        node[rare] = self.single[padded[place[rare] - 1]]
        rows = self.cost[node * self.width + symbols]
        some = np.flatnonzero(np.diff(at) > 0)
        out[some] = np.add.reduceat(rows, at[some], axis=0, dtype=np.float64)
        return out

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score of each text of a string column."""
        data, at = buffers(column)
        bits = self.bits(data, at)
        best = bits.argmin(1) if len(self.names) else np.zeros(len(at) - 1, int)
        score = 1 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1) if len(self.names) else np.zeros(len(at) - 1)
        letter = np.concatenate(([0], np.cumsum(((data | 32) >= 97) & ((data | 32) <= 122))))
        lettered = letter[at[1:]] > letter[at[:-1]]
        for i in np.flatnonzero(~lettered & (np.diff(at) > 0)):
            lettered[i] = any(c.isalpha() for c in column[int(i)].as_py())
        lettered &= bool(self.names)
        return [self.names[b] if ok else "und" for b, ok in zip(best, lettered, strict=True)], np.where(lettered, score, 0.0)


def train(labelled: DataFrame, key: str, text: str, lang: str, max_docs: int = 500, max_bytes: int = 8 << 20, max_langs: int = 64, total_bytes: int = 32 << 20) -> PPMModel:
    """A model from a hash sample of labelled texts: of each language about max_docs texts and max_bytes at most, of all total_bytes.

    Of a text above an eighth of a language's bytes the first that many are trained on (in whole characters), so that the
    sample keeps near its bounds.  More than max_langs languages are an error.
    """
    usable = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = {r[0]: r[1:] for r in usable.groupBy(lang).agg(F.count(F.lit(1)), F.sum(F.least(F.octet_length(text), F.lit(max_bytes // 8)).cast("long"))).limit(max_langs + 1).collect()}
    if len(counts) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    max_bytes = min(max_bytes, total_bytes // max(len(counts), 1))
    chance, most = F.lit(0.0), max_bytes // 8
    said = F.when(F.octet_length(text) <= most, F.col(text)).otherwise(F.substring(text, 1, most // 4))
    for name, (n, total) in counts.items():
        chance = F.when(F.col(lang) == name, F.lit(min(1.0, max_docs / n, max_bytes / max(total, 1)))).otherwise(chance)
    sample = usable.filter(F.pmod(F.xxhash64(F.col(key), F.lit(11)), F.lit(1_000_000)) < chance * 1_000_000).select(F.col(lang).alias("lang"), said.alias("text"))
    texts: dict[str, list[bytes]] = {}
    for name, words in sorted(sample.collect()):
        texts.setdefault(name, []).append(words.encode())
    model = PPMModel(texts)
    del texts
    release()
    return model


def identify(docs: DataFrame, model: PPMModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred, score for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # TABLE bytes at most, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 1, BATCH):
                names, score = shared.value.predict(batch.column(1))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score)], ["k", "lang_pred", "score"])

    kind = docs.schema[key].dataType.simpleString()
    return arrow_map(docs.select(key, text), run, f"k {kind}, lang_pred string, score double").withColumnRenamed("k", key)


def keep_identified(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """docs whose language is told; texts without a letter (`und`) go.  All columns stay as they were."""
    model = train(docs.filter(crc_mod(key, 4) != 2), key, text, lang)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, at, BATCH):
                names, _ = shared.value.predict(batch.column(at))
                yield batch.filter(pa.array([n != "und" for n in names], pa.bool_()))

    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # whatever characters the names have
    return arrow_map(plain, run, plain.schema).toDF(*docs.columns)


def op2_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs.filter(crc_mod("doc_id", 4) != 2), "doc_id", "text", "lang")
    out = identify(docs, model)
    return out.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")

"""Quality classification from positives and unlabelled text (PU learning).

Trusted positives (label 1) and unlabelled documents train a scorer on features of the text.  With class prior pi the
risk is pi * E+[loss(g)] + max(0, E?[loss(-g)] - pi * E+[loss(-g)]): the second term estimates the risk on negatives
without any of them and is kept from going below zero (the non-negative unbiased estimator); while it is below, a step
is taken against it.  The prior is estimated from positives and unlabelled rows alone (rows with label 0 are never
read): a separator of the two ranks held-out halves, and the smallest ratio of the unlabelled share to the positive
share above a threshold, with its sampling error, tells how much of the unlabelled looks like positives.

A text is looked at twice, each time by a logistic scorer with a prior of its own.  `writing` has the shares of byte
classes, figures of words and lines, and the wording; `wording` has only what letters tell: hashed words and trigrams
without marks and capitals, put on the directions in which unlabelled texts differ most, and the figures of words that
hang on letters alone.  The score is the smaller of the two: bad in either respect is bad.

Training takes bounded samples, chosen by a hash of the key: the directions from max_wording rows with a thousand hashed
counts each, the scorers from max_positive and max_unlabelled rows with some forty numbers each, all in the driver.
Scoring is one pass over whole texts without a shuffle.

Defined results: null and empty texts are scored by their (zero) features; without positives the prior is the score;
rows that repeat a doc_id are scored one by one; several labels of one doc_id count once as positive if any is 1; with
fewer than four rows of either kind the prior is one half.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import IS_SPACE, arrow_map, buffers, crc_mod, lowered, mixed, pieces, prefix_hash, range_hash, word_bounds

PART = 1 << 20
#: Byte classes whose shares of a text are features.
CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "blank": (32, 9), "line": (10, 13), "high": range(128, 256),
    "bang": b"!", "bar": b"|", "mark": b"#$%&*@^~=+<>", "stop": b".?", "comma": b",;:", "bracket": b"()[]{}", "quote": b"\"'`", "dash": b"-_/\\", "control": (*range(9), 11, 12, *range(14, 32), 127),
}
CLASS_OF = np.zeros(256, np.int64)
for _i, _bytes in enumerate(CLASSES.values()):
    CLASS_OF[list(_bytes)] = _i
SHAPES = len(CLASSES) + 17
#: Of the shape features, those of words that marks, capitals and line breaks leave as they are.
OF_WORDS = [len(CLASSES) + i for i in (1, 2, 3, 4, 8, 9, 10, 11, 16)]
#: Buckets for words and as many for trigrams; bytes that count as letters or part words.
BUCKETS = 512
LETTERS = IS_SPACE.copy()
LETTERS[97:123] = LETTERS[128:] = True


class Separator:
    """Ridge least squares between two samples on standardised features and their squares, to rank rows."""

    def __init__(self, positive: np.ndarray, unlabelled: np.ndarray, ridge: float = 1.0):
        pool = np.concatenate((positive, unlabelled))
        self.centre, self.scale = pool.mean(0), pool.std(0) + 1e-3
        x = self._terms(pool)
        y = np.concatenate((np.full(len(positive), 1 / len(positive)), np.full(len(unlabelled), -1 / len(unlabelled)))) * len(pool)
        self.weights = np.linalg.solve(x.T @ x + ridge * np.eye(x.shape[1]), x.T @ y)

    def _terms(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -5, 5).astype(np.float64)
        return np.concatenate((z, z**2, np.ones((len(z), 1))), 1)

    def rank(self, x: np.ndarray) -> np.ndarray:
        return self._terms(x) @ self.weights


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 3, least: float = 0.02, most: float = 0.98) -> float:
    """Share of positives in the unlabelled sample, by the best threshold on held-out halves; between least and most."""
    if len(positive) < 4 or len(unlabelled) < 4:
        return 0.5
    rng = np.random.default_rng(seed)
    p, u = positive[rng.permutation(len(positive))], unlabelled[rng.permutation(len(unlabelled))]
    by = Separator(p[::2], u[::2])
    p, u = np.sort(by.rank(p[1::2])), np.sort(by.rank(u[1::2]))
    above_p = 1 - np.arange(len(p)) / len(p)
    above_u = 1 - np.searchsorted(u, p, "left") / len(u)
    error = 1.01 * (np.sqrt(np.log(40) / 2 / len(p)) + np.sqrt(np.log(40) / 2 / len(u)))
    best = int(np.argmin((above_u + error) / above_p))
    return float(np.clip(above_u[best] / above_p[best], least, most))


def _repeats(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct items and the count of the most frequent one, for each text."""
    distinct, most = np.zeros(len(at) - 1), np.zeros(len(at) - 1)
    for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        if b > a:
            own = np.sort(hashes[a:b])
            edge = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1], [True])))
            distinct[i], most[i] = len(edge) - 1, np.diff(edge).max()
    return distinct, most


def features(column: pa.Array) -> np.ndarray:
    """(texts, features) of a string column."""
    data, at = buffers(column)
    n = len(at) - 1
    size = np.diff(at)
    row = np.repeat(np.arange(n), size)
    share = np.bincount(row * len(CLASSES) + CLASS_OF[data], minlength=n * len(CLASSES)).reshape(n, -1) / np.maximum(size, 1)[:, None]
    prefix = prefix_hash(lowered(data))
    start, end, word_at = word_bounds(data, at)
    words = range_hash(prefix, start, end) if len(start) else np.zeros(0, np.uint64)
    counts = np.diff(word_at)
    owner = np.repeat(np.arange(n), counts)
    per = lambda x: np.bincount(owner, x, minlength=n) / np.maximum(counts, 1)
    length = (end - start).astype(float)
    same = np.zeros(len(words))
    if len(words):
        same[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    last = data[np.maximum(end - 1, 0)] if len(end) else np.zeros(0, np.uint8)
    loud = (data[start] >= 65) & (data[start] <= 90) & (data[np.minimum(start + 1, np.maximum(end - 1, 0))] <= 90) & (length > 1) if len(start) else same
    distinct, most = _repeats(words, word_at)
    breaks = data == 10
    line_start = np.flatnonzero(np.concatenate(([True], breaks[:-1])) | np.isin(np.arange(len(data)), at[:-1])) if len(data) else np.zeros(0, np.int64)
    line_end = np.append(line_start[1:], len(data))
    line_at = np.searchsorted(line_start, at)
    lines = np.diff(line_at)
    line_distinct, line_most = _repeats(range_hash(prefix, line_start, line_end) if len(line_start) else words[:0], line_at)
    mean = per(length)
    some = np.maximum(counts, 1)
    columns = [
        np.log1p(size), np.log1p(counts), mean, np.sqrt(np.maximum(per(length**2) - mean**2, 0)), per(same), per(loud.astype(float)), per(np.isin(last, list(b"!#$%&*|")).astype(float)),
        per((last == 46).astype(float)), per((length == 1).astype(float)), per((length > 16).astype(float)), distinct / some, most / some, np.log1p(lines), np.log1p(counts / np.maximum(lines, 1)),
        line_distinct / np.maximum(lines, 1), line_most / np.maximum(lines, 1), np.log1p(most),
    ]
    return np.concatenate((share, np.stack(columns, 1)), 1).astype(np.float32)


def _shares(bucket: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Square roots of the shares of buckets in each row."""
    counts = np.bincount(row * BUCKETS + bucket, minlength=n * BUCKETS).reshape(n, BUCKETS)
    return np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1)).astype(np.float32)


def wording(column: pa.Array) -> np.ndarray:
    """(texts, 2 * BUCKETS) of a string column: hashed words and trigrams of its letters in lower case."""
    data, at = buffers(column)
    n, low = len(at) - 1, lowered(data)
    kept = LETTERS[low]
    at = np.concatenate(([0], np.cumsum(kept)))[at]
    low = low[kept]
    start, end, word_at = word_bounds(low, at)
    words = range_hash(prefix_hash(low), start, end) if len(start) else np.zeros(0, np.uint64)
    code, row = np.where(IS_SPACE[low], 32, low).astype(np.uint64), np.repeat(np.arange(n), np.diff(at))
    three = code[:-2] | code[1:-1] << np.uint64(8) | code[2:] << np.uint64(16) if len(low) > 2 else code[:0]
    inside = row[: len(three)] == row[len(row) - len(three) :]
    bucket = lambda h: (h % np.uint64(BUCKETS)).astype(np.int64)
    return np.concatenate((_shares(bucket(words), np.repeat(np.arange(n), np.diff(word_at)), n), _shares(bucket(mixed(three[inside])), row[: len(three)][inside], n)), 1)


class Directions:
    """The `size` directions in which rows of wording differ most, after scaling (rare buckets count less)."""

    def __init__(self, rows: np.ndarray, size: int = 8):
        rows = rows if len(rows) else np.zeros((1, 2 * BUCKETS), np.float32)
        self.centre, spread = rows.mean(0), rows.std(0)
        self.scale = spread + 0.2 * spread.mean() + 1e-6
        x = (rows - self.centre) / self.scale
        self.axes = np.linalg.eigh(x.T @ x / len(x))[1][:, : -size - 1 : -1]

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        return np.clip((rows - self.centre) / self.scale @ self.axes, -50, 50).astype(np.float32)

    def described(self, column: pa.Array) -> np.ndarray:
        """(texts, SHAPES + size): shape features and wording along the directions."""
        return np.concatenate((features(column), self(wording(column))), 1)


def risk_slope(p: np.ndarray, u: np.ndarray, prior: float) -> np.ndarray:
    """Slope of the non-negative risk by the scorer's output, of minus the negatives' risk where that is below zero.

    p, u: probabilities of positives and unlabelled rows, whose slopes come end to end.  loss(g) = log(1 + exp(-g)): the
    slope of loss(g) is s - 1, that of loss(-g) is s.
    """
    negative = -np.log1p(-u + 1e-12).mean() + prior * np.log1p(-p + 1e-12).mean()
    slope = np.concatenate((-prior * p / len(p), u / len(u)))
    if negative < 0:
        return -slope
    slope[: len(p)] += prior * (p - 1) / len(p)
    return slope


class Adam:
    """Steps down a slope, shorter and shorter."""

    def __init__(self, weights: list[np.ndarray], rate: float, steps: int):
        self.rate, self.steps, self.t = rate, steps, 0
        self.first, self.second = ([np.zeros_like(w) for w in weights] for _ in range(2))

    def step(self, weights: list[np.ndarray], grads: list[np.ndarray]) -> None:
        self.t += 1
        rate = self.rate * (1 - self.t / (self.steps + 1))
        for i, g in enumerate(grads):
            self.first[i] = 0.9 * self.first[i] + 0.1 * g
            self.second[i] = 0.999 * self.second[i] + 0.001 * g * g
            weights[i] = weights[i] - rate * (self.first[i] / (1 - 0.9**self.t)) / (np.sqrt(self.second[i] / (1 - 0.999**self.t)) + 1e-8)


class PULogistic:
    """A logistic scorer on standardised features and their squares, trained on all rows at once."""

    def __init__(self, positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 1e-4):
        self.prior = prior
        pool = unlabelled if len(unlabelled) else positive
        width = positive.shape[1]
        self.centre = pool.mean(0) if len(pool) else np.zeros(width, np.float32)
        self.scale = pool.std(0) + 1e-3 if len(pool) else np.ones(width, np.float32)
        self.weights = [np.zeros(2 * width), np.array(np.log(prior / (1 - prior)))]
        if not len(positive) or not len(unlabelled):
            return
        p, u = self._terms(positive), self._terms(unlabelled)
        down = Adam(self.weights, rate, steps)
        for _ in range(steps):
            slope = risk_slope(self._chance(p), self._chance(u), prior)
            by_term = p.T @ slope[: len(p)].astype(np.float32) + u.T @ slope[len(p) :].astype(np.float32)
            down.step(self.weights, [by_term + decay * self.weights[0], slope.sum()])

    def _terms(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -5, 5)
        return np.concatenate((z, z**2 - 1), 1).astype(np.float32)

    def _chance(self, terms: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(terms @ self.weights[0] + self.weights[1], -500, 500)))

    def score(self, x: np.ndarray) -> np.ndarray:
        return self._chance(self._terms(x))


class PUModel:
    """A network of one hidden layer, trained with the non-negative risk."""

    def __init__(self, positive: np.ndarray, unlabelled: np.ndarray, prior: float, hidden: int = 16, steps: int = 2500, batch: int = 2048, rate: float = 6e-3, decay: float = 1e-4, seed: int = 5):
        self.prior = prior
        pool = unlabelled if len(unlabelled) else positive
        width = positive.shape[1]
        self.centre = pool.mean(0) if len(pool) else np.zeros(width, np.float32)
        self.scale = pool.std(0) + 1e-3 if len(pool) else np.ones(width, np.float32)
        rng = np.random.default_rng(seed)
        self.weights = [rng.normal(0, width**-0.5, (width, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.array(np.log(prior / (1 - prior)))]
        if not len(positive) or not len(unlabelled):
            self.weights[2][:] = 0
            return
        p, u = self._scaled(positive), self._scaled(unlabelled)
        down = Adam(self.weights, rate, steps)
        for _ in range(steps):
            grads = self.gradient(p[rng.integers(len(p), size=batch)], u[rng.integers(len(u), size=batch)])
            down.step(self.weights, [g + decay * w for g, w in zip(grads, self.weights, strict=True)])

    def gradient(self, p: np.ndarray, u: np.ndarray) -> list[np.ndarray]:
        """Of the risk by the weights, on scaled rows."""
        x = np.concatenate((p, u))
        h = np.tanh(x @ self.weights[0] + self.weights[1])
        s = 1 / (1 + np.exp(-(h @ self.weights[2] + self.weights[3])))
        slope = risk_slope(s[: len(p)], s[len(p) :], self.prior)
        back = np.outer(slope, self.weights[2]) * (1 - h**2)
        return [x.T @ back, back.sum(0), h.T @ slope, slope.sum()]

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.scale, -8, 8)

    def score(self, x: np.ndarray) -> np.ndarray:
        h = np.tanh(self._scaled(x) @ self.weights[0] + self.weights[1])
        return 1 / (1 + np.exp(-(h @ self.weights[2] + self.weights[3])))


class TwoViews:
    """Scorers of writing and of wording over described texts; the smaller score counts."""

    def __init__(self, directions: Directions, positive: np.ndarray, unlabelled: np.ndarray):
        self.directions = directions
        width = SHAPES + directions.axes.shape[1]
        self.views = [list(range(width)), [*OF_WORDS, *range(SHAPES, width)]]
        self.scorers = [PULogistic(positive[:, v], unlabelled[:, v], estimated_prior(positive[:, v], unlabelled[:, v])) for v in self.views]

    def score(self, column: pa.Array) -> np.ndarray:
        x = self.directions.described(column)
        return np.minimum.reduce([s.score(x[:, v]) for s, v in zip(self.scorers, self.views, strict=True)])


def _collected(docs: DataFrame, text: str, told, width: int) -> np.ndarray:
    """What told() says of the texts of a bounded sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 0, PART):
                rows = np.ascontiguousarray(told(batch.column(0)), np.float32)
                yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.list_(pa.float32()))], ["x"])

    rows = arrow_map(docs.select(text), run, "x array<float>").toArrow().column("x")
    return np.array(rows.combine_chunks().flatten()).reshape(-1, width) if len(rows) else np.zeros((0, width), np.float32)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", max_positive: int = 6000, max_unlabelled: int = 12000, max_wording: int = 3000) -> TwoViews:
    """A model from hash samples of about max_positive rows with label 1 and max_unlabelled documents, its directions from max_wording."""
    chosen = lambda seed, most, n: F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 30)) < F.lit(int(min(1.0, most / max(n, 1)) * (1 << 30)))
    trusted = labels.filter(F.col(label) == 1)
    ids = trusted.filter(chosen(1, max_positive, trusted.count())).select(key).distinct()
    n = docs.select(key).count()
    directions = Directions(_collected(docs.filter(chosen(3, max_wording, n)), text, wording, 2 * BUCKETS))
    width = SHAPES + directions.axes.shape[1]
    positive = _collected(docs.join(F.broadcast(ids), key), text, directions.described, width)  # about max_positive ids
    unlabelled = _collected(docs.filter(chosen(2, max_unlabelled, n)), text, directions.described, width)
    return TwoViews(directions, positive, unlabelled)


def quality(docs: DataFrame, model: TwoViews, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 1, PART):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(batch.column(1)), pa.float64())], ["k", "score"])

    kind = docs.schema[key].dataType.simpleString()
    return arrow_map(docs.select(key, text), run, f"k {kind}, score double").withColumnRenamed("k", key)


def op7_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    learn = crc_mod("doc_id", 5) != 0
    model = train(docs.filter(learn), labels.filter(learn))
    return quality(docs, model).select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))

"""SentencePiece encoding and decoding by suffix-array matching, for byte-pair models with byte fallback.

A part of a record batch is encoded at once.  Its texts are cut where a space follows something else (no piece of the
model reaches across such a place; a model with one that does is refused), and equal cuts are indexed once.  Over
their concatenation a suffix array is sorted eight bytes at a time, to the depth the pieces need; a binary search of
every piece gives its range of occurrences.  Each occurrence is an edge from its start to its end; the edges are
sorted by position and relaxed from left to right.

Relaxing keeps, for every position, the one piece that ends there in the encoding of the cut's prefix: an edge is
taken if its piece may follow the piece that ends where it starts.  Two pieces may follow each other if merging their
bytes by the model's ranks gives these two again, that is, if no merge across the border comes before the merges that
build them.  An encoding is right exactly if all its neighbours are, so this gives the pieces that merging gives.
Characters that the model lacks become an edge of their own, written as byte pieces.

Decoding is the way back: pieces to bytes, byte pieces to their byte, the added leading space off.

Defined results: null and empty texts have no ids; runs of spaces, unknown characters, control characters and very
long texts (a text is a part of its own if it is longer than PART) encode as any other; rows are independent.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .shared import arrow_map, buffers, pieces, prefix_hash, range_hash, spans

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
PART = 1 << 19
SPACE = "▁"
NONE = np.iinfo(np.int64).max


def merged(symbols: list[bytes], rank: dict[bytes, int]) -> list[bytes]:
    """Byte-pair merging: again and again the pair of best rank, the first of equals.  A small helper for single pieces and runs of spaces."""
    symbols = list(symbols)
    while len(symbols) > 1:
        best = min(range(len(symbols) - 1), key=lambda i: (rank.get(symbols[i] + symbols[i + 1], NONE), i))
        if symbols[best] + symbols[best + 1] not in rank:
            break
        symbols[best : best + 2] = [symbols[best] + symbols[best + 1]]
    return symbols


class PieceModel:
    """The tables of a model: piece bytes (a space for the space sign), what may follow what."""

    def __init__(self, file: bytes):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        model.ParseFromString(file)
        norm = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
            raise ValueError("only byte-pair models with byte fallback, identity normaliser and leading space")
        self.text = [b""] * len(model.pieces)
        self.byte_id = np.zeros(256, np.int64)
        score: dict[bytes, tuple[float, int]] = {}
        for i, p in enumerate(model.pieces):
            if p.type == 1:
                self.text[i] = p.piece.replace(SPACE, " ").encode()
                score[self.text[i]] = (-p.score, i)
            elif p.type == 6:
                byte = int(p.piece[3:5], 16)
                self.byte_id[byte], self.text[i] = i, bytes([byte])
        if any(b" " in p.lstrip(b" ") for p in score):
            raise ValueError("a piece reaches across a word's start")
        levels = {s: r for r, s in enumerate(sorted({s for s, _ in score.values()}))}
        #: Ranks of merges (low first); equal scores have equal ranks.  Single characters exist from the start.
        self.rank = {p: levels[s] for p, (s, _) in score.items()}
        self.id = {p: i for p, (_, i) in score.items()}
        chars = lambda p: [c.encode() for c in p.decode()]
        if any(c not in self.id for p in self.id for c in chars(p)):
            raise ValueError("a piece has a character that is no piece")
        n = len(self.text)
        self.unknown = n  # stands for one character that is no piece
        #: Pieces that merging gives, but runs of spaces; runs are merged one by one, in runs().
        left, right = np.full(n + 1, -1, np.int64), np.full(n + 1, -1, np.int64)
        when = np.full(n + 1, -1, np.int64)
        usable = []
        for p, i in sorted(self.id.items(), key=lambda x: len(x[0])):
            if len(p) > 1 and not p.strip(b" "):
                continue
            parts = chars(p)
            if len(parts) > 1:
                steps = self._last_merge(parts)
                if steps is None:
                    continue
                left[i], right[i], when[i] = self.id[steps[0]], self.id[steps[1]], self.rank[p]
            usable.append(i)
        self.usable = np.array(sorted(usable))
        good = set(usable)
        joins = [(self.id[p[:k]], self.id[p[k:]], i) for p, i in self.id.items() if len(p) > 1 for k in range(1, len(p)) if self.id.get(p[:k]) in good and self.id.get(p[k:]) in good]
        table = np.array(joins, np.int64).reshape(-1, 3)
        key = table[:, 0] * (n + 1) + table[:, 1]
        order = np.argsort(key)
        self.join_key, self.join_rank = key[order], np.array([self.rank[self.text[i]] for i in table[order, 2]], np.int64)
        self.left, self.right, self.when = left, right, when
        size = np.array([len(t) for t in self.text], np.int64)
        self.piece_at = np.concatenate(([0], np.cumsum(size)))
        self.piece_data = np.frombuffer(b"".join(self.text), np.uint8)
        self._prepare_search(size)
        self.known_key, self.known = np.full(1 << 20, -1, np.int64), np.zeros(1 << 20, bool)

    def _last_merge(self, parts: list[bytes]) -> tuple[bytes, bytes] | None:
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: (self.rank.get(parts[i] + parts[i + 1], NONE), i))
            if parts[best] + parts[best + 1] not in self.rank:
                return None
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return tuple(parts)

    def _prepare_search(self, size: np.ndarray) -> None:
        """Pieces as big-endian words of eight bytes, with the highest value that each prefix allows."""
        longest = int(size[self.usable].max() + 7) // 8
        words = np.zeros((len(self.usable), longest * 8), np.uint8)
        for row, i in enumerate(self.usable):
            words[row, : size[i]] = np.frombuffer(self.text[i], np.uint8)
        self.low = words.view(">u8").astype(np.uint64)
        self.size = size
        filled = size[self.usable]
        self.high = self.low.copy()
        for k in range(longest):
            rest = np.clip(filled - 8 * k, 0, 8)
            self.high[:, k] |= np.where(rest < 8, (np.uint64(1) << (8 * (8 - np.minimum(np.maximum(rest, 1), 8))).astype(np.uint64)) - np.uint64(1), np.uint64(0))
        self.depth = (filled + 7) // 8

    def __getstate__(self):
        state = self.__dict__.copy()
        state["known_key"] = state["known"] = None
        return state

    def __setstate__(self, state):
        self.__dict__ |= state
        self.known_key, self.known = np.full(1 << 20, -1, np.int64), np.zeros(1 << 20, bool)

    def follows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether piece b may follow piece a; answers are kept in a table of fixed size."""
        key = a * (self.unknown + 1) + b
        slot = ((key * 0x9E3779B1) >> 7) & (len(self.known_key) - 1)
        new = np.flatnonzero(self.known_key[slot] != key)
        if len(new):
            fresh, inverse = np.unique(key[new], return_inverse=True)
            answer = self._follows(fresh // (self.unknown + 1), fresh % (self.unknown + 1))
            out = self.known[slot]
            out[new] = answer[inverse]
            self.known_key[slot[new]] = key[new]
            self.known[slot[new]] = out[new]
            self.known[slot[new]] = answer[np.searchsorted(fresh, self.known_key[slot[new]])]
            return out
        return self.known[slot]

    def _follows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Walks down the right edge of a's merge tree and the left edge of b's, in step with the merges' order."""
        ok = np.ones(len(a), bool)
        at = np.flatnonzero((a != self.unknown) & (b != self.unknown))
        x, y = a[at].copy(), b[at].copy()
        until_x, until_y = np.full(len(at), NONE), np.full(len(at), NONE)  # when x and y are merged into more
        while len(at):
            key = x * (self.unknown + 1) + y
            place = np.minimum(np.searchsorted(self.join_key, key), len(self.join_key) - 1)
            rank = np.where(self.join_key[place] == key, self.join_rank[place], NONE)
            across = (rank < until_x) & (rank <= until_y) & (rank < NONE)
            ok[at[across]] = False
            later_x = self.when[x] >= self.when[y]
            until_x, until_y = np.where(later_x, self.when[x], until_x), np.where(later_x, until_y, self.when[y])
            x, y = np.where(later_x, self.right[x], x), np.where(later_x, y, self.left[y])
            go = ~across & (x >= 0) & (y >= 0)
            at, x, y, until_x, until_y = at[go], x[go], y[go], until_x[go], until_y[go]
        return ok

    # -- encoding ---------------------------------------------------------------------------------------------------

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts end to end, and the n + 1 offsets."""
        data, at = buffers(pc.replace_substring(column, SPACE, " ") if len(column) else column)
        sizes = np.diff(at)
        lead = (sizes > 0).astype(np.int64)
        new_at = np.concatenate(([0], np.cumsum(sizes + lead)))
        if not new_at[-1]:
            return np.zeros(0, np.int32), np.zeros(len(at), np.int64)
        text = np.full(new_at[-1], 32, np.uint8)
        place = np.ones(new_at[-1], bool)
        place[new_at[:-1][sizes > 0]] = False
        text[place] = data
        space = text == 32
        cut = space.copy()
        cut[1:] &= ~space[:-1]
        cut[new_at[:-1][sizes > 0]] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], len(text))
        _, first, which = np.unique(range_hash(prefix_hash(text), start, end), return_index=True, return_inverse=True)
        ids, id_at = self._encode_cuts(text, start[first], end[first])
        counts = np.diff(id_at)
        out = ids[spans(id_at[which], counts[which])]
        cut_at = np.concatenate(([0], np.cumsum(counts[which])))
        return out.astype(np.int32), cut_at[np.searchsorted(start, new_at)]

    def _encode_cuts(self, text: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        runs = np.flatnonzero((end - start > 1) & (text[np.minimum(start + 1, len(text) - 1)] == 32))
        size = end - start
        # Of a cut with a run of spaces only what follows the run but its last space is indexed: a run is merged on its
        # own, up to where the rest of the cut may take its last spaces; see _runs().
        whole = np.setdiff1d(np.arange(len(start)), runs)
        flat = text[spans(start[whole], size[whole])]
        flat_at = np.concatenate(([0], np.cumsum(size[whole])))
        ids, id_at = self._relax(flat, flat_at)
        if not len(runs):
            return ids, id_at
        parts = {int(w): ids[id_at[j] : id_at[j + 1]] for j, w in enumerate(whole)} if len(runs) else {}
        for r in runs:
            parts[int(r)] = self._run(text[start[r] : end[r]].tobytes())
        ordered = [parts[i] for i in range(len(start))]
        return np.concatenate(ordered), np.concatenate(([0], np.cumsum([len(p) for p in ordered])))

    def _run(self, cut: bytes) -> np.ndarray:
        """A cut that begins with several spaces, by merging."""
        head = len(cut) - len(cut.lstrip(b" "))
        symbols = merged_fast([b" "] * head + [c.encode() for c in cut[head:].decode()], self.rank)
        out: list[int] = []
        for s in symbols:
            out += [self.id[s]] if s in self.id else [int(self.byte_id[b]) for b in s]
        return np.array(out, np.int64)

    def _occurrences(self, flat: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and piece ids of all occurrences of the usable pieces; room: bytes to the cut's end."""
        n = len(flat)
        padded = np.concatenate((flat, np.zeros(16, np.uint8)))
        words = np.empty(n + 8, np.uint64)
        for r in range(8):
            part = padded[r : r + (n + 8 - r + 7) // 8 * 8]
            words[r::8] = part[: len(part) // 8 * 8].view(">u8")[: len(words[r::8])]
        words = words[:n]
        short = room < 8
        words[short] &= ~((np.uint64(1) << (8 * (8 - room[short])).astype(np.uint64)) - np.uint64(1))
        order = np.argsort(words)
        level = words[order]
        low = np.searchsorted(level, self.low[:, 0], "left")
        high = np.searchsorted(level, self.high[:, 0], "right")
        at_level = np.zeros(n, np.uint64)
        for k in range(1, self.low.shape[1]):
            deep = np.flatnonzero(self.depth > k)
            deep = deep[low[deep] < high[deep]]
            if not len(deep):
                break
            segments = np.unique(low[deep], return_index=True)[1]
            lo, count = low[deep[segments]], (high - low)[deep[segments]]
            rows = spans(lo, count)
            suffix = order[rows]
            inside = room[suffix] > 8 * k
            value = np.zeros(len(rows), np.uint64)
            value[inside] = words[suffix[inside] + 8 * k]
            again = np.lexsort((value, np.repeat(np.arange(len(lo)), count)))
            order[rows], at_level[rows] = suffix[again], value[again]
            lo, hi = low[deep].copy(), high[deep].copy()
            low[deep] = bounded_search(at_level, lo, hi, self.low[deep, k], False)
            high[deep] = bounded_search(at_level, lo, hi, self.high[deep, k], True)
        count = np.maximum(high - low, 0)
        return order[spans(low, count)], np.repeat(self.usable, count)

    def _relax(self, flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(flat)
        if not n:
            return np.zeros(0, np.int64), np.zeros(len(at), np.int64)
        begin = np.repeat(at[:-1], np.diff(at))
        room = np.repeat(at[1:], np.diff(at)) - np.arange(n)
        start, piece = self._occurrences(flat, room)
        size = self.size[piece]
        fits = size <= room[start]
        start, piece, size = start[fits], piece[fits], size[fits]
        head = (flat & 0xC0) != 0x80
        known = np.zeros(n, bool)
        one = (np.diff(np.append(np.flatnonzero(head), n)))
        char = np.zeros(n, np.int64)
        char[head] = one
        known[start[size == char[start]]] = True
        missing = np.flatnonzero(head & ~known)
        start = np.concatenate((start, missing))
        piece = np.concatenate((piece, np.full(len(missing), self.unknown)))
        size = np.concatenate((size, char[missing]))
        offset = start - begin[start]
        order = np.argsort(offset, kind="stable")
        start, piece, size, offset = start[order], piece[order], size[order], offset[order]
        ending = np.full(n + 1, -1, np.int32)  # the piece that ends before this place
        groups = np.flatnonzero(np.diff(offset, prepend=-1))
        for a, b in zip(groups, np.append(groups[1:], len(offset)), strict=True):
            s, p, e = start[a:b], piece[a:b], start[a:b] + size[a:b]
            if offset[a]:
                last = ending[s].astype(np.int64)
                take = last >= 0
                take[take] = self.follows(last[take], p[take])
                ending[e[take]] = p[take]
            else:
                ending[e] = p
        # Walk back from the ends of all cuts together.
        size_of = np.append(self.size, 0)
        place, floor = at[1:].copy(), at[:-1]
        live = np.flatnonzero(place > floor)
        taken_cut, taken_end, taken_piece = [], [], []
        while len(live):
            here = place[live]
            p = ending[here].astype(np.int64)
            step = size_of[p]
            odd = np.flatnonzero(p == self.unknown)
            step[odd] = [1 if head[h - 1] else 2 if head[h - 2] else 3 if head[h - 3] else 4 for h in here[odd]]
            taken_cut.append(live)
            taken_end.append(here)
            taken_piece.append(p)
            place[live] = here - step
            live = live[place[live] > floor[live]]
        cut, last, got = map(np.concatenate, (taken_cut, taken_end, taken_piece))
        order = np.argsort(last)
        cut, last, got = cut[order], last[order], got[order]
        width = np.ones(len(got), np.int64)
        odd = np.flatnonzero(got == self.unknown)
        before = np.append(0, last)[:-1]
        width[odd] = last[odd] - before[odd]
        ids = np.repeat(got, width)
        if len(odd):
            out_at = np.cumsum(width) - width
            ids[spans(out_at[odd], width[odd])] = self.byte_id[flat[spans(before[odd], width[odd])]]
        counts = np.bincount(cut, width, minlength=len(at) - 1).astype(np.int64)
        return ids, np.concatenate(([0], np.cumsum(counts)))

    # -- decoding ---------------------------------------------------------------------------------------------------

    def decode(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the texts with ids at[i]:at[i + 1], and their offsets; control pieces are nothing."""
        ids = ids.astype(np.int64)
        size = self.size[ids]
        data = self.piece_data[spans(self.piece_at[ids], size)]
        ends = np.concatenate(([0], np.cumsum(size)))
        out_at = ends[at]
        lead = np.flatnonzero((np.diff(out_at) > 0) & (data[np.minimum(out_at[:-1], max(0, len(data) - 1))] == 32) if len(data) else np.zeros(len(at) - 1, bool))
        keep = np.ones(len(data), bool)
        keep[out_at[lead]] = False
        less = np.zeros(len(at), np.int64)
        less[lead + 1] = 1
        return data[keep], out_at - np.cumsum(less)


def merged_fast(symbols: list[bytes], rank: dict[bytes, int]) -> list[bytes]:
    """merged() for long runs: a heap of pairs over a linked list."""
    import heapq

    n = len(symbols)
    nxt, prv, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    value = list(symbols)
    heap = [(rank[value[i] + value[i + 1]], i, value[i], value[i + 1]) for i in range(n - 1) if value[i] + value[i + 1] in rank]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = nxt[i]
        if not alive[i] or value[i] != a or j >= n or value[j] != b:
            continue
        value[i], alive[j], nxt[i] = a + b, False, nxt[j]
        if nxt[j] < n:
            prv[nxt[j]] = i
        for left, right in ((prv[i], i), (i, nxt[i])):
            if left >= 0 and right < n and value[left] + value[right] in rank:
                heapq.heappush(heap, (rank[value[left] + value[right]], left, value[left], value[right]))
    return [v for v, ok in zip(value, alive, strict=True) if ok]


def bounded_search(values: np.ndarray, low: np.ndarray, high: np.ndarray, key: np.ndarray, after: bool) -> np.ndarray:
    """For each row the place of key in values[low:high], which is sorted: before equals, or after them."""
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        mid = (low + high) // 2
        v = values[np.minimum(mid, len(values) - 1)]
        up = open_ & ((v <= key) if after else (v < key))
        low, high = np.where(up, mid + 1, low), np.where(open_ & ~up, mid, high)
    return low


def load(spark: SparkSession, path: str = MODEL) -> PieceModel:
    """The model at path, which the driver alone reads."""
    with open(path, "rb") as f:
        return PieceModel(f.read())


def encode(docs: DataFrame, model: PieceModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids (array of int)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 1, PART):
                ids, at = shared.value.encode(batch.column(1))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids))], ["k", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return arrow_map(docs.select(key, text), run, f"k {kind}, ids array<int>").withColumnRenamed("k", key)


def decode(encoded: DataFrame, model: PieceModel, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key, text; null ids give the empty text.  Bytes that are no UTF-8 become U+FFFD."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            data, at = shared.value.decode(lists.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(size, dtype=np.int64))))
            texts = [data[a:b].tobytes().decode(errors="replace") for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["k", "text"])

    kind = encoded.schema[key].dataType.simpleString()
    return arrow_map(encoded.select(key, ids), run, f"k {kind}, text string").withColumnRenamed("k", key)


def token_digests(docs: DataFrame, model: PieceModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_tokens, ids_sha256 (ids as 32-bit little-endian numbers), round_trip (decoding gives the text again)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 1, PART):
                ids, at = shared.value.encode(batch.column(1))
                back, back_at = shared.value.decode(ids, at)
                data, data_at = buffers(batch.column(1))
                same = [np.array_equal(data[a:b], back[c:d]) for a, b, c, d in zip(data_at[:-1], data_at[1:], back_at[:-1], back_at[1:], strict=True)]
                ids = ids.astype("<i4")
                shas = [hashlib.sha256(ids[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(data_at)), pa.array(np.diff(at)), pa.array(shas, pa.string()), pa.array(same, pa.bool_())], ["k", "n_bytes", "n_tokens", "ids_sha256", "round_trip"])

    kind = docs.schema[key].dataType.simpleString()
    return arrow_map(docs.select(key, text), run, f"k {kind}, n_bytes long, n_tokens long, ids_sha256 string, round_trip boolean").withColumnRenamed("k", key)


def op1_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str = MODEL) -> DataFrame:
    return token_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), load(spark, model_path))

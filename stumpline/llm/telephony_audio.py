"""Telephony audio columns: G.711 mu-law and A-law, and IMA ADPCM, in WAVE files.

`encode_audio` stores payload bytes as the coded samples of a WAVE file (lossless: the file holds them as they are).
`decode_audio` reads the files back: mu-law and A-law expand by 256-entry tables, IMA ADPCM blocks are decoded with
numpy across all blocks of a record batch at once (one step for each sample of a block), and the 16-bit PCM is
resampled to another rate.  `audio_digests` reads stored files the same way and gives digests and features of payload
and PCM instead of the PCM itself.  All of it works on record batches of a bounded number of bytes; no row meets another.

Defined results: null payload counts as empty; empty payload gives a file without samples and empty PCM; repeated rows
give equal values.  Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import arrow_map, buffers, pieces, stored, strings

#: WAVE format tags.
MULAW, ALAW, ADPCM = 7, 6, 0x11
NAMES = {MULAW: "mulaw", ALAW: "alaw", ADPCM: "ima_adpcm"}
BLOCK = 64  # bytes of an ADPCM block: 4 of header, then two samples a byte
#: Fixed values of IMA ADPCM: step index changes by code.
INDEX_CHANGE = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)
BATCH = 4 << 20


def mulaw_table() -> np.ndarray:
    """G.711 mu-law: complemented byte = sign, 3 bits of exponent, 4 of mantissa; bias 132."""
    code = ~np.arange(256) & 255
    size = (((code & 15) << 3) + 132 << ((code >> 4) & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """G.711 A-law: even bits inverted; sign set means positive."""
    code = np.arange(256) ^ 0x55
    exponent, mantissa = (code >> 4) & 7, code & 15
    size = np.where(exponent == 0, (mantissa << 4) + 8, (mantissa << 4) + 264 << np.maximum(exponent - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


def steps() -> np.ndarray:
    """Fixed values of IMA ADPCM: the standard's table of 89 step sizes."""
    fixed = "7 8 9 10 11 12 13 14 16 17 19 21 23 25 28 31 34 37 41 45 50 55 60 66 73 80 88 97 107 118 130 143 157 173 190 209 230 253 279 307 337 371 408 449 494 544 598 658 724 796 876 963 1060 1166 1282 1411 1552 1707 1878 2066 2272 2499 2749 3024 3327 3660 4026 4428 4871 5358 5894 6484 7132 7845 8630 9493 10442 11487 12635 13899 15289 16818 18500 20350 22385 24623 27086 29794 32767"
    return np.array(fixed.split(), np.int32)


MULAW_PCM, ALAW_PCM, STEPS = mulaw_table(), alaw_table(), steps()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """(n, BLOCK) bytes to (n, 2 * (BLOCK - 4) + 1) samples, all blocks side by side."""
    n, width = blocks.shape
    out = np.empty((1 + 2 * (width - 4), n), np.int16)
    value = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    out[0] = value
    for i in range(width - 4):
        byte = blocks[:, 4 + i]
        for half, code in ((0, byte & 15), (1, byte >> 4)):
            step = STEPS[index]
            change = step >> 3
            change += np.where(code & 4, step, 0)
            change += np.where(code & 2, step >> 1, 0)
            change += np.where(code & 1, step >> 2, 0)
            value += np.where(code & 8, -change, change)
            np.clip(value, -32768, 32767, out=value)
            index += INDEX_CHANGE[code]
            np.clip(index, 0, 88, out=index)
            out[1 + 2 * i + half] = value
    return np.ascontiguousarray(out.T)


def wave(tag: int, rate: int, payload: bytes) -> bytes:
    """A RIFF/WAVE file with a fmt chunk of 20 bytes, a fact chunk and the payload as data."""
    block, per_block = (BLOCK, 1 + 2 * (BLOCK - 4)) if tag == ADPCM else (1, 1)
    samples = len(payload) // block * per_block
    fmt = struct.pack("<HHIIHHHH", tag, 1, rate, rate * block // per_block, block, 4 if tag == ADPCM else 8, 2, per_block)
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, samples) + b"data" + struct.pack("<I", len(payload)) + payload
    return b"RIFF" + struct.pack("<I", len(body)) + body


def parse_wave(file) -> tuple[int, int, int, int]:
    """Format tag, rate, and where the data chunk starts and ends; walks the chunks."""
    if bytes(file[:4]) != b"RIFF" or bytes(file[8:12]) != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, tag, rate = 12, 0, 0
    while at + 8 <= len(file):
        name, size = bytes(file[at : at + 4]), int.from_bytes(bytes(file[at + 4 : at + 8]), "little")
        if name == b"fmt ":
            tag, _, rate = struct.unpack("<HHI", bytes(file[at + 8 : at + 16]))
        elif name == b"data":
            return tag, rate, at + 8, at + 8 + size
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def resampled(pcm: np.ndarray, at: np.ndarray, rate: int, to: int) -> tuple[np.ndarray, np.ndarray]:
    """Clips at[i]:at[i + 1] of pcm at another rate by linear interpolation (the last sample is held)."""
    if rate == to or not len(pcm):
        return pcm, at
    counts = np.diff(at) * to // rate
    new = np.concatenate(([0], np.cumsum(counts)))
    clip = np.repeat(np.arange(len(counts)), counts)
    place = (np.arange(new[-1]) - new[clip]) * (rate / to)
    left = place.astype(np.int64)
    part = (place - left).astype(np.float32)
    left += at[clip]
    right = np.minimum(left + 1, at[clip + 1] - 1)
    low = pcm[left].astype(np.float32)
    return np.rint(low + (pcm[right] - low) * part).astype(np.int16), new


def expand(tags: np.ndarray, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coded clips at[i]:at[i + 1] of data, each with its format tag, to PCM clips."""
    sizes = np.diff(at)
    counts = np.where(tags == ADPCM, sizes // BLOCK * (1 + 2 * (BLOCK - 4)), sizes)
    out_at = np.concatenate(([0], np.cumsum(counts)))
    out = np.empty(out_at[-1], np.int16)
    for tag, table in ((MULAW, MULAW_PCM), (ALAW, ALAW_PCM)):
        for i in np.flatnonzero(tags == tag):
            table.take(data[at[i] : at[i + 1]], out=out[out_at[i] : out_at[i + 1]])
    coded = np.flatnonzero(tags == ADPCM)
    if len(coded):
        blocks = np.concatenate([data[at[i] : at[i] + sizes[i] // BLOCK * BLOCK] for i in coded]).reshape(-1, BLOCK)
        samples, done = decode_adpcm(blocks).reshape(-1), 0
        for i in coded:
            out[out_at[i] : out_at[i + 1]] = samples[done : done + counts[i]]
            done += counts[i]
    return out, out_at


def encode_audio(df: DataFrame, keys: str | list[str], payload: str, tag: int | str = MULAW, rate: int = 8000) -> DataFrame:
    """keys, media: a WAVE file that holds the payload (binary or string) as its coded samples.

    tag: a format for all rows, or the name of a column of formats.
    """
    keys = [keys] if isinstance(keys, str) else keys

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 1, BATCH):
                data, at = buffers(batch.column(1))
                files = [wave(t, rate, data[a:b].tobytes()) for t, a, b in zip(batch.column(0).to_pylist(), at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(files, pa.binary())], [*whole.schema.names[2:], "media"])

    own = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    code = F.col(tag) if isinstance(tag, str) else F.lit(tag)
    return arrow_map(df.select(code.cast("int").alias("__tag"), F.col(payload).alias("__payload"), *keys), run, f"{own}, media binary")


def decode_audio(df: DataFrame, key: str, media: str, to: int = 16000) -> DataFrame:
    """key, codec, rate, pcm: 16-bit little-endian samples at rate `to`, from the WAVE files in `media`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 1, BATCH):
                tags, pcm, at = _read(*buffers(batch.column(1)), to)
                rows = pa.array([NAMES.get(t, "") for t in tags], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0), rows, pa.array(np.full(len(tags), to, np.int32)), strings(pcm.view(np.uint8), at * 2)], ["key", "codec", "rate", "pcm"])

    kind = df.schema[key].dataType.simpleString()
    return arrow_map(df.select(key, media), run, f"key {kind}, codec string, rate int, pcm binary").withColumnRenamed("key", key)


def _read(data: np.ndarray, at: np.ndarray, to: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Files at[i]:at[i + 1] to format tags and resampled clips; a null (empty) file gives no samples and tag 0."""
    heads = [parse_wave(data[a:b]) if b > a else (0, to, 0, 0) for a, b in zip(at[:-1], at[1:], strict=True)]
    tags = np.array([h[0] for h in heads], np.int64)
    coded = [data[a + h[2] : a + h[3]] for a, h in zip(at[:-1], heads, strict=True)]
    clip_at = np.concatenate(([0], np.cumsum([len(x) for x in coded], dtype=np.int64)))
    pcm, pcm_at = expand(tags, np.concatenate(coded) if coded else np.zeros(0, np.uint8), clip_at)
    rates = {h[1] for h in heads}
    if rates <= {to}:
        return tags, pcm, pcm_at
    if len(rates) == 1:
        return tags, *resampled(pcm, pcm_at, rates.pop(), to)
    clips = [resampled(pcm[a:b], np.array([0, b - a]), h[1], to)[0] for a, b, h in zip(pcm_at[:-1], pcm_at[1:], heads, strict=True)]
    return tags, np.concatenate(clips), np.concatenate(([0], np.cumsum([len(c) for c in clips], dtype=np.int64)))


def features(pcm: np.ndarray, at: np.ndarray) -> list[str]:
    """For each clip: samples, peak, RMS and zero crossings."""
    counts = np.diff(at)
    some = np.flatnonzero(counts)
    peak, power, cross = (np.zeros(len(counts), np.int64) for _ in range(3))
    if len(some):
        wide = pcm.astype(np.int32)
        peak[some] = np.maximum.reduceat(np.abs(wide), at[some])
        square = np.concatenate(([0], np.cumsum(wide.astype(np.int64) ** 2)))
        power = square[at[1:]] - square[at[:-1]]
        flips = np.zeros(len(pcm), np.int64)
        flips[1:] = (pcm[1:] < 0) != (pcm[:-1] < 0)
        flips[at[some]] = 0
        total = np.concatenate(([0], np.cumsum(flips)))
        cross = total[at[1:]] - total[at[:-1]]
    return [f"n={n};peak={p};rms={(w / n) ** 0.5 if n else 0:.3f};zc={z}" for n, p, w, z in zip(counts.tolist(), peak.tolist(), power.tolist(), cross.tolist(), strict=True)]


def payloads(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, n_bytes, payload (the text as UTF-8, padded with bytes 0 to a positive multiple of BLOCK) and its format tag.

    The tag (mu-law, A-law or ADPCM) follows from the payload's crc32, so equal texts are coded alike.
    """
    raw = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    size = F.greatest(F.lit(BLOCK), F.ceil(F.length(raw) / BLOCK).cast("int") * BLOCK)
    payload = F.rpad(raw, size, F.unhex(F.lit("00")))
    tag = F.element_at(F.array(*(F.lit(t) for t in (MULAW, ALAW, ADPCM))), (F.crc32(payload) % 3 + 1).cast("int"))
    return docs.select(F.col(key).alias(key), F.length(raw).cast("long").alias("n_bytes"), payload.alias("payload"), tag.alias("tag"))


def audio_digests(media: DataFrame, to: int = 16000) -> DataFrame:
    """Of stored files (key columns first, `media` last): those columns without it, sizes and digests of payload, file and PCM, and features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            at_ = whole.num_columns - 1
            for batch in pieces(whole, at_, BATCH):
                data, at = buffers(batch.column(at_))
                tags, pcm, pcm_at = _read(data, at, to)
                files = [data[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                back = [f[h[2] : h[3]] for f in files for h in (parse_wave(f),)]
                sha = lambda x: hashlib.sha256(x).hexdigest()
                said = [f"{NAMES[t]};8000>{to};{x}" for t, x in zip(tags.tolist(), features(pcm, pcm_at), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        *batch.columns[:at_], pa.array([len(p) for p in back], pa.int64()), pa.array([sha(p) for p in back], pa.string()), pa.array([zlib.crc32(p[-64:]) for p in back], pa.int64()), pa.array([len(f) for f in files], pa.int64()),
                        pa.array([sha(f) for f in files], pa.string()), pa.array(said, pa.string()), pa.array(np.diff(pcm_at) * 2), pa.array([sha(pcm[a:b]) for a, b in zip(pcm_at[:-1].tolist(), pcm_at[1:].tolist(), strict=True)], pa.string()),
                    ],
                    [*whole.schema.names[:at_], "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm_bytes", "pcm_sha256"],
                )

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema.fields[:-1])
    return arrow_map(media, run, f"{own}, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm_bytes long, pcm_sha256 string")


def op8_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as mu-law, A-law or ADPCM files of 8 kHz in a written table, read back and decoded to PCM of 16 kHz."""
    rows = payloads(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    media = stored(encode_audio(rows, ["doc_id", "n_bytes"], "payload", "tag"), "audio-media")
    return audio_digests(media)

"""Telephony audio columns: mu-law, A-law and ADPCM in, resampled PCM out.

mu-law and A-law bytes expand through 256-entry tables built from their rule.
ADPCM (4 bits, blocks of a fixed size, each with its own header) decodes step by
step within a block but across all blocks of a batch at once, so numpy works on
columns of blocks.  Every function is bounded by one Arrow batch; no shuffle.

Null texts count as empty (a payload of one 64-byte unit of zeros).  Media that are
null, or no WAV file of a known kind, have null PCM; of ADPCM, whole blocks decode.
Equal inputs give equal outputs, whatever batch they fall in.  Repeated rows stay.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import cut

RATE, TARGET_RATE, UNIT = 8_000, 16_000, 64
MULAW, ALAW, ADPCM, PCM = 7, 6, 0x11, 1  # RIFF format tags
#: Index steps of 4-bit ADPCM codes (the sign bit is apart).
INDEX_STEPS = (-1, -1, -1, -1, 2, 4, 6, 8)
#: Quantiser steps of 4-bit ADPCM.
STEPS = (
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143,
    157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552,
    1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487,
    12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
)


@lru_cache(maxsize=1)
def mulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    size = (((code & 0x0F) << 3) + 0x84 << (code >> 4 & 7)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


@lru_cache(maxsize=1)
def alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    part, segment = (code & 0x0F) << 4, code >> 4 & 7
    size = np.where(segment == 0, part + 8, part + 0x108 << np.maximum(segment - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


def decode_adpcm(data: np.ndarray, block: int = UNIT) -> np.ndarray:
    """Mono 4-bit ADPCM: (blocks, samples) from bytes; a last block that isn't whole is left out.

    A block is a 16-bit first sample, a step index, a spare byte, then two codes a byte, low half first."""
    rows = data[: len(data) // block * block].reshape(-1, block)
    value = rows[:, 0].astype(np.int32) | rows[:, 1].astype(np.int8).astype(np.int32) << 8
    index = np.minimum(rows[:, 2].astype(np.int32), len(STEPS) - 1)
    steps, moves = np.array(STEPS, np.int32), np.array(INDEX_STEPS, np.int32)
    out = np.empty((2 * (block - 4) + 1, len(rows)), np.int16)
    out[0] = value
    codes = np.ascontiguousarray(rows[:, 4:].T)
    for k in range(1, len(out)):
        code = (codes[(k - 1) // 2] >> (4 * ((k - 1) % 2)) & 15).astype(np.int32)
        step, size = steps[index], code & 7
        change = step >> 3
        change += np.where(size & 4, step, 0) + np.where(size & 2, step >> 1, 0) + np.where(size & 1, step >> 2, 0)
        value = np.clip(np.where(code & 8, value - change, value + change), -32768, 32767)
        index = np.clip(index + moves[size], 0, len(STEPS) - 1)
        out[k] = value
    return out.T


@lru_cache(maxsize=8)
def kernel(up: int, down: int, half: int = 8) -> np.ndarray:
    """A windowed-sinc low-pass for resampling by up/down."""
    wide = max(up, down)
    x = np.arange(-half * wide, half * wide + 1) / wide
    return np.sinc(x) * (0.5 + 0.5 * np.cos(np.pi * x / half)) * up / wide


def resample(pcm: np.ndarray, rate: int, target: int) -> np.ndarray:
    """16-bit samples at another rate: zero-stuffed, filtered, thinned out; ceil(n * target / rate) of them."""
    if rate == target or not len(pcm):
        return pcm.astype(np.int16)
    common = np.gcd(rate, target)
    up, down = target // common, rate // common
    taps = kernel(up, down)
    mid, n = len(taps) // 2, -(-len(pcm) * up // down)
    if down == 1:  # each phase of the filter runs at the low rate
        padded = pcm.astype(np.float64)
        out = np.empty((len(pcm), up))
        for phase in range(up):
            own = taps[(mid + phase) % up :: up]
            lead = (mid + phase) // up
            full = np.convolve(padded, own)
            out[:, phase] = full[lead : lead + len(pcm)]
        wave = out.ravel()[:n]
    else:
        stuffed = np.zeros(len(pcm) * up)
        stuffed[::up] = pcm
        wave = np.convolve(stuffed, taps)[mid : mid + len(stuffed)][::down][:n]
    return np.clip(np.rint(wave), -32768, 32767).astype(np.int16)


def write_wav(data: bytes, tag: int = MULAW, rate: int = RATE, bits: int = 8, align: int = 1) -> bytes:
    """A mono RIFF file around coded samples."""
    fmt = struct.pack("<HHIIHHH", tag, 1, rate, rate * align if tag != ADPCM else rate * align // (2 * (align - 4) + 1), align, bits, 0)
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(media: bytes) -> tuple[int, int, int, bytes]:
    """(format tag, rate, block size, coded samples) of a RIFF file; chunks that aren't known are passed over."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("no RIFF/WAVE header")
    at, tag, rate, align = 12, 0, 0, 1
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt " and at + 22 <= len(media):
            tag, _, rate, _, align = struct.unpack_from("<HHIIH", media, at + 8)
        elif name == b"data":
            return tag, rate, align, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def expand(tag: int, data: bytes, align: int = UNIT) -> np.ndarray:
    """PCM of coded samples."""
    raw = np.frombuffer(data, np.uint8)
    if tag in (MULAW, ALAW):
        return (mulaw_table() if tag == MULAW else alaw_table())[raw]
    if tag == ADPCM and align > 4:
        return decode_adpcm(raw, align).ravel()
    if tag == PCM:
        return raw[: len(raw) // 2 * 2].view("<i2")
    raise ValueError(f"format {tag} with blocks of {align} bytes isn't known")


def samples(media: bytes | None, target: int = TARGET_RATE) -> np.ndarray | None:
    """PCM of a WAV file at `target` Hz; None for null and for what isn't one of a known kind."""
    try:
        tag, rate, align, data = read_wav(media or b"")
        return resample(expand(tag, data, align), rate, target) if rate else None
    except (ValueError, struct.error):
        return None


def decode_media(df: DataFrame, media: str = "media", target: int = TARGET_RATE) -> DataFrame:
    """Adds `pcm` (little-endian 16-bit samples at `target` Hz) to rows with a WAV column, to be stored beside it or in its place."""

    @F.pandas_udf("binary")
    def pcm(column: pd.Series) -> pd.Series:
        waves = (samples(x, target) for x in column)
        return pd.Series([None if w is None else w.astype("<i2").tobytes() for w in waves], dtype=object)

    return df.withColumn("pcm", pcm(F.col(media)))


def store(df: DataFrame, text: str = "text", out: str = "media", tag: int = MULAW) -> DataFrame:
    """Adds `out`: each text's UTF-8 bytes, zero-filled to whole units, as the mu-law (or A-law) samples of a WAV file."""

    @F.pandas_udf("binary")
    def wav(column: pd.Series) -> pd.Series:
        return column.fillna("").map(lambda t: write_wav(payload_of(t), tag))

    return df.withColumn(out, wav(F.col(text)))


def payload_of(text: str) -> bytes:
    raw = text.encode()
    return raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b"\0")


def features(media: list[bytes], target: int = TARGET_RATE) -> list[tuple[bytes, bytes, str]]:
    """(coded samples read back, resampled PCM, feature text) of each file: its own samples, and its bytes as A-law and as
    ADPCM samples; the ADPCM reading runs across all files at once."""
    read = [read_wav(m) for m in media]
    blocks = np.array([len(r[3]) // UNIT for r in read])
    wave = decode_adpcm(np.frombuffer(b"".join(r[3] for r in read), np.uint8)).astype(np.int64)
    power = np.add.reduceat((wave**2).sum(axis=1), np.concatenate(([0], np.cumsum(blocks)[:-1]))) if len(read) else []
    out = []
    for (tag, rate, _, data), n, p in zip(read, blocks.tolist(), power, strict=True):
        pcm = expand(tag, data)
        fine = resample(pcm, rate, target)
        wide = fine.astype(np.int64)
        sign = pcm >= 0
        other = expand(ALAW if tag == MULAW else MULAW, data).astype(np.int64)
        out.append((data, fine.astype("<i2").tobytes(), f"samples={len(pcm)};rms={np.sqrt((pcm.astype(np.int64) ** 2).mean()):.3f};crossings={np.count_nonzero(sign[1:] != sign[:-1])};"
                          f"rate={target};resampled={len(fine)};peak={np.abs(wide).max()};resampled_rms={np.sqrt((wide**2).mean()):.3f};other_law_rms={np.sqrt((other**2).mean()):.3f};adpcm_rms={np.sqrt(int(p) / (n * wave.shape[1])):.3f}"))  # fmt: skip
    return out


def digests(docs: DataFrame) -> DataFrame:
    """Stores each text as mu-law audio in the shared folder, reads it back and returns digests and features.

    The media table is written; the resampled PCM, eight times as large, exists in the tasks only."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm_bytes long, pcm_sha256 string"
    names = [x.split()[0] for x in schema.split(", ")]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    stored = cut(store(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))).drop("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), 512):
                own = batch.iloc[i : i + 512]
                media = own["media"].tolist()
                rows = [
                    (d, n, len(x), hashlib.sha256(x).hexdigest(), zlib.crc32(x[-UNIT:]), len(m), hashlib.sha256(m).hexdigest(), f, len(p), hashlib.sha256(p).hexdigest())
                    for d, n, m, (x, p, f) in zip(own["doc_id"].tolist(), own["n_bytes"].tolist(), media, features(media), strict=True)
                ]
                yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    return stored.select("doc_id", "n_bytes", "media").mapInPandas(run, schema)

"""Telephony audio: mu-law, A-law and IMA ADPCM to resampled 16-bit PCM, as numpy arrays.

The companded codes expand through tables of 256 samples; ADPCM blocks are decoded step by step, each step
for all blocks of a slice at once. ``to_pcm`` turns a column of WAVE files into WAVE files of resampled PCM;
``store`` keeps any text losslessly as a mu-law WAVE file, one byte a sample, and ``read_back`` gives the payload of
stored files and the features of the PCM files that ``to_pcm`` makes of them.

Lower rates are reached by taking the mean of the samples that fall into one, higher ones by linear interpolation,
both in whole numbers. Of a last ADPCM block that isn't complete the samples that are there count, and PCM of 8 bits
is brought to 16.

Rows: null text counts as empty and is stored as 192 spaces; a null or unreadable file (no WAVE file of one channel,
a damaged header, another format, a rate of zero) gives nulls, and one without samples a file without samples;
repeated rows repeat; other columns stay out of the result.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Bytes of an ADPCM block; payloads are padded to a multiple of it.
BLOCK = 192
RATE, TARGET_RATE = 8_000, 16_000
PCM, ALAW, MULAW, IMA = 1, 6, 7, 17

# Fixed values of the IMA ADPCM format: quantiser steps, and how a code's magnitude moves the step index.
STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
    np.int32,
)
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)


def _mulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    size = (((code & 0x0F) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 0x80, -size, size).astype(np.int16)


def _alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    step, low = code >> 4 & 7, (code & 0x0F) << 4
    size = np.where(step == 0, low + 8, (low + 264) << np.maximum(step - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


MULAW_PCM, ALAW_PCM = _mulaw_table(), _alaw_table()
# What a code adds to the prediction at each step index.
_code = np.arange(16)
_size = (STEPS[:, None] >> 3) + (_code >> 2 & 1) * STEPS[:, None] + (_code >> 1 & 1) * (STEPS[:, None] >> 1) + (_code & 1) * (STEPS[:, None] >> 2)
CHANGES = np.where(_code & 8, -_size, _size).astype(np.int32)


def decode_ima(data: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Samples of whole blocks of mono IMA ADPCM, one row a block; all blocks advance together, one nibble at a time."""
    blocks = data[: len(data) // block * block].reshape(-1, block)
    value = (blocks[:, 0].astype(np.int32) | blocks[:, 1].astype(np.int8).astype(np.int32) << 8).copy()
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    out = np.empty((1 + 2 * (block - 4), len(blocks)), np.int16)
    out[0] = value
    codes = np.ascontiguousarray(blocks[:, 4:].T)
    for k in range(block - 4):
        for half in (0, 1):
            code = codes[k] >> 4 if half else codes[k] & 15
            value += CHANGES[index, code]
            np.clip(value, -32768, 32767, out=value)
            index += MOVES[code]
            np.clip(index, 0, 88, out=index)
            out[1 + 2 * k + half] = value
    return out.T


def decode_ima_file(data: np.ndarray, block: int) -> np.ndarray:
    """All samples of a file's blocks, with those of a last one that isn't complete."""
    rest = len(data) % block
    whole = decode_ima(data, block).ravel()
    return whole if rest < 4 else np.concatenate([whole, decode_ima(data[-rest:], rest).ravel()])


def resample(samples: np.ndarray, rate: int, target: int) -> np.ndarray:
    """Linear interpolation in whole numbers, to a rate that isn't lower."""
    if target < rate:
        raise ValueError("the target rate is lower than the source's")
    if target == rate or not len(samples):
        return samples
    wide = np.append(samples, samples[-1]).astype(np.int32)
    if target % rate == 0:
        up = target // rate
        base, rise = wide[:-1, None], np.diff(wide)[:, None]
        return (base + rise * np.arange(up, dtype=np.int32) // up).astype(np.int16).ravel()
    at = np.arange(len(samples) * target // rate, dtype=np.int64) * rate
    i, part = at // target, at % target
    return (wide[i] + (wide[i + 1] - wide[i]) * part // target).astype(np.int16)


def at_rate(samples: np.ndarray, rate: int, target: int) -> np.ndarray:
    """The samples at another rate, which may be lower: then each is the mean (rounded down) of those that fall into it."""
    if target >= rate or not len(samples):
        return resample(samples, rate, target)
    count = (len(samples) - 1) * target // rate + 1
    begin = -(-np.arange(count, dtype=np.int64) * rate // target)
    sums = np.add.reduceat(samples.astype(np.int64), begin)
    return (sums // np.diff(np.append(begin, len(samples)))).astype(np.int16)


def wave(data: bytes, kind: int, rate: int, bits: int, block: int = 1) -> bytes:
    """A mono WAVE file around encoded samples."""
    extra = b"" if kind == PCM else struct.pack("<H", 0) if kind != IMA else struct.pack("<HH", 2, 1 + 2 * (block - 4))
    form = struct.pack("<HHIIHH", kind, 1, rate, rate * bits // 8 & 0xFFFFFFFF, block, bits) + extra
    chunks = b"fmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def parse_wave(media: bytes) -> tuple[int, int, int, bytes] | None:
    """Format, rate, block size and encoded samples of a mono WAVE file; None for anything else. The block size of PCM
    is the bytes of a sample."""
    if len(media) < 12 or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        return None
    at, form = 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            if size < 16 or at + 24 > len(media):
                return None
            kind, channels, rate, _, block, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if channels != 1 or not rate:
                return None
            form = (kind, rate, bits // 8 if kind == PCM else block)
        elif name == b"data":
            return None if form is None else (*form, media[at + 8 : at + 8 + size])
        at += 8 + size + size % 2
    return None


def samples_of(kind: int, data: bytes, block: int) -> np.ndarray | None:
    """The samples as 16-bit PCM; None for other formats."""
    raw = np.frombuffer(data, np.uint8)
    if kind == MULAW:
        return MULAW_PCM[raw]
    if kind == ALAW:
        return ALAW_PCM[raw]
    if kind == IMA and block > 4:
        return decode_ima_file(raw, block)
    if kind == PCM and block == 1:
        return (raw.astype(np.int16) - 128) << 8
    return np.frombuffer(data[: len(data) // 2 * 2], "<i2") if kind == PCM and block == 2 else None


def pcm_file(media: bytes | None, target: int = TARGET_RATE) -> bytes | None:
    """A WAVE file of 16-bit PCM at the target rate; None if the file can't be read."""
    parsed = parse_wave(media) if media else None
    samples = samples_of(parsed[0], parsed[3], parsed[2]) if parsed else None
    return None if samples is None else wave(at_rate(samples, parsed[1], target).astype("<i2").tobytes(), PCM, target, 16, 2)


def to_pcm(files: DataFrame, media: str = "media", key: str = "doc_id", target: int = TARGET_RATE) -> DataFrame:
    """key and pcm (a WAVE file of resampled 16-bit PCM) of every file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [pcm_file(file, target) for file in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], [key, "pcm"])

    return common.map_slices(files.select(key, F.col(media).alias("__media")), "__media", run, f"{key} {files.schema[key].dataType.simpleString()}, pcm binary")


def store(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes and media (a mu-law WAVE file whose samples are the padded text) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [t or b"" for t in common.byte_list(batch.column(1))]
            files = [wave(t.ljust(max(1, -(-len(t) // BLOCK)) * BLOCK, b" "), MULAW, RATE, 8) for t in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, raw)), pa.int64()), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias(common.TEXT))
    return common.map_slices(rows, common.TEXT, run, "doc_id long, n_bytes long, media binary")


def _describe(file: bytes) -> str:
    """Features of a file of 16-bit PCM."""
    pcm = np.frombuffer(parse_wave(file)[3], "<i2")
    wide = pcm.astype(np.int64)
    power = math.isqrt(int(wide @ wide) // len(pcm))
    crossings = int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))
    return f"n{len(pcm)} rms{power} zc{crossings} peak{int(np.abs(wide).max())} crc{zlib.crc32(pcm):08x}"


def with_pcm(stored: DataFrame, media: str = "media", target: int = TARGET_RATE) -> DataFrame:
    """``stored`` with pcm, a WAVE file of resampled 16-bit PCM (null where the file can't be read)."""
    at = stored.columns.index(media)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pcm = pa.array([pcm_file(file, target) for file in batch.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, pcm], [*batch.schema.names, "pcm"])

    return common.map_slices(stored, media, run, T.StructType([*stored.schema]).add("pcm", T.BinaryType()))


def read_back(stored: DataFrame) -> DataFrame:
    """What the stored files (media, and pcm made of it) hold: payload digests, the PCM's size and digest, and features.

    The feature describes the stored PCM, and what the same payload would be as A-law and as ADPCM blocks.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "pcm_bytes", "pcm_sha256", "feature"]
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, pcm_bytes long, pcm_sha256 string, feature string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files, made = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            payloads = [parse_wave(f) for f in files]
            data = [p[3] for p in payloads]
            ima = decode_ima(np.frombuffer(b"".join(data), np.uint8))  # whole blocks, so texts don't mix
            rows, at = [], 0
            for file, pcm, (_, rate, _, payload) in zip(files, made, payloads, strict=True):
                n = len(payload) // BLOCK
                others = [ALAW_PCM[np.frombuffer(payload, np.uint8)], ima[at : at + n].ravel()]
                alaw, adpcm = (wave(at_rate(x, rate, TARGET_RATE).astype("<i2").tobytes(), PCM, TARGET_RATE, 16, 2) for x in others)
                feature = f"ulaw {_describe(pcm)}; alaw {_describe(alaw)}; ima {_describe(adpcm)}"
                at += n
                rows.append((len(payload), common.sha256(payload), zlib.crc32(payload[-16:]), len(file), common.sha256(file), len(pcm), common.sha256(pcm), feature))
            columns = [pa.array(c) for c in zip(*rows, strict=True)] if rows else []
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names)

    return common.map_slices(stored.select("doc_id", "n_bytes", "media", "pcm"), "pcm", run, schema)

"""Telephony audio in binary columns: mu-law and A-law by lookup tables, IMA ADPCM with numpy across blocks, resampled PCM.

Stored form: a RIFF/WAVE file with a `fact` chunk and one channel at 8 kHz. Companded codes are one byte a sample, so
any bytes are stored without loss; IMA ADPCM's unit is a block of 64 bytes (a 4-byte header and 120 more samples).
Decoded sound is resampled to 16 kHz by an integer half-band filter, so every figure is exact and repeatable.

Defined results: a null or empty text becomes one block of zero bytes; long texts are whole files, never cut; equal
texts give equal rows; a stored form that isn't such a file raises ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from popshift.llm.common import column, read, small_batches, staged, text_bytes

RATE, UNIT = 8000, 64
#: WAVE format tags, and the samples that one block holds.
TAGS = {"alaw": (6, 1, 1), "mulaw": (7, 1, 1), "ima": (17, UNIT, 2 * (UNIT - 4) + 1)}


def _mulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    size = (((code & 0x0F) << 3) + 0x84 << (code >> 4 & 7)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def _alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    exponent, mantissa = code >> 4 & 7, (code & 0x0F) << 4
    size = np.where(exponent == 0, mantissa + 8, (mantissa + 0x108) << np.maximum(exponent - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


def _ima_steps() -> np.ndarray:
    """The 89 step sizes of IMA ADPCM. Fixed values, as the format gives them."""
    return np.array(
        [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
        dtype=np.int32,
    )


MULAW, ALAW, STEPS = _mulaw_table(), _alaw_table(), _ima_steps()
#: How a 4-bit code moves the step index. Fixed values, as the format gives them.
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], dtype=np.int32)


def _code_tables() -> tuple[np.ndarray, np.ndarray]:
    """By step index and code: the difference, and the next step index."""
    step = STEPS[:, None]
    code = np.arange(16)[None, :]
    size = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
    return np.where(code & 8, -size, size).astype(np.int32).ravel(), np.clip(np.arange(89)[:, None] + MOVES[code & 7], 0, 88).astype(np.int32).ravel()


DIFFERENCE, NEXT = _code_tables()


def decode_ima(blocks: np.ndarray) -> np.ndarray:
    """(blocks, samples) of (blocks, bytes): one step in time decodes a sample of every block."""
    head = blocks[:, :4]
    value = (head[:, 0].astype(np.int32) | head[:, 1].astype(np.int32) << 8).astype(np.uint16).view(np.int16).astype(np.int32)
    index = np.minimum(head[:, 2], 88).astype(np.int32)
    codes = np.empty((2 * (blocks.shape[1] - 4), len(blocks)), np.int32)
    codes[0::2], codes[1::2] = (blocks[:, 4:] & 15).T, (blocks[:, 4:] >> 4).T
    out = np.empty((len(codes) + 1, len(blocks)), np.int16)
    out[0] = value
    for t, code in enumerate(codes):
        at = index * 16 + code
        value = np.clip(value + DIFFERENCE[at], -32768, 32767)
        index = NEXT[at]
        out[t + 1] = value
    return out.T


def decode(codec: str, data: bytes) -> np.ndarray:
    """PCM samples of a stored payload."""
    raw = np.frombuffer(data, np.uint8)
    if codec == "ima":
        return decode_ima(raw.reshape(-1, UNIT)).ravel()
    return (MULAW if codec == "mulaw" else ALAW)[raw]


def resample_double(pcm: np.ndarray) -> np.ndarray:
    """Twice the rate: samples as they are, and between them the half-band filter (-1, 9, 9, -1) / 16."""
    x = np.pad(pcm.astype(np.int32), (1, 2), mode="edge")
    out = np.empty(2 * len(pcm), np.int16)
    out[0::2] = pcm
    out[1::2] = np.clip((9 * (x[1:-2] + x[2:-1]) - x[:-3] - x[3:] + 8) >> 4, -32768, 32767)
    return out


def pad(text: bytes) -> bytes:
    """Zero bytes up to a positive multiple of UNIT."""
    return text.ljust(max(UNIT, -(-len(text) // UNIT) * UNIT), b"\0")


def to_wave(payload: bytes, codec: str = "mulaw") -> bytes:
    tag, align, samples = TAGS[codec]
    n = len(payload) // align * samples
    bits, extra = (4, struct.pack("<HH", 2, samples)) if codec == "ima" else (8, struct.pack("<H", 0))
    fmt = struct.pack("<HHIIHH", tag, 1, RATE, RATE * align // samples, align, bits) + extra
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, n) + b"data" + struct.pack("<I", len(payload)) + payload
    return b"RIFF" + struct.pack("<I", len(body)) + body


def from_wave(media: bytes) -> tuple[str, bytes]:
    """(codec, payload) of a stored form."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, codec = 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            tag = struct.unpack_from("<H", media, at + 8)[0]
            codec = next((c for c, x in TAGS.items() if x[0] == tag), None)
        elif name == b"data":
            if codec is None or at + 8 + size > len(media):
                raise ValueError("unknown format tag or short data chunk")
            return codec, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def store(docs: DataFrame, codec: str = "mulaw") -> DataFrame:
    """doc_id, n_bytes, media: each text's padded bytes as a stored form, written as a table and read back."""
    small_batches(docs.sparkSession)
    df = text_bytes(docs, "doc_id")

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = column(batch, "_b").to_pylist()
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array([len(x) for x in texts], pa.int64()), pa.array([to_wave(pad(x), codec) for x in texts], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return staged(df.mapInArrow(build, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary"), "media")


def _stats(pcm: np.ndarray) -> str:
    x = pcm.astype(np.int64)
    sign = np.signbit(pcm)
    return f"n={len(x)},mean={int(x.sum()) // len(x)},power={int((x * x).sum()) // len(x)},peak={int(np.abs(x).max())},crossings={int((sign[1:] != sign[:-1]).sum())}"


def resample_half(pcm: np.ndarray) -> np.ndarray:
    """Half the rate: the half-band filter (-1, 0, 9, 16, 9, 0, -1) / 32 around every other sample."""
    x = np.pad(pcm.astype(np.int32), (3, 3), mode="edge")
    n = len(pcm)
    at = lambda k: x[3 + k : 3 + k + n : 2]
    return np.clip((16 * at(0) + 9 * (at(-1) + at(1)) - at(-3) - at(3) + 16) >> 5, -32768, 32767).astype(np.int16)


def eight_bits(pcm: np.ndarray) -> np.ndarray:
    """Linear samples of 8 bits, unsigned as in WAVE files, rounded."""
    return (np.clip((pcm.astype(np.int32) + 128) >> 8, -128, 127) + 128).astype(np.uint8)


#: Bytes of payload that are decoded together: a batch's rows are taken in portions.
PORTION = 1 << 20


def features(media: DataFrame) -> DataFrame:
    """Digests of what is stored, for each reading of its bytes (mu-law, A-law, ADPCM) figures of the 16 kHz sound, and pcm.

    pcm is the stored sound at half its rate, as linear samples of 8 bits.
    """
    small_batches(media.sparkSession)

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(x.as_buffer()) for x in column(batch, "media")])
            begins = np.flatnonzero(np.diff(np.cumsum(sizes) // PORTION, prepend=-1))
            for a, b in zip(begins.tolist(), [*begins[1:].tolist(), batch.num_rows], strict=True):
                yield portion(batch.slice(a, b - a))

    def portion(batch: pa.RecordBatch) -> pa.RecordBatch:
        forms = column(batch, "media").to_pylist()
        read_ = [from_wave(x) for x in forms]
        payloads = [p for _, p in read_]
        # ADPCM in one pass over the blocks of all rows, a bounded number of them at a time.
        ima, at = [], 0
        blocks = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, UNIT)
        sound = np.concatenate([decode_ima(blocks[i : i + 32768]) for i in range(0, len(blocks), 32768)]) if len(blocks) else blocks
        for p in payloads:
            ima.append(sound[at : (at := at + len(p) // UNIT)].ravel())
        said = [f"mulaw:{_stats(resample_double(decode('mulaw', p)))};alaw:{_stats(resample_double(decode('alaw', p)))};ima:{_stats(resample_double(x))}" for p, x in zip(payloads, ima, strict=True)]
        pcm = [eight_bits(resample_half(decode(codec, p))).tobytes() for codec, p in read_]
        sha = lambda rows: pa.array([hashlib.sha256(x).hexdigest() for x in rows], pa.string())
        return pa.RecordBatch.from_arrays(
            [column(batch, "doc_id"), column(batch, "n_bytes"), pa.array([len(p) for p in payloads], pa.int64()), sha(payloads), pa.array([zlib.crc32(p[-UNIT:]) for p in payloads], pa.int64()), pa.array([len(x) for x in forms], pa.int64()), sha(forms), pa.array(said, pa.string()), pa.array(pcm, pa.binary())],
            names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm"],
        )

    return media.mapInArrow(of, f"doc_id {media.schema['doc_id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm binary")


def resampled(docs: DataFrame, codec: str = "mulaw") -> DataFrame:
    """features() of what store() stores, with the resampled PCM written as a column of a table and read back."""
    return staged(features(store(docs, codec)), "media-pcm")


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and the size and digest of the resampled PCM as it was read back."""
    stored = resampled(read(spark, sf_dir, "documents"))
    return stored.withColumns({"pcm_bytes": F.octet_length("pcm").cast("long"), "pcm_sha256": F.sha2("pcm", 256)}).drop("pcm")

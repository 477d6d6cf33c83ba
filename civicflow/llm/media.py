"""Telephony audio columns: mu-law, A-law and IMA ADPCM in WAVE files, decoded and resampled.

Companded bytes are expanded by 256-entry lookup tables. ADPCM predicts each sample from the one
before, so a block can't be vectorised along itself; all blocks of a batch are decoded together, one
numpy step for each place in a block. Decoded audio is brought to another rate by a windowed-sinc
filter and stored as 16-bit PCM.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from civicflow.llm.base import cut, documents, spans_of

PCM, ALAW, MULAW, IMA = 1, 6, 7, 17
NAMES = {PCM: "pcm", ALAW: "alaw", MULAW: "mulaw", IMA: "ima"}
RATE, TARGET = 8000, 16000
UNIT = 192  # payload bytes of an ADPCM block, and what payloads are padded to
_HEADER = 4  # of an ADPCM block: first sample, step index, a spare byte


@lru_cache(1)
def mulaw_table() -> np.ndarray:
    """16-bit sample of each mu-law byte, from the companding rule: sign, 3-bit segment, 4-bit step, all bits inverted."""
    code = ~np.arange(256) & 255
    size = ((code & 15) * 8 + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


@lru_cache(1)
def alaw_table() -> np.ndarray:
    """16-bit sample of each A-law byte: even bits inverted, then sign, segment and step."""
    code = np.arange(256) ^ 0x55
    segment, step = code >> 4 & 7, (code & 15) * 16 + 8
    size = np.where(segment == 0, step, step + 256 << np.maximum(segment - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


#: The step sizes and index changes of IMA ADPCM.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143,
    157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552,
    1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487,
    12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)
CHANGES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)


def decode_ima(blocks: np.ndarray) -> np.ndarray:
    """Samples of mono IMA ADPCM blocks (a row of bytes each): one more than twice the bytes behind the header."""
    blocks = np.ascontiguousarray(blocks, np.uint8)
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.clip(blocks[:, 2].astype(np.int32), 0, 88)
    data = blocks[:, _HEADER:]
    out = np.empty((data.shape[1] * 2 + 1, len(blocks)), np.int16)
    out[0] = value
    for at in range(data.shape[1]):
        for half, shift in enumerate((0, 4)):
            nibble = (data[:, at] >> shift) & 15
            step = STEPS[index]
            change = (step >> 3) + np.where(nibble & 4, step, 0) + np.where(nibble & 2, step >> 1, 0) + np.where(nibble & 1, step >> 2, 0)
            value = np.clip(np.where(nibble & 8, value - change, value + change), -32768, 32767)
            index = np.clip(index + CHANGES[nibble], 0, 88)
            out[1 + 2 * at + half] = value
    return np.ascontiguousarray(out.T)


def wave(data: bytes, tag: int, rate: int = RATE) -> bytes:
    """A mono WAVE file whose data chunk holds these bytes. For ADPCM they are whole blocks of 4 + ``UNIT`` bytes."""
    align, bits, extra = {PCM: (2, 16, b""), IMA: (_HEADER + UNIT, 4, struct.pack("<HH", 2, 2 * UNIT + 1))}.get(tag, (1, 8, b"\0\0"))
    per_second = rate * align // (2 * UNIT + 1) if tag == IMA else rate * align
    fmt = struct.pack("<HHIIHH", tag, 1, rate, per_second, align, bits) + extra
    pad = b"\0" * (len(data) % 2)
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(data)) + data + pad
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wave(stored: bytes) -> tuple[int, int, int, bytes]:
    """Format tag, rate, block size and data of a mono WAVE file; other chunks are skipped, a cut-off data chunk is read as far as it goes."""
    if stored[:4] != b"RIFF" or stored[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, fmt = 12, None
    while at + 8 <= len(stored):
        name, size = stored[at : at + 4], int.from_bytes(stored[at + 4 : at + 8], "little")
        if name == b"fmt ":
            fmt = struct.unpack("<HHIIHH", stored[at + 8 : at + 24])
            if fmt[1] != 1:
                raise ValueError("only one channel is read")
        if name == b"data" and fmt:
            return fmt[0], fmt[2], fmt[4], stored[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk behind a format chunk")


def payload_of(tag: int, data: bytes) -> bytes:
    """The payload in a data chunk: all of it, or behind the blocks' headers."""
    if tag != IMA:
        return data
    return np.frombuffer(data, np.uint8).reshape(-1, _HEADER + UNIT)[:, _HEADER:].tobytes()


def chunk_of(tag: int, payload: bytes) -> bytes:
    """The data chunk that holds a payload; for ADPCM its length must be a multiple of ``UNIT``."""
    if tag != IMA:
        return payload
    blocks = np.zeros((len(payload) // UNIT, _HEADER + UNIT), np.uint8)
    blocks[:, _HEADER:] = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    return blocks.tobytes()


def decode_many(files: list[tuple[int, bytes]]) -> list[np.ndarray]:
    """16-bit samples of many files, given as format tag and data; all their ADPCM blocks are decoded at once.

    PCM must be of 16 bits. A part of a block at the end of ADPCM data is left out.
    """
    out: list[np.ndarray | None] = [None] * len(files)
    adpcm = [i for i, (tag, _) in enumerate(files) if tag == IMA]
    for i, (tag, data) in enumerate(files):
        if tag == PCM:
            out[i] = np.frombuffer(data[: len(data) // 2 * 2], "<i2")
        elif tag in (ALAW, MULAW):
            out[i] = (mulaw_table() if tag == MULAW else alaw_table())[np.frombuffer(data, np.uint8)]
        elif tag != IMA:
            raise ValueError(f"format {tag} isn't read")
    if adpcm:
        size = _HEADER + UNIT
        sizes = [len(files[i][1]) // size for i in adpcm]
        blocks = np.concatenate([np.frombuffer(files[i][1][: n * size], np.uint8).reshape(-1, size) for i, n in zip(adpcm, sizes, strict=True)])
        parts = np.split(decode_ima(blocks), np.cumsum(sizes)[:-1])
        for i, part in zip(adpcm, parts, strict=True):
            out[i] = part.reshape(-1)
    return out


@lru_cache(8)
def _filter(up: int, down: int, half: int = 8) -> np.ndarray:
    """Rows of a polyphase low-pass filter, one a phase; each sums to 1."""
    widest = max(up, down)
    taps = np.arange(-half * widest, half * widest + 1)
    kernel = np.sinc(taps / widest) * np.hanning(len(taps) + 2)[1:-1]
    width = -(-len(kernel) // up)
    rows = np.zeros((up, width))
    for phase in range(up):
        own = kernel[phase::up]
        rows[phase, : len(own)] = own / own.sum()
    return rows.astype(np.float32)


def resample(samples: np.ndarray, rate: int, target: int) -> np.ndarray:
    """16-bit samples at another rate, ceil(n x target / rate) of them; silence is taken around the signal."""
    if rate == target or not len(samples):
        return samples
    up, down = target // gcd(rate, target), rate // gcd(rate, target)
    rows = _filter(up, down)
    width, half = rows.shape[1], 8 * max(up, down)
    n = -(-len(samples) * up // down)
    wide = np.concatenate([np.zeros(width + 1, np.float32), samples.astype(np.float32), np.zeros(width + 1, np.float32)])
    out = np.empty(n, np.float32)
    for first in range(min(up, n)):  # outputs first, first + up, ... share a phase and step by down inputs
        at = first * down + half
        phase, last = at % up, at // up
        count = len(range(first, n, up))
        total = np.zeros(count, np.float32)
        for k in range(width):
            start = last - k + width + 1
            total += rows[phase, k] * wide[start : start + down * (count - 1) + 1 : down]
        out[first::up] = total
    return np.clip(np.rint(out), -32768, 32767).astype("<i2")


def features(tag: int, rate: int, samples: np.ndarray, pcm: np.ndarray) -> str:
    """Format, seconds, loudness, peak, zero crossings and the stored PCM's checksum."""
    n = max(1, len(samples))
    wide = samples.astype(np.int64)
    loud = float(np.sqrt(int((wide * wide).sum()) / n))
    crossings = int(np.count_nonzero((samples[1:] ^ samples[:-1]) < 0))
    peak = int(np.abs(samples.astype(np.int32)).max(initial=0))
    return f"{NAMES[tag]};s={len(samples) / rate:.4f};rms={loud:.2f};peak={peak};zc={crossings};pcm={len(pcm)}:{zlib.crc32(pcm.tobytes()):08x}"


def format_for(payload: bytes) -> int:
    """The format in which a text's payload is stored; it depends on the payload only."""
    return (MULAW, ALAW, IMA)[zlib.crc32(payload) % 3]


def text_payload(text: str | None) -> tuple[int, bytes]:
    """Number of UTF-8 bytes, and these bytes filled with spaces to a positive multiple of ``UNIT``."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return len(data), data.ljust(max(1, -(-len(data) // UNIT)) * UNIT, b" ")


def stored_audio(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text of docs (doc_id, text) as a telephony WAVE file. A null text is an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].to_pylist()
            for a, b in spans_of([t or "" for t in texts], 1 << 22):
                made = [text_payload(t) for t in texts[a:b]]
                media = [wave(chunk_of(tag := format_for(p), p), tag) for _, p in made]
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, b - a).cast(pa.int64()), pa.array([n for n, _ in made], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


_KINDS = {"n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(), "pcm": pa.binary(), "payload": pa.binary()}
_SQL = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}


def decoded_audio(stored: DataFrame, columns: tuple[str, ...] = ("feature", "pcm"), target: int = TARGET) -> DataFrame:
    """doc_id and the chosen columns of each row of stored (doc_id, media[, n_bytes]).

    To choose from: payload (the bytes in the data chunk) and its digests, media's size and digest,
    pcm (a WAVE file of 16-bit PCM at the target rate) and feature. A null media gives nulls.
    """
    needs = ["doc_id", "media", *(["n_bytes"] if "n_bytes" in columns else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch["media"].to_pylist()
            for a, b in spans_of([m or b"" for m in every], 1 << 20):
                files = [read_wave(m) if m is not None else None for m in every[a:b]]
                audio = iter(decode_many([(f[0], f[3]) for f in files if f]))
                out: dict[str, list] = {c: [] for c in columns}
                for i, f in enumerate(files):
                    row = dict.fromkeys(columns)
                    if f:
                        samples, media = next(audio), every[a + i]
                        pcm = resample(samples, f[1], target)
                        payload = payload_of(f[0], f[3])
                        row |= {"payload": payload, "payload_bytes": len(payload), "tail_crc32": zlib.crc32(payload[-16:]), "media_bytes": len(media)}
                        row["payload_sha256"] = hashlib.sha256(payload).hexdigest()
                        row["media_sha256"] = hashlib.sha256(media).hexdigest()
                        row["feature"] = features(f[0], f[1], samples, pcm)
                        if "pcm" in columns:
                            row["pcm"] = wave(pcm.tobytes(), PCM, target)
                    for c in columns:
                        out[c].append(row.get(c))
                if "n_bytes" in columns:
                    out["n_bytes"] = batch["n_bytes"].slice(a, b - a).to_pylist()
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, b - a).cast(pa.int64()), *[pa.array(out[c], _KINDS[c]) for c in columns]], ["doc_id", *columns])

    return stored.select(*needs).mapInArrow(run, "doc_id long, " + ", ".join(f"{c} {_SQL[_KINDS[c]]}" for c in columns))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each document's stored audio as it is read back, its feature, and its resampled PCM.

    The telephony files are written to shared storage and read from there; the PCM, at twice the rate
    and width and so several times as large, is a column of the result. A null or empty text is a payload of 192 spaces; a very
    long one is one long file. Equal texts and rows that repeat have equal files; a null id stays
    null. No documents, no rows. Other columns aren't read.
    """
    stored = cut(stored_audio(documents(spark, sf_dir)), "media")
    return decoded_audio(stored, ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm"))

"""Audio columns: bytes kept losslessly as 8-bit samples, and features read back from them.

A payload is stored as a RIFF/WAVE file (PCM, mono, unsigned 8-bit, ``RATE`` samples a second).  From
the stored samples come: polyphase resampling to ``RATE * UP / DOWN``, overlapped log-mel filterbanks,
and segments of energy with hysteresis (a segment opens at ``OPEN_DB`` and closes below ``CLOSE_DB``).
Features are cut to clips of ``CLIP`` frames and kept as Arrow fixed-shape tensors with time spans.
Long payloads are computed in blocks of frames, whose results don't depend on the block.

Null texts are empty; repeated rows give repeated results; an empty table gives none; a kept column
named like a result gives way to it.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, LongType, StringType, StructField, StructType

from pathloom.llm.common import arrow_schema, kept

RATE, UP, DOWN = 16_000, 1, 2
FRAME, HOP, N_FFT, MELS = 200, 80, 256, 32
CLIP = 64
OPEN_DB, CLOSE_DB = -6.0, -9.0
PAD_TO = 576
BLOCK = 4096


def payload(text: bytes) -> bytes:
    """text with bytes 255 appended up to a positive multiple of 576."""
    return text + b"\xff" * (-len(text) % PAD_TO if text else PAD_TO)


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    pad = b"\0" * (len(samples) % 2)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + len(pad), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples)) + samples + pad


def from_wav(media: bytes) -> tuple[int, bytes]:
    """Sample rate and samples of an 8-bit mono PCM file; chunks of other kinds are passed over."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("no RIFF/WAVE file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        kind, size = struct.unpack_from("<4sI", media, at)
        if kind == b"fmt ":
            form, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (form, channels, bits) != (1, 1, 8):
                raise ValueError("8-bit mono PCM is expected")
        elif kind == b"data":
            return rate, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


@lru_cache(maxsize=8)
def taps(up: int, down: int, lobes: int = 10) -> np.ndarray:
    """A Kaiser-windowed low-pass of odd length for rational resampling."""
    m = max(up, down)
    k = np.arange(-lobes * m, lobes * m + 1)
    h = np.sinc(k / m) / m * np.kaiser(len(k), 5.0) * up
    return h.astype(np.float32)


def resample(x: np.ndarray, up: int, down: int, low: int = 0, high: int | None = None, offset: int = 0) -> np.ndarray:
    """Samples low <= m < high of the resampled signal; x holds the input from sample offset on, zeros stand elsewhere.

    Output sample m uses the taps of phase (m * down) % up only.
    """
    h = taps(up, down)
    half = len(h) // 2
    high = -(-len(x) * up // down) if high is None else high
    out = np.zeros(max(0, high - low), np.float32)
    for phase in range(up):
        m = np.arange(low + (phase - low) % up, high, up)
        if not len(m):
            continue
        first = m * down  # on the raised grid; input k stands at k * up
        k0 = -((half - first[0]) // up)  # least k with k * up >= first - half
        count = (2 * half) // up + 1
        h_at = half + k0 * up - first[0]
        kernel = np.array([h[h_at + j * up] if 0 <= h_at + j * up < len(h) else 0 for j in range(count)], np.float32)
        span = (len(m) - 1) * down + count
        start = int(k0) - offset
        left, right = max(0, -start), max(0, start + span - len(x))
        part = np.concatenate([np.zeros(left, np.float32), x[max(0, start) : max(0, min(len(x), start + span))], np.zeros(right, np.float32)])[:span]
        y = np.zeros(len(m), np.float32)
        for j in range(count):
            if kernel[j]:
                y += kernel[j] * part[j : j + (len(m) - 1) * down + 1 : down]
        out[m - low] = y
    return out


@lru_cache(maxsize=4)
def mel_bank(rate: float, n_fft: int, mels: int) -> np.ndarray:
    """Triangular filters, equally spaced on the mel scale (2595 log10(1 + f / 700))."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    centres = 700 * (10 ** (np.linspace(0, top, mels + 2) / 2595) - 1)
    f = np.linspace(0, rate / 2, n_fft // 2 + 1)[:, None]
    rise, fall = (f - centres[:-2]) / (centres[1:-1] - centres[:-2]), (centres[2:] - f) / (centres[2:] - centres[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


def log_mel(samples: bytes, rate: int = RATE):
    """Blocks of (log-mel frames, energies in dB below full scale)."""
    x = np.frombuffer(samples, np.uint8)
    total = -(-len(x) * UP // DOWN)
    frames = 1 + max(0, -(-(total - FRAME) // HOP))
    window, bank = np.hanning(FRAME).astype(np.float32), mel_bank(rate * UP / DOWN, N_FFT, MELS)
    margin = len(taps(UP, DOWN)) // UP + 1
    for low in range(0, frames, BLOCK):
        n = min(BLOCK, frames - low)
        a, b = low * HOP, (low + n - 1) * HOP + FRAME
        i, j = max(0, a * DOWN // UP - margin), min(len(x), b * DOWN // UP + margin)
        y = resample((x[i:j].astype(np.float32) - 128) / 128, UP, DOWN, a, b, offset=i)
        view = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP]
        power = np.abs(np.fft.rfft(view * window, N_FFT)) ** 2
        energy = 10 * np.log10(np.einsum("ij,ij->i", view, view) / FRAME + 1e-10)
        yield np.log(power.astype(np.float32) @ bank + 1e-6), energy


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """First frame and frame after the last of each stretch that opens at OPEN_DB and lasts while energy is at least CLOSE_DB."""
    mark = np.where(energy >= OPEN_DB, 1, np.where(energy < CLOSE_DB, 0, -1))
    known = np.maximum.accumulate(np.where(mark >= 0, np.arange(len(mark)), -1))
    on = np.concatenate([[False], (mark[known] == 1) & (known >= 0), [False]])
    edges = np.flatnonzero(on[1:] != on[:-1])
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def clips(samples: bytes, rate: int = RATE):
    """Blocks of fixed-shape tensors (clips x CLIP x MELS, float16; the last clip is filled with zeros), then the energies of all frames."""
    energies = []
    for frames, energy in log_mel(samples, rate):
        energies.append(energy.astype(np.float32))
        pad = -len(frames) % CLIP
        filled = np.concatenate([frames, np.zeros((pad, MELS), np.float32)]) if pad else frames
        yield pa.FixedShapeTensorArray.from_numpy_ndarray(np.ascontiguousarray(filled.reshape(-1, CLIP, MELS).astype(np.float16)))
    yield np.concatenate(energies)


def feature(samples: bytes, rate: int = RATE) -> str:
    """frames:segments:active frames:digest of the tensors and of the segments' time spans."""
    digest, energy = hashlib.sha256(), None
    for block in clips(samples, rate):
        if isinstance(block, np.ndarray):
            energy = block
        else:
            digest.update(block.storage.flatten().to_numpy(zero_copy_only=False).tobytes())
    spans, step = segments(energy), HOP * DOWN / UP / rate
    digest.update(",".join(f"{a * step:.3f}-{b * step:.3f}" for a, b in spans).encode())
    return f"{len(energy)}:{len(spans)}:{sum(b - a for a, b in spans)}:{digest.hexdigest()[:32]}"


def media_digest(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep and, of each text stored as audio and read back: n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    Null text: empty, so a payload of 576 bytes.
    """
    kinds = {f.name: f.dataType for f in docs.schema}
    added = {"n_bytes": LongType(), "payload_bytes": LongType(), "payload_sha256": StringType(), "tail_crc32": LongType(), "media_bytes": LongType(), "media_sha256": StringType(), "feature": StringType()}
    keep = kept(keep, list(added))
    schema = StructType([StructField(c, kinds[c]) for c in keep] + [StructField(c, t) for c, t in added.items()])
    arrow, n = arrow_schema(schema), len(keep)

    def run(batches):
        for b in batches:
            for low in range(0, b.num_rows, 1000):
                part, out = b.slice(low, 1000), []
                for text in part.column(n):
                    raw = (text.as_py() or "").encode()
                    media = to_wav(payload(raw))
                    rate, back = from_wav(media)
                    out.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(back, rate)))
                yield pa.RecordBatch.from_arrays([part.column(i).cast(arrow.field(i).type) for i in range(n)] + [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), list(arrow)[n:], strict=True)], schema=arrow)

    return docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.col(text_col).alias("_text")).mapInArrow(run, schema)


def audio_clips(media: DataFrame, media_col: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per clip of each WAVE file: the columns in keep, clip, start_s, end_s, active (share of frames in segments) and tensor (CLIP * MELS floats, row by row).

    Null media: no rows.  tensors() turns the tensor column of a collected batch into an Arrow fixed-shape tensor array.
    """
    keep = kept(keep, ["clip", "start_s", "end_s", "active", "tensor"])
    kinds = {f.name: f.dataType for f in media.schema}
    schema = StructType([StructField(c, kinds[c]) for c in keep]).add("clip", "long").add("start_s", "double").add("end_s", "double").add("active", "double").add("tensor", ArrayType(FloatType()))
    arrow, n = arrow_schema(schema), len(keep)

    def run(batches):
        for b in batches:
            for i, m in enumerate(b.column(n)):
                if not m.is_valid:
                    continue
                rate, back = from_wav(m.as_py())
                *blocks, energy = clips(back, rate)
                on, step, at = np.zeros(len(energy) + 1), HOP * DOWN / UP / rate, 0
                for x, y in segments(energy):
                    on[x:y] = 1
                for block in blocks:
                    tensor = block.to_numpy_ndarray().astype(np.float32).reshape(len(block), -1)
                    clip = at + np.arange(len(block))
                    first, last = clip * CLIP, np.minimum((clip + 1) * CLIP, len(energy))
                    share = [float(on[x:y].mean()) for x, y in zip(first, last, strict=True)]
                    values = [pa.array([b.column(k)[i].as_py()] * len(block), arrow.field(k).type) for k in range(n)]
                    values += [pa.array(clip, pa.int64()), pa.array(first * step), pa.array(((last - 1) * HOP + FRAME) * step / HOP), pa.array(share)]
                    values.append(pa.ListArray.from_arrays(pa.array(np.arange(len(block) + 1, dtype=np.int32) * (CLIP * MELS)), pa.array(tensor.ravel())))
                    yield pa.RecordBatch.from_arrays([v.cast(f.type) for v, f in zip(values, arrow, strict=True)], schema=arrow)
                    at += len(block)

    return media.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.col(media_col).alias("_media")).mapInArrow(run, schema)


def tensors(column) -> pa.FixedShapeTensorArray:
    """A tensor column (lists of CLIP * MELS floats) as an Arrow fixed-shape tensor array."""
    flat = pa.array(column, pa.list_(pa.float32(), CLIP * MELS)) if not isinstance(column, pa.Array) else column.cast(pa.list_(pa.float32(), CLIP * MELS))
    return pa.ExtensionArray.from_storage(pa.fixed_shape_tensor(pa.float32(), (CLIP, MELS)), flat)

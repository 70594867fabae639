"""Audio features of media columns: polyphase resampling, log-mel filterbanks, energy segments.

A payload of bytes is kept losslessly as 8-bit PCM in a WAV file. The stored file is read back, resampled by
a polyphase filter, cut into overlapped frames for a log-mel filterbank, and segmented by frame energy with
hysteresis. Features are tensors of one fixed shape per file, with the time span of each of their rows; the shape is in
the column's metadata, and with_tensors() gives any batch of them as Arrow's fixed-shape tensor type.
"""

from __future__ import annotations

import base64
import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm import text as tx

#: Samples a second as stored, and the resampling ratio.
RATE, UP, DOWN = 16000, 1, 2
#: Samples of a frame and of its step after resampling, mel bands, rows of the tensor.
FRAME, HOP, BANDS, ROWS = 256, 128, 24, 8
#: Decibels over the mean energy at which a segment begins, and under which it ends.
RISE, FALL = 1.5, -1.5
PAD = 64


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    held = io.BytesIO()
    with wave.open(held, "wb") as out:
        out.setnchannels(1)
        out.setsampwidth(1)
        out.setframerate(rate)
        out.writeframes(payload)
    return held.getvalue()


def from_wav(stored: bytes) -> tuple[bytes, int]:
    with wave.open(io.BytesIO(stored)) as read:
        return read.readframes(read.getnframes()), read.getframerate()


def _low_pass(up: int, down: int, half: int = 8) -> np.ndarray:
    """A windowed sinc that cuts at the lower of both Nyquist frequencies."""
    widest = max(up, down)
    t = np.arange(-half * widest, half * widest + 1)
    return (np.sinc(t / widest) * np.hamming(len(t)) * up / widest).astype(np.float32)


def resample(x: np.ndarray, up: int = UP, down: int = DOWN) -> np.ndarray:
    """Polyphase: each output takes only the taps that meet a sample, never the zeros between them."""
    taps = _low_pass(up, down)
    half = len(taps) // 2
    n = -(-len(x) * up // down)
    out = np.zeros(n, np.float32)
    for phase in range(up):
        at = np.arange(phase, n, up)  # outputs whose place times down has one remainder modulo up
        if not len(at):
            continue
        centre = at[0] * down
        shift = (centre + half) % up
        own = taps[shift::up]  # tap k meets sample (place + half - k) / up
        first = (centre + half - shift) // up
        need = first + (len(at) - 1) * down + 1
        padded = np.zeros(max(need, 0) + len(own), np.float32)
        held = x[: max(need, 0)]
        padded[len(own) - 1 : len(own) - 1 + len(held)] = held
        frames = np.lib.stride_tricks.sliding_window_view(padded, len(own))[first : first + (len(at) - 1) * down + 1 : down]
        out[at] = frames @ own[::-1]
    return out


def _filterbank(rate: float) -> np.ndarray:
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(20), mel(rate / 2), BANDS + 2) / 2595) - 1)
    at = np.arange(FRAME // 2 + 1) * rate / FRAME
    rise = (at - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    fall = (edges[2:, None] - at) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32).T


_BANK = _filterbank(RATE * UP / DOWN)
_TAPER = np.hanning(FRAME).astype(np.float32)


def log_mel(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """frames x bands of log energies, and the energy of each frame in decibels. Zeros fill the last frame, so that every sample lies in one."""
    short = FRAME - len(x) if len(x) < FRAME else -(len(x) - FRAME) % HOP
    if short:
        x = np.concatenate([x, np.zeros(short, np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    mel, energy = [], []
    for low in range(0, len(frames), 512):  # bounded, however long the file
        part = frames[low : low + 512] * _TAPER
        power = np.abs(np.fft.rfft(part, axis=1).astype(np.complex64)) ** 2
        mel.append(np.log1p(power @ _BANK))
        energy.append(10 * np.log10((part**2).mean(1) + 1e-6))
    return np.concatenate(mel), np.concatenate(energy)


def segments(energy: np.ndarray, rise: float = RISE, fall: float = FALL) -> list[tuple[int, int]]:
    """Runs of frames that stay over the lower threshold and reach the upper one, both about the mean."""
    level = energy - energy.mean()
    over = np.concatenate([[False], level > fall, [False]])
    edges = np.flatnonzero(over[1:] != over[:-1]).reshape(-1, 2)
    peaks = np.concatenate([[0], np.cumsum(level >= rise)])
    return [(int(a), int(b)) for a, b in edges if peaks[b] > peaks[a]]


def features(payload: bytes, rate: int = RATE) -> tuple[np.ndarray, list[tuple[float, float]], list[tuple[float, float]]]:
    """A ROWS x BANDS tensor of mean log-mel energies over equal parts, the time span of each row, and the segments' spans."""
    x = (np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128
    mel, energy = log_mel(resample(x))
    cuts = np.linspace(0, len(mel), ROWS + 1)
    low = np.minimum(cuts[:-1].astype(int), len(mel) - 1)
    high = np.maximum(np.ceil(cuts[1:]).astype(int), low + 1)
    sums = np.concatenate([np.zeros((1, BANDS)), np.cumsum(mel, axis=0, dtype=np.float64)])
    tensor = np.round((sums[high] - sums[low]) / (high - low)[:, None], 3).astype(np.float32)
    second = HOP * DOWN / UP / rate
    return tensor, [(a * second, b * second) for a, b in zip(low.tolist(), high.tolist(), strict=True)], [(a * second, b * second) for a, b in segments(energy)]


def tensor_array(rows: list[np.ndarray]) -> pa.FixedShapeTensorArray:
    """The tensors of many files as one Arrow array of fixed shape."""
    flat = np.stack(rows) if rows else np.zeros((0, ROWS, BANDS), np.float32)
    kind = pa.fixed_shape_tensor(pa.float32(), (ROWS, BANDS))
    return pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(pa.array(flat.ravel()), ROWS * BANDS))


def with_tensors(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A batch of encode_media's rows, as mapInArrow gets it, with the tensor column in Arrow's fixed-shape tensor type."""
    column = batch.column("tensor")
    flat = column.flatten() if isinstance(column, pa.ListArray) else column
    kind = pa.fixed_shape_tensor(pa.float32(), (ROWS, BANDS))
    tensor = pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(flat, ROWS * BANDS))
    return batch.set_column(batch.schema.get_field_index("tensor"), pa.field("tensor", kind), tensor)


def feature_string(tensor: np.ndarray, found: list[tuple[float, float]], rate: int = RATE) -> str:
    """The tensor's shape, its values in hundredths (16 bits each, base64) and the segments in frames."""
    second = HOP * DOWN / UP / rate
    spans = ",".join(f"{round(a / second)}-{round(b / second)}" for a, b in found)
    return f"{ROWS}x{BANDS}:{base64.b64encode(np.rint(tensor * 100).astype('<i2').tobytes()).decode()}:{spans}"


def read_feature(feature: str) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The tensor and the segments of a feature string."""
    shape, held, spans = feature.split(":")
    values = np.frombuffer(base64.b64decode(held), "<i2").reshape(*map(int, shape.split("x"))) / 100
    return values, [(int(a), int(b)) for a, b in (s.split("-") for s in spans.split(",") if s)]


def encode_media(docs: DataFrame, pad: int = PAD, rate: int = RATE, key: str = "doc_id", text: str = "text", keep_media: bool = True) -> DataFrame:
    """One row per text with its WAV file (unless keep_media is off), digests of both, tensor, spans and segments.

    The payload is the UTF-8 text with zero bytes up to a positive multiple of pad; null is the empty text.
    Every file has at least one frame, so features are defined for all; silence has one segment or none. Equal
    texts have equal values, repeated rows each a row, an empty table gives an empty one, and further columns
    are not read. Spark keeps a tensor as its ROWS x BANDS floats in row order, with the shape in the column's metadata;
    feature is tensor and segments in one string (read_feature).
    """
    spans = pa.list_(pa.list_(pa.float64()))
    schema = "key long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, media binary, tensor array<float>, spans array<array<double>>, segments array<array<double>>, feature string"
    names = [x.split(" ")[0] for x in schema.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), None, spans, spans, pa.string()]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in tx.slices(batch.column(1)):
                rows, tensors = [], []
                for row in range(high - low):
                    raw = data[offsets[row] : offsets[row + 1]].tobytes()
                    stored = to_wav(raw + bytes(-len(raw) % pad or (pad if not raw else 0)), rate)
                    payload, at = from_wav(stored)
                    tensor, spans_, found = features(payload, at)
                    tensors.append(tensor)
                    rows.append((len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), stored if keep_media else None, None, spans_, found, feature_string(tensor, found, at)))
                columns = list(zip(*rows, strict=True))
                arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True) if t is not None]
                storage = tensor_array(tensors).storage
                arrays.insert(7, pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * (ROWS * BANDS)), storage.flatten()))
                yield pa.RecordBatch.from_arrays([batch.column(0)[low:high], *arrays], names)

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return tx.arrow_map(rows, emit, schema).withMetadata("tensor", {"shape": [ROWS, BANDS]}).withColumnRenamed("key", key)

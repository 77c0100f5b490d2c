"""Audio columns: payloads as 8-bit PCM WAV, and log-mel features with energy segments.

``encode_wav`` stores bytes losslessly as unsigned 8-bit mono samples. ``audio_features`` resamples
with a polyphase filter, computes overlapped log-mel filterbanks, segments by energy with
hysteresis, and returns the features as blocks of one fixed shape, each an Arrow
``fixed_shape_tensor`` (float32) in an IPC stream, with the block's time span. All sums are made in
double precision.

Defined results: null or empty audio gives no block and no segment. Audio of any length is read
whole, ``BLOCK_FRAMES`` frames at a time; the last block is padded with the floor value and its
span ends with the audio. Equal bytes give equal features. Repeated rows and further columns pass
through; a column that bears the name of an added one gets ``_`` appended.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import apart, col


@dataclass(frozen=True)
class AudioConfig:
    rate: int = 16000  # of the stored samples
    up: int = 2  # resampling ratio up / down
    down: int = 5
    taps: int = 16  # filter taps for each phase
    frame: int = 256
    hop: int = 128
    mels: int = 32
    block_frames: int = 64
    open_db: float = -12.0  # a segment opens above, and closes below, these levels against the loudest frame
    close_db: float = -18.0
    floor: float = 1e-6

    @property
    def out_rate(self) -> float:
        return self.rate * self.up / self.down


def encode_wav(payload: bytes, rate: int = 16000) -> bytes:
    """RIFF/WAVE, PCM, mono, unsigned 8 bit; the samples are the payload's bytes."""
    pad = b"\0" * (len(payload) % 2)
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate, 1, 8)
    data = struct.pack("<4sI", b"data", len(payload)) + payload + pad
    return struct.pack("<4sI4s", b"RIFF", 4 + len(fmt) + len(data), b"WAVE") + fmt + data


def decode_wav(stored: bytes) -> tuple[int, bytes]:
    """(rate, samples) of a WAV file as written by ``encode_wav``; other chunks are skipped."""
    if stored[:4] != b"RIFF" or stored[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    rate, at = 0, 12
    while at + 8 <= len(stored):
        name, size = struct.unpack_from("<4sI", stored, at)
        if name == b"fmt ":
            rate = struct.unpack_from("<I", stored, at + 12)[0]
        elif name == b"data":
            return rate, stored[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


@lru_cache
def _filters(cfg: AudioConfig) -> np.ndarray:
    """Windowed-sinc low-pass split into ``up`` phases (rows), each ``taps`` long."""
    n = cfg.taps * cfg.up
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / max(cfg.up, cfg.down)) * np.hamming(n)
    h *= cfg.up / h.sum()
    return np.ascontiguousarray(h.reshape(cfg.taps, cfg.up).T[:, ::-1])


@lru_cache
def _mel_matrix(cfg: AudioConfig) -> np.ndarray:
    """Triangular filters evenly spaced on the mel scale, (frame // 2 + 1) x mels."""
    top = 2595 * np.log10(1 + cfg.out_rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, cfg.mels + 2) / 2595) - 1)
    freq = np.linspace(0, cfg.out_rate / 2, cfg.frame // 2 + 1)[:, None]
    rise = (freq - edges[:-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[2:] - freq) / (edges[2:] - edges[1:-1])
    return np.clip(np.minimum(rise, fall), 0, None)


@lru_cache
def _taper(n: int) -> np.ndarray:
    return np.hanning(n)


def resample(x: np.ndarray, cfg: AudioConfig) -> np.ndarray:
    """Polyphase resampling: output sample m is phase (m * down) % up at input m * down // up."""
    if not len(x):
        return np.zeros(0, np.float64)
    phases = _filters(cfg)
    n_out = -(-len(x) * cfg.up // cfg.down)
    padded = np.concatenate([np.zeros(cfg.taps - 1, np.float64), x])
    windows = np.lib.stride_tricks.sliding_window_view(padded, cfg.taps)
    out = np.empty(n_out, np.float64)
    for k in range(cfg.up):  # outputs k, k + up, k + 2 up ... use one phase and an even input stride
        count = len(range(k, n_out, cfg.up))
        at = k * cfg.down // cfg.up
        out[k :: cfg.up] = windows[at :: cfg.down][:count] @ phases[k * cfg.down % cfg.up]
    return out


def log_mel(x: np.ndarray, cfg: AudioConfig) -> tuple[np.ndarray, np.ndarray]:
    """(frames x mels log energies, energy of each frame); short audio is padded to one frame."""
    if not len(x):
        return np.zeros((0, cfg.mels), np.float64), np.zeros(0, np.float64)
    count = max(1, -(-(len(x) - cfg.frame) // cfg.hop) + 1)
    padded = np.concatenate([x, np.zeros(max(0, (count - 1) * cfg.hop + cfg.frame - len(x)), np.float64)])
    frames = np.lib.stride_tricks.sliding_window_view(padded, cfg.frame)[:: cfg.hop]
    mel, energy = [], []
    for at in range(0, count, 2048):
        part = frames[at : at + 2048]
        spectrum = np.fft.rfft(part * _taper(cfg.frame))
        power = spectrum.real**2 + spectrum.imag**2
        mel.append(np.log(power @ _mel_matrix(cfg) + cfg.floor))
        energy.append(np.einsum("ij,ij->i", part, part) / cfg.frame)
    return np.concatenate(mel), np.concatenate(energy)


def segments(energy: np.ndarray, cfg: AudioConfig) -> np.ndarray:
    """(first frame, end frame) of runs above ``close_db`` that reach ``open_db`` somewhere."""
    if not len(energy) or energy.max() <= 0:
        return np.zeros((0, 2), np.int64)
    db = 10 * np.log10(np.maximum(energy / energy.max(), 1e-12))
    above = np.concatenate([[0], (db >= cfg.close_db).view(np.int8), [0]])
    begin, end = np.flatnonzero(np.diff(above) == 1), np.flatnonzero(np.diff(above) == -1)
    opened = np.concatenate([[0], np.cumsum(db >= cfg.open_db)])
    hit = opened[end] > opened[begin]
    return np.stack([begin[hit], end[hit]], axis=1)


def tensor_bytes(blocks: np.ndarray) -> bytes:
    """Blocks (n x frames x mels) as an Arrow IPC stream with one fixed_shape_tensor column."""
    tensors = pa.FixedShapeTensorArray.from_numpy_ndarray(np.ascontiguousarray(blocks))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([pa.field("log_mel", tensors.type)])) as writer:
        writer.write_batch(pa.record_batch([tensors], names=["log_mel"]))
    return sink.getvalue().to_pybytes()


def tensor_array(stored: bytes) -> np.ndarray:
    column = pa.ipc.open_stream(stored).read_all().column(0)
    return column.combine_chunks().to_numpy_ndarray() if column.num_chunks else np.zeros((0, 0, 0), np.float32)


def features_of(samples: bytes, cfg: AudioConfig) -> dict:
    """Blocks, their time spans in seconds and the segments' time spans of one audio."""
    x = (np.frombuffer(samples, np.uint8).astype(np.float64) - 128) / 128
    y = resample(x, cfg)
    mel, energy = log_mel(y, cfg)
    n = -(-len(mel) // cfg.block_frames)
    blocks = np.full((n * cfg.block_frames, cfg.mels), np.log(np.float32(cfg.floor)), np.float32)
    blocks[: len(mel)] = mel
    step, length = cfg.hop * cfg.block_frames / cfg.out_rate, len(y) / cfg.out_rate
    spans = [(k * step, min(length, (k + 1) * step + (cfg.frame - cfg.hop) / cfg.out_rate)) for k in range(n)]
    found = segments(energy, cfg)
    times = [(a * cfg.hop / cfg.out_rate, min(length, ((b - 1) * cfg.hop + cfg.frame) / cfg.out_rate)) for a, b in found.tolist()]
    return {"blocks": blocks.reshape(n, cfg.block_frames, cfg.mels), "spans": spans, "segments": times, "mel": mel}


def digest(mel: np.ndarray) -> int:
    """crc32 of log energies rounded to eighths, as little-endian 16-bit integers."""
    return zlib.crc32(np.round(mel * 8).astype("<i2").tobytes())


_SPAN = "array<struct<start:double,end:double>>"


def audio_features(media: DataFrame, column: str, cfg: AudioConfig = AudioConfig(), keep: list[str] | None = None) -> DataFrame:
    """Add ``payload`` (samples read back), ``log_mel`` (tensor stream), ``spans``, ``segments``, ``level`` and ``digest``.

    ``level`` is the mean log energy; ``digest`` is a crc32 of the energies rounded to eighths, so that
    processors which differ in the last bits of a sum still agree.
    """
    keep = [c for c in media.columns if c != column] if keep is None else keep
    names = [f"__k{i}" for i in range(len(keep))]
    plain = media.select(*[col(c).alias(n) for c, n in zip(keep, names)], col(column).alias("__media"))
    added = T.StructType().add("payload", "binary").add("log_mel", "binary").add("spans", T._parse_datatype_string(_SPAN)).add("segments", T._parse_datatype_string(_SPAN)).add("level", "double").add("digest", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.list_(pa.struct([("start", pa.float64()), ("end", pa.float64())]))
        pairs = lambda spans: [{"start": a, "end": b} for a, b in spans]
        for batch in batches:
            at, size = 0, batch.num_rows
            while at < size:  # a few rows at a time bound the memory of tensors
                part, at = batch.slice(at, 64), at + 64
                rows = []
                for value in part.column(part.num_columns - 1):
                    stored = value.as_py()
                    payload = decode_wav(stored)[1] if stored else b""
                    f = features_of(payload, cfg)
                    rows.append((payload, tensor_bytes(f["blocks"]) if len(f["blocks"]) else None, pairs(f["spans"]), pairs(f["segments"]), float(np.mean(f["mel"], dtype=np.float64)) if len(f["mel"]) else None, digest(f["mel"]) if len(f["mel"]) else None))
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.binary()), pa.array(cols[2], kinds), pa.array(cols[3], kinds), pa.array(cols[4], pa.float64()), pa.array(cols[5], pa.int64())],
                    names=[*part.schema.names[:-1], *added.names],
                )

    out = plain.mapInArrow(run, T.StructType([*plain.schema.fields[:-1], *added.fields]))
    return out.select(*[F.col(n).alias(c) for c, n in zip(apart(keep, added.names), names)], *added.names)


def with_wav(docs: DataFrame, payload: str, keep: list[str], rate: int = 16000) -> DataFrame:
    """Store the binary column ``payload`` as WAV in a new column ``media`` (header and pad built by Spark)."""
    size = F.octet_length(col(payload)).cast("long")
    pad = size % 2

    def little(n, width: int):
        digits = F.lpad(F.hex(n), 2 * width, "0")
        return F.unhex(F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(width))]))

    word = lambda s: F.lit(s.encode()).cast("binary")
    fixed = F.lit(struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate, 1, 8))
    media = F.concat(word("RIFF"), little(size + pad + 36, 4), word("WAVE"), fixed, word("data"), little(size, 4), col(payload), F.when(pad == 1, F.unhex(F.lit("00"))).otherwise(F.unhex(F.lit(""))))
    return docs.select(*[col(c).alias(n) for c, n in zip(keep, apart(keep, ["media"]))], media.alias("media"))

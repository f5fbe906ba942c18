"""Audio features from stored 8-bit samples: polyphase resampling, log-mel filterbanks, hysteresis segmentation.

Payloads are kept as mono 8-bit PCM WAV files in a binary column. Features come from the stored bytes: samples are
resampled by a windowed-sinc polyphase filter, cut into frames that overlap by half, and turned into log-mel energies;
a segment begins where a frame's energy passes the upper threshold and ends where it falls under the lower one (both
relative to the file's own median, or to NOISE_DB where no frame stands out from the median). Each segment is stored as tensors of the fixed shape (FRAMES, MELS), the last
padded with its own floor, each with its time span.

Texts as media: `payload` gives the UTF-8 of a text with zero bytes up to a positive multiple of 64.
Defined cases: a null text is empty (64 zero bytes); files shorter than a frame are one padded frame, and the last
frame of others is padded; a silent file has no segment and no tensor, an even one is a single segment; equal payloads give equal values. Long files are resampled in blocks.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filesystem, new_dir, session, stored

RATE, UP, DOWN, TAPS = 16_000, 2, 3, 16
FRAME, HOP, MELS, FRAMES = 256, 128, 20, 32
#: Hysteresis thresholds in dB over the file's median frame energy.
RISE_DB, FALL_DB = 0.3, 0.0
#: Level in dB between silence (-67) and the least that 8-bit samples can say: a file of one frame has no other floor.
NOISE_DB = -60.0
BLOCK = 1 << 18


def payload(text: str | None) -> bytes:
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data))


def to_wav(data: bytes, rate: int = RATE) -> bytes:
    """A mono 8-bit PCM file with these samples, byte for byte."""
    pad = b"\0" * (len(data) & 1)
    head = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(data))
    return b"RIFF" + struct.pack("<I", len(head) + len(data) + len(pad)) + head + data + pad


def from_wav(wav: bytes) -> tuple[int, bytes]:
    """Rate and samples of such a file."""
    if wav[:4] != b"RIFF" or wav[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, rate = 12, 0
    while at < len(wav):
        kind, n = wav[at : at + 4], struct.unpack_from("<I", wav, at + 4)[0]
        if kind == b"fmt ":
            _, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", wav, at + 8)
            if (channels, bits) != (1, 8):
                raise ValueError("only mono 8-bit samples are read")
        elif kind == b"data":
            return rate, wav[at + 8 : at + 8 + n]
        at += 8 + n + (n & 1)
    raise ValueError("no samples")


@lru_cache
def branches(up: int, down: int, taps: int) -> np.ndarray:
    """The polyphase branches of a Hann-windowed sinc low-pass: row p filters the outputs of phase p."""
    cut, n = 1 / max(up, down), taps * max(up, down)
    at = np.arange(n) - (n - 1) / 2
    h = np.sinc(at * cut) * cut * np.hanning(n + 2)[1:-1]
    h *= up / h.sum()
    return np.pad(h, (0, -len(h) % up)).reshape(-1, up).T.astype(np.float32)[:, ::-1].copy()


def resampled(x: np.ndarray, up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """x at up/down times its rate; each output sample costs one branch, not the whole filter."""
    h = branches(up, down, taps)
    k, n = h.shape[1], -(-len(x) * up // down)
    x = np.concatenate([np.zeros(k - 1, np.float32), x, np.zeros(k, np.float32)])
    out = np.empty(n, np.float32)
    for first in range(min(up, n)):  # outputs first, first + up, ...: all of one phase
        phase, start = first * down % up, first * down // up
        windows = sliding_window_view(x, k)[start::down]
        count = -(-(n - first) // up)
        for i in range(0, count, BLOCK):
            out[first + i * up : first + min(count, i + BLOCK) * up : up][: min(count, i + BLOCK) - i] = windows[i : min(count, i + BLOCK)] @ h[phase]
    return out


@lru_cache
def mel_bank(rate: int, frame: int = FRAME, mels: int = MELS) -> np.ndarray:
    """Triangular filters, even on the mel scale."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), mels + 2) / 2595) - 1)
    f = np.fft.rfftfreq(frame, 1 / rate)[:, None]
    up, down = (f - edges[:-2]) / np.diff(edges)[:-1], (edges[2:] - f) / np.diff(edges)[1:]
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


@lru_cache
def window(frame: int = FRAME) -> np.ndarray:
    return np.hanning(frame).astype(np.float32)


def log_mel(x: np.ndarray, rate: int) -> np.ndarray:
    """(frames, MELS) log energies in dB of frames of FRAME samples that start every HOP, the last one padded."""
    x = np.pad(x, (0, FRAME - len(x) if len(x) < FRAME else -(len(x) - FRAME) % HOP))
    frames = sliding_window_view(x, FRAME)[::HOP]
    out = [10 * np.log10((np.abs(np.fft.rfft(frames[i : i + 4096] * window(), axis=1)) ** 2).astype(np.float32) @ mel_bank(rate) + 1e-8) for i in range(0, len(frames), 4096)]
    return np.concatenate(out)


def segments(mel: np.ndarray) -> list[tuple[int, int]]:
    """Frame spans [start, end) where the energy, once over the upper threshold, has not yet fallen under the lower."""
    energy = 10 * np.log10((10 ** (mel / 10)).sum(1))
    mid = np.median(energy)
    if not (energy > mid + RISE_DB).any():
        mid = NOISE_DB
    # 1: on, -1: off, 0: as before
    state = np.where(energy > mid + RISE_DB, 1, np.where(energy <= mid + FALL_DB, -1, 0))
    at = np.maximum.accumulate(np.where(state != 0, np.arange(len(state)), -1))
    on = np.concatenate([[False], (at >= 0) & (state[np.maximum(at, 0)] > 0), [False]])
    edge = np.flatnonzero(on[1:] != on[:-1])
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def features(wav: bytes) -> tuple[np.ndarray, list[tuple[float, float]]]:
    """Tensors (n, FRAMES, MELS) as float16 and the time span in seconds of each."""
    rate, samples = from_wav(wav)
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    x -= x.mean()  # a constant offset would drown the rest
    x = np.pad(x, (0, TAPS * max(UP, DOWN)))  # what the filter still holds of the last samples
    mel = log_mel(resampled(x), rate * UP // DOWN)
    step, parts, spans = HOP * DOWN / (UP * rate), [], []
    for a, b in segments(mel):
        for i in range(a, b, FRAMES):
            part = mel[i : min(b, i + FRAMES)]
            spans.append((i * step, min(b, i + FRAMES) * step))
            parts.append(np.pad(part, ((0, FRAMES - len(part)), (0, 0)), constant_values=-80))
    return np.array(parts, np.float16).reshape(-1, FRAMES, MELS), spans


def store(docs: DataFrame, name: str = "media") -> DataFrame:
    """docs: doc_id, text. The stored media table: doc_id, n_bytes (of the text), media (a WAV file)."""
    spark = session(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            n = [len((t or "").encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array([to_wav(payload(t)) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    df = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(encode, "doc_id long, n_bytes long, media binary")
    path = new_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


FEATURES = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
    "file string, first_row long, spans array<struct<start:double,end:double>>, tensors_sha256 string"
)
TENSOR = pa.fixed_shape_tensor(pa.float16(), [FRAMES, MELS])
STORED = pa.schema([("doc_id", pa.int64()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("mel", TENSOR)])


def extracted(media: DataFrame, folder: str | None = None) -> tuple[str, DataFrame]:
    """media: doc_id, n_bytes, media, as store() gives it. Tensors go to Arrow IPC files (schema STORED) in the folder,
    a file a task; the rows (FEATURES) say where each document's tensors are, and their spans and digest."""
    folder = folder or new_dir(session(media.sparkSession), "tensors")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, place = filesystem(folder)
        fs.create_dir(place, recursive=True)
        name, at, out = f"{uuid.uuid4().hex}.arrow", 0, None
        for b in batches:
            rows, ids, tensors, times = [], [], [], []
            for doc_id, n, wav in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                samples = from_wav(wav)[1]
                mel, spans = features(wav)
                rows.append((
                    doc_id, n, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), len(wav), hashlib.sha256(wav).hexdigest(),
                    name, at + len(ids), [{"start": s, "end": e} for s, e in spans], hashlib.sha256(mel.tobytes()).hexdigest(),
                ))
                ids += [doc_id] * len(spans)
                tensors.append(mel)
                times += spans
            if ids:
                if out is None:
                    file = fs.open_output_stream(f"{place}/{name}", compression=None)
                    out = pa.ipc.new_file(file, STORED, options=pa.ipc.IpcWriteOptions(compression="zstd"))
                flat = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(tensors).ravel()), FRAMES * MELS)
                mel = pa.ExtensionArray.from_storage(TENSOR, flat)
                out.write_batch(pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array([t[i] for t in times], pa.float64()) for i in (0, 1)), mel], schema=STORED))
                at += len(ids)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], NAMES)
        if out is not None:
            out.close()
            file.close()

    # stored at once: tensors are written by the tasks of this one job, whatever is done with the rows later
    return folder, stored(media.select("doc_id", "n_bytes", "media").mapInArrow(run, FEATURES), "features")


NAMES = "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 file first_row spans tensors_sha256".split()
TYPES = [
    pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(),
    pa.list_(pa.struct([("start", pa.float64()), ("end", pa.float64())])), pa.string(),
]

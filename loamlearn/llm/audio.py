"""Audio features of 8-bit media: polyphase resampling, log-mel filterbanks, energy segments.

A payload is stored as a WAV container of unsigned 8-bit samples, mono, without loss; features are
computed from the samples that are read back, and stored as an Arrow record: a tensor of fixed shape and
the time spans of its segments. Everything is done record by record, so equal payloads give equal
bytes and equal features wherever they are. Samples are resampled and transformed in slices of
``SLICE`` frames: beside the record's bytes, memory holds a slice and a number a frame.

Defined cases: null text is an empty payload and becomes one block of padding; a container without
samples has no frames, no segments and a tensor of zeros; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back

#: Block to which payloads are padded, and the byte that pads.
BLOCK, PAD = 576, 255
RATE = 8000
#: Resampling to UP / DOWN of the rate, with TAPS coefficients in each of the UP phases.
UP, DOWN, TAPS = 3, 4, 16
FRAME, HOP, N_FFT, N_MEL = 256, 128, 256, 20
#: The fixed shape of a record's tensor: cells of time by mel bands.
CELLS = 8
SLICE = 2048
#: A segment opens above the high mark and closes below the low one (shares of the mean energy); shorter ones go.
HIGH, LOW, LEAST_FRAMES = 1.15, 0.9, 3


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    pad = b"\0" * (len(payload) % 2)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + len(pad), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload)) + payload + pad


def from_wav(media: bytes) -> tuple[bytes, int]:
    """The samples' bytes and the rate; chunks may come in any order."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV container")
    at, rate, data = 12, 0, None
    while at + 8 <= len(media):
        kind, n = struct.unpack_from("<4sI", media, at)
        if kind == b"fmt ":
            rate = struct.unpack_from("<I", media, at + 12)[0]
        elif kind == b"data":
            data = media[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    if data is None:
        raise ValueError("no data chunk")
    return data, rate


@cache
def phases(up: int = UP, down: int = DOWN) -> np.ndarray:
    """A windowed sinc for the lower of both rates, as ``up`` phases of TAPS coefficients."""
    n = up * TAPS
    t = (np.arange(n) - (n - 1) / 2) / max(up, down)
    taps = np.sinc(t) * np.hamming(n)
    return (taps / taps.sum() * up).reshape(TAPS, up).T.astype(np.float32).copy()


def resample(samples: np.ndarray, up: int = UP, down: int = DOWN, start: int = 0, end: int | None = None) -> np.ndarray:
    """Outputs ``start`` to ``end`` of the 8-bit samples, from -1 to 1, at up / down of their rate.

    Output k is phase (k * down) mod up applied to the TAPS samples that end at k * down // up; samples
    before the first are 0.
    """
    n_out = len(samples) * up // down
    end = n_out if end is None else min(end, n_out)
    out = np.zeros(max(0, end - start), np.float32)
    if not len(out):
        return out
    first, last = start * down // up - (TAPS - 1), (end - 1) * down // up
    x = (samples[max(0, first) : last + 1].astype(np.float32) - 128) / 128
    x = np.concatenate([np.zeros(max(0, -first), np.float32), x])
    taps = phases(up, down)
    for p in range(min(up, len(out))):  # outputs p, p + up, ... share a phase and step ``down`` samples
        k = start + p
        coef, at = taps[k * down % up], k * down // up - first
        got = out[p::up]
        m = len(got)
        for j in range(TAPS):
            got += coef[j] * x[at - j : at - j + (m - 1) * down + 1 : down]
    return out


@cache
def _mel() -> np.ndarray:
    top = RATE * UP / DOWN / 2
    to_mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, to_mel(top), N_MEL + 2) / 2595) - 1)
    f = np.linspace(0, top, N_FFT // 2 + 1)
    up = (f[:, None] - edges[None, :-2]) / (edges[1:-1] - edges[:-2])
    down = (edges[None, 2:] - f[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


def frames_of(n: int) -> int:
    """Overlapping frames over n resampled samples; the last one is filled up with zeros."""
    return 1 + max(0, -(-(n - FRAME) // HOP)) if n else 0


def log_mel(samples: np.ndarray):
    """(first frame, log-mel rows, energies) of each slice of overlapping frames."""
    total = len(samples) * UP // DOWN
    n = frames_of(total)
    window = np.hanning(FRAME).astype(np.float32)
    for at in range(0, n, SLICE):
        many = min(SLICE, n - at)
        x = resample(samples, start=at * HOP, end=(at + many - 1) * HOP + FRAME)
        x = np.concatenate([x, np.zeros((many - 1) * HOP + FRAME - len(x), np.float32)])
        part = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP] * window
        spectrum = np.fft.rfft(part, N_FFT)
        power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
        yield at, np.log10(np.maximum(power @ _mel(), 1e-6)), (part * part).mean(axis=1)


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """Frame spans by hysteresis: the state is the last mark that the energy crossed."""
    if not len(energy):
        return []
    mean = float(energy.mean(dtype=np.float64))
    mark = np.where(energy > HIGH * mean, 1, np.where(energy < LOW * mean, 0, -1))
    known = np.where(mark >= 0, np.arange(len(mark)), -1)
    last = np.maximum.accumulate(known)
    on = np.where(last >= 0, mark[np.maximum(last, 0)], 0)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], on, [0]])))
    return [(int(a), int(b)) for a, b in zip(edge[::2], edge[1::2], strict=True) if b - a >= LEAST_FRAMES]


def features(media: bytes) -> dict:
    """tensor, spans (seconds of each segment), n_frames, read from the stored form.

    The tensor holds CELLS x N_MEL means over equal shares of the time; a share without frames repeats
    the frame at its start.
    """
    raw, rate = from_wav(media)
    samples = np.frombuffer(raw, np.uint8)
    n = frames_of(len(samples) * UP // DOWN)
    cuts = np.arange(CELLS + 1) * n // CELLS
    lo, hi = cuts[:-1], np.maximum(cuts[1:], cuts[:-1] + 1)
    sums, energy = np.zeros((CELLS, N_MEL)), np.zeros(n, np.float32)
    for at, rows, power in log_mel(samples):
        energy[at : at + len(rows)] = power
        below = np.concatenate([np.zeros((1, N_MEL)), np.cumsum(rows, axis=0, dtype=np.float64)])
        sums += below[np.clip(hi - at, 0, len(rows))] - below[np.clip(lo - at, 0, len(rows))]
    step = HOP * DOWN / UP / max(rate, 1)
    tensor = (sums / (hi - lo)[:, None]).astype(np.float32)
    return {"tensor": tensor, "spans": [(round(a * step, 6), round((b - 1) * step + FRAME * DOWN / UP / max(rate, 1), 6)) for a, b in segments(energy)], "n_frames": n}


@cache
def _stored_schema():
    import pyarrow as pa

    return pa.schema([("n_frames", pa.int64()), ("log_mel", pa.fixed_shape_tensor(pa.float32(), (CELLS, N_MEL))), ("span_start", pa.list_(pa.float64())), ("span_end", pa.list_(pa.float64()))])


def to_arrow(f: dict) -> bytes:
    """The features as an Arrow stream of one record, whose tensor column has the fixed-shape tensor type."""
    import pyarrow as pa

    schema = _stored_schema()
    kind = schema.field("log_mel").type
    cells = pa.FixedSizeListArray.from_arrays(pa.array(f["tensor"].ravel()), CELLS * N_MEL)
    one = pa.record_batch([pa.array([f["n_frames"]]), pa.ExtensionArray.from_storage(kind, cells), pa.array([[a for a, _ in f["spans"]]], pa.list_(pa.float64())), pa.array([[b for _, b in f["spans"]]], pa.list_(pa.float64()))], schema=schema)
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, schema) as writer:
        writer.write_batch(one)
    return out.getvalue().to_pybytes()


def from_arrow(stored: bytes) -> dict:
    import pyarrow as pa

    with pa.ipc.open_stream(stored) as reader:
        one = reader.read_next_batch()
    spans = zip(one.column(2)[0].as_py(), one.column(3)[0].as_py(), strict=True)
    return {"n_frames": one.column(0)[0].as_py(), "tensor": one.column(1).storage.flatten().to_numpy().reshape(CELLS, N_MEL), "spans": list(spans)}


def feature_string(f: dict) -> str:
    """Frames, segments, first span and the tensor in sixteenths."""
    spans = f["spans"]
    first = f"{spans[0][0]:.3f}-{spans[0][1]:.3f}" if spans else "-"
    return f"{f['n_frames']};{len(spans)};{first};" + ",".join(map(str, np.round(f["tensor"].ravel() * 16).astype(int).tolist()))


def padded(payload: bytes) -> bytes:
    n = max(BLOCK, -(-len(payload) // BLOCK) * BLOCK)
    return payload + bytes([PAD]) * (n - len(payload))


#: The media columns. ``features`` is the stored record; what follows it is read back from it, the tensor row by row.
SCHEMA = "doc_id long, n_bytes long, media binary, payload_sha256 string, tail_crc32 long, payload_bytes long, media_bytes long, media_sha256 string, features binary, tensor array<float>, span_start array<double>, span_end array<double>, feature string"


def _columns(media: bytes, n_bytes: int, keep: bool) -> tuple:
    back, stored = from_wav(media)[0], to_arrow(features(media))
    f = from_arrow(stored)
    return n_bytes, media if keep else None, hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(back), len(media), hashlib.sha256(media).hexdigest(), stored if keep else None, f["tensor"].ravel(), [a for a, _ in f["spans"]], [b for _, b in f["spans"]], feature_string(f)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = True) -> DataFrame:
    """The columns of SCHEMA for every row; without keep_media the container and the stored record are null."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids, rows = batch.column(0), []
            for at, text in enumerate(batch.column(1)):
                payload = (text.as_py() or "").encode()
                rows.append((ids[at].as_py(), *_columns(to_wav(padded(payload)), len(payload), keep_media)))
                if len(rows) >= 512:  # containers of long texts don't pile up
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES(pa), strict=True)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES(pa), strict=True)], names)
        give_back()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def TYPES(pa) -> list:  # noqa: N802
    return [pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.float32()), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.string()]

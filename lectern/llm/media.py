"""Audio columns: bytes as 8-bit PCM, and features of the sound.

A payload is kept as a WAV file of unsigned 8-bit samples at 8 kHz, which loses nothing. Features come from the stored bytes
read back: the sound is resampled by 2/3 with a windowed-sinc filter in polyphase form (only the taps that meet a sample are
used), cut into half-overlapping frames, and turned into the log energies of mel bands. Frames count as active from where
their energy passes an upper level until it falls below a lower one; each such stretch is a segment with its time span.
Frames are grouped into tensors of fixed shape (FRAMES, BANDS), the last one filled up with its own last frame, each with its
time span, and kept as an Arrow record batch with a fixed-shape-tensor column.
Taps, window, sines and mel weights are whole numbers, and so is every sum over them (below 2**53, so that it is exact in any
order); logarithms are looked up. Features are therefore the same on every machine and however a sound is cut into blocks.
Sound is worked through in blocks, so memory is bounded by the payload and its features.

Defined cases: a null text is the empty one, whose payload is 576 bytes of 255; equal texts give equal values; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lectern.llm.common import slices, staged, table

UNIT, RATE = 576, 8000
UP, DOWN, TAPS = 2, 3, 12
FRAME, HOP, BANDS, FRAMES = 256, 128, 16, 32
BLOCK = 1024
#: Bits of the fractions of taps, window, sines and mel weights; bits dropped after the filter and the transform; steps of an octave.
TAP_BITS, WINDOW_BITS, SINE_BITS, MEL_BITS, DROP_SOUND, DROP_SPECTRUM, STEPS = 12, 8, 10, 6, 6, 18, 256
MADE = "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
KEPT = "media binary, tensors binary, segments array<struct<start_s:double,end_s:double>>"

KINDS = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]


def padded(data: bytes) -> bytes:
    return data + b"\xff" * (-len(data) % UNIT if data else UNIT)


def wav(payload: bytes) -> bytes:
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8)
    body = b"WAVE" + fmt + struct.pack("<4sI", b"data", len(payload)) + payload
    return b"RIFF" + struct.pack("<I", len(body)) + body


def samples(media: bytes) -> memoryview:
    """The payload of a WAV file of 8-bit samples."""
    view = memoryview(media)
    if bytes(view[:4]) != b"RIFF" or bytes(view[8:12]) != b"WAVE":
        raise ValueError("not a WAV file")
    at = 12
    while at < len(view):
        name, size = struct.unpack("<4sI", view[at : at + 8])
        if name == b"data":
            return view[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("a WAV file without data")


@lru_cache(maxsize=1)
def phases() -> np.ndarray:
    """A windowed-sinc low pass at the lower of both rates, one row of taps for each phase."""
    n = TAPS * UP
    t = (np.arange(n) - (n - 1) / 2) / UP
    cut = min(1.0, UP / DOWN)
    taps = np.sinc(t * cut) * np.hamming(n)
    rows = taps.reshape(TAPS, UP).T
    return np.rint(rows / rows.sum(1, keepdims=True) * 2**TAP_BITS).astype(np.int64)


@lru_cache(maxsize=1)
def mel_bank() -> np.ndarray:
    """Triangles, evenly spaced on the mel scale, over the bins of a frame's spectrum."""
    top = RATE * UP / DOWN / 2
    edges = 700 * (10 ** (np.linspace(0, 2595 * np.log10(1 + top / 700), BANDS + 2) / 2595) - 1)
    bins = np.linspace(0, top, FRAME // 2 + 1)
    rise = (bins[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[2:] - bins[:, None]) / (edges[2:] - edges[1:-1])
    return np.rint(np.maximum(0, np.minimum(rise, fall)) * 2**MEL_BITS)


@lru_cache(maxsize=1)
def window() -> np.ndarray:
    return np.rint(np.hanning(FRAME) * 2**WINDOW_BITS).astype(np.int64)


@lru_cache(maxsize=1)
def sines() -> np.ndarray:
    """Cosines, then sines, of a frame's bins, one row for each sample."""
    turns = 2 * np.pi / FRAME * (np.outer(np.arange(FRAME), np.arange(FRAME // 2 + 1)) % FRAME)
    return np.rint(np.concatenate([np.cos(turns), np.sin(turns)], axis=1) * 2**SINE_BITS)


@lru_cache(maxsize=1)
def mantissas() -> np.ndarray:
    """STEPS times the binary logarithm of 1 + k / 1024, rounded down; found with whole numbers."""
    return np.array([((1024 + k) ** STEPS).bit_length() - 1 - 10 * STEPS for k in range(1024)], np.int64)


def logarithms(x: np.ndarray) -> np.ndarray:
    """STEPS times the binary logarithm of 1 + x (its first eleven digits) for whole x."""
    part, power = np.frexp(x + 1)
    return STEPS * (power.astype(np.int64) - 1) + mantissas()[(part * 2048).astype(np.int64) - 1024]


def resampled(pcm: np.ndarray, first: int, n: int) -> np.ndarray:
    """n samples from number first on, at UP/DOWN of the rate; needs only the input around them."""
    out = np.zeros(n, np.int64)
    for p in range(UP):
        # output m reads input from (m * DOWN) // UP - TAPS + 1 on, with the taps of phase (m * DOWN) % UP
        at = next(i for i in range(UP) if (first + i) * DOWN % UP == p)
        if at >= n:
            continue
        count, low = -(-(n - at) // UP), (first + at) * DOWN // UP - TAPS + 1
        need = (count - 1) * DOWN + TAPS
        a, b = max(low, 0), min(low + need, len(pcm))
        held = np.zeros(need, np.int64)
        if b > a:
            held[a - low : b - low] = pcm[a:b].astype(np.int64) - 128
        total = out[at::UP]
        for k, tap in enumerate(phases()[p][::-1].tolist()):
            total += tap * held[k : k + (count - 1) * DOWN + 1 : DOWN]
    return out >> DROP_SOUND


def log_mels(pcm: np.ndarray) -> np.ndarray:
    """Log mel energies, STEPS to the octave, one row for each frame."""
    n = len(pcm) * UP // DOWN
    frames = 1 + max(0, n - FRAME) // HOP
    out = np.empty((frames, BANDS), np.int16)
    for a in range(0, frames, BLOCK):
        b = min(a + BLOCK, frames)
        sound = resampled(pcm, a * HOP, (b - a - 1) * HOP + FRAME)
        cut = (np.lib.stride_tricks.sliding_window_view(sound, FRAME)[::HOP] * window()).astype(np.float64)
        spectrum = np.floor(cut @ sines() / 2**DROP_SPECTRUM)
        power = spectrum[:, : FRAME // 2 + 1] ** 2 + spectrum[:, FRAME // 2 + 1 :] ** 2
        out[a:b] = logarithms(power @ mel_bank())
    return out


def active(mels: np.ndarray) -> np.ndarray:
    """First and last + 1 frame of each segment: on above the mean energy plus half a deviation, off below the mean."""
    energy = mels.sum(1, dtype=np.int64)
    n, total, squares = len(energy), int(energy.sum()), int((energy * energy).sum())
    over = n * energy - total  # n times what a frame has beyond the mean
    deviation = math.isqrt(n * squares - total * total)  # n times, rounded down
    sign = np.where(2 * over > deviation, 1, np.where(over < 0, -1, 0))
    said = np.maximum.accumulate(np.where(sign != 0, np.arange(n), 0))
    on = (sign[said] > 0).astype(np.int8)
    return np.flatnonzero(np.diff(np.concatenate([[0], on, [0]]))).reshape(-1, 2)


def seconds(frame: np.ndarray | int) -> np.ndarray | float:
    return frame * HOP * DOWN / UP / RATE


def tensors(mels: np.ndarray) -> bytes:
    """An Arrow stream: fixed-shape tensors with their time spans."""
    n = -(-len(mels) // FRAMES)
    filled = np.concatenate([mels, np.repeat(mels[-1:], n * FRAMES - len(mels), 0)])
    kind = pa.fixed_shape_tensor(pa.int16(), (FRAMES, BANDS))
    flat = pa.FixedSizeListArray.from_arrays(pa.array(filled.ravel()), FRAMES * BANDS)
    starts = np.arange(n) * FRAMES
    spans = [pa.array(seconds(starts)), pa.array(seconds(np.minimum(starts + FRAMES, len(mels)) - 1) + FRAME * DOWN / UP / RATE)]
    batch = pa.RecordBatch.from_arrays([pa.ExtensionArray.from_storage(kind, flat), *spans], names=["log_mel", "start_s", "end_s"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def frames_of(stream: bytes) -> np.ndarray:
    """The log mel energies that tensors() was given; the last time span says how many frames there are."""
    batch = pa.ipc.open_stream(stream).read_next_batch()
    flat = batch.column("log_mel").storage.flatten().to_numpy()
    n = round((batch.column("end_s")[-1].as_py() - FRAME * DOWN / UP / RATE) / seconds(1)) + 1
    return flat.reshape(-1, BANDS)[:n]


def digests(media: bytes, stream: bytes, segments: list[dict]) -> tuple:
    """The columns MADE, from the stored WAV file, tensors and segments. Bytes of 255 are filling, as no UTF-8 text has them."""
    payload = samples(media)
    mels = frames_of(stream)
    lengths = [round((s["end_s"] - s["start_s"] - FRAME * DOWN / UP / RATE) / seconds(1)) + 1 for s in segments]
    print_ = hashlib.sha256(mels.astype("<i4").tobytes()).hexdigest()[:16]
    feature = f"frames={len(mels)};bands={BANDS};tensors={pa.ipc.open_stream(stream).read_next_batch().num_rows};segments={len(segments)};active={sum(lengths)};log_mel={print_}"
    return len(bytes(payload).rstrip(b"\xff")), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature


def features(text: str | None) -> tuple:
    data = (text or "").encode()
    media = wav(padded(data))
    payload = samples(media)
    mels = log_mels(np.frombuffer(payload, np.uint8))
    spans = active(mels)
    print_ = hashlib.sha256(mels.astype("<i4").tobytes()).hexdigest()[:16]
    feature = f"frames={len(mels)};bands={BANDS};tensors={-(-len(mels) // FRAMES)};segments={len(spans)};active={int((spans[:, 1] - spans[:, 0]).sum())};log_mel={print_}"
    row = len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature
    return row, media, mels, spans


def _rows(column: str, names: list[str], keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column, 256):
            got = [features(x.as_py()) for x in batch.column(column)]
            more = [pa.array(x, t) for x, t in zip(zip(*(g[0] for g in got), strict=True), KINDS, strict=True)]
            if keep:
                ends = [[{"start_s": seconds(a), "end_s": seconds(b - 1) + FRAME * DOWN / UP / RATE} for a, b in g[3].tolist()] for g in got]
                more += [pa.array([g[1] for g in got], pa.binary()), pa.array([tensors(g[2]) for g in got], pa.binary()), pa.array(ends, pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())])))]
            rest = [c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != column]
            yield pa.RecordBatch.from_arrays([*rest, *more], names=names)

    return run


def audio_features(docs: DataFrame, text: str = "text", keep: bool = True) -> DataFrame:
    """docs without the text, with figures of the stored sound and its feature string; if keep, with media (WAV), tensors (an Arrow stream) and segments. Columns of these names give way."""
    ddl = f"{MADE}, {KEPT}" if keep else MADE
    made = [x.split()[0] for x in ddl.replace("start_s:double,end_s:double", "").split(", ")]
    docs = docs.drop(*[c for c in docs.columns if c.lower() in made])
    rest = [f for f in docs.schema.fields if f.name != text]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), ddl])
    return docs.mapInArrow(_rows(text, [*(f.name for f in rest), *made], keep), schema)


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "media", 256):
        got = [digests(m.as_py(), t.as_py(), s.as_py()) for m, t, s in zip(batch.column("media"), batch.column("tensors"), batch.column("segments"), strict=True)]
        more = [pa.array(x, k) for x, k in zip(zip(*got, strict=True), KINDS, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *more], names=["doc_id", *(x.split()[0] for x in MADE.split(", "))])


def op9_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media, tensors and segments are written for every document, and the digests come from what is read back."""
    made = audio_features(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "media", "tensors", "segments")
    stored = staged(made, "audio")
    return stored.mapInArrow(_read_back, f"doc_id {stored.schema['doc_id'].dataType.simpleString()}, {MADE}")

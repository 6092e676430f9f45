"""Audio columns: 8-bit samples, polyphase resampling, log-mel tensors and energy segments.

``encode`` stores a byte payload losslessly as a mono 8-bit WAV; ``features`` reads the stored
bytes back and yields fixed-shape log-mel tensors with time spans; ``digests`` gives one row per
recording. All three are narrow maps: no shuffle, no state between rows.

Cases: null text is empty; an empty text is one block of 64 zero bytes; a signal shorter than one
analysis frame is padded with silence; repeated rows give repeated, equal results; other columns of the input
are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .common import small_batches, texts

#: Payload bytes come in multiples of this.
BLOCK = 64
RATE = 8000
#: Polyphase resampling from RATE to RATE * UP / DOWN, TAPS filter taps a phase.
UP, DOWN, TAPS = 2, 5, 16
FRAME, HOP, MELS = 256, 128, 32
#: One stored tensor has this many frames; the last one of a recording is padded with its floor.
TENSOR_FRAMES = 32
#: Hysteresis: a segment opens HIGH above the recording's median frame energy (natural log) and closes below LOW.
HIGH, LOW = 0.35, 0.1
FLOOR, PLACES = 1e-6, 4


def payload_of(text: bytes) -> bytes:
    return text + bytes(-len(text) % BLOCK or (0 if text else BLOCK))


def wav_of(payload: bytes) -> bytes:
    """A RIFF file: one byte a sample, one channel."""
    return b"RIFF" + struct.pack("<I", 36 + len(payload)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload


def samples_of(wav: bytes) -> tuple[bytes, int]:
    """The sample bytes and the rate of a stored recording, found by walking its chunks."""
    if wav[:4] != b"RIFF" or wav[8:12] != b"WAVE":
        raise ValueError("not a RIFF recording")
    at, rate = 12, RATE
    while at + 8 <= len(wav):
        kind, size = wav[at : at + 4], struct.unpack_from("<I", wav, at + 4)[0]
        if kind == b"fmt ":
            rate = struct.unpack_from("<I", wav, at + 12)[0]
        if kind == b"data":
            return wav[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("a recording without samples")


@lru_cache(1)
def _design() -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Phase filters, analysis window and mel weights."""
    n = np.arange(UP * TAPS) - (UP * TAPS - 1) / 2
    cut = 1 / max(UP, DOWN)
    low = UP * cut * np.sinc(n * cut) * np.hamming(UP * TAPS)
    phases = [np.ascontiguousarray(low[p::UP][::-1]) for p in range(UP)]
    rate = RATE * UP / DOWN
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), MELS + 2) / 2595) - 1)
    bins = np.arange(FRAME // 2 + 1) * rate / FRAME
    up = (bins[:, None] - edges[None, :-2]) / np.diff(edges)[None, :-1]
    down = (edges[None, 2:] - bins[:, None]) / np.diff(edges)[None, 1:]
    return phases, np.hanning(FRAME), np.maximum(0, np.minimum(up, down))


def resample(x: np.ndarray) -> np.ndarray:
    """x at UP / DOWN times its rate: every output sample is one phase of the filter over its input window."""
    phases, _, _ = _design()
    n_out = -(-len(x) * UP // DOWN)
    windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.zeros(TAPS - 1), x, np.zeros(TAPS)]), TAPS)
    out = np.empty(n_out)
    for first in range(UP):
        place = out[first::UP]
        if len(place):
            rows = windows[first * DOWN // UP :: DOWN][: len(place)]
            place[:] = np.ascontiguousarray(rows) @ phases[first * DOWN % UP]
    return out


def log_mel(samples: bytes) -> np.ndarray:
    """Frames by MELS of natural-log mel energies of 8-bit samples.

    Computed in doubles and rounded to PLACES, so that equal samples have equal values whatever order a machine adds in."""
    _, window, weights = _design()
    y = resample((np.frombuffer(samples, np.uint8).astype(np.float64) - 128) / 128)
    if len(y) < FRAME:
        y = np.concatenate([y, np.zeros(FRAME - len(y), np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP]
    out = np.empty((len(frames), MELS), np.float32)
    for at in range(0, len(frames), 4096):
        spectrum = np.fft.rfft(frames[at : at + 4096] * window, axis=1)
        power = spectrum.real**2 + spectrum.imag**2
        out[at : at + 4096] = np.round(np.log(power @ weights + FLOOR), PLACES)
    return out


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """Half-open frame spans that open above median + HIGH and close below median + LOW."""
    middle = float(np.median(energy))
    above, below = energy >= middle + HIGH, energy < middle + LOW
    opens, closes = np.flatnonzero(above), np.flatnonzero(below)
    out: list[tuple[int, int]] = []
    at = 0
    while True:
        i = np.searchsorted(opens, at)
        if i == len(opens):
            return out
        start = int(opens[i])
        j = np.searchsorted(closes, start)
        at = int(closes[j]) if j < len(closes) else len(energy)
        out.append((start, at))


def milliseconds(frame: int) -> int:
    return round(frame * HOP * 1000 * DOWN / (RATE * UP))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each text as a stored recording."""
    small_batches(docs.sparkSession)

    def store(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            raw = texts(b)
            yield pa.record_batch([b.column("doc_id"), pa.array(map(len, raw), pa.int64()), pa.array([wav_of(payload_of(x)) for x in raw], pa.binary())], ["doc_id", "n_bytes", "media"])

    source = docs.selectExpr(f"`{id_col}` AS doc_id", f"CAST(`{text_col}` AS STRING) AS text")
    return source.mapInArrow(store, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def blocks_of(mel: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """First frames, ends and padded values (one row each) of the tensors of a recording, 64 at a time."""
    for at in range(0, len(mel), TENSOR_FRAMES * 64):
        part = mel[at : at + TENSOR_FRAMES * 64]
        blocks = -(-len(part) // TENSOR_FRAMES)
        held = np.full((blocks * TENSOR_FRAMES, MELS), np.float32(np.log(FLOOR)))
        held[: len(part)] = part
        starts = at + np.arange(blocks) * TENSOR_FRAMES
        yield starts, np.minimum(starts + TENSOR_FRAMES, len(mel)), held.reshape(blocks, TENSOR_FRAMES * MELS)


def features(media: DataFrame) -> DataFrame:
    """doc_id, block, start_ms, end_ms, log_mel: TENSOR_FRAMES x MELS floats a row (``tensors`` views them as Arrow tensors)."""

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for doc, wav in zip(b.column("doc_id").to_pylist(), b.column("media").to_pylist(), strict=True):
                for starts, ends, held in blocks_of(log_mel(samples_of(wav)[0])):
                    yield pa.record_batch(
                        [
                            pa.array([doc] * len(held), b.column("doc_id").type),
                            pa.array(starts // TENSOR_FRAMES, pa.int64()),
                            pa.array([milliseconds(int(x)) for x in starts], pa.int64()),
                            pa.array([milliseconds(int(x)) for x in ends], pa.int64()),
                            _lists(held),
                        ],
                        ["doc_id", "block", "start_ms", "end_ms", "log_mel"],
                    )

    return media.select("doc_id", "media").mapInArrow(read, f"doc_id {media.schema['doc_id'].dataType.simpleString()}, block long, start_ms long, end_ms long, log_mel array<float>")


def _lists(held: np.ndarray):
    import pyarrow as pa

    return pa.ListArray.from_arrays(np.arange(len(held) + 1, dtype=np.int32) * held.shape[1], held.ravel())


def tensor_digest(mel: np.ndarray) -> tuple[int, str]:
    """How many tensors a recording has, and a hash of their time spans and values as Arrow tensors hold them."""
    n, seen = 0, hashlib.sha256()
    for starts, ends, held in blocks_of(mel):
        stored = tensors(_lists(held)).to_numpy_ndarray()
        for start, end, tensor in zip(starts.tolist(), ends.tolist(), stored, strict=True):
            seen.update(struct.pack("<qq", milliseconds(start), milliseconds(end)))
            seen.update(np.ascontiguousarray(tensor, "<f4").tobytes())
        n += len(stored)
    return n, seen.hexdigest()


def tensors(log_mel_column):
    """An Arrow list column of ``features`` as a fixed-shape tensor array."""
    import pyarrow as pa

    shape = (TENSOR_FRAMES, MELS)
    flat = log_mel_column.combine_chunks() if isinstance(log_mel_column, pa.ChunkedArray) else log_mel_column
    return pa.ExtensionArray.from_storage(pa.fixed_shape_tensor(pa.float32(), shape), flat.cast(pa.list_(pa.float32(), shape[0] * shape[1])))


DIGEST = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_tensors long, tensors_sha256 string, segments array<struct<start_ms:long,end_ms:long>>"


def feature_text(mel: np.ndarray, n_tensors: int, found: list[tuple[int, int]]) -> str:
    """Frames, tensors, segments, frames in segments and mean log-mel of four bands."""
    bands = mel.reshape(len(mel), 4, MELS // 4).mean(axis=(0, 2), dtype=np.float64)
    return f"frames={len(mel)};tensors={n_tensors};segments={len(found)};active={sum(b - a for a, b in found)};bands=" + ",".join(f"{x + 0:.2f}" for x in bands)


def digests(media: DataFrame) -> DataFrame:
    """One row per recording, all of it computed from the stored bytes (n_bytes is carried)."""

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            rows = []
            for n, wav in zip(b.column("n_bytes").to_pylist(), b.column("media").to_pylist(), strict=True):
                back, _ = samples_of(wav)
                mel = log_mel(back)
                found = segments(mel.mean(axis=1, dtype=np.float64))
                n_tensors, stored = tensor_digest(mel)
                rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]), len(wav), hashlib.sha256(wav).hexdigest(), feature_text(mel, n_tensors, found), n_tensors, stored, [{"start_ms": milliseconds(a), "end_ms": milliseconds(z)} for a, z in found]))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.list_(pa.struct([("start_ms", pa.int64()), ("end_ms", pa.int64())]))]
            cols = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_tensors", "tensors_sha256", "segments"]
            yield pa.record_batch([b.column("doc_id"), *(pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", *names])

    return media.mapInArrow(read, f"doc_id {media.schema['doc_id'].dataType.simpleString()}, {DIGEST}")

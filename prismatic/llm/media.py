"""Media columns: byte payloads stored as WAV, read back, and fingerprinted by pairs of spectral peaks.

A payload of n 8-bit samples is cut into blocks of 64; two neighbouring blocks make a frame of the
short-time Fourier transform, 128 samples under a Hann window. The transform's cosines and sines are
whole numbers (127 times the real ones, rounded), so every sum is exact in 32-bit floats and equal
payloads give equal spectra wherever they are computed. Peaks are the strongest bins of three bands
whose power is higher than in the frame before and not lower than in the frame after. A peak and the
next one of its band, at most 63 frames later, make a fingerprint, coded by the frame of the first.
"""

from __future__ import annotations

import io
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_and_text, map_slices, text_bytes

BLOCK, RATE, FARTHEST = 64, 8000, 63
BANDS = ((0, 8), (8, 24), (24, 64))


def _waves() -> np.ndarray:
    n, k = np.arange(2 * BLOCK), np.arange(1, BLOCK + 1)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * (n + 0.5) / (2 * BLOCK))
    angle = np.pi * np.outer(n, k) / BLOCK
    return np.rint(127 * window[:, None] * np.concatenate([np.cos(angle), np.sin(angle)], axis=1)).astype(np.float32)


WAVES = _waves()


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media)) as r:
        return r.readframes(r.getnframes())


def fingerprints(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many each payload has, and the frames and codes of all, by frame and band. Payloads: multiples of 64 bytes."""
    blocks = np.array([len(p) // BLOCK for p in payloads], np.int64)
    of = np.repeat(np.arange(len(payloads)), blocks)
    samples = np.frombuffer(b"".join(payloads), np.uint8).astype(np.float32).reshape(-1, BLOCK) - np.float32(128)
    spectrum = samples @ WAVES[:BLOCK]
    later = samples @ WAVES[BLOCK:]
    same = np.flatnonzero(of[1:] == of[:-1])
    spectrum[same] += later[same + 1]
    frame = np.ones(len(of), bool)  # the last block ends the last frame; a lone block is a frame with silence after it
    frame[np.cumsum(blocks) - 1] = blocks == 1
    of, spectrum = of[frame], spectrum[frame].astype(np.float64)
    power = spectrum[:, :BLOCK] ** 2 + spectrum[:, BLOCK:] ** 2
    first = np.searchsorted(of, np.arange(len(payloads)))
    time = np.arange(len(of)) - first[of]
    starts = np.concatenate([[True], of[1:] != of[:-1]])
    ends = np.concatenate([starts[1:], [True]])
    found = []
    for band, (low, high) in enumerate(BANDS):
        bins = power[:, low:high].argmax(axis=1)
        most = power[np.arange(len(of)), low + bins]
        before = np.where(starts, -1, np.concatenate([[-1], most[:-1]]))
        after = np.where(ends, -1, np.concatenate([most[1:], [-1]]))
        at = np.flatnonzero((most > before) & (most >= after) & (most > 0))
        a, b = at[:-1], at[1:]
        pair = (of[a] == of[b]) & (time[b] - time[a] <= FARTHEST)
        a, b = a[pair], b[pair]
        found.append((of[a], time[a], np.full(len(a), band), (band << 18) | (bins[a] << 12) | (bins[b] << 6) | (time[b] - time[a])))
    whose, when, band, code = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((band, when, whose))
    return np.bincount(whose, minlength=len(payloads)), when[order].astype(np.int32), code[order].astype(np.int32)


def store_and_fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media (a WAV file), payload (what the wave module reads from it), times and codes, for every row of docs.

    The payload is the text in UTF-8 and bytes 0 up to the next positive multiple of 64; a null or
    empty text is 64 bytes 0, silent but for its level. Texts without two peaks in a band have no
    fingerprints. Repeated rows stay.
    """

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        data, at = text_bytes(part.column("text"))
        raw, ends = data.tobytes(), at.tolist()
        media = [to_wav((text := raw[a:b]) + bytes(-len(text) % BLOCK if text else BLOCK)) for a, b in zip(ends, ends[1:], strict=False)]
        payloads = [from_wav(m) for m in media]
        counts, times, codes = fingerprints(payloads)
        offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (times, codes)]
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(at)), pa.array(media, pa.binary()), pa.array(payloads, pa.binary()), *lists], ["doc_id", "n_bytes", "media", "payload", "times", "codes"])

    return map_slices(id_and_text(docs, id_col, text_col), work, "doc_id long, n_bytes long, media binary, payload binary, times array<int>, codes array<int>")

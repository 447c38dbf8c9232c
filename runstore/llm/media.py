"""Media columns: texts' bytes as WAV sound with spectral-peak pair fingerprints (operator 10).

The payload (UTF-8, zero-padded to a positive multiple of 64 bytes) is stored as 8-bit mono samples by the
wave module, as a column of a table in the shared folder; from there it is read back by that module.  A short-time Fourier transform of
the samples gives a spectrogram; in each frame the bins that stand out against their neighbours in time and frequency are
peaks, of which the strongest count (of equal ones the lower bin), and each peak is paired with the next few peaks behind it.  A pair is coded
as (first bin, second bin, distance), and stored with its time: two equally long arrays, ``fp_time`` and ``fp_code``.

Frames of several texts are computed together, and those of a long text in blocks, so that memory is bounded by a block and the
sound itself.  Defined cases: null text counts as empty (64 zero bytes); silence has no peaks, so its arrays are empty; equal texts
(and repeated rows) have equal values; an empty table gives an empty result; extra columns pass through, a column named like an output (n_bytes,
payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, fp_time, fp_code, media, in any case) is replaced.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from runstore.llm.common import columns_but, kept, map_texts, quoted

UNIT = 64
RATE = 8000
FRAME, HOP = 256, 128
#: Peaks a frame at most are the strongest; FAN later peaks are paired with each, within REACH frames.
PEAKS, FAN, REACH = 3, 3, 32
BLOCK = 2048
#: A steady tone may waver by this share and still be a peak in time.
STEADY = 0.99
_window = np.hanning(FRAME + 1)[:FRAME].astype(np.float32)


def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % UNIT if data else UNIT)


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(data: bytes) -> bytes:
    with wave.open(io.BytesIO(data), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("not 8-bit mono")
        return w.readframes(w.getnframes())


def n_frames(samples: np.ndarray) -> int:
    return 1 + max(0, -(-(len(samples) - FRAME) // HOP))


def windows(samples: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """The samples of the frames lo..hi, zero (128) beyond the end."""
    piece = samples[lo * HOP : (hi - 1) * HOP + FRAME]
    short = (hi - lo - 1) * HOP + FRAME - len(piece)
    if short:
        piece = np.concatenate([piece, np.full(short, 128, np.uint8)])
    return np.lib.stride_tricks.sliding_window_view(piece, FRAME)[::HOP]


def spectrum(frames: np.ndarray) -> np.ndarray:
    """Magnitudes of frames without their mean."""
    frames = frames.astype(np.float32) - 128
    frames -= frames.mean(axis=1, keepdims=True)
    return np.abs(np.fft.rfft(frames * _window, axis=1)).astype(np.float32)


def standing_out(m: np.ndarray) -> np.ndarray:
    """The bins of each inner frame's strongest peaks in order of strength, -1 where there are fewer; m has a border of -1."""
    mid = m[1:-1, 1:-1]
    top = (mid > m[1:-1, :-2]) & (mid >= m[1:-1, 2:]) & (mid >= STEADY * m[:-2, 1:-1]) & (mid >= STEADY * m[2:, 1:-1])
    top &= mid > 2 * mid.mean(axis=1, keepdims=True) + 1e-3
    top[:, 0] = False
    strength, rows, best = np.where(top, mid, 0), np.arange(len(mid)), []
    for _ in range(PEAKS):
        at = strength.argmax(axis=1)
        best.append(np.where(strength[rows, at] > 0, at, -1))
        strength[rows, at] = 0
    return np.stack(best, axis=1)


def peaks(signals: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signal, frame and bin of the spectral peaks, in this order."""
    pieces = [(i, lo, min(n, lo + BLOCK), n) for i, x in enumerate(signals) for n in [n_frames(x)] for lo in range(0, n, BLOCK)]
    found, at = [], 0
    while at < len(pieces):
        end, rows = at, 0
        while end < len(pieces) and (end == at or rows + pieces[end][2] - pieces[end][1] <= BLOCK):
            rows += pieces[end][2] - pieces[end][1]
            end += 1
        frames, signal, frame, place, n = [], [], [], [], 1
        for i, lo, hi, last in pieces[at:end]:
            a, b = max(0, lo - 1), min(last, hi + 1)  # a frame on either side, for the comparison in time
            frames.append(windows(signals[i], a, b))
            place.append(np.arange(n, n + b - a))
            signal.append(np.full(b - a, i))
            frame.append(np.where((np.arange(a, b) >= lo) & (np.arange(a, b) < hi), np.arange(a, b), -1))
            n += b - a + 1  # an empty row between two pieces
        m = np.full((n, FRAME // 2 + 3), -1.0, np.float32)
        place, signal, frame = np.concatenate(place), np.concatenate(signal), np.concatenate(frame)
        m[place, 1:-1] = spectrum(np.concatenate(frames))
        best = np.sort(standing_out(m)[place - 1], axis=1)
        row, k = np.nonzero((best >= 0) & (frame >= 0)[:, None])
        found.append((signal[row], frame[row], best[row, k]))
        at = end
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3


def fingerprints(signals: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each signal times (frames) and codes of its peak pairs, in order of the first peak and then the second."""
    i, t, b = peaks(signals)
    first, code, nth = [], [], []
    for k in range(1, FAN + 1):
        near = np.nonzero((i[k:] == i[:-k]) & (t[k:] - t[:-k] <= REACH))[0] if len(t) > k else np.zeros(0, np.int64)
        first.append(near)
        nth.append(np.full(len(near), k))
        code.append((b[near] << 16) | (b[near + k] << 8) | (t[near + k] - t[near]))
    first, code = np.concatenate(first), np.concatenate(code)
    order = np.lexsort((np.concatenate(nth), first))
    first, code = first[order], code[order].astype(np.int32)
    cuts = np.searchsorted(i[first], np.arange(len(signals) + 1))
    when = t[first].astype(np.int32)
    return [(when[lo:hi], code[lo:hi]) for lo, hi in zip(cuts, cuts[1:], strict=False)]


FEATURES = T.StructType(
    [T.StructField(n, k) for n, k in (("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType()))]
    + [T.StructField(n, T.ArrayType(T.IntegerType())) for n in ("fp_time", "fp_code")]
)


def stored(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without the text, plus n_bytes and ``media``, the sound; written to the shared folder and read back."""

    def start():
        def work(texts):
            data = [(t or "").encode("utf-8") for t in texts]
            return {"n_bytes": [len(d) for d in data], "media": [to_wav(padded(d)) for d in data]}

        return work

    docs = docs.select(*[quoted(c) for c in columns_but(docs, [n for n in FEATURES.names if n.lower() != text.lower()])])
    return kept(map_texts(docs, text, T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())]), start), "media")


def media_columns(docs: DataFrame, text: str = "text", keep_media: bool = True) -> DataFrame:
    """docs without the text, plus n_bytes, the digests of the stored form, its fingerprint arrays (``fp_time``,
    ``fp_code``) with a digest of them (``feature``) and, if kept, the sound itself (``media``)."""

    def start():
        def work(sounds):
            back = [from_wav(x) for x in sounds]
            made = fingerprints([np.frombuffer(x, np.uint8) for x in back])
            return {
                "payload_bytes": [len(x) for x in back],
                "payload_sha256": [hashlib.sha256(x).hexdigest() for x in back],
                "tail_crc32": [zlib.crc32(x[-UNIT:]) for x in back],
                "media_bytes": [len(x) for x in sounds],
                "media_sha256": [hashlib.sha256(x).hexdigest() for x in sounds],
                "feature": [f"{len(code)}:{hashlib.sha256(when.astype('<i4').tobytes() + code.astype('<i4').tobytes()).hexdigest()[:32]}" for when, code in made],
                "fp_time": [when for when, _ in made],
                "fp_code": [code for _, code in made],
            }

        return work

    return map_texts(stored(docs, text), "media", FEATURES, start, drop_text=not keep_media)

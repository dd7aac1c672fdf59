"""Mel spectra of snippets, in decibels below the loudest band."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

FRAME, HOP, BANDS = 2048, 512, 128
#: The scale is even up to this frequency, in steps of 200 / 3 Hz, and logarithmic above: 27 mels
#: for a factor of 6.4.
KNEE, STEP, PER_FACTOR = 1000.0, 200 / 3, 27 / math.log(6.4)
FLOOR, SPAN = 1e-10, 80.0


def to_mel(hertz: np.ndarray) -> np.ndarray:
    f = np.asarray(hertz, float)
    return np.where(f < KNEE, f / STEP, KNEE / STEP + np.log(np.maximum(f, KNEE) / KNEE) * PER_FACTOR)


def to_hertz(mel: np.ndarray) -> np.ndarray:
    m, knee = np.asarray(mel, float), KNEE / STEP
    return np.where(m < knee, m * STEP, KNEE * np.exp(np.maximum(m - knee, 0) / PER_FACTOR))


def filters(rate: float, bands: int = BANDS, low: float = 0.0, high: float | None = None, frame: int = FRAME) -> np.ndarray:
    """Triangles over the frequencies of a frame, each of area one."""
    at = np.linspace(0, rate / 2, frame // 2 + 1)
    edges = to_hertz(np.linspace(to_mel(low), to_mel(rate / 2 if high is None else high), bands + 2))
    left, mid, right = (edges[k : k + bands, None] for k in range(3))
    up, down = (at - left) / np.maximum(mid - left, 1e-12), (right - at) / np.maximum(right - mid, 1e-12)
    return np.maximum(0, np.minimum(up, down)) * 2 / (right - left)


def spectrum(samples: np.ndarray, bank: np.ndarray, frame: int = FRAME, hop: int = HOP) -> np.ndarray:
    """(bands, frames) of one snippet: frames around every hop, zeros beyond its ends."""
    x = np.pad(np.asarray(samples, float), frame // 2)
    n = 1 + (len(x) - frame) // hop
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(frame) / frame)
    parts = np.lib.stride_tricks.sliding_window_view(x, frame)[::hop][:n]
    power = np.abs(np.fft.rfft(parts * window, axis=1)) ** 2
    mel = bank @ power.T
    level = 10 * np.log10(np.maximum(mel, FLOOR)) - 10 * np.log10(max(float(mel.max()), FLOOR))
    return np.maximum(level, level.max() - SPAN)


def mel_spectra(cut: DataFrame, rate: float, bands: int = BANDS, low: float = 0.0, high: float | None = None) -> DataFrame:
    """(recording_id, start_time, mel) of snippets (recording_id, start_time, samples): an array of
    frames for each band; NULL for a snippet without samples."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bank = filters(rate, bands, low, high)
        for batch in batches:
            mel = [spectrum(np.asarray(s) / 32768.0, bank).astype(np.float32).tolist() if len(s) else None for s in batch["samples"]]
            yield pd.DataFrame({"recording_id": batch["recording_id"], "start_time": batch["start_time"], "mel": mel})

    return cut.select("recording_id", "start_time", "samples").mapInPandas(run, "recording_id long, start_time double, mel array<array<float>>")

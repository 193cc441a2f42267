"""From samples to spectra, fingerprints, waveforms and scalar features (numpy within Arrow batches)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..sources import files  # noqa: F401


def note_spectrum(x: np.ndarray, rate: int = 22_050, hop: int = 512, bins: int = 84, per_octave: int = 12, lowest: float = 32.7, size: int = 4096) -> np.ndarray:
    """Magnitudes in dB against the largest, bins x frames, of notes from the lowest up: a short-time spectrum read at the notes' frequencies."""
    x = np.pad(x, (size // 2, size // 2))
    n = 1 + max(0, (len(x) - size)) // hop
    at = np.arange(size)[None, :] + hop * np.arange(n)[:, None]
    power = np.abs(np.fft.rfft(x[at] * np.hanning(size), axis=1)) ** 2
    hz = lowest * 2.0 ** (np.arange(bins) / per_octave)
    low, high = hz * 2 ** (-0.5 / per_octave), hz * 2 ** (0.5 / per_octave)
    whole = np.concatenate([np.zeros((n, 1)), np.cumsum(power, axis=1)], axis=1)
    i, j = (low * size / rate).astype(int), np.maximum((high * size / rate).astype(int), (low * size / rate).astype(int) + 1)
    level = np.sqrt((whole[:, np.minimum(j, whole.shape[1] - 1)] - whole[:, np.minimum(i, whole.shape[1] - 1)]) / (j - i)).T
    return 20 * np.log10(np.maximum(level, 1e-10) / max(level.max(), 1e-10))


def spectra(audio: DataFrame, key: str = "recording") -> DataFrame:
    """(key, frame, bin, magnitude) of (key, rate, samples), of which match.find_peaks and match.peak_hashes make fingerprints."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for k, rate, x in zip(p[key], p["rate"], p["samples"], strict=True):
                s = note_spectrum(np.asarray(x), int(rate))
                b, f = np.indices(s.shape)
                yield pd.DataFrame({key: k, "frame": f.ravel().astype("int32"), "bin": b.ravel().astype("int32"), "magnitude": s.ravel()})

    kind = audio.schema[key].dataType.simpleString()
    return audio.select(key, "rate", "samples").mapInPandas(run, f"{key} {kind}, frame int, bin int, magnitude double")


def three_bands(x: np.ndarray, rate: int = 11_025, edges: tuple[float, float] = (250.0, 4000.0), step: int = 2048, chunk: int = 10) -> dict[str, np.ndarray]:
    """Envelopes of low, middle and high frequencies, one value a step, each scaled to its largest; chunks of seconds are filtered on their own."""
    out: dict[str, list[float]] = {"bass": [], "mid": [], "treble": []}
    for i in range(0, len(x), chunk * rate):
        part = x[i : i + chunk * rate]
        spectrum, hz = np.fft.rfft(part), np.fft.rfftfreq(len(part), 1 / rate)
        for name, keep in (("bass", hz < edges[0]), ("mid", (hz >= edges[0]) & (hz < edges[1])), ("treble", hz >= edges[1])):
            out[name] += np.abs(np.fft.irfft(spectrum * keep, len(part))[::step]).tolist()
    return {k: np.array(v) / max(v) if v and max(v) > 0 else np.array(v) for k, v in out.items()}


def features(x: np.ndarray, rate: int = 22_050, size: int = 2048, hop: int = 512) -> dict[str, float]:
    """Scalar features of one recording; names by group: level, spectrum, bands, rhythm, structure."""
    x = x if len(x) >= size else np.pad(x, (0, size - len(x)))
    at = np.arange(size)[None, :] + hop * np.arange(1 + (len(x) - size) // hop)[:, None]
    frames = x[at]
    rms = np.sqrt((frames**2).mean(axis=1))
    mag = np.abs(np.fft.rfft(frames * np.hanning(size), axis=1))
    hz, total = np.fft.rfftfreq(size, 1 / rate), mag.sum(axis=1) + 1e-10
    centroid = (mag * hz).sum(axis=1) / total
    spread = np.sqrt((mag * (hz[None, :] - centroid[:, None]) ** 2).sum(axis=1) / total)
    cum = np.cumsum(mag, axis=1)
    rolloff = hz[(cum >= 0.85 * cum[:, -1:]).argmax(axis=1)]
    flux = np.maximum(np.diff(mag, axis=0), 0).sum(axis=1) if len(mag) > 1 else np.zeros(1)
    share = mag / total[:, None]
    out = {
        "rms_energy": rms.mean(), "rms_mean": rms.mean(), "rms_std": rms.std(), "loudness_variation": rms.std(), "rms_p10": np.percentile(rms, 10), "rms_p90": np.percentile(rms, 90), "peak": np.abs(x).max(),
        "dynamic_range_db": 20 * np.log10(np.abs(x).max() + 1e-10) - 20 * np.log10(rms.mean() + 1e-10), "zero_crossing_rate": (np.diff(np.signbit(frames), axis=1)).mean(),
        "spectral_centroid": centroid.mean(), "spectral_centroid_std": centroid.std(), "spectral_bandwidth": spread.mean(), "spectral_rolloff": rolloff.mean(), "spectral_flux": flux.mean(),
        "spectral_entropy": -(share * np.log(share + 1e-10)).sum(axis=1).mean(), "spectral_flatness": (np.exp(np.log(mag + 1e-10).mean(axis=1)) / (mag.mean(axis=1) + 1e-10)).mean(),
        "energy_slope": np.polyfit(np.arange(len(rms)), rms, 1)[0] if len(rms) > 1 else 0.0, "tempo_confidence": 1.0, "onset_rate": float((flux > flux.mean() + flux.std()).sum()) * rate / max(1, len(x)),
    }
    from .frames import BANDS

    mean = (mag**2).mean() + 1e-10
    for n, (a, b) in BANDS.items():
        own = (hz >= a) & (hz < b)
        out[f"{n}_energy"] = (mag[:, own] ** 2).mean() if own.any() else 0.0
        out[f"{n}_ratio"] = out[f"{n}_energy"] / mean
    i, j = int(len(rms) * 0.2), int(len(rms) * 0.8)
    whole = rms.mean() + 1e-10
    out |= {"intro_ratio": rms[:i].mean() / whole if i else 0.0, "core_ratio": rms[i:j].mean() / whole if j > i else 0.0, "outro_ratio": rms[j:].mean() / whole}
    return {k: float(v) for k, v in out.items()}


def feature_rows(audio: DataFrame, key: str = "recording") -> DataFrame:
    """(key, features: map) of (key, rate, samples)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame({key: p[key], "features": [features(np.asarray(x), int(r)) for x, r in zip(p["samples"], p["rate"], strict=True)]})

    return audio.select(key, "rate", "samples").mapInPandas(run, f"{key} {audio.schema[key].dataType.simpleString()}, features map<string,double>")


def middle(n: int, rate: int, seconds: float = 60.0) -> tuple[int, int]:
    """The middle excerpt of so many seconds, in samples."""
    keep = min(n, int(seconds * rate))
    return (n - keep) // 2, (n - keep) // 2 + keep

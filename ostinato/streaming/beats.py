"""Stateful analysis of live audio: one pure step per frame, run in batch or over a stream.

A frame is (source, frame, samples); state per source is small and of fixed
size, so a source lives in one task and sources are dealt out by key.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

#: Bands in Hz, half open; the last has no upper end. Fixed values.
EDGES = {"bass": (20, 250), "mid": (250, 4000), "treble": (4000, float("inf"))}
OUT = "source string, frame long, bass double, mid double, treble double, beat boolean, bands array<double>"


@dataclass
class State:
    samples: list[float] = field(default_factory=list)
    top: dict[str, float] = field(default_factory=lambda: dict.fromkeys(EDGES, 1e-6))
    recent: list[float] = field(default_factory=list)
    last_beat: int = -(10**9)
    frames: int = 0


def levels(samples: np.ndarray, rate: int, n_bands: int = 32) -> tuple[dict[str, float], list[float]]:
    """Root mean square of each band's spectrum, and so many even bands scaled to their largest."""
    if not len(samples):
        return dict.fromkeys(EDGES, 0.0), [0.0] * n_bands
    spectrum = np.abs(np.fft.rfft(samples * np.hanning(len(samples))))
    hz = np.fft.rfftfreq(len(samples), 1 / rate)
    found = {n: float(np.sqrt(np.mean(spectrum[(hz >= a) & (hz < b)] ** 2))) if ((hz >= a) & (hz < b)).any() else 0.0 for n, (a, b) in EDGES.items()}
    bands = np.array([p.mean() if len(p) else 0.0 for p in np.array_split(spectrum, n_bands)])
    return found, (bands / bands.max() if bands.max() > 0 else bands).tolist()


def beat(state: State, bass: float, span: int = 30, apart: int = 7) -> bool:
    """The level is over half and over 1.5 times the mean of the last frames, this one included, and the last beat is far enough."""
    state.recent = [*state.recent, bass][-span:]
    hit = bass > max(0.5, 1.5 * sum(state.recent) / len(state.recent)) and state.frames - state.last_beat >= apart
    if hit:
        state.last_beat = state.frames
    state.frames += 1
    return hit


def step(state: State, samples: list[float], rate: int = 44_100, keep: int = 4096) -> dict:
    """What one frame gives; the state keeps the last samples and, for each band, a slowly falling maximum."""
    state.samples = [*state.samples, *samples][-keep:]
    raw, bands = levels(np.array(state.samples), rate)
    out = {}
    for n, x in raw.items():
        state.top[n] = max(1.2 * x, 0.998 * state.top[n])
        out[n] = min(1.0, x / state.top[n]) if state.top[n] > 0 else 0.0
    return {**out, "beat": beat(state, out["bass"]), "bands": bands}


def _run(state: State, pdf: pd.DataFrame, rate: int) -> pd.DataFrame:
    rows = [{"source": r.source, "frame": r.frame, **step(state, list(r.samples), rate)} for r in pdf.sort_values("frame").itertuples()]
    return pd.DataFrame(rows, columns=["source", "frame", "bass", "mid", "treble", "beat", "bands"])


def batch(frames: DataFrame, rate: int = 44_100) -> DataFrame:
    return frames.groupBy("source").applyInPandas(lambda pdf: _run(State(), pdf, rate), OUT)


def stream(frames: DataFrame, rate: int = 44_100) -> DataFrame:
    """The same over a streaming frame, with the state kept between batches."""
    import json

    def run(key: tuple, parts: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        state = State(**json.loads(held.get[0])) if held.exists else State()
        yield _run(state, pd.concat(list(parts)), rate)
        held.update((json.dumps(asdict(state)),))

    return frames.groupBy("source").applyInPandasWithState(run, OUT, "state string", "append", GroupStateTimeout.NoTimeout)


def beats_of_levels(df: DataFrame, group: str, frame: str, level: str) -> DataFrame:
    """Beats of given bass levels: (group, frame)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        state, pdf = State(), pdf.sort_values(frame)
        hits = [beat(state, x) for x in pdf[level]]
        return pdf.loc[hits, [group, frame]]

    return df.select(group, frame, level).groupBy(group).applyInPandas(run, df.select(group, frame).schema)

"""Audio features over rows of spectra: separation, mel and pitch kernels, contrast, onsets, tempo, beats, constant-Q, band filters.

A spectrum has a row a bin: (key, frame, bin, magnitude). Linear maps of a
spectrum (mel bands, cosine transform, pitch classes, constant-Q) are small
tables (bin, out, weight) that its rows are joined with and summed by; their
size follows the transform's size, not the data. Only the Fourier transform of a
frame, the correlations of the frames around one, the beat path of one recording
and the recursive filter of one chunk are small functions of arrays.
"""

from __future__ import annotations

import cmath
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# spectra


def _transforms(audio: DataFrame, key: str, size: int, hop: int, bins: int, window: np.ndarray | None = None) -> DataFrame:
    """(key, rate, frame, rms, crossings, re, im) of (key, rate, samples): the first bins of each frame's transform, 64 frames at a time."""
    shape = np.hanning(size + 1)[:-1] if window is None else window

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for k, rate, x in zip(p[key], p["rate"], p["samples"], strict=True):
                padded = np.pad(np.asarray(x, float), size // 2)
                n = 1 + (len(padded) - size) // hop if len(x) else 0
                for a in range(0, n, 64):
                    at = np.arange(size)[None, :] + hop * np.arange(a, min(a + 64, n))[:, None]
                    own = padded[at]
                    z = np.fft.rfft(own * shape, axis=1)[:, :bins]
                    turns = np.diff(np.signbit(own), axis=1).mean(axis=1)
                    yield pd.DataFrame({key: k, "rate": rate, "frame": np.arange(a, a + len(z), dtype="int32"), "rms": np.sqrt((own**2).mean(axis=1)), "crossings": turns, "re": list(z.real), "im": list(z.imag)})

    kind = audio.schema[key].dataType.simpleString()
    return audio.select(key, "rate", "samples").filter("samples is not null").mapInPandas(run, f"{key} {kind}, rate int, frame int, rms double, crossings double, re array<double>, im array<double>")


def spectrum(audio: DataFrame, key: str = "recording", size: int = 2048, hop: int = 512) -> DataFrame:
    """(key, frame, bin, magnitude) of (key, rate, samples): frames are centred, a Hann window each."""
    z = _transforms(audio, key, size, hop, size // 2 + 1)
    mag = F.transform(F.arrays_zip("re", "im"), lambda c: F.sqrt(c["re"] * c["re"] + c["im"] * c["im"]))
    return z.select(key, "frame", F.posexplode(mag).alias("bin", "magnitude"))


def _table(spark: SparkSession, rows: list[tuple], out: str, into: str = "bin") -> DataFrame:
    """A kernel as rows (into, out, weight)."""
    return F.broadcast(spark.createDataFrame([(a, b, float(w)) for a, b, w in rows], f"{into} int, {out} int, weight double"))


def project(rows: DataFrame, kernel: DataFrame, key: str, into: str, out: str, value: str, name: str) -> DataFrame:
    """(key, frame, out, name): the sum of weight * value over a frame's rows, by a kernel (into, out, weight)."""
    return rows.join(kernel, into).groupBy(key, "frame", out).agg(F.sum(F.col("weight") * F.col(value)).alias(name))


def decibels(rows: DataFrame, key: str, value: str, floor: float = 1e-10, span: float = 80.0) -> DataFrame:
    """value in dB, no more than span below the key's largest."""
    level = rows.withColumn(value, F.log10(F.greatest(F.col(value), F.lit(floor))) * 10)
    top = level.groupBy(key).agg(F.max(value).alias("__top"))
    return level.join(top, key).withColumn(value, F.greatest(F.col(value), F.col("__top") - span)).drop("__top")


# harmonic and percussive parts


def moving_median(rows: DataFrame, groups: list[str], order: str, value: str, reach: int, name: str) -> DataFrame:
    """rows with the median of value over the 2 * reach + 1 places around each, along `order` (whole, from 0, without gaps), which is mirrored once at both ends."""
    n = rows.groupBy(*groups).agg((F.max(order) + 1).alias("__n"))
    held = rows.join(n, groups).withColumn("__at", F.col(order))
    before = held.filter(F.col(order) < reach).withColumn("__at", -1 - F.col(order))
    after = held.filter(F.col(order) >= F.col("__n") - reach).withColumn("__at", 2 * F.col("__n") - 1 - F.col(order))
    around = Window.partitionBy(*groups).orderBy("__at").rowsBetween(-reach, reach)
    wide = held.unionAll(before).unionAll(after).withColumn("__s", F.array_sort(F.collect_list(value).over(around)))
    size = F.size("__s")
    middle = (F.element_at("__s", F.floor((size + 1) / 2).cast("int")) + F.element_at("__s", (F.floor(size / 2) + 1).cast("int"))) / 2
    return wide.filter(F.col("__at") == F.col(order)).withColumn(name, middle).drop("__n", "__at", "__s")


def separate(rows: DataFrame, key: str = "recording", reach: int = 15) -> DataFrame:
    """A spectrum with its harmonic and percussive magnitudes, which add up to the whole.

    What lasts shows in the median along frames, what is short and broad in that
    along bins; each place is shared by the squares of both.
    """
    lasting = moving_median(rows, [key, "bin"], "frame", "magnitude", reach, "__h")
    both = moving_median(lasting, [key, "frame"], "bin", "magnitude", reach, "__p")
    h, p = F.col("__h") * F.col("__h"), F.col("__p") * F.col("__p")
    share = F.when(h + p > 0, h / (h + p)).otherwise(0.5)
    return both.withColumn("harmonic", F.col("magnitude") * share).withColumn("percussive", F.col("magnitude") * (1 - share)).drop("__h", "__p")


def frame_levels(rows: DataFrame, key: str, value: str, size: int, name: str) -> DataFrame:
    """(key, frame, name): the root mean square of a frame, from its spectrum, the window's own taken out."""
    ends = F.when((F.col("bin") == 0) | (F.col("bin") == size // 2), 1).otherwise(2)
    return rows.groupBy(key, "frame").agg(F.sqrt(F.sum(ends * F.col(value) * F.col(value)) / (size * 0.375 * size)).alias(name))


# kernels


def mel_rows(rate: int, size: int, mels: int = 128) -> list[tuple[int, int, float]]:
    """Triangles of equal area over a scale that is even below 1 kHz and logarithmic above."""
    slope = math.log(6.4) / 27
    mel = lambda f: f * 3 / 200 if f < 1000 else 15 + math.log(f / 1000) / slope
    hz = lambda m: m * 200 / 3 if m < 15 else 1000 * math.exp(slope * (m - 15))
    edges = [hz(mel(rate / 2) * i / (mels + 1)) for i in range(mels + 2)]
    out = []
    for b in range(size // 2 + 1):
        f = b * rate / size
        for m in range(mels):
            low, mid, high = edges[m : m + 3]
            w = min((f - low) / (mid - low), (high - f) / (high - mid))
            if w > 0:
                out.append((b, m, w * 2 / (high - low)))
    return out


def cosine_rows(n: int, coefficients: int) -> list[tuple[int, int, float]]:
    """The orthonormal cosine transform of n values."""
    return [(m, k, math.sqrt((1 if k == 0 else 2) / n) * math.cos(math.pi * k * (m + 0.5) / n)) for k in range(coefficients) for m in range(n)]


def pitch_rows(rate: int, size: int, tuned: float = 440.0) -> list[tuple[int, int, float]]:
    """Pitch classes from C of a bin: a bell around each class as wide as the bin, less weight far from the fifth octave."""
    semitone = [12 * math.log2(b * rate / size / (tuned / 16)) for b in range(1, size)]
    semitone = [semitone[0] - 18, *semitone]
    out = []
    for b in range(size // 2 + 1):
        width = max(semitone[b + 1] - semitone[b], 1.0)
        bell = [math.exp(-0.5 * (2 * ((semitone[b] - c + 6) % 12 - 6) / width) ** 2) for c in range(12)]
        length = math.sqrt(sum(x * x for x in bell))
        octave = math.exp(-0.5 * ((semitone[b] / 12 - 5) / 2) ** 2)
        out += [(b, (c - 3) % 12, x / length * octave) for c, x in enumerate(bell)]  # class 0 is A, three semitones before C
    return out


def tonal_rows() -> list[tuple[int, int, float]]:
    """Pitch classes on the circles of fifths, minor and major thirds: sine and cosine of each."""
    circles = ((7 / 6, 1.0), (3 / 2, 1.0), (2 / 3, 0.5))
    return [(c, 2 * i + j, r * math.cos(math.pi * (step * c - (0.5 if j == 0 else 0)))) for i, (step, r) in enumerate(circles) for j in (0, 1) for c in range(12)]


def mel_levels(rows: DataFrame, key: str, rate: int, size: int, value: str = "magnitude", mels: int = 128) -> DataFrame:
    """(key, frame, mel, level): power by mel band in dB."""
    power = rows.withColumn("__power", F.col(value) * F.col(value))
    return decibels(project(power, _table(rows.sparkSession, mel_rows(rate, size, mels), "mel"), key, "bin", "mel", "__power", "level"), key, "level")


def cepstrum(levels: DataFrame, key: str, n: int = 10, mels: int = 128) -> DataFrame:
    """(key, frame, coefficient, value) of levels by mel band; coefficients from 0."""
    return project(levels, _table(levels.sparkSession, cosine_rows(mels, n), "coefficient", "mel"), key, "mel", "coefficient", "level", "value")


def chroma(rows: DataFrame, key: str, rate: int, size: int, value: str = "magnitude") -> DataFrame:
    """(key, frame, pitch, level): strength of the pitch classes from C, the strongest of a frame 1."""
    power = rows.withColumn("__power", F.col(value) * F.col(value))
    raw = project(power, _table(rows.sparkSession, pitch_rows(rate, size), "pitch"), key, "bin", "pitch", "__power", "level")
    top = raw.groupBy(key, "frame").agg(F.max("level").alias("__top"))
    return raw.join(top, [key, "frame"]).withColumn("level", F.when(F.col("__top") > 0, F.col("level") / F.col("__top")).otherwise(0.0)).drop("__top")


def tonnetz(pitches: DataFrame, key: str) -> DataFrame:
    """(key, frame, axis, value): the tonal centre of a frame's pitch classes."""
    whole = pitches.groupBy(key, "frame").agg(F.sum("level").alias("__sum"))
    share = pitches.join(whole, [key, "frame"]).withColumn("__share", F.when(F.col("__sum") > 0, F.col("level") / F.col("__sum")).otherwise(0.0))
    return project(share, _table(pitches.sparkSession, tonal_rows(), "axis", "pitch"), key, "pitch", "axis", "__share", "value")


def contrast_bands(rate: int, size: int, lowest: float = 200.0, bands: int = 6) -> list[tuple[int, int, float]]:
    """Bins of octave bands, the first from 0 Hz: a band takes in the bin below it, and ends with the one before its edge; the last ends with the spectrum."""
    edges = [0.0, *(lowest * 2.0**i for i in range(bands + 1))]
    last, out = size // 2, []
    for k in range(bands + 1):
        own = [b for b in range(last + 1) if edges[k] <= b * rate / size <= edges[k + 1]]
        if own and k > 0 and own[0] > 0:
            own = [own[0] - 1, *own]
        own = own + list(range(own[-1] + 1, last + 1)) if own and k == bands else own[:-1]
        out += [(b, k, 1.0) for b in own]
    return out


def contrast(rows: DataFrame, key: str, bands: list[tuple[int, int, float]], quantile: float = 0.02) -> DataFrame:
    """(key, frame, band, contrast): mean of a band's strongest bins less that of its weakest, in dB."""
    held = rows.join(_table(rows.sparkSession, bands, "band"), "bin").groupBy(key, "frame", "band").agg(F.array_sort(F.collect_list("magnitude")).alias("s"))
    n = F.greatest(F.rint(F.size("s") * quantile), F.lit(1)).cast("int")
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda t, x: t + x) / F.size(a)
    ends = held.select(key, "frame", "band", mean(F.slice("s", F.lit(1), n)).alias("valley"), mean(F.slice("s", F.size("s") - n + 1, n)).alias("peak"))
    return decibels(decibels(ends, key, "peak"), key, "valley").select(key, "frame", "band", (F.col("peak") - F.col("valley")).alias("contrast"))


# rhythm


def onset_strength(levels: DataFrame, key: str) -> DataFrame:
    """(key, frame, strength): how much louder the mel bands of a frame are than those of the frame before, on average; 0 for the first."""
    rise = F.col("level") - F.lag("level").over(Window.partitionBy(key, "mel").orderBy("frame"))
    return levels.withColumn("__rise", F.greatest(F.coalesce(rise, F.lit(0.0)), F.lit(0.0))).groupBy(key, "frame").agg(F.avg("__rise").alias("strength"))


def onsets(strength: DataFrame, key: str, above: float = 0.07) -> DataFrame:
    """(key, frame) of onsets: not less than the frame before, over the mean around by so much of the largest, not the next but one frame of another."""
    top = strength.groupBy(key).agg(F.max("strength").alias("__top"))
    scaled = strength.join(top, key).filter(F.col("__top") > 0).withColumn("__x", F.col("strength") / F.col("__top"))
    along = Window.partitionBy(key).orderBy("frame")
    told = scaled.withColumn("__peak", F.max("__x").over(along.rowsBetween(-1, 0))).withColumn("__mean", F.avg("__x").over(along.rowsBetween(-4, 4)))
    from .frames import spaced

    return spaced(told.filter((F.col("__x") == F.col("__peak")) & (F.col("__x") >= F.col("__mean") + above)), key, "frame", 2)


def lag_products(strength: DataFrame, key: str, lags: int) -> DataFrame:
    """(key, lag, frame, product): strength times that `lag` frames later, lags from 0 below `lags`."""
    later = strength.select(key, F.col("frame").alias("__to"), F.col("strength").alias("__later"))
    ahead = strength.select(key, "frame", "strength", F.explode(F.sequence(F.lit(0), F.lit(lags - 1))).alias("lag")).withColumn("__to", F.col("frame") + F.col("lag"))
    return ahead.join(later, [key, "__to"]).select(key, "lag", "frame", (F.col("strength") * F.col("__later")).alias("product"))


def tempo(strength: DataFrame, key: str, rate: int, hop: int = 512, near: float = 120.0, bounds: tuple[float, float] = (30.0, 300.0)) -> DataFrame:
    """(key, lag, tempo): the period of greatest autocorrelation, weighted by a bell of an octave around `near` beats a minute."""
    per_minute = 60.0 * rate / hop
    low, high = math.ceil(per_minute / bounds[1]), math.floor(per_minute / bounds[0])
    sums = lag_products(strength, key, high + 1).filter(F.col("lag") >= low).groupBy(key, "lag").agg(F.sum("product").alias("s"))
    octaves = F.log2(F.lit(per_minute) / F.col("lag") / near)
    best = sums.withColumn("__w", F.col("s") * F.exp(-0.5 * octaves * octaves)).groupBy(key).agg(F.max(F.struct("__w", (-F.col("lag")).alias("less"))).alias("b"))
    return best.filter("b.__w > 0").select(key, (-F.col("b.less")).alias("lag"), (F.lit(per_minute) / -F.col("b.less")).alias("tempo"))


def _window_correlations(key: str, width: int):
    """A function of batches (key, frame, __at, __x), each row with the frames around it and their strengths: (key, frame, values) by lag."""
    half = width // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 1024):
                b = whole.slice(first, 1024)
                n, frame, at = b.num_rows, b.column("frame").to_numpy(zero_copy_only=False), b.column("__at")
                row = np.repeat(np.arange(n), pc.list_value_length(at).to_numpy(zero_copy_only=False))
                x = np.zeros((n, width))
                x[row, at.flatten().to_numpy(zero_copy_only=False) - frame[row] + half] = b.column("__x").flatten().to_numpy(zero_copy_only=False)
                sums = np.stack([np.einsum("ij,ij->i", x[:, : width - lag], x[:, lag:]) for lag in range(width)], axis=1)
                values = np.divide(sums, sums[:, :1], out=np.zeros_like(sums), where=sums[:, :1] > 0)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, width), pa.int32()), pa.array(values.ravel()))
                yield pa.record_batch([b.column(key), b.column("frame"), lists], [key, "frame", "values"])

    return run


def tempogram(strength: DataFrame, key: str, width: int = 384) -> DataFrame:
    """(key, frame, lag, value): autocorrelation within the `width` frames around each, by that of lag 0; 0 where that is 0.

    Frames meet those around them once, by a window of the recording; lags
    become rows at last and aren't shuffled. A null strength counts as 0.
    """
    half = width // 2
    around = Window.partitionBy(key).orderBy("frame").rangeBetween(-half, half - 1)
    held = strength.select(key, "frame", F.collect_list("frame").over(around).alias("__at"), F.collect_list(F.coalesce("strength", F.lit(0.0))).over(around).alias("__x"))
    kinds = {c: strength.schema[c].dataType.simpleString() for c in (key, "frame")}
    told = held.mapInArrow(_window_correlations(key, width), f"`{key}` {kinds[key]}, frame {kinds['frame']}, values array<double>")
    return told.select(key, "frame", F.posexplode("values").alias("lag", "value"))


def beat_path(strength: np.ndarray, period: int, tightness: float = 100.0) -> list[int]:
    """Frames of beats: the path of greatest strength whose steps are near the period, by dynamic programming."""
    n = len(strength)
    if not n or strength.max() <= 0 or period < 1:
        return []
    local = strength / (strength.std() or 1.0)
    score, back = local.copy(), np.full(n, -1)
    steps = np.arange(max(1, period // 2), 2 * period + 1)
    cost = tightness * np.log(steps / period) ** 2
    for t in range(n):
        reach = steps[steps <= t]
        if len(reach):
            ways = score[t - reach] - cost[: len(reach)]
            i = int(ways.argmax())
            if ways[i] > 0:
                score[t] += ways[i]
                back[t] = t - reach[i]
    at, path = int(score.argmax()), []
    while at >= 0:
        path.append(at)
        at = int(back[at])
    return path[::-1]


def beats(strength: DataFrame, periods: DataFrame, key: str) -> DataFrame:
    """(key, frame) of beats, from strengths and (key, lag); a recording's path is one group."""

    def path(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("frame")
        found = beat_path(rows["strength"].to_numpy(), int(rows["lag"].iloc[0]))
        return pd.DataFrame({key: rows[key].iloc[:1].repeat(len(found)), "frame": rows["frame"].to_numpy()[found].astype("int32")})

    kind = strength.schema[key].dataType.simpleString()
    return strength.join(periods.select(key, "lag"), key).groupBy(key).applyInPandas(path, f"{key} {kind}, frame int")


# constant-Q


@lru_cache(maxsize=8)
def constant_q_rows(rate: int, size: int = 16_384, bins: int = 84, per_octave: int = 12, lowest: float = 32.7, least: float = 0.005) -> tuple[tuple[int, int, float, float], ...]:
    """(bin, note, re, im): transforms of windowed tones, each as long as its pitch's quality asks, without parts below `least` of the largest."""
    q = 1 / (2 ** (1 / per_octave) - 1)
    out = []
    for k in range(bins):
        hz = lowest * 2.0 ** (k / per_octave)
        n = min(size, math.ceil(q * rate / hz))
        tone = np.zeros(size, complex)
        start = (size - n) // 2
        tone[start : start + n] = np.hanning(n + 2)[1:-1] / n * np.exp(2j * np.pi * hz / rate * (np.arange(n) - n / 2))
        z = np.conj(np.fft.fft(tone)) / size
        z = z[: size // 2 + 1]
        keep = np.nonzero(np.abs(z) >= least * np.abs(z).max())[0]
        out += [(int(b), k, float(z[b].real), float(z[b].imag)) for b in keep]
    return tuple(out)


def constant_q(audio: DataFrame, rate: int, key: str = "recording", hop: int = 512, size: int = 16_384, **notes) -> DataFrame:
    """(key, frame, bin, magnitude): dB against the recording's loudest, bins being notes; for match.find_peaks and match.peak_hashes.

    The product of a frame's transform and the kernels is a join by bin. Recordings of other rates are left out.
    """
    rows = constant_q_rows(rate, size, **notes)
    kernel = F.broadcast(audio.sparkSession.createDataFrame(list(rows), "at int, note int, kr double, ki double"))
    z = _transforms(audio.filter(F.col("rate") == rate), key, size, hop, max(r[0] for r in rows) + 1, np.ones(size))
    flat = z.select(key, "frame", F.posexplode(F.arrays_zip("re", "im")).alias("at", "z")).select(key, "frame", "at", "z.re", "z.im")
    met = flat.join(kernel, "at").groupBy(key, "frame", F.col("note").alias("bin"))
    sums = met.agg(F.sum(F.col("re") * F.col("kr") - F.col("im") * F.col("ki")).alias("a"), F.sum(F.col("re") * F.col("ki") + F.col("im") * F.col("kr")).alias("b"))
    level = sums.select(key, "frame", "bin", F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b")).alias("level"))
    top = level.groupBy(key).agg(F.max("level").alias("__top"))
    return level.join(top, key).select(key, "frame", "bin", (F.log10(F.greatest(F.col("level"), F.lit(1e-10)) / F.greatest("__top", F.lit(1e-10))) * 20).alias("magnitude"))


# recursive band filters


@lru_cache(maxsize=32)
def butterworth(kind: str, edges: tuple[float, ...], rate: float, order: int = 4) -> tuple[tuple[float, float, float, float, float], ...]:
    """Second-order sections (b0, b1, b2, a1, a2) of a maximally flat filter: low, high or band."""
    warped = [2 * rate * math.tan(math.pi * f / rate) for f in edges]
    poles = [cmath.exp(1j * math.pi * (2 * k + order + 1) / (2 * order)) for k in range(order)]
    if kind == "low":
        poles, at_one, at_minus = [p * warped[0] for p in poles], 0, order
    elif kind == "high":
        poles, at_one, at_minus = [warped[0] / p for p in poles], order, 0
    else:
        width, centre = warped[1] - warped[0], warped[0] * warped[1]
        half = [p * width / 2 for p in poles]
        poles = [h + s * cmath.sqrt(h * h - centre) for h in half for s in (1, -1)]
        at_one = at_minus = order
    digital = [(2 * rate + p) / (2 * rate - p) for p in poles]
    upper = sorted((p for p in digital if p.imag > 1e-12), key=lambda p: abs(p))
    zeros = [1.0] * at_one + [-1.0] * at_minus
    # where the filter lets all through: 0 Hz, half the rate, or the middle of the band
    middle = {"low": 1.0, "high": -1.0}.get(kind) or cmath.exp(2j * math.atan(math.sqrt(warped[0] * warped[-1]) / (2 * rate)))
    out = []
    for i, p in enumerate(upper):
        z1, z2 = zeros[i], zeros[-1 - i]
        b1, b2, a1, a2 = -(z1 + z2), z1 * z2, -2 * p.real, abs(p) ** 2
        gain = abs((1 + a1 / middle + a2 / middle**2) / (1 + b1 / middle + b2 / middle**2))
        out.append((gain, gain * b1, gain * b2, a1, a2))
    return tuple(out)


def filtered(x: np.ndarray, sections: tuple[tuple[float, ...], ...], block: int = 128) -> np.ndarray:
    """x through the sections, from rest: a scan over blocks carries each section's two values on by powers of its 2 x 2 matrix."""
    for b0, b1, b2, a1, a2 in sections:
        step = np.array([[-a1, 1.0], [-a2, 0.0]])
        enter = np.array([b1 - a1 * b0, b2 - a2 * b0])
        powers = [np.eye(2)]
        for _ in range(block):
            powers.append(powers[-1] @ step)
        read = np.array([p[0] for p in powers[:block]])  # what the carried values add to each output
        impulse = np.concatenate([[b0], read[:-1] @ enter])
        inner = np.array([[impulse[i - j] if i >= j else 0.0 for j in range(block)] for i in range(block)])
        leave = np.array([powers[block - 1 - j] @ enter for j in range(block)])  # what each input leaves in the carried values
        parts = np.pad(x, (0, -len(x) % block)).reshape(-1, block)
        out, left, carried = parts @ inner.T, parts @ leave, np.zeros(2)
        for i in range(len(parts)):
            out[i] += read @ carried
            carried = powers[block] @ carried + left[i]
        x = out.reshape(-1)[: len(x)]
    return x


def band_waveform(audio: DataFrame, key: str = "recording", edges: tuple[float, float] = (250.0, 4000.0), step: int = 2048, chunk: int = 10) -> DataFrame:
    """(key, at, bass, mid, treble) of (key, rate, samples): every step-th absolute value of three filtered bands, counted on over the chunks.

    A row a chunk of so many seconds is filtered, each from rest. A null or empty recording has no rows.
    """
    rows = audio.filter("size(samples) > 0").select(key, "rate", "samples", F.explode(F.sequence(F.lit(0), F.floor((F.size("samples") - 1) / (F.col("rate") * chunk)).cast("int"))).alias("chunk"))
    parts = rows.select(key, "rate", "chunk", F.slice("samples", F.col("chunk") * F.col("rate") * chunk + 1, F.col("rate") * chunk).alias("samples"))

    @F.pandas_udf("array<struct<bass:double,mid:double,treble:double>>")
    def bands(rate: pd.Series, samples: pd.Series) -> pd.Series:
        out = []
        for r, x in zip(rate, samples, strict=True):
            x = np.asarray(x, float)
            three = [np.abs(filtered(x, butterworth(kind, at, float(r)))[::step]) for kind, at in (("low", edges[:1]), ("band", edges), ("high", edges[1:]))]
            out.append([{"bass": a, "mid": b, "treble": c} for a, b, c in zip(*three, strict=True)])
        return pd.Series(out)

    per = F.ceil(F.col("rate") * chunk / step).cast("int")
    return parts.select(key, "rate", "chunk", F.posexplode(bands("rate", "samples")).alias("i", "b")).select(key, (F.col("chunk") * per + F.col("i")).alias("at"), "b.*")


def band_energies(waveform: DataFrame, key: str = "recording") -> DataFrame:
    """Per key of band_waveform: mean bass, mid and treble before scaling, their sum, and how far the loudest lies above the mean, in dB."""
    whole = F.col("bass") + F.col("mid") + F.col("treble")
    db = lambda c: F.log10(c + 1e-10) * 20
    means = [F.avg(c).alias(f"{c}_energy") for c in ("bass", "mid", "treble")]
    found = waveform.groupBy(key).agg(*means, (db(F.max(whole)) - db(F.avg(whole))).alias("dynamic_range"))
    return found.withColumn("energy", F.col("bass_energy") + F.col("mid_energy") + F.col("treble_energy"))


def scaled_bands(waveform: DataFrame, key: str = "recording") -> DataFrame:
    """band_waveform with each band by its largest; a silent band stays 0."""
    bands = ("bass", "mid", "treble")
    top = waveform.groupBy(key).agg(*[F.max(c).alias(f"__{c}") for c in bands])
    return waveform.join(top, key).select(key, "at", *[F.when(F.col(f"__{c}") > 0, F.col(c) / F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in bands])


# all of them


def feature_columns(audio: DataFrame, rate: int, key: str = "recording", size: int = 2048, hop: int = 512) -> DataFrame:
    """A row a recording of (key, rate, samples) of this rate: cepstrum, contrast, both parts' energies, onsets, tempo, beats, harmony."""
    own = audio.filter((F.col("rate") == rate) & (F.size("samples") > 0))
    from . import steps

    rows = steps.written(separate(spectrum(own, key, size, hop), key))
    seconds = own.select(key, (F.size("samples") / F.lit(float(rate))).alias("__seconds"))
    levels = steps.written(mel_levels(rows, key, rate, size))
    ceps = cepstrum(levels, key).groupBy(key).agg(*[F.avg(F.when(F.col("coefficient") == i, F.col("value"))).alias(f"mfcc_{i + 1}") for i in range(10)])
    parts = [frame_levels(rows, key, c, size, "x").groupBy(key).agg(F.avg("x").alias(f"{c}_energy")) for c in ("harmonic", "percussive")]
    strength = steps.written(onset_strength(mel_levels(rows, key, rate, size, "percussive"), key))
    every = onset_strength(levels, key)
    count = lambda df, name: df.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    speed = steps.written(tempo(strength, key, rate, hop))
    gap = beats(strength, speed, key).withColumn("__gap", (F.col("frame") - F.lag("frame").over(Window.partitionBy(key).orderBy("frame"))) * (hop / rate))
    pitches = steps.written(chroma(rows, key, rate, size))
    whole = pitches.groupBy(key, "frame").agg(F.sum("level").alias("s"), F.max(F.struct("level", (-F.col("pitch")).alias("less"))).alias("top"))
    share = F.col("level") / (F.col("s") + 1e-10)
    entropy = pitches.join(whole.select(key, "frame", "s"), [key, "frame"]).groupBy(key, "frame").agg((-F.sum(share * F.log(share + 1e-10))).alias("e")).groupBy(key).agg(F.avg("e").alias("chroma_entropy"))
    tables = [
        ceps, *parts, contrast(rows, key, contrast_bands(rate, size)).groupBy(key).agg(F.avg("contrast").alias("spectral_contrast")),
        strength.groupBy(key).agg(F.avg("strength").alias("onset_strength_mean")), count(onsets(strength, key), "__percussive"), count(onsets(every, key), "__all"),
        speed.select(key, "tempo"), gap.groupBy(key).agg(F.avg("__gap").alias("beat_interval_mean"), F.stddev_pop("__gap").alias("beat_interval_std")),
        tempogram(strength, key).groupBy(key).agg(F.avg("value").alias("tempogram_periodicity")), entropy,
        whole.groupBy(key).agg(F.avg(-F.col("top.less")).alias("chroma_centroid"), F.stddev_pop("s").alias("chroma_energy_std")),
        tonnetz(chroma(rows, key, rate, size, "harmonic"), key).groupBy(key).agg(F.avg("value").alias("tonnetz_mean")),
    ]
    out = seconds
    for t in tables:
        out = out.join(t, key, "left")
    names = [c for c in out.columns if c != key and not c.startswith("__")]
    rates = [(F.coalesce(c, F.lit(0)) / F.col("__seconds")).alias(n) for c, n in (("__percussive", "percussive_onset_rate"), ("__all", "onset_rate"))]
    ratio = (F.col("percussive_energy") / (F.col("harmonic_energy") + 1e-10)).alias("perc_harm_ratio")
    return out.select(key, *[F.coalesce(n, F.lit(0.0)).alias(n) for n in names], ratio, *rates)


def scalar_columns(audio: DataFrame, rate: int, key: str = "recording", size: int = 2048, hop: int = 512) -> DataFrame:
    """A row a recording of (key, rate, samples) of this rate: levels, bands, shape of the spectrum, structure."""
    from . import steps
    from .frames import BANDS

    own = audio.filter((F.col("rate") == rate) & (F.size("samples") > 0))
    z = _transforms(own, key, size, hop, size // 2 + 1)
    z = steps.written(z.select(key, "frame", "rms", "crossings", F.transform(F.arrays_zip("re", "im"), lambda c: F.sqrt(c["re"] * c["re"] + c["im"] * c["im"])).alias("magnitudes")))
    slope = F.when(F.count(F.lit(1)) > 1, F.regr_slope("rms", F.col("frame"))).otherwise(0.0)
    level = z.groupBy(key).agg(
        *[F.avg("rms").alias(c) for c in ("rms_energy", "rms_mean")], *[F.stddev_pop("rms").alias(c) for c in ("rms_std", "loudness_variation")],
        F.percentile("rms", 0.1).alias("rms_p10"), F.percentile("rms", 0.9).alias("rms_p90"), F.avg("crossings").alias("zero_crossing_rate"), slope.alias("energy_slope"),
    )
    m, hz, power = F.col("magnitude"), F.col("bin") * F.lit(rate / size), F.greatest(F.col("magnitude") * F.col("magnitude"), F.lit(1e-10))
    rows = z.select(key, "frame", F.posexplode("magnitudes").alias("bin", "magnitude"))
    inside = {n: F.avg(F.when((hz >= a) & (hz < b), m)) for n, (a, b) in BANDS.items()}
    bands = rows.groupBy(key).agg(F.avg(m).alias("__mean"), *[F.coalesce(v, F.lit(0.0)).alias(f"{n}_mean") for n, v in inside.items()])
    bands = bands.select(key, *[f"{n}_mean" for n in BANDS], *[(F.col(f"{n}_mean") / (F.col("__mean") + 1e-10)).alias(f"{n}_ratio") for n in BANDS])
    total = rows.groupBy(key, "frame").agg(F.sum(m).alias("__sum"))
    share = F.when(F.col("__sum") > 0, m / F.col("__sum")).otherwise(0.0)
    loose = m / (F.col("__sum") + 1e-10)
    so_far = F.sum(m).over(Window.partitionBy(key, "frame").orderBy("bin"))
    told = rows.join(total, [key, "frame"]).withColumn("__below", so_far < F.col("__sum") * 0.85)
    frames = told.groupBy(key, "frame").agg(
        F.sum(share * hz).alias("c"), F.sum(share * hz * hz).alias("cc"), (F.count_if("__below") * F.lit(rate / size)).alias("rolloff"),
        (F.exp(F.avg(F.log(power))) / F.avg(power)).alias("flatness"), (-F.sum(loose * F.log(loose + 1e-10))).alias("entropy"),
    )
    shape = frames.groupBy(key).agg(
        F.avg("c").alias("spectral_centroid"), F.stddev_pop("c").alias("spectral_centroid_std"), F.avg(F.sqrt(F.greatest(F.col("cc") - F.col("c") * F.col("c"), F.lit(0.0)))).alias("spectral_bandwidth"),
        F.avg("rolloff").alias("spectral_rolloff"), F.avg("flatness").alias("spectral_flatness"), F.avg("entropy").alias("spectral_entropy"),
    )
    n = F.size("samples")
    first, last = (n * 0.2).cast("int"), (n * 0.8).cast("int")
    mean = lambda a: F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda t, x: t + F.abs(x)) / F.size(a)).otherwise(0.0)
    parts = {"intro": (F.lit(1), first), "core": (first + 1, last - first), "outro": (last + 1, n - last)}
    structure = own.select(key, F.array_max(F.transform("samples", F.abs)).alias("peak_amplitude"), mean(F.col("samples")).alias("__whole"), *[mean(F.slice("samples", a, c)).alias(f"__{p}") for p, (a, c) in parts.items()])
    structure = structure.select(key, "peak_amplitude", *[(F.col(f"__{p}") / (F.col("__whole") + 1e-10)).alias(f"{p}_energy_ratio") for p in parts])
    out = level.join(bands, key).join(shape, key).join(structure, key)
    return out.withColumn("crest_factor", F.col("peak_amplitude") / (F.col("rms_mean") + 1e-10)).withColumn("tempo_confidence", F.lit(1.0))


def all_columns(audio: DataFrame, low: DataFrame, rate: int = 22_050, key: str = "recording") -> DataFrame:
    """The 62 columns that the classifier is trained on, a row a recording: of audio at this rate, and of low, the same recordings at a lower one, for the band filters."""
    return scalar_columns(audio, rate, key).join(feature_columns(audio, rate, key), key).join(band_energies(band_waveform(low, key), key), key, "left")

"""Audio over rows against values by hand: separation, kernels, rhythm, constant-Q, filters."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ostinato.operators import match, spectral

RATE = 22_050


def _audio(spark, *signals, rate=RATE):
    return spark.createDataFrame([(i, rate, None if x is None else [float(v) for v in x]) for i, x in enumerate(signals, 1)], "recording int, rate int, samples array<double>")


def _clicks(seconds, every, rate=RATE):
    x = np.zeros(int(seconds * rate))
    for a in np.arange(0.1, seconds - 0.05, every):
        x[int(a * rate) : int(a * rate) + 60] = np.random.default_rng(1).normal(0, 0.8, 60)
    return x


def test_moving_median(spark):
    x = [5.0, 1.0, 4.0, 9.0, 2.0, 7.0, 3.0]
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate(x)] + [(2, 0, 8.0)], "g int, i int, x double")
    mirrored = x[1::-1] + x + x[:-3:-1]
    found = {(r.g, r.i): r.m for r in spectral.moving_median(rows, ["g"], "i", "x", 2, "m").collect()}
    assert found == {(1, i): sorted(mirrored[i : i + 5])[2] for i in range(7)} | {(2, 0): 8.0}


def test_tone_and_clicks_separate(spark):
    frames, bins, tone, click = 60, 50, 12, 30
    s = [[(5.0 if b == tone else 0.0) + (3.0 if f == click else 0.0) + 0.01 for b in range(bins)] for f in range(frames)]
    rows = spark.createDataFrame([(1, f, b, s[f][b]) for f in range(frames) for b in range(bins)], "recording int, frame int, bin int, magnitude double")
    found = {(r.frame, r.bin): r for r in spectral.separate(rows, reach=5).collect()}
    share = lambda h, p: h * h / (h * h + p * p)
    # by hand: along frames the tone's row has median 5.01, others 0.01; along bins the click's frame has 3.01, others 0.01
    for (f, b), want in {(10, tone): share(5.01, 0.01), (click, 40): share(0.01, 3.01), (click, tone): share(5.01, 3.01), (5, 5): 0.5}.items():
        r = found[f, b]
        assert math.isclose(r.harmonic, s[f][b] * want, rel_tol=1e-9) and math.isclose(r.harmonic + r.percussive, r.magnitude, rel_tol=1e-12)


def test_kernels_by_hand():
    mel = spectral.mel_rows(RATE, 2048, 40)
    area = {}
    for _, m, w in mel:
        area[m] = area.get(m, 0) + w * RATE / 2048
    assert len(area) == 40 and all(abs(a - 1) < 0.25 for m, a in area.items() if m > 12)  # wide triangles have area 1
    c = {(k, m): w for m, k, w in spectral.cosine_rows(8, 8)}
    for j in range(8):
        for k in range(8):
            assert math.isclose(sum(c[j, m] * c[k, m] for m in range(8)), float(j == k), abs_tol=1e-12)
    pitch = {}
    for b, p, w in spectral.pitch_rows(RATE, 4096):
        pitch.setdefault(b, {})[p] = w
    for name, hz in ((9, 440.0), (0, 523.25), (4, 659.26)):
        own = pitch[round(hz * 4096 / RATE)]
        assert max(own, key=own.get) == name
    assert {b for b, _, _ in spectral.contrast_bands(RATE, 2048)} == set(range(1025))


def test_cepstrum_chroma_and_contrast_of_a_tone(spark):
    t = np.arange(RATE) / RATE
    rows = spectral.spectrum(_audio(spark, 0.5 * np.sin(2 * np.pi * 440 * t), None, []))
    x = np.pad(0.5 * np.sin(2 * np.pi * 440 * t), 1024)
    mags = np.abs(np.fft.rfft(x[512 * 20 : 512 * 20 + 2048] * np.hanning(2049)[:-1]))
    found = {r.bin: r.magnitude for r in rows.filter("recording = 1 and frame = 20").collect()}
    assert rows.select("recording").distinct().count() == 1 and np.allclose([found[b] for b in range(1025)], mags, atol=1e-9)
    mel = np.zeros((1025, 128))
    for b, m, w in spectral.mel_rows(RATE, 2048):
        mel[b, m] = w
    levels = spectral.mel_levels(rows, "recording", RATE, 2048).cache()
    one = {r.mel: r.level for r in levels.filter("frame = 20").collect()}
    top = levels.agg(F.max("level")).first()[0]
    want = np.maximum(10 * np.log10(np.maximum(mags**2 @ mel, 1e-10)), top - 80)
    assert np.allclose([one[m] for m in range(128)], want, atol=1e-6)
    ceps = {r.coefficient: r.value for r in spectral.cepstrum(levels, "recording").filter("frame = 20").collect()}
    assert np.allclose([ceps[k] for k in range(10)], [sum(want[m] * math.cos(math.pi * k * (m + 0.5) / 128) for m in range(128)) * math.sqrt((2 if k else 1) / 128) for k in range(10)], atol=1e-6)
    pitches = spectral.chroma(rows, "recording", RATE, 2048).filter("frame = 20").orderBy(F.desc("level")).collect()
    assert pitches[0].pitch == 9 and pitches[0].level == 1.0
    bands = spectral.contrast_bands(RATE, 2048)
    got = {r.band: r.contrast for r in spectral.contrast(rows, "recording", bands).filter("frame = 20").collect()}
    assert max(got, key=got.get) == 2 and len(got) == 7  # 440 Hz lies between 400 and 800


def test_tonal_centre(spark):
    rows = spark.createDataFrame([(1, 0, p, 1.0 if p == 0 else 0.0) for p in range(12)], "recording int, frame int, pitch int, level double")
    found = {r.axis: r.value for r in spectral.tonnetz(rows, "recording").collect()}
    assert np.allclose([found[i] for i in range(6)], [0, 1, 0, 1, 0, 0.5], atol=1e-12)  # C is where all circles start


def test_click_track_has_its_tempo_and_beats(spark):
    audio = _audio(spark, _clicks(8, 0.5))
    rows = spectral.spectrum(audio)
    strength = spectral.onset_strength(spectral.mel_levels(rows, "recording", RATE, 2048), "recording").cache()
    speed = spectral.tempo(strength, "recording", RATE)
    lag = speed.first().lag
    assert abs(lag - 0.5 * RATE / 512) <= 1
    frames = [r.frame for r in spectral.beats(strength, speed, "recording").orderBy("frame").collect()]
    told = {r.frame for r in strength.filter("strength > 1").collect()}
    # every beat stands at a click, within one frame of where its sound enters the window
    assert len(frames) >= 14 and all(any(abs(f - x) <= 1 for x in told) for f in frames)
    assert all(abs(b - a - 0.5 * RATE / 512) <= 2 for a, b in zip(frames, frames[1:], strict=False))
    hits = spectral.onsets(strength, "recording").count()
    assert 14 <= hits <= 18


def test_tempogram_by_hand(spark):
    x = [0.0, 2.0, 1.0, 0.0, 3.0, 1.0, 0.0, 0.0, 4.0]
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate(x)] + [(2, i, 0.0) for i in range(3)], "recording int, frame int, strength double")
    found = {(r.recording, r.frame, r.lag): r.value for r in spectral.tempogram(rows, "recording", 4).collect()}
    for f in range(len(x)):
        inside = [i for i in range(f - 2, f + 2) if 0 <= i < len(x)]
        for lag in range(4):
            own = sum(x[i] * x[i + lag] for i in inside if i + lag in inside)
            zero = sum(x[i] ** 2 for i in inside)
            assert math.isclose(found[1, f, lag], own / zero if zero else 0.0, abs_tol=1e-12)
    assert all(found[2, f, lag] == 0.0 for f in range(3) for lag in range(4))


def test_tempogram_shuffles_frames_once(spark):
    """Lags become rows after the one shuffle by recording; before, rows of all lags were joined four times. Frames that lack count as 0."""
    rows = spark.createDataFrame([(1, i, float(i)) for i in (0, 1, 2, 5, 6)], "recording int, frame long, strength double")
    found = spectral.tempogram(rows, "recording", 4)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    told = {(r.frame, r.lag): r.value for r in found.collect()}
    assert told[2, 1] == 2 / 5 and told[5, 1] == 30 / 61 and told[5, 3] == 0.0 and len(told) == 20


def test_each_note_peaks_in_its_own_bin(spark):
    notes = [0, 7, 19, 31, 48, 60, 83]
    t = np.arange(RATE) / RATE
    audio = _audio(spark, *(np.sin(2 * np.pi * 32.7 * 2 ** (k / 12) * t) for k in notes))
    rows = spectral.constant_q(audio, RATE, hop=4096)
    best = rows.filter("frame = 3").groupBy("recording").agg(F.max_by("bin", "magnitude").alias("bin")).collect()
    assert {r.recording: r.bin for r in best} == dict(enumerate(notes, 1))
    assert rows.agg(F.max("magnitude")).first()[0] == 0.0


def test_constant_q_makes_fingerprints(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([np.sin(2 * np.pi * 32.7 * 2 ** (k / 12) * np.arange(RATE // 4) / RATE) * np.hanning(RATE // 4) for k in rng.integers(20, 70, 8)])
    peaks = match.find_peaks(spectral.constant_q(_audio(spark, x), RATE))
    assert peaks.count() >= 6 and match.peak_hashes(peaks).count() > 0


@pytest.mark.parametrize(("kind", "edges"), [("low", (250.0,)), ("band", (250.0, 4000.0)), ("high", (4000.0,))])
def test_filters(kind, edges):
    rate = 11_025.0
    sections = spectral.butterworth(kind, edges, rate)
    assert len(sections) == (4 if kind == "band" else 2)
    x = np.zeros(500)
    x[0] = 1.0
    x[3] = -2.0
    y = x
    for b0, b1, b2, a1, a2 in sections:  # sample by sample
        s1 = s2 = 0.0
        out = []
        for v in y:
            o = b0 * v + s1
            s1, s2 = b1 * v - a1 * o + s2, b2 * v - a2 * o
            out.append(o)
        y = np.array(out)
    assert np.allclose(spectral.filtered(x, sections, block=7), y, atol=1e-12) and np.allclose(spectral.filtered(x, sections), y, atol=1e-12)

    def gain(hz):
        z = np.exp(2j * np.pi * hz / rate)
        return abs(np.prod([(b0 + b1 / z + b2 / z**2) / (1 + a1 / z + a2 / z**2) for b0, b1, b2, a1, a2 in sections]))

    for e in edges:
        assert math.isclose(gain(e), math.sqrt(0.5), rel_tol=1e-6)  # half the power at an edge
    # flat to the fourth order: 1 / sqrt(1 + (ratio of warped frequencies)^8)
    if kind != "band":
        warp = lambda f: math.tan(math.pi * f / rate)
        ratio = warp(900) / warp(edges[0]) if kind == "low" else warp(edges[0]) / warp(900)
        assert math.isclose(gain(900), 1 / math.sqrt(1 + ratio**8), rel_tol=1e-6)


def test_waveform_chunks_start_from_rest(spark):
    rate, x = 1000, np.random.default_rng(2).normal(0, 1, 2500)
    audio = _audio(spark, x, None, [], rate=rate)
    rows = spectral.band_waveform(audio, edges=(50.0, 200.0), step=10, chunk=1).cache()
    found = {r.at: (r.bass, r.mid, r.treble) for r in rows.collect()}
    assert sorted(found) == list(range(250))
    for c in range(3):
        own = np.abs(spectral.filtered(x[c * 1000 : (c + 1) * 1000], spectral.butterworth("low", (50.0,), 1000.0))[::10])
        assert np.allclose([found[c * 100 + i][0] for i in range(len(own))], own)
    e = spectral.band_energies(rows).first()
    a = np.array([found[i] for i in range(250)])
    assert np.allclose([e.bass_energy, e.mid_energy, e.treble_energy, e.energy], [*a.mean(axis=0), a.mean(axis=0).sum()])
    assert math.isclose(e.dynamic_range, 20 * math.log10(a.sum(axis=1).max() + 1e-10) - 20 * math.log10(a.sum(axis=1).mean() + 1e-10))
    assert spectral.scaled_bands(rows).agg(F.max("bass"), F.max("mid"), F.max("treble")).first() == (1.0, 1.0, 1.0)


def test_feature_columns(spark):
    t = np.arange(4 * RATE) / RATE
    found = spectral.feature_columns(_audio(spark, _clicks(4, 0.5) + 0.2 * np.sin(2 * np.pi * 440 * t), 0.5 * np.sin(2 * np.pi * 440 * t)), RATE)
    rows = {r.recording: r for r in found.collect()}
    assert len(found.columns) == 26 and all(v is not None and math.isfinite(v) for r in rows.values() for v in r)
    assert rows[1].perc_harm_ratio > 5 * rows[2].perc_harm_ratio and math.isclose(rows[2].harmonic_energy, 0.5 / math.sqrt(2), rel_tol=0.1)
    assert abs(rows[1].tempo - 120) < 4 and abs(rows[1].beat_interval_mean - 0.5) < 0.03 and round(rows[2].chroma_centroid) == 9


def test_scalar_columns_against_numpy(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(0, 0.2, RATE) * np.linspace(0.2, 1, RATE)
    r = spectral.scalar_columns(_audio(spark, x, None), RATE).first()
    padded = np.pad(x, 1024)
    frames = np.array([padded[a : a + 2048] for a in range(0, len(padded) - 2047, 512)])
    rms = np.sqrt((frames**2).mean(axis=1))
    mag, hz = np.abs(np.fft.rfft(frames * np.hanning(2049)[:-1], axis=1)), np.arange(1025) * RATE / 2048
    share = mag / mag.sum(axis=1, keepdims=True)
    centre = (share * hz).sum(axis=1)
    cum = np.cumsum(mag, axis=1)
    bass = mag[:, (hz >= 60) & (hz < 150)].mean()
    wanted = {
        "rms_mean": rms.mean(), "rms_std": rms.std(), "rms_p10": np.percentile(rms, 10), "rms_p90": np.percentile(rms, 90), "energy_slope": np.polyfit(np.arange(len(rms)), rms, 1)[0], "peak_amplitude": np.abs(x).max(),
        "spectral_centroid": centre.mean(), "spectral_centroid_std": centre.std(), "spectral_bandwidth": np.sqrt((share * (hz[None] - centre[:, None]) ** 2).sum(axis=1)).mean(),
        "spectral_rolloff": hz[(cum >= 0.85 * cum[:, -1:]).argmax(axis=1)].mean(), "spectral_flatness": (np.exp(np.log(np.maximum(mag**2, 1e-10)).mean(axis=1)) / np.maximum(mag**2, 1e-10).mean(axis=1)).mean(),
        "spectral_entropy": -(share * np.log(share + 1e-10)).sum(axis=1).mean(), "bass_mean": bass, "bass_ratio": bass / mag.mean(), "intro_energy_ratio": np.abs(x[: RATE // 5]).mean() / np.abs(x).mean(),
        "zero_crossing_rate": np.diff(np.signbit(frames), axis=1).mean(), "crest_factor": np.abs(x).max() / rms.mean(),
    }
    for name, v in wanted.items():
        assert math.isclose(r[name], v, rel_tol=1e-6), name


def test_all_62_columns(spark):
    x = _clicks(2, 0.5) + 0.1 * np.sin(2 * np.pi * 330 * np.arange(2 * RATE) / RATE)
    found = spectral.all_columns(_audio(spark, x), _audio(spark, x[::2], rate=RATE // 2))
    row = found.first()
    assert len(found.columns) == 63 and all(v is not None and math.isfinite(v) for v in row)
    from ostinato.operators import learning

    assert {c for group in learning.COLUMNS.values() for c in group} == set(found.columns) - {"recording"}


def test_top_peaks_keep_ties(spark):
    level = [9.0, 7.0, 7.0, 7.0, 5.0, 4.0]
    rows = [(r, 20 * i, 40, v + 40) for r in (1, 2) for i, v in enumerate(level)] + [(r, f, b, 0.0) for r in (1, 2) for f in range(0, 120, 3) for b in (0, 80)]
    spectrum = spark.createDataFrame(rows, "recording int, frame int, bin int, magnitude double")
    for most, want in ((1, 1), (2, 4), (4, 4), (5, 5), (100, 6)):
        found = match.find_peaks(spectrum, most=most).groupBy("recording").count().collect()
        assert {r.recording: r["count"] for r in found} == {1: want, 2: want}

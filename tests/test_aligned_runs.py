"""Aligned runs and windowed screening against all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from ostinato.operators import similar


def _cos(a, b):
    n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b, strict=True)) / n if n else None


def _brute(frames, asked, threshold, step, overlap):
    best = {}
    by = {}
    for rec, f, v in frames:
        by.setdefault(rec, {})[f] = v
    for rec, own in by.items():
        for off in range(overlap - len(asked), max(own) + 1, step):
            run = []
            for i, q in [*asked, (max(i for i, _ in asked) + 2, None)]:
                c = _cos(own[off + i], q) if q and off + i in own else None
                if c is not None and c >= threshold:
                    run.append(c)
                elif run:
                    best[rec] = min(best.get(rec, (0, 0, 0)), (-len(run), -sum(run) / len(run), off))
                    run = []
    return {rec: (-n, round(-m, 9), off) for rec, (n, m, off) in best.items() if n}


@pytest.mark.parametrize(("step", "overlap", "threshold", "head"), [(1, 1, 0.5, 2), (1, 10, 0.9, 3), (3, 5, 0.3, 6), (7, 4, -2.0, 1)])
def test_runs_against_all_offsets(spark, step, overlap, threshold, head):
    rng = random.Random(step)
    vec = lambda: [0.0] * 6 if rng.random() < 0.05 else [rng.gauss(0, 1) for _ in range(6)]
    song = [vec() for _ in range(25)]
    frames = [(1, f, song[f % 25]) for f in range(40)] + [(2, f, vec()) for f in range(30)] + [(3, f, [x + 0.1 for x in song[(f + 5) % 25]]) for f in range(20)]
    asked = list(enumerate(song))
    f = spark.createDataFrame(frames, "recording int, frame int, v array<double>")
    q = spark.createDataFrame(asked, "i int, qv array<double>")
    found = similar.sustained_runs(f, q, threshold, step, overlap, head)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert {r.recording: (r.run, round(r.mean, 9), r.off) for r in found.collect()} == _brute(frames, asked, threshold, step, overlap)


@pytest.mark.parametrize(("step", "band", "block"), [(1, 4, 8), (1, 64, 16), (2, 3, 7)])
def test_runs_go_on_from_block_to_block(spark, step, band, block):
    rng = random.Random(block)
    song = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(40)]
    frames = [(r, f, song[(f + 3 * r) % 40] if f % 23 else [rng.gauss(0, 1) for _ in range(4)]) for r in range(3) for f in range(60) if f != 31]
    asked = [(0, i, song[i]) for i in range(40)] + [(1, i, song[i + 5]) for i in range(20)]
    f = spark.createDataFrame(frames, "recording int, frame int, v array<double>")
    q = spark.createDataFrame(asked, "variant int, i int, qv array<double>")
    found = {(r.variant, r.recording): (r.run, round(r.mean, 9), r.off) for r in similar.variant_runs(f, q, 0.4, step, 1, band, block).collect()}
    for k in (0, 1):
        wanted = _brute(frames, [(i, v) for x, i, v in asked if x == k], 0.4, step, 1)
        assert {r: x for (v, r), x in found.items() if v == k} == wanted


def test_pairs_of_frames_make_no_rows(spark):
    """A row a pair of frames, which was made before, is the square of their number."""
    frames = [(r, f, [1.0, float(f % 3), float(f % 5)]) for r in range(2) for f in range(60)]
    f = spark.createDataFrame(frames, "recording int, frame int, v array<double>")
    q = f.filter("recording = 0").select(F.col("frame").alias("i"), F.col("v").alias("qv"))
    plan = similar.sustained_runs(f, q, 0.2, 1, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    library, windows = f.select(F.col("frame").alias("track"), "v"), q.select(F.col("qv").alias("q"))
    plan = similar.windowed(library, windows)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "FlatMapGroupsInArrow" in plan


@pytest.mark.parametrize("block", [1, 3, 256])
def test_windows_in_blocks(spark, block):
    rng = random.Random(block)
    tracks = [(t, [rng.gauss(0, 1) for _ in range(4)]) for t in range(20)] + [(20, [0.0] * 4)]
    windows = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(7)] + [[0.0] * 4]
    lib, win = spark.createDataFrame(tracks, "track int, v array<double>"), spark.createDataFrame([(w,) for w in windows], "q array<double>")
    found = {r.track: r.score for r in similar.windowed(lib, win, block).collect()}
    for t, v in tracks:
        wanted = max((c for w in windows if (c := _cos(v, w)) is not None), default=None)
        assert found[t] == wanted or math.isclose(found[t], wanted, rel_tol=1e-12)
    plan = similar.windowed(lib, win, block)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert all(r.score is None for r in similar.windowed(lib, win.limit(0)).collect())
    assert similar.windowed(lib, win.filter(F.lit(False))).count() == 21

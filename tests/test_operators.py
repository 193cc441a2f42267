import math
import random
import wave

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ostinato.operators import audio, dedup, external, frames, intervals, learning, library, match, similar
from ostinato.sources import cache, cue, files
from ostinato.streaming import beats, events


def test_match_finds_the_stretched_track(spark):
    rng = random.Random(1)
    lib = [(1, i, 500 * i) for i in range(200)] + [(2, i, rng.randrange(100_000)) for i in range(200)]
    asked = [(0, 0, i, int(60_000 + 1.02 * 500 * i)) for i in range(200)]
    found = match.match_global(spark.createDataFrame(asked, "recording int, segment int, hash long, t long"), spark.createDataFrame(lib, "track long, hash long, t long")).collect()
    assert len(found) == 1
    r = found[0]
    assert (r.track, r.match_count, r.start, r.span, r.confidence) == (1, 200, 60_000, 101_490, 1.0)
    assert math.isclose(r.ratio, 1.02)


@pytest.mark.parametrize("crowded", [2**20, 20])
def test_stretched_aligns_all_rates_at_once(spark, crowded):
    """As by a search of the segments once a rate, which made each pair eleven times."""
    from pyspark.sql import Window

    rng = random.Random(5)
    lib = [(k, h, 1000 * rng.randrange(12)) for k in range(12) for h in rng.sample(range(90), 40)] + [(20, h, 500) for h in range(6)] + [(21, h, 700 * h) for h in range(60)]
    asked = [(r, 0, h, int(900 + 1.13 * 700 * h) if r == 0 else 1000 * rng.randrange(12)) for r in range(3) for h in range(0, 90, 1 + r)]
    q, known = spark.createDataFrame(asked, "recording int, segment int, hash long, t long"), spark.createDataFrame(lib, "track long, hash long, t long")
    rates = q.withColumn("rate_i", F.explode(F.sequence(F.lit(0), F.lit(10)))).withColumn("t", (F.col("t") / match.ratio("stretch", F.col("rate_i"))).cast("long"))
    old = match.match_segments(rates, known, ("recording", "rate_i"), "segment")
    order = Window.partitionBy("recording").orderBy(F.desc("match_count"), "rate_i", "track")
    wanted = old.withColumn("r", F.row_number().over(order)).filter("r = 1").select("recording", "track", "match_count", (match.ratio("stretch", F.col("rate_i")) * F.col("ratio")).alias("ratio"), "confidence")
    found = match.stretched(q, known, crowded=crowded)
    assert sorted(map(tuple, found.collect())) == (told := sorted(map(tuple, wanted.collect()))) and (0, 21) in [x[:2] for x in told]
    assert "rate_i" not in match.hash_pairs(q, known, ["recording"]).columns


def test_narrow_offsets_use_the_median(spark):
    pairs = spark.createDataFrame([(0, 1, 1000 + i, 1000) for i in range(7)], "recording int, track int, qt long, dt long")
    best = match.tempo_histogram(pairs, ["recording"]).first()
    assert (best.peak, best.i, best.center) == (7, 0, 83)


def test_merge_folds_ratios_pairwise(spark):
    rows = [(0, 1, s, 20_000, 0.5, 10, 0, r) for s, r in ((0, 1.0), (10_000, 1.1), (20_000, 1.2))] + [(0, 1, 900_000, 1000, 0.9, 3, 0, 1.0)]
    found = match.merge_matches(spark.createDataFrame(rows, "recording int, track int, start long, span long, confidence double, match_count int, track_start long, ratio double")).collect()
    assert len(found) == 1 and math.isclose(found[0].ratio, 1.125) and found[0].match_count == 30


def test_peak_pairs_take_the_nearest_three(spark):
    peaks = [(0, 0, 40, 1.0), (0, 2, 41, 1.0), (0, 2, 42, 5.0), (0, 3, 40, 1.0), (0, 4, 40, 9.0), (0, 40, 40, 1.0)]
    found = match.peak_hashes(spark.createDataFrame(peaks, "recording int, frame int, bin int, magnitude double")).filter("t = 0").collect()
    assert [(r.hash >> 18) & 127 for r in sorted(found, key=lambda r: (r.hash >> 6) & 63)][0] in (41, 42) and len(found) == 3


def test_packed_hash(spark):
    row = spark.range(1).select(match.pack_hash(*map(F.lit, (83, 80, 5, -3, 31)))).first()[0]
    assert row == 83 << 25 | 80 << 18 | 29 << 12 | 5 << 6 | 31


@pytest.mark.parametrize(("entries", "flags"), [([(0, 180_000), (120_000, 180_000)], ["overlap", "overlap"]), ([(0, 120_000), (180_000, 120_000)], ["gap-next", "gap-prev"]), ([(0, 120_000), (120_000, 120_000)], ["", ""])])
def test_interval_flags(spark, entries, flags):
    df = spark.createDataFrame([(0, i, s, d) for i, (s, d) in enumerate(entries)], "g int, k int, start long, duration long")
    assert [r.flag for r in intervals.flags(df, "g", "k").orderBy("k").collect()] == flags


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 300_000), st.integers(0, 90_000)), max_size=12))
def test_overlaps_against_all_pairs(spark, entries):
    df = spark.createDataFrame([(0, i, s, d) for i, (s, d) in enumerate(entries)], "g int, k int, start long, duration long")
    wanted = {(i, j) for i, (s, d) in enumerate(entries) for j, (s2, d2) in enumerate(entries) if i != j and s < s2 + d2 and s + d > s2}
    assert {(r.a, r.b) for r in intervals.overlaps(df, "g", "k").collect()} == wanted
    flagged = {r.k for r in intervals.flags(df, "g", "k").filter("flag = 'overlap'").collect()}
    assert flagged == {i for i, _ in wanted}


def test_cue_sheets(spark, tmp_path):
    text = 'PERFORMER "DJ"\nTITLE "Mix"\nFILE "m.wav" WAVE\n  TRACK 01 AUDIO\n    TITLE "One"\n    PERFORMER "A \\"q\\""\n    INDEX 01 00:00:00\n  TRACK 02 AUDIO\n    INDEX 00 03:00:00\n    INDEX 01 03:05:00\n  TRACK 03 AUDIO\n    TITLE "Three"\n    INDEX 01 06:10:37\n'
    (tmp_path / "a.cue").write_text(text)
    found = cue.parse(cue.lines_of(spark, str(tmp_path / "*.cue"))).orderBy("index").collect()
    assert [(r.start_ms, r.duration_ms, r.performer, r.title) for r in found] == [(0, 185_000, 'A "q"', "One"), (185_000, 185_000, "", ""), (370_000, 0, "", "Three")]
    empty = spark.createDataFrame([("s", 0, 'TITLE "x"')], "sheet string, no int, line string")
    with pytest.raises(ValueError, match="no tracks"):
        cue.require(cue.parse(empty), empty)
    with pytest.raises(ValueError, match="no entries"):
        cue.write(spark.createDataFrame([], "sheet string, start_ms long, performer string, title string"), str(tmp_path / "out"))


def _track(i, artist, title, filename, path="/music/t.mp3", mode="collection"):
    return (i, artist, title, filename, path, mode)


@pytest.mark.parametrize(
    ("known", "asked", "status"),
    [
        (("Daft Punk", "Get Lucky", "track.mp3"), ("", "", "Daft Punk - Get Lucky.mp3"), "red"),
        (("X", "GetLucky", "q.mp3"), ("", "", "GetLucky.mp3"), "orange"),
        (("Daft Punk", "Get Lucky", "track.mp3"), ("", "", "Completely Unknown Track.mp3"), "green"),
        (("daft punk", "get lucky", "track.mp3"), ("", "", "DAFT PUNK - GET LUCKY.mp3"), "red"),
        (("", "", "daft-punk-get-lucky.mp3"), ("", "", "daft punk get lucky.mp3"), "orange"),
        (("", "", "beethoven-symphony.mp3"), ("", "", "totally_different_song.mp3"), "green"),
        (("", "", "my_great_track.mp3"), ("", "", "my_great_track.mp3"), "orange"),
        (("a", "b", "c.mp3"), ("", "", ""), "green"),
    ],
)
def test_duplicate_check(spark, known, asked, status):
    schema = "id int, artist string, title string, filename string, filepath string, mode string"
    lib, new = spark.createDataFrame([_track(1, *known)], schema), spark.createDataFrame([_track(9, *asked, mode="curating")], schema)
    assert dedup.check(new, lib).first().status == status
    assert dedup.check(new, lib.limit(0)).first().status == "green"


def test_sustained_runs(spark):
    e1, e2 = [1.0, 0.0], [0.0, 1.0]
    same = spark.createDataFrame([(1, i, e1) for i in range(60)] + [(2, i, e2) for i in range(60)], "recording int, frame int, v array<double>")
    asked = spark.createDataFrame([(i, e1) for i in range(60)], "i int, qv array<double>")
    found = {r.recording: r for r in similar.sustained_runs(same, asked, 0.9, step=1, overlap=10).collect()}
    assert found[1].run == 60 and found[1].mean == 1.0 and 2 not in found


def test_linked_lists_are_sound(spark):
    rows = spark.createDataFrame([(k, 10 * k + i, i) for k in range(3) for i in range(1, 5)], "list_id int, track_id int, position int")
    assert [(r.entries, r.tails, r.dangling) for r in external.verify(external.linked(rows)).collect()] == [(4, 1, 0)] * 3


def test_month_folder_decides(spark):
    own = spark.createDataFrame([("a", "/m/2024-07/a.mp3"), ("b", "/m/b.mp3")], "name string, filepath string")
    other = spark.createDataFrame([("a", 1, "x/2024-07/a"), ("a", 2, "x/2024-08/a"), ("b", 3, "p"), ("b", 4, "q")], "name string, id int, path string")
    assert {r.name: r.id for r in external.resolve(own, other, "name", "id", "path").collect()} == {"a": 1, "b": 4}


def test_recommend_without_plays(spark):
    tracks = spark.createDataFrame([(i, f"a{i % 3}", f"g{i % 2}") for i in range(20)], "id int, artist string, genre string")
    none = spark.createDataFrame([], "track_id int, played_at timestamp, completed boolean")
    now = F.lit("2024-01-31").cast("timestamp")
    assert library.recommend(tracks, none, now, 5).count() == 5


def test_merge_columns_refuses_unknown(spark):
    df = spark.createDataFrame([(1, 2)], "id int, a int")
    with pytest.raises(ValueError, match="unknown"):
        library.merge_columns(df, df.withColumn("zz", F.lit(1)), "id")


def test_models_survive_saving(spark, tmp_path):
    rows = spark.createDataFrame([(i, float(i % 7), float(i % 3), int(i % 7 > 3)) for i in range(80)], "id int, a double, b double, y_H int")
    models = learning.LabelModels("random_forest", ["a", "b"], ["H"], numTrees=5, maxDepth=3).fit(rows)
    digest = learning.save(models, str(tmp_path))
    again = learning.load(spark, str(tmp_path), digest)
    assert learning.evaluate(again, rows).first() == learning.evaluate(models, rows).first()
    assert learning.evaluate(models, rows).first().f1_micro > 0.9
    with pytest.raises(ValueError, match="digest"):
        learning.load(spark, str(tmp_path), None)


def _wav(path, seconds=3, rate=22_050, hz=440.0):
    x = (np.sin(2 * np.pi * hz * np.arange(seconds * rate) / rate) * 20_000).astype("<i2")
    with wave.open(str(path), "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(rate), w.writeframes(x.tobytes())


def test_audio_files(spark, tmp_path):
    _wav(tmp_path / "a.wav")
    (tmp_path / "bad.wav").write_bytes(b"no")
    raw = files.write_info((tmp_path / "a.wav").read_bytes(), {"title": "T", "artist": "A"})
    assert files.read_info(files.write_info(raw, {"artist": ""})) == {"title": "T"}
    (tmp_path / "a.wav").write_bytes(raw)
    rows = {r.path.rsplit("/", 1)[1]: r for r in files.read_audio(spark, str(tmp_path)).collect()}
    assert rows["bad.wav"].samples is None and len(rows["a.wav"].samples) == 3 * 22_050 and rows["a.wav"].tags["title"] == "T"
    spectrum = audio.spectra(files.read_audio(spark, str(tmp_path)).filter("samples is not null").select(F.lit(1).alias("recording"), "rate", "samples"))
    top = spectrum.filter("frame = 30").orderBy(F.desc("magnitude")).first()
    assert abs(32.7 * 2 ** (top.bin / 12) - 440) < 30
    found = audio.feature_rows(files.read_audio(spark, str(tmp_path)).filter("samples is not null").select(F.lit(1).alias("recording"), "rate", "samples")).first().features
    assert abs(found["spectral_centroid"] - 440) < 60 and found["low_mid_ratio"] > 1
    listed = files.scan(spark, str(tmp_path)).collect()
    assert [r.filename for r in listed] == ["a.wav", "bad.wav"]
    assert files.scan(spark, str(tmp_path), known=files.scan(spark, str(tmp_path)).limit(1)).count() == 1


def test_waveform_bands():
    t = np.arange(11_025 * 12) / 11_025
    bands = audio.three_bands(np.sin(2 * np.pi * 100 * t))
    assert len({len(v) for v in bands.values()}) == 1 and bands["bass"].max() == 1.0


def test_entry_cache(spark, tmp_path):
    (tmp_path / "e.json").write_text('{"start_time_ms": 5, "title": "t"}\nnot json\n')
    found = cache.load_entries(spark, str(tmp_path / "e.json")).collect()
    assert len(found) == 1 and found[0].time_stretch_ratio == 1.0 and found[0].status == "pending"
    assert cache.load(spark, str(tmp_path), "none") is None


def test_beats():
    state, hits = beats.State(), []
    levels = [0.1] * 40 + [0.9] + [0.1] * 2 + [0.9] + [0.1] * 5 + [0.9]
    for i, x in enumerate(levels):
        if beats.beat(state, x):
            hits.append(i)
    assert hits == [40, 49]


def test_stream_agrees_with_batch(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [("s", i, rng.normal(size=64).tolist()) for i in range(12)]
    schema = "source string, frame long, samples array<double>"
    for k in range(3):
        spark.createDataFrame(rows[4 * k : 4 * k + 4], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = beats.stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("beats").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = {r.frame: r for r in spark.table("beats").collect()}
    want = {r.frame: r for r in beats.batch(spark.createDataFrame(rows, schema)).collect()}
    assert set(got) == set(want)


def test_bus_outlives_a_failing_handler(spark):
    bus, seen = events.Bus(), []
    bus.subscribe("a", lambda df: 1 / 0)
    bus.subscribe("a", lambda df: seen.append(df.count()))
    bus.emit(spark.createDataFrame([("a", 1), ("b", 2)], "event_type string, v int"))
    assert seen == [1] and len(bus.failed) == 1


def test_queue(spark):
    items = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "item string, at int")
    first = spark.createDataFrame([("c", 1), ("c", 2)], "item string, at int")
    assert [r.item for r in events.queue(items, first).orderBy("place").collect()] == ["c", "a", "b"]


def test_spaced(spark):
    df = spark.createDataFrame([(0, f) for f in (1, 3, 5, 9)], "g int, f int")
    assert sorted(r.f for r in frames.spaced(df, "g", "f", 4).collect()) == [1, 5, 9]


def test_index_from_files_to_cue_sheet(spark, tmp_path):
    from ostinato.operators import index
    from ostinato.sources.snapshots import Store

    rng = np.random.default_rng(4)
    for name in ("a", "b"):
        x = np.concatenate([np.sin(2 * np.pi * 2.0 ** (rng.integers(12, 60) / 12) * 55 * np.arange(11_025) / 22_050) for _ in range(12)])
        with wave.open(str(tmp_path / f"{name}.wav"), "wb") as w:
            w.setnchannels(1), w.setsampwidth(2), w.setframerate(22_050), w.writeframes((x * 20_000).astype("<i2").tobytes())
    store = Store(spark, str(tmp_path / "store"))
    tracks = [(1, str(tmp_path / "a.wav"), "A", "One", "collection"), (2, str(tmp_path / "b.wav"), "B", "Two", "collection")]
    with store.transaction():
        store.write("tracks", spark.createDataFrame(tracks, "id long, filepath string, artist string, title string, mode string"))
        store.write("fingerprints", spark.createDataFrame([], "track long, hash long, t long"))
        store.write("vectors", spark.createDataFrame([(9, "mfcc", [0.0])], "track long, kind string, v array<double>"))
    own = index.Index(store)
    assert index.scan_and_index(spark, own, str(tmp_path)) > 20 and own.pending().count() == 0
    assert own.stats().first().indexed == 2
    asked = store.read("fingerprints").filter("track = 2").select(F.lit("mix").alias("recording"), "hash", "t")
    assert own.identify(asked).first().track == 2
    assert own.cleanup() == 1
    with pytest.raises(ZeroDivisionError), store.transaction():
        own.clear()
        raise ZeroDivisionError
    assert own.stats().first().fingerprints > 0
    own.clear()
    assert own.stats().first().fingerprints == 0


def test_long_entries_touch_few_slots(spark):
    """Entries as long as thousands of slots: before, each stood in every slot that it touched."""
    import random

    rng = random.Random(5)
    rows = [(k % 3, k, rng.randrange(10**9), rng.choice([0, 1, 59_999, 10**5, 10**7, 5 * 10**8])) for k in range(150)]
    df = spark.createDataFrame(rows, "g int, k int, start long, duration long")
    wanted = sorted((g, a, b) for g, a, s, d in rows for h, b, t, e in rows if g == h and a != b and s < t + e and s + d > t)
    assert sorted(map(tuple, intervals.overlaps(df, "g", "k").collect())) == wanted
    longest = [r[0] for r in intervals.overlaps(df.filter("duration > 1e8").withColumn("start", df.start + 10**12), "g", "k", 1).limit(1).collect()]
    assert longest


def test_cue_numbers_and_ties(spark):
    rows = [("s", i * 1000, "p", "t", 0.5) for i in range(101)]
    df = spark.createDataFrame(rows, "sheet string, start_ms long, performer string, title string, confidence double")
    assert "TRACK 101 AUDIO" in cue.render(df).first().text
    fixed = cue.render(df, digits=2).first().text
    assert "TRACK 101" not in fixed and fixed.count("  TRACK 10 AUDIO") == 3
    same = spark.createDataFrame([("s", 0, "p", "t", k / 100, k) for k in (7, 3, 9, 1)], "sheet string, start_ms long, performer string, title string, confidence double, tie int")
    assert [r.line[-4:] for r in cue.readable(same).orderBy("line").collect()] == [" (1%)"[-4:], " (3%)"[-4:], " (7%)"[-4:], " (9%)"[-4:]]


def test_entries_without_a_start_or_title_come_last(spark, tmp_path):
    """As in the SQL of a11 and a10; before, they came first and took the others' numbers, and a null id was written as null%."""
    import duckdb

    from ostinato.plans import registry

    registry.load()
    con = duckdb.connect()
    part = "case when event_id % 50 = 3 then null else event_id end as event_id, case when event_id % 41 = 0 then null else ts end as ts, case when event_id % 37 = 0 then null else user_id end as user_id, case when event_id % 7 = 0 then null else event_type end as event_type"
    con.sql(f"copy (select * replace ({part}) from '/root/testdata/sf0.001/events.parquet') to '{tmp_path}/events.parquet'")
    con.sql(f"create view events as select * from '{tmp_path}/events.parquet'")
    for name, cols in (("a11_readable_cues", "sheet, start_ms, line"), ("a10_cue_text", "sheet, text")):
        found = registry.QUERIES[name](spark, str(tmp_path)).selectExpr(*cols.split(", ")).collect()
        assert sorted(map(str, map(tuple, found))) == sorted(map(str, con.sql(f"select {cols} from ({registry.ORACLES[name]})").fetchall()))

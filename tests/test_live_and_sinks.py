"""The live source with its trigger, the sink with a commit, machines with a radial kernel."""

import time
import wave

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from ostinato.operators import kernel, learning
from ostinato.sources import files, tagged
from ostinato.streaming import captures

FRAME = 16


def _append(path, a, z, extra=0):
    with open(path, "ab") as f:
        for i in range(a, z):
            f.write(np.full(FRAME, i % 30_000, "<i2").tobytes())
        f.write(b"\1" * extra)


def _until(query, seen, n):
    for _ in range(600):
        if len(seen) >= n or not query.isActive:
            break
        time.sleep(0.1)


def test_restart_loses_and_repeats_nothing(spark, tmp_path):
    folder, checkpoint = tmp_path / "in", str(tmp_path / "checkpoint")
    folder.mkdir()
    _append(folder / "a.pcm", 0, 70)
    _append(folder / "b.pcm", 0, 5)
    batches, seen = {}, []

    def keep(batch, number):
        rows = [(r.source, r.frame, round(r.samples[0] * 32768)) for r in batch.collect()]
        batches[number] = rows
        seen.extend(rows)

    def fail(batch, number):
        if number == failing:
            batch.collect()
            raise RuntimeError("cut off")
        keep(batch, number)

    stream = lambda: captures.live(spark, str(folder), FRAME, most=30, part=8)
    one = captures.poll(stream(), keep, checkpoint, "20 milliseconds")
    _until(one, seen, 75)
    one.stop()
    assert sorted(seen) == sorted([("a", i, i) for i in range(70)] + [("b", i, i) for i in range(5)])
    assert all(sum(r[0] == s for r in rows) <= 30 for rows in batches.values() for s in "ab") and len(batches) >= 3
    _append(folder / "a.pcm", 70, 100, extra=7)  # and a part of a frame
    _append(folder / "c.pcm", 0, 40)
    failing = max(batches) + 1
    two = captures.poll(stream(), fail, checkpoint, "20 milliseconds")
    with pytest.raises(Exception, match="cut off"):
        two.awaitTermination(60)
    assert len(seen) == 75
    three = captures.poll(stream(), keep, checkpoint, "20 milliseconds")
    _until(three, seen, 145)
    three.stop()
    wanted = [("a", i, i) for i in range(100)] + [("b", i, i) for i in range(5)] + [("c", i, i) for i in range(40)]
    assert sorted(seen) == sorted(wanted)


def _wav(path, seconds=0.01):
    with wave.open(str(path), "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(8000), w.writeframes(np.zeros(int(8000 * seconds), "<i2").tobytes())


def test_tags_are_written_all_or_none(spark, tmp_path):
    for i in range(6):
        _wav(tmp_path / f"{i}.wav")
    schema = "path string, tags map<string,string>"
    tags = [(str(tmp_path / f"{i}.wav"), {"title": f"T{i}", "artist": "A"}) for i in range(6)]
    assert tagged.write_tags(spark, str(tmp_path), spark.createDataFrame(tags, schema).repartition(3)) == 6
    read = lambda: {p.name: files.read_info(p.read_bytes()) for p in sorted(tmp_path.glob("*.wav"))}
    assert read() == {f"{i}.wav": {"title": f"T{i}", "artist": "A"} for i in range(6)}
    before = {p.name: p.read_bytes() for p in tmp_path.glob("*.wav")}
    lost = [(p, {"artist": ""}) for p, _ in tags] + [(str(tmp_path / "none.wav"), {"title": "x"})]
    for rows in (lost, [*lost[:6], lost[0]]):  # a task that fails; a file that is named twice
        with pytest.raises(Exception):  # noqa: B017
            tagged.write_tags(spark, str(tmp_path), spark.createDataFrame(rows, schema).repartition(3))
        assert {p.name: p.read_bytes() for p in tmp_path.glob("*.wav")} == before
        assert not [p for p in tmp_path.iterdir() if p.name.startswith("_tags-")]
    assert tagged.write_tags(spark, str(tmp_path), spark.createDataFrame([], schema)) == 0


def test_a_commit_that_was_cut_off_is_finished(tmp_path):
    for i in range(3):
        _wav(tmp_path / f"{i}.wav")
    writer = tagged.TagWriter(str(tmp_path))
    said = writer.write(iter([{"path": str(tmp_path / f"{i}.wav"), "tags": {"title": "new"}} for i in range(3)]))
    store, aside = tagged.store_of(writer.aside)
    with store.open_output_stream(f"{aside}/moves.json") as f:
        f.write(__import__("json").dumps(said.moves).encode())
    store.move(*said.moves[0])  # the first move was done
    other = tagged.TagWriter(str(tmp_path))
    other.write(iter([{"path": str(tmp_path / "0.wav"), "tags": {"title": "never"}}]))
    assert tagged.recover(str(tmp_path)) == 1 and tagged.recover(str(tmp_path)) == 0
    assert [files.read_info((tmp_path / f"{i}.wav").read_bytes()) for i in range(3)] == [{"title": "new"}] * 3
    assert sorted(p.name for p in tmp_path.iterdir()) == ["0.wav", "1.wav", "2.wav"]


def _rings(spark, n=300):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(n):
        y = i % 2
        a, r = rng.uniform(0, 2 * np.pi), (1.0 if y else 3.0) + rng.normal(0, 0.2)
        rows.append((i, float(r * np.cos(a)), float(r * np.sin(a)), y))
    return spark.createDataFrame(rows, "id long, a double, b double, y_R int").withColumn("y_S", 1 - F.col("y_R"))


def test_fourier_features_are_near_the_kernel(spark):
    df = _rings(spark, 40).withColumn("v", array_to_vector(F.array("a", "b")))
    made = kernel.FourierFeatures(inputCol="v", outputCol="f", gamma=0.3, size=4000, seed=1).transform(df)
    rows = made.select("a", "b", vector_to_array("f").alias("f")).collect()
    for x, y in zip(rows, rows[5:], strict=False):
        assert abs(np.dot(x.f, y.f) - np.exp(-0.3 * ((x.a - y.a) ** 2 + (x.b - y.b) ** 2))) < 0.08


def test_two_rings_separate(spark, tmp_path):
    train, test = learning.split(_rings(spark), "id", 0.3)
    radial = learning.LabelModels("svm", ["a", "b"], ["R", "S"], size=128, maxIter=30).fit(train)
    assert learning.evaluate(radial, test).first()["f1_micro"] > 0.95
    straight = learning.LabelModels("linear_svm", ["a", "b"], ["R", "S"], maxIter=20).fit(train)
    assert learning.evaluate(straight, test).first()["f1_micro"] < 0.8
    p = {r.id: r.probabilities for r in radial.predict_proba(test).collect()}
    assert all(0 <= x <= 1 for m in p.values() for x in m.values())
    # margins became probabilities: far from the border they are sure
    assert sum(max(m["R"], 1 - m["R"]) > 0.8 for m in p.values()) > 0.8 * len(p)
    digest = learning.save(radial, str(tmp_path / "m"))
    again = learning.load(spark, str(tmp_path / "m"), digest)
    told = {r.id: r.probabilities for r in again.predict_proba(test).collect()}
    assert all(abs(told[i]["R"] - p[i]["R"]) < 1e-9 for i in p)

"""The stored index against a search by hand: appending, taking out, merging, pruned reads."""

import math
import random

import pytest
from pyspark.sql import functions as F

from ostinato.operators import search, text_index

WORDS = ["red", "blue", "widget", "ring", "bolt", "nut", "the", "ünder"]


def _rows(rng, ids):
    return [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(0, 12))) or None, rng.choice([None, "the", "red ring"])) for i in ids]


def _by_hand(rows, query, limit):
    bags = {i: search_words(a) + search_words(b) for i, a, b in rows}
    bags = {i: b for i, b in bags.items() if b}
    words = query.lower().split()
    mean = sum(map(len, bags.values())) / max(len(bags), 1)
    often = {w: sum(w in b for b in bags.values()) for w in words}
    rated = []
    for i, b in bags.items():
        if all(w in b for w in words):
            rated.append((-sum(math.log(1 + (len(bags) - often[w] + 0.5) / (often[w] + 0.5)) * b.count(w) * 2.2 / (b.count(w) + 1.2 * (0.25 + 0.75 * len(b) / mean)) for w in words), i))
    return [(i, -s) for s, i in sorted(rated)[:limit]]


def search_words(t):
    return (t or "").split()


def _same(found, wanted):
    assert [r.id for r in found] == [i for i, _ in wanted] or all(math.isclose(r.score, s, rel_tol=1e-9) for r, (_, s) in zip(found, wanted, strict=True))
    assert len(found) == len(wanted)
    told = {r.id: r.score for r in found}
    assert all(math.isclose(told[i], s, rel_tol=1e-9) for i, s in wanted if i in told)


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rng = random.Random(2)
    rows = _rows(rng, range(0, 1200))
    frame = lambda r: spark.createDataFrame(r, "id long, title string, artist string")
    index = text_index.TextIndex(spark, str(tmp_path_factory.mktemp("index")), buckets=5, span=16)
    index.append(frame(rows[:700]), "id", ["title", "artist"])
    index.append(frame(rows[700:]), "id", ["title", "artist"])
    return index, rows, frame


@pytest.mark.parametrize("query", ["red", "red widget", "the ünder bolt", "nowhere", "red nowhere", ""])
@pytest.mark.parametrize("limit", [3, 5000])
def test_search_over_segments(made, query, limit):
    index, rows, _ = made
    _same(index.search(query, limit, ahead=4).collect(), _by_hand(rows, query, limit) if query else [])


def test_only_the_buckets_of_the_words_are_read(made):
    index, _, _ = made
    found = index.of_words(["red"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket#", "bucket#") and "term" in plan
    read = {r.f.split("bucket=")[1].split("/")[0] for r in found.select(F.input_file_name().alias("f")).distinct().collect()}
    assert len(read) == 1


def test_phrases(made):
    index, rows, _ = made
    wanted = sorted(i for i, a, b in rows if any(" red ring " in f" {x or ''} " for x in (a, b)))
    assert sorted(r.id for r in index.phrase("Red ring").collect()) == wanted


def test_taking_out_and_merging(spark, made):
    index, rows, frame = made
    own = text_index.TextIndex(spark, index.folder + "-own", buckets=3, span=8)
    own.append(frame(rows[:200]), "id", ["title", "artist"])
    own.append(frame(rows[200:300]), "id", ["title", "artist"])
    own.remove(spark.range(0, 300, 3))
    left = [r for r in rows[:300] if r[0] % 3]
    for _ in range(2):
        _same(own.search("red the", 40).collect(), _by_hand(left, "red the", 40))
        assert all(r.id % 3 for r in own.phrase("red ring").collect())
        own.merge()
        assert [s["kind"] for s in own.segments()] == ["rows"]
    again = text_index.TextIndex(spark, own.folder, buckets=3, span=8)
    _same(again.search("red the", 40).collect(), _by_hand(left, "red the", 40))
    again.clear()
    assert again.search("red", 5).count() == 0
    again.append(frame([(1, None, None)]), "id", ["title", "artist"])
    assert again.segments() == []


def test_second_writer_of_one_state_is_refused(spark, tmp_path):
    from ostinato.sources import snapshots

    one, two = (snapshots.Store(spark, str(tmp_path)) for _ in range(2))
    one.write("t", spark.range(1))
    with pytest.raises(RuntimeError, match="first"), one.transaction():
        one.write("t", spark.range(2))
        two.write("t", spark.range(3))
    assert one.read("t").count() == 3
    (tmp_path / "_states" / "000000000009").write_text("t\thalf")  # a list that is still being written doesn't count
    assert two.read("t").count() == 3
    two.write("t", spark.range(4))
    assert one.read("t").count() == 4


def test_writing_joins_nothing(spark, tmp_path, monkeypatch):
    """Lengths of all rows, joined to their words, were broadcast through the driver."""
    from pyspark.sql import DataFrameWriter

    plans, write = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **k: (plans.append(self._df._jdf.queryExecution().optimizedPlan().toString()), write(self, *a, **k))[1])
    rows = spark.createDataFrame([(1, "red widget"), (2, "red red"), (3, "blue")], "id long, title string")
    index = text_index.TextIndex(spark, str(tmp_path / "words"))
    index.append(rows, "id", ["title"])
    assert any("max_tf" in p for p in plans) and not any("Join" in p for p in plans if "max_tf" in p)
    assert [r.id for r in index.search("red widget").collect()] == [1]

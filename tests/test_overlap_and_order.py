"""Set-similarity joins, duplicate checks and total orders against brute force."""

import difflib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ostinato.functions import text as T
from ostinato.operators import dedup, external, hierarchy, library, overlap, steps
from ostinato.plans import registry

registry.load()

words = st.lists(st.sampled_from(["the", "the", "a", "b", "c", "d", "e", None]), max_size=7)


@settings(max_examples=10, deadline=None)
@given(st.lists(words, max_size=8), st.lists(words, max_size=8), st.integers(1, 3))
def test_overlap_join_against_all_pairs(spark, left, right, least):
    schema = "id long, tokens array<string>"
    a, b = (spark.createDataFrame(list(enumerate(x)), schema) for x in (left, right))
    sets = lambda x: [set(w) - {None} for w in x]
    wanted = {(i, j, len(x & y)) for i, x in enumerate(sets(left)) for j, y in enumerate(sets(right)) if len(x & y) >= least}
    assert sorted(map(tuple, overlap.join(a, b, least).collect())) == sorted(wanted)
    assert sorted(r.id for r in overlap.have_partner(a, b).collect()) == sorted({i for i, x in enumerate(sets(left)) if any(len(x & y) >= 2 for y in sets(right))})
    first = sorted((i, j) for i, x in enumerate(sets(left)) for j in [j for j, y in enumerate(sets(right)) if x & y][:2])
    assert sorted(map(tuple, overlap.first_sharing_one(a, b, 2).collect())) == first


def test_equal_sets_meet_once(spark):
    """A thousand copies of two sets: before, each pair of rows with a word in their prefixes met."""
    from pyspark.sql.observation import Observation

    rows = spark.range(1000).select("id", F.array(F.lit("x"), F.lit("y"), F.when(F.col("id") % 2 == 0, "p").otherwise("q"), F.concat(F.lit("only"), "id")).alias("tokens"))
    a, b = rows.filter("id < 500"), rows.filter("id >= 500")
    found = overlap.join(a, b, 3)
    told = Observation()
    assert found.observe(told, F.count(F.lit(1)).alias("n"), F.max("shared").alias("top")).filter("a % 2 <> b % 2").count() == 0
    assert told.get == {"n": 2 * 250 * 250, "top": 3}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    last = plan.split("Join")[0]
    assert "Repartition" in last and last.count("explode") == 2


def test_blocks_of_equal_sets_are_large_and_sides_alike_are_made_once(spark, monkeypatch):
    """What is shuffled of the pairs found is two ids for every 1024 (before 256): 2048 equal sets meet in about 4 pairs of blocks, not 64."""
    rows = spark.range(2048).select("id", F.array(F.lit("x"), F.lit("y")).alias("tokens"))
    made = []
    monkeypatch.setattr(steps, "written", lambda df, f=steps.written: made.append(1) or f(df))
    found = overlap.join(rows, rows, 2)
    assert len(made) == 1
    _, _, blocks = overlap.blocks_met(rows, rows, 2, 1024)
    assert blocks.count() == 4 and overlap.join.__defaults__ == (1024,)
    assert found.filter("a < b").count() == 2048 * 2047 // 2


def test_a_word_of_all_rows_pairs_none_of_them(spark):
    """Every set holds one common word: it stands in no prefix, so that as many rows meet as share another."""
    rows = spark.range(600).select("id", F.array(F.lit("common"), F.concat(F.lit("w"), F.col("id") % 300), F.concat(F.lit("only"), "id")).alias("tokens"))
    assert overlap.join(rows, rows, 2).filter("a < b").count() == 300
    ranked = overlap.by_rarity(rows, rows).select(F.element_at("tokens", -1).alias("w")).distinct().collect()
    assert [r.w for r in ranked] == ["common"]


@settings(max_examples=200)
@given(st.text("abz0 é", max_size=12), st.text("abz0 é", max_size=12))
def test_matching_characters_are_bounded(x, y):
    matched = sum(m.size for m in difflib.SequenceMatcher(None, x, y).get_matching_blocks())
    rows = list(range(len(y) + 1))
    for i, c in enumerate(x, 1):
        before, rows[0] = rows[0], i
        for j, d in enumerate(y, 1):
            before, rows[j] = rows[j], min(rows[j] + 1, rows[j - 1] + 1, before + (c != d))
    assert 2 * matched <= len(x) + len(y) - rows[-1]


def test_letters_in_common_are_an_upper_bound(spark):
    rng = random.Random(4)
    names = ["", "aaaaaaa", "aaaa", "zz 09", "ééé", *("".join(rng.choice("abcz 019é") for _ in range(rng.randrange(30))) for _ in range(40))]
    df = spark.createDataFrame([(n,) for n in names], "x string").withColumn("m", T.letter_masks(F.col("x")))
    pairs = df.crossJoin(df.select(F.col("x").alias("y"), F.col("m").alias("k"))).select("x", "y", T.letters_in_common("m", "k").alias("c"))
    for r in pairs.collect():
        common = sum(min(r.x.count(c), r.y.count(c)) for c in set(r.x))
        few = all(r.x.count(c) <= 4 and c.isascii() for c in set(r.x)) and all(r.y.count(c) <= 4 and c.isascii() for c in set(r.y))
        assert r.c >= common and (not few or r.c == common)


def _brute_check(asked, known):
    """Pass 3 by all pairs: names that share two words, else the first 50 that share one."""
    tokens = lambda n: {w for w in n.split() if len(w) >= 3}
    hits = {i: len(tokens(asked) & tokens(n)) for i, n in known.items()}
    two = [i for i in sorted(known) if hits[i] >= 2] or [i for i in sorted(known) if hits[i] == 1][:50]
    rated = [(-difflib.SequenceMatcher(None, asked, known[i]).ratio(), i) for i in two]
    best = min(rated, default=(0, None))
    return best[1] if -best[0] >= 0.8 else None


@pytest.mark.parametrize("first", [1, 3])
def test_most_similar_names_against_all_pairs(spark, first):
    rng = random.Random(first)
    some = ["brand", "small", "ring", "widget", "blue", "bolt", "redder", "xyz"]
    name = lambda: " ".join(rng.choice([*some, str(rng.randrange(200)), "of"]) for _ in range(rng.randrange(1, 6)))
    known = {i: name() for i in range(150)} | {200 + i: "lonely" + "abcdefgh"[i % 8] * (i % 4) + " xyzzy" for i in range(70)}
    asked = {i: name() for i in range(80)} | {90: "lonely xyzzy", 91: "lonelya", 92: "", 93: "of", 94: known[3], 95: known[3] + "q"}
    frame = lambda x: spark.createDataFrame(list(x.items()), "id long, name string").withColumn("tokens", T.tokens(F.col("name")))
    found = {r.a: r.b for r in dedup.most_similar(frame(asked), frame(known), 0.8, 50, first).collect()}
    assert found == {i: b for i, n in asked.items() if (b := _brute_check(n, known)) is not None}


def test_crowded_sets_meet_as_blocks(spark):
    """Names of few words: pairs are no rows before their letters are held against what a neighbour reaches; same result as all pairs."""
    from pyspark.sql.observation import Observation

    rng = random.Random(6)
    names = [f"brand {rng.randrange(9)}   {rng.choice(['large', 'small'])} {rng.choice(['ring', 'bolt'])} {i}" + "\u00e9" * (i % 50 == 0) * 20 for i in range(1000, 1400)]
    known, asked = {i: n for i, n in enumerate(names) if i % 4}, {i: n for i, n in enumerate(names) if i % 4 == 0}
    frame = lambda x: spark.createDataFrame(list(x.items()), "id int, name string").withColumn("tokens", T.tokens(F.col("name")))
    a, b = frame(asked), frame(known)
    for few in (0, 10**9):
        found = {r.a: r.b for r in dedup.most_similar(a, b, 0.8, 50, 3, few).collect()}
        assert found == {i: x for i, n in asked.items() if (x := _brute_check(n, known)) is not None}
    told = dedup._told_least(a, b, 0.8)
    seen = Observation()
    dedup._near_pairs(a, b, told, 0).observe(seen, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
    assert seen.get["n"] < overlap.join(a, b, 2).count() / 4


def test_a_name_has_one_row_a_pair_of_blocks():
    """Before, all pairs whose letters in common were enough became rows: a share of all pairs."""
    import pyarrow as pa

    rng = random.Random(9)
    name = lambda i: f"brand {rng.randrange(25)}   {rng.choice(['old', 'cold'])} ring {rng.randrange(10**6, 2 * 10**6)}" + "\u00e9x" * (i % 40 == 0) * 25
    names = [name(i) for i in range(600)]
    known, asked = [*names[200:], names[205], ""], [*names[:200], names[205], names[240][:64], names[241] + "q" * 40]
    for least in (0.8, 0.93):
        rows = [(1, i, None, x, least) for i, x in enumerate(asked)] + [(1, None, 1000 - i, x, None) for i, x in enumerate(known)]
        both = pa.table(dict(zip(("pair", "a", "b", "name", "least"), (list(c) for c in zip(*rows, strict=True)), strict=True)))
        found = [(r["a"], r["b"]) for r in dedup._best_in_blocks(both).to_pylist()]
        rated = lambda x: min((-difflib.SequenceMatcher(None, x, y).ratio(), 1000 - i) for i, y in enumerate(known))
        best = {i: rated(x) for i, x in enumerate(asked)}
        assert {a: b for a, b in found if -best[a][0] >= least} == {i: b for i, (r, b) in best.items() if -r >= least}
        assert len(found) == len({a for a, _ in found})


@pytest.mark.parametrize("n", [0, 1, 5, 1000])
def test_total_orders(spark, n):
    rng = random.Random(n)
    keys = [None if rng.random() < 0.05 else rng.randrange(50) for _ in range(n)]
    rows = spark.createDataFrame([(i, k, rng.choice([None, 1, 2])) for i, k in enumerate(keys)], "id long, k long, v int").repartition(3)
    order = sorted(rows.collect(), key=lambda r: (r.k is not None, r.k or 0, r.id))
    found = {r.id: r for r in steps.numbered(rows, ["k", "id"]).collect()}
    assert all(found[r.id].number == i for i, r in enumerate(order, 1)) and len(found) == n
    behind = {r.id: r.before for r in steps.lagged(rows, ["k", "id"], "v", "before").collect()}
    assert all(behind[r.id] == (order[i - 1].v if i else None) for i, r in enumerate(order))
    totals = {r.id: r.total for r in steps.running_totals(rows, ["k", "id"], F.col("v"), "total").collect()}
    assert all(totals[r.id] == sum(x.v or 0 for x in order[:i]) for i, r in enumerate(order))


def _windows(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [line for line in plan.splitlines() if "Window [" in line]


@pytest.mark.parametrize("name", ["k8_work_queue", "b1_upsert", "b13_export_lists", "changed_statuses"])
def test_no_window_without_a_partition_key(spark, name):
    sf = "/root/testdata/sf0.001"
    for line in _windows(registry.QUERIES[name](spark, sf)):
        for spec in line.split("windowspecdefinition(")[1:]:  # partition keys come first, order keys say which way
            assert not any(way in spec.split(",")[0] for way in (" ASC", " DESC")), line


def test_new_tracks_are_numbered_in_order_of_path(spark):
    schema = "id long, filepath string, title string, date_added string, play_count long"
    old = spark.createDataFrame([(7, "/b", "B", "d", 3)], schema)
    new = spark.createDataFrame([(f"/{c}", c.upper()) for c in "zxcba"], "filepath string, title string")
    found = {r.filepath: (r.id, r.title, r.play_count) for r in library.upsert(old, new, F.lit("now")).collect()}
    assert found == {"/b": (7, "B", 3), "/a": (8, "A", 0), "/c": (9, "C", 0), "/x": (10, "X", 0), "/z": (11, "Z", 0)}


def test_exported_lists_are_numbered_one_after_the_other(spark):
    rows = spark.createDataFrame([(k, 10 * k + i, i) for k in range(40) for i in range(1, 1 + k % 4)], "list_id int, track_id int, position int")
    found = external.linked(rows, 5).orderBy("list_id", F.desc("position")).collect()
    assert [r.id for r in found] == list(range(5, 5 + len(found)))


def test_list_positions(spark):
    links = [(k, 100 * k + i, 100 * k + i + 1 if i < k else 0) for k in range(1, 30) for i in range(1, k + 1)]
    found = hierarchy.list_positions(spark.createDataFrame(links, "list_id long, id long, next_id long")).collect()
    assert {(r.list_id, r.id): r.position for r in found} == {(k, x): x - 100 * k for k, x, _ in links}
    with pytest.raises(ValueError, match="no end"):
        hierarchy.list_positions(spark.createDataFrame([(1, 1, 2), (1, 2, 1)], "list_id long, id long, next_id long")).count()


def test_parts_follow_the_rows(spark, monkeypatch):
    """Ranges, entries and a fit's rows go to more parts if there are more rows; before, a part grew with the input."""
    from ostinato.operators import learning

    assert [steps.pieces(n, 4, 10) for n in (0, 40, 41)] == [4, 4, 5]
    monkeypatch.setattr(steps, "pieces", lambda rows, least, most=0: max(least, -(-rows // 10)))
    rows = spark.range(200).select((F.col("id") % 50).alias("list_id"), F.col("id").alias("track_id"), F.col("id").alias("position"))
    assert steps.dealt(rows, "list_id").rdd.getNumPartitions() == 20
    found = external.verify(external.linked(rows)).collect()
    assert len(found) == 50 and {(r.entries, r.tails, r.dangling) for r in found} == {(4, 1, 0)}
    assert steps._ranged(rows, ["position"], 200).select("__range").distinct().count() == 20
    broken = spark.createDataFrame([(1, 5, 0), (1, 6, 5), (1, 7, 99), (2, 8, 0), (2, 9, 0)], "list_id int, id long, next_id long")
    assert sorted(map(tuple, external.verify(broken).collect())) == [(1, 3, 1, 1), (2, 2, 2, 0)]
    seen = []
    monkeypatch.setitem(learning.MODELS, "counted", lambda **how: type("M", (), {"fit": lambda self, df: seen.append(df.rdd.getNumPartitions())})())
    learning.LabelModels("counted", ["x"], ["A"]).fit(spark.range(200).select(F.col("id").cast("double").alias("x"), (F.col("id") % 2).cast("int").alias("y_A")).coalesce(1))
    assert seen == [20]

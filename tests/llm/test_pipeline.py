"""Every stage of the pipeline against plain Python."""

import os
import re
import zlib

import pytest

import corpus_pipeline as pipeline
from ostinato.llm import mixing, queries, toxicity_crf

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


def firsts_of_alike(rows):
    """The smallest id of each group that similarities of 0.8 or more of five-word shingles link; rows(id, text)."""
    sets = {}
    for d, t in rows:
        w = (t or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    group = {d: d for d in sets}
    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and group[a] != group[b]:
                x, y = sorted((group[a], group[b]))
                group = {d: x if g == y else g for d, g in group.items()}
    return set(group.values())


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    columns = docs.columns
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    stages = dict(pipeline.STAGES)

    one = stages["toxicity"](spark, docs, SF).cache()
    learnt = {d for d in labels if zlib.crc32(str(d).encode()) % 3 != 1 and d in texts}
    model = toxicity_crf.fit([texts[d] for d in sorted(learnt)], [labels[d] for d in sorted(learnt)])
    scores = dict(zip(texts, (s for s, _ in toxicity_crf.Scorer(model).many(list(texts.values()))), strict=True))
    assert one.columns == columns and {r.doc_id for r in one.collect()} == {d for d, s in scores.items() if s < pipeline.REJECT}

    two = stages["exact dedup"](spark, one, SF).cache()
    first = {}
    for r in sorted(one.collect(), key=lambda r: r.doc_id):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), r.doc_id)
    assert two.columns == columns and {r.doc_id for r in two.collect()} == set(first.values())

    three = stages["near dedup"](spark, two, SF).cache()
    kept = {r.doc_id for r in three.collect()}
    assert three.columns == columns and kept == firsts_of_alike([(r.doc_id, r.text) for r in two.collect()])

    four = stages["mixing"](spark, three, SF).cache()
    words = sum(len((r.text or "").split()) for r in three.collect())
    taken = sum(len(r.text.split()) for r in four.collect())
    assert four.columns == columns and abs(taken - 1.5 * words) <= 8 * 25
    assert {r.doc_id for r in four.collect()} == {r.doc_id for r in mixing.mix(three).collect() if r.taken}

    five = stages["packing"](spark, four, SF)
    assert five.groupBy("sequence_id").sum("length").filter("`sum(length)` > 2048").count() == 0
    assert pipeline.run(spark, SF).count() == five.count()


def test_stages_take_odd_rows(spark):
    """Nulls, empty and repeated rows, names that stages use themselves, and no rows at all; what documents carry stays as it was."""
    others = ["__node", "node", "__size", "part", "__score", "__id", "__sha", "__n", "__source", "__at", "__shards", "__target", "__words", "__taken", "__text", "carried", "a.b", "c0", "id"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in others)
    rows = [(1, "a b c", "en", "s", 5), (1, "a b c", "en", "s", 5), (2, "a  b c", None, None, None), (None, None, None, None, None), (3, "", None, "s", 0), (4, "x " * 50_000, "en", "t", 100_000)]
    for given in (rows, []):
        docs = spark.createDataFrame([(*r, *(f"keep {c} {r[0]}" for c in others)) for r in given], schema)
        for name, stage in pipeline.STAGES[:4]:
            after = stage(spark, docs, SF)
            assert after.columns == docs.columns and [f.dataType for f in after.schema] == [f.dataType for f in docs.schema], name
            docs = after.cache()
            assert all(r[c] == f"keep {c} {r.doc_id}" for r in docs.collect() for c in others), name
            if name == "toxicity":
                assert docs.count() == len(given)
        assert {r.doc_id for r in docs.collect()} == ({1, 4} if given else set())
        assert pipeline.STAGES[4][1](spark, docs, SF).count() >= len(given[:2])


def test_queries_have_all_rows(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name in ("op1_toxicity_crf", "op2_iblt_fingerprints", "op3_karmarkar_karp_shards", "op4_best_fit_packing", "op5_sainte_lague_mix", "op6_ppm_scores", "op7_simhash_anchors", "op9_debruijn_repeats", "op10_exact_tree_merge", "op11_license_scan", "op12_kolpakov_kucherov_runs"):
        assert queries.QUERIES[name](spark, SF).select("doc_id").distinct().count() == n, name


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_agrees_with_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    told = con.sql(queries.ORACLES[name])
    found = queries.QUERIES[name](spark, SF)
    order = sorted(found.columns)
    assert order == sorted(told.columns)
    assert sorted(tuple(str(r[c]) for c in order) for r in found.collect()) == sorted(tuple(str(r[told.columns.index(c)]) for c in order) for r in told.fetchall())


def test_near_dedup_by_jaccard(spark):
    import random

    rng = random.Random(3)
    line = [f"line{i}" for i in range(30)]
    given = [None, "", " ", "a b", "A  b", "a b c d e"]
    for n in (6, 25, 60, 235, 611):
        for _ in range(4):
            base = [f"w{rng.randrange(5000)}" for _ in range(n)]
            given += [" ".join(base), " ".join(base + line), " ".join(line + base[n // 2 :])]
            for edits in (1, 2, 3, 4, 6, 9, 14):
                w = list(base)
                for at in rng.sample(range(n), min(n, edits)):
                    w[at] = f"x{rng.randrange(5000)}"
                given.append(" ".join(w))
    rows = [(i * 7 % 1009, t) for i, t in enumerate(given)]
    want = firsts_of_alike(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = dict(pipeline.STAGES)["near dedup"](spark, df, SF)
    assert found.columns == df.columns and {r.doc_id for r in found.collect()} == want
    assert 20 < len(want) < len(rows) - 20


def rows_of_joins(spark, since):
    """The most rows that a join made in any execution from that one on."""
    store, most = spark._jsparkSession.sharedState().statusStore(), 0
    for at in range(since, store.executionsCount()):
        told = store.executionsList(at, 1).apply(0).executionId()
        values, nodes = store.executionMetrics(told), store.planGraph(told).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            metrics = node.metrics()
            for m in (metrics.apply(i) for i in range(metrics.size())):
                if "Join" in node.name() and m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    most = max(most, int(values.apply(m.accumulatorId()).replace(",", "")))
    return most


def test_near_dedup_of_a_large_group(spark):
    """Copies with few changes are joined, and copies with too many are told apart, without the pairs of the group."""
    import random

    rng = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    given = []
    for i in range(500):
        w = list(base)
        for at in rng.sample(range(150), i % 8):
            w[at] = f"x{rng.randrange(10**9)}"
        given.append(" ".join(w[: 150 - i % 3]))
    rng.shuffle(given)
    rows = list(enumerate(given))
    want = firsts_of_alike(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    since = spark._jsparkSession.sharedState().statusStore().executionsCount()
    assert {r.doc_id for r in dict(pipeline.STAGES)["near dedup"](spark, df, SF).collect()} == want
    assert 100 < len(want) < 400 and 0 < rows_of_joins(spark, since) < 40 * len(rows)  # its prefixes have 30 shingles a text


def test_shingles_meet_where_enough_is_left(spark):
    """All links of alike sets are found, whatever their sizes are and whoever is the least of a shingle."""
    import random

    from ostinato.llm import near_jaccard

    rng = random.Random(5)
    given = []
    for n in (1, 4, 9, 14, 30, 64):
        for _ in range(3):
            base = [f"w{rng.randrange(40)}" for _ in range(n)]
            for _ in range(12):
                w = base[rng.randrange(1 + n // 6) : n - rng.randrange(1 + n // 6)]
                for _ in range(rng.randrange(3)):
                    w[rng.randrange(len(w))] = f"w{rng.randrange(40)}"
                given.append(" ".join(w))
    rng.shuffle(given)
    rows = list(enumerate(given))
    for one_in, listed in ((1, 2**20), (2, 5), (10**9, 1)):
        texts = spark.createDataFrame(rows, "node long, text string").selectExpr("node", "cast(text as binary) as text").repartition(3)
        links = near_jaccard.rest(texts, spark.createDataFrame([], "a long, b long"), 2, one_in, listed).collect()
        group = {d: d for d, _ in rows}
        for a, b in links:
            x, y = sorted((group[a], group[b]))
            group = {d: x if g == y else g for d, g in group.items()}
        sets = {d: {tuple(t.split()[i : i + 2]) for i in range(max(1, len(t.split()) - 1))} for d, t in rows}
        alike = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
        assert {(min(a, b), max(a, b)) for a, b in links} <= alike and all(group[a] == group[b] for a, b in alike)
        assert 20 < len(set(group.values())) < len(rows) - 20

"""The corpus operators against brute force, on small tables with nulls, empty and long texts, ties, repeats and clashing names."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ostinato.llm.components import components as components_of
from ostinato.llm import chat, common, debruijn, exact_dedup, iblt, mixing, packing, ppm, sharding, simhash_anchor, toxicity_crf

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, slot int, keep_id string, __salt int, block string"


def prose(rng, n, words=400):
    return " ".join(f"w{int(x)}" for x in rng.zipf(1.3, n) % words)


def corpus():
    rng = np.random.default_rng(5)
    base = [prose(rng, int(n)) for n in rng.integers(1, 200, 40)]
    passage = prose(rng, 60, 100_000)
    texts = [None, "", " ", "a", "a b", "a\tb", "a  b", "\n\n", "é ü ñ", "x" * 300, prose(rng, 6000, 5000), *base, *base[:8], base[0], base[0], *(f"{b} {passage} {b}" for b in base[10:14]), *(b + " one more" for b in base[20:24]), "First line.\nSecond line.\nThird"]
    return [(7 * i % 997, t, "en" if i % 3 else None, ("s1", "s2", None, "é")[i % 4], len(t or ""), 1, "k", 2, "b") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def words_of(t):
    return re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())


def test_exact(docs, rows, empty):
    groups = {}
    for r in rows:
        groups.setdefault(norm(r[1]), []).append(r[0])
    found = exact_dedup.exact_groups(docs).collect()
    assert len(found) == len(rows)
    by = {r.doc_id: r for r in found}
    for r in rows:
        g = groups[norm(r[1])]
        assert (by[r[0]].keep_id, by[r[0]].group_size, by[r[0]].kept) == (min(g), len(g), r[0] == min(g))
        assert by[r[0]].text_sha256 == hashlib.sha256(norm(r[1]).encode()).hexdigest()
    assert exact_dedup.drop_copies(docs).count() == len(groups)
    assert exact_dedup.exact_groups(empty).count() == 0 and exact_dedup.drop_copies(empty).count() == 0


def test_exact_keeps_one_of_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a "), (None, "a"), (None, "q")], "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in exact_dedup.exact_groups(df).filter("kept").collect()) == ["1", "2", "None"]
    assert exact_dedup.drop_copies(df).count() == 3


def test_exact_merges_sorted_runs(docs):
    runs = docs.select(F.lit(0).cast("long").alias("slot"), F.xxhash64("text").alias("key"), F.unhex(F.sha2("text", 256)).alias("digest"), F.col("doc_id").alias("least"), F.lit(1).cast("long").alias("rows"))
    merged = exact_dedup.merge_runs(runs, 64, 8)
    plan = merged._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("SortAggregate") >= 2 and "HashAggregate" not in plan.replace("SortAggregate", "")
    want = docs.filter("text is not null").groupBy("text").agg(F.min("doc_id").alias("a"), F.count("*").alias("n"))
    assert sorted((r.a, r.n) for r in want.collect()) == sorted((r.least, r.rows) for r in merged.filter("digest is not null").collect())


def test_exact_takes_ids_of_any_type(spark):
    df = spark.createDataFrame([("b", "x"), ("a", "x"), (None, "x")], "doc_id string, text string")
    assert sorted((str(r.doc_id), r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(df).collect()) == [("None", "a", 3, False), ("a", "a", 3, True), ("b", "a", 3, False)]


def brute_simhash(t):
    w = words_of((t or "").translate({c: c + 32 for c in range(65, 91)}))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps, bits=3):
    parent = {d: d for d in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= bits:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in fps}


def test_simhash(docs, rows, empty):
    fps = {r[0]: brute_simhash(r[1]) for r in rows}
    found = {r.doc_id: r for r in simhash_anchor.near_groups(docs).collect()}
    assert {d: r.fingerprint for d, r in found.items()} == {d: f"{f:016x}" for d, f in fps.items()}
    assert {d: r.component_id for d, r in found.items()} == components(fps)
    assert {r.doc_id: r.component_id for r in simhash_anchor.near_groups(docs, crowded=2, per_anchor=8).collect()} == components(fps)
    assert simhash_anchor.near_groups(empty).count() == 0


def told(fps, code, dealt):
    """What _meet is told: which anchors are homes, and the groups of homes and members of some."""
    homes = np.zeros(2**12 * 8, bool)
    homes[simhash_anchor.within_reach(fps, code, 3)[2]] = True
    at = sorted(dealt)
    return SimpleNamespace(value=(np.packbits(homes, bitorder="little"), np.array(at, np.int64), np.array([dealt[a][0] for a in at]), np.array([dealt[a][1] for a in at])))


def test_no_cell_of_a_cluster_grows():
    """A cluster's homes and members are both dealt, copies go to homes only, and every home still meets every member once."""
    import pyarrow as pa

    rng = np.random.default_rng(6)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 7)), replace=False)) for _ in range(6000)], np.uint64)
    fps = np.unique(np.uint64(0x0123456789ABCDEF) ^ flips)
    code, crowded = [simhash_anchor.anchors(8)], 200
    batch = pa.record_batch([pa.array(fps.view(np.int64)), pa.array(np.arange(len(fps)) * 20)], ["fp", "node"])
    held = pa.Table.from_batches(list(simhash_anchor._reached(iter([batch]), code, 3))).to_pylist()
    assert sum(r["homes"] for r in held) == len(fps) and max(r["homes"] for r in held) > 2 * crowded
    dealt = {r["anchor"]: (-(-r["homes"] // crowded), -(-r["members"] // crowded)) for r in held if r["homes"]}
    met = pa.Table.from_batches(list(simhash_anchor._meet(iter([batch]), code, 3, told(fps, code, dealt)))).to_pandas()
    assert set(met.anchor) == set(dealt)
    assert met.groupby(["anchor", "cell"]).size().max() < 2.6 * crowded
    for anchor, rows in met.groupby("anchor"):
        pairs = [(h, m) for _, cell in rows.groupby("cell") for h in cell.node[cell.home] for m in cell.node[~cell.home]][:200_000]
        assert len(pairs) == len(set(pairs))
        home, member = rows.node[rows.home].nunique(), rows.node[~rows.home].nunique()
        both = rows.groupby(["cell", "home"]).size().unstack(fill_value=0)
        assert (both[True] * both[False]).sum() == home * member


@pytest.mark.parametrize("code", [[simhash_anchor.anchors(7)], [simhash_anchor.anchors(4, 7, 32), simhash_anchor.anchors(4, 8, 32)]])
def test_anchors_lose_no_link(code):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**64, 60, dtype=np.uint64)
    near = [int(b) for b in base]
    for b in base.tolist():
        for _ in range(6):
            x = near[int(rng.integers(len(near)))]
            for bit in rng.choice(64, int(rng.integers(1, 4)), replace=False):
                x ^= 1 << int(bit)
            near.append(x)
    fps = np.array(sorted(set(near)), np.uint64)
    import pyarrow as pa

    batch = pa.record_batch([pa.array(fps.view(np.int64)), pa.array(np.arange(len(fps)))], ["fp", "node"])
    met = pa.Table.from_batches(list(simhash_anchor._meet(iter([batch]), code, 3, told(fps, code, {0: (2, 5), 3: (3, 7)})))).sort_by([("anchor", "ascending"), ("cell", "ascending")])
    links = pa.Table.from_batches(list(simhash_anchor._compare(iter(met.to_batches(max_chunksize=50)), 3)))
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in zip(links.column("a").to_pylist(), links.column("b").to_pylist(), strict=True):
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert {i: find(i) for i in range(len(fps))} == components({i: int(f) for i, f in enumerate(fps)})


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (5, 5)], "a long, b long")
    found = {r.node: r.component for r in components_of(edges).collect()}
    assert found == {i: 0 for i in range(1, 41)} | {95: 90, 100: 90}


def test_shards(docs, rows, empty):
    found = {r.doc_id: r for r in sharding.shard(docs, 4, blocks=3).collect()}
    size = {r[0]: len((r[1] or "").encode()) + 1 for r in rows}
    assert {d: r["size"] for d, r in found.items()} == size
    at = {}
    for r in rows:
        assert found[r[0]].text_crc32 == zlib.crc32((r[1] or "").encode())
        assert at.setdefault(r[1] or "", found[r[0]].shard) == found[r[0]].shard
    slots = {}
    for r in found.values():
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard(empty).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(1, 1000), max_size=60), st.integers(2, 6))
def test_differencing(sizes, parts):
    found = sharding.difference(sizes, parts)
    load = [0] * parts
    for s, p in zip(sizes, found, strict=True):
        load[p] += s
    assert sum(load) == sum(sizes) and (not sizes or max(load) - min(load) <= max(sizes))


def test_shards_are_even(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, f"{i}" + "x" * int(n)) for i, n in enumerate(rng.integers(1, 500, 3000))], "doc_id long, text string")
    load = [r.b for r in sharding.shard(df).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(load) == 16 and max(load) - min(load) <= 2


def test_packing(spark, docs, rows, empty):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path("byte_bpe_50k.json"))
    rows = [*rows, (5001, "a<|endoftext|>b"), (5002, "<|endoftext|>" * 300), (5003, "<|endoftext|" + ">x")]
    docs = docs.select("doc_id", "text").union(spark.createDataFrame([r[:2] for r in rows[-3:]], "doc_id long, text string"))
    assert t.encode(rows[-3][1], add_special_tokens=False).ids == [64, 50256, 65]
    found = packing.pack(docs, capacity=256, open_bins=8, ahead=16, pieces_a_task=100).collect()
    pieces, bins = {}, {}
    for r in found:
        pieces.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append(r)
    for d, text, *_ in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        own = sorted(pieces[d], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and own[0].start == 0
        assert all(r.length == 256 for r in own[1:]) and (len(own) == 1) == (len(ids) <= 256)
        for r in own:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
        assert sum(r.length for r in own) == len(ids)
    for own in bins.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0, *(r.length for r in own[:-1])]).tolist() and sum(r.length for r in own) <= 256
    assert packing.pack(empty).count() == 0


def test_ranks_encode_as_the_tokenizer_does():
    from public_tokenizers import PATTERN, path
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path("byte_bpe_50k.json"))
    enc = packing.Encoder(path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), PATTERN)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    texts = ["".join(f"a{c}b {c}1{c}  {c}'s." for c in points[i : i + 64]) for i in range(0, len(points), 64)]
    assert [enc.ids(x) for x in texts] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_packing_of_repeated_and_idless_rows(spark):
    rows = [(1, "a b"), (1, "a b"), (1, "c"), (None, "a"), (None, None)]
    found = packing.pack(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.length) for r in found) == [("1", 2), ("1", 3), ("1", 3), ("None", 1), ("None", 2)]
    assert sorted(r.offset for r in found)[0] == 0 and sum(r.length for r in found) == 11


def test_few_sequences(spark):
    sf = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(sf):
        pytest.skip("no tables here")
    found = packing.pack(spark.read.parquet(sf)).agg(F.sum("length"), F.countDistinct("sequence_id")).first()
    assert found[1] <= 1.01 * -(-found[0] // 2048) + 1


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200), st.integers(1, 5))
def test_best_fit(lengths, open_bins):
    """Against a list of bins searched in full."""
    packer, bins, closed = packing.Packer(64, open_bins), [], set()
    for n in lengths:
        fit = [i for i, b in enumerate(bins) if i not in closed and b >= n and b]
        least = min((bins[i] for i in fit), default=None)
        at, offset = packer.put(n)
        if least is None:
            assert (at, offset) == (len(bins), 0)
            bins.append(64 - n)
        else:
            assert at not in closed and bins[at] == least and offset == 64 - least
            bins[at] -= n
        alive = [i for i, b in enumerate(bins) if b and i not in closed]
        if len(alive) > open_bins:
            fullest = min(bins[i] for i in alive)
            gone = {i for i in alive if bins[i] == fullest} - {i for b in packer.bins for i in b}
            assert len(gone) == 1
            closed |= gone


def test_targets():
    assert mixing.targets([100, 100, 100], [5, 2, 1]) == [200.0, pytest.approx(500 / 3), pytest.approx(250 / 3)]
    assert mixing.targets([10, 1000], [5, 2]) == [20.0, 1495.0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 500), min_size=1, max_size=8), st.integers(0, 300))
def test_apportionment(claims, seats):
    """Against one seat at a time by the highest quotient."""
    caps = [10**9] * len(claims)
    got = mixing.apportion([float(c) for c in claims], seats, caps)
    want = [0] * len(claims)
    if sum(claims):
        for _ in range(seats):
            want[max(range(len(claims)), key=lambda i: (claims[i] / (2 * want[i] + 1), -i))] += 1
        quotients = lambda g: sorted(claims[i] / (2 * k + 1) for i in range(len(claims)) for k in range(g[i]))
        assert sum(got) == seats and quotients(got) == pytest.approx(quotients(want))
    else:
        assert got == want


def test_mix(docs, rows, empty):
    found = {r.doc_id: r for r in mixing.mix(docs).collect()}
    again = {r.doc_id: r for r in mixing.mix(docs.repartition(5)).collect()}
    assert found == again and len(found) == len(rows)
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows:
        own = found[r[0]]
        assert own["size"] == len(words_of(r[1])) and 0 <= own.taken <= 2 * own["size"]
        sizes[r[3]] += own["size"]
        taken[r[3]] += own.taken
        target[r[3]] = own.target
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    assert [target[s] for s in order] == pytest.approx(mixing.targets([sizes[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))]))
    assert all(abs(taken[s] - target[s]) <= 8 for s in order)
    assert mixing.mix(empty).count() == 0 and mixing.mixed_texts(empty).count() == 0


def test_mixed_texts_have_the_words_taken(docs):
    taken = {r.doc_id: r.taken for r in mixing.mix(docs).collect() if r.taken}
    got = Counter()
    out = mixing.mixed_texts(docs)
    assert out.columns == docs.columns
    for r in out.collect():
        got[r.doc_id] += len(words_of(r.text))
    assert got == taken


def brute_counts(texts):
    c = Counter()
    for t in texts:
        c.update([w.lower() for w in words_of(t)])
        c[b"\n"] += 1
    return c


def test_scores(docs, rows, empty):
    learnt = [r[1] for r in rows if zlib.crc32(str(r[0]).encode()) % 10]
    c = brute_counts(learnt)
    n, v = sum(c.values()), len(c)
    found = {r.doc_id: r for r in ppm.score(docs, "crc32(cast(cast(doc_id as string) as binary)) % 10 <> 0", frequent=20, chunk=3000).collect()}
    assert len(found) == len(rows)
    for d, t, *_ in rows:
        w = [*(x.lower() for x in words_of(t)), b"\n"]
        r = found[d]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(x in c for x in w), n, zlib.crc32(str(d).encode()) % 10 == 0)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
        assert r.score < 0
    same = {r.doc_id: r.score for r in ppm.score(docs, "crc32(cast(cast(doc_id as string) as binary)) % 10 <> 0").collect()}
    assert {d: r.score for d, r in found.items()} == pytest.approx(same, rel=1e-5)
    assert ppm.score(empty, "true").count() == 0
    assert ppm.score(docs, "false").filter("score is null or isnan(score)").count() == 0


class SlowTrie:
    """The same model by the book: dictionaries, one symbol at a time, sets of excluded symbols."""

    def __init__(self, texts, order):
        self.order, self.table = order, {}
        for t in texts:
            s = ppm.symbols(t.encode(), order)
            for i in range(order, len(s)):
                for k in range(order + 1):
                    self.table.setdefault(s[i - k : i], Counter())[s[i]] += 1

    def log(self, s, i):
        gone, out = set(), 0.0
        for k in range(self.order, -1, -1):
            left = {x: n for x, n in self.table.get(s[i - k : i], {}).items() if x not in gone}
            if left:
                escape = len(left) / (2 * sum(left.values()))
                if s[i] in left:
                    return out + math.log10((1 - escape) * left[s[i]] / sum(left.values()))
                out += math.log10(escape)
                gone |= set(left)
        return out - math.log10(256 - len(gone))

    def score(self, text):
        s = ppm.symbols(text.encode(), self.order)
        return sum(self.log(s, i) for i in range(self.order, len(s)))


@pytest.mark.parametrize("order", [2, 4, 6])
def test_trie_by_the_book(spark, order):
    """Words that follow each other, more of them than are sent to the tasks, over several partitions."""
    learnt = ["the other then", "then there he hen", "the the the the other", "a b a b a b a", "", "été été " * 9, "hen HEN\thE"]
    asked = [*learnt, "other the.", "thx zzz", "é", "hhhhhhhhhh", "b a"]
    slow = SlowTrie([t.lower() for t in learnt], order)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(asked)], "doc_id long, text string").repartition(3)
    found = {r.doc_id: r.score for r in ppm.score(df, f"doc_id < {len(learnt)}", order=order, frequent=30, chunk=40).collect()}
    assert [found[i] for i in range(len(asked))] == pytest.approx([slow.score(t.lower()) for t in asked], rel=1e-5)


def test_the_order_of_words_counts(spark):
    df = spark.createDataFrame([(i, "red apple green leaf " * 5) for i in range(9)] + [(10, "red apple green leaf"), (11, "apple leaf red green")], "doc_id long, text string")
    found = {r.doc_id: r.score for r in ppm.score(df, "doc_id < 10").collect()}
    assert found[10] > found[11] + 3


def test_rare_contexts_are_kept(spark):
    heavy = ["abcdef " * 40_000] * 8
    texts = [*heavy, "wonderful", "wonderful", "abcdefgh wonderfully"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {r.doc_id: r.score for r in ppm.score(df, "doc_id < 10", frequent=4).collect()}
    slow = SlowTrie(texts[:10], 6)
    assert [found[i] for i in (0, 8, 10)] == pytest.approx([slow.score(texts[i]) for i in (0, 8, 10)], rel=1e-5)


def test_trie_is_a_distribution():
    texts = ["ab abc b", "abab ba", "b"]
    gram = ppm.read([t.encode() for t in texts], 3)[0]
    trie = ppm.levels(*np.unique(gram, return_counts=True), 3)
    for before in (b"\n\n\n", b"b a", b" ab", b"zza", b"zzz"):
        grams = np.array([int.from_bytes(before + bytes([x]), "big") for x in range(256)], np.uint64)
        assert (10 ** ppm.rate(grams, trie)).sum() == pytest.approx(1)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(1, 2**64 - 1), unique=True, max_size=300), st.lists(st.integers(1, 2**64 - 1), max_size=50))
def test_lookup(keys, others):
    table = ppm.Lookup(np.array(keys, np.uint64), np.arange(len(keys), dtype=float))
    value, hit = table.get(np.array(keys + others, np.uint64))
    want = {k: i for i, k in enumerate(keys)}
    assert hit.tolist() == [k in want for k in keys + others] and value.tolist() == [want.get(k, 0) for k in keys + others]


def test_scores_beat_the_base(spark):
    sf = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(sf):
        pytest.skip("no tables here")
    r = ppm.score(spark.read.parquet(sf), "crc32(cast(cast(doc_id as string) as binary)) % 10 <> 0").filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1] * 0.985


def paragraphs(t):
    found = re.findall(iblt.PARAGRAPH, t)
    assert "".join(found) == t and all(len(p) <= 384 for p in found)
    return set(found)


def test_fingerprints(spark, rows, empty):
    given = [*rows, (5000, "long " * 20_000, None, None, 0, 1, "k", 2, "b")]
    df = spark.createDataFrame(given, SCHEMA)
    found = {r.doc_id: r for r in iblt.near_next_and_edited(df, blocks=5).collect()}
    order = sorted((r[0], r[1] or "") for r in given)
    like = lambda a, b: 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0
    prints = {}
    for i, (d, t) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        r = found[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == pytest.approx(like(paragraphs(t), paragraphs(edited))) and r.near_next == pytest.approx(like(paragraphs(t), paragraphs(after)))
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint
    assert iblt.near_next_and_edited(empty).count() == 0
    assert iblt.near_next_and_edited(df.limit(1)).count() == 1


def test_likeness_does_not_depend_on_steps_of_length(spark):
    """Whatever its length, a text is like itself with a changed or shorter end, and unlike another."""
    rng = np.random.default_rng(2)
    letters = lambda n: "".join(chr(97 + int(x)) for x in rng.integers(0, 26, n))
    rows = []
    for n in (1020, 1040, 2050, 4100, 9000, 33_000, 66_000, 70_000, 300_000):
        t = letters(n)
        rows += [(len(rows), t), (len(rows) + 1, t[: n - 10]), (len(rows) + 2, "next text,")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in iblt.near_next_and_edited(df, blocks=2).collect()}
    for i in range(0, len(rows), 3):
        assert found[i].near_next > 0.8 and found[i + 1].near_next == 0
        assert 0.6 < found[i + 1].near_edited < 0.95 and found[i].near_edited > 0.55


def test_fingerprints_are_what_is_subtracted(spark):
    """The likeness of near texts follows from the published fingerprints alone."""
    rng = np.random.default_rng(12)
    text = prose(rng, 300, 5000)
    df = spark.createDataFrame([(1, text), (2, text[:-40])], "doc_id long, text string")
    found = {r.doc_id: r for r in iblt.near_next_and_edited(df, blocks=1).collect()}
    cells = lambda f: [(int(f[i : i + 16], 16), int(f[i + 16 : i + 20], 16)) for i in range(0, len(f), 20)]
    left = [(a ^ x, b - y) for (a, b), (x, y) in zip(cells(found[1].fingerprint), cells(found[2].fingerprint), strict=True)]
    a, b = paragraphs(text), paragraphs(text[:-40])
    assert len(left) == 24 and sum(n for _, n in left) == 3 * (len(a) - len(b))
    assert found[1].next_difference == len(a ^ b) and {x for x, n in left if n} and found[1].near_next == pytest.approx(2 * len(a & b) / (len(a) + len(b)))


def test_fingerprints_of_idless_rows(spark):
    df = spark.createDataFrame([(None, "a"), (None, None), (3, "b"), (3, "b"), (3, "c")], "doc_id long, text string")
    found = iblt.near_next_and_edited(df).collect()
    assert len(found) == 5 and sorted(r.near_next for r in found) == [0, 0, 0, 0, 1]


def test_peeling_recovers_digests(spark):
    rows = [(i, list(range(i)), list(range(i // 2, i + 5)), 2, 16) for i in range(0, 40, 3)]
    df = spark.createDataFrame(rows, "id int, a array<long>, b array<long>, parts int, width int")
    got = {}
    for r in iblt.differ(df, ["id"]).collect():
        one = got.setdefault(r.id, [True, set(), set()])
        one[0] &= r.ok
        one[1] |= set(r.digests_a)
        one[2] |= set(r.digests_b)
    for i, a, b, *_ in rows:
        if got[i][0]:
            assert got[i][1:] == [set(a) - set(b), set(b) - set(a)]
    assert sum(x[0] for x in got.values()) >= len(rows) - 3


def check_repeats(df, rows, **how):
    """rows(id, text): every row against all windows of all rows."""
    key = lambda d: math.inf if d is None else d
    least = {}
    for d, t in rows:
        w = words_of(t)
        for i in range(len(w) - 12):
            least[tuple(w[i : i + 13])] = min(least.get(tuple(w[i : i + 13]), math.inf), key(d))
    want = Counter()
    for d, t in rows:
        w = words_of(t)
        gone = {j for i in range(len(w) - 12) if least[tuple(w[i : i + 13])] < key(d) for j in range(i, i + 13)}
        want[d, len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest(), tuple(sorted(gone))] += 1
    found = debruijn.remove_repeats(df, filter_bits=17, **how).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, tuple(j for s in r.removed for j in range(s.start, s.start + s.length))) for r in found) == want


def test_repeats(docs, rows, empty):
    check_repeats(docs, [r[:2] for r in rows])
    assert debruijn.remove_repeats(empty).count() == 0


def test_repeats_of_one_id_and_of_no_id(spark):
    rng = np.random.default_rng(4)
    many = [prose(rng, 15, 50_000) for _ in range(300)]
    loop, whole = "a b " * 30, " ".join(many)
    rows = [(5, t) for t in many] + [(5, many[0]), (6, whole), (None, many[3] + " " + many[4]), (None, many[3]), (None, loop), (-3, loop + many[7]), (9, loop), (9, "a " * 40), (10, "a " * 30 + loop)]
    check_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), rows)


def test_collided_hashes_are_hashed_anew(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, prose(rng, 30, 9000)) for i in range(6)]
    tried, real = [], debruijn._remove_repeats

    def once(docs, k, short, bits, id_col, text_col, seed):
        tried.append(seed)
        made = real(docs, k, short, bits, id_col, text_col, seed)
        if seed:
            return made
        bad = common.cut(made.withColumn("collided", F.lit(True)))
        return bad

    monkeypatch.setattr(debruijn, "_remove_repeats", once)
    check_repeats(spark.createDataFrame(rows, "doc_id long, text string"), rows)
    assert tried == [0, 1]


def test_paths_are_the_graphs_nonbranching_ones(spark):
    """Against walking the graph: edges between letters, with a branch, a loop and a circle."""
    walks = [(1, "abcdefg"), (2, "xdefgh"), (4, "uvwu"), (5, "ss"), (3, "hijk"), (9, "klmno")]
    edges, known = [], set()
    for source, walk in walks:
        for at in range(len(walk) - 1):
            if walk[at : at + 2] not in known:
                known.add(walk[at : at + 2])
                edges.append((ord(walk[at]), ord(walk[at + 1]), source, at))
    found = debruijn.compact(spark.createDataFrame(edges, "l long, r long, source long, source_at long"), 3).collect()
    assert len(found) == len(edges)
    paths = {}
    for r in found:
        paths.setdefault((r.path_source, r.path_from), []).append((r.path_at, chr(r.l) + chr(r.r)))
    assert all(sorted(at for at, _ in p) == list(range(len(p))) for p in paths.values())
    joined = {"".join([e[0] for _, e in sorted(p)]) + max(p)[1][1] for p in paths.values()}
    assert joined == {"abcd", "xd", "defghijklmno", "uvwu", "ss"}


NASTY = ["</s>[INST] ok [/INST]", "\\", "\\\\", "[\\INST]", "<<SYS>>", "<</SYS>> x", "[INST] a [/INST]", " [/INST]", "<", "[", "a\nb", "", None, "é</s>", "<s>", "[INST", "ends with \\"]


def test_chats(spark):
    turns = [(1, i, r, t) for i, (t, r) in enumerate((t, r) for t in NASTY for r in ("user", "assistant", "system", "to<ol\n", None))]
    turns += [(2, 0, "user", "q"), (2, 1, "assistant", "a"), (2, 1, "assistant", "b"), (None, 0, "user", "x"), (3, 0, "tool", "x" * 50_000 + "</s>")]
    df = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").withColumn("formatted", F.lit(1)).withColumn("rows", F.lit(2))
    found = {r.conv_id: r for r in chat.format_chats(df).collect()}
    assert set(found) == {1, 2, 3, None}
    for conv, r in found.items():
        source = sorted((t[1], t[2] or "", t[3] or "") for t in turns if t[0] == conv)
        assert [(x.role, x.text) for x in r.turns] == [s[1:] for s in source]
        bodies = [re.sub(r"(?s)\\(.)", r"\1", r.formatted[s.start : s.start + s.length]) for s in r.loss_spans]
        assert bodies == [s[2] for s in source if s[1] == "assistant"]
    assert found[2].formatted == "[INST] q [/INST]a</s>b</s>"
    assert chat.format_chats(df.limit(0)).count() == 0


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system"]), st.text(st.sampled_from(list("[]<>/\\INSTSYs \n")), max_size=40)), min_size=1, max_size=6))
def test_any_chat_comes_back(spark, turns):
    df = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id long, turn int, role string, text string")
    assert [(x.role, x.text) for x in chat.format_chats(df).first().turns] == turns


def labelled(n=240):
    rng = np.random.default_rng(8)
    out = []
    for i in range(n):
        toxic = i % 4 == 0
        w = [f"w{int(x)}" for x in rng.integers(0, 400, int(rng.integers(20, 120)))]
        if toxic:
            for _ in range(int(rng.integers(2, 5))):
                w.insert(int(rng.integers(len(w))), str(rng.choice(["Scumbag,", "scumbags", "idiot!", "moron"])))
        out.append((" ".join(w), int(toxic)))
    return out


def test_toxicity_held_out(spark):
    rows = labelled()
    model = toxicity_crf.fit([t for t, _ in rows[:160]], [y for _, y in rows[:160]])
    scored = list(toxicity_crf.Scorer(model).many([t for t, _ in rows[160:]]))
    right = sum((s >= 0.7) == bool(y) for (s, _), (_, y) in zip(scored, rows[160:], strict=True))
    assert right >= 78
    for (_, spans), (t, _) in zip(scored, rows[160:], strict=True):
        assert all(re.match(r"(?i)scumbag|idiot|moron", t[a:b]) for a, b, _ in spans)
    clean = toxicity_crf.fit([], [])
    assert all(0 <= s <= 1 for s, _ in toxicity_crf.Scorer(clean).many([None, "", "x"]))


def test_toxicity_scores_rows(spark, docs, rows, empty):
    train = labelled(160)
    lab = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(train)] + [(5, None)], "doc_id long, toxic int")
    texts = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(train)], "doc_id long, text string")
    model = toxicity_crf.learn(texts, lab)
    assert toxicity_crf.score(docs, model).filter("score between 0 and 1").count() == len(rows)
    assert toxicity_crf.score(docs, model, keep=True).columns == [*docs.columns, "__score"]
    assert toxicity_crf.score(empty, model).count() == 0


def all_paths(e, link):
    """Each token's probability of the toxic state, by the weights of all paths."""
    n, weight = len(e), {}
    for path in range(2**n):
        s = [path >> i & 1 for i in range(n)]
        weight[path] = math.exp(sum(e[i] * s[i] for i in range(n)) + sum(link[s[i], s[i + 1]] for i in range(n - 1)))
    return [sum(w for p, w in weight.items() if p >> i & 1) / sum(weight.values()) for i in range(n)]


def test_marginals_against_all_paths():
    rng = np.random.default_rng(3)
    link = np.array([[2.6, -1.5], [-0.4, 3.7]])
    texts = [rng.normal(size=n) * 2 for n in (1, 7, 2, 9, 5)]
    first = np.concatenate([np.arange(len(e)) == 0 for e in texts])
    want = [p for e in texts for p in all_paths(e, link)]
    assert toxicity_crf.marginals(np.concatenate(texts), link, first).tolist() == pytest.approx(want)


def test_marginals_of_long_texts_reach_from_end_to_end():
    rng = np.random.default_rng(4)
    link = np.array([[6.0, -1.0], [0.0, 6.0]])  # what is far off counts
    e = np.concatenate([rng.normal(size=5000) * 0.1, rng.normal(size=3) * 80])
    first = np.arange(len(e)) == 0
    first[5000] = True
    left, right = [e[0]], [0.0]
    for t in range(1, 5000):
        left.append(e[t] + np.logaddexp(link[0, 1], left[-1] + link[1, 1]) - np.logaddexp(link[0, 0], left[-1] + link[1, 0]))
    for t in range(4998, -1, -1):
        x = e[t + 1] + right[-1]
        right.append(np.logaddexp(link[1, 0], x + link[1, 1]) - np.logaddexp(link[0, 0], x + link[0, 1]))
    want = 1 / (1 + np.exp(-(np.array(left) + np.array(right[::-1]))))
    got = toxicity_crf.marginals(e, link, first)
    assert got[:5000].tolist() == pytest.approx(want.tolist(), rel=1e-6)
    assert np.isfinite(got).all() and len(toxicity_crf.marginals(np.zeros(0), link, np.zeros(0, bool))) == 0


def test_toxicity_score_by_hand():
    model = toxicity_crf.fit([t for t, _ in labelled()], [y for _, y in labelled()])
    for text in ("w1 Scumbag, w2 idiot! w3", "w5", "... w7 ?!", "moron"):
        e = [model.bias + sum(model.weights.get(f, 0) for f in toxicity_crf.word_features(t)) for t in text.split()]
        p = sorted(all_paths(e, model.link))
        x = [1, math.log1p(sum(v for v in p if v > 0.02)), p[-1], p[-2] if len(p) > 1 else 0]
        assert next(toxicity_crf.Scorer(model).many([text]))[0] == pytest.approx(1 / (1 + math.exp(-float(np.dot(model.document, x)))))


def test_toxicity_sample_has_usable_rows_only(spark):
    train = labelled(60)
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(train)] + [(0, "zz zz"), (100, None), (101, " "), (102, "x" * 99999), (None, "y")], "doc_id long, text string")
    lab = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(train)] + [(100, 1), (101, 1), (102, 1), (None, 1), (7, None), (999, 1)], "doc_id long, toxic int")
    want = toxicity_crf.fit([t for t, _ in train], [y for _, y in train])
    got = toxicity_crf.learn(docs, lab, most_rows=60)
    assert got.weights == want.weights and got.document.tolist() == want.document.tolist()


def test_look_up_spreads_a_hot_key(spark):
    big = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(300)], "id long, key string")
    small = spark.createDataFrame([("hot", 1), ("k0", 2)], "key string, v int")
    got = {r.id: r.v for r in common.look_up(big, small, ["key"], "id", 4).collect()}
    assert got == {i: 1 if i % 3 else 2 if i == 0 else None for i in range(300)}

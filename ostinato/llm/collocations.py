"""Phrases that stand for themselves: n-gram counts by suffix arrays of word ids, scored by how their parts occur elsewhere.

A shard is a bounded stretch of texts that a task has read. Its words become
ids, and its places are sorted by the ranks of what follows them: by one word,
then by prefix doubling, a pair of ranks at a time, by two and four. In that
order neighbours are compared; an LCP interval of depth k, a maximal stretch of
places that agree in k words, is an n-gram with its count in the shard. Shards'
counts are merged by key.

An n-gram can only be frequent if the shorter ones in it are. Words are counted
first, then hashes of pairs of frequent words, then all phrases whose pairs'
hashes are frequent, by their words. What is frequent is told to the tasks by a
bit field of fixed size; a false hit there, or two pairs of one hash, costs
counted rows and changes nothing, and counts below the least are dropped after
merging, not before.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

U = np.uint64
#: A byte that no UTF-8 text has.
_CUT = b"\xff"
_PIECES = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", _CUT * 10)


def tokens(text: bytes) -> list[bytes]:
    """Words of a text, lower-cased in A-Z, with a cut between its pieces."""
    return text.lower().translate(_PIECES).replace(_CUT, b" \xff ").split()


def ranks(ids: np.ndarray, most: int) -> list[np.ndarray]:
    """ranks(ids, most)[j]: the order among all places of the 2**j words from there on, words beyond a cut (id 0) being none.

    Equal ranks, equal words; as many steps as `most` words need.
    """
    out, width = [ids], 1
    while width < most:
        r = out[-1]
        ahead = np.zeros_like(r)
        ahead[:-width] = r[width:]
        ahead[reach(ids) < width] = 0  # a cut is nearer than the second half
        key = r * (int(r.max(initial=0)) + 1) + ahead
        out.append(np.unique(key, return_inverse=True)[1].reshape(-1))
        width *= 2
    return out


def reach(ids: np.ndarray) -> np.ndarray:
    """How many words stand from a place to the next cut."""
    n = len(ids)
    cuts = np.where(ids == 0, np.arange(n), n)
    return np.minimum.accumulate(cuts[::-1])[::-1] - np.arange(n)


def grams(ids: np.ndarray, lengths: range, wanted: Callable[[int], np.ndarray] | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, first places, counts) of the distinct n-grams of each length, from the LCP intervals of the suffix array.

    ids end with a cut, 0. wanted(length) tells which places an n-gram of that
    length may count at; all places of one n-gram alike.
    """
    left = reach(ids)
    by = ranks(ids, lengths[-1])
    places = np.nonzero(left >= lengths[0])[0]
    if wanted is not None:
        places = places[wanted(lengths[0])[places]]
    order = places[np.argsort(by[-1][places], kind="stable")]
    # the LCP of neighbours, up to the greatest length: agreement of the largest powers of two, then of what follows them
    a, b = order[:-1], order[1:]
    lcp = np.zeros(len(a), np.int64)
    for j in range(len(by) - 1, -1, -1):
        same = (np.minimum(left[a], left[b]) >= lcp + 2**j) & (lcp + 2**j <= lengths[-1])
        same[same] = by[j][(a + lcp)[same]] == by[j][(b + lcp)[same]]
        lcp[same] += 2**j
    for k in lengths:
        new = np.concatenate([[True], lcp < k]) if len(order) else np.zeros(0, bool)
        at = np.nonzero(new)[0]
        first, sizes = order[at], np.diff(np.append(at, len(order)))
        keep = left[first] >= k
        if wanted is not None:
            keep &= wanted(k)[first]
        yield k, first[keep], sizes[keep]


class Shard:
    """Texts of any languages, as word ids by language."""

    def __init__(self) -> None:
        self.bytes, self.parts, self.known = 0, defaultdict(list), {}

    def add(self, lang: str, text: bytes) -> None:
        self.bytes += len(text)
        if lang not in self.known:
            ids = count()
            self.known[lang] = defaultdict(ids.__next__)
            self.known[lang][_CUT]
        said = tokens(text)
        said.append(_CUT)
        self.parts[lang].append(np.fromiter(map(self.known[lang].__getitem__, said), np.int64, len(said)))

    def languages(self) -> Iterator[tuple[str, np.ndarray, list[bytes], np.ndarray]]:
        """(language, ids, words by id, their hashes)."""
        for lang, parts in self.parts.items():
            words = list(self.known[lang])
            head = lang.encode() + b"\0"
            yield lang, np.concatenate(parts), words, np.fromiter((xxhash.xxh64_intdigest(head + w, 42) for w in words), U, len(words))


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ (a >> U(31))) * U(0x9E3779B97F4A7C15) + b
    return x ^ (x >> U(29))


def _counter(lengths: range, known: Callable[[], np.ndarray] | None, bits: int, shard_bytes: int, spelt: bool = True):
    """A function for mapInArrow: (lang, text) -> (lang, phrase, c), or (h, c) if not spelt: the counts in a shard of n-grams whose words (of pairs that aren't spelt) or pairs are in the field."""

    def emit(shard: Shard) -> Iterator[pa.RecordBatch]:
        field = known() if known else None
        for lang, ids, words, hashed in shard.languages():
            h = hashed[ids]
            pairs = np.append(_pair(h[:-1], h[1:]), U(0))
            may = None
            if field is not None:
                spot = ((pairs if spelt else h) & U(2**bits - 1)).astype(np.int64)
                hit = (field[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1 == 1

                def may(k: int, hit: np.ndarray = hit) -> np.ndarray:
                    ok = hit.copy()
                    for j in range(1, k - (1 if spelt else 0)):
                        ok[:-j] &= hit[j:]
                    return ok

            for k, first, sizes in grams(ids, lengths, may):
                for i in range(0, len(first), 50_000):
                    at, c = first[i : i + 50_000], pa.array(sizes[i : i + 50_000])
                    if spelt:
                        said = [b" ".join([words[x] for x in row]) for row in ids[at[:, None] + np.arange(k)].tolist()]
                        yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(said, pa.binary()).cast(pa.string()), c], ["lang", "phrase", "c"])
                    else:
                        yield pa.record_batch([pa.array(pairs[at].view(np.int64)), c], ["h", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard()
        for b in batches:
            for part, texts in common.by_bytes(b, "text"):
                for lang, text in zip(part.column("lang").to_pylist(), texts, strict=True):
                    shard.add(lang, text or b"")
                if shard.bytes >= shard_bytes:
                    yield from emit(shard)
                    shard = Shard()
        yield from emit(shard)

    return common.lean(run)


def _field(df: DataFrame, bits: int) -> Callable[[], np.ndarray]:
    """A bit field of the column h, 2**bits wide, broadcast."""
    spark = df.sparkSession
    spot = F.pmod("h", F.lit(2**bits))
    rows = df.groupBy(F.expr(f"pmod(h, {2**bits}L) div 32768").alias("row")).agg(F.bitmap_construct_agg(spot % 32768).alias("bits")).collect()
    made = np.zeros((2 ** max(0, bits - 15), 4096), np.uint8)
    for r in rows:
        made[r["row"]] = np.frombuffer(r["bits"], np.uint8)
    shared = spark.sparkContext.broadcast(made.reshape(-1))
    return lambda: shared.value


def counts(docs: DataFrame, least: int = 30, most_words: int = 4, lang_col: str = "lang", text_col: str = "text", filter_bits: int = 27, shard_bytes: int = 2**23) -> tuple[DataFrame, DataFrame]:
    """(lang, n): all word occurrences of a language; (lang, phrase, words, c): phrases of up to most_words (2 to 8) words that occur `least` times or more.

    Both are written. Occurrences lie within a piece and may overlap.
    """
    if not 2 <= most_words <= 8:
        raise ValueError("phrases have 2 to 8 words at most")
    given = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("binary").alias("text"))

    def merged(lengths: range, known: Callable[[], np.ndarray] | None) -> DataFrame:
        found = given.mapInArrow(_counter(lengths, known, filter_bits, shard_bytes), "lang string, phrase string, c long")
        return found.groupBy("lang", "phrase").agg(F.sum("c").alias("c"))

    words = common.cut(merged(range(1, 2), None))
    totals = common.cut(words.groupBy("lang").agg(F.sum("c").alias("n")))
    often = words.filter(F.col("c") >= least)
    known = _field(often.select(F.xxhash64(F.concat("lang", F.lit("\0"), "phrase")).alias("h")), filter_bits)
    pairs = given.mapInArrow(_counter(range(2, 3), known, filter_bits, shard_bytes, spelt=False), "h long, c long")
    pairs = common.cut(pairs.groupBy("h").agg(F.sum("c").alias("c")).filter(F.col("c") >= least).select("h"))
    phrases = common.cut(merged(range(2, most_words + 1), _field(pairs, filter_bits)).filter(F.col("c") >= least))
    common.discard(pairs)
    return totals, often.unionAll(phrases).select("lang", "phrase", F.size(F.split("phrase", " ")).alias("words"), "c")


def _part(first: Column, length: Column) -> Column:
    """Of the words of `said`: so many from the first-th (from 1), joined."""
    return F.array_join(F.slice("said", first, length), " ")


def mine(docs: DataFrame, least: int = 30, most_words: int = 4, top: int = 2000, within: int = 80, scale: int = 2_000_000, lang_col: str = "lang", text_col: str = "text", filter_bits: int = 27, shard_bytes: int = 2**23) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases.

    Texts are lower-cased in A-Z, cut into pieces at [.,;:!?] and line ends
    (\\n to \\r), and these into words at spaces and tabs. A candidate is a phrase of 2 to
    most_words words that occurs a >= least times within pieces, overlaps
    included. Cut after its first k words, whose count is l and that of the rest
    r, it scores floor(scale * a / (l + r)); the cut of least score counts, of
    ties that of least k. A candidate goes if its words stand within a longer
    one, whether that goes or not, that occurs `within` percent as often or more.
    n counts all words of the language. Ranks go by score, then a, both
    descending, then by the phrase's bytes; arithmetic is exact.

    A null language is `und`, together with those that are so called. Null and
    empty texts have no words; a language without candidates has no rows, nor
    has an empty table. All rows count, repeated ones and those of one id alike;
    ids and other columns of any name aren't read. A text is held whole in a
    task, a shard ends with the part of it (1 MB or one text) that fills it.
    """
    totals, counted = counts(docs, least, most_words, lang_col, text_col, filter_bits, shard_bytes)
    said = counted.withColumn("said", F.split("phrase", " "))
    candidates = said.filter("words > 1")
    # what a longer candidate holds, and how often the most frequent such occurs
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.col("words") - k + 1), lambda i: _part(i, k))))
    inside = candidates.filter("words > 2").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), F.col("c").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    exact = lambda c: F.col(c).cast("decimal(20,0)")
    alone = candidates.join(inside, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (exact("longer") * 100 < exact("c") * within)).drop("longer")
    cuts = F.transform(F.sequence(F.lit(1), F.col("words") - 1), lambda k: F.struct(k.alias("k"), _part(F.lit(1), k).alias("head"), _part(k + 1, F.col("words") - k).alias("tail")))
    cut = alone.select("lang", "phrase", F.col("c").alias("a"), F.explode(cuts).alias("at")).select("lang", "phrase", "a", "at.*")
    # a part may belong to a third of all candidates: each language's part meets its count once a salt
    heads = common.look_up(cut, counted.select("lang", F.col("phrase").alias("head"), F.col("c").alias("l")), ["lang", "head"], "phrase")
    both = common.look_up(heads, counted.select("lang", F.col("phrase").alias("tail"), F.col("c").alias("r")), ["lang", "tail"], "phrase")
    score = F.expr(f"cast(a as decimal(20,0)) * {scale} div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    best = both.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("at"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    # the first of each language are told within tasks before they meet
    ranked = best.select("lang", "phrase", "a", "at.l", "at.r", "at.score").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    n = F.broadcast(totals) if totals.limit(10_001).count() <= 10_000 else totals
    return ranked.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")

"""Near duplicates by shingles of words: the exact way for the links that SimHash anchors don't find.

Texts whose Jaccard similarity is 0.8 or more can be so many bits apart that no
covering code reaches them; here all of them meet. Candidates come from
prefixes: with the shingles of every set in one order, two sets that are alike
enough share one among the first |x| - ceil(0.8 |x|) + 1 of each. Common shingles, as a sample of the texts tells them, come last; that
makes the prefixes selective and has no effect on which pairs are found.

What two sets share stands, in both, at or after the first shingle that they
share. So where x members of one set and y of the other are left from that
shingle on, itself included, no more than min(x, y) are shared: a shingle at
which this is too few needn't bring the two together. Farther on in the order
fewer are left, so that the shingles at which two sets meet are the first that
they share. The smaller of two sets that meet has enough left for a set of its
own size ("early"): sets that haven't only meet smaller, early ones.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components


def shingles(text: bytes | None, words: int = 5) -> np.ndarray:
    """Distinct hashes of the text's shingles, sorted; a text of fewer words is one shingle."""
    w = (text or b"").lower().split()
    tuples = zip(*(w[i:] for i in range(words)), strict=False) if len(w) >= words else [w]
    digest, join = xxhash.xxh64_digest, b" ".join
    return np.unique(np.frombuffer(b"".join([digest(join(t)) for t in tuples]), np.int64))


def alike(shared: Column, both: Column) -> Column:
    """Whether two sets of `both` members together that share so many have a similarity of 4/5 or more."""
    return 9 * shared >= 4 * both


def _early(rest: Column, size: Column) -> Column:
    """Whether a set of which so many are left can be alike to another of its size."""
    return alike(rest, 2 * size)


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """node and its set of batches (node, text)."""
    for b in batches:
        for part, texts in common.by_bytes(b, 1):
            sets = [shingles(t, words) for t in texts]
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))], ["node", "set"])


def _prefixes(rows: DataFrame, words: int, one_in: int, listed: int) -> DataFrame:
    """shingle, node, size, rest: the first shingles of the set of each of rows(node, text), and how many are left from each on."""
    some = rows.filter(F.pmod(F.xxhash64("node"), F.lit(one_in)) == 0).mapInArrow(common.lean(lambda batches: _sets(batches, words)), "node long, set array<long>").select(F.explode("set").alias("s"))
    often = some.groupBy("s").agg(F.count(F.lit(1)).alias("n")).filter("n > 3").orderBy(F.desc("n"), "s").limit(listed).toArrow()
    often = often.column("s").to_numpy()
    by = np.argsort(often)
    sent = rows.sparkSession.sparkContext.broadcast((often[by], -by))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank = sent.value
        for b in _sets(batches, words):
            out, nodes = [], b.column(0).to_numpy()
            for row in b.column(1):
                s = row.values.to_numpy()
                if len(known):
                    place = np.searchsorted(known, s).clip(0, len(known) - 1)
                    hit = known[place] == s
                    s = np.concatenate([s[~hit], s[hit][np.argsort(rank[place[hit]], kind="stable")]])
                out.append(s[: len(s) - (4 * len(s) + 4) // 5 + 1])
            sizes = b.column(1).value_lengths().to_numpy()
            many = [len(x) for x in out]
            rests = np.concatenate([np.zeros(0, np.int64), *(n - np.arange(m) for n, m in zip(sizes, many, strict=True))])
            yield pa.record_batch([pa.array(np.concatenate([*out, np.zeros(0, np.int64)])), pa.array(np.repeat(nodes, many)), pa.array(np.repeat(sizes, many).astype(np.int32)), pa.array(rests.astype(np.int32))], ["shingle", "node", "size", "rest"])

    return common.cut(rows.mapInArrow(common.lean(run), "shingle long, node long, size int, rest int"))


def verified(pairs: DataFrame, rows: DataFrame, words: int) -> DataFrame:
    """Those of pairs(a, b) that are alike, by the sets of rows(node, text)."""
    pairs = common.cut(pairs.select("a", "b"))
    met = rows.join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi")
    sets = common.cut(met.select("node", "text").mapInArrow(common.lean(lambda batches: _sets(batches, words)), "node long, set array<long>"))
    both = pairs.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")
    found = common.cut(both.filter(alike(F.size(F.array_intersect("set_a", "set_b")), F.size("set_a") + F.size("set_b"))).select("a", "b"))
    common.discard(pairs)
    common.discard(sets)
    return found


def _mixed(members: DataFrame, links: DataFrame) -> DataFrame:
    """members(shingle, node, size, rest) of the shingles whose nodes links(a, b) don't join yet, with each node's part.

    Members that no early one of their shingle can be alike to are left out.
    """
    size, rest = F.col("size"), F.col("rest")
    early = _early(rest, size)
    parted = members.join(components(links), "node", "left").select("shingle", "node", "size", "rest", F.coalesce("component", "node").alias("part"))
    most = 9 * rest - 4 * size  # four times the size of the largest set that can be alike
    apart = parted.groupBy("shingle").agg(F.min("part").alias("first"), F.max("part").alias("last"), F.min(F.when(early, 4 * size)).alias("least"), F.max(F.when(early, most)).alias("most"))
    met = parted.join(apart.filter("first <> last"), "shingle")
    return common.cut(met.filter(early | (F.col("least") <= most) & (4 * size <= F.col("most"))).select(*parted.columns))


def _stars(shared: DataFrame) -> DataFrame:
    """Pairs (a, b) that may be alike: each member of a shingle and the centre of those of about its size, for two divisions of the sizes.

    The centre is that before which the fewest shingles stand: of copies with
    changes the one with the least changes, as what was changed is rare. Sets
    of either side of a bound of one division have a centre in the other.
    """
    step = F.log(F.col("size")) / math.log(1.25)
    own = shared.withColumn("class", F.explode(F.array(2 * F.floor(step), 2 * F.floor(step + 0.5) + 1)))
    centre = own.groupBy("shingle", "class").agg(F.min(F.struct((F.col("size") - F.col("rest")).alias("before"), "node", "size", "rest", "part")).alias("centre"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    met = own.join(centre, ["shingle", "class"])
    may = alike(F.least("rest", "centre.rest"), F.col("size") + F.col("centre.size"))
    return met.filter((F.col("part") != F.col("centre.part")) & may).select(F.col("centre.node").alias("a"), F.col("node").alias("b")).distinct()


def _pairs(members: DataFrame) -> DataFrame:
    """a, b, both (their sizes' sum), left: a row for each shingle of members at which two of different parts may be alike; a is the smaller one."""
    one = members.filter(_early(F.col("rest"), F.col("size"))).select("shingle", F.col("node").alias("a"), F.col("size").alias("x"), F.col("rest").alias("left_a"), F.col("part").alias("part_a"))
    other = members.select("shingle", F.col("node").alias("b"), F.col("size").alias("y"), F.col("rest").alias("left_b"), F.col("part").alias("part_b"))
    may = alike(F.least("left_a", "left_b"), F.col("x") + F.col("y"))
    met = one.join(other, "shingle").filter((F.col("part_a") != F.col("part_b")) & ((F.col("x") < F.col("y")) | (F.col("x") == F.col("y")) & (F.col("a") < F.col("b"))) & may)
    return met.select("a", "b", (F.col("x") + F.col("y")).alias("both"), F.least("left_a", "left_b").alias("left"))


def rest(rows: DataFrame, given: DataFrame, words: int, one_in: int, listed: int) -> DataFrame:
    """Pairs (a, b) of nodes that join, with the given links, what all alike pairs of rows(node, text) join.

    First each member of a shingle meets two centres, so that a large group of
    near copies is joined without its pairs; then members meet that aren't
    joined yet. A shingle whose members the links join already has no pair to
    look at. Common shingles are told from one in `one_in` texts, and the
    `listed` most common are known to every task: this decides what the search
    costs, not what it finds.
    """
    prefix = _prefixes(rows, words, one_in, listed)
    shared = _mixed(prefix, given)
    common.discard(prefix)
    links = given.union(verified(_stars(shared), rows, words))
    left_over = _mixed(shared.drop("part"), links)
    common.discard(shared)
    # the shingles at which two met are the first that they share: past the last of these no more than what is left behind it
    pairs = _pairs(left_over).groupBy("a", "b").agg(F.count(F.lit(1)).alias("m"), F.min("left").alias("left"), F.first("both").alias("both"))
    more = verified(pairs.filter(alike(F.col("m") + F.col("left") - 1, F.col("both"))), rows, words)
    common.discard(left_over)
    return links.union(more)

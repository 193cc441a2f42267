"""Near duplicates by SimHash: a covering code's words are anchors, fingerprints meet at them.

Why no link is lost: let r(f) be the distance of f to its nearest anchor, its
home. Of two fingerprints f, g at most t bits apart let r(f) <= r(g). Then
d(g, home(f)) <= r(f) + t <= r(g) + t, so g, copied to every anchor within
r(g) + t, meets f at f's home. This holds for any code; a code with a small
covering radius only makes it cheap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, near_jaccard
from .components import components

BITS = 64


def simhash(text: bytes | None, words: int = 3, seed: int = 42) -> int:
    """Signed 64 bits: a bit is set if it is in more than half of the shingles' hashes. No word at all: 0."""
    w = (text or b"").lower().split()
    if not w:
        return 0
    tuples = zip(*(w[i:] for i in range(words)), strict=False) if len(w) >= words else [w]
    digest, join = xxhash.xxh64_digest, b" ".join
    raw = np.frombuffer(b"".join([digest(join(t), seed) for t in tuples]), np.uint8).reshape(-1, 8)
    count = sum(np.unpackbits(raw[i : i + 32768], axis=1).sum(axis=0, dtype=np.int64) for i in range(0, len(raw), 32768))
    return int.from_bytes(np.packbits(count * 2 > len(raw)).tobytes(), "big", signed=True)


def anchors(dimension: int, seed: int = 7, bits: int = BITS) -> np.ndarray:
    """The 2**dimension words of a linear [bits, dimension] code that holds the word of all ones.

    Random linear codes come near the sphere-covering bound.
    """
    rng = np.random.default_rng(seed)
    basis, reduced = [], []

    def independent(g: int) -> bool:
        for v in reduced:
            g = min(g, g ^ v)
        if g:
            reduced.append(g)
            reduced.sort(reverse=True)
        return bool(g)

    tries = iter([2**bits - 1])
    while len(basis) < dimension:
        g = next(tries, None) or int(rng.integers(0, 2**bits, dtype=np.uint64))
        if independent(g):
            basis.append(g)
    found = np.zeros(1, np.uint64)
    for g in basis:
        found = np.concatenate([found, found ^ np.uint64(g)])
    return found


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """id and fp, a signed long, of every whole text; null is a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, texts in common.by_bytes(b, 1):
                yield pa.record_batch([part.column(0), pa.array([simhash(t, words, seed) for t in texts], pa.int64())], ["id", "fp"])

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return picked.mapInArrow(common.lean(run), "id long, fp long")


def within_reach(fps: np.ndarray, code: list[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which fingerprint meets which anchor, by place, and each one's home.

    code: one array of anchors; or two, of the upper and lower 32 bits of the
    words of a product code, so that many more anchors can be told without
    listing them all.
    """
    if len(code) == 1:
        apart = np.bitwise_count(fps[:, None] ^ code[0][None, :])
        row, anchor = np.nonzero(apart <= apart.min(axis=1)[:, None] + bits)
        return row, anchor, apart.argmin(axis=1)
    upper = np.bitwise_count((fps >> np.uint64(32))[:, None] ^ code[0][None, :]).astype(int)
    lower = np.bitwise_count((fps & np.uint64(2**32 - 1))[:, None] ^ code[1][None, :]).astype(int)
    home = upper.argmin(axis=1) * len(code[1]) + lower.argmin(axis=1)
    upper, lower = upper - upper.min(axis=1)[:, None], lower - lower.min(axis=1)[:, None]
    rows, found = [], []
    for i, (u, v) in enumerate(zip(upper, lower, strict=True)):
        a, b = np.nonzero(u <= bits)[0], np.nonzero(v <= bits)[0]
        x, y = np.nonzero(u[a][:, None] + v[b][None, :] <= bits)
        found.append(a[x] * len(code[1]) + b[y])
        rows.append(np.full(len(x), i))
    return np.concatenate(rows), np.concatenate(found), home


def covering_code(dimension: int) -> list[np.ndarray]:
    """Anchors of a code of that dimension, as within_reach takes them: up to 2**14 words in one list, more as a product of two codes."""
    if dimension <= 14:
        return [anchors(dimension)]
    half = -(-dimension // 2)
    return [anchors(half, 7, 32), anchors(half, 8, 32)]


def dealt_over(anchor: np.ndarray, crowded: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """In how many groups each anchor's rows go: one, but for the `crowded` ones (sorted)."""
    if not len(crowded):
        return np.ones(len(anchor), np.int64)
    at = np.searchsorted(crowded, anchor).clip(0, len(crowded) - 1)
    return np.where(crowded[at] == anchor, groups[at], 1)


def _group(node: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The group of each node among `of`, by a hash, as ids may follow a pattern."""
    mixed = node.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(32)).astype(np.int64) % of


def _cells(keep: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row as often as `times` says: its place among keep, and the number of the copy."""
    return np.repeat(keep, times), np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)


def _meet(batches: Iterator[pa.RecordBatch], code: list[np.ndarray], bits: int, sent) -> Iterator[pa.RecordBatch]:
    """Rows (anchor, cell, home, fp, node) of the anchors that are home to any fingerprint.

    An anchor's homes and members go in groups, and each pair of groups meets in
    one cell: a home goes to all cells of its group, and so does a member.
    """
    homes_at, crowded, home_groups, member_groups = sent.value
    for b in batches:
        fps, nodes = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
        for i in range(0, len(fps), 128):
            f, n = fps[i : i + 128], nodes[i : i + 128]
            row, anchor, home = within_reach(f.view(np.uint64), code, bits)
            lived = homes_at[anchor >> 3] >> (anchor & 7).astype(np.uint8) & 1 == 1
            row, anchor = row[lived], anchor[lived]
            own, every = _cells(np.arange(len(home)), dealt_over(home, crowded, member_groups))
            at = home[own]
            own_cell = _group(n[own], dealt_over(at, crowded, home_groups)) * dealt_over(at, crowded, member_groups) + every
            copy, each = _cells(np.arange(len(row)), dealt_over(anchor, crowded, home_groups))
            row, anchor = row[copy], anchor[copy]
            many = dealt_over(anchor, crowded, member_groups)
            cell = each * many + _group(n[row], many)
            yield pa.record_batch(
                [
                    pa.array(np.concatenate([anchor, at]).astype(np.int32)),
                    pa.array(np.concatenate([cell, own_cell]).astype(np.int64)),
                    pa.array(np.concatenate([np.zeros(len(row), bool), np.ones(len(at), bool)])),
                    pa.array(np.concatenate([f[row], f[own]])),
                    pa.array(np.concatenate([n[row], n[own]])),
                ],
                ["anchor", "cell", "home", "fp", "node"],
            )


def forest(h_fp: np.ndarray, h_node: np.ndarray, m_fp: np.ndarray, m_node: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links that join what the close pairs (home, member) join: fewer than there are nodes, however many pairs there are."""
    nodes, at = np.unique(np.concatenate([h_node, m_node]), return_inverse=True)
    h, m = at[: len(h_node)], at[len(h_node) :]
    parent = list(range(len(nodes)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    label, links, i, step = np.arange(len(nodes)), [], 0, 1
    while i < len(h):
        row, col = np.nonzero(np.bitwise_count(h_fp[i : i + step, None] ^ m_fp[None, :]) <= bits)
        a, b = label[h[i + row]], label[m[col]]
        apart = a != b
        if apart.any():
            a, b = a[apart], b[apart]
            for pair in np.unique(np.minimum(a, b) * len(nodes) + np.maximum(a, b)).tolist():
                x, y = find(pair // len(nodes)), find(pair % len(nodes))
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    links.append((int(nodes[min(x, y)]), int(nodes[max(x, y)])))
            own, back = np.unique(label, return_inverse=True)
            label = np.array([find(x) for x in own.tolist()])[back]
        i += step
        step = min(step * 2, max(1, 2**20 // len(m)))
    return links


def _compare(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Links within each (anchor, cell); the rows come sorted by these."""

    def starts(b: pa.Table | pa.RecordBatch) -> np.ndarray:
        anchor, cell = b.column(0).to_numpy(), b.column(1).to_numpy()
        return np.nonzero((np.diff(anchor) != 0) | (np.diff(cell) != 0))[0] + 1

    def links(t: pa.Table) -> pa.RecordBatch:
        home, fp, node = (t.column(c).to_numpy() for c in ("home", "fp", "node"))
        fp, found = fp.view(np.uint64), []
        ends = [0, *starts(t), t.num_rows]
        for i, j in zip(ends, ends[1:], strict=False):
            is_home = home[i:j]
            if is_home.any() and not is_home.all():
                found += forest(fp[i:j][is_home], node[i:j][is_home], fp[i:j][~is_home], node[i:j][~is_home], bits)
        return pa.record_batch([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "b"])

    def key(b: pa.RecordBatch, i: int) -> tuple[int, int]:
        return b.column(0)[i].as_py(), b.column(1)[i].as_py()

    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        if held and key(held[0], 0) == key(b, b.num_rows - 1):
            held.append(b)
            continue
        last = int([0, *starts(b)][-1])
        held.append(b.slice(0, last))
        yield links(pa.Table.from_batches(held))
        held = [b.slice(last)]
    if held:
        yield links(pa.Table.from_batches(held))


def _summed(parts: list[np.ndarray]) -> np.ndarray:
    """Rows (anchor, members, homes) with one row an anchor."""
    rows = np.concatenate(parts, axis=1)
    anchor, at = np.unique(rows[0], return_inverse=True)
    members, homes = np.zeros_like(anchor), np.zeros_like(anchor)
    np.add.at(members, at, rows[1])
    np.add.at(homes, at, rows[2])
    return np.stack([anchor, members, homes])


def _reached(batches: Iterator[pa.RecordBatch], code: list[np.ndarray], bits: int, most: int = 2**18) -> Iterator[pa.RecordBatch]:
    """anchor, members, homes: how many of a task's fingerprints reach it, and how many are at home there.

    Counts are summed within the task, and sent on when those of `most` anchors are held.
    """
    held, rows = [np.zeros((3, 0), np.int64)], 0
    out = lambda x: pa.record_batch([pa.array(x[0].astype(np.int32)), pa.array(x[1]), pa.array(x[2])], ["anchor", "members", "homes"])
    for b in batches:
        fps = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for i in range(0, len(fps), 128):
            row, anchor, home = within_reach(fps[i : i + 128], code, bits)
            held.append(np.stack([anchor, np.ones_like(anchor), home[row] == anchor]).astype(np.int64))
            rows += len(anchor)
            if rows > most:
                held = [_summed(held)]
                rows = held[0].shape[1]
                if rows > most // 2:
                    yield out(held[0])
                    held, rows = [np.zeros((3, 0), np.int64)], 0
    yield out(_summed(held))


def links(known: DataFrame, bits: int, per_anchor: int, crowded: int) -> DataFrame:
    """Pairs (a, b) of nodes that join what all pairs of known(fp, node) at most `bits` apart join.

    What each anchor holds is counted first. Fingerprints aren't copied to an
    anchor that is home to none, where they could meet nobody. An anchor with
    more than `crowded` homes or members deals both in groups of about that
    many; each group of homes meets each group of members in a cell of its own,
    so that no task holds more than two groups at once, however large a cluster
    of like texts is. Told to every task: the homes as a bit field of at most 32
    MB (2**28 anchors), and the crowded anchors, of which there is at most one
    in `crowded` copies.
    """
    n = known.count()
    code = covering_code(min(28, max(4, (max(1, n) // per_anchor).bit_length())))
    spark = known.sparkSession
    parts = max(common.partitions(spark), 1)
    known = known.repartition(parts)
    counted = known.mapInArrow(common.lean(lambda batches: _reached(batches, code, bits)), "anchor int, members long, homes long")
    held = common.cut(counted.groupBy("anchor").agg(F.sum("members").alias("members"), F.sum("homes").alias("homes")).filter("homes > 0"))
    homes_at = np.zeros(max(4096, -(-int(np.prod([len(x) for x in code])) // 8)), np.uint8)
    for r in held.groupBy(F.bitmap_bucket_number(F.col("anchor") + 1).alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("anchor") + 1)).alias("bits")).toLocalIterator():
        homes_at[(r["at"] - 1) * 4096 : r["at"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    full = held.filter((F.col("members") > crowded) | (F.col("homes") > crowded)).orderBy("anchor").toArrow()
    anchor, members, homes = (full.column(c).to_numpy().astype(np.int64) for c in ("anchor", "members", "homes"))
    sent = spark.sparkContext.broadcast((homes_at, anchor, -(-homes // crowded), -(-members // crowded)))
    common.discard(held)
    met = known.mapInArrow(common.lean(lambda batches: _meet(batches, code, bits, sent)), "anchor int, cell long, home boolean, fp long, node long")
    return met.repartition(parts, "anchor", "cell").sortWithinPartitions("anchor", "cell").mapInArrow(common.lean(lambda batches: _compare(batches, bits)), "a long, b long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, bits: int = 3, seed: int = 42, per_anchor: int = 16, crowded: int = 7 * 2**10) -> DataFrame:
    """id, fingerprint (16 hex digits) and component_id for every row of docs.

    Fingerprints at most `bits` apart are linked; component_id is the smallest
    id that links reach, the row's own included. Null and wordless texts have
    fingerprint 0 and are linked like others. Rows of one id count as one
    document for each fingerprint they have; rows whose id is null take the
    component of their fingerprint, null if it has no other row. Other columns
    are ignored. per_anchor: about as many distinct fingerprints as anchors are
    made for, up to 2**28 anchors; crowded: see links.
    """
    rows = common.cut(fingerprints(docs, id_col, text_col, words, seed))
    known = common.cut(rows.groupBy("fp").agg(F.min("id").alias("node")))
    found = links(known.filter("node is not null"), bits, per_anchor, crowded)
    found = known.join(components(found), "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    told = common.look_up(rows, found, ["fp"], "id")
    return told.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, bits: int = 3, seed: int = 42, per_anchor: int = 16, crowded: int = 7 * 2**10, one_in: int = 4, listed: int = 2**20) -> DataFrame:
    """docs without all but one row of each group that alike texts link: that of the smallest id stays (null last), in the columns they had.

    Texts are alike if the Jaccard similarity of their shingles of `words`
    words, ASCII letters in lower case, is 0.8 or more; null, empty and wordless
    texts are alike, a text of fewer words is one shingle. Anchors link texts
    whose fingerprints, of the same shingles, are at most `bits` apart; each
    text is then checked against the least one that it is so joined to. Alike texts that are farther apart, up to 17 of 64 bits,
    are beyond any code's reach: near_jaccard.rest finds those links exactly.
    Of rows that agree in id and text one stays. Other columns don't count; an
    empty table gives an empty one.
    """
    return common.carrying(docs, [id_col, text_col], lambda own: _drop_near(own, id_col, text_col, words, bits, seed, per_anchor, crowded, one_in, listed))


def _drop_near(docs: DataFrame, id_col: str, text_col: str, words: int, bits: int, seed: int, per_anchor: int, crowded: int, one_in: int, listed: int) -> DataFrame:
    rows = common.cut(docs.withColumn("__node", F.monotonically_increasing_id()))
    texts = rows.select(F.col("__node").alias("node"), F.col(text_col).cast("binary").alias("text"))
    fps = common.cut(fingerprints(texts, "node", "text", words, seed))
    known = common.cut(fps.groupBy("fp").agg(F.min("id").alias("node")))
    joined = known.join(components(links(known, bits, per_anchor, crowded)), "node", "left").select("fp", F.coalesce("component", "node").alias("component"))
    # a pair for each text at most: each with the least one of those that fingerprints join it to
    close = common.look_up(fps, joined, ["fp"], "id").filter("id <> component").select(F.col("component").alias("a"), F.col("id").alias("b"))
    close = near_jaccard.verified(close, texts, words)
    found = components(near_jaccard.rest(texts, close, words, one_in, listed))
    found = found.union(found.select("component", "component").distinct().toDF("node", "component"))
    met = found.join(rows.select(F.col("__node").alias("node"), F.col(id_col).alias("id")), "node")
    first = met.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node")).alias("first")).select(F.col("first.node").alias("node"))
    gone = found.select("node").join(first, "node", "left_anti").withColumnRenamed("node", "__node")
    return rows.join(gone, "__node", "left_anti").select(*docs.columns)

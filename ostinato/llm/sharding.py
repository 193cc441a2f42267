"""Shards of near equal bytes, copies kept together, by Karmarkar-Karp differencing."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common


def difference(sizes: list[int], parts: int) -> list[int]:
    """The part of each item. Each starts as a partial partition with one part filled; the two of largest spread are
    combined, the fullest part of one with the emptiest of the other, until one is left."""
    if not sizes:
        return []
    heap = [(-s, i, ((0,) * (parts - 1) + (s,)), ((None,) * (parts - 1) + (i,))) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    made = len(heap)
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heap[0]
        both = sorted(((s + t, i) for i, (s, t) in enumerate(zip(a, reversed(b), strict=True))))
        members = [(x[i], y[parts - 1 - i]) if x[i] is not None and y[parts - 1 - i] is not None else x[i] if x[i] is not None else y[parts - 1 - i] for _, i in both]
        sums = tuple(s for s, _ in both)
        heapq.heapreplace(heap, (sums[0] - sums[-1], made, sums, tuple(members)))
        made += 1
    found = [0] * len(sizes)
    for part, tree in enumerate(heap[0][3]):
        stack = [tree]
        while stack:
            t = stack.pop()
            if isinstance(t, tuple):
                stack += t
            elif t is not None:
                found[t] = part
    return found


def shard(docs: DataFrame, shards: int = 16, blocks: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, size (UTF-8 bytes and 1 more, null as none), text_crc32, law, shard, slot, grown_shard.

    Equal texts, which may not be parted, are one item (null and "" are equal).
    Items of over 1/256 of a shard's due in bytes or rows, at most 512 * shards
    of them, go to the last differencing one by one. The others are dealt into
    `blocks` blocks by digest (by default twice the shuffle partitions, 64 to
    16384); each block's task combines them by differencing
    into `shards` bundles, and these, too, go to the last differencing, on the
    driver: at most shards * (blocks + 512) numbers. Slots count from 0 in each
    shard without gaps: blocks of ids are counted first, rows within them then,
    so that no task has a whole shard. law is "bytes", grown_shard null. Rows
    that repeat, ties, null ids and empty tables are as any other; other
    columns are ignored.
    """
    spark = docs.sparkSession
    blocks = blocks or min(2**14, max(64, 2 * common.partitions(spark)))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = common.cut(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.unhex(F.sha2(text, 256)).alias("digest"),
        )
    )
    items = common.cut(rows.groupBy("digest").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")))
    whole, count = items.agg(F.sum("bytes"), F.sum("n")).first()
    large = (F.col("bytes") * (256 * shards) > F.lit(whole or 0)) | (F.col("n") * (256 * shards) > F.lit(count or 0))
    alone = items.filter(large).orderBy("digest").collect()

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).sort_by([("bytes", "descending"), ("digest", "ascending")])
        parts = difference(t.column("bytes").to_pylist(), shards)
        yield from t.append_column("bundle", pa.array(parts, pa.int32())).to_batches()

    block = F.pmod(F.xxhash64("digest"), F.lit(blocks)).cast("int")
    light = items.filter(~large).select("digest", "bytes", block.alias("block")).groupBy("block").applyInArrow(_grouped(bundle), "digest binary, bytes long, block int, bundle int")
    light = common.cut(light)
    bundles = light.groupBy("block", "bundle").agg(F.sum("bytes").alias("bytes")).orderBy("block", "bundle").collect()
    found = difference([r["bytes"] for r in [*alone, *bundles]], shards)
    places = spark.createDataFrame([(r["block"], r["bundle"], s) for r, s in zip(bundles, found[len(alone) :], strict=True)], "block int, bundle int, shard int")
    placed = light.join(F.broadcast(places), ["block", "bundle"]).select("digest", "shard")
    placed = placed.union(spark.createDataFrame([(bytes(r["digest"]), s) for r, s in zip(alone, found, strict=False)], "digest binary, shard int"))
    dealt = common.cut(common.look_up(rows, placed, ["digest"], "id").select("id", "size", "text_crc32", "shard", common.salt(F.col("id"), 256).alias("part")))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = dealt.groupBy("shard", "part").count().select("shard", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("shard", "part").orderBy("id", "text_crc32")
    return dealt.join(F.broadcast(first), ["shard", "part"]).select(
        F.col("id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("first") + F.row_number().over(within) - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _grouped(f):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)

    return run

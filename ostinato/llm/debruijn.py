"""Repeated passages: token k-mers as edges of a De Bruijn graph, compacted to paths, verified at their source.

A node is a run of k - 1 words, an edge a window of k words: it leads from its
first k - 1 words to its last, and is known by the hashes of these two nodes.

Only edges that may repeat are materialised. The least hash of the short
k-mers in a window (its minimizer) is the same wherever the window occurs, and
there are a few times fewer of them than windows: the minimizers are counted
first, those in more than one document go into a bit field of fixed size, and
only windows whose minimizer is in it become edges. A false hit there costs an
edge and changes nothing.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, exact_dedup

U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _grams(h: np.ndarray, k: int, base: int) -> np.ndarray:
    """A hash of each k consecutive entries."""
    n = len(h) - k + 1
    out = np.zeros(max(n, 0), U)
    for j in range(k if n > 0 else 0):
        out = out * U(base) + h[j : j + n]
    return _mix(out)


def windows(texts: list[bytes | None], k: int, short: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows of k words within one text: text, place, the nodes that it leads from and to, and the minimizer's hash."""
    split = [(t or b"").split() for t in texts]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    digest = xxhash.xxh3_64_digest
    h = np.frombuffer(b"".join([digest(w, seed) for words in split for w in words]), ">u8").astype(U)
    n = len(h) - k + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none.view(U), none.view(U), none.view(U)
    text = np.repeat(np.arange(len(split)), sizes)
    place = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    small = _grams(h, short, 0x9E3779B97F4A7C15)
    least = small[:n]
    for j in range(1, k - short + 1):
        least = np.minimum(least, small[j : j + n])
    own = text[:n] == text[k - 1 :]
    node = _grams(h, k - 1, 0xD6E8FEB86659FD93)
    return text[:n][own], place[:n][own], node[:n][own], node[1:][own], least[own]


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def compact(edges: DataFrame, parts: int) -> DataFrame:
    """edges(l, r, source, source_at), one row an edge -> the same with path_source, path_from (the path's first edge) and path_at.

    Edges e, f are linked if a node has e as its only edge in and f as its only
    edge out. Linked edges that follow each other at one source are a chunk,
    told by one sort; chunks are joined to paths by pointer doubling, in as many
    rounds as the logarithm of a path's chunks. A closed path stays in its
    chunks. The chunks are written before this returns: edges is read no more.
    """
    ends = edges.select("source", "source_at", F.explode(F.array(F.struct(F.col("r").alias("node"), F.lit(True).alias("arrives")), F.struct(F.col("l").alias("node"), F.lit(False).alias("arrives")))).alias("x")).select("source", "source_at", "x.*")
    at = lambda c, arrives: F.max(F.when(F.col("arrives") == arrives, F.col(c)))
    nodes = ends.groupBy("node").agg(
        F.count_if("arrives").alias("ins"), F.count_if(~F.col("arrives")).alias("outs"), at("source", True).alias("before"), at("source_at", True).alias("before_at"), at("source", False).alias("source"), at("source_at", False).alias("source_at")
    )
    links = nodes.filter("ins = 1 and outs = 1 and not (before = source and before_at = source_at)")
    none = F.lit(None).cast("long")
    both = edges.select("source", "source_at", "l", "r", none.alias("before"), none.alias("before_at")).union(links.select("source", "source_at", none, none, "before", "before_at"))
    linked = both.repartition(parts, "source").groupBy("source", "source_at").agg(*[F.max(c).alias(c) for c in ("l", "r", "before", "before_at")])
    along = Window.partitionBy("source").orderBy("source_at")
    goes_on = F.coalesce((F.col("before") == F.col("source")) & (F.col("before_at") == F.col("source_at") - 1), F.lit(False))
    chunked = linked.withColumn("chunk", F.last(F.when(~goes_on, F.col("source_at")), ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    chunked = common.cut(chunked.withColumn("before", F.when(~goes_on, F.col("before"))))
    chunks = chunked.groupBy("source", "chunk").agg(F.max("source_at").alias("last"), F.max("before").alias("before"), F.max(F.when(F.col("before").isNotNull(), F.col("before_at"))).alias("before_at"))
    chunks = common.cut(chunks)
    ahead = chunks.select(F.col("source").alias("to"), F.col("last").alias("to_last"), F.col("chunk").alias("to_chunk"), (F.col("last") - F.col("chunk") + 1).alias("steps"))
    hops = chunks.filter("before is not null").select("source", "chunk", F.col("before").alias("to"), F.col("before_at").alias("to_last")).join(ahead, ["to", "to_last"]).select("source", "chunk", "to", "to_chunk", "steps")
    hops, open_ = common.cut(hops), None
    while True:
        onward = hops.select(F.col("source").alias("to"), F.col("chunk").alias("to_chunk"), F.col("to").alias("next"), F.col("to_chunk").alias("next_chunk"), F.col("steps").alias("more"))
        now = hops.join(onward, ["to", "to_chunk"], "left")
        now = common.cut(now.select("source", "chunk", F.coalesce("next", "to").alias("to"), F.coalesce("next_chunk", "to_chunk").alias("to_chunk"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("next").isNotNull().alias("open")))
        left, before = now.filter("open").count(), open_
        common.discard(hops)
        hops, open_ = now, left
        if not left or left == before:  # what is left runs in circles
            break
    hops = hops.filter("not open").select("source", "chunk", "to", "to_chunk", "steps")
    found = chunked.join(hops, ["source", "chunk"], "left")
    return found.select("l", "r", "source", "source_at", F.coalesce("to", "source").alias("path_source"), F.coalesce("to_chunk", "chunk").alias("path_from"), (F.coalesce("steps", F.lit(0)) + F.col("source_at") - F.col("chunk")).alias("path_at"))


def remove_repeats(docs: DataFrame, k: int = 13, short: int = 6, filter_bits: int = 27, id_col: str = "doc_id", text_col: str = "text", seeds: int = 3) -> DataFrame:
    """Per row of docs: id, n_words, n_removed, kept_sha256, and removed, the spans (start, length) in words.

    A word goes if a window of k words over it also stands in a document with a
    smaller id. Words are cut at ASCII white space and not changed; a null text
    has none. Documents of fewer than k words lose nothing. Texts that agree in
    all words are settled by their smallest id alone: of each other copy with k
    words or more all goes. Rows of one id are one document, even if their texts
    differ; a null id counts as larger than any. Other columns don't count. An
    empty table gives an empty result. Each span is compared word for word with
    what its source holds; should hashes of different windows collide, all is
    done again with another seed, `seeds` times at most. A window of a third of
    all texts is dealt over tasks by Spark's skew join.
    """
    for seed in range(seeds):
        found = _remove_repeats(docs, k, short, filter_bits, id_col, text_col, seed)
        if found.filter("collided").isEmpty():
            return found.drop("collided")
        common.discard(found)
    raise RuntimeError(f"hashes of windows collided with each of {seeds} seeds")


def _remove_repeats(docs: DataFrame, k: int, short: int, filter_bits: int, id_col: str, text_col: str, seed: int) -> DataFrame:
    spark = docs.sparkSession
    parts = common.partitions(spark)
    top = F.lit(2**63 - 1)
    own = docs.select(F.col(id_col).cast("long").alias("own"), F.coalesce(F.col(id_col).cast("long"), top).alias("id"), F.col(text_col).alias("text"))
    kept = exact_dedup.exact_groups(own.select("id", "text"), "id", "text").select("id", F.when(F.col("id") == F.col("keep_id"), F.col("text_sha256")).alias("sha"))
    kept = kept.groupBy("id").agg(F.array_sort(F.collect_set("sha")).alias("shas"))
    joined = own.join(kept, "id").withColumn("first", F.array_position("shas", F.sha2(exact_dedup.normal_text(F.col("text")), 256)))
    # bucketed by id, so that no later join deals the texts out again; the name is in the catalog until this function ends
    table = f"repeats_{uuid.uuid4().hex}"
    place = f"{common.shared_dir(spark)}/{table}"
    with common.swept(spark):
        joined.select("own", "id", F.col("text").cast("binary").alias("text"), "first").write.format("parquet").option("path", place).bucketBy(parts, "id").sortBy("id").saveAsTable(table)
    common.forget_at_exit(spark, place)
    try:
        return _settled(spark.table(table), parts, k, short, filter_bits, id_col, seed)
    finally:
        spark.sql(f"drop table if exists {table}")
        common.delete(spark, place)


def _settled(source: DataFrame, parts: int, k: int, short: int, filter_bits: int, id_col: str, seed: int) -> DataFrame:
    """The result for source(own, id, text, first), and whether a span collided, written."""
    spark = source.sparkSession
    firsts = source.filter("first > 0").select("id", "text", "first")

    def minimizers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, texts in common.by_bytes(b, "text"):
                which, _, _, _, least = windows(texts, k, short, seed)
                new = np.ones(len(least), bool)
                new[1:] = (least[1:] != least[:-1]) | (which[1:] != which[:-1])
                ids = part.column("id").to_numpy()
                yield pa.record_batch([_longs(least[new]), pa.array(ids[which[new]])], ["m", "id"])

    counted = firsts.mapInArrow(common.lean(minimizers), "m long, id long").groupBy("m").agg(F.min("id").alias("a"), F.max("id").alias("b")).filter("a < b")
    counted = common.cut(counted.select("m"))
    bit = F.pmod(F.col("m"), F.lit(2**filter_bits))
    rows = counted.groupBy(F.expr(f"pmod(m, {2**filter_bits}L) div 32768").alias("row")).agg(F.bitmap_construct_agg(bit % 32768).alias("bits")).collect()
    common.discard(counted)
    bits = np.zeros((2 ** max(0, filter_bits - 15), 4096), np.uint8)
    for r in rows:
        bits[r["row"]] = np.frombuffer(r["bits"], np.uint8)
    field = spark.sparkContext.broadcast(bits.reshape(-1))

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = field.value
        for b in batches:
            for part, texts in common.by_bytes(b, "text"):
                which, at, left, right, least = windows(texts, k, short, seed)
                spot = (least & U(2**filter_bits - 1)).astype(np.int64)
                hit = (known[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1 == 1
                which, at = which[hit], at[hit]
                ids, ordinal = part.column("id").to_numpy(), part.column("first").to_numpy()
                yield pa.record_batch([_longs(left[hit]), _longs(right[hit]), pa.array(ids[which]), pa.array((ordinal[which].astype(np.int64) - 1 << 32) + at)], ["l", "r", "id", "at"])

    # at: the place in the text, and above 32 bits which of the id's texts it is
    occurs = common.cut(firsts.mapInArrow(common.lean(edges), "l long, r long, id long, at long"))
    repeated = occurs.groupBy("l", "r").agg(F.min("id").alias("source"), F.min_by("at", "id").alias("source_at"), F.max("id").alias("last")).filter(F.col("source") < F.col("last")).drop("last")
    repeated = common.cut(repeated)
    paths = compact(repeated, parts)
    common.discard(repeated)  # compact has written what it needs
    met = occurs.join(paths, ["l", "r"]).filter("source < id").select("id", "at", "source", "source_at", "path_source", "path_from", "path_at")
    met = common.cut(met)
    common.discard(occurs)
    # spans: where a document walks along a path, cut where the path's source changes
    within = Window.partitionBy("id").orderBy("at")
    same = lambda c: F.col(c) == F.lag(c).over(within)
    shift = F.col("at") - F.col("source_at")
    goes_on = (F.col("at") - F.lag("at").over(within) == 1) & same("path_source") & same("path_from") & (F.col("path_at") - F.lag("path_at").over(within) == 1) & same("source") & (shift == F.lag(shift).over(within))
    runs = met.withColumn("run", F.when(F.coalesce(goes_on, F.lit(False)), F.lit(None)).otherwise(F.col("at"))).withColumn("run", F.last("run", ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, 0)))
    spans = runs.groupBy("id", "run").agg(F.first("source").alias("source"), F.min("source_at").alias("source_at"), (F.max("at") - F.min("at") + k).alias("length"))
    spans = common.cut(spans.select("id", F.col("run").alias("at"), "source", "source_at", "length"))
    common.discard(met)
    wanted = spans.select("source", "source_at", "length").distinct().groupBy("source").agg(F.collect_list(F.struct("source_at", "length")).alias("wanted"))

    def recite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What the sources hold at the places that are claimed to be repeated."""
        for b in batches:
            for part, texts in common.by_bytes(b, "text"):
                found = []
                for doc, text, ordinal, claims in zip(part.column("source").to_pylist(), texts, part.column("first").to_pylist(), part.column("wanted"), strict=True):
                    words = text.split()
                    found += [(doc, x["source_at"], x["length"], _digest(words, x["source_at"] & 0xFFFFFFFF, x["length"])) for x in claims.as_py() if x["source_at"] >> 32 == ordinal - 1]
                cols = list(zip(*found, strict=True)) or [()] * 4
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["source", "source_at", "length", "said"])

    said = firsts.withColumnRenamed("id", "source").join(wanted, "source").select("source", "text", "first", "wanted").mapInArrow(common.lean(recite), "source long, source_at long, length long, said binary").dropDuplicates(["source", "source_at", "length"])
    claims = common.look_up(spans, said, ["source", "source_at", "length"], "id")
    claims = claims.groupBy("id").agg(F.collect_list(F.struct("at", "length", "said")).alias("claims"))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, texts in common.by_bytes(b, "text"):
                found = []
                for doc, text, ordinal, claimed in zip(part.column("own").to_pylist(), texts, part.column("first").to_pylist(), part.column("claims"), strict=True):
                    words, collided = (text or b"").split(), False
                    gone = np.zeros(len(words) + 1, np.int64)
                    if not ordinal and len(words) >= k:
                        gone[0], gone[-1] = 1, -1
                    for x in claimed.as_py() or ():
                        if ordinal and x["at"] >> 32 == ordinal - 1:
                            at = x["at"] & 0xFFFFFFFF
                            collided |= _digest(words, at, x["length"]) != x["said"]
                            gone[at] += 1
                            gone[at + x["length"]] -= 1
                    out = np.cumsum(gone)[:-1] > 0
                    turn = np.nonzero(np.diff(np.concatenate([[0], out.astype(np.int8), [0]])))[0].tolist()
                    rest = words if not turn else [w for w, x in zip(words, out.tolist(), strict=True) if not x]
                    found.append((doc, len(words), int(out.sum()), hashlib.sha256(b" ".join(rest)).hexdigest(), [{"start": a, "length": z - a} for a, z in zip(turn[::2], turn[1::2], strict=True)], collided))
                cols = list(zip(*found, strict=True)) or [()] * 6
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])), pa.bool_())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [id_col, "n_words", "n_removed", "kept_sha256", "removed", "collided"])

    settled = source.join(claims, "id", "left").select("own", "text", "first", "claims").mapInArrow(common.lean(settle), f"`{id_col}` long, n_words long, n_removed long, kept_sha256 string, removed array<struct<start:long,length:long>>, collided boolean")
    made = common.cut(settled)
    common.discard(spans)
    return made


def _digest(words: list[bytes], at: int, length: int) -> bytes:
    return hashlib.blake2b(b" ".join(words[at : at + length]), digest_size=16).digest()

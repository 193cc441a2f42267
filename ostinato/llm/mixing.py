"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common


def targets(sizes: list[int], weights: list[float], share: float = 1.5, most: float = 2.0) -> list[float]:
    """Words wanted of each source: share * sum(sizes) by weight, none above most * its size, the excess reshared by weight."""
    left, open_, found = share * sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        over = [i for i in sorted(open_) if weights[i] * unit > most * sizes[i]]
        if not over:
            for i in open_:
                found[i] = weights[i] * unit
            break
        for i in over:
            found[i] = float(most * sizes[i])
            left -= found[i]
            open_.discard(i)
    return found


def apportion(claims: list[float], seats: int, caps: list[int]) -> list[int]:
    """Seats by highest quotients claim / (2 * seats so far + 1), none above its cap; ties go to the first.

    Starts a little under each claim's exact share, so that the work doesn't
    grow with the seats, and then moves seats until no quotient that was passed
    over is above one that was served.
    """
    n, seats, total = len(claims), min(seats, sum(caps)), sum(claims)
    if not total:
        return [0] * n
    got = [min(caps[i], max(0, int(claims[i] / total * seats) - 2)) for i in range(n)]
    up = [(-claims[i] / (2 * got[i] + 1), i) for i in range(n) if got[i] < caps[i]]
    heapq.heapify(up)
    for _ in range(seats - sum(got)):
        if not up:
            break
        _, i = heapq.heappop(up)
        got[i] += 1
        if got[i] < caps[i]:
            heapq.heappush(up, (-claims[i] / (2 * got[i] + 1), i))
    while True:
        best = max((i for i in range(n) if got[i] < caps[i]), key=lambda i: (claims[i] / (2 * got[i] + 1), -i), default=None)
        worst = min((i for i in range(n) if got[i]), key=lambda i: (claims[i] / (2 * got[i] - 1), -i), default=None)
        if best is None or worst is None or claims[best] / (2 * got[best] + 1) <= claims[worst] / (2 * got[worst] - 1):
            return got
        got[best] += 1
        got[worst] -= 1


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, block: int = 8, seed: int = 42, words_a_shard: int = 2**20, most_shards: int = 2**16, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: bool = False) -> DataFrame:
    """Per row of docs: id, size, source_size, target, taken; with keep, the columns of docs before these, named __size etc.

    size counts the words of the text, null as none. Sources, ordered by code
    point with null last, take the weights in turn. A source's target in blocks
    of `block` words is apportioned over all sources, then over the source's
    shards (by hash of the id, so many that a source of any size is dealt out);
    within a shard the documents stand in a seeded order and the first blocks
    are taken, up to `most` times round. The order depends on seed and ids
    alone: reruns agree. A document without words takes none. Rows of one id
    are taken one by one. Sources are listed on the driver, one row each; the
    shards are at most most_shards more than there are sources.
    """
    spark = docs.sparkSession
    own = docs.select("*") if keep else docs.select(id_col, source_col, text_col)
    sized = own.withColumn("__size", F.coalesce(F.regexp_count(text_col, F.lit(common.WORD)), F.lit(0)).cast("long"))
    if not keep:
        sized = common.cut(sized.select(id_col, source_col, "__size"))
    found = sized.groupBy(source_col).agg(F.sum("__size")).collect()
    found.sort(key=lambda r: (r[0] is None, r[0] or ""))
    sizes = [r[1] for r in found]
    wanted = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share, most) if sum(sizes) else [0.0] * len(sizes)
    quotas = apportion(wanted, round(sum(wanted) / block), [most * -(-s // block) for s in sizes])
    per = max(words_a_shard, -(-sum(sizes) // most_shards))
    schema = f"__source {docs.schema[source_col].dataType.simpleString()}, __at int, __shards int, __source_size long, __target double"
    about = F.broadcast(spark.createDataFrame([(r[0], i, max(1, sizes[i] // per), sizes[i], wanted[i]) for i, r in enumerate(found)], schema))
    placed = sized.join(about, F.col(source_col).eqNullSafe(F.col("__source"))).withColumn("__shard", F.pmod(F.xxhash64(F.lit("shard"), F.lit(seed), id_col), "__shards"))
    cells: dict[int, list[tuple[int, int]]] = {}
    for at, shard, words in placed.groupBy("__at", "__shard").agg(F.sum("__size")).orderBy("__at", "__shard").collect():
        cells.setdefault(at, []).append((shard, words))
    dealt = []
    for at, own_cells in cells.items():
        got = apportion([w for _, w in own_cells], quotas[at], [most * -(-w // block) for _, w in own_cells])
        dealt += [(at, shard, words, q) for (shard, words), q in zip(own_cells, got, strict=True)]
    quota = F.broadcast(spark.createDataFrame(dealt, "__at int, __shard long, __words long, __quota long"))
    order = Window.partitionBy("__at", "__shard").orderBy(F.xxhash64(F.lit("order"), F.lit(seed), id_col), id_col, "__size")
    rounds = F.col("__blocks_a_round")
    taken = (
        placed.join(quota, ["__at", "__shard"])
        .withColumn("__blocks_a_round", F.ceil(F.col("__words") / block))
        .withColumn("__end", F.sum("__size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        # all whole rounds, and of the last one the blocks up to this many words
        .withColumn("__whole", F.when(rounds > 0, F.floor(F.col("__quota") / rounds)).otherwise(0))
        .withColumn("__rest", (F.col("__quota") - F.col("__whole") * rounds) * block)
        .withColumn("__taken", F.col("__whole") * F.col("__size") + F.greatest(F.lit(0), F.least("__end", "__rest") - (F.col("__end") - F.col("__size"))))
    )
    names = {"size": "__size", "source_size": "__source_size", "target": "__target", "taken": "__taken"}
    if keep:
        return taken.select(*docs.columns, *names.values())
    return taken.select(id_col, *[F.col(c).cast("double" if n == "target" else "long").alias(n) for n, c in names.items()])


def mixed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix itself, in the columns of docs, whatever their names: a row as often as it is taken whole, and one with its first words for the rest.

    A document of which nothing is taken, as one without words, has no row. In
    a row of first words they are joined by one space, and n_chars, if there is
    such a column, is counted anew.
    """
    return common.carrying(docs, [id_col, text_col, source_col, "n_chars"], lambda own: _mixed_texts(own, id_col=id_col, text_col=text_col, source_col=source_col, **how))


def _mixed_texts(docs: DataFrame, id_col: str, text_col: str, **how) -> DataFrame:
    rows = mix(docs, id_col=id_col, text_col=text_col, keep=True, **how).filter("__taken > 0")
    rest = F.col("__taken") % F.col("__size")
    copies = F.flatten(F.array(F.array_repeat(F.lit(-1).cast("long"), (F.col("__taken") / F.col("__size")).cast("int")), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>"))))
    rows = rows.withColumn("__words", F.explode(copies))
    text = F.when(F.col("__words") < 0, F.col(text_col)).otherwise(F.array_join(F.slice(F.regexp_extract_all(text_col, F.lit(common.WORD), F.lit(0)), F.lit(1), F.col("__words").cast("int")), " "))
    rows = rows.withColumn(text_col, text)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("__words") < 0, F.col("n_chars")).otherwise(F.length(text_col)).cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)

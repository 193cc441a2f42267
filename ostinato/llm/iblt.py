"""Document fingerprints as invertible Bloom lookup sketches of paragraphs (DataFrame operations only)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Subtables of a sketch; a digest has one cell in each.
TABLES = 3


#: Where a paragraph may end. One rule for texts of any length: after a word's beginning, a rare sequence of three letters or digits, or one of some letters of other scripts.
PARAGRAPH = r"(?s).{64,384}?(?:(?<=[ \n][a-d][a-z])|(?<=[g-m][v-z0-4][a-m5-7 ])|(?<=[\u0430\u0438\u043d\u05d0\u05ea\u0627\u0646\u0915\u0930\u3044\u306e\u30f3\u4e00-\u4e7f\u5a00-\u5a7f\u6600-\u667f\u7200-\u727f\u7e00-\u7e7f\u8a00-\u8a7f\uac00-\uac7f\ub800-\ub87f\uc400-\uc47f])|$)|.{1,384}"


def paragraphs(text: Column) -> Column:
    """Digests (64 bits, distinct) of the text's paragraphs, whose ends its content tells: 64 to 384 code points, about 100 in prose.

    No rule depends on the text's length, and where texts agree for longer than
    a paragraph, their paragraphs agree again. Line feeds are characters like
    others.
    """
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)), lambda p: F.xxhash64(p)))


def cell(digest: Column, table: int, width: Column) -> Column:
    """Where a digest stands in a sketch of `width` cells a subtable."""
    return (F.pmod(F.xxhash64(digest, F.lit(table)), width) + table * width).cast("int")


def part_of(digest: Column) -> Column:
    """Which of `parts` small sketches holds a digest."""
    return F.pmod(F.xxhash64(digest, F.lit(-2)), F.col("parts")).cast("int")


def check(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit(-1))


def parted(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """pairs(keys, parts, width, a, b), digests in a and b: a row for each key and part that has any, with the part's digests.

    A sketch is made of `parts` small ones; a digest belongs to one of them, by
    its hash, so that neither making nor peeling one handles a large array. The
    rows are grouped as they lie: no exchange if pairs is already dealt by some
    of the keys.
    """

    def listed(name: str, left: bool) -> Column:
        return F.transform(name, lambda x: F.struct(x.alias("x"), F.lit(left).alias("left"), part_of(x).alias("part")))

    items = pairs.select(*keys, "width", F.explode(F.concat(listed("a", True), listed("b", False))).alias("s")).select(*keys, "width", "s.*")
    return items.groupBy(*keys, "width", "part").agg(F.collect_list(F.when(F.col("left"), F.col("x"))).alias("a"), F.collect_list(F.when(~F.col("left"), F.col("x"))).alias("b"))


def sketch(digests: Column, width: Column) -> Column:
    """The sketch of an array of digests, of width * TABLES cells, each a struct (x, c, n)."""
    placed = F.transform(digests, lambda x: F.struct(x.alias("x"), check(x).alias("c"), *[cell(x, t, width).alias(f"at{t}") for t in range(TABLES)]))

    def cells(held: Column) -> Column:
        def one(t: int):
            def sum_up(i: Column) -> Column:
                zero = F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("c"), F.lit(0).cast("long").alias("n"))
                return F.aggregate(F.filter(held, lambda p: p[f"at{t}"] == i), zero, lambda s, p: F.struct(s["x"].bitwiseXOR(p["x"]).alias("x"), s["c"].bitwiseXOR(p["c"]).alias("c"), (s["n"] + 1).alias("n")))

            return F.transform(F.sequence(width * t, width * (t + 1) - 1), sum_up)

        return F.concat(*[one(t) for t in range(TABLES)])

    return F.element_at(F.transform(F.array(placed), cells), 1)


def subtract(a: Column, b: Column) -> Column:
    """The difference of two sketches of one size."""
    return F.zip_with(a, b, lambda s, t: F.struct(s["x"].bitwiseXOR(t["x"]).alias("x"), s["c"].bitwiseXOR(t["c"]).alias("c"), (s["n"] - t["n"]).alias("n")))


def peel(difference: str, width: str, rounds: int = 25) -> Column:
    """struct(cells, idle, only_a, only_b): the digests that one sketch alone holds, by peeling pure cells off their difference.

    A cell is pure if it counts one and its check is that of its digest. In each
    round the digests of all pure cells, each once, leave all their cells, and
    that may make others pure. What is left in cells tells whether all were
    recovered.
    """
    longs = "array<bigint>"

    def pure(cells: Column, n: int) -> Column:
        own = F.filter(cells, lambda c: (c["n"] == n) & (c["c"] == check(c["x"])))
        return F.transform(F.array_distinct(F.transform(own, lambda c: c["x"])), lambda x: F.struct(x.alias("x"), check(x).alias("c"), F.lit(n).cast("long").alias("n"), *[cell(x, t, F.col(width)).alias(f"at{t}") for t in range(TABLES)]))

    def without(cells: Column, found: Column) -> Column:
        def of(t: int) -> Column:
            def one(c: Column, j: Column) -> Column:
                at = j + t * F.col(width) if t else j
                gone = F.filter(found, lambda p: p[f"at{t}"] == at)
                return F.aggregate(gone, c, lambda s, p: F.struct(s["x"].bitwiseXOR(p["x"]).alias("x"), s["c"].bitwiseXOR(p["c"]).alias("c"), (s["n"] - p["n"]).alias("n")))

            return F.transform(F.slice(cells, t * F.col(width) + 1, F.col(width)), one)

        return F.concat(*[of(t) for t in range(TABLES)])

    def step(s: Column, _: Column) -> Column:
        def after(found: Column) -> Column:
            return F.struct(
                F.when(F.size(found) == 0, s["cells"]).otherwise(without(s["cells"], found)).alias("cells"),
                (F.size(found) == 0).alias("idle"),
                F.concat(s["only_a"], F.transform(F.filter(found, lambda p: p["n"] == 1), lambda p: p["x"])).alias("only_a"),
                F.concat(s["only_b"], F.transform(F.filter(found, lambda p: p["n"] == -1), lambda p: p["x"])).alias("only_b"),
            )

        return F.when(s["idle"], s).otherwise(F.element_at(F.transform(F.array(F.concat(pure(s["cells"], 1), pure(s["cells"], -1))), after), 1))

    start = F.struct(F.col(difference).alias("cells"), F.lit(False).alias("idle"), F.array().cast(longs).alias("only_a"), F.array().cast(longs).alias("only_b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step)


def differ(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """pairs(keys, parts, width, a, b) -> keys, width, part, ok, how many digests one side alone has, and these digests."""
    found = parted(pairs, keys).select(*keys, "width", "part", subtract(sketch(F.col("a"), F.col("width")), sketch(F.col("b"), F.col("width"))).alias("difference"))
    found = found.withColumn("peeled", peel("difference", "width"))
    return found.select(*keys, "width", "part", _whole("peeled.cells").alias("ok"), F.size("peeled.only_a").alias("only_a"), F.size("peeled.only_b").alias("only_b"), F.col("peeled.only_a").alias("digests_a"), F.col("peeled.only_b").alias("digests_b"))


def _whole(cells: str) -> Column:
    """Whether nothing is left in the cells: all digests were recovered."""
    return F.forall(cells, lambda c: (c["n"] == 0) & (c["x"] == 0) & (c["c"] == 0))


def _code(cells: Column) -> Column:
    """A sketch as text: for each cell 16 hex digits of its xor and 4 of its number."""
    return F.lower(F.array_join(F.transform(cells, lambda s: F.concat(F.lpad(F.hex(s["x"]), 16, "0"), F.lpad(F.hex(s["n"] % 65536), 4, "0"))), ""))


def with_next(docs: DataFrame, blocks: int, width: int, id_col: str, text_col: str) -> DataFrame:
    """block, pos (unique together), id, text, a and s (its paragraphs and their sketch), next_text, next and next_s (of the following document).

    Documents follow by id, null first, equal ids by their texts' hash; the last
    is followed by the first. Blocks of ids are cut at approximate percentiles;
    the first document of a block is also sent to the block before, so that no
    task needs more than a block.
    """
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    cuts = own.agg(F.percentile_approx("id", [i / blocks for i in range(blocks)], max(10_000, 4 * blocks))).first()[0]
    cuts = sorted(set(cuts or [0]))
    # the block of an id in two steps, each over the square root of the blocks
    step = math.isqrt(len(cuts) - 1) + 1
    longs = lambda x: F.expr("array(" + ", ".join(f"{c}L" for c in x) + ")")
    within = lambda a: F.greatest(F.size(F.filter(a, lambda c: c <= F.col("id"))) - 1, F.lit(0))
    own = own.withColumn("part", within(longs(cuts[::step])))
    near = F.slice(longs(cuts), F.col("part") * step + 1, F.lit(step))
    block = F.col("part") * step + within(near)
    opens = F.col("id").isNull() | F.array_contains(near, F.col("id"))
    here = F.struct(block.alias("block"), F.lit(0).alias("sent"))
    before = F.struct(F.pmod(block - 1, F.lit(len(cuts))).alias("block"), F.lit(1).alias("sent"))
    rows = own.withColumn("a", paragraphs(F.col("text"))).withColumn("s", sketch(F.col("a"), F.lit(width))).withColumn("to", F.explode(F.when(opens, F.array(here, before)).otherwise(F.array(here)))).select("to.block", "to.sent", "id", "text", "a", "s", F.xxhash64("text").alias("h"))
    order = Window.partitionBy("block").orderBy("sent", F.asc_nulls_first("id"), "h")
    lead = [F.lead(c).over(order).alias(n) for c, n in (("text", "next_text"), ("a", "next"), ("s", "next_s"))]
    told = rows.select("block", "sent", "id", "text", "a", "s", F.row_number().over(order).alias("pos"), *lead)
    return told.filter("sent = 0").drop("sent")


def near_next_and_edited(docs: DataFrame, base_width: int = 8, width: int = 8, blocks: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and how many digests differ.

    The edited text has its last quarter of code points (rounded down) replaced
    by the first as many, or all, of the following document. Fingerprints are
    sketches of base_width * 3 cells of all of the texts' paragraph digests; equal
    texts have equal ones. Likeness is twice the shared paragraphs by the sum of
    both numbers, 1 for two empty texts; the shared ones are what the difference
    of two sketches, peeled, leaves. The fingerprints are subtracted first. Of a
    pair whose difference can't be peeled, larger sketches are made, of as many
    small ones as the digests of both need, and those of them that still can't
    be peeled twice as large each time until all digests are recovered. A text of few paragraphs has few steps of likeness. Null is the
    empty text. Rows that repeat follow each other; a single row follows
    itself. Rows of one id, or of none, are dealt with in one task. Other
    columns don't count; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    parts = common.partitions(spark)
    blocks = blocks or min(2**14, max(64, 2 * parts))
    n = F.length("text")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - F.floor(n / 4).cast("int")), F.substring(F.col("next_text"), F.lit(1), F.floor(n / 4).cast("int")))
    told = with_next(docs, blocks, base_width, id_col, text_col).withColumn("edited", edited)
    source = told.select("block", "pos", "id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "a", "s", paragraphs(F.col("edited")).alias("e"), F.col("next").alias("n"), "next_s")
    source = common.cut(source.withColumn("es", sketch(F.col("e"), F.lit(base_width))))
    kinds = {"edited": ("e", "es"), "next": ("n", "next_s")}
    tried = source.withColumn("width", F.lit(base_width))
    for kind, (_, cells) in kinds.items():
        tried = tried.withColumn("difference", subtract(F.col("s"), F.col(cells))).withColumn("peeled", peel("difference", "width", 8))
        tried = tried.withColumn(kind, F.when(_whole("peeled.cells"), F.struct(F.size("peeled.only_a").cast("long").alias("a"), F.size("peeled.only_b").cast("long").alias("b")))).drop("difference", "peeled")
    done = common.cut(
        tried.select(
            "block", "pos", "id", "n_chars", "edited_sha256", _code(F.col("s")).alias("fingerprint"), _code(F.col("es")).alias("edited_fingerprint"), *kinds, F.size("a").alias("sa"), F.size("e").alias("se"), F.size("n").alias("sn"),
            F.when(F.col("edited").isNull() | F.col("next").isNull(), F.col("a")).alias("a"), *[F.when(F.col(kind).isNull(), F.col(b)).alias(b) for kind, (b, _) in kinds.items()],
        )
    )
    common.discard(source)
    # those whose sketch was too small, ever larger
    lacking = F.filter(F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(b).alias("b")) for kind, (b, _) in kinds.items()]), lambda x: x["b"].isNotNull())
    open_ = done.filter(F.col("a").isNotNull()).select("block", "pos", "a", F.explode(lacking).alias("p")).select("block", "pos", "p.kind", "a", "p.b")
    open_ = open_.repartition(4 * parts, "block", "pos")  # small enough that a task's cells stay in hash tables
    open_ = open_.withColumn("parts", F.ceil((F.size("a") + F.size("b") + 1) / width).cast("int"))
    keys, found = ["block", "pos", "kind"], None
    for doubled in range(12):
        result = common.cut(differ(open_.withColumn("width", F.lit(width << doubled)), keys).select(*keys, "part", "ok", "only_a", "only_b"))
        found = result.filter("ok") if found is None else found.union(result.filter("ok"))
        failed = result.filter("not ok").groupBy(*keys).agg(F.collect_set("part").alias("again"))
        if failed.isEmpty():
            break
        again = lambda digests: F.filter(digests, lambda x: F.array_contains("again", part_of(x)))
        open_ = open_.join(failed, keys).withColumn("a", again("a")).withColumn("b", again("b")).drop("again")
    else:
        raise RuntimeError("sketches of 2048 times the size could not be peeled")
    gone = lambda kind: F.struct(F.sum(F.when(F.col("kind") == kind, F.col("only_a"))).alias("a"), F.sum(F.when(F.col("kind") == kind, F.col("only_b"))).alias("b"))
    late = found.groupBy("block", "pos").agg(*[gone(kind).alias(f"late_{kind}") for kind in kinds])
    done = done.join(late, ["block", "pos"], "left")
    for kind in kinds:
        done = done.withColumn(kind, F.coalesce(kind, f"late_{kind}"))

    def likeness(x: str, size: str) -> Column:
        whole = F.col("sa") + F.col(size)
        return F.when(whole == 0, F.lit(1.0)).otherwise((whole - F.col(x)["a"] - F.col(x)["b"]) / whole)

    return done.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness("edited", "se").alias("near_edited"), likeness("next", "sn").alias("near_next"),
        (F.col("edited")["a"] + F.col("edited")["b"]).cast("long").alias("edited_difference"), (F.col("next")["a"] + F.col("next")["b"]).cast("long").alias("next_difference"),
    )

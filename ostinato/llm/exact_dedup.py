"""Exact duplicates by merging sorted runs of digests in binomial rounds (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common


def normal_text(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), common.SPACE, " ")


def merge_runs(runs: DataFrame, slots: int, fan_in: int) -> DataFrame:
    """The tree: runs(slot, key, digest, least, rows), one run a slot, merged until slot = key mod slots.

    In round r the fan_in slots that differ only in digit r exchange: each run
    is cut by digit r of its keys, every partner gets the slice of its own
    digit, and merges the fan_in sorted slices it then holds, keeping the least
    identifier and the sum of rows for equal digests. The 64-bit key orders the
    runs; two entries are one only if their 256-bit digests agree, too. After
    log_fan_in(slots) rounds a digest is in one slot. A digest has at most one
    entry a slot, so a text that a third of all rows share is as cheap as any.
    The least identifier is held in a struct (null last): Spark then aggregates
    in the order of the run instead of in hash tables, so each round is a sort
    of the runs that came and one pass over them, and its result a sorted run.
    """
    runs = runs.withColumn("least", F.struct(F.col("least").isNull().alias("none"), F.col("least").alias("id")))
    width = 1
    while width < slots:
        of_slot = F.floor(F.col("slot") / width) % fan_in
        of_key = F.floor(F.pmod("key", F.lit(slots)) / width) % fan_in
        runs = (
            runs.withColumn("slot", (F.col("slot") + (of_key - of_slot) * width).cast("long"))
            .repartition(slots, "slot")
            .groupBy("slot", "key", "digest")
            .agg(F.min("least").alias("least"), F.sum("rows").alias("rows"))
        )
        width *= fan_in
    return runs.withColumn("least", F.col("least.id"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 8) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are after each run of ASCII white space became one
    space; null is the empty text, so null and "" are one group, " " another.
    The row of the smallest id stays. Rows that agree in id and text: one of
    them stays, group_size counts all. A null id never is the smallest unless
    all ids of the group are null. Other columns are ignored, whatever their
    names; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    slots = fan_in
    while slots < max(64, common.partitions(spark)):
        slots *= fan_in
    rows = common.cut(
        docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(normal_text(F.col(text_col)), 256)).alias("digest"))
        .withColumn("slot", F.pmod(F.xxhash64("id"), F.lit(slots)))
        .withColumn("key", F.xxhash64("digest"))
    )
    leaves = rows.groupBy("slot", "key", "digest").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("rows"))
    merged = merge_runs(leaves, slots, fan_in).select("digest", F.col("least").alias("keep_id"), F.col("rows").alias("group_size"))
    # back down: a slot's run meets the root once a digest, then its own rows
    told = rows.select("slot", "digest").distinct().join(merged, "digest")
    same = Window.partitionBy("slot", "digest", "id").orderBy("id")
    return rows.join(told, ["slot", "digest"]).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.row_number().over(same) == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_groups doesn't keep, with the columns they had, whatever their names."""
    return common.carrying(docs, [id_col, text_col], lambda own: _drop_copies(own, id_col, text_col))


def _drop_copies(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    kept = exact_groups(docs, id_col, text_col).filter("kept").select(F.col(id_col).alias("__id"), F.col("text_sha256").alias("__sha"))
    own = docs.withColumn("__sha", F.sha2(normal_text(F.col(text_col)), 256))
    same = Window.partitionBy("__id", "__sha").orderBy("__id")
    met = own.join(kept.withColumnRenamed("__sha", "__kept_sha"), own[id_col].eqNullSafe(F.col("__id")) & (F.col("__sha") == F.col("__kept_sha")))
    return met.withColumn("__n", F.row_number().over(same)).filter("__n = 1").select(*[docs[c] for c in docs.columns])

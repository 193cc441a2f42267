"""Entries with a start and a duration, in groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlaps(df: DataFrame, group: str, key: str, slot: int = 60_000) -> DataFrame:
    """(group, a, b) of different entries that overlap, both ways.

    Entries have a level by their duration, whose slots are at least as long as
    they are: each touches two slots at most, however long it is. An entry meets
    those of its own level or a longer one where it starts or ends, so that a
    group's entries far from each other are never compared; a pair counts in
    the later start's slot only, at the longer one's level. An entry without
    duration touches no other's inside unless it lies within it.
    """
    end = F.greatest(F.col("start") + F.col("duration"), F.col("start"))
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest((end - F.col("start")) / slot, F.lit(1.0))))).cast("int")
    spread = df.filter(F.col("start").isNotNull() & F.col("duration").isNotNull()).select(group, F.col(key).alias("a"), F.col("start").alias("s"), (F.col("start") + F.col("duration")).alias("e"), level.alias("level"))

    def touching(rows: DataFrame, at: str) -> DataFrame:
        length = F.lit(float(slot)) * F.pow(F.lit(2.0), F.col(at))
        return rows.withColumn("slot", F.explode(F.sequence(F.floor(F.col("s") / length), F.floor(F.greatest("e", "s") / length))))

    own = touching(spread, "level")
    # the levels that a group has, of which there are as many as doublings of its longest entry
    levels = spread.select(F.col(group).alias("of"), F.col("level").alias("at")).distinct()
    left = touching(spread.join(levels, (F.col(group) == F.col("of")) & (F.col("level") <= F.col("at"))).drop("of"), "at")
    right = own.select(F.col(group).alias("of"), F.col("level").alias("at"), "slot", F.col("a").alias("b"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    met = left.join(right.withColumnRenamed("of", group), [group, "at", "slot"]).filter((F.col("a") != F.col("b")) & (F.col("s") < F.col("e2")) & (F.col("e") > F.col("s2")))
    met = met.filter(F.col("slot") == F.floor(F.greatest("s", "s2") / (F.lit(float(slot)) * F.pow(F.lit(2.0), F.col("at")))))
    # a pair of one level meets both ways, one of two levels as the shorter and the longer
    ways = F.explode(F.when(F.col("level") == F.col("at"), F.array(F.struct("a", "b"))).otherwise(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
    return met.select(group, ways.alias("p")).select(group, "p.a", "p.b")


def _order(group: str, key: str):
    return Window.partitionBy(group).orderBy("start", key)


def flags(df: DataFrame, group: str, key: str) -> DataFrame:
    """flag: overlap, else gap-prev if time is free before, else gap-next if it is free behind, else empty.

    Whether an entry overlaps is told by the furthest end before it and the next
    start: no pairs are made.
    """
    w, at = _order(group, key), Window.partitionBy(group).orderBy("start")
    end = F.col("start") + F.col("duration")
    over = F.max(end).over(at.rangeBetween(Window.unboundedPreceding, -1)) > F.col("start")
    into = F.min("start").over(at.rangeBetween(1, Window.unboundedFollowing)) < end
    # of those that start at one time only such with a duration overlap
    beside = (F.col("duration") > 0) & (F.count_if(F.col("duration") > 0).over(Window.partitionBy(group, "start")) > 1)
    hit = F.coalesce(over, F.lit(False)) | F.coalesce(into, F.lit(False)) | beside
    return df.withColumn("flag", F.when(hit, "overlap").when(F.col("start") > F.lag(end).over(w), "gap-prev").when(F.lead("start").over(w) > end, "gap-next").otherwise(""))


def durations(df: DataFrame, group: str, key: str) -> DataFrame:
    """Each duration is the gap to the next start; the last has 0."""
    return df.withColumn("duration", F.coalesce(F.lead("start").over(_order(group, key)) - F.col("start"), F.lit(0).cast("long")))


def runs(df: DataFrame, group: str, at: str, good: Column) -> DataFrame:
    """(group, first, n) of consecutive places where the condition holds."""
    held = df.filter(good).withColumn("run", F.col(at) - F.row_number().over(Window.partitionBy(group).orderBy(at)))
    return held.groupBy(group, "run").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("n")).drop("run")


def snap(df: DataFrame, group: str, key: str, within: int) -> DataFrame:
    """snapped: the end before, if it is close enough to the start."""
    before = F.lag(F.col("start") + F.col("duration")).over(_order(group, key))
    return df.withColumn("snapped", F.when(F.abs(F.col("start") - before) <= within, before).otherwise(F.col("start")))


def insert_places(df: DataFrame, group: str, key: str) -> DataFrame:
    """place: where an entry put in behind this one begins: its end, a second before the next at the latest, a second after its start at least."""
    end, after = F.col("start") + F.col("duration"), F.lead("start").over(_order(group, key))
    return df.withColumn("place", F.greatest(F.when(after.isNull(), end).otherwise(F.least(end, after - 1000)), F.col("start") + 1000))

"""Export to another library: matching files by name, choosing among several, linked playlists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import steps


def by_name(own: DataFrame, other: DataFrame, name: str = "filename") -> DataFrame:
    """Inner join on names in canonical composition."""
    return own.withColumn("__n", T.nfc(name)).join(other.withColumn("__n", T.nfc(name)).drop(name), "__n").drop("__n")


def resolve(own: DataFrame, other: DataFrame, name: str, key: str, path: str) -> DataFrame:
    """Per row of own one row of other of the same name: that whose path has the month folder of the own path, else the largest key."""
    met = own.join(other, name).withColumn("__month", T.month_folder(F.col("filepath"))).withColumn("__fits", F.coalesce(F.col(path).contains(F.col("__month")), F.lit(False)))
    order = Window.partitionBy(name, "filepath").orderBy(F.desc("__fits"), F.desc(key))
    return met.withColumn("__r", F.row_number().over(order)).filter("__r = 1").drop("__month", "__fits", "__r")


def linked(entries: DataFrame, first_id: int = 1) -> DataFrame:
    """(list_id, id, track_id, next_id) of (list_id, track_id, position): ids in writing order, last entry first; 0 ends a list."""
    back = Window.partitionBy("list_id").orderBy(F.desc("position"))
    lists = entries.groupBy("list_id").agg(F.count(F.lit(1)).alias("n"))
    before = steps.running_totals(lists, ["list_id"], F.col("n"), "before", entries.count()).select("list_id", "before")
    placed = entries.join(before, "list_id").withColumn("id", F.lit(first_id) + F.col("before") + F.row_number().over(back) - 1)
    return placed.withColumn("next_id", F.coalesce(F.lag("id").over(back), F.lit(0).cast("long"))).select("list_id", "id", "track_id", "next_id", "position")


def verify(links: DataFrame) -> DataFrame:
    """Per list: entries, tails (must be one) and dangling links (must be none). Ids are unique; they meet within their list, without a join."""
    side = lambda c, own: F.struct(F.col(c).cast("long").alias("x"), F.lit(own).alias("own"), F.lit(1 - own).alias("asked"))
    both = F.explode(F.array(side("id", 1), side("next_id", 0)))
    met = links.select("list_id", both.alias("e")).groupBy("list_id", "e.x").agg(F.sum("e.own").alias("own"), F.sum("e.asked").alias("asked"))
    count = lambda of, which: F.sum(F.when(which, F.col(of)).otherwise(0))
    return met.groupBy("list_id").agg(F.sum("own").alias("entries"), count("asked", F.col("x") == 0).alias("tails"), count("asked", (F.col("x") != 0) & (F.col("own") == 0)).alias("dangling"))

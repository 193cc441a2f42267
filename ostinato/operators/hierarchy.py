"""Trees of paths and linked lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import steps


def parent(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def prefixes(folder: Column) -> Column:
    """The folder and all folders above it, without the root."""
    parts = F.filter(F.split(folder, "/"), lambda p: p != "")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), n), "/")))


def folder_counts(files: DataFrame, path: str) -> DataFrame:
    return files.groupBy(parent(F.col(path)).alias("folder")).agg(F.count(F.lit(1)).alias("n"))


def roll_up(counts: DataFrame) -> DataFrame:
    """Of every folder, own (files in it) and total (with all below)."""
    own = counts.select("folder", "n", F.explode(prefixes(F.col("folder"))).alias("at"))
    return own.groupBy("at").agg(F.sum(F.when(F.col("at") == F.col("folder"), F.col("n")).otherwise(0)).alias("own"), F.sum("n").alias("total")).withColumnRenamed("at", "folder")


def under(files: DataFrame, path: str, folder: str) -> DataFrame:
    """Files anywhere below the folder; nothing in its name is a wildcard."""
    return files.filter(F.col(path).startswith(folder.rstrip("/") + "/"))


def list_positions(links: DataFrame) -> DataFrame:
    """list_id, id, position (from 1) of links (list_id, id, next_id; 0 ends), by doubling the distance looked ahead.

    Rounds are the logarithm of the longest list, not its length. Each carries
    how many entries follow; a list's length less that is the position. A round
    is written and the one before it deleted, so that neither plan nor disk
    grows with the rounds. Lists without an end are refused: after as many rounds
    as the longest possible list needs, entries are still open.
    """
    far = links.select("list_id", "id", F.col("next_id").alias("to"), F.when(F.col("next_id") != 0, 1).otherwise(0).cast("long").alias("after"))
    far = steps.written(far)
    most = max(1, far.count()).bit_length() + 1
    for _ in range(most):
        if far.filter("to <> 0").isEmpty():
            break
        ahead = far.select("list_id", F.col("id").alias("to"), F.col("to").alias("further"), F.col("after").alias("more"))
        now = steps.written(far.join(ahead, ["list_id", "to"], "left").select("list_id", "id", F.coalesce("further", F.lit(0).cast("long")).alias("to"), (F.col("after") + F.coalesce("more", F.lit(0).cast("long"))).alias("after")))
        steps.discard(far)
        far = now
    else:
        raise ValueError("a list has no end")
    length = far.groupBy("list_id").agg((F.max("after") + 1).alias("length"))
    return far.join(length, "list_id").select("list_id", "id", (F.col("length") - F.col("after")).cast("int").alias("position"))

"""Written steps, and total orders over a whole table without a task that holds it.

A total order is made of ranges: rows are dealt out by ranges of the order's
keys, one range after the other, so that a row's number is its number within
its range and the rows of the ranges before. Only one row a range, of which
there are as many as shuffle partitions, goes through the driver.
"""

from __future__ import annotations

import atexit
import itertools
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir; a local session without one gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="ostinato-")
    atexit.register(shutil.rmtree, made, True)
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def written(df: DataFrame) -> DataFrame:
    """df from the shared folder: what reads it doesn't compute it again, and a lost executor doesn't lose it. Deleted when the session ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    forget_at_exit(spark, path)
    made = spark.read.schema(df.schema).parquet(path)
    made.step_path = path
    return made


def _place(spark: SparkSession, path: str):
    """The path and its file system."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def forget_at_exit(spark: SparkSession, path: str) -> None:
    place, system = _place(spark, path)
    system.deleteOnExit(place)


def file_status(spark: SparkSession, path: str) -> tuple[str, int, int]:
    """A file's path, size and time of change."""
    place, system = _place(spark, path)
    s = system.getFileStatus(place)
    return path, s.getLen(), s.getModificationTime()


def discard(step: DataFrame) -> None:
    """Delete a written step that nothing reads again."""
    place, system = _place(step.sparkSession, step.step_path)
    system.delete(place, True)


def pieces(rows: int, least: int, most: int = 2**18) -> int:
    """Into how many parts so many rows go, `least` or more, so that no part's size follows the input's."""
    return max(least, -(-rows // most))


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt out by keys to more parts than shuffles have, if it has too many rows for these."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = pieces(df.count(), parts)
    return df.repartition(wanted, *keys) if wanted > parts else df


def _ranged(df: DataFrame, order: list[str], rows: int = 0) -> DataFrame:
    """df with __range, the number of a row's range of the order, written. Equal keys share a range. Of many rows (told by the caller) there are more ranges, each dealt to a task."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = pieces(rows, parts)
    made = written(df.repartitionByRange(wanted, *order).withColumn("__range", F.spark_partition_id()))
    return made.repartition(wanted, "__range") if wanted > parts else made


def _beside(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    """df with what is told of each range: one row a range."""
    told = df.sparkSession.createDataFrame(rows, schema)
    return df.join(F.broadcast(told), "__range", "left")


def running_totals(df: DataFrame, order: list[str], value: Column, name: str, rows: int = 0) -> DataFrame:
    """df with the sum of a whole-numbered value over all rows before each one (0 for the first).

    Rows are in the order of the given columns, nulls first; rows that agree in
    all of them come in any order.
    """
    own = _ranged(df.withColumn("__value", value.cast("long")), order, rows)
    sums = dict(own.groupBy("__range").agg(F.sum("__value")).collect())
    ranges = sorted(sums)
    befores = list(zip(ranges, itertools.accumulate([0, *(sums[r] or 0 for r in ranges)]), strict=False))
    within = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = own.withColumn("__inner", F.coalesce(F.sum("__value").over(within), F.lit(0).cast("long")))
    return _beside(inner, befores, "__range int, __before long").withColumn(name, F.col("__before") + F.col("__inner")).drop("__range", "__value", "__inner", "__before")


def numbered(df: DataFrame, order: list[str], name: str = "number") -> DataFrame:
    """df with the number of each row (long, from 1) in the order of the given columns."""
    return running_totals(df, order, F.lit(1), name).withColumn(name, F.col(name) + 1)


def lagged(df: DataFrame, order: list[str], column: str, name: str) -> DataFrame:
    """df with what a column holds in the row before each one, null for the first."""
    own = _ranged(df, order)
    last = {r["__range"]: r["x"] for r in own.groupBy("__range").agg(F.max_by(F.struct(column), F.struct(*order)).alias("x")).collect()}
    ranges = sorted(last)
    kind = df.schema[column].dataType.simpleString()
    befores = [(now, last[before][column]) for before, now in itertools.pairwise(ranges)]
    within = Window.partitionBy("__range").orderBy(*order)
    inner = own.withColumn("__inner", F.lag(F.struct(F.col(column).alias("x"))).over(within))
    return _beside(inner, befores, f"__range int, __before {kind}").withColumn(name, F.when(F.col("__inner").isNotNull(), F.col("__inner.x")).otherwise(F.col("__before"))).drop("__range", "__inner", "__before")

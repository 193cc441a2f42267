"""Caches of results by the identity of the file they were made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTRIES = T.StructType([T.StructField(n, t) for n, t in (("start_time_ms", T.LongType()), ("artist", T.StringType()), ("title", T.StringType()), ("confidence", T.DoubleType()), ("duration_ms", T.LongType()), ("status", T.StringType()), ("filepath", T.StringType()), ("track_id", T.LongType()), ("time_stretch_ratio", T.DoubleType()))])


def key(path: Column, size: Column, modified: Column) -> Column:
    """A file that changed gets another key."""
    return F.sha2(F.concat_ws("|", path, size.cast("string"), modified.cast("string")), 256)


def save(df: DataFrame, folder: str, name: str) -> None:
    df.write.mode("overwrite").parquet(f"{folder}/{name}")


def load(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    """What was saved, or None."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    return spark.read.parquet(f"{folder}/{name}") if there else None


def load_entries(spark: SparkSession, path: str) -> DataFrame:
    """Saved entries (JSON lines) with defaults for optional fields; lines that aren't JSON are left out."""
    schema = T.StructType([*ENTRIES.fields, T.StructField("_bad", T.StringType())])
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.filter(F.col("start_time_ms").isNotNull()).drop("_bad").withColumns({"filepath": F.coalesce("filepath", F.lit("")), "time_stretch_ratio": F.coalesce("time_stretch_ratio", F.lit(1.0)), "status": F.coalesce("status", F.lit("pending"))})

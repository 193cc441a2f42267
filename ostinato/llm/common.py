"""What the corpus operators share: the shared folder, cut lineage, joins that survive a hot key."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the separators of words in every operator here.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a temporary folder serves a local session; any other
    session is refused, as its executors could not see such a folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="ostinato-")
    atexit.register(shutil.rmtree, made, True)
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it again: later stages don't recompute it, and losing an executor doesn't lose it.

    The files go when the session's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    with swept(spark):
        df.write.parquet(path)
    forget_at_exit(spark, path)
    made = spark.read.schema(df.schema).parquet(path)
    made.cut_path = path
    return made


def discard(df: DataFrame) -> None:
    """Delete the files of a cut that nothing will read again."""
    delete(df.sparkSession, df.cut_path)


def delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def forget_at_exit(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)


@contextlib.contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile leaves no shuffle files: Spark deletes those of each write when it is over.

    Python functions get their rows in small batches meanwhile, as those of long
    texts fill memory outside the heap, on either side, that isn't given back.
    """
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = {key: spark.conf.get(key, default) for key, default in (("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false"), (rows, "10000"))}
    for key, value in zip(before, ("true", str(min(1000, int(before[rows])) if int(before[rows]) > 0 else 1000)), strict=True):
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def carrying(docs: DataFrame, used: list[str], run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """run(docs), which keeps, repeats or drops rows, with docs' columns as they were but for those it changes among `used`.

    It sees the used columns and one more that holds all others, so that none of
    these can clash with a name that it makes.
    """
    used = [c for c in dict.fromkeys(used) if c in docs.columns]
    others = [c for c in docs.columns if c not in used]
    quoted = lambda c: "`" + c.replace("`", "``") + "`"
    own = [F.col(quoted(c)) for c in used]
    if not others:
        return run(docs).select(*[F.col(quoted(c)) for c in docs.columns])
    rest = "carried"
    while rest in used:
        rest += "_"
    # fields go by number, as names may hold anything
    out = run(docs.select(*own, F.struct(*[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(others)]).alias(rest)))
    return out.select(*[F.col(quoted(c)) if c in used else F.col(rest).getField(f"c{others.index(c)}").alias(c) for c in docs.columns])


def salt(key: Column, salts: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("salt")), F.lit(salts)).cast("int")


def look_up(big: DataFrame, small: DataFrame, keys: list[str], spread_by: str, salts: int = 64) -> DataFrame:
    """big left join small on keys, where small has one row a key and big may have a third of its rows on one key.

    The keys of big, once a salt, meet small first (at most `salts` rows a
    key); each row of big then meets its salt's copy. A key's rows are thus
    dealt over `salts` tasks, and nothing is replicated that big doesn't hold.
    """
    salted = big.withColumn("__salt", salt(F.col(spread_by), salts))
    leaf = salted.select(*keys, "__salt").distinct().join(small, keys, "left")
    return salted.join(leaf, [*keys, "__salt"], "left").drop("__salt")


def by_bytes(b: pa.RecordBatch, text: str | int, most: int = 2**20) -> Iterator[tuple[pa.RecordBatch, list]]:
    """b in parts of about `most` bytes of text, and each part's texts, so that a task's memory doesn't follow the texts' lengths.

    A longer text is a part of its own; a row counts 64 bytes at least.
    """
    ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy().astype(np.int64) + 64)
    i = 0
    while i < b.num_rows:
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
        part = b.slice(i, j - i)
        yield part, part.column(text).to_pylist()
        i = j


def lean(run: Callable) -> Callable:
    """run, for mapInArrow: when a task ends, what its worker has freed goes back to the system.

    Workers are kept for later tasks, of other operators too; else each would
    hold the most that any task before needed.
    """

    @functools.wraps(run)
    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # another C library
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return tidy

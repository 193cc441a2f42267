"""Per-frame series: levels, peaks, envelopes, statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Edges of the bands in Hz, half open. Fixed values.
BANDS = {"sub_bass": (20, 60), "bass": (60, 150), "low_mid": (150, 500), "mid": (500, 2000), "high_mid": (2000, 6000), "high": (6000, 20000)}


def normalised(df: DataFrame, group: str, value: str) -> DataFrame:
    """level: value by the group's largest, 0 if that is 0."""
    top = F.max(value).over(Window.partitionBy(group))
    return df.withColumn("level", F.when(top == 0, 0.0).otherwise(F.col(value) / top))


def local_maxima(df: DataFrame, group: str, order: str, value: str, reach: int = 3, above: float = 0.5) -> DataFrame:
    top = F.max(value).over(Window.partitionBy(group).orderBy(order).rowsBetween(-reach, reach))
    return df.withColumn("__top", top).filter((F.col(value) == F.col("__top")) & (F.col(value) > above)).drop("__top")


def falling_maximum(df: DataFrame, group: str, order: str, value: str, rise: float = 1.2, fall: float = 0.998) -> DataFrame:
    """top: the larger of rise * value and fall * the top before, along the order; values are positive.

    As the top is the greatest of rise * value * fall ** (rows since), it is a
    running maximum of logarithms, without state.
    """
    w = Window.partitionBy(group).orderBy(order)
    at = F.row_number().over(w) * math.log(fall)
    level = F.max(F.col("__log") - F.col("__at")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("__at", at).withColumn("__log", F.log(F.col(value) * rise)).withColumn("top", F.coalesce(F.exp(level + F.col("__at")), F.lit(0.0))).drop("__at", "__log")


def spaced(df: DataFrame, group: str, frame: str, least: int) -> DataFrame:
    """Frames taken in order, each at least so many after the one taken before."""
    far = lambda acc, x: F.when((F.size(acc) == 0) | (x - F.element_at(acc, -1) >= least), F.array_append(acc, x)).otherwise(acc)
    rows = df.groupBy(group).agg(F.array_sort(F.collect_list(F.col(frame).cast("int"))).alias("f"))
    start = F.array().cast("array<int>")
    return rows.select(group, F.explode(F.aggregate("f", F.when(F.size("f") > 0, F.slice("f", 1, 1)).otherwise(start), far)).alias(frame))


def band_levels(df: DataFrame, key: list[str], hz: str, power: str, bands: dict[str, tuple[int, int]] = BANDS) -> DataFrame:
    """Mean power of each band, and its share of the mean over all."""
    mean = {n: F.avg(F.when((F.col(hz) >= a) & (F.col(hz) < b), F.col(power))) for n, (a, b) in bands.items()}
    rows = df.groupBy(*key).agg(F.avg(power).alias("__all"), *[F.coalesce(m, F.lit(0.0)).alias(n) for n, m in mean.items()])
    return rows.select(*key, *bands, *[F.when(F.col("__all") > 0, F.col(n) / F.col("__all")).otherwise(0.0).alias(f"{n}_ratio") for n in bands])


def rms(df: DataFrame, key: list[str], value: str, frame: Column) -> DataFrame:
    return df.withColumn("frame", frame).groupBy(*key, "frame").agg(F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"))


def envelope(df: DataFrame, key: list[str], at: str, value: str, columns: int) -> DataFrame:
    """Largest absolute value in each of so many columns over the key's length."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*key))
    return df.withColumn("column", F.floor(F.col(at) * columns / n).cast("int")).groupBy(*key, "column").agg(F.max(F.abs(F.col(value))).alias("peak"))


def structure(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Mean level of the first 20 %, the middle and the last 20 % of a series, by the mean of all."""
    w = Window.partitionBy(key)
    rows = df.withColumn("__i", F.row_number().over(w.orderBy(order)) - 1).withColumn("__n", F.count(F.lit(1)).over(w))
    a, b = (F.col("__n") * 0.2).cast("int"), (F.col("__n") * 0.8).cast("int")
    at = F.col("__i")
    share = lambda cond: F.avg(F.when(cond, F.col(value))) / F.avg(value)
    return rows.groupBy(key).agg(share(at < a).alias("intro_ratio"), share((at >= a) & (at < b)).alias("core_ratio"), share(at >= b).alias("outro_ratio"))


def statistics(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Mean, population deviation, percentiles, slope over the position, entropy of shares."""
    w = Window.partitionBy(key)
    rows = df.withColumn("__i", F.row_number().over(w.orderBy(order)) - 1).withColumn("__p", F.col(value) / (F.sum(value).over(w) + 1e-10))
    return rows.groupBy(key).agg(
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("sd"),
        F.percentile(value, 0.1).alias("p10"),
        F.percentile(value, 0.9).alias("p90"),
        F.median(value).alias("median"),
        F.regr_slope(F.col(value), F.col("__i")).alias("slope"),
        (-F.sum(F.col("__p") * F.log(F.col("__p") + 1e-10))).alias("entropy"),
        F.max(value).alias("peak"),
    )

"""The library's tables as projections of the given ones, for Spark and as common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import steps

NOW = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: One text for both engines, but for the function that makes a timestamp of seconds.
_TRACKS = """select p_partkey as id,
  concat('/music/', lower(p_type), '/', replace(lower(p_brand), '#', '_'), '/', p_brand, ' - ', p_name, ' ', cast(p_partkey as {text}), '.mp3') as filepath,
  concat(p_brand, ' - ', p_name, ' ', cast(p_partkey as {text}), '.mp3') as filename,
  case when p_partkey % 11 = 0 then null else p_name end as title, case when p_partkey % 13 = 0 then null else p_brand end as artist, p_type as album,
  concat(upper(substr(p_name, 1, 1)), '-', upper(substr(p_name, instr(p_name, ' ') + 1, 1)), '-*', cast(p_size % 5 + 1 as {text})) as genre,
  p_retailprice as duration_seconds, cast(p_size as bigint) * 1000 as file_size,
  case when p_partkey % 4 = 0 then 'curating' else 'collection' end as mode,
  {stamp} as date_added, cast(0 as int) as play_count
from part"""

_PLAYS = "select event_id as id, user_id as track_id, ts as played_at, value as play_duration_seconds, event_type in ('view', 'purchase') as completed from events"
_ENTRIES = "select l_orderkey as playlist_id, l_partkey as track_id, l_linenumber as position, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as at from lineitem"
_PLAYLISTS = "select o_orderkey as id, concat('Playlist ', cast(o_orderkey as {text})) as name from orders"

CTE = {
    "tracks": _TRACKS.format(text="varchar", stamp="make_timestamp((1704067200 + p_partkey * 60) * 1000000)"),
    "plays": _PLAYS,
    "entries": _ENTRIES,
    "playlists": _PLAYLISTS.format(text="varchar"),
    # times of two recordings' hashes: suppliers are tracks, parts are hashes
    "library": "select l_suppkey as track, l_partkey as hash, cast(date_diff('day', timestamp '1990-01-01', l_shipdate) as bigint) * 1000 as t from lineitem",
    # each hash in the first recording that plays it, two per cent slower than its track
    "query": "select l_suppkey as recording, l_linenumber as segment, l_partkey as hash, cast(60000 + 1.02 * (date_diff('day', timestamp '1990-01-01', l_shipdate) * 1000) as bigint) as t from lineitem qualify row_number() over (partition by l_partkey order by l_suppkey, l_linenumber, l_shipdate) = 1",
    "vectors": "select vec_id as track, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings",
    "cues": "select user_id as sheet, event_id, (epoch_us(ts) // 1000 - 1704067200000) as start_raw, cast(floor(value * 1000000) as bigint) as duration_raw, event_type as title from events",
}


def with_(names: str, body: str) -> str:
    return "with " + ", ".join(f"{n} as ({CTE[n]})" for n in names.split()) + "\n" + body


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = _TRACKS.format(text="string", stamp="timestamp_seconds(1704067200 + p_partkey * 60)").replace("from part", "from {part}")
    return spark.sql(sql, part=table(spark, sf_dir, "part"))


def plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("track_id"), F.col("ts").alias("played_at"), F.col("value").alias("play_duration_seconds"), F.col("event_type").isin("view", "purchase").alias("completed"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_ENTRIES.replace("from lineitem", "from {l}"), l=steps.dealt(table(spark, sf_dir, "lineitem"), "l_orderkey"))


def playlists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_PLAYLISTS.format(text="string").replace("from orders", "from {o}"), o=table(spark, sf_dir, "orders"))


def _days(c):
    return F.datediff(c, F.lit("1990-01-01").cast("date")).cast("long") * 1000


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("track"), F.col("l_partkey").alias("hash"), _days(F.col("l_shipdate")).alias("t"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.min(F.struct("l_suppkey", "l_linenumber", "l_shipdate")).alias("x"))
    return first.select(F.col("x.l_suppkey").alias("recording"), F.col("x.l_linenumber").alias("segment"), F.col("l_partkey").alias("hash"), F.round(F.lit(60000) + _days(F.col("x.l_shipdate")) * F.lit(102) / 100).cast("long").alias("t"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("track"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("sheet"), "event_id", (F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000) - 1704067200000).alias("start_raw"), F.floor(F.col("value") * 1000000).cast("long").alias("duration_raw"), F.col("event_type").alias("title")
    )

"""The catalog of tracks, playlists and plays: look-ups, changes as new snapshots, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import steps

#: Tag columns that an update may change. Fixed values.
EDITABLE = ("title", "artist", "album", "album_artist", "genre", "year", "track_number", "comment", "mode", "duration_seconds", "file_size", "filepath", "filename")


def in_mode(tracks: DataFrame, mode: str | None) -> DataFrame:
    return tracks.filter(F.col("mode") == mode) if mode else tracks


def newest(tracks: DataFrame, limit: int | None = None, mode: str | None = None) -> DataFrame:
    found = in_mode(tracks, mode).orderBy(F.desc("date_added"), "id")
    return found.limit(limit) if limit else found


def fallback_lookup(tracks: DataFrame, path: str) -> DataFrame:
    """The row of that path, else of that file name, else of a path that contains the name; the lowest id of those."""
    name = path.rsplit("/", 1)[-1]
    rank = F.when(F.col("filepath") == path, 1).when(F.col("filename") == name, 2).when(F.col("filepath").contains(name), 3)
    return tracks.withColumn("rank", rank).filter("rank is not null").orderBy("rank", "id").limit(1)


def in_given_order(tracks: DataFrame, paths: list[str]) -> DataFrame:
    """Rows of the paths in the caller's order; unknown ones are left out, repeated ones come once."""
    spark = tracks.sparkSession
    asked = spark.createDataFrame([(p, i) for i, p in enumerate(dict.fromkeys(paths))], "filepath string, pos int")
    return tracks.join(F.broadcast(asked), "filepath").orderBy("pos")


def upsert(tracks: DataFrame, new: DataFrame, now: Column, key: str = "filepath") -> DataFrame:
    """tracks with the rows of new: known paths keep id, date_added and play_count and take the new metadata; others get the next ids, in order of path."""
    kept = ("id", "date_added", "play_count")
    data = [c for c in new.columns if c not in (key, *kept)]
    top = tracks.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    latest = new.groupBy(key).agg(*[F.last(c).alias(f"__{c}") for c in data], F.lit(1).alias("__new"))
    met = tracks.join(latest, key, "full_outer")
    known = met.filter("id is not null").select(*[F.when(F.col("__new") == 1, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in data else F.col(c) for c in tracks.columns])
    fresh = steps.numbered(met.filter("id is null"), [key], "__number").crossJoin(F.broadcast(top)).withColumn("id", F.col("top") + F.col("__number"))
    fresh = fresh.select(*[F.col(f"__{c}").alias(c) if c in data else (now.alias(c) if c == "date_added" else F.lit(0).alias(c) if c == "play_count" else F.col(c)) for c in tracks.columns])
    return known.unionByName(fresh)


def update(tracks: DataFrame, key: int, values: dict, allowed: tuple[str, ...] = EDITABLE) -> tuple[DataFrame, bool]:
    """The snapshot with allowed columns of one row changed, and whether there was any; other names are ignored."""
    good = {k: v for k, v in values.items() if k in allowed and k in tracks.columns}
    changed = tracks.withColumns({k: F.when(F.col("id") == key, F.lit(v)).otherwise(F.col(k)) for k, v in good.items()})
    return (changed, True) if good else (tracks, False)


def move(tracks: DataFrame, key: int, path: str, name: str | None = None) -> DataFrame:
    return update(tracks, key, {"filepath": path, "filename": name or path.rsplit("/", 1)[-1]})[0]


def delete(tracks: DataFrame, gone: DataFrame, children: dict[str, DataFrame], on: str = "track_id") -> tuple[DataFrame, dict[str, DataFrame]]:
    """Without the ids in gone, here and in every child table."""
    ids = gone.select(F.col("id").alias("__gone")).distinct()
    return tracks.join(ids, F.col("id") == F.col("__gone"), "left_anti"), {k: c.join(ids, F.col(on) == F.col("__gone"), "left_anti") for k, c in children.items()}


def record_plays(tracks: DataFrame, plays: DataFrame) -> DataFrame:
    """play_count and last_played after the plays."""
    added = plays.groupBy(F.col("track_id").alias("id")).agg(F.count(F.lit(1)).alias("__n"), F.max("played_at").alias("__last"))
    return tracks.join(added, "id", "left").withColumn("play_count", F.col("play_count") + F.coalesce("__n", F.lit(0))).withColumn("last_played", F.greatest("last_played", "__last")).drop("__n", "__last")


def replace_by_key(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new instead of those of old with the same key."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def merge_columns(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Given columns of new where they aren't null, else the old values; keys only in new come in. Unknown columns are refused."""
    extra = set(new.columns) - set(old.columns)
    if extra:
        raise ValueError(f"unknown columns: {sorted(extra)}")
    n = new.select(key, *[F.col(c).alias(f"__{c}") for c in new.columns if c != key])
    return old.join(n, key, "full_outer").select(*[F.coalesce(f"__{c}", c).alias(c) if c in new.columns and c != key else F.col(c) for c in old.columns])


def orphans(child: DataFrame, tracks: DataFrame, on: str = "track_id") -> DataFrame:
    return child.join(tracks.select(F.col("id").alias("__id")), F.col(on) == F.col("__id"), "left_anti")


def append_to_playlist(entries: DataFrame, playlist: int, track: int) -> DataFrame:
    """The track at the end, unless it is there."""
    here = entries.filter(F.col("playlist_id") == playlist)
    found = here.agg((F.coalesce(F.max("position"), F.lit(0)) + 1).cast(entries.schema["position"].dataType).alias("position"), F.coalesce(F.max(F.col("track_id") == track), F.lit(False)).alias("there"))
    new = found.filter("not there").select(F.lit(playlist).cast("long").alias("playlist_id"), F.lit(track).cast("long").alias("track_id"), "position")
    return entries.select("playlist_id", "track_id", "position").unionByName(new)


def sort_key(column: str) -> list[Column]:
    """What a list sorts by for each column heading: text without case, length, rating, or folder without case."""
    from ..functions import text

    if column in ("title", "artist", "album", "filename", "genre"):
        return [F.lower(F.coalesce(column, F.lit("")))]
    if column == "rating":
        return [text.rating(F.col("genre"))]
    if column == "folder":
        return [F.regexp_extract("filepath", "^(.*)/[^/]*$", 1)]
    if column == "path":
        return [F.lower(F.regexp_extract("filepath", "^(.*)/[^/]*$", 1))]
    if column == "duration":
        return [F.coalesce("duration_seconds", F.lit(0.0))]
    return [F.col(column)]


#: Headings that a list can be sorted by. Fixed values.
SORTABLE = ("artist", "title", "filename", "genre", "duration", "rating", "path")


def sorted_by(tracks: DataFrame, column: str | None, limit: int, descending: bool = False) -> DataFrame:
    """The first rows of a list by a heading, the newest first where it can't be sorted by that; ties by id. place counts them."""
    keys = [k.desc() if descending else k.asc() for k in sort_key(column)] if column in SORTABLE else [F.desc("date_added")]
    first = tracks.orderBy(*keys, "id").limit(limit)
    return first.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*keys, "id")))  # of the limited rows alone


def random_rows(df: DataFrame, n: int, seed: int, key: str = "id") -> DataFrame:
    """n rows in an order that depends on seed and key alone: by the digest of both."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), key).limit(n)


def unplayed(tracks: DataFrame, plays: DataFrame, now: Column, days: int = 7) -> DataFrame:
    recent = plays.filter(F.col("played_at") > now - F.expr(f"interval {days} days")).select(F.col("track_id").alias("__id")).distinct()
    return tracks.join(recent, F.col("id") == F.col("__id"), "left_anti")


def recent_pairs(tracks: DataFrame, plays: DataFrame, limit: int = 20) -> DataFrame:
    """The artist and genre pairs that were last played to the end, newest first."""
    met = plays.filter("completed").join(tracks, plays["track_id"] == tracks["id"])
    return met.groupBy("artist", "genre").agg(F.max("played_at").alias("played_at")).orderBy(F.desc("played_at"), "artist", "genre").limit(limit)


def recommend(tracks: DataFrame, plays: DataFrame, now: Column, n: int = 10, seed: int = 1) -> DataFrame:
    """Tracks to play next: unplayed ones of up to three recent artists, then of up to two recent genres; without plays, any. In seeded order."""
    pairs = recent_pairs(tracks, plays)
    artists = [r[0] for r in random_rows(pairs.select("artist").filter("artist is not null").distinct(), 3, seed, "artist").collect()]
    genres = [r[0] for r in random_rows(pairs.select("genre").filter("genre is not null").distinct(), 2, seed, "genre").collect()]
    if not artists and not genres:
        return random_rows(tracks, n, seed)
    free = unplayed(tracks, plays, now)
    by_artist = [random_rows(free.filter(F.col("artist") == a), n // 3, seed) for a in artists]
    found = by_artist[0] if by_artist else tracks.limit(0)
    for x in by_artist[1:]:
        found = found.unionByName(x)
    for g in genres:
        found = found.unionByName(random_rows(tracks.filter(F.col("genre") == g), max(1, (n - 3 * (n // 3)) // 2 or 1), seed))
    return random_rows(found, n, seed + 1)


def duplicate_groups(tracks: DataFrame) -> DataFrame:
    """Tracks of the same title and artist, case aside."""
    key = [F.lower(F.coalesce(c, F.lit(""))).alias(f"k_{c}") for c in ("title", "artist")]
    return tracks.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("id")).alias("ids")).filter("n > 1")


def with_missing_columns(df: DataFrame, schema) -> DataFrame:
    """df with the schema's columns in its order, null where df has none."""
    return df.select(*[F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])

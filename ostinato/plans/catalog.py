"""Catalog queries: scans, look-ups, changes, joins, statistics, orders."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import index, learning, steps
from ..operators import library as L
from ..sources import snapshots
from . import domain as D
from .registry import query


def _index(spark, **tables) -> index.Index:
    """An index of its own in the shared folder, holding these tables; the others are empty."""
    store = snapshots.Store(spark, f"{steps.shared_dir(spark)}/index-{uuid.uuid4().hex}")
    steps.forget_at_exit(spark, store.folder)
    empty = {"tracks": "id long, filepath string", "fingerprints": "track long, hash long, t long", "vectors": "track long, kind string, v array<float>"}
    with store.transaction():
        for name, schema in empty.items():
            store.write(name, tables[name] if name in tables else spark.createDataFrame([], schema))
    return index.Index(store)


def now():
    return F.lit(D.NOW).cast("timestamp")


@query("a1_newest_tracks", D.with_("tracks", "select id, title, date_added from tracks where mode = 'collection' order by date_added desc, id limit 50"))
def newest_tracks(spark, sf):
    return L.newest(D.tracks(spark, sf), 50, "collection").select("id", "title", "date_added")


@query("a2_point_lookup", D.with_("tracks", "select id, filepath from tracks where id = 7 or filepath = (select filepath from tracks where id = 9)"))
def point_lookup(spark, sf):
    t = D.tracks(spark, sf)
    path = t.filter("id = 9").select(F.col("filepath").alias("p"))
    return t.filter("id = 7").select("id", "filepath").unionByName(t.join(F.broadcast(path), F.col("filepath") == F.col("p"), "left_semi").select("id", "filepath"))


@query("a2b_fallback_lookup", D.with_("tracks", "select id, 3 as rank from tracks where contains(filepath, 'ring') order by id limit 1"))
def fallback_lookup(spark, sf):
    return L.fallback_lookup(D.tracks(spark, sf), "/elsewhere/ring").select("id", "rank")


@query(
    "a3_rows_in_given_order",
    D.with_("tracks", "select id, cast(case id when 5 then 0 when 2 then 1 else 3 end as int) as pos from tracks where id in (5, 2, 9)"),
)
def rows_in_given_order(spark, sf):
    t = D.tracks(spark, sf)
    paths = {r[0]: r[1] for r in t.filter(F.col("id").isin(5, 2, 9)).select("id", "filepath").collect()}
    return L.in_given_order(t, [paths[5], paths[2], "/none", paths[5], paths[9]]).select("id", "pos")


@query(
    "a4_waveforms_and_stats_flag",
    "select d.doc_id, l.quality is not null as has_stats, sha256(d.text) as wave from documents d left join labels l using (doc_id)",
)
def waveforms_and_stats_flag(spark, sf):
    d, stats = D.table(spark, sf, "documents"), D.table(spark, sf, "labels").select("doc_id", F.lit(True).alias("s"))
    return d.join(stats, "doc_id", "left").select("doc_id", F.coalesce("s", F.lit(False)).alias("has_stats"), F.sha2("text", 256).alias("wave"))


@query("a14_vectors_by_type", "select label as feature_type, count(*) as n, sum(len(embedding)) as numbers from embeddings group by 1")
def vectors_by_type(spark, sf):
    """Half of the vectors are put twice: the second time each takes its own place."""
    rows = D.table(spark, sf, "embeddings").select(F.col("vec_id").alias("track"), F.col("label").cast("string").alias("kind"), F.col("embedding").alias("v"))
    held = _index(spark, vectors=rows.filter("track % 2 = 0"))
    held.put_vectors(rows)
    return held.vectors().groupBy(F.col("kind").cast("int").alias("feature_type")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("v")).alias("numbers"))


@query(
    "a15_typed_settings",
    "select event_id, lower(event_type) in ('true', '1', 'yes', 'click') as flag, coalesce(try_cast(json_extract_string(props, '$.k') as int), -1) as k, coalesce(try_cast(event_type as int), 42) as fallback from events",
)
def typed_settings(spark, sf):
    return D.table(spark, sf, "events").select("event_id", F.lower("event_type").isin("true", "1", "yes", "click").alias("flag"), F.coalesce(F.get_json_object("props", "$.k").try_cast("int"), F.lit(-1)).alias("k"), F.coalesce(F.col("event_type").try_cast("int"), F.lit(42)).alias("fallback"))


@query("a16_attached_catalog", D.with_("tracks", "select t.id, n.n_name from tracks t join nation n on n.n_nationkey = t.id"))
def attached_catalog(spark, sf):
    D.table(spark, sf, "nation").createOrReplaceTempView("attached_nation")
    return spark.sql("select t.id, n.n_name from {t} t join attached_nation n on n.n_nationkey = t.id", t=D.tracks(spark, sf))


@query(
    "b1_upsert",
    D.with_(
        "tracks",
        """, new as (select filepath, 'New ' || title as title from tracks where id % 50 = 0 union all select '/new/' || id, 'Fresh' from tracks where id % 100 = 1),
    top as (select max(id) as top from tracks)
    select t.id, t.filepath, case when n.filepath is not null then n.title else t.title end as title, t.date_added from tracks t left join new n using (filepath)
    union all select top + row_number() over (order by filepath), filepath, title, timestamp '2024-01-31' from new, top where starts_with(filepath, '/new/')""",
    ).replace(")\n,", "),"),
)
def upsert(spark, sf):
    t = D.tracks(spark, sf).select("id", "filepath", "title", "date_added", "play_count")
    new = t.filter("id % 50 = 0").select("filepath", F.concat(F.lit("New "), "title").alias("title")).unionByName(t.filter("id % 100 = 1").select(F.concat(F.lit("/new/"), F.col("id").cast("string")).alias("filepath"), F.lit("Fresh").alias("title")))
    return L.upsert(t, new, now()).select("id", "filepath", "title", "date_added")


@query("b2_allowed_update", D.with_("tracks", "select id, case when id = 3 then 'X' else title end as title from tracks"))
def allowed_update(spark, sf):
    return L.update(D.tracks(spark, sf), 3, {"title": "X", "id": 99, "no_such": 1})[0].select("id", "title")


@query("b3_move", D.with_("tracks", "select id, case when id = 4 then '/moved/a.mp3' else filepath end as filepath, case when id = 4 then 'a.mp3' else filename end as filename from tracks"))
def move(spark, sf):
    return L.move(D.tracks(spark, sf), 4, "/moved/a.mp3").select("id", "filepath", "filename")


@query("b4_delete_cascade", D.with_("tracks plays entries", "select 'tracks' as kind, count(*) as n from tracks where id % 5 <> 0 union all select 'plays', count(*) from plays where track_id % 5 <> 0 union all select 'entries', count(*) from entries where track_id % 5 <> 0"))
def delete_cascade(spark, sf):
    t = D.tracks(spark, sf)
    kept, children = L.delete(t, t.filter("id % 5 = 0"), {"plays": D.plays(spark, sf).filter("track_id in (0,1) or true"), "entries": D.entries(spark, sf)})
    out = None
    for name, df in {"tracks": kept, **children}.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("kind"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("b5_record_plays", D.with_("tracks plays", "select t.id, count(p.id) as play_count, max(p.played_at) as last_played from tracks t left join plays p on p.track_id = t.id group by 1"))
def record_plays(spark, sf):
    t = D.tracks(spark, sf).withColumn("play_count", F.col("play_count").cast("long")).withColumn("last_played", F.lit(None).cast("timestamp"))
    return L.record_plays(t, D.plays(spark, sf)).select("id", "play_count", "last_played")


@query("b6_replace_by_key", "select doc_id, case when doc_id % 3 = 0 then 9 else quality end as quality from labels")
def replace_by_key(spark, sf):
    old = D.table(spark, sf, "labels").select("doc_id", "quality")
    return L.replace_by_key(old, old.filter("doc_id % 3 = 0").withColumn("quality", F.lit(9)), ["doc_id"])


@query("b7_merge_columns", "select doc_id, quality, case when doc_id % 3 = 0 then 5 else toxic end as toxic from labels union all select -1, 1, null")
def merge_columns(spark, sf):
    old = D.table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    new = old.filter("doc_id % 3 = 0").select("doc_id", F.lit(None).cast("int").alias("quality"), F.lit(5).alias("toxic"))
    bare = spark.range(1).select(F.lit(-1).cast("long").alias("doc_id"), F.lit(1).alias("quality"), F.lit(None).cast("int").alias("toxic"))
    return L.merge_columns(old, new.unionByName(bare), "doc_id")


@query("b7b_replace_whole_rows", "select doc_id, case when doc_id % 3 = 0 then null else quality end as quality, case when doc_id % 3 = 0 then 5 else toxic end as toxic from labels")
def replace_whole_rows(spark, sf):
    old = D.table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    new = L.with_missing_columns(old.filter("doc_id % 3 = 0").select("doc_id", F.lit(5).alias("toxic")), old.schema)
    return L.replace_by_key(old, new, ["doc_id"])


@query("b8_bulk_append_counts", D.with_("library", "select track, count(*) as fingerprint_count from (select * from library union all select * from library where track < 3) group by 1"))
def bulk_append_counts(spark, sf):
    f = D.library(spark, sf)
    held = _index(spark, fingerprints=f)
    held.add(f.filter("track < 3"))
    return held.status()


@query("b9_orphans", D.with_("tracks entries", "select count(*) as removed from entries where track_id not in (select id from tracks where id % 2 = 0)"))
def orphans(spark, sf):
    return L.orphans(D.entries(spark, sf), D.tracks(spark, sf).filter("id % 2 = 0")).agg(F.count(F.lit(1)).alias("removed"))


@query("b10_clear_all", D.with_("tracks", "select id from tracks where false"))
def clear_all(spark, sf):
    held = _index(spark, fingerprints=D.library(spark, sf), vectors=D.vectors(spark, sf).withColumn("kind", F.lit("all")))
    held.clear()
    return held.store.read("fingerprints").select(F.col("track").alias("id")).unionAll(held.vectors().select("track"))


@query(
    "b11_append_to_playlist",
    D.with_("entries", "select playlist_id, track_id, position from entries union all select 1, 100000, (select coalesce(max(position), 0) + 1 from entries where playlist_id = 1)"),
)
def append_to_playlist(spark, sf):
    once = L.append_to_playlist(D.entries(spark, sf), 1, 100000)
    return L.append_to_playlist(once, 1, 100000)


@query("b13_linked_list", "select conv_id as list_id, turn as id, coalesce(lead(turn) over (partition by conv_id order by turn), 0) as next_id from conversations")
def linked_list(spark, sf):
    w = Window.partitionBy("list_id").orderBy("id")
    c = D.table(spark, sf, "conversations").select(F.col("conv_id").alias("list_id"), F.col("turn").alias("id"))
    return c.withColumn("next_id", F.coalesce(F.lead("id").over(w), F.lit(0).cast("long")))


@query("c7_nonempty_guard", D.with_("tracks", "select id from tracks where title is not null and title <> '' and artist is not null"))
def nonempty_guard(spark, sf):
    return D.tracks(spark, sf).filter("title is not null and title <> '' and artist is not null").select("id")


@query("c8_needs_work", "select d.doc_id from documents d left join labels l using (doc_id) where l.doc_id is null or l.quality = 0")
def needs_work(spark, sf):
    stats = D.table(spark, sf, "labels").select("doc_id", F.when(F.col("quality") != 0, F.col("quality")).alias("q"))
    return D.table(spark, sf, "documents").join(stats, "doc_id", "left").filter("q is null").select("doc_id")


@query("c9_not_played_lately", D.with_("tracks plays", f"select id from tracks where id not in (select track_id from plays where played_at > timestamp '{D.NOW}' - interval 2 day)"))
def not_played_lately(spark, sf):
    return L.unplayed(D.tracks(spark, sf), D.plays(spark, sf), now(), 2).select("id")


@query("c10_missing_files", D.with_("tracks", "select id, id % 3 = 0 as missing from tracks"))
def missing_files(spark, sf):
    t = D.tracks(spark, sf)
    listed = t.filter("id % 3 <> 0").select("filepath", F.lit(True).alias("there"))
    return t.join(listed, "filepath", "left").select("id", F.col("there").isNull().alias("missing"))


@query("c13_even_sample", D.with_("library", "select track, hash, t from (select *, count(*) over (partition by track) as n, row_number() over (partition by track order by t, hash) - 1 as r from library) where n <= 50 or (r % (n // 50) = 0 and r / (n // 50) < 50)"))
def even_sample(spark, sf):
    from ..operators import match

    return match.sample_evenly(D.library(spark, sf), "track", ["t", "hash"], 50)


@query("d2_not_analysed", "select d.doc_id from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)")
def not_analysed(spark, sf):
    return D.table(spark, sf, "documents").select("doc_id").join(D.table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


@query("d3_indexed_newest", D.with_("tracks library", "select t.id, t.date_added, s.n from tracks t join (select track, count(*) as n from library group by 1) s on s.track = t.id order by t.date_added desc limit 20"))
def indexed_newest(spark, sf):
    status = D.library(spark, sf).groupBy(F.col("track").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return D.tracks(spark, sf).join(status, "id").select("id", "date_added", "n").orderBy(F.desc("date_added")).limit(20)


@query("d4_features_of_tracks", "select d.doc_id, d.lang, l.quality, l.toxic from documents d join labels l using (doc_id)")
def features_of_tracks(spark, sf):
    return D.table(spark, sf, "documents").select("doc_id", "lang").join(D.table(spark, sf, "labels"), "doc_id").select("doc_id", "lang", "quality", "toxic")


@query("d5_recent_plays", D.with_("tracks plays", "select p.id, t.title, p.played_at from plays p join tracks t on t.id = p.track_id where p.completed order by p.played_at desc, p.id limit 30"))
def recent_plays(spark, sf):
    t = D.tracks(spark, sf).select(F.col("id").alias("track_id"), "title")
    return D.plays(spark, sf).filter("completed").join(t, "track_id").select("id", "title", "played_at").orderBy(F.desc("played_at"), "id").limit(30)


@query("d6_playlist_counts", D.with_("playlists entries", "select p.id, p.name, count(e.track_id) as n from playlists p left join entries e on e.playlist_id = p.id group by 1, 2"))
def playlist_counts(spark, sf):
    n = D.entries(spark, sf).groupBy(F.col("playlist_id").alias("id")).agg(F.count("track_id").alias("n"))
    return D.playlists(spark, sf).join(n, "id", "left").select("id", "name", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query("d7_playlist_in_order", D.with_("tracks entries", "select e.playlist_id, e.at, t.id, t.filename from entries e join tracks t on t.id = e.track_id"))
def playlist_in_order(spark, sf):
    t = D.tracks(spark, sf).select(F.col("id").alias("track_id"), F.col("id"), "filename")
    return D.entries(spark, sf).join(t, "track_id").select("playlist_id", "at", "id", "filename").orderBy("playlist_id", "at")


@query("d9_shared_ids", "select doc_id from labels intersect select vec_id from embeddings")
def shared_ids(spark, sf):
    return D.table(spark, sf, "labels").select("doc_id").intersect(D.table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id")))


@query("d12_dangling", "select c.conv_id, c.turn from conversations c where c.turn > 0 and not exists (select 1 from conversations n where n.conv_id = c.conv_id and n.turn = c.turn + 1)")
def dangling(spark, sf):
    c = D.table(spark, sf, "conversations").select("conv_id", "turn")
    return c.filter("turn > 0").join(c.select(F.col("conv_id"), (F.col("turn") - 1).alias("turn")), ["conv_id", "turn"], "left_anti")


@query(
    "d13_list_positions",
    """with recursive l as (select conv_id as list_id, turn + 1 as id, coalesce(lead(turn + 1) over (partition by conv_id order by turn), 0) as next_id from conversations),
  walk as (select list_id, id, next_id, 1 as position from l where id not in (select next_id from l l2 where l2.list_id = l.list_id)
  union all select l.list_id, l.id, l.next_id, w.position + 1 from walk w join l on l.list_id = w.list_id and l.id = w.next_id) select list_id, id, position from walk""",
)
def list_positions(spark, sf):
    from ..operators import hierarchy

    w = Window.partitionBy("list_id").orderBy("id")
    c = D.table(spark, sf, "conversations").select(F.col("conv_id").alias("list_id"), (F.col("turn") + 1).alias("id"))
    return hierarchy.list_positions(c.withColumn("next_id", F.coalesce(F.lead("id").over(w), F.lit(0).cast("long"))))


@query("e1_library_stats", D.with_("tracks", "select count(*) as n, round(coalesce(sum(duration_seconds), 0), 2) as seconds from tracks where mode = 'collection'"))
def library_stats(spark, sf):
    return L.in_mode(D.tracks(spark, sf), "collection").agg(F.count(F.lit(1)).alias("n"), F.round(F.coalesce(F.sum("duration_seconds"), F.lit(0.0)), 2).alias("seconds"))


@query("e2_index_stats", D.with_("tracks library", "select t.n as tracks, i.n as indexed, f.n as fingerprints, t.n - i.n as missing, round(f.n / greatest(i.n, 1), 6) as average from (select count(*) n from tracks) t, (select count(distinct track) n from library) i, (select count(*) n from library) f"))
def index_stats(spark, sf):
    t = D.tracks(spark, sf).agg(F.count(F.lit(1)).alias("tracks"))
    f = D.library(spark, sf).agg(F.count_distinct("track").alias("indexed"), F.count(F.lit(1)).alias("fingerprints"))
    return t.crossJoin(f).select("tracks", "indexed", "fingerprints", (F.col("tracks") - F.col("indexed")).alias("missing"), F.round(F.col("fingerprints") / F.greatest("indexed", F.lit(1)), 6).alias("average"))


@query("e3_code_histogram", D.with_("tracks", "select code, count(*) as n from (select unnest(list_filter(string_split(genre, '-'), lambda x: not starts_with(x, '*') and x <> '')) as code from tracks) group by 1"))
def code_histogram(spark, sf):
    return D.tracks(spark, sf).select(F.explode(T.filter_codes(F.col("genre"))).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query("e4_recent_pairs", D.with_("tracks plays", "select artist, genre, max(played_at) as played_at from plays p join tracks t on t.id = p.track_id where completed group by 1, 2 order by 3 desc, 1, 2 limit 20"))
def recent_pairs(spark, sf):
    return L.recent_pairs(D.tracks(spark, sf), D.plays(spark, sf), 20)


@query("e5_duplicate_groups", D.with_("tracks", "select lower(coalesce(title, '')) as k_title, lower(coalesce(artist, '')) as k_artist, count(*) as n, list(id order by id)[1] as first_id from tracks group by 1, 2 having count(*) > 1"))
def duplicate_groups(spark, sf):
    return L.duplicate_groups(D.tracks(spark, sf)).select("k_title", "k_artist", "n", F.element_at("ids", 1).alias("first_id"))


_LABELS = "list_filter(list_distinct(string_split(genre, '-')), lambda x: regexp_full_match(x, '[A-Z]') and x not in ('A', 'C', 'F', 'L', 'R', 'U'))"


@query("e6_label_support", D.with_("tracks", f"select code, count(*) as n from (select unnest({_LABELS}) as code from tracks) group by 1 having count(*) >= 5"))
def label_support(spark, sf):
    return D.tracks(spark, sf).select(F.explode(T.label_codes(F.col("genre"))).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n")).filter("n >= 5")


@query("e9_label_pivot", D.with_("tracks", f"select id, cast(list_contains({_LABELS}, 'B') as int) as label_b, cast(list_contains({_LABELS}, 'S') as int) as label_s, cast(list_contains({_LABELS}, 'W') as int) as label_w from tracks"))
def label_pivot(spark, sf):
    codes = T.label_codes(F.col("genre"))
    return D.tracks(spark, sf).select("id", *[F.array_contains(codes, c).cast("int").alias(f"label_{c.lower()}") for c in "BSW"])


@query("g1_sorted_list", D.with_("tracks", "select id, row_number() over (order by lower(coalesce(title, '')), date_added desc, id) as place from tracks order by place limit 100"))
def sorted_list(spark, sf):
    t = D.tracks(spark, sf).orderBy(*L.sort_key("title"), F.desc("date_added"), "id").limit(100)
    return t.select("id", F.row_number().over(Window.orderBy(*L.sort_key("title"), F.desc("date_added"), "id")).cast("long").alias("place"))


_FIRST = {"artist": "lower(coalesce(artist, ''))", "title": "lower(coalesce(title, ''))", "filename": "lower(coalesce(filename, ''))", "genre": "lower(coalesce(genre, ''))", "duration": "coalesce(duration_seconds, 0)", "rating": "coalesce(try_cast(regexp_extract(genre, '-\\*(\\d+)', 1) as int), 0)", "path": "lower(regexp_extract(filepath, '^(.*)/[^/]*$', 1))", "added": "-epoch(date_added)"}


@query("g1_all_headings", D.with_("tracks", " union all ".join(f"(select '{c}' as heading, id, row_number() over (order by {k}, id) as place from tracks order by place limit 50)" for c, k in _FIRST.items())))
def all_headings(spark, sf):
    lists = [L.sorted_by(D.tracks(spark, sf), c, 50).select(F.lit(c).alias("heading"), "id", F.col("place").cast("long").alias("place")) for c in _FIRST]
    return functools.reduce(DataFrame.unionAll, lists)


@query("e3_dataset_stats", D.with_("tracks", "select count(*) as total_tracks, count(*) filter (genre <> '') as tracks_with_genre, (select count(*) from embeddings) as tracks_with_analysis, (select count(*) from embeddings where label <> 3) as tracks_with_features, count(*) filter (genre <> '' and id in (select vec_id from embeddings where label <> 3)) as usable_for_training from tracks"))
def dataset_stats(spark, sf):
    told = D.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.when(F.col("label") != 3, F.col("label")).alias("rms_mean"))
    return learning.dataset_stats(D.tracks(spark, sf), told, "rms_mean")


@query("g3_random_track", D.with_("tracks", "select id, title from tracks order by md5('7:' || id), id limit 1"))
def random_track(spark, sf):
    return L.random_rows(D.tracks(spark, sf), 1, 7).select("id", "title")


@query("h11_coded", D.with_("tracks", "select t.id, regexp_matches(g, '^([A-Z]+)(-[A-Z]+)*(-\\*[1-5])?$') as coded from (select id, case when id % 3 = 0 then lower(genre) when id % 5 = 0 then genre || '6' else genre end as g from tracks) t"))
def coded(spark, sf):
    g = F.when(F.col("id") % 3 == 0, F.lower("genre")).when(F.col("id") % 5 == 0, F.concat("genre", F.lit("6"))).otherwise(F.col("genre"))
    return D.tracks(spark, sf).select("id", T.is_coded(g).alias("coded"))


@query("g2_random_tracks", D.with_("tracks", "select id, title from tracks order by md5('42:' || id), id limit 10"))
def random_tracks(spark, sf):
    return L.random_rows(D.tracks(spark, sf), 10, 42).select("id", "title")


@query("g4_recommendations")
def recommendations(spark, sf):
    return L.recommend(D.tracks(spark, sf), D.plays(spark, sf), now(), 10, 42).select("id", "artist", "genre")


@query("g6_shared_id_set", "select vec_id as id from embeddings where label < 5 intersect select doc_id from labels")
def shared_id_set(spark, sf):
    return D.table(spark, sf, "embeddings").filter("label < 5").select(F.col("vec_id").alias("id")).intersect(D.table(spark, sf, "labels").select(F.col("doc_id").alias("id")))


@query("g7_distinct_hashes", D.with_("query", "select recording, count(distinct hash) as n from query group by 1"))
def distinct_hashes(spark, sf):
    return D.query(spark, sf).groupBy("recording").agg(F.count_distinct("hash").alias("n"))

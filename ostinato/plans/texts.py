"""Queries of search, filters, text and time functions, duplicates, trees."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import times, vectors
from ..operators import dedup, hierarchy, search, steps, text_index
from . import domain as D
from .registry import query

_WORDS = r"list_filter(string_split_regex(trim(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}_]+', ' ', 'g')), ' +'), lambda x: x <> '')"


_INDEXES: dict[tuple, text_index.TextIndex] = {}


def _text_index(spark, sf) -> text_index.TextIndex:
    """The index of the library's words, in the shared folder: written when these files are first asked for, then read."""
    files = D.table(spark, sf, "part").inputFiles()
    status = [steps.file_status(spark, f) for f in files]
    key = (spark.sparkContext.applicationId, sf, *status)
    if key not in _INDEXES:
        made = text_index.TextIndex(spark, f"{steps.shared_dir(spark)}/words-{uuid.uuid4().hex}")
        made.append(D.tracks(spark, sf), "id", ["title", "artist", "album", "filename"])
        steps.forget_at_exit(spark, made.folder)
        _INDEXES[key] = made
    return _INDEXES[key]


@query(
    "c1_full_text_search",
    D.with_(
        "tracks",
        """, fields as (select id, 'title' as f, title as v from tracks union all select id, 'artist', artist from tracks union all select id, 'album', album from tracks union all select id, 'filename', filename from tracks),
    words as (select id, f, unnest("""
        + _WORDS.format(c="v")
        + """) as w from fields where v is not null),
    size as (select id, count(*) as len from words group by 1), n as (select count(*) as docs, avg(len) as mean from size),
    tf as (select id, w, count(*) as tf from words where w in ('red', 'widget') group by 1, 2), df as (select w, count(*) as df from tf group by 1),
    scored as (select tf.id, count(*) as hits, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) as score from tf join df using (w) join size using (id), n group by 1)
    select id, round(score, 6) as score from scored where hits = 2 order by scored.score desc, id limit 100""",
    ).replace(")\n,", "),"),
)
def full_text_search(spark, sf):
    return _text_index(spark, sf).search('red "widget', 100).select("id", F.round("score", 6).alias("score"))


@query("c1_phrase_search", D.with_("tracks", "select id from tracks where contains(lower(coalesce(title, '')), 'red widget')"))
def phrase_search(spark, sf):
    return search.phrase(search.index(D.tracks(spark, sf), "id", ["title"]), "red widget").select("id")


@query("c2_substring_search", D.with_("tracks", "select id from tracks where contains(lower(concat(artist, ' ', title, ' ', filename)), 'brand#1') and contains(lower(concat(artist, ' ', title, ' ', filename)), 'ring')"))
def substring_search(spark, sf):
    hay = F.concat_ws(" ", "artist", "title", "filename")
    return D.tracks(spark, sf).filter(T.search_words(hay, "Brand#1  RING")).select("id")


_CODES = "list_filter(list_transform(string_split(genre, '-'), lambda x: trim(x)), lambda x: x <> '' and not starts_with(x, '*'))"


@query("c3_code_switches", D.with_("tracks", f"select id from tracks where list_contains({_CODES}, 'R') and not list_contains({_CODES}, 'B')"))
def code_switches(spark, sf):
    return D.tracks(spark, sf).filter(T.code_switches(T.filter_codes(F.col("genre")), ["R"], ["B"])).select("id")


@query("c4_code_expression", D.with_("tracks", f"select id from tracks where (list_contains({_CODES}, 'R') or list_contains({_CODES}, 'B')) and not list_contains({_CODES}, 'W')"))
def code_expression(spark, sf):
    return D.tracks(spark, sf).filter(T.code_expression("(r OR B) and not w", {"R", "B", "W"}, T.filter_codes(F.col("genre")))).select("id")


@query("c5_presets", "select event_id, cast(json_extract_string(props, '$.k') as int) as k from events")
def presets(spark, sf):
    return D.table(spark, sf, "events").select("event_id", F.from_json("props", "map<string,int>")["k"].alias("k"))


@query("c6_under_folder", D.with_("tracks", "select id from tracks where starts_with(filepath, '/music/small/')"))
def under_folder(spark, sf):
    return hierarchy.under(D.tracks(spark, sf), "filepath", "/music/small").select("id")


@query("d11_normalised_names", D.with_("tracks", "select t.id, p.p_partkey as other from tracks t join part p on p.p_name || ' ' || p.p_partkey = replace(regexp_extract(t.filename, ' - (.*)$', 1), '.mp3', '')"))
def normalised_names(spark, sf):
    from ..operators import external

    own = D.tracks(spark, sf).select("id", T.stem(F.regexp_extract("filename", " - (.*)$", 1)).alias("filename"))
    other = D.table(spark, sf, "part").select(F.col("p_partkey").alias("other"), F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("filename"))
    return external.by_name(own, other).select("id", "other")


@query(
    "d11_ambiguous_names",
    "select url_id, max(page_id) as chosen from (select page_id, regexp_extract(url, '^[a-z]+://([^/]*)', 1) as url_id from pages) group by 1",
)
def ambiguous_names(spark, sf):
    from ..operators import external

    pages = D.table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]*)", 1).alias("url_id"), F.col("url").alias("path"))
    own = pages.select("url_id", F.lit("/x/y.mp3").alias("filepath")).distinct()
    return external.resolve(own, pages, "url_id", "page_id", "path").select("url_id", F.col("page_id").alias("chosen"))


@query("e7_folder_counts", D.with_("tracks", "select regexp_extract(filepath, '^(.*)/[^/]*$', 1) as folder, count(*) as n from tracks group by 1"))
def folder_counts(spark, sf):
    return hierarchy.folder_counts(D.tracks(spark, sf), "filepath")


@query(
    "e8_folder_roll_up",
    D.with_(
        "tracks",
        """, d as (select regexp_extract(filepath, '^(.*)/[^/]*$', 1) as folder from tracks), p as (select folder, unnest(['/music', regexp_extract(folder, '^(/music/[^/]*)', 1), folder]) as place from d)
    select place as folder, cast(sum(cast(place = folder as int)) as bigint) as own, count(*) as total from p group by 1""",
    ).replace(")\n,", "),"),
)
def folder_roll_up(spark, sf):
    return hierarchy.roll_up(hierarchy.folder_counts(D.tracks(spark, sf), "filepath"))


@query("h1_normalised_text", r"select doc_id, trim(regexp_replace(regexp_replace(trim(lower(text)), '[^\p{L}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g')) as norm from documents")
def normalised_text(spark, sf):
    return D.table(spark, sf, "documents").select("doc_id", T.normalize(F.col("text")).alias("norm"))


@query("h2_normalised_filename", D.with_("tracks", "select id, trim(regexp_replace(lower(replace(filename, '.mp3', '')), '[^a-z0-9]', ' ', 'g')) as norm from tracks"))
def normalised_filename(spark, sf):
    return D.tracks(spark, sf).select("id", T.normalize_filename(F.col("filename")).alias("norm"))


@query("h3_parsed_filename", D.with_("tracks", "select id, string_split(replace(filename, '.mp3', ''), ' - ')[1] as artist, string_split(replace(filename, '.mp3', ''), ' - ')[2] as title from tracks"))
def parsed_filename(spark, sf):
    return D.tracks(spark, sf).select("id", T.parse_filename(F.col("filename")).alias("p")).select("id", "p.artist", "p.title")


@query("h4_tokens", "select p_partkey, w from (select p_partkey, unnest(list_distinct(list_filter(string_split(p_name, ' '), lambda x: length(x) >= 4))) as w from part)")
def tokens(spark, sf):
    return D.table(spark, sf, "part").select("p_partkey", F.explode(T.tokens(F.col("p_name"), 4)).alias("w"))


@query("h5_display_label", D.with_("tracks", "select id, case when artist is not null and title is not null then artist || ' - ' || title when title is not null then title else filename end || chr(10) || filepath as label from tracks"))
def display_label(spark, sf):
    return D.tracks(spark, sf).select("id", T.display_label(*map(F.col, ("artist", "title", "filename", "filepath"))).alias("label"))


@query("h9_rating", D.with_("tracks", r"select id, cast(regexp_extract(genre, '\*(\d+)', 1) as int) as rating, regexp_matches(genre, '^([A-Z]+)(-[A-Z]+)*(-\*[1-5])?$') as coded from tracks"))
def rating(spark, sf):
    return D.tracks(spark, sf).select("id", T.rating(F.col("genre")).alias("rating"), T.is_coded(F.col("genre")).alias("coded"))


@query(
    "h10_edited_codes",
    D.with_(
        "tracks",
        f"""select id, array_to_string(case when list_contains({_CODES}, 'R') then list_filter({_CODES}, lambda x: x <> 'R') else list_sort(list_append({_CODES}, 'R')) end, '-') || regexp_extract(genre, '(-\\*\\d)', 1) as toggled,
    array_to_string({_CODES}, '-') || case regexp_extract(genre, '\\*(\\d)', 1) when '5' then '' else '-*' || (cast(regexp_extract(genre, '\\*(\\d)', 1) as int) + 1) end as cycled from tracks where genre not like 'R-R%'""",
    ),
)
def edited_codes(spark, sf):
    return D.tracks(spark, sf).filter("genre not like 'R-R%'").select("id", T.toggle_code(F.col("genre"), "R").alias("toggled"), T.cycle_rating(F.col("genre")).alias("cycled"))


@query("h12_first_code", D.with_("tracks", f"select id, list_min(list_filter({_CODES}, lambda x: x not in ('A', 'C', 'F', 'L', 'R', 'U'))) as first from tracks"))
def first_code(spark, sf):
    return D.tracks(spark, sf).select("id", F.array_min(T.label_codes(F.col("genre"))).alias("first"))


_MS = "cast(floor(l_extendedprice) as bigint)"


@query(
    "h13_times",
    f"""with m as (select l_orderkey, l_linenumber, l_partkey, {_MS} as ms from lineitem)
select l_orderkey, l_linenumber, l_partkey, ms, lpad(cast(ms // 60000 as varchar), 2, '0') || ':' || lpad(cast(ms // 1000 % 60 as varchar), 2, '0') as shown,
  lpad(cast(ms // 60000 as varchar), 2, '0') || ':' || lpad(cast(ms // 1000 % 60 as varchar), 2, '0') || ':' || lpad(cast(cast(floor((ms / 1000.0 - floor(ms / 1000.0)) * 75) as int) as varchar), 2, '0') as cue,
  cast(round_even(ms / 1000.0, 0) * 1000 as bigint) as whole, (ms // 1000) * 1000 as back from m""",
)
def times_of(spark, sf):
    m = D.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.floor("l_extendedprice").alias("ms"))
    ms = F.col("ms")
    return m.select("l_orderkey", "l_linenumber", "l_partkey", "ms", times.minutes(ms).alias("shown"), times.cue_time(ms).alias("cue"), times.whole(ms).alias("whole"), times.from_minutes(times.minutes(ms)).alias("back"))


@query("h14_clock", "select o_orderkey, case when s >= 3600 then lpad(cast(s // 3600 as varchar), 2, '0') || ':' else '' end || lpad(cast(s // 60 % 60 as varchar), 2, '0') || ':' || lpad(cast(s % 60 as varchar), 2, '0') as clock from (select o_orderkey, cast(floor(o_totalprice / 50) as bigint) as s from orders)")
def clock(spark, sf):
    return D.table(spark, sf, "orders").select("o_orderkey", times.clock(F.floor(F.col("o_totalprice") / 50) * 1000).alias("clock"))


@query("h17_cue_time_back", "select o_orderkey, cast(floor((m * 60 + s + f / 75.0) * 1000) as bigint) as ms from (select o_orderkey, o_orderkey % 90 as m, o_orderkey % 60 as s, o_orderkey % 75 as f from orders)")
def cue_time_back(spark, sf):
    two = lambda n: F.lpad((F.col("o_orderkey") % n).cast("string"), 2, "0")
    return D.table(spark, sf, "orders").select("o_orderkey", times.from_cue_time(F.concat_ws(":", two(90), two(60), two(75))).alias("ms"))


@query("h19_quotes", r"""select page_id, replace(html, '"', '\"') as escaped, html as back from pages""")
def quotes(spark, sf):
    from ..sources import cue

    p = D.table(spark, sf, "pages")
    return p.select("page_id", cue.escape(F.col("html")).alias("escaped"), cue.unescape(cue.escape(F.col("html"))).alias("back"))


@query("h21_packed_hash", "select l_orderkey, l_linenumber, l_partkey, ((l_partkey % 84) << 25) | ((l_suppkey % 84) << 18) | ((((l_linenumber - 4) + 32) & 63)::bigint << 12) | (least(cast(l_quantity as bigint), 63) << 6) | (l_orderkey % 64) as hash from lineitem")
def packed_hash(spark, sf):
    from ..operators import match

    c = F.col
    return D.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", match.pack_hash(c("l_partkey") % 84, c("l_suppkey") % 84, c("l_quantity").cast("long"), c("l_linenumber") - 4, c("l_orderkey") % 64).alias("hash"))


@query("h23_cosine", D.with_("vectors", "select a.track, round(list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)), 9) as cosine from vectors a, vectors b where b.track = 0"))
def cosine(spark, sf):
    v = D.vectors(spark, sf)
    one = v.filter("track = 0").select(F.col("v").alias("q"))
    return v.crossJoin(F.broadcast(one)).select("track", F.round(vectors.cosine(F.col("v"), F.col("q")), 9).alias("cosine"))


@query("h24_decibel", "select event_id, round(20 * log10(value + 1e-10), 6) as db from events")
def decibel(spark, sf):
    return D.table(spark, sf, "events").select("event_id", F.round(vectors.decibel(F.col("value")), 6).alias("db"))


@query("h25_month_folder", "select o_orderkey, strftime(o_orderdate, '%Y-%m') as month from orders")
def month_folder(spark, sf):
    path = F.concat(F.lit("/music/2024/"), F.date_format("o_orderdate", "yyyy-MM"), F.lit("/x.mp3"))
    return D.table(spark, sf, "orders").select("o_orderkey", T.month_folder(path).alias("month"))


@query("h26_safe_names", "select page_id, regexp_replace(url, '[<>:\"/\\\\|?*]', '_', 'g') as name, left(regexp_replace(html, '[\\x00-\\x1F\\x7F]', '', 'g'), 500) as tag from pages")
def safe_names(spark, sf):
    return D.table(spark, sf, "pages").select("page_id", T.safe_filename(F.col("url")).alias("name"), T.clean_tag(F.col("html")).alias("tag"))


@query("h27_organised_path", D.with_("tracks", "select id, coalesce(artist, 'Unknown Artist') || '/' || album || '/' || lpad(cast(id % 20 as varchar), 2, '0') || ' - ' || coalesce(title, 'Unknown Title') as path from tracks"))
def organised_path(spark, sf):
    return D.tracks(spark, sf).select("id", T.organized_path(F.col("artist"), F.col("album"), F.col("id") % 20, F.col("title")).alias("path"))


@query("h29_fade", "select event_id, round(case when x < 0 or x > 10 then 0 when x < 2 then x / 2 when x > 7 then (10 - x) / 3 else 1 end, 6) as opacity from (select event_id, value / 10 - 1 as x from events)")
def fade(spark, sf):
    return D.table(spark, sf, "events").select("event_id", F.round(times.fade(F.col("value") / 10, 1.0, 10.0, 2.0, 3.0), 6).alias("opacity"))


@query("h30_seek_and_loop", "select event_id, round(least(300.0, value + least(event_id % 8, 5) * 10), 4) as seek, round(greatest(0.0, least(value - 20, 300.0 - 30)), 4) as loop_start from events")
def seek_and_loop(spark, sf):
    e = D.table(spark, sf, "events").select("event_id", "value", F.lit(300.0).alias("duration"))
    return e.select("event_id", F.round(times.seek(F.col("value"), 10.0, F.col("event_id") % 8, F.col("duration")), 4).alias("seek"), F.round(times.loop_window(F.col("value"), F.lit(30.0), F.lit(-20.0), F.col("duration"))["start"], 4).alias("loop_start"))


@query("h31_composed", "select doc_id, nfc_normalize(text) as text from documents")
def composed(spark, sf):
    return D.table(spark, sf, "documents").select("doc_id", T.nfc(F.col("text")).alias("text"))


@query("h32_cache_key", D.with_("tracks", "select id, sha256(filepath || '|' || file_size || '|' || epoch_us(date_added)) as key from tracks"))
def cache_key(spark, sf):
    from ..sources import cache

    return D.tracks(spark, sf).select("id", cache.key(F.col("filepath"), F.col("file_size"), F.unix_micros("date_added")).alias("key"))


@query("dup_exact_passes", D.with_("tracks", """select c.id, case when exists (select 1 from tracks l where l.mode = 'collection' and l.artist is not null and l.title is not null and lower(replace(l.artist, '#', '')) = lower(replace(c.artist, '#', '')) and l.title = c.title) then 'red'
  else 'other' end as status from tracks c where c.mode = 'curating' and c.title is not null and c.artist is not null"""))
def dup_exact_passes(spark, sf):
    t = D.tracks(spark, sf)
    found = dedup.check(t.filter("mode = 'curating' and title is not null and artist is not null"), t, fuzzy=False)
    return found.select("id", F.when(F.col("status") == "red", "red").otherwise("other").alias("status"))


@query("dup_check")
def dup_check(spark, sf):
    t = D.tracks(spark, sf)
    return dedup.check(t.filter("mode = 'curating'"), t).select("id", "status", "match_info")


@query("d14_shared_tokens", "with w as (select p_partkey as id, unnest(list_distinct(string_split(p_name || ' ' || p_type, ' '))) as w from part) select a.id as a, b.id as b, count(*) as shared from w a join w b on a.w = b.w and a.id < b.id group by 1, 2 having count(*) >= 3")
def shared_tokens(spark, sf):
    t = D.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.split(F.concat_ws(" ", "p_name", "p_type"), " ").alias("tokens"))
    return dedup.shared_tokens(t, t, 3).filter("a < b")


@query("changed_statuses", "select doc_id, quality as now from (select doc_id, quality, lag(quality) over (order by doc_id) as before from labels) where before is null or before <> quality")
def changed_statuses(spark, sf):
    own = steps.lagged(D.table(spark, sf, "labels").select("doc_id", F.col("quality").alias("now")), ["doc_id"], "now", "before")
    return dedup.changed(own, "before", "now").select("doc_id", "now")

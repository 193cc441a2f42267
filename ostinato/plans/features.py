"""Queries of series statistics, learning, streams and export."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import external, frames, learning
from ..streaming import beats, events
from . import domain as D
from .registry import query


def _series(spark, sf):
    return D.table(spark, sf, "events").select("user_id", "event_id", "value")


@query(
    "i1_series_statistics",
    """with p as (select user_id, value, row_number() over (partition by user_id order by event_id) - 1 as i, value / (sum(value) over (partition by user_id) + 1e-10) as p from events)
select user_id, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as sd, round(quantile_cont(value, 0.1), 6) as p10, round(quantile_cont(value, 0.9), 6) as p90, round(median(value), 6) as median, round(regr_slope(value, i), 6) as slope, round(-sum(p * ln(p + 1e-10)), 6) as entropy, max(value) as peak from p group by 1""",
)
def series_statistics(spark, sf):
    found = frames.statistics(_series(spark, sf), "user_id", "event_id", "value")
    return found.select("user_id", "peak", *[F.round(c, 6).alias(c) for c in ("mean", "sd", "p10", "p90", "median", "slope", "entropy")])


@query("i3_band_levels", "select user_id, round(coalesce(avg(value * value) filter (hz >= 60 and hz < 150), 0), 6) as bass, round(coalesce(avg(value * value) filter (hz >= 500 and hz < 2000), 0), 6) as mid, round(coalesce(avg(value * value) filter (hz >= 500 and hz < 2000), 0) / avg(value * value), 6) as mid_ratio from (select *, event_id % 20000 as hz from events) group by 1")
def band_levels(spark, sf):
    e = _series(spark, sf).withColumn("hz", F.col("event_id") % 20000).withColumn("power", F.col("value") * F.col("value"))
    return frames.band_levels(e, ["user_id"], "hz", "power").select("user_id", F.round("bass", 6).alias("bass"), F.round("mid", 6).alias("mid"), F.round("mid_ratio", 6).alias("mid_ratio"))


@query("i4_structure", "with r as (select user_id, value, row_number() over (partition by user_id order by event_id) - 1 as i, count(*) over (partition by user_id) as n from events) select user_id, round(avg(value) filter (i < trunc(n * 0.2::double)) / avg(value), 6) as intro_ratio, round(avg(value) filter (i >= trunc(n * 0.2::double) and i < trunc(n * 0.8::double)) / avg(value), 6) as core_ratio, round(avg(value) filter (i >= trunc(n * 0.8::double)) / avg(value), 6) as outro_ratio from r group by 1")
def structure(spark, sf):
    return frames.structure(_series(spark, sf), "user_id", "event_id", "value").select("user_id", *[F.round(c, 6).alias(c) for c in ("intro_ratio", "core_ratio", "outro_ratio")])


@query("i7_frame_levels", "select user_id, event_id // 500 as frame, round(sqrt(avg(value * value)), 6) as rms from events group by 1, 2")
def frame_levels(spark, sf):
    return frames.rms(_series(spark, sf), ["user_id"], "value", F.expr("event_id div 500")).withColumn("rms", F.round("rms", 6))


@query("i9_envelope", 'with r as (select user_id, value, row_number() over (partition by user_id order by event_id) - 1 as i, count(*) over (partition by user_id) as n from events) select user_id, cast(floor(i * 20 / n) as int) as "column", max(abs(value)) as peak from r group by 1, 2')
def envelope(spark, sf):
    e = _series(spark, sf).withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1)
    return frames.envelope(e, ["user_id"], "i", "value", 20)


@query(
    "d18_effects",
    D.with_("tracks", "select id, coalesce(list_transform(list_filter(string_split(genre, '-'), lambda x: x in ('R', 'B')), lambda x: case x when 'R' then 'fire' else 'rain' end)[1], 'wave') as first_effect from tracks"),
)
def effects(spark, sf):
    rows = D.tracks(spark, sf).select("id", F.posexplode_outer(T.filter_codes(F.col("genre"))).alias("pos", "code"))
    mapping = spark.createDataFrame([("R", "fire"), ("B", "rain")], "code string, effect string")
    met = rows.join(F.broadcast(mapping), "code", "left").groupBy("id").agg(F.min_by("effect", F.when(F.col("effect").isNotNull(), F.col("pos"))).alias("e"))
    return met.select("id", F.coalesce("e", F.lit("wave")).alias("first_effect"))


def _labelled(spark, sf):
    return D.table(spark, sf, "labels").select(F.col("doc_id").alias("row"), F.explode(F.array(F.struct(F.lit("all").alias("label"), F.col("quality").alias("y"), (1 - F.col("toxic")).alias("yhat")), F.struct(F.lit("bad").alias("label"), F.col("toxic").alias("y"), (1 - F.col("quality")).alias("yhat")))).alias("c")).select("row", "c.*")


_CELLS = "with c as (select doc_id as row, 'all' as label, quality as y, 1 - toxic as yhat from labels union all select doc_id, 'bad', toxic, 1 - quality from labels)"


@query(
    "e16_metrics",
    _CELLS
    + """, t as (select row, label, y, y * yhat as tp, (1 - y) * yhat as fp, y * (1 - yhat) as fn from c),
l as (select label, coalesce(2.0 * sum(tp) / nullif(2 * sum(tp) + sum(fp) + sum(fn), 0), 0) as f1, sum(y) as support from t group by 1),
r as (select row, coalesce(2.0 * sum(tp) / nullif(2 * sum(tp) + sum(fp) + sum(fn), 0), 0) as f1, sum(fp) + sum(fn) = 0 as exact from t group by 1)
select round(avg(fp + fn), 9) as hamming_loss, round(2.0 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 9) as f1_micro, round(sum(tp) / (sum(tp) + sum(fp)), 9) as precision_micro, round(sum(tp) / (sum(tp) + sum(fn)), 9) as recall_micro,
 (select round(avg(f1), 9) from l) as f1_macro, (select round(sum(f1 * support) / sum(support), 9) from l) as f1_weighted, (select round(avg(f1), 9) from r) as f1_samples, (select round(avg(cast(exact as int)), 9) from r) as subset_accuracy from t""",
)
def metrics(spark, sf):
    found = learning.metrics(_labelled(spark, sf))
    return found.select(*[F.round(c, 9).alias(c) for c in found.columns])


@query("e16_metrics_by_label", _CELLS + " select label, round(coalesce(sum(y * yhat) / nullif(sum(yhat), 0), 0), 9) as precision, round(sum(y * yhat) / sum(y), 9) as recall, round(2.0 * sum(y * yhat) / (sum(y) + sum(yhat)), 9) as f1, sum(y) as support from c group by 1 having sum(y) > 0")
def metrics_by_label(spark, sf):
    return learning.per_label(_labelled(spark, sf)).select("label", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support")


_STATS = ["p_size", "p_retailprice"]


@query("j1_training_set", D.with_("tracks", "select id, list_contains(string_split(genre, '-'), 'B')::int as y_B, list_contains(string_split(genre, '-'), 'W')::int as y_W from tracks where regexp_matches(genre, '(^|-)[BDEGHIJKMNOPQSTVWXYZ](-|$)')"))
def training_set(spark, sf):
    numbers = D.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), *[F.col(c).cast("double").alias(c) for c in _STATS])
    return learning.training_set(D.tracks(spark, sf), numbers, 5)[0].select("id", "y_B", "y_W")


@query(
    "j2_scaled",
    "with p as (select p_partkey, case when p_partkey % 10 = 0 then null else p_retailprice end as x from part), m as (select median(x) as med from p), f as (select p_partkey, coalesce(x, med) as x from p, m), s as (select avg(x) as mean, stddev_pop(x) as sd from f) select p_partkey, round((x - mean) / sd, 6) as x from f, s",
)
def scaled(spark, sf):
    p = D.table(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 10 != 0, F.col("p_retailprice")).alias("x"))
    return learning.Scaler(["x"]).fit(p).transform(p).withColumn("x", F.round("x", 6))


def _model(spark, sf, name, **how):
    numbers = D.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("a"), F.length("p_name").cast("double").alias("b"), F.ascii("p_name").cast("double").alias("c"))
    rows, labels = learning.training_set(D.tracks(spark, sf), numbers, 5)
    train, test = learning.split(rows, "id")
    scaler = learning.Scaler(["a", "b", "c"]).fit(train)
    return learning.LabelModels(name, ["a", "b", "c"], labels, **how).fit(scaler.transform(train)), scaler.transform(test)


@query("j4_random_forest")
def random_forest(spark, sf):
    model, test = _model(spark, sf, "random_forest", numTrees=10, maxDepth=5)
    p = F.col("probabilities")
    return model.predict_proba(test).select("id", learning.predicted(p).alias("labels"), learning.top_n(p, 2).alias("top"))


@query("j5_boosted_trees_metrics")
def boosted_trees_metrics(spark, sf):
    model, test = _model(spark, sf, "boosted_trees", maxIter=5, maxDepth=3)
    return learning.evaluate(model, test)


@query("j6_linear_svm_metrics")
def linear_svm_metrics(spark, sf):
    model, test = _model(spark, sf, "linear_svm", maxIter=20)
    return learning.evaluate(model, test)


@query("j6_radial_svm_metrics")
def radial_svm_metrics(spark, sf):
    model, test = _model(spark, sf, "svm", maxIter=10, size=64)
    return learning.evaluate(model, test)


@query("e17_importances")
def importances(spark, sf):
    model, _ = _model(spark, sf, "random_forest", numTrees=10, maxDepth=5)
    return spark.createDataFrame([(i + 1, n, x) for i, (n, x) in enumerate(model.importances())], "rank int, feature string, importance double")


@query("b13_export_lists", "select l_orderkey as list_id, count(*) as entries, cast(1 as bigint) as tails, cast(0 as bigint) as dangling from lineitem group by 1")
def export_lists(spark, sf):
    e = D.entries(spark, sf).select(F.col("playlist_id").alias("list_id"), "track_id", F.col("at").alias("position"))
    return external.verify(external.linked(e)).select("list_id", "entries", "tails", "dangling")


@query("k4_beats")
def beat_frames(spark, sf):
    top = Window.partitionBy("user_id")
    e = _series(spark, sf).withColumn("level", F.col("value") / F.max("value").over(top))
    return beats.beats_of_levels(e, "user_id", "event_id", "level")


@query("k1_band_features")
def band_features(spark, sf):
    frames_ = D.table(spark, sf, "embeddings").select(F.col("label").cast("string").alias("source"), F.col("vec_id").alias("frame"), F.transform("embedding", lambda x: x.cast("double")).alias("samples"))
    return beats.batch(frames_)


@query("k7_latest_updates", "select user_id, event_id, value from events qualify row_number() over (partition by user_id order by event_id desc) = 1")
def latest_updates(spark, sf):
    return events.latest(D.table(spark, sf, "events").select("user_id", "event_id", "value"), "user_id", "event_id")


@query("k8_work_queue", "select p_partkey as item, row_number() over (order by case when p_partkey % 100 = 7 then 0 else 1 end, case when p_partkey % 100 = 7 then -p_partkey else p_partkey end) as place from part")
def work_queue(spark, sf):
    p = D.table(spark, sf, "part").select(F.col("p_partkey").alias("item"), F.col("p_partkey").alias("at"))
    return events.queue(p, p.filter("item % 100 = 7"))


@query("k9_needing_work", "select doc_id from documents where doc_id not in (select doc_id from labels)")
def needing_work(spark, sf):
    return events.needing_work(D.table(spark, sf, "documents").select("doc_id"), D.table(spark, sf, "labels"), "doc_id")


@query("windowed_counts", "select time_bucket(interval 5 minute, ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def windowed_counts(spark, sf):
    e = D.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return events.windowed_counts(e).withColumn("total", F.round("total", 4))


@query("sessions", 'with g as (select user_id, ts, coalesce(ts - lag(ts) over w >= interval 2 hour, true) as new from events window w as (partition by user_id order by ts)), s as (select *, sum(new::int) over (partition by user_id order by ts rows unbounded preceding) as s from g) select user_id, min(ts) as start, max(ts) + interval 2 hour as "end", count(*) as n from s group by user_id, s')
def sessions(spark, sf):
    return events.sessions(D.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "2 hours")


@query("j9_encoded_labels", D.with_("tracks", "select id, list_transform(['B', 'S', 'W'], lambda c: list_contains(string_split(genre, '-'), c)::int)::varchar as bits from tracks"))
def encoded_labels(spark, sf):
    bits = learning.encode(T.label_codes(F.col("genre")), ["B", "S", "W"])
    back = learning.decode(bits, ["B", "S", "W"])
    rows = D.tracks(spark, sf).select("id", F.concat(F.lit("["), F.array_join(bits.cast("array<string>"), ", "), F.lit("]")).alias("bits"), (F.size(back) == F.aggregate(bits, F.lit(0), lambda a, x: a + x)).alias("same"))
    return rows.filter("same").drop("same")


@query("i8_band_spectrum", "with x as (select vec_id, unnest(embedding) as v, generate_subscripts(embedding, 1) as i from embeddings), b as (select vec_id, (i - 1) // 2 as band, avg(abs(v::double)) as level from x group by 1, 2) select vec_id, band, round(level / max(level) over (), 6) as level from b")
def band_spectrum(spark, sf):
    x = D.table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    bands = x.groupBy("vec_id", F.expr("cast(i div 2 as bigint)").alias("band")).agg(F.avg(F.abs(F.col("v").cast("double"))).alias("level"))
    top = bands.agg(F.max("level").alias("top"))
    return bands.crossJoin(F.broadcast(top)).select("vec_id", "band", F.round(F.col("level") / F.col("top"), 6).alias("level"))


@query("f7_ranked_in_group", "select label, vec_id, rank from (select label, vec_id, row_number() over (partition by label order by list_sum(embedding) desc, vec_id) as rank from embeddings) where rank <= 3")
def ranked_in_group(spark, sf):
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    e = D.table(spark, sf, "embeddings").select("label", "vec_id", total.alias("s"))
    w = Window.partitionBy("label").orderBy(F.desc("s"), "vec_id")
    return e.withColumn("rank", F.row_number().over(w).cast("long")).filter("rank <= 3").select("label", "vec_id", "rank")


@query("h22_frame_times", "select o_orderkey, cast(trunc(o_orderkey * 512.0::double / 22050 * 1000) as bigint) as ms from orders")
def frame_times(spark, sf):
    return D.table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") * F.lit(512.0) / 22050 * 1000).cast("long").alias("ms"))


@query("h28_sizes", "select p_partkey, case when n >= 1048576 then round(n / 1048576, 1)::varchar || ' MB' when n >= 1024 then round(n / 1024, 1)::varchar || ' KB' else n::varchar || ' B' end as shown from (select p_partkey, p_size::bigint * p_partkey as n from part)")
def sizes(spark, sf):
    return D.table(spark, sf, "part").select("p_partkey", T.size_display(F.col("p_size").cast("long") * F.col("p_partkey")).alias("shown"))


@query("a6_first_tags", "select p_partkey, case when p_partkey % 2 = 0 then p_name else p_brand end as title, try_cast(left(cast(1990 + p_size as varchar) || '-05', 4) as int) as year, p_size as track from part")
def first_tags(spark, sf):
    from ..sources import files

    text = lambda c: F.col(c).cast("string")
    tags = F.map_filter(F.create_map(F.lit("TIT2"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")), F.lit("title"), F.col("p_brand"), F.lit("date"), F.concat((F.lit(1990) + F.col("p_size")).cast("string"), F.lit("-05")), F.lit("TRCK"), F.concat(text("p_size"), F.lit("/12"))), lambda k, v: v.isNotNull())
    return D.table(spark, sf, "part").select("p_partkey", files.first_tag(tags, ("TIT2", "title")).alias("title"), files.year_of(files.first_tag(tags, ("TDRC", "date"))).alias("year"), files.track_of(files.first_tag(tags, ("TRCK",))).alias("track"))


@query("scoring_formulas", D.with_("vectors", "select a.track, round(list_distance(a.v, q.v), 6) as euclidean, round(list_dot_product(a.v, q.v), 6) as dot from vectors a, vectors q where q.track = 0"))
def scoring_formulas(spark, sf):
    from ..operators import index

    v = D.vectors(spark, sf)
    one = v.filter("track = 0").select(F.col("v").alias("q"))
    return index.scoring_formulas(v.crossJoin(F.broadcast(one))).select("track", F.round("euclidean", 6).alias("euclidean"), F.round("dot", 6).alias("dot"))


@query(
    "scoring_formulas_all",
    D.with_("vectors", "select a.track, round(list_dot_product(a.v, q.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(q.v, q.v)), 6) as cosine, round(1 / (1 + list_distance(a.v, q.v)), 6) as inverse_distance, round(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: abs(a.v[i] - q.v[i]))), 6) as manhattan, round(least(sqrt(list_dot_product(a.v, a.v)), sqrt(list_dot_product(q.v, q.v))), 6) as least_norm from vectors a, vectors q where q.track = 0"),
)
def all_scoring_formulas(spark, sf):
    from ..operators import index

    v = D.vectors(spark, sf)
    one = v.filter("track = 0").select(F.col("v").alias("q"))
    return index.scoring_formulas(v.crossJoin(F.broadcast(one))).select("track", *[F.round(c, 6).alias(c) for c in ("cosine", "inverse_distance", "manhattan", "least_norm")])


@query("v5_vector_match")
def vector_match(spark, sf):
    from ..operators import index

    v = D.vectors(spark, sf)
    halves = v.select("track", F.slice("v", 1, 40).alias("m"), F.slice("v", 41, 24).alias("c"))
    w = Window.partitionBy("label").orderBy("vec_id")
    f = D.table(spark, sf, "embeddings").select(F.col("label").cast("long").alias("recording"), (F.row_number().over(w) - 1).alias("frame"), F.transform(F.slice("embedding", 1, 8), lambda x: x.cast("double")).alias("v"))
    asked = f.filter("recording = 0").select(F.col("frame").alias("i"), F.col("v").alias("qv"))
    return index.match_by_vectors(halves, halves.filter("track = 0").select("m", "c"), {"all": f}, {"all": asked}, {"all": 0.2}, step=1, overlap=1).withColumn("confidence", F.round("confidence", 6))

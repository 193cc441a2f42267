"""Queries of audio features: embeddings as spectra (a label is a recording, its vectors are frames), events as strengths."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import spectral
from . import domain as D
from .registry import query

_FRAMES = "f as (select label as recording, row_number() over (partition by label order by vec_id) - 1 as frame, embedding from embeddings)"
_SPECTRUM = _FRAMES + ", s as (select recording, frame, generate_subscripts(embedding, 1) - 1 as bin, abs(cast(unnest(embedding) as double)) as m from f)"


def _spectrum(spark, sf):
    frame = (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).alias("frame")
    rows = D.table(spark, sf, "embeddings").select(F.col("label").alias("recording"), frame, "embedding")
    return rows.select("recording", "frame", F.posexplode("embedding").alias("bin", "v")).select("recording", "frame", "bin", F.abs(F.col("v").cast("double")).alias("magnitude"))


@query(
    "i1_harmonic_percussive",
    f"""with {_SPECTRUM},
t as (select *, max(frame) over (partition by recording) + 1 as nf, max(bin) over (partition by recording, frame) + 1 as nb from s),
along as (select *, frame as pos from t union all select *, -1 - frame from t where frame < 3 union all select *, 2 * nf - 1 - frame from t where frame >= nf - 3),
h as (select *, median(m) over (partition by recording, bin order by pos rows between 3 preceding and 3 following) as h from along),
across as (select recording, frame, bin, m, h, nb, bin as pos2 from h where pos = frame),
wide as (select * from across union all select recording, frame, bin, m, h, nb, -1 - bin from across where bin < 3 union all select recording, frame, bin, m, h, nb, 2 * nb - 1 - bin from across where bin >= nb - 3),
p as (select *, median(m) over (partition by recording, frame order by pos2 rows between 3 preceding and 3 following) as p from wide)
select recording, frame, bin, round(m * case when h * h + p * p > 0 then h * h / (h * h + p * p) else 0.5 end, 9) as harmonic from p where pos2 = bin""",
)
def harmonic_percussive(spark, sf):
    found = spectral.separate(_spectrum(spark, sf), reach=3)
    return found.select("recording", F.col("frame").cast("long").alias("frame"), F.col("bin").cast("long").alias("bin"), F.round("harmonic", 9).alias("harmonic"))


@query("i1_cepstrum", f"with {_SPECTRUM}, k as (select unnest(range(10)) as coefficient) select recording, frame, coefficient, round(sum(m * sqrt(case when coefficient = 0 then 1 else 2 end / 64.0::double) * cos(pi() * coefficient * (bin + 0.5::double) / 64)), 6) as value from s, k group by 1, 2, 3")
def cepstrum(spark, sf):
    levels = _spectrum(spark, sf).select("recording", "frame", F.col("bin").alias("mel"), F.col("magnitude").alias("level"))
    found = spectral.cepstrum(levels, "recording", 10, 64)
    return found.select("recording", F.col("frame").cast("long").alias("frame"), F.col("coefficient").cast("long").alias("coefficient"), F.round("value", 6).alias("value"))


@query(
    "i1_contrast",
    f"""with {_SPECTRUM}, r as (select recording, frame, bin // 16 as band, m, row_number() over (partition by recording, frame, bin // 16 order by m) as r from s),
e as (select recording, frame, band, 10 * log10(greatest(avg(m) filter (r <= 2), 1e-10)) as valley, 10 * log10(greatest(avg(m) filter (r > 14), 1e-10)) as peak from r group by 1, 2, 3)
select recording, frame, band, round(greatest(peak, max(peak) over (partition by recording) - 80) - greatest(valley, max(valley) over (partition by recording) - 80), 6) as contrast from e""",
)
def contrast(spark, sf):
    found = spectral.contrast(_spectrum(spark, sf), "recording", [(b, b // 16, 1.0) for b in range(64)], 0.125)
    return found.select("recording", F.col("frame").cast("long").alias("frame"), F.col("band").cast("long").alias("band"), F.round("contrast", 6).alias("contrast"))


@query(
    "i1_tonal_centre",
    f"""with {_SPECTRUM}, c as (select recording, frame, bin % 12 as pitch, sum(m) as level from s group by 1, 2, 3), w as (select *, level / sum(level) over (partition by recording, frame) as share from c),
a(axis, r, step, turn) as (values (0, 1.0::double, 7 / 6.0::double, 0.5::double), (1, 1.0, 7 / 6.0::double, 0), (2, 1.0, 1.5, 0.5), (3, 1.0, 1.5, 0), (4, 0.5, 2 / 3.0::double, 0.5), (5, 0.5, 2 / 3.0::double, 0))
select recording, frame, axis, round(sum(share * r * cos(pi() * (step * pitch - turn))), 6) as value from w, a group by 1, 2, 3""",
)
def tonal_centre(spark, sf):
    pitches = _spectrum(spark, sf).groupBy("recording", "frame", (F.col("bin") % 12).alias("pitch")).agg(F.sum("magnitude").alias("level"))
    found = spectral.tonnetz(pitches, "recording")
    return found.select("recording", F.col("frame").cast("long").alias("frame"), "axis", F.round("value", 6).alias("value"))


def _strengths(spark, sf):
    e = D.table(spark, sf, "events")
    return e.select("user_id", (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).alias("frame"), F.col("value").alias("strength"))


_STRENGTHS = "e as (select user_id, row_number() over (partition by user_id order by event_id) - 1 as frame, value as x from events)"


@query(
    "i2_tempogram",
    f"""with {_STRENGTHS}, l as (select unnest(range(8)) as lag), p as (select a.user_id, lag, a.frame, a.x * b.x as p from e a, l, e b where b.user_id = a.user_id and b.frame = a.frame + lag),
w as (select f.user_id, f.frame, l.lag, coalesce(sum(p.p) filter (p.frame >= f.frame - 4 and p.frame + l.lag < f.frame + 4), 0) as s from e f cross join l left join p on p.user_id = f.user_id and p.lag = l.lag and p.frame between f.frame - 4 and f.frame + 3 group by 1, 2, 3)
select user_id, round(avg(case when z.s > 0 then w.s / z.s else 0 end), 6) as periodicity from w join (select user_id, frame, s from w where lag = 0) z using (user_id, frame) group by 1""",
)
def tempogram(spark, sf):
    return spectral.tempogram(_strengths(spark, sf), "user_id", 8).groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("periodicity"))


@query(
    "i1_tempo",
    f"with {_STRENGTHS}, l as (select unnest(range(4, 13)) as lag), p as (select a.user_id, lag, sum(a.x * b.x) * exp(-0.5 * power(log2(1200.0::double / lag / 120), 2)) as w from e a, l, e b where b.user_id = a.user_id and b.frame = a.frame + lag group by 1, 2) select user_id, cast(lag as int) as lag, round(1200.0::double / lag, 6) as tempo from p where w > 0 qualify row_number() over (partition by user_id order by w desc, lag) = 1",
)
def tempo(spark, sf):
    # twenty frames a second
    return spectral.tempo(_strengths(spark, sf), "user_id", 20, 1, 120.0, (100.0, 300.0)).withColumn("tempo", F.round("tempo", 6))

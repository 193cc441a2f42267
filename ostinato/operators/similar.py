"""Vector similarity: screening, ranks, and how long recordings stay alike."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import as_strided
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V


def screen(library: DataFrame, asked: DataFrame, n: int = 200) -> DataFrame:
    """The n tracks nearest to one query (m, c): mean of the cosines of both halves, ties by track. The query is one row."""
    one = asked.select(F.col("m").alias("qm"), F.col("c").alias("qc")).limit(1)
    score = (V.cosine(F.col("m"), F.col("qm")) + V.cosine(F.col("c"), F.col("qc"))) / 2
    return library.crossJoin(F.broadcast(one)).withColumn("score", score).filter("score is not null").orderBy(F.desc("score"), "track").limit(n)


def ranks(library: DataFrame, asked: DataFrame, wanted: list[int]) -> DataFrame:
    """Places of given tracks in the screening: one more than how many are nearer."""
    rated = library.crossJoin(F.broadcast(asked.limit(1))).select("track", V.cosine(F.col("v"), F.col("q")).alias("s")).filter("s is not null")
    own = rated.filter(F.col("track").isin(wanted)).select(F.col("track").alias("own"), F.col("s").alias("own_s"))
    ahead = (F.col("s") > F.col("own_s")) | ((F.col("s") == F.col("own_s")) & (F.col("track") < F.col("own")))
    met = F.broadcast(own).join(rated, ahead, "left")
    return met.groupBy(F.col("own").alias("track")).agg((F.count("track") + 1).alias("rank"))


def _dense(vectors) -> np.ndarray:
    """The rows of a list column without nulls, all of one size."""
    flat = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def _greatest(key: tuple, both: pa.Table) -> pa.Table:
    """Each track's largest product with a block of windows, which have no id."""
    tracks, windows = both.filter(pc.is_valid(both["at"])), both.filter(pc.is_null(both["at"]))
    if not tracks.num_rows or not windows.num_rows:
        return pa.table({"at": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
    u, q = _dense(tracks["u"]), _dense(windows["u"]).T
    best = [(u[k : k + 256] @ q).max(axis=1) for k in range(0, len(u), 256)]
    return pa.table({"at": tracks["at"].combine_chunks(), "score": pa.array(np.concatenate(best))})


def windowed(library: DataFrame, windows: DataFrame, block: int = 4096) -> DataFrame:
    """Per track the largest cosine over the query's windows, null where no vector has a length.

    Tracks and windows are dealt to blocks, and each pair of blocks meets once
    as a product of matrices: all is looked at, a row a track and block leaves
    it. Vectors are brought to length one before they meet, those of different
    sizes don't meet.
    """
    rows = library.select("track", F.col("v").alias("u"), F.xxhash64("track", "v").alias("at"))
    own = rows.filter(V.norm(F.col("u")) > 0).select("at", V.unit(F.col("u")).alias("u")).withColumn("dim", F.size("u"))
    long = windows.filter(V.norm(F.col("q")) > 0).select(V.unit(F.col("q")).alias("u")).withColumn("dim", F.size("u"))
    of_windows, of_tracks = -(-long.count() // block), -(-own.count() // block)
    if not of_windows or not of_tracks:
        return library.select("track", F.lit(None).cast("double").alias("score")).distinct()

    def dealt(df: DataFrame, c: str, side: str, blocks: int, other: str, others: int) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other)
        return df.select("*", F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int").alias(side), every)

    left = dealt(own.dropDuplicates(["at"]), "at", "g", of_tracks, "h", of_windows).select("at", "dim", "g", "h", "u")
    right = dealt(long, "u", "h", of_windows, "g", of_tracks).select(F.lit(None).cast("long").alias("at"), "dim", "g", "h", "u")
    best = left.unionAll(right).groupBy("dim", "g", "h").applyInArrow(_greatest, "at long, score double").groupBy("at").agg(F.max("score").alias("score"))
    return rows.join(best, "at", "left").groupBy("track").agg(F.max("score").alias("score"))


def sustained_runs(frames: DataFrame, asked: DataFrame, threshold: float, step: int = 15, overlap: int = 30, band: int = 256, block: int = 8192) -> DataFrame:
    """Per recording the longest run of frames alike at one offset: run, its mean cosine, off.

    frames: recording, frame, v; asked: i, qv, one query. Offsets are every
    step-th from overlap - n on; the shorter overlaps than `overlap` don't count.
    """
    return variant_runs(frames, asked.withColumn("variant", F.lit(0)), threshold, step, overlap, band, block).drop("variant")


class _Rows:
    """Rows of numbered vectors of a block without gaps: those that it lacks are NaN, which is alike to nothing."""

    def __init__(self, at: np.ndarray, vectors: np.ndarray):
        self.first, self.n = int(at.min()), int(at.max() - at.min()) + 1
        self.raw = np.full((self.n, vectors.shape[1]), np.nan)
        self.raw[at - self.first] = vectors
        total = np.zeros(self.n)
        for d in range(vectors.shape[1]):
            total = total + self.raw[:, d] * self.raw[:, d]
        self.norm = np.sqrt(total)
        self.unit = self.raw / self.norm[:, None]


def _cosines(f: _Rows, q: _Rows, frame: np.ndarray, i: np.ndarray) -> np.ndarray:
    """Of given pairs, summed in order of the components, so that equal vectors have equal cosines wherever they stand."""
    a, b, total = f.raw[frame - f.first], q.raw[i - q.first], np.zeros(len(i))
    for d in range(a.shape[1]):
        total = total + a[:, d] * b[:, d]
    return total / (f.norm[frame - f.first] * q.norm[i - q.first])


def _band(f: _Rows, q: _Rows, off: int, step: int, many: int, threshold: float, padded: np.ndarray, pad: int) -> tuple[int, np.ndarray] | None:
    """The first i, and for `many` offsets from off on, a row each, which frames are alike; a last column is empty."""
    lo, hi = max(q.first, f.first - off - (many - 1) * step), min(q.first + q.n, f.first + f.n - off)
    if lo >= hi:
        return None
    good = np.zeros((many, hi - lo + 1), bool)
    for c in range(lo, hi, 256):
        m = min(256, hi - c)
        begin = c + off - f.first + pad
        rows, asked = padded[begin : begin + m + (many - 1) * step], q.unit[c - q.first : c - q.first + m]
        if step == 1:  # an offset's pairs stand along a diagonal of the product
            made = rows @ asked.T
            cos = as_strided(made, (many, m), (made.strides[0], sum(made.strides)), writeable=False)
        else:
            each = as_strided(rows, (many, m, rows.shape[1]), (step * rows.strides[0], *rows.strides), writeable=False)
            cos = np.einsum("kmd,md->km", each, asked)
        part = good[:, c - lo : c - lo + m]
        np.greater_equal(cos, threshold - 1e-9, out=part)
        k, at = np.nonzero(part & (cos < threshold + 1e-9))
        if len(k):
            part[k, at] = _cosines(f, q, c + at + off + k * step, c + at) >= threshold
    return lo, good


def _runs(f: _Rows, q: _Rows, n: int, threshold: float, step: int, overlap: int, band: int, block: int) -> list[np.ndarray]:
    """off, i, run, total of the runs of two blocks: all that begin or end where the blocks do, and of the others the best one."""
    pad = (band - 1) * step
    padded = np.full((f.n + 2 * pad, f.unit.shape[1]), np.nan)
    padded[pad : pad + f.n] = f.unit
    first = overlap - n
    first += max(0, -(-(f.first - q.first - q.n + 1 - first) // step)) * step
    out, best, longest = [], None, 1
    for off in range(first, f.first + f.n - q.first, band * step):
        found = _band(f, q, off, step, band, threshold, padded, pad)
        if found is None:
            continue
        lo, good = found
        flat, width = good.ravel(), good.shape[1]
        before = np.empty_like(flat)
        before[0], before[1:] = False, flat[:-1]
        starts, ends = np.flatnonzero(flat & ~before), np.flatnonzero(before & ~flat)
        run = ends - starts
        k, at = np.divmod(starts, width)
        offs, i = off + k * step, lo + at
        loose = (i % block == 0) | ((i + run) % block == 0) | ((i + offs) % block == 0) | ((i + offs + run) % block == 0)
        longest = max(longest, int(run[~loose].max(initial=0)))
        kept = np.flatnonzero(loose | (run >= longest))
        if not len(kept):
            continue
        offs, i, run, loose = offs[kept], i[kept], run[kept], loose[kept]
        begin = np.cumsum(run) - run
        each = np.arange(run.sum()) + np.repeat(i - begin, run)
        total = np.add.reduceat(_cosines(f, q, each + np.repeat(offs, run), each), begin)
        own = np.flatnonzero(~loose)
        if len(own):
            top = own[np.lexsort((offs[own], -total[own] / run[own], -run[own]))[0]]
            told = (-int(run[top]), -total[top] / run[top], int(offs[top]), int(i[top]), total[top])
            best = told if best is None else min(best, told)
        out.append(np.stack([x[loose].astype(np.float64) for x in (offs, i, run, total)]))
    if best is not None:
        out.append(np.array([[best[2]], [best[3]], [-best[0]], [best[4]]], np.float64))
    return out


def variant_runs(frames: DataFrame, asked: DataFrame, threshold: float, step: int = 15, overlap: int = 30, band: int = 256, block: int = 8192) -> DataFrame:
    """sustained_runs for each variant of a query (variant, i, qv), numbered from 0, all at once: variant, recording, run, mean, off.

    Frames and query are cut into blocks of consecutive ones, and each pair of
    blocks meets in one group, where all offsets are looked at, `band` of them
    at once, as products of matrices. No pair of frames leaves it: of a pair of
    blocks go on its best run and those that touch the blocks' ends, which are
    joined to what follows them in the next blocks. Vectors of different sizes
    don't meet. The work is the pairs of frames at the offsets asked for.
    """
    kind = {c: df.schema[c].dataType.simpleString() for df, c in ((frames, "recording"), (frames, "frame"), (asked, "i"))}
    of_off = "bigint" if "bigint" in (kind["frame"], kind["i"]) else "int"
    sizes = {-1: 0} | dict(asked.groupBy("variant").agg(F.count(F.lit(1))).collect())  # one number a variant
    n = F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair])[F.col("variant")].cast("long")
    # blocks of frames are dealt to groups by a digest, about one to each
    groups = max(8, -(-frames.count() * 5 // (4 * block)))
    ends = asked.agg(F.min(F.floor(F.col("i") / block)), F.max(F.floor(F.col("i") / block))).first()
    doubles = lambda c: F.transform(c, lambda x: x.cast("double"))
    own = frames.select("recording", F.col("frame").cast("long").alias("frame"), doubles("v").alias("v"), F.floor(F.col("frame") / block).alias("f_block")).filter(V.norm(F.col("v")) > 0)
    every = F.explode(F.sequence(F.lit(ends[0] or 0), F.lit(ends[1] or 0))).alias("q_block")
    own = own.select("*", F.size("v").alias("dim"), F.pmod(F.xxhash64("recording", "f_block"), F.lit(groups)).alias("g"), every)
    query = asked.select("variant", n.alias("n"), F.col("i").cast("long").alias("i"), doubles("qv").alias("qv"), F.floor(F.col("i") / block).alias("q_block")).filter(V.norm(F.col("qv")) > 0)
    query = query.select("*", F.size("qv").alias("dim"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("g"))

    def met(key: tuple, both: pa.Table) -> pa.Table:
        left, right, out = both.filter(pc.is_null(both["n"])), both.filter(pc.is_valid(both["n"])), []
        if left.num_rows and right.num_rows:
            at, v = left["at"].to_numpy(), _dense(left["v"])
            code = left["recording"].combine_chunks().dictionary_encode()
            name, which = code.dictionary, code.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            q, many = _Rows(right["at"].to_numpy(), _dense(right["v"])), right["n"][0].as_py()
            for of, f_block in sorted(set(zip(which.tolist(), (at // block).tolist(), strict=True))):
                here = (which == of) & (at // block == f_block)
                for rows in _runs(_Rows(at[here], v[here]), q, many, threshold, step, overlap, band, block):
                    out.append((None if of < 0 else name[of].as_py(), rows))
        many = np.array([r.shape[1] for _, r in out], int)
        column = lambda k: np.concatenate([r[k] for _, r in out]) if out else np.zeros(0)
        recordings = pa.array([x for x, _ in out], both.schema.field("recording").type).take(pa.array(np.repeat(np.arange(len(out)), many)))
        whole = {c: pa.array(column(k).astype(np.int64)) for k, c in enumerate(("off", "i", "run"))}
        return pa.table({"variant": pa.array(np.full(many.sum(), key[0].as_py(), np.int32)), "recording": recordings, **whole, "total": pa.array(column(3))})

    by = ["variant", "dim", "g", "q_block"]
    left = own.withColumn("variant", F.explode(F.array(*[F.lit(k) for k in sizes if k >= 0]).cast("array<int>"))).select(*by, "recording", F.lit(None).cast("long").alias("n"), F.col("frame").alias("at"), "v")
    right = query.withColumn("variant", F.col("variant").cast("int")).select(*by, F.lit(None).cast(kind["recording"]).alias("recording"), "n", F.col("i").alias("at"), F.col("qv").alias("v"))
    pieces = left.unionAll(right).groupBy(*by).applyInArrow(met, f"variant int, recording {kind['recording']}, off long, i long, run long, total double")
    along = Window.partitionBy("variant", "recording", "off").orderBy("i")
    fresh = pieces.withColumn("new", F.coalesce(F.lag(F.col("i") + F.col("run")).over(along) != F.col("i"), F.lit(True)).cast("int"))
    joined = fresh.withColumn("run_id", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    runs = joined.groupBy("variant", "recording", "off", "run_id").agg(F.sum("run").alias("run"), (F.sum("total") / F.sum("run")).alias("mean"))
    best = F.min(F.struct((-F.col("run")).alias("run"), (-F.col("mean")).alias("mean"), "off"))
    return runs.groupBy("variant", "recording").agg(best.alias("b")).select("variant", "recording", (-F.col("b.run")).alias("run"), (-F.col("b.mean")).alias("mean"), F.col("b.off").cast(of_off).alias("off"))


def sub_windows(asked: DataFrame, spans: list[tuple[int, int]]) -> DataFrame:
    """(variant, i, qv): the query's frames from each start up to its end, as a query of their own; spans beyond the query are left out."""
    n = asked.count()
    rows = [(k, a, z) for k, (a, z) in enumerate(spans) if z <= n]
    told = F.broadcast(asked.sparkSession.createDataFrame(rows, "variant int, a int, z int"))
    within = asked.select(F.col("i").alias("at"), "qv", F.explode(F.sequence(F.lit(0), F.lit(max(len(spans) - 1, 0)))).alias("variant"))
    return within.join(told, "variant").filter((F.col("at") >= F.col("a")) & (F.col("at") < F.col("z"))).select("variant", (F.col("at") - F.col("a")).alias("i"), "qv")


def drifts(asked: DataFrame, low: float = 0.92, step: float = 0.01, n: int = 17) -> DataFrame:
    """(variant, ratio, i, qv): the query read at n tempos by nearest frames, from `low` on; frames i count from 0 without gaps."""
    frames = asked.count()
    ratios = asked.sparkSession.createDataFrame([(k, round(low + k * step, 6)) for k in range(n)], "variant int, ratio double")
    # (frames / ratio) frames a tempo, each from the frame it falls in
    many = ratios.withColumn("m", (F.lit(float(frames)) / F.col("ratio")).cast("int")).filter("m > 0")
    read = many.select("variant", "ratio", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("i")).withColumn("at", F.least((F.col("i") * F.col("ratio")).cast("int"), F.lit(frames - 1)))
    return read.join(asked.select(F.col("i").alias("at"), "qv"), "at").select("variant", "ratio", "i", "qv")


def drift_sweep(frames: DataFrame, asked: DataFrame, threshold: float, step: int = 15, overlap: int = 30, low: float = 0.92, by: float = 0.01, n: int = 17) -> DataFrame:
    """(recording, ratio, run, mean, off, best): the longest run at each tempo of the query; best marks a recording's longest, ties to the greater mean, then the least ratio."""
    told = drifts(asked, low, by, n)
    runs = variant_runs(frames, told, threshold, step, overlap).join(F.broadcast(told.select("variant", "ratio").distinct()), "variant")
    order = Window.partitionBy("recording").orderBy(F.desc("run"), F.desc("mean"), "ratio")
    return runs.withColumn("best", F.row_number().over(order) == 1).select("recording", "ratio", "run", "mean", "off", "best")


def combined(library: DataFrame, windows: DataFrame, frames: DataFrame, asked: DataFrame, spans: list[tuple[int, int]], threshold: float, top: int = 200, step: int = 15, overlap: int = 30) -> DataFrame:
    """(track, score, run, mean): the tracks that windowed screening puts first, by their longest run within any span of the query."""
    near = windowed(library, windows).filter("score is not null").orderBy(F.desc("score"), "track").limit(top)
    kept = frames.join(near.select(F.col("track").alias("recording")), "recording", "left_semi")
    runs = variant_runs(kept, sub_windows(asked, spans), threshold, step, overlap)
    best = runs.groupBy(F.col("recording").alias("track")).agg(F.max(F.struct("run", "mean")).alias("b"))
    return near.join(best, "track", "left").select("track", "score", F.coalesce("b.run", F.lit(0)).alias("run"), F.coalesce("b.mean", F.lit(0.0)).alias("mean")).orderBy(F.desc("run"), F.desc("mean"), "track")


def rerank(candidates: DataFrame, runs: dict[str, DataFrame]) -> DataFrame:
    """Candidates by the shortest of their runs over all features, then by the least mean."""
    out = candidates
    for name, r in runs.items():
        out = out.join(r.select(F.col("recording").alias("track"), F.col("run").alias(f"run_{name}"), F.col("mean").alias(f"mean_{name}")), "track", "left")
    least = lambda cols: F.least(*cols) if len(cols) > 1 else cols[0]
    score = least([F.coalesce(f"run_{n}", F.lit(0)) for n in runs])
    return out.withColumn("score", score).withColumn("sim", F.when(F.col("score") > 0, least([F.col(f"mean_{n}") for n in runs])).otherwise(0.0)).orderBy(F.desc("score"), F.desc("sim"), "track")


def summaries(frames: DataFrame) -> DataFrame:
    """(recording, d, mean, sd, slope) per dimension of frame vectors; slope is the mean of first differences."""
    flat = frames.select("recording", "frame", F.posexplode("v").alias("d0", "x"))
    return flat.groupBy("recording", (F.col("d0") + 1).cast("long").alias("d")).agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"), ((F.max_by("x", "frame") - F.min_by("x", "frame")) / (F.count(F.lit(1)) - 1)).alias("slope"))


def drifted(frames: Column, ratio: float) -> Column:
    """A frame sequence read at another tempo, by nearest frames."""
    return F.transform(F.sequence(F.lit(0), (F.size(frames) / ratio).cast("int") - 1), lambda i: F.element_at(frames, F.least((i * ratio).cast("int"), F.size(frames) - 1) + 1))

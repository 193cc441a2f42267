"""The fingerprint index as one object: add recordings, identify, analyse mixes, statistics, clean-up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import times
from ..functions import vectors as V
from ..sources import files
from ..sources.snapshots import Store
from . import audio, library, match, similar


def fingerprints(recordings: DataFrame, key: str) -> DataFrame:
    """(key, hash, t, bin) of (key, rate, samples)."""
    return match.peak_hashes(match.find_peaks(audio.spectra(recordings, key), key), key)


class Index:
    """Kept in a store with tables tracks, fingerprints (track, hash, t) and vectors (track, kind, v)."""

    def __init__(self, store: Store):
        self.store = store

    def pending(self, mode: str | None = None, limit: int | None = None) -> DataFrame:
        """Tracks that have no fingerprints yet."""
        done = self.store.read("fingerprints").select(F.col("track").alias("id")).distinct()
        found = library.in_mode(self.store.read("tracks"), mode).join(done, "id", "left_anti").orderBy("id")
        return found.limit(limit) if limit else found

    def add(self, rows: DataFrame, replace: bool = False) -> None:
        """Fingerprints (track, hash, t) of new tracks; with replace instead of those that the tracks had."""
        old = self.store.read("fingerprints")
        new = rows.select(*old.columns)
        self.store.write("fingerprints", library.replace_by_key(old, new, ["track"]) if replace else old.unionByName(new))

    def status(self) -> DataFrame:
        """track and fingerprint_count, counted, so that it can't differ from what is stored."""
        return self.store.read("fingerprints").groupBy("track").agg(F.count(F.lit(1)).alias("fingerprint_count"))

    def stats(self) -> DataFrame:
        t = self.store.read("tracks").agg(F.count(F.lit(1)).alias("tracks"))
        f = self.store.read("fingerprints").agg(F.count_distinct("track").alias("indexed"), F.count(F.lit(1)).alias("fingerprints"))
        return t.crossJoin(f).withColumn("missing", F.col("tracks") - F.col("indexed")).withColumn("average", F.col("fingerprints") / F.greatest("indexed", F.lit(1)))

    def identify(self, query: DataFrame, sample: int = 500) -> DataFrame:
        """Which track a recording (recording, hash, t) is, by confidence, from an even sample of its hashes."""
        asked = match.sample_evenly(query.select("recording", "hash", "t"), "recording", ["t", "hash"], sample)
        found = match.match_segments(asked, self.store.read("fingerprints"), ("recording",))
        return self._named(found).orderBy(F.desc("confidence"), "track")

    def analyze(self, query: DataFrame, by_time: bool = False) -> DataFrame:
        """The cue sheet of a mix (recording, segment, hash, t): entries by confidence, or by time."""
        found = self._named(match.match_global(query, self.store.read("fingerprints")))
        cues = found.select("recording", "track", times.whole(F.col("start")).alias("start_ms"), times.whole(F.col("span")).alias("duration_ms"), "confidence", F.coalesce("artist", F.lit("Unknown Artist")).alias("performer"), F.coalesce("title", F.lit("Unknown Title")).alias("title"), F.col("ratio").alias("time_stretch_ratio"))
        return cues.orderBy("recording", "start_ms") if by_time else cues.orderBy(F.desc("confidence"), "track")

    def put_vectors(self, rows: DataFrame) -> None:
        """Vectors (track, kind, v), each instead of the one of the same track and kind."""
        self.store.write("vectors", library.replace_by_key(self.store.read("vectors"), rows.select("track", "kind", "v"), ["track", "kind"]))

    def vectors(self, kind: str | None = None) -> DataFrame:
        found = self.store.read("vectors")
        return found.filter(F.col("kind") == kind) if kind else found

    def cleanup(self) -> int:
        """Remove fingerprints and vectors of tracks that are gone; how many rows."""
        tracks, gone = self.store.read("tracks").select(F.col("id").alias("track")), 0
        with self.store.transaction():
            for name in ("fingerprints", "vectors"):
                own = self.store.read(name)
                gone += own.join(tracks, "track", "left_anti").count()
                self.store.write(name, own.join(tracks, "track", "left_semi"))
        return gone

    def clear(self) -> None:
        with self.store.transaction():
            for name in ("fingerprints", "vectors"):
                self.store.write(name, self.store.read(name).limit(0))

    def _named(self, found: DataFrame) -> DataFrame:
        return found.join(self.store.read("tracks").select(F.col("id").alias("track"), "artist", "title"), "track")


def scan_and_index(spark: SparkSession, index: Index, folder: str) -> int:
    """Add the WAV files under a folder that tracks know by path and that aren't indexed; how many fingerprints."""
    sound = files.read_audio(spark, folder).filter("samples is not null").withColumn("filepath", F.regexp_replace("path", "^file:/*", "/"))
    wanted = index.pending().select(F.col("id").alias("track"), "filepath")
    rows = fingerprints(sound.join(wanted, "filepath").select("track", "rate", "samples"), "track").select("track", "hash", F.col("t").cast("long").alias("t"))
    before = index.store.read("fingerprints").count()
    index.add(rows)
    return index.store.read("fingerprints").count() - before


def match_by_vectors(library_halves: DataFrame, query_halves: DataFrame, library_frames: dict[str, DataFrame], query_frames: dict[str, DataFrame], thresholds: dict[str, float], top: int = 200, step: int = 15, overlap: int = 30) -> DataFrame:
    """The track most like a recording whose hashes find none: screening by summary vectors, then the longest sustained runs.

    library_frames, query_frames: per feature (recording, frame, v) and (i, qv). A
    track's score is the shortest of its runs over the features.
    """
    near = similar.screen(library_halves, query_halves, top).select("track")
    runs = {}
    for name, rows in library_frames.items():
        kept = rows.join(F.broadcast(near.select(F.col("track").alias("recording"))), "recording", "left_semi")
        # of frames that fall on one place at a tempo the first counts
        tempos = query_frames[name].withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(match.RATIOS["drift"][2] - 1))))
        asked = tempos.groupBy("variant", (F.col("i") * match.ratio("drift", F.col("variant"))).cast("int").alias("at")).agg(F.min_by("qv", "i").alias("qv"))
        best = similar.variant_runs(kept, asked.withColumnRenamed("at", "i"), thresholds[name], step, overlap)
        runs[name] = best.groupBy("recording").agg(F.max_by(F.struct("run", "mean"), F.struct("run", "mean")).alias("b")).select("recording", "b.run", "b.mean")
    found = similar.rerank(near, runs).filter("score > 0").limit(1)
    return found.select("track", F.col("sim").alias("confidence"), F.col("score").alias("run"), F.lit(0).alias("match_count"), F.lit(0).alias("track_start"))


def scoring_formulas(rows: DataFrame, a: str = "v", b: str = "q") -> DataFrame:
    """Ways to rate how alike two vectors are, side by side."""
    x, y = F.col(a), F.col(b)
    apart = V.norm(F.zip_with(x, y, lambda p, q: p - q))
    return rows.select("*", V.cosine(x, y).alias("cosine"), apart.alias("euclidean"), (1 / (1 + apart)).alias("inverse_distance"), V.dot(x, y).alias("dot"), F.aggregate(F.zip_with(x, y, lambda p, q: F.abs(p - q)), F.lit(0.0), lambda s, d: s + d).alias("manhattan"), F.least(V.norm(x), V.norm(y)).alias("least_norm"))

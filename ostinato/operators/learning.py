"""Multi-label classification: training sets, scaling, one model a label, metrics, predictions."""

from __future__ import annotations

import hashlib
import json

from pyspark.ml.classification import FMClassifier, GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from . import kernel, steps


def training_set(tracks: DataFrame, features: DataFrame, least: int = 5) -> tuple[DataFrame, list[str]]:
    """id, features and a 0/1 column y_CODE for each label with enough rows; rows without any such label go."""
    coded = tracks.filter("genre is not null and genre <> ''").select("id", T.label_codes(F.col("genre")).alias("codes"))
    met = coded.join(features, "id")
    counts = met.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    labels = sorted(r[0] for r in counts.collect())  # at most 26
    held = met.filter(F.arrays_overlap("codes", F.array(*map(F.lit, labels)).cast("array<string>"))) if labels else met.limit(0)
    return held.withColumns({f"y_{c}": F.array_contains("codes", c).cast("int") for c in labels}).drop("codes"), labels


def dataset_stats(tracks: DataFrame, features: DataFrame, told: str) -> DataFrame:
    """One row: all tracks, those with a genre, those with features (id, ...), those whose feature `told` is known, and those fit for training, which have a genre and that feature."""
    known = features.select("id", F.lit(True).alias("__there"), F.col(told).isNotNull().alias("__told"))
    met = tracks.select("id", (F.coalesce("genre", F.lit("")) != "").alias("__genre")).join(known, "id", "full_outer")
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return met.agg(
        count(F.col("__genre").isNotNull()).alias("total_tracks"),
        count(F.col("__genre")).alias("tracks_with_genre"),
        count(F.col("__there")).alias("tracks_with_analysis"),
        count(F.col("__told")).alias("tracks_with_features"),
        count(F.col("__genre") & F.col("__told")).alias("usable_for_training"),
    )


def split(df: DataFrame, key: str, share: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Training and test rows by a seeded hash of the key."""
    test = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1000)) < int(share * 1000)
    return df.filter(~test), df.filter(test)


class Scaler:
    """Fills gaps with the median (or mean, or most frequent value) and standardises, as fitted on training rows."""

    def __init__(self, columns: list[str], fill: str = "median", scale: bool = True):
        self.columns, self.fill, self.scale, self.values = columns, fill, scale, {}

    def fit(self, df: DataFrame) -> Scaler:
        of = {"median": F.median, "mean": F.avg, "most_frequent": F.mode}[self.fill]
        fills = df.agg(*[of(c).alias(c) for c in self.columns]).first()
        self.values = {c: [float(fills[c] if fills[c] is not None else 0.0), 0.0, 1.0] for c in self.columns}
        if self.scale:
            filled = df.select(*[F.coalesce(c, F.lit(self.values[c][0])).alias(c) for c in self.columns])
            row = filled.agg(*[F.avg(c).alias(f"m_{c}") for c in self.columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in self.columns]).first()
            for c in self.columns:
                self.values[c][1:] = [float(row[f"m_{c}"] or 0.0), float(row[f"s_{c}"] or 0.0) or 1.0]
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.coalesce(F.col(c).cast("double"), F.lit(f)) - m) / s for c, (f, m, s) in self.values.items()})


def random_forest(**how):
    return RandomForestClassifier(**({"numTrees": 200, "maxDepth": 20, "minInstancesPerNode": 2, "featureSubsetStrategy": "sqrt", "seed": 42, "weightCol": "w"} | how))


def boosted_trees(**how):
    return GBTClassifier(**({"maxIter": 200, "maxDepth": 6, "stepSize": 0.1, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8", "seed": 42, "weightCol": "w"} | how))


def linear_svm(**how):
    """A linear machine; `svm` has a radial kernel."""
    return LinearSVC(**({"regParam": 0.1, "weightCol": "w"} | how))


MODELS = {"random_forest": random_forest, "boosted_trees": boosted_trees, "svm": kernel.RadialMachine, "linear_svm": linear_svm, "logistic": lambda **how: LogisticRegression(**({"weightCol": "w"} | how)), "factorization": lambda **how: FMClassifier(**how)}


class LabelModels:
    """One binary model a label, classes weighted to balance."""

    def __init__(self, name: str, columns: list[str], labels: list[str], **how):
        self.name, self.columns, self.labels, self.how, self.models = name, columns, labels, how, {}

    def _vector(self, df: DataFrame) -> DataFrame:
        return VectorAssembler(inputCols=self.columns, outputCol="v", handleInvalid="keep").transform(df)

    def fit(self, df: DataFrame) -> LabelModels:
        # a fit reads its rows many times: they are dealt to all cores, in parts whose size doesn't follow the input's
        parts = steps.pieces(df.count(), df.sparkSession.sparkContext.defaultParallelism, 2**15)
        rows = self._vector(df).repartition(parts).persist()
        counts = rows.agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"y_{c}").alias(c) for c in self.labels]).first()
        for c in self.labels:
            n, pos = counts["n"], counts[c]
            weight = F.when(F.col(f"y_{c}") == 1, n / (2.0 * max(1, pos))).otherwise(n / (2.0 * max(1, n - pos)))
            model = MODELS[self.name](labelCol=f"y_{c}", featuresCol="v", **self.how)
            self.models[c] = model.fit(rows.withColumn("w", weight).withColumn(f"y_{c}", F.col(f"y_{c}").cast("double")))
        rows.unpersist()
        return self

    def predict_proba(self, df: DataFrame) -> DataFrame:
        """df with probabilities: map of label to probability; a model without them gives the logistic of its margin."""
        out = self._vector(df)
        for c, m in self.models.items():
            kept = out.columns
            if hasattr(m, "setRawPredictionCol"):
                m = m.copy()
                m.setRawPredictionCol("raw_")
            scored = m.transform(out)
            p = vector_to_array("probability")[1] if "probability" in scored.columns else 1 / (1 + F.exp(-vector_to_array("raw_")[1]))
            out = scored.withColumn(f"p_{c}", p).select(*kept, f"p_{c}")
        pairs = [x for c in self.models for x in (F.lit(c), F.col(f"p_{c}"))]
        return out.withColumn("probabilities", F.create_map(*pairs)).drop("v", *[f"p_{c}" for c in self.models])

    def importances(self) -> list[tuple[str, float]]:
        """Features by mean importance over the labels' models."""
        total = [0.0] * len(self.columns)
        for m in self.models.values():
            if not hasattr(m, "featureImportances") and not hasattr(m, "coefficients"):
                raise ValueError("a machine with a kernel has no importances by feature")
            for i, x in enumerate(m.featureImportances.toArray() if hasattr(m, "featureImportances") else abs(m.coefficients.toArray())):
                total[i] += float(x) / len(self.models)
        return sorted(zip(self.columns, total, strict=True), key=lambda x: (-x[1], x[0]))


def predicted(probabilities: Column, threshold: float = 0.5) -> Column:
    return F.array_sort(F.map_keys(F.map_filter(probabilities, lambda k, v: v >= threshold)))


def top_n(probabilities: Column, n: int = 3) -> Column:
    """The n likeliest labels, ties by name."""
    ranked = F.array_sort(F.transform(F.map_entries(probabilities), lambda e: F.struct((-e["value"]).alias("a"), e["key"].alias("k"))))
    return F.transform(F.slice(ranked, 1, n), lambda x: x["k"])


def metrics(df: DataFrame) -> DataFrame:
    """One row of measures over (row, label, y, yhat) with 0/1 values; nothing by nothing is 0."""
    cell = df.select("row", "label", (F.col("y") * F.col("yhat")).alias("tp"), ((1 - F.col("y")) * F.col("yhat")).alias("fp"), (F.col("y") * (1 - F.col("yhat"))).alias("fn"), "y")
    f1 = lambda: F.coalesce(F.try_divide(2 * F.sum("tp"), 2 * F.sum("tp") + F.sum("fp") + F.sum("fn")), F.lit(0.0))
    by_label = cell.groupBy("label").agg(f1().alias("f1"), F.sum("y").alias("support"))
    by_row = cell.groupBy("row").agg(f1().alias("f1"), (F.sum("fp") + F.sum("fn") == 0).cast("int").alias("exact"))
    whole = cell.agg(F.avg(F.col("fp") + F.col("fn")).alias("hamming_loss"), f1().alias("f1_micro"), F.coalesce(F.try_divide(F.sum("tp"), F.sum("tp") + F.sum("fp")), F.lit(0.0)).alias("precision_micro"), F.coalesce(F.try_divide(F.sum("tp"), F.sum("tp") + F.sum("fn")), F.lit(0.0)).alias("recall_micro"))
    labels = by_label.agg(F.avg("f1").alias("f1_macro"), F.coalesce(F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")), F.lit(0.0)).alias("f1_weighted"))
    rows = by_row.agg(F.avg("f1").alias("f1_samples"), F.avg("exact").alias("subset_accuracy"))
    return whole.crossJoin(labels).crossJoin(rows)  # one row each


def per_label(df: DataFrame) -> DataFrame:
    """precision, recall, f1 and support of each label that occurs."""
    tp, fp, fn = F.sum(F.col("y") * F.col("yhat")), F.sum((1 - F.col("y")) * F.col("yhat")), F.sum(F.col("y") * (1 - F.col("yhat")))
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return df.groupBy("label").agg(zero(tp, tp + fp).alias("precision"), zero(tp, tp + fn).alias("recall"), zero(2 * tp, 2 * tp + fp + fn).alias("f1"), F.sum("y").alias("support")).filter("support > 0")


def evaluate(models: LabelModels, df: DataFrame, threshold: float = 0.5) -> DataFrame:
    rated = models.predict_proba(df)
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("label"), F.col(f"y_{c}").alias("y"), (F.col("probabilities")[c] >= threshold).cast("int").alias("yhat")) for c in models.labels]))
    return metrics(rated.select(F.col("id").alias("row"), cells.alias("c")).select("row", "c.*"))


def compare(names: list[str], columns: list[str], labels: list[str], train: DataFrame, test: DataFrame, **how) -> list[tuple[str, float]]:
    """Models by f1_micro on the test rows."""
    found = [(n, float(evaluate(LabelModels(n, columns, labels, **how.get(n, {})).fit(train), test).first()["f1_micro"])) for n in names]
    return sorted(found, key=lambda x: (-x[1], x[0]))


def save(models: LabelModels, folder: str) -> str:
    """Write the models with a manifest and its digest, which is returned."""
    spark = SparkSession.active()
    for c, m in models.models.items():
        m.write().overwrite().save(f"{folder}/{c}")
    body = json.dumps({"name": models.name, "columns": models.columns, "labels": models.labels}, sort_keys=True)
    digest = hashlib.sha256(body.encode()).hexdigest()
    spark.createDataFrame([(body, digest)], "body string, digest string").coalesce(1).write.mode("overwrite").json(f"{folder}/manifest")
    return digest


def load(spark, folder: str, digest: str | None) -> LabelModels:
    """The models, if the manifest has the digest that is asked for; without one they are refused."""
    from pyspark.ml.util import DefaultParamsReader

    row = spark.read.json(f"{folder}/manifest").first()
    if not digest or hashlib.sha256(row["body"].encode()).hexdigest() != digest:
        raise ValueError("the models' digest is missing or another")
    about = json.loads(row["body"])
    models = LabelModels(about["name"], about["columns"], about["labels"])
    models.models = {c: DefaultParamsReader.loadParamsInstance(f"{folder}/{c}", spark) for c in about["labels"]}
    return models


#: Features by what they tell. Fixed values.
GROUPS = {
    "level": ["rms_energy", "rms_mean", "rms_std", "loudness_variation", "rms_p10", "rms_p90", "peak", "dynamic_range_db"],
    "spectrum": ["spectral_centroid", "spectral_centroid_std", "spectral_bandwidth", "spectral_rolloff", "spectral_flux", "spectral_entropy", "spectral_flatness"],
    "bands": ["sub_bass_energy", "bass_energy", "low_mid_energy", "mid_energy", "high_mid_energy", "high_energy"],
    "band_ratios": ["sub_bass_ratio", "bass_ratio", "low_mid_ratio", "mid_ratio", "high_mid_ratio", "high_ratio"],
    "rhythm": ["tempo_confidence", "onset_rate"],
    "percussion": ["zero_crossing_rate"],
    "trend": ["energy_slope"],
    "structure": ["intro_ratio", "core_ratio", "outro_ratio"],
}


#: The 62 columns of spectral.all_columns by what they tell. Fixed values.
COLUMNS = {
    "level": ["rms_energy", "rms_mean", "rms_std", "rms_p10", "rms_p90", "peak_amplitude", "crest_factor", "loudness_variation"],
    "bands": [f"{b}_{x}" for b in ("sub_bass", "bass", "low_mid", "mid", "high_mid", "high") for x in ("mean", "ratio")],
    "spectrum": ["spectral_centroid", "spectral_centroid_std", "spectral_bandwidth", "spectral_rolloff", "spectral_flatness", "spectral_contrast", "spectral_entropy"],
    "cepstrum": [f"mfcc_{i}" for i in range(1, 11)],
    "percussion": ["harmonic_energy", "percussive_energy", "perc_harm_ratio", "onset_strength_mean", "percussive_onset_rate", "zero_crossing_rate"],
    "rhythm": ["tempo", "tempo_confidence", "beat_interval_mean", "beat_interval_std", "onset_rate", "tempogram_periodicity"],
    "harmony": ["chroma_entropy", "chroma_centroid", "chroma_energy_std", "tonnetz_mean"],
    "structure": ["intro_energy_ratio", "core_energy_ratio", "outro_energy_ratio", "energy_slope"],
    "waveform": ["energy", "bass_energy", "mid_energy", "treble_energy", "dynamic_range"],
}


def encode(sets: Column, labels: list[str]) -> Column:
    """0/1 per label, in the labels' order."""
    return F.transform(F.array(*map(F.lit, labels)), lambda c: F.array_contains(sets, c).cast("int"))


def decode(values: Column, labels: list[str], threshold: float = 0.5) -> Column:
    """The labels whose value reaches the threshold."""
    pairs = F.arrays_zip(F.array(*map(F.lit, labels)).alias("label"), values.alias("value"))
    return F.transform(F.filter(pairs, lambda p: p["value"] >= threshold), lambda p: p["label"])

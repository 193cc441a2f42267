"""Machines with a radial kernel: random Fourier features, a linear machine over them, margins turned into probabilities."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, HasSeed
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class FourierFeatures(Transformer, HasInputCol, HasOutputCol, HasSeed, DefaultParamsReadable, DefaultParamsWritable):
    """Vectors whose products are near exp(-gamma * squared distance): cosines of `size` random projections, told by the seed alone."""

    gamma = Param(Params._dummy(), "gamma", "how fast likeness falls with squared distance", TypeConverters.toFloat)
    size = Param(Params._dummy(), "size", "how many cosines", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, gamma=None, size=None, seed=None):
        super().__init__()
        self._setDefault(gamma=1.0, size=256, seed=42)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, df: DataFrame) -> DataFrame:
        gamma, size, seed = self.getOrDefault(self.gamma), self.getOrDefault(self.size), self.getSeed()

        @F.pandas_udf("array<double>")
        def cosines(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=object)
            rows = np.stack(x.to_numpy())
            rng = np.random.default_rng(seed)
            turn, ahead = rng.normal(0, np.sqrt(2 * gamma), (rows.shape[1], size)), rng.uniform(0, 2 * np.pi, size)
            return pd.Series(list(np.sqrt(2 / size) * np.cos(rows @ turn + ahead)))

        return df.withColumn(self.getOutputCol(), array_to_vector(cosines(vector_to_array(self.getInputCol()))))


class RadialMachine:
    """Fits a machine with a radial kernel to 0/1 labels with weights; the fitted one is a pipeline that saves and loads as such.

    c is the cost of errors; gamma, unless given, is 1 by the features' number
    and variance. Probabilities are a logistic curve over margins that each row
    got from a machine fitted without its fold. Equal rows share a fold.
    """

    def __init__(self, labelCol: str, featuresCol: str, weightCol: str | None = "w", c: float = 1.0, gamma: float | None = None, size: int = 256, seed: int = 42, folds: int = 3, maxIter: int = 100):
        self.label, self.features, self.weight, self.c, self.gamma, self.size, self.seed, self.folds, self.most = labelCol, featuresCol, weightCol, c, gamma, size, seed, folds, maxIter

    def _scale(self, df: DataFrame) -> float:
        s = df.select(Summarizer.metrics("mean", "variance", "count").summary(F.col(self.features)).alias("s")).select("s.*").first()
        mean, n = s["mean"].toArray(), max(s["count"], 1)
        spread = float((s["variance"].toArray() * (n - 1) / n + mean**2).mean() - mean.mean() ** 2)
        return 1 / (len(mean) * spread) if spread > 0 else 1.0

    def _machine(self, df: DataFrame):
        weight = {"weightCol": self.weight} if self.weight else {}
        total = df.agg(F.sum(self.weight) if self.weight else F.count(F.lit(1))).first()[0] or 1.0
        return LinearSVC(labelCol=self.label, featuresCol="radial", rawPredictionCol="margin", predictionCol="beyond", regParam=1 / (self.c * total), standardization=False, maxIter=self.most, **weight).fit(df)

    def fit(self, df: DataFrame) -> PipelineModel:
        gamma = self.gamma if self.gamma is not None else self._scale(df)
        features = FourierFeatures(inputCol=self.features, outputCol="radial", gamma=gamma, size=self.size, seed=self.seed)
        rows = features.transform(df).withColumn("fold", F.pmod(F.xxhash64(vector_to_array(self.features)), F.lit(self.folds))).persist()
        whole = self._machine(rows)
        margins = None
        for k in range(self.folds):
            kept = rows.filter(F.col("fold") != k)
            both = kept.agg(F.count_distinct(self.label)).first()[0] == 2
            told = (self._machine(kept) if both else whole).transform(rows.filter(F.col("fold") == k)).select("margin", self.label)
            margins = told if margins is None else margins.unionAll(told)
        curve = LogisticRegression(labelCol=self.label, featuresCol="margin", rawPredictionCol="raw_", predictionCol="said", regParam=1e-6).fit(margins)
        rows.unpersist()
        return PipelineModel([features, whole, curve])

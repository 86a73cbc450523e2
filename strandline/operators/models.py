"""Classifiers of windows as pyspark.ml pipelines: features, a forest, probabilities; trained on a feature pool, saved and loaded as a whole."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import signal


class FeatureVectors(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Windows (an array column a channel) to the vector that a model takes; the arrays go."""

    hz = Param(Params._dummy(), "hz", "samples a second", TypeConverters.toFloat)
    length = Param(Params._dummy(), "length", "which vector: a key of signal.LAYOUTS", TypeConverters.toInt)
    chosen = Param(Params._dummy(), "chosen", "places of the vector to keep, none for all", TypeConverters.toListInt)
    output = Param(Params._dummy(), "output", "the vector's column", TypeConverters.toString)

    def __init__(self, hz: float | None = None, length: int = max(signal.LAYOUTS), chosen: Sequence[int] = ()) -> None:
        super().__init__()
        self._setDefault(length=max(signal.LAYOUTS), chosen=[], output="features")
        self._set(**{k: v for k, v in {"hz": hz, "length": length, "chosen": list(chosen)}.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        get = self.getOrDefault
        found = signal.features(dataset, get(self.hz), get(self.length), chosen=get(self.chosen) or None)
        return found.withColumn(get(self.output), array_to_vector("features"))


class ClassProbabilities(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """A classifier's columns to probs in the order of classes, confidence and label; a label of less confidence than minimum is null."""

    classes = Param(Params._dummy(), "classes", "the names of the model's labels 0, 1, ...", TypeConverters.toListString)
    minimum = Param(Params._dummy(), "minimum", "the least confidence of a label", TypeConverters.toFloat)

    def __init__(self, classes: Sequence[str] = (), minimum: float = 0.0) -> None:
        super().__init__()
        self._setDefault(minimum=0.0)
        self._set(classes=list(classes), minimum=minimum)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        names = self.getOrDefault(self.classes)
        out = dataset.withColumn("probs", vector_to_array("probability")).drop("features", "rawPrediction", "probability", "prediction")
        out = out.withColumn("confidence", F.array_max("probs"))
        label = F.element_at(F.array(*map(F.lit, names)), F.array_position("probs", F.col("confidence")).cast("int"))
        return out.withColumn("label", F.when(F.col("confidence") >= self.getOrDefault(self.minimum), label))


def train(pool: DataFrame, classes: Sequence[str], hz: float, chosen: Sequence[int] = (), trees: int = 40, depth: int = 8, seed: int = 42, minimum: float = 0.0) -> PipelineModel:
    """A pipeline from windows to classes, its forest trained on a pool (label, features: an array of the length of a layout). Rows of other labels are left out.

    chosen: the places of the vector that the forest takes.
    """
    known = pool.where(F.col("label").isin(*classes))
    sizes = [r[0] for r in known.select(F.size("features")).distinct().limit(2).collect()]
    if len(sizes) != 1 or sizes[0] not in signal.LAYOUTS:
        raise ValueError(f"the pool's vectors have lengths {sizes}; known: {sorted(signal.LAYOUTS)}")
    taken = F.array(*[F.col("features")[int(k)] for k in chosen]) if chosen else F.col("features")
    number = F.array_position(F.array(*map(F.lit, classes)), F.col("label")) - 1
    rows = known.select(array_to_vector(taken.cast("array<double>")).alias("features"), number.cast("double").alias("_number"))
    forest = RandomForestClassifier(featuresCol="features", labelCol="_number", numTrees=trees, maxDepth=depth, seed=seed).fit(rows)
    return PipelineModel([FeatureVectors(hz, sizes[0], chosen), forest, ClassProbabilities(list(classes)[: forest.numClasses], minimum)])


def importances(model: PipelineModel) -> DataFrame:
    """place (in the whole vector), name and importance of what the forest looks at, the most important first."""
    vectors, forest = model.stages[0], model.stages[1]
    length, chosen = vectors.getOrDefault(vectors.length), vectors.getOrDefault(vectors.chosen)
    names = signal.feature_names(length == 193) if length != 78 else [f"f{k}" for k in range(78)]
    places = chosen or range(length)
    rows = [(int(p), names[p], float(x)) for p, x in zip(places, forest.featureImportances.toArray(), strict=True)]
    return SparkSession.active().createDataFrame(rows, "place int, name string, importance double").orderBy(F.desc("importance"), "place")

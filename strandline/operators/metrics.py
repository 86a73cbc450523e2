"""How well predicted classes agree with true ones, and what features weigh."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(predictions: DataFrame, true: str = "true_class", predicted: str = "pred_class") -> DataFrame:
    return predictions.groupBy(true, predicted).agg(F.count("*").alias("n"))


def by_class(counts: DataFrame, true: str = "true_class", predicted: str = "pred_class") -> DataFrame:
    """Precision, recall, F1 and support of each class of a confusion table; 0 where a share has no base."""
    as_true = counts.select(F.col(true).alias("class"), F.when(F.col(true) == F.col(predicted), F.col("n")).otherwise(0).alias("hit"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"))
    as_predicted = counts.select(F.col(predicted).alias("class"), F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"))
    sums = as_true.unionByName(as_predicted).groupBy("class").agg(F.sum("hit").alias("hit"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted"))
    precision = F.coalesce(F.try_divide("hit", "predicted"), F.lit(0.0))
    recall = F.coalesce(F.try_divide("hit", "support"), F.lit(0.0))
    out = sums.withColumn("precision", precision).withColumn("recall", recall)
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return out.withColumn("f1", f1).select("class", "precision", "recall", "f1", "support")


def overall(counts: DataFrame, true: str = "true_class", predicted: str = "pred_class") -> DataFrame:
    """Accuracy, mean F1 over classes, and how many predictions there are: one row."""
    hits = F.sum(F.when(F.col(true) == F.col(predicted), F.col("n")).otherwise(0))
    accuracy = counts.agg(F.try_divide(hits, F.sum("n")).alias("accuracy"), F.sum("n").alias("n"))
    return accuracy.crossJoin(by_class(counts, true, predicted).agg(F.avg("f1").alias("macro_f1")))  # one row each


def top_features(importance: DataFrame, most: int, value: str = "importance", name: str = "feature") -> DataFrame:
    return importance.orderBy(F.desc(value), name).limit(most)

"""Classification metrics from a confusion matrix."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(df: DataFrame, truth: str = "label", predicted: str = "prediction") -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )


def per_class(matrix: DataFrame) -> DataFrame:
    """Support, precision, recall and F per class seen in truth or prediction; 0/0 gives 0."""
    sides = (
        matrix.select(F.col("truth").alias("label"), F.col("n").alias("support"), F.lit(0).alias("guesses"),
                      F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0).alias("hits"))
        .unionByName(matrix.select(F.col("predicted").alias("label"), F.lit(0).alias("support"),
                                   F.col("n").alias("guesses"), F.lit(0).alias("hits")))
        .groupBy("label")
        .agg(F.sum("support").alias("support"), F.sum("guesses").alias("guesses"), F.sum("hits").alias("hits"))
    )

    def ratio(a, b):
        return F.when(b > 0, a / b).otherwise(0.0)

    precision = ratio(F.col("hits"), F.col("guesses"))
    recall = ratio(F.col("hits"), F.col("support"))
    return sides.withColumns({"precision": precision, "recall": recall}).withColumn(
        "fscore",
        ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")),
    )


def metrics(df: DataFrame, truth: str = "label", predicted: str = "prediction") -> DataFrame:
    """One row: accuracy, balanced accuracy, and precision, recall, F weighted by support."""
    total = F.sum("support")

    def weighted(name):
        return (F.sum(F.col("support") * F.col(name)) / total).alias(name)

    return per_class(confusion(df, truth, predicted)).agg(
        total.cast("bigint").alias("samples"),
        (F.sum("hits") / total).alias("accuracy"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        weighted("precision"),
        weighted("recall"),
        weighted("fscore"),
    )


def evaluate(
    df: DataFrame,
    metric: Callable[[DataFrame], DataFrame] = metrics,
    cap: int | None = None,
) -> DataFrame:
    """Any metric, given as a DataFrame to one-row DataFrame function with ``samples``, plus the
    set size reported with it: at most ``cap``."""
    size = F.col("samples") if cap is None else F.least(F.lit(cap).cast("bigint"), F.col("samples"))
    return metric(df).withColumn("eval_samples", size)

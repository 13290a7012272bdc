"""Text features, the classifier, and its review queue."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commentlens.functions import scores
from commentlens.functions.text import pair_text
from commentlens.operators import store

N_FEATURES = 1 << 14
EMBEDDING_SIZE = 384


def feature_stages(n_features: int = N_FEATURES, text: str = "pair") -> list:
    """Token counts hashed to a unit TF-IDF vector."""
    return [
        RegexTokenizer(inputCol=text, outputCol="tokens", pattern=r"(?U)\w+", gaps=False),
        HashingTF(inputCol="tokens", outputCol="counts", numFeatures=n_features),
        IDF(inputCol="counts", outputCol="weighted"),
        Normalizer(inputCol="weighted", outputCol="features"),
    ]


def with_pair(df: DataFrame) -> DataFrame:
    return df.withColumn("pair", pair_text(F.col("author_name"), F.col("text")))


def embed(df: DataFrame, key: str = "comment_id", n_features: int = EMBEDDING_SIZE) -> DataFrame:
    """``id, embedding`` from author and text, for the similarity operators."""
    pairs = with_pair(df)
    fitted = Pipeline(stages=feature_stages(n_features)).fit(pairs)
    return fitted.transform(pairs).select(
        F.col(key).alias("id"), vector_to_array("features", "float32").alias("embedding")
    )


def train(labelled: DataFrame, n_features: int = N_FEATURES, max_iter: int = 20,
          reg_param: float = 0.01) -> PipelineModel:
    """Multinomial classifier on the labels; ``model_id`` is the fixed 0-based class id."""
    rows = with_pair(labelled).withColumn("model_id", scores.model_id_of(F.col("label")).cast("double"))
    classifier = LogisticRegression(
        featuresCol="features", labelCol="model_id", family="multinomial", maxIter=max_iter, regParam=reg_param
    )
    return Pipeline(stages=[*feature_stages(n_features), classifier]).fit(rows)


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Add ``prediction_label`` and the ``probability`` of that class."""
    p = vector_to_array("probability")
    verdict = F.struct(
        scores.label_of(scores.argmax(F.col("__p"))).alias("prediction_label"),
        F.array_max("__p").alias("probability"),
    )
    # the one-row generator keeps filters on the verdict from running the model a second time
    scored = model.transform(with_pair(df)).select(*df.columns, p.alias("__p"))
    return scored.select(*df.columns, F.inline(F.array(verdict)))


def prediction_queue(model: PipelineModel, comments: DataFrame,
                     minimum: float = scores.MIN_PROBABILITY) -> DataFrame:
    """Unreviewed rows whose non-VALID prediction is confident enough to ask about."""
    rated = score(model, store.unmoderated(comments))
    return rated.filter(scores.is_confident(F.col("prediction_label"), F.col("probability"), minimum))

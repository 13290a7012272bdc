"""Live scoring: each comment id is classified once, actions follow the current settings.

The prediction log is a Parquet table partitioned by batch and by id hash. Every micro-batch first
keeps one row per comment id (combined before the shuffle, so a hot id costs one row per task), drops
ids that earlier batches predicted, for which it reads the folders of its own ids only, and writes its
own partition. A replayed batch overwrites that partition, so results stay exact after a failure.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from commentlens.operators.cascade import flag, rules_then_model
from commentlens.operators.policy import uses_rules, with_action
from commentlens.operators.ranking import first_per_key
from commentlens.session import written_table
from commentlens.sources.tables import bucket_of, held_buckets

PREDICTIONS = T.StructType([
    T.StructField("comment_id", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("batch_id", T.LongType()),
    T.StructField("bucket", T.IntegerType()),
])

#: Folders of a batch of the log, by hash of the id.
LOG_BUCKETS = 16

Classifier = Callable[[DataFrame], DataFrame]


def rule_classifier(comments: DataFrame, settings: DataFrame | None = None) -> DataFrame:
    """Add ``label`` from the live rules; without them (``use-rules`` off) every comment is VALID."""
    if settings is not None and not uses_rules(settings):
        return comments.withColumn("label", F.lit("VALID"))
    html = "html" if "html" in comments.columns else None
    flagged = flag(comments, live=True, html=html)
    return flagged.withColumn("label", rules_then_model(F.col("rule_label"), F.lit(None).cast("string")))


def score_stream(comments: DataFrame) -> DataFrame:
    """Stateless live rules on a stream or a table: adds ``rule_id`` and ``rule_label``."""
    html = "html" if "html" in comments.columns else None
    return flag(comments, live=True, html=html)


def first_sightings(comments: DataFrame, event_time: str, delay: str, salts: int = 16) -> DataFrame:
    """Purely streaming variant: one row per id, with state dropped ``delay`` after its event time.

    An id that comes back later than that is sighted anew; ``classify_once`` keeps every id for good.

    Repeats are dropped per (id, salt) first, so a hot id is spread over ``salts`` tasks and at
    most that many of its rows reach the task that keeps one.
    """
    others = [c for c in comments.columns if c != "comment_id"]
    salted = comments.withColumn("__salt", F.pmod(F.xxhash64(*others), F.lit(salts)))
    return (
        salted.withWatermark(event_time, delay)
        .dropDuplicatesWithinWatermark(["comment_id", "__salt"])
        .dropDuplicatesWithinWatermark(["comment_id"])
        .drop("__salt")
    )


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """The log so far: ``comment_id, label, batch_id, bucket``."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], PREDICTIONS)
    return spark.read.schema(PREDICTIONS).parquet(path)


def classify_once(
    comments: DataFrame,
    log_path: str,
    checkpoint: str,
    order: list[str],
    classify: Classifier = rule_classifier,
    once: bool = True,
) -> StreamingQuery:
    """Start the stream that fills the log; the first sighting by ``order`` is classified."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # read for its buckets and for the classification, and the source may not give the same rows twice
        unseen = written_table(first_per_key(batch, ["comment_id"], [F.col(c) for c in order]), "sightings")
        known = predictions(spark, log_path).filter((F.col("batch_id") < batch_id) & F.col("bucket").isin(held_buckets(unseen, LOG_BUCKETS)))
        fresh = unseen.join(known.select("comment_id"), "comment_id", "left_anti")
        rows = classify(fresh).select("comment_id", "label", bucket_of("comment_id", LOG_BUCKETS).alias("bucket"))
        rows.repartition(LOG_BUCKETS, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{log_path}/batch_id={batch_id}")

    writer = comments.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def save_settings(settings: DataFrame, path: str) -> None:
    """Make ``settings(setting, value)`` the current ones; earlier versions stay beside them."""
    stamp = F.unix_micros(F.current_timestamp())
    settings.select("setting", "value", stamp.alias("saved")).coalesce(1).write.mode("append").parquet(path)


def current_settings(spark: SparkSession, path: str) -> DataFrame:
    """The settings as they were saved last; a few dozen rows per version."""
    saved = spark.read.schema("setting string, value string, saved bigint").parquet(path)
    newest = saved.agg(F.max("saved").alias("saved"))
    return saved.join(F.broadcast(newest), "saved").select("setting", "value")


def act_on_stream(comments: DataFrame, settings_path: str, out: str, checkpoint: str, classify: Classifier | None = None,
                  once: bool = True) -> StreamingQuery:
    """Label and act on a stream under the settings that hold when a micro-batch comes.

    Settings are read anew for every batch, ``use-rules`` included, so a change between batches takes effect. A batch
    writes ``comment_id``, ``label``, ``action`` and the other columns of ``comments`` to its own partition of ``out``.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        settings = written_table(current_settings(batch.sparkSession, settings_path), "settings")
        labelled = classify(batch) if classify else rule_classifier(batch, settings)
        with_action(labelled, settings).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    writer = comments.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def live_actions(sightings: DataFrame, log: DataFrame, settings: DataFrame) -> DataFrame:
    """Every sighting, repeats included, with the logged label and the action the settings give now."""
    labelled = sightings.join(log.select("comment_id", "label"), "comment_id", "left")
    return with_action(labelled, settings)

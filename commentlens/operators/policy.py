"""What to do with a flagged comment, from settings and thread position."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings that switch a label on; any one is enough.
LABEL_SETTINGS = (
    ("SCAM", "rules-enabled-scam"),
    ("EXPLICIT", "rules-enabled-explicit"),
    ("LINK_SPAM", "rules-links-spam"),
    ("LINK_SPAM", "rules-links-contains"),
    ("LINK_ONLY", "rules-links-only"),
    ("LINK_ONLY", "rules-links-contains"),
    ("LINK_CONTAINS", "rules-links-contains"),
    ("SELF_PROMO", "rules-enabled-selfpromo"),
    ("OTHER_PROMO", "rules-enabled-otherpromo"),
    ("SPONSOR", "rules-enabled-sponsor"),
    ("OTHER_SPAM", "rules-enabled-spam"),
)

# Default settings.
DEFAULT_SETTINGS = {
    "rules-enabled-scam": "true",
    "rules-scam-names": "true",
    "rules-scam-text": "true",
    "rules-enabled-explicit": "true",
    "rules-enabled-links": "true",
    "rules-links-spam": "true",
    "rules-links-only": "false",
    "rules-links-contains": "false",
    "rules-enabled-selfpromo": "false",
    "rules-enabled-otherpromo": "false",
    "rules-enabled-sponsor": "false",
    "rules-enabled-spam": "true",
    "rules-spam-wafflehouse": "true",
    "action": "blur",
    "use-rules": "true",
    "use-ml": "false",
}


def settings_table(spark: SparkSession, changes: dict[str, str] | None = None) -> DataFrame:
    """Settings as rows; missing ones keep their default."""
    rows = {**DEFAULT_SETTINGS, **(changes or {})}
    return spark.createDataFrame(list(rows.items()), "setting string, value string")


def uses_rules(settings: DataFrame) -> bool:
    """Whether rules may decide at all; on unless switched off."""
    row = settings.filter(F.col("setting") == "use-rules").agg(F.max("value")).first()
    return row[0] is None or row[0] == "true"


def label_policy(settings: DataFrame) -> DataFrame:
    """``label, enabled, action`` for every label that has a setting."""
    wanted = [*LABEL_SETTINGS, *((label, "action") for label in dict(LABEL_SETTINGS))]
    links = settings.sparkSession.createDataFrame(wanted, "label string, setting string")
    is_action = F.col("setting") == "action"
    return links.join(settings, "setting", "left").groupBy("label").agg(
        F.bool_or(~is_action & F.coalesce(F.col("value") == "true", F.lit(False))).alias("enabled"),
        F.max(F.when(is_action, F.col("value"))).alias("action"),
    )


def with_action(comments: DataFrame, settings: DataFrame, label: str = "label") -> DataFrame:
    """Add ``action``: blur, remove, or none. The policy has at most one row per label."""
    policy = F.broadcast(
        label_policy(settings).select(F.col("label").alias("__label"), "enabled", F.col("action").alias("__action"))
    )
    chosen = F.when(F.col("enabled") & F.col("__action").isin("blur", "remove"), F.col("__action"))
    return (
        comments.join(policy, F.col(label) == F.col("__label"), "left")
        .withColumn("action", F.coalesce(chosen, F.lit("none")))
        .drop("__label", "enabled", "__action")
    )


def cascade_threads(comments: DataFrame, thread: str = "thread_id", is_top: str = "is_top") -> DataFrame:
    """Add ``hidden``: a removed top-level comment hides its thread, a removed reply only itself.

    The join side holds one row per removed thread; a hot thread is split by the adaptive skew
    join, or the side is broadcast when its measured size allows.
    """
    removed = F.col("action") == "remove"
    threads = comments.filter(removed & F.col(is_top)).select(thread).distinct().withColumn("__gone", F.lit(True))
    return (
        comments.join(threads, thread, "left")
        .withColumn("hidden", removed | F.coalesce("__gone", F.lit(False)))
        .drop("__gone")
    )

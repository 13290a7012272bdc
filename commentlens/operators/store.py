"""Comment-table operators: merge by key, and the stored-row filters."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from commentlens.functions.html import display_text, permalink
from commentlens.operators.ranking import first_per_key, seeded_order
from commentlens.schema import COMMENTS, DATASET_COLUMNS, REQUIRED

REVIEW_SCORE = 0.95


# --- merging -----------------------------------------------------------------------------


def new_rows(incoming: DataFrame, stored: DataFrame, key: str = "comment_id") -> DataFrame:
    """Incoming rows whose key is not stored yet."""
    return incoming.join(stored.select(key), key, "left_anti")


def complete_rows(df: DataFrame, required=REQUIRED) -> DataFrame:
    """Rows without a NULL in a required column; the others are skipped silently."""
    present = [c for c in required if c in df.columns]
    return df.filter(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in present)))


def insertable(incoming: DataFrame, stored: DataFrame, order, key: str = "comment_id") -> DataFrame:
    """What an insert-or-ignore adds: complete rows, first per key by ``order``, key not stored.

    Repeats go first, before the shuffle, so the join never sees a hot incoming key; it reuses
    the partitioning by key.
    """
    return new_rows(first_per_key(complete_rows(incoming), [key], order), stored, key)


def insert_or_ignore(stored: DataFrame, incoming: DataFrame, order, key: str = "comment_id") -> DataFrame:
    """The table after the insert; stored rows never change."""
    return stored.unionByName(insertable(incoming, stored, order, key).select(*stored.columns))


def update_by_key(stored: DataFrame, updates: DataFrame, order=None, key: str = "comment_id") -> DataFrame:
    """Overwrite whole rows by key. Unknown keys are ignored and an update may set NULL.

    With several updates per key the first by ``order`` wins (pass a descending order for
    last-wins). Without ``order`` the updates must already be unique per key.
    """
    if order is not None:
        updates = first_per_key(updates, [key], order)
    changed = [c for c in stored.columns if c != key and c in updates.columns]
    packed = updates.select(F.col(key), F.struct(*changed).alias("__new"))
    merged = stored.join(packed, key, "left")
    hit = F.col("__new").isNotNull()
    return merged.select(
        *(F.when(hit, F.col("__new")[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c)
          for c in stored.columns)
    )


def not_downloaded(requested: DataFrame, landed: DataFrame) -> DataFrame:
    """Requested videos that have no landed document."""
    return requested.join(landed.select("video_id"), "video_id", "left_anti")


# --- filters -----------------------------------------------------------------------------


def unmoderated(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("moderated"))


def moderated(df: DataFrame) -> DataFrame:
    return df.filter(F.col("moderated"))


def by_id(df: DataFrame, comment_id: str | int, key: str = "comment_id") -> DataFrame:
    """The row with this id, or no row. The id must have the type of the column, or the filter does not reach the scan."""
    return df.filter(F.col(key) == F.lit(comment_id).cast(df.schema[key].dataType))


def review_eligible(df: DataFrame, min_score: float = REVIEW_SCORE) -> DataFrame:
    """Unreviewed rows that carry a propagated score."""
    return unmoderated(df).filter(F.col("score") >= min_score)


def recheck_set(df: DataFrame, label: str = "SCAM") -> DataFrame:
    return unmoderated(df).filter(F.col("label") == label)


def training_eligible(df: DataFrame) -> DataFrame:
    """VALID rows, and reviewed rows with another label; unlabelled rows drop out."""
    return df.filter(((F.col("label") != "VALID") & F.col("moderated")) | (F.col("label") == "VALID"))


def dataset_columns(df: DataFrame) -> DataFrame:
    return df.select(*DATASET_COLUMNS)


def comment_ids(df: DataFrame) -> DataFrame:
    return df.select("comment_id").distinct()


def link_column() -> Column:
    return permalink(F.col("video_id"), F.col("comment_id"))


def display_column() -> Column:
    return display_text(F.col("author_name"), F.col("text"))


# --- caller SQL --------------------------------------------------------------------------


def comments_sql(
    spark: SparkSession,
    statement: str,
    parameters: dict | list | None = None,
    shuffle: bool = False,
    seed: str = "0",
    **tables: DataFrame,
) -> DataFrame:
    """Caller-supplied SQL with bound parameters; ``{name}`` refers to a DataFrame argument.

    ``shuffle`` adds a reproducible random order and refuses SQL that already orders or limits.
    """
    if shuffle and re.search("ORDER BY|LIMIT", statement):
        raise ValueError("a random order cannot be combined with ORDER BY or LIMIT")
    result = spark.sql(statement, args=parameters, **tables)
    unknown = set(result.columns) - set(COMMENTS.names)
    if unknown:
        raise ValueError(f"not comment columns: {sorted(unknown)}")
    return result.orderBy(seeded_order(seed, "comment_id")) if shuffle else result

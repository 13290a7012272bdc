"""Training set: eligible rows, de-duplicated, capped per label, split."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commentlens.operators import store
from commentlens.operators.ranking import first_per_key, seeded_order, top_n_per_key
from commentlens.schema import labels_dim
from commentlens.session import written_table

MAX_PER_LABEL = 25_000
SEED = "commentlens"

# 80/10/10 as thresholds on the first eight hex digits of the split hash.
SPLIT_TRAIN_BELOW, SPLIT_VALID_BELOW = "cccccccc", "e6666666"


def dedupe_author_text(df: DataFrame, seed: str = SEED) -> DataFrame:
    """First row per (author_name, text) in the seeded order.

    A 64-bit hash leads the key so that sorting rarely compares whole texts; equality is
    still decided on the columns themselves.
    """
    keyed = df.withColumns({"__pair": F.xxhash64("author_name", "text"),
                            "__order": seeded_order(seed, "comment_id")})
    return first_per_key(keyed, ["__pair", "author_name", "text"], ["__order", "comment_id"]).drop(
        "__pair", "__order"
    )


def cap_per_label(df: DataFrame, cap: int = MAX_PER_LABEL, seed: str = SEED) -> DataFrame:
    """At most ``cap`` rows per label, lowest in the seeded order; reads ``df`` twice."""
    keyed = df.withColumn("__order", seeded_order(seed, "comment_id"))
    # labels are an enumeration of eleven values, so the cut table is broadcast
    return top_n_per_key(keyed, ["label"], "__order", cap, "comment_id", small_keys=True).drop("__order")


def split_column(seed: str = SEED, key: str = "comment_id") -> Column:
    """train / valid / test by hash, 80/10/10 in expectation, stable under re-runs."""
    prefix = F.substring(F.md5(F.concat(F.lit(f"{seed}|split|"), F.col(key))), 1, 8)
    return (
        F.when(prefix < SPLIT_TRAIN_BELOW, "train").when(prefix < SPLIT_VALID_BELOW, "valid").otherwise("test")
    )


def build_dataset(comments: DataFrame, cap: int = MAX_PER_LABEL, seed: str = SEED) -> DataFrame:
    """Eligible, then de-duplicated, then capped rows with their ``split``.

    Rows are chosen by id, label and a digest of author and text; texts are read again for the chosen ids only.
    """
    eligible = store.training_eligible(comments)
    pair = F.sha2(F.to_json(F.struct("author_name", "text")), 256)
    keys = eligible.select("comment_id", "label", pair.alias("__pair")).withColumn("__order", seeded_order(seed, "comment_id"))
    unique = first_per_key(keys, ["__pair"], ["__order", "comment_id"]).select("comment_id", "label")
    chosen = cap_per_label(written_table(unique, "dataset-unique"), cap, seed).select("comment_id")
    return store.dataset_columns(eligible).join(chosen, "comment_id", "left_semi").withColumn("split", split_column(seed))


def cap_split_rows(df: DataFrame, caps: dict[str, int], seed: str = SEED) -> DataFrame:
    """First N rows, in the seeded order, of each capped split; other splits stay whole."""
    parts = [df.filter(~F.col("split").isin(*caps))] if caps else [df]
    for split, n in caps.items():
        rows = df.filter(F.col("split") == split).withColumn("__order", seeded_order(seed, "comment_id"))
        parts.append(top_n_per_key(rows, ["split"], "__order", n, "comment_id", small_keys=True).drop("__order"))
    return reduce(DataFrame.unionByName, parts)


def sample_rows(df: DataFrame, n: int = 3, seed: str = SEED) -> DataFrame:
    """A few random rows to look at."""
    return df.orderBy(seeded_order(seed, "comment_id"), "comment_id").limit(n)


def label_counts(df: DataFrame, column: str = "label") -> DataFrame:
    """Rows per label; every label appears, also with zero."""
    counts = df.groupBy(F.col(column).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return (
        labels_dim(df.sparkSession).join(counts, F.col("label_name") == F.col("label"), "left")
        .select(F.col("label_name").alias("label"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
    )


def shuffled(df: DataFrame, seed: str = SEED) -> DataFrame:
    """Reproducible random order, as a distributed sort."""
    return df.orderBy(seeded_order(seed, "comment_id"), "comment_id")

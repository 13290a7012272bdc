"""Skew-safe building blocks: one row per key, top n per key, first and last rows, ranks.

A key may own a third of the table, so nothing here puts all rows of a key in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from commentlens.session import cut_lineage

_N, _BUCKET = "__n", "__bucket"


def seeded_order(seed: str, key: str) -> Column:
    """Reproducible random order: a uniform hex hash of seed and key."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(key)))


def first_per_key(df: DataFrame, keys, order) -> DataFrame:
    """First row per key. The literal rank limit is applied before the shuffle as well, so a
    hot key sends one row per task."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(_N, F.row_number().over(window)).filter(F.col(_N) == 1).drop(_N)


def edge_rows(df: DataFrame, keys, order, n: int = 3) -> DataFrame:
    """First ``n`` and last ``n`` rows per key with ``side`` and ``position``; small groups overlap.

    Each side is its own rank-limited window; one window with both ranks could not be limited
    before the shuffle.
    """
    last = [F.desc(o) if isinstance(o, str) else o.desc() for o in order]
    sides = []
    for side, by in (("first", list(order)), ("last", last)):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*by))
        sides.append(
            df.withColumn("position", rank).filter(F.col("position") <= n)
            .withColumns({"side": F.lit(side), "position": F.col("position").cast("bigint")})
        )
    return sides[0].unionByName(sides[1])


def top_n_per_key(df: DataFrame, keys, order: str, n: int, tie: str, small_keys: bool = False) -> DataFrame:
    """The ``n`` lowest rows per key by the uniform hex column ``order`` (ties by ``tie``), exactly.

    A histogram over hash prefixes finds the prefix where each key reaches ``n``; only rows up
    to that prefix are shuffled and ranked. ``df`` is read twice, so pass a stored table.
    ``small_keys`` states that the number of distinct keys has a fixed bound.
    """
    bucketed = df.withColumn(_BUCKET, F.substring(order, 1, 4))
    counts = bucketed.groupBy(*keys, _BUCKET).agg(F.count(F.lit(1)).alias(_N))
    running = Window.partitionBy(*keys).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    cuts = (
        counts.withColumn("__before", F.coalesce(F.sum(_N).over(running), F.lit(0)))
        .filter(F.col("__before") < n)
        .groupBy(*keys)
        .agg(F.max(F.struct(_BUCKET, "__before")).alias("__cut"))
        .select(*(F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)), "__cut")
    )
    if small_keys:
        cuts = F.broadcast(cuts)
    same = [F.col(k).eqNullSafe(F.col(f"__key{i}")) for i, k in enumerate(keys)]
    kept = bucketed.join(cuts, [*same, F.col(_BUCKET) <= F.col("__cut")[_BUCKET]], "inner")
    rank = F.row_number().over(Window.partitionBy(*keys, _BUCKET).orderBy(order, tie))
    # only the last prefix can overflow; earlier ones fit whole
    return (
        kept.withColumn(_N, rank)
        .filter(F.col(_N) <= n)
        .filter((F.col(_BUCKET) < F.col("__cut")[_BUCKET]) | (F.col(_N) <= n - F.col("__cut.__before")))
        .select(*df.columns)
    )


def rank_within(df: DataFrame, keys, order, name: str = "rank", max_group_rows: int = 2_000_000) -> DataFrame:
    """``row_number`` per key over a unique order.

    Groups up to ``max_group_rows`` use a window. If any group is larger, rows are ranked by
    a range partitioning of (key, order): a local rank plus the rows of the key in earlier
    partitions. The range partitions are checkpointed, so both uses see the same ones.
    """
    largest = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(_N)).agg(F.max(_N)).first()[0] or 0
    if largest <= max_group_rows:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint"))
    placed = cut_lineage(
        df.repartitionByRange(*(F.col(k) for k in keys), *order).withColumn("__part", F.spark_partition_id())
    )
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias(_N))
        .withColumn("__offset", F.coalesce(F.sum(_N).over(earlier), F.lit(0)))
        .drop(_N)
    )
    local = F.row_number().over(Window.partitionBy(*keys, "__part").orderBy(*order))
    return (
        placed.withColumn(name, local)
        .join(offsets, [*keys, "__part"])
        .withColumn(name, (F.col(name) + F.col("__offset")).cast("bigint"))
        .drop("__part", "__offset")
    )

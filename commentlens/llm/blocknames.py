"""Exact de-duplication by block naming, with DataFrame functions only.

Every normalised text is cut into blocks of ``BLOCK_BYTES``. The distinct blocks are sorted and a
block's rank becomes its integer name, so equal blocks, and only those, share a name. Adjacent
names are paired and the pairs named in the same way, level by level, until one name is left per
text. A text's identity is (level, name): two texts have the same identity exactly if they are equal.

The sort key of a block is its 64-bit hash followed, for the hashes that more than one block has, by
the block itself. Ties are therefore broken by content, and block bytes cross the network once, as
distinct blocks. Ranks are taken inside a fixed number of key ranges, so no step sees all names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from commentlens.llm.wordhash import SPACE
from commentlens.session import written_table

BLOCK_BYTES = 1024
#: Key ranges in which ranks are taken; a rank of range b becomes the name rank * RANGES + b.
RANGES = 1 << 16


def collapsed(text: Column) -> Column:
    """The text with every run of separators replaced by one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def _named(keys: DataFrame, columns: list[str], ranges: int) -> DataFrame:
    """Distinct keys with a name, which is their rank inside a key range."""
    distinct = keys.select(*columns).distinct().withColumn("range", F.pmod(F.xxhash64(*columns), F.lit(ranges)))
    rank = F.row_number().over(Window.partitionBy("range").orderBy(*columns)).cast("long")
    return distinct.select(*columns, (rank * ranges + F.col("range")).alias("name"))


def _blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int, hash_bits: int) -> DataFrame:
    """One row per block: row, id, n_blocks, pos, h (the leading sort digit), bytes, sha (first block only).

    An empty text has one empty block. Blocks are cut from bytes, where a cut costs only its own length.
    """
    texts = docs.select(
        F.monotonically_increasing_id().alias("row"), docs[id_col].cast("long").alias("id"),
        collapsed(docs[text_col]).cast("binary").alias("data"),
    )
    size = F.greatest(F.lit(1), F.ceil(F.length("data") / block_bytes).cast("int"))
    cut = F.transform(
        F.sequence(F.lit(0), F.col("n_blocks") - 1),
        lambda i: F.struct(
            i.alias("pos"), F.substring(F.col("data"), i * block_bytes + 1, F.lit(block_bytes)).alias("bytes"),
            F.when(i == 0, F.sha2("data", 256)).alias("sha"),
        ),
    )
    return (
        texts.withColumn("n_blocks", size).select("row", "id", "n_blocks", F.explode(cut).alias("b"))
        .select("row", "id", "n_blocks", "b.*")
        .withColumn("h", F.shiftrightunsigned(F.xxhash64("bytes"), 64 - hash_bits))
    )


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES,
                     ranges: int = RANGES, hash_bits: int = 64) -> DataFrame:
    """One row per input row: the id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal if identical after every separator run became one space; null counts as empty.
    The smallest id of a group stays. A null id sorts after all others, so it stays only in a group
    without any id, whose ``keep_id`` is null. Of rows that repeat both id and text one is kept.
    An empty table gives an empty result; other columns are ignored, whatever their names.
    ``hash_bits`` shortens the leading sort digit (tests use it to make ties).
    """
    blocks = _blocks(docs, id_col, text_col, block_bytes, hash_bits)
    shared = written_table(
        blocks.select("h", "bytes").distinct().groupBy("h").count().where("count > 1").select("h"), "block-ties",
    )
    # an empty tie compares equal in joins, which a null would not
    if shared.isEmpty():
        keys = blocks.withColumn("tie", F.lit(b""))
    else:
        keys = blocks.join(shared.withColumn("tied", F.lit(True)), "h", "left").withColumn(
            "tie", F.when(F.col("tied"), F.col("bytes")).otherwise(F.lit(b"")))
    # row numbers are fixed here, once: every later pass reads this table
    keys = written_table(keys.drop("bytes"), "block-keys")
    names = written_table(_named(keys, ["h", "tie"], ranges), "block-names")
    level = written_table(keys.join(names, ["h", "tie"]).select("row", "n_blocks", "pos", "name"), "block-level")

    done, depth = [], 0
    while True:
        done.append(level.where("n_blocks = 1").select("row", F.lit(depth).alias("level"), "name"))
        if (level.agg(F.max("n_blocks")).first()[0] or 0) <= 1:
            break
        pairs = (
            level.where("n_blocks > 1").groupBy("row", "n_blocks", F.floor(F.col("pos") / 2).cast("int").alias("pos"))
            .agg(
                F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
                F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"),
            )
        )
        names = written_table(_named(pairs, ["a", "b"], ranges), "pair-names")
        half = F.ceil(F.col("n_blocks") / 2).cast("int").alias("n_blocks")
        level = written_table(pairs.join(names, ["a", "b"]).select("row", half, "pos", "name"), "pair-level")
        depth += 1
    named = reduce(DataFrame.unionByName, done)

    rows = keys.where("pos = 0").select("row", "id", "sha")
    found = written_table(rows.join(named, "row"), "block-identities")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    groups = written_table(
        found.groupBy("level", "name").agg(F.min(order).alias("keep"), F.count(F.lit(1)).alias("group_size")), "block-groups",
    )
    return found.join(groups, ["level", "name"]).select(
        F.col("id").alias(id_col), F.col("keep.id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("keep.row")).alias("kept"), F.col("sha").alias("text_sha256"),
    )

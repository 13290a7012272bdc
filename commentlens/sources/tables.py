"""Stored comments, dataset splits and prediction files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from commentlens.operators import store
from commentlens.operators.ranking import first_per_key
from commentlens.schema import COMMENTS, DATASET
from commentlens.session import written_table


#: Folders of a comment table, by hash of the id.
BUCKETS = 32


def bucket_of(key: str = "comment_id", buckets: int = BUCKETS):
    return F.pmod(F.xxhash64(F.lit("bucket"), key), F.lit(buckets)).cast("int")


def held_buckets(rows: DataFrame, buckets: int = BUCKETS, key: str = "comment_id") -> list[int]:
    """The buckets that the ids of ``rows`` fall in; at most ``buckets`` numbers."""
    return [r[0] for r in rows.select(bucket_of(key, buckets)).distinct().collect()]


class CommentTable:
    """A Parquet comment table in folders by id hash. Inserts append; a rewrite goes to a new path and returns it.

    An insert looks for its ids in the folders that may hold them, and in these only in files whose range of ids does.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def exists(self) -> bool:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop)

    def read(self) -> DataFrame:
        if not self.exists():
            return self.spark.createDataFrame([], COMMENTS)
        return self.spark.read.schema(COMMENTS).parquet(self.path).select(*COMMENTS.names)

    def near(self, rows: DataFrame) -> DataFrame:
        """The stored rows of the files that may hold an id of ``rows``."""
        if not self.exists():
            return self.read()
        ends = rows.agg(F.min("comment_id"), F.max("comment_id")).first()
        kept = self.spark.read.schema(T.StructType([*COMMENTS.fields, T.StructField("bucket", T.IntegerType())])).parquet(self.path)
        return kept.where(F.col("bucket").isin(held_buckets(rows)) & F.col("comment_id").between(ends[0], ends[1])).select(*COMMENTS.names)

    def _write(self, rows: DataFrame, path: str, mode: str) -> None:
        placed = rows.select(*COMMENTS.names, bucket_of().alias("bucket"))
        # one file per folder, in the order of ids, so that files outside a range of ids are skipped
        spread = placed.repartition(BUCKETS, "bucket").sortWithinPartitions("bucket", "comment_id")
        spread.write.mode(mode).partitionBy("bucket").parquet(path)

    def insert(self, incoming: DataFrame, order) -> None:
        """Insert-or-ignore: complete rows with unseen keys, first per key by ``order``."""
        fresh = written_table(first_per_key(store.complete_rows(incoming), ["comment_id"], order).select(*COMMENTS.names), "arrivals")
        self._write(store.new_rows(fresh, self.near(fresh)), self.path, "append")

    def rewrite(self, result: DataFrame, path: str) -> "CommentTable":
        """Write a result derived from this table (such as an update by key) to a new path."""
        self._write(result, path, "error")
        return CommentTable(self.spark, path)


def write_dataset(dataset: DataFrame, path: str) -> None:
    """JSON Lines, one folder per split."""
    dataset.write.mode("error").partitionBy("split").json(path)


def read_dataset(spark: SparkSession, path: str, splits=("train", "valid")) -> DataFrame:
    """Dataset rows with their ``split``. Pass ``test`` too when rows are to be predicted."""
    schema = T.StructType([*DATASET.fields, T.StructField("split", T.StringType())])
    return spark.read.schema(schema).json(path).filter(F.col("split").isin(*splits))


def write_predictions(predictions: DataFrame, path: str) -> None:
    """Tab-separated ``index, text, prediction`` with a header, a record per line.

    Tabs, line breaks, zero characters and backslashes are escaped by a backslash, and no value is written as ``\\N``. So
    files split between lines, whatever the texts hold.
    """
    rows = predictions.select("index", _escaped("text"), _escaped("prediction"))
    rows.write.mode("error").options(**_LINES).csv(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_predictions`` wrote; large files are read by several tasks."""
    rows = spark.read.schema("index bigint, text string, prediction string").options(**_LINES).csv(path)
    return rows.select("index", _unescaped("text"), _unescaped("prediction"))


# no quotes, and nothing that the reader would take for an empty value
_LINES = {"sep": "\t", "header": True, "quote": "", "emptyValue": "", "nullValue": "\0", "ignoreLeadingWhiteSpace": False,
          "ignoreTrailingWhiteSpace": False, "lineSep": "\n", "maxCharsPerColumn": -1, "escape": "\0"}
_ESCAPES = (("\t", r"\t"), ("\n", r"\n"), ("\r", r"\r"), ("\0", r"\0"))


def _escaped(name: str):
    text = F.replace(F.col(name), F.lit("\\"), F.lit("\\\\"))
    for char, spelt in _ESCAPES:
        text = F.replace(text, F.lit(char), F.lit(spelt))
    return F.coalesce(text, F.lit(r"\N")).alias(name)


def _unescaped(name: str):
    def restored(part):
        for char, spelt in _ESCAPES:
            part = F.replace(part, F.lit(spelt), F.lit(char))
        return part

    # between doubled backslashes each single one begins an escape
    parts = F.transform(F.split(F.coalesce(F.col(name), F.lit("")), r"\\\\"), restored)
    return F.when(F.coalesce(F.col(name) != r"\N", F.lit(True)), F.array_join(parts, "\\")).alias(name)

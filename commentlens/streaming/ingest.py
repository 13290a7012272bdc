"""Incremental ingest: new thread files become new rows of the comment table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from commentlens.schema import THREAD_DOCUMENT
from commentlens.sources.tables import CommentTable
from commentlens.sources.threads import ARRIVAL, cap_pages, existing_videos, flatten, read_threads


def ingest(documents: DataFrame, table: CommentTable) -> None:
    """Flatten and insert-or-ignore; the earliest file, page and position wins a repeated id."""
    table.insert(flatten(documents), [F.col(c) for c in ARRIVAL])


def ingest_folder(spark: SparkSession, folder: str, table: CommentTable, **options) -> None:
    """One pass over all documents in a folder."""
    ingest(read_threads(spark, folder, **options), table)


def stream_documents(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """New files of a folder as a stream of documents; files seen before are not read again."""
    reader = spark.readStream.schema(THREAD_DOCUMENT)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(folder).withColumn("file", F.col("_metadata.file_path"))


def ingest_stream(documents: DataFrame, table: CommentTable, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Insert-or-ignore per micro-batch; a replayed batch finds its ids stored and adds nothing."""
    pruned = cap_pages(existing_videos(documents))
    writer = (
        pruned.writeStream.foreachBatch(lambda batch, _: ingest(batch, table))
        .option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if once else writer).start()

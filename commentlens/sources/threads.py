"""Thread documents: read, prune, flatten, land."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commentlens.schema import THREAD_DOCUMENT

MAX_REQUESTS = 10


def read_threads(spark: SparkSession, path: str, one_document_per_file: bool = False) -> DataFrame:
    """Thread documents from JSON with a fixed schema, plus the ``file`` they came from.

    JSON Lines splits across tasks; ``one_document_per_file`` reads a whole file as one object.
    """
    reader = spark.read.schema(THREAD_DOCUMENT).option("multiLine", one_document_per_file)
    return reader.json(path).withColumn("file", F.col("_metadata.file_path"))


def land_threads(documents: DataFrame, path: str, mode: str = "append") -> None:
    """Land documents with the time of retrieval as JSON Lines."""
    stamped = documents.withColumn("retrieval_time", F.unix_micros(F.current_timestamp()) / 1e6)
    stamped.select(*THREAD_DOCUMENT.names).write.mode(mode).json(path)


def land_raw(documents: DataFrame, path: str, mode: str = "append") -> None:
    """Land documents with every field they have: ``video_id``, ``video_info`` and ``comments_info`` of the JSON column ``document``.

    The time of retrieval is added. ``video_info`` and ``comments_info`` are variants, so unknown keys survive.
    """
    whole = F.parse_json("document")
    rows = documents.select(
        F.variant_get(whole, "$.video_id", "string").alias("video_id"),
        (F.unix_micros(F.current_timestamp()) / 1e6).alias("retrieval_time"),
        F.variant_get(whole, "$.video_info", "variant").alias("video_info"),
        F.variant_get(whole, "$.comments_info", "variant").alias("comments_info"),
    )
    rows.select(F.to_json(F.struct("*")).alias("value")).write.mode(mode).text(path)


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Landed documents, one per line: ``video_id``, ``retrieval_time`` and the variants ``video_info``, ``comments_info``, with their ``file``."""
    whole = F.try_parse_json("value")
    return spark.read.text(path).select(
        F.try_variant_get(whole, "$.video_id", "string").alias("video_id"),
        F.try_variant_get(whole, "$.retrieval_time", "double").alias("retrieval_time"),
        F.try_variant_get(whole, "$.video_info", "variant").alias("video_info"),
        F.try_variant_get(whole, "$.comments_info", "variant").alias("comments_info"),
        F.col("_metadata.file_path").alias("file"),
    )


def typed(raw: DataFrame) -> DataFrame:
    """Raw documents with the fixed schema that ``flatten`` reads."""
    whole = F.from_json(F.to_json(F.struct("video_id", "retrieval_time", "video_info", "comments_info")), THREAD_DOCUMENT)
    return raw.select(whole.alias("__d"), "file").select("__d.*", "file")


def existing_videos(documents: DataFrame) -> DataFrame:
    """Documents of videos that exist; the others keep no pages."""
    return documents.filter(F.size("video_info.items") > 0)


def cap_pages(documents: DataFrame, max_requests: int = MAX_REQUESTS) -> DataFrame:
    """Keep the first ``max_requests + 1`` pages of each document (the request test is ``>``)."""
    return documents.withColumn("comments_info", F.slice("comments_info", 1, max_requests + 1))


def flatten(documents: DataFrame) -> DataFrame:
    """One row per comment: each top-level comment and its replies, with position columns.

    Both kinds come out of one generator per thread, so the documents are scanned once.
    """
    carried = [c for c in ("file",) if c in documents.columns]
    pages = documents.select(*carried, F.posexplode("comments_info").alias("page_no", "page"))
    threads = pages.select(*carried, "page_no", F.posexplode("page.items").alias("thread_no", "thread"))
    top = F.col("thread.snippet.topLevelComment")
    replies = F.coalesce(F.col("thread.replies.comments"), F.array())
    nodes = threads.select(
        *carried, "page_no", "thread_no", top["id"].alias("thread_id"),
        F.posexplode(F.concat(F.array(top), replies)).alias("node_no", "node"),
    )
    snippet = F.col("node.snippet")
    return nodes.select(
        F.col("node.id").alias("comment_id"),
        snippet["videoId"].alias("video_id"),
        snippet["textOriginal"].alias("text"),
        snippet["likeCount"].alias("likes"),
        snippet["publishedAt"].alias("publish_date"),
        snippet["updatedAt"].alias("update_date"),
        snippet["authorDisplayName"].alias("author_name"),
        snippet["authorProfileImageUrl"].alias("author_profile_url"),
        snippet["authorChannelId"]["value"].alias("author_channel_id"),
        F.lit(None).cast("string").alias("label"),
        F.lit(None).cast("double").alias("score"),
        F.lit(False).alias("moderated"),
        "thread_id",
        (F.col("node_no") == 0).alias("is_top"),
        *carried, "page_no", "thread_no", "node_no",
    )


# order in which rows of several documents are inserted
ARRIVAL = ("file", "page_no", "thread_no", "node_no")

"""Fixed schemas of the comment table, the thread documents and the label dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# The label names, in id order.
LABELS = (
    "VALID", "SCAM", "SELF_PROMO", "OTHER_PROMO", "SPONSOR", "EXPLICIT",
    "LINK_SPAM", "LINK_ONLY", "LINK_CONTAINS", "OTHER_SPAM", "REPLY_TO_SCAM",
)

COMMENTS = T.StructType([
    T.StructField("comment_id", T.StringType(), False),
    T.StructField("video_id", T.StringType(), False),
    T.StructField("text", T.StringType(), False),
    T.StructField("likes", T.LongType(), False),
    T.StructField("publish_date", T.StringType(), False),
    T.StructField("update_date", T.StringType(), False),
    T.StructField("author_name", T.StringType(), False),
    T.StructField("author_profile_url", T.StringType(), False),
    T.StructField("author_channel_id", T.StringType(), False),
    T.StructField("label", T.StringType(), True),
    T.StructField("score", T.DoubleType(), True),
    T.StructField("moderated", T.BooleanType(), False),
])

REQUIRED = tuple(f.name for f in COMMENTS.fields if not f.nullable)

DATASET_COLUMNS = ("comment_id", "video_id", "author_channel_id", "author_name", "text", "label")

DATASET = T.StructType([T.StructField(name, T.StringType()) for name in DATASET_COLUMNS])

_COMMENT_NODE = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("snippet", T.StructType([
        T.StructField("videoId", T.StringType()),
        T.StructField("textOriginal", T.StringType()),
        T.StructField("likeCount", T.LongType()),
        T.StructField("publishedAt", T.StringType()),
        T.StructField("updatedAt", T.StringType()),
        T.StructField("authorDisplayName", T.StringType()),
        T.StructField("authorProfileImageUrl", T.StringType()),
        T.StructField("authorChannelId", T.StructType([T.StructField("value", T.StringType())])),
    ])),
])

_THREAD_ITEM = T.StructType([
    T.StructField("snippet", T.StructType([T.StructField("topLevelComment", _COMMENT_NODE)])),
    T.StructField("replies", T.StructType([T.StructField("comments", T.ArrayType(_COMMENT_NODE))])),
])

THREAD_DOCUMENT = T.StructType([
    T.StructField("video_id", T.StringType()),
    T.StructField("retrieval_time", T.DoubleType()),
    T.StructField("video_info", T.StructType([
        T.StructField("items", T.ArrayType(T.StructType([T.StructField("id", T.StringType())]))),
    ])),
    T.StructField("comments_info", T.ArrayType(T.StructType([
        T.StructField("items", T.ArrayType(_THREAD_ITEM)),
    ]))),
])


def labels_dim(spark: SparkSession) -> DataFrame:
    """The eleven labels: ``label_name``, 1-based ``label_id``, 0-based ``model_id``."""
    rows = [(name, i + 1, i) for i, name in enumerate(LABELS)]
    return spark.createDataFrame(rows, "label_name string, label_id bigint, model_id bigint")

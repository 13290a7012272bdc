"""Queries for sources, sinks, the comment table and the dataset."""

from __future__ import annotations

from pyspark.sql import functions as F

from commentlens.operators import dataset, store
from commentlens.operators.ranking import first_per_key
from commentlens.plans import views
from commentlens.plans.registry import query, table
from commentlens.schema import labels_dim
from commentlens.session import work_path, written_table
from commentlens.sources import tables, threads

SPLIT_SQL = f"""CASE WHEN substr(md5('{dataset.SEED}|split|' || comment_id), 1, 8) < '{dataset.SPLIT_TRAIN_BELOW}' THEN 'train'
    WHEN substr(md5('{dataset.SEED}|split|' || comment_id), 1, 8) < '{dataset.SPLIT_VALID_BELOW}' THEN 'valid'
    ELSE 'test' END"""
ORDER_SQL = f"md5('{dataset.SEED}|' || comment_id), comment_id"
ELIGIBLE_SQL = views.COMMENTS_SQL + """
, eligible AS (SELECT * FROM comments WHERE (label <> 'VALID' AND moderated) OR label = 'VALID')"""
DEDUPED_SQL = ELIGIBLE_SQL + f"""
, deduped AS (SELECT * FROM eligible
    QUALIFY row_number() OVER (PARTITION BY author_name, text ORDER BY {ORDER_SQL}) = 1)"""
CAP = 100
CAPPED_SQL = DEDUPED_SQL + f"""
, capped AS (SELECT *, {SPLIT_SQL} AS split FROM deduped
    QUALIFY row_number() OVER (PARTITION BY label ORDER BY {ORDER_SQL}) <= {CAP})"""


# --- threads ---------------------------------------------------------------------------------


@query("thread_flatten", f"""
    WITH {views.THREADS_SQL}
    SELECT comment_id, video_id, text, length(text) AS likes, author_channel_id, thread_id, is_top FROM threads""")
def thread_flatten(spark, folder):
    path = work_path(spark, "threads")
    threads.land_threads(views.documents_nested(spark, folder), path)
    rows = threads.flatten(threads.read_threads(spark, path))
    return rows.select("comment_id", "video_id", "text", "likes", "author_channel_id", "thread_id", "is_top")


@query("raw_envelope", f"""
    WITH {views.THREADS_SQL}
    SELECT comment_id, video_id, text, 'e' || conv_id AS etag, 'p' || conv_id || '.' || (turn // 64) AS token FROM threads""")
def raw_envelope(spark, folder):
    """Documents with keys that no schema names are landed and read again; these keys and the comments come back."""
    nested = views.documents_nested(spark, folder)
    page = F.transform("comments_info", lambda p: F.struct(p["items"].alias("items"), F.lit("next").alias("nextPageToken")))
    number = F.substring("video_id", 2, 20)
    first_turn = F.col("comments_info")[0]["items"][0]["snippet"]["topLevelComment"]["id"]
    part = F.expr("split_part(first_turn, '.', 2) div 64")
    documents = nested.withColumn("first_turn", first_turn).select(F.to_json(F.struct(
        "video_id", F.struct(F.col("video_info.items").alias("items"), F.concat(F.lit("e"), number).alias("etag"),
                             F.concat(F.lit("p"), number, F.lit("."), part.cast("string")).alias("token")).alias("video_info"),
        page.alias("comments_info"))).alias("document"))
    path = work_path(spark, "raw")
    threads.land_raw(documents, path)
    raw = threads.read_raw(spark, path)
    keys = [F.variant_get("video_info", f"$.{k}", "string").alias(k) for k in ("etag", "token")]
    tokens = raw.where(F.variant_get("comments_info", "$[0].nextPageToken", "string") == "next").select("video_id", *keys)
    rows = threads.flatten(threads.typed(raw))
    part_of = F.concat(F.lit("p"), F.substring("video_id", 2, 20), F.lit("."), F.expr("split_part(thread_id, '.', 2) div 64").cast("string"))
    joined = rows.withColumn("token", part_of).join(tokens, ["video_id", "token"])
    return joined.select("comment_id", "video_id", "text", "etag", "token")


@query("page_cap", f"""
    WITH {views.THREADS_SQL}
    SELECT comment_id, page AS page_no FROM threads WHERE page <= 2""")
def page_cap(spark, folder):
    capped = threads.cap_pages(views.documents_nested(spark, folder), max_requests=2)
    return threads.flatten(capped).select("comment_id", F.col("page_no").cast("bigint").alias("page_no"))


@query("existing_videos", f"""
    WITH {views.THREADS_SQL}
    SELECT comment_id, video_id FROM threads WHERE conv_id % 5 <> 0""")
def existing_videos(spark, folder):
    kept = threads.existing_videos(views.documents_nested(spark, folder))
    return threads.flatten(kept).select("comment_id", "video_id")


@query("ingest_table", f"""
    WITH {views.THREADS_SQL}
    SELECT comment_id, video_id, text, author_channel_id, false AS moderated FROM threads
    WHERE author_channel_id IS NOT NULL""")
def ingest_table(spark, folder):
    """Documents landed twice, ingested twice: each complete comment is stored once."""
    from commentlens.streaming.ingest import ingest_folder

    path = work_path(spark, "threads")
    documents = views.documents_nested(spark, folder)
    comments = tables.CommentTable(spark, work_path(spark, "comments"))
    for _ in range(2):
        threads.land_threads(documents, path)
        ingest_folder(spark, path, comments)
    return comments.read().select("comment_id", "video_id", "text", "author_channel_id", "moderated")


@query("skip_downloaded", """
    SELECT DISTINCT 'v' || conv_id AS video_id FROM conversations
    WHERE conv_id NOT IN (SELECT doc_id FROM labels)""")
def skip_downloaded(spark, folder):
    requested = table(spark, folder, "conversations").select(F.format_string("v%d", "conv_id").alias("video_id"))
    landed = table(spark, folder, "labels").select(F.format_string("v%d", "doc_id").alias("video_id"))
    return store.not_downloaded(requested.distinct(), landed)


# --- merging by key --------------------------------------------------------------------------


@query("new_rows_only", f"""
    WITH {views.COMMENTS_SQL}
    SELECT comment_id, video_id FROM comments
    WHERE comment_id NOT IN (SELECT cast(doc_id AS varchar) FROM labels)""")
def new_rows_only(spark, folder):
    stored = table(spark, folder, "labels").select(F.col("doc_id").cast("string").alias("comment_id"))
    return store.new_rows(views.comments(spark, folder), stored).select("comment_id", "video_id")


# arrivals repeat keys (two texts of one length share one) and lack some authors
_ARRIVALS_SQL = views.COMMENTS_SQL + """
, arrivals AS (
    SELECT 'k' || length(text) AS comment_id, video_id, text, doc_id,
           CASE WHEN author_name NOT LIKE 'de%' THEN author_channel_id END AS author_channel_id, label
    FROM comments)
, stored AS (SELECT * FROM arrivals WHERE label IS NOT NULL AND author_channel_id IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY comment_id ORDER BY doc_id) = 1)
, fresh AS (SELECT * FROM arrivals WHERE author_channel_id IS NOT NULL
    AND comment_id NOT IN (SELECT comment_id FROM stored)
    QUALIFY row_number() OVER (PARTITION BY comment_id ORDER BY doc_id) = 1)
"""


def _arrivals(spark, folder):
    return views.comments(spark, folder).select(
        F.concat(F.lit("k"), F.length("text").cast("string")).alias("comment_id"), "video_id", "text", "doc_id",
        F.when(~F.col("author_name").startswith("de"), F.col("author_channel_id")).alias("author_channel_id"),
        "label",
    )


@query("insert_or_ignore", f"""
    WITH {_ARRIVALS_SQL}
    SELECT comment_id, video_id, doc_id, author_channel_id FROM stored
    UNION ALL SELECT comment_id, video_id, doc_id, author_channel_id FROM fresh""")
def insert_or_ignore(spark, folder):
    arrivals = _arrivals(spark, folder)
    labelled = store.complete_rows(arrivals).filter(F.col("label").isNotNull())
    stored = first_per_key(labelled, ["comment_id"], [F.col("doc_id")])
    merged = store.insert_or_ignore(stored, arrivals, [F.col("doc_id")])
    return merged.select("comment_id", "video_id", "doc_id", "author_channel_id")


@query("update_by_key", f"""
    WITH {views.COMMENTS_SQL}, changes AS (
        SELECT cast(doc_id AS varchar) AS comment_id, CASE WHEN toxic = 0 THEN 'SPONSOR' END AS label, true AS moderated
        FROM labels)
    SELECT c.comment_id, c.video_id, CASE WHEN u.comment_id IS NULL THEN c.label ELSE u.label END AS label,
           coalesce(u.moderated, c.moderated) AS moderated
    FROM comments c LEFT JOIN changes u USING (comment_id)""")
def update_by_key(spark, folder):
    """Each key is updated twice and some keys are unknown; the later update wins and may set NULL."""
    ids = table(spark, folder, "labels")
    last = ids.select(
        F.col("doc_id").cast("string").alias("comment_id"),
        F.when(F.col("toxic") == 0, "SPONSOR").alias("label"), F.lit(True).alias("moderated"), F.lit(2).alias("turn"),
    )
    first = last.withColumns({"label": F.lit("EXPLICIT"), "moderated": F.lit(False), "turn": F.lit(1)})
    unknown = last.withColumn("comment_id", F.concat(F.lit("unknown"), "comment_id"))
    updates = first.unionByName(last).unionByName(unknown)
    merged = store.update_by_key(views.comments(spark, folder), updates, [F.desc("turn")])
    return merged.select("comment_id", "video_id", "label", "moderated")


# --- stored-row filters ----------------------------------------------------------------------


@query("unmoderated", f"WITH {views.COMMENTS_SQL} SELECT comment_id FROM comments WHERE NOT moderated")
def unmoderated(spark, folder):
    return store.unmoderated(views.comments(spark, folder)).select("comment_id")


@query("moderated", f"WITH {views.COMMENTS_SQL} SELECT comment_id, label FROM comments WHERE moderated")
def moderated(spark, folder):
    return store.moderated(views.comments(spark, folder)).select("comment_id", "label")


@query("point_lookup", f"WITH {views.COMMENTS_SQL} SELECT comment_id, text FROM comments WHERE comment_id = '42'")
def point_lookup(spark, folder):
    """The id column has its stored type, so the filter reaches the scan; nothing is shuffled."""
    documents = store.by_id(table(spark, folder, "documents"), 42, "doc_id")
    return documents.select(F.col("doc_id").cast("string").alias("comment_id"), "text")


@query("review_eligible", f"""
    WITH {views.COMMENTS_SQL} SELECT comment_id, score FROM comments WHERE NOT moderated AND score >= 0.5""")
def review_eligible(spark, folder):
    return store.review_eligible(views.comments(spark, folder), 0.5).select("comment_id", "score")


@query("recheck_set", f"""
    WITH {views.COMMENTS_SQL} SELECT comment_id, label FROM comments WHERE NOT moderated AND label = 'SCAM'""")
def recheck_set(spark, folder):
    return store.recheck_set(views.comments(spark, folder)).select("comment_id", "label")


@query("training_eligible", f"WITH {ELIGIBLE_SQL} SELECT comment_id, label, moderated FROM eligible")
def training_eligible(spark, folder):
    return store.training_eligible(views.comments(spark, folder)).select("comment_id", "label", "moderated")


@query("dataset_projection", f"""
    WITH {views.COMMENTS_SQL}
    SELECT comment_id, video_id, author_channel_id, author_name, text, label FROM comments""")
def dataset_projection(spark, folder):
    return store.dataset_columns(views.comments(spark, folder))


@query("permalink", f"""
    WITH {views.COMMENTS_SQL}
    SELECT comment_id, 'https://www.youtube.com/watch?v=' || video_id || '&lc=' || comment_id AS url,
           md5('[' || author_name || '] ' || text) AS display
    FROM comments""")
def permalink(spark, folder):
    return views.comments(spark, folder).select(
        "comment_id", store.link_column().alias("url"), F.md5(store.display_column()).alias("display")
    )


@query("caller_sql", f"""
    WITH {views.COMMENTS_SQL} SELECT comment_id, likes, label FROM comments WHERE likes >= 50 AND label = 'VALID'""")
def caller_sql(spark, folder):
    return store.comments_sql(
        spark, "SELECT comment_id, likes, label FROM {stored} WHERE likes >= :floor AND label = :label",
        {"floor": 50, "label": "VALID"}, shuffle=True, stored=views.comments(spark, folder),
    )


@query("distinct_ids", f"WITH {_ARRIVALS_SQL} SELECT DISTINCT comment_id FROM arrivals")
def distinct_ids(spark, folder):
    return store.comment_ids(_arrivals(spark, folder))


# --- dataset ---------------------------------------------------------------------------------


@query("dedupe_author_text", f"WITH {DEDUPED_SQL} SELECT comment_id, label FROM deduped")
def dedupe_author_text(spark, folder):
    eligible = store.training_eligible(views.comments(spark, folder))
    return dataset.dedupe_author_text(eligible).select("comment_id", "label")


@query("label_cap", f"WITH {CAPPED_SQL} SELECT comment_id, label FROM capped")
def label_cap(spark, folder):
    unique = dataset.dedupe_author_text(store.training_eligible(views.comments(spark, folder)))
    stored = written_table(unique.select("comment_id", "label"), "unique")
    return dataset.cap_per_label(stored, CAP)


@query("dataset_split", f"WITH {views.COMMENTS_SQL} SELECT comment_id, {SPLIT_SQL} AS split FROM comments")
def dataset_split(spark, folder):
    return views.comments(spark, folder).select("comment_id", dataset.split_column().alias("split"))


@query("dataset_build", f"""
    WITH {CAPPED_SQL}
    SELECT comment_id, video_id, author_channel_id, author_name, text, label, split FROM capped""")
def dataset_build(spark, folder):
    return dataset.build_dataset(views.comments(spark, folder), CAP)


@query("dataset_round_trip", f"""
    WITH {CAPPED_SQL}
    SELECT comment_id, video_id, author_channel_id, author_name, text, label, split FROM capped
    WHERE split IN ('train', 'valid')""")
def dataset_round_trip(spark, folder):
    path = work_path(spark, "dataset")
    tables.write_dataset(dataset.build_dataset(views.comments(spark, folder), CAP), path)
    return tables.read_dataset(spark, path)


@query("split_row_caps", f"""
    WITH {views.COMMENTS_SQL}, divided AS (SELECT comment_id, {SPLIT_SQL} AS split FROM comments)
    SELECT comment_id, split FROM divided
    QUALIFY row_number() OVER (PARTITION BY split ORDER BY {ORDER_SQL})
        <= CASE split WHEN 'train' THEN 200 WHEN 'valid' THEN 50 ELSE 1000000000 END""")
def split_row_caps(spark, folder):
    divided = views.comments(spark, folder).select("comment_id", dataset.split_column().alias("split"))
    return dataset.cap_split_rows(divided, {"train": 200, "valid": 50})


@query("training_sample", f"""
    WITH {views.COMMENTS_SQL}
    SELECT comment_id, label FROM comments WHERE {SPLIT_SQL} = 'train' ORDER BY {ORDER_SQL} LIMIT 3""")
def training_sample(spark, folder):
    train = views.comments(spark, folder).filter(dataset.split_column() == "train")
    return dataset.sample_rows(train).select("comment_id", "label")


@query("dataset_label_counts", f"""
    WITH {views.COMMENTS_SQL}, names(label) AS (VALUES {", ".join(f"('{n}')" for n in (
        "VALID", "SCAM", "SELF_PROMO", "OTHER_PROMO", "SPONSOR", "EXPLICIT", "LINK_SPAM", "LINK_ONLY",
        "LINK_CONTAINS", "OTHER_SPAM", "REPLY_TO_SCAM"))})
    SELECT names.label AS label, count(comment_id) AS n FROM names LEFT JOIN comments ON names.label = comments.label
    GROUP BY names.label""")
def dataset_label_counts(spark, folder):
    return dataset.label_counts(views.comments(spark, folder))


@query("label_ids", f"""
    WITH {views.COMMENTS_SQL}
    SELECT comment_id, CASE label WHEN 'VALID' THEN 0 WHEN 'SCAM' THEN 1 WHEN 'OTHER_SPAM' THEN 9 ELSE -1 END AS model_id
    FROM comments""")
def label_ids(spark, folder):
    comments = views.comments(spark, folder)
    # eleven labels
    ids = F.broadcast(labels_dim(spark).select(F.col("label_name").alias("label"), "model_id"))
    return comments.join(ids, "label", "left").select("comment_id", F.coalesce("model_id", F.lit(-1)).alias("model_id"))


@query("random_order", f"""
    WITH {views.COMMENTS_SQL}
    SELECT comment_id, md5('{dataset.SEED}|' || comment_id) AS place FROM comments""")
def random_order(spark, folder):
    rows = dataset.shuffled(views.comments(spark, folder).select("comment_id"))
    return rows.select("comment_id", dataset.seeded_order(dataset.SEED, "comment_id").alias("place"))

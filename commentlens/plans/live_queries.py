"""Queries for policy and live scoring. Streams read the tables with ``availableNow``."""

from __future__ import annotations

from pyspark.sql import functions as F

from commentlens.operators import cascade, policy
from commentlens.plans import oracle as o
from commentlens.plans import views
from commentlens.plans.registry import query, table
from commentlens.session import work_path, written_table
from commentlens.sources import threads
from commentlens.sources.tables import CommentTable
from commentlens.streaming import ingest, live

CHANGED_SETTINGS = {"rules-links-contains": "true", "rules-enabled-spam": "false", "action": "remove"}


def _policy_sql(changes: dict[str, str]) -> str:
    settings = {**policy.DEFAULT_SETTINGS, **changes}
    links = ", ".join(f"('{a}', '{b}')" for a, b in policy.LABEL_SETTINGS)
    rows = ", ".join(f"('{a}', '{b}')" for a, b in settings.items())
    return f"""
links(label, setting) AS (VALUES {links}), settings(setting, value) AS (VALUES {rows})
, policy AS (SELECT label, bool_or(value = 'true') AS enabled FROM links JOIN settings USING (setting) GROUP BY label)
, doing AS (SELECT value AS action FROM settings WHERE setting = 'action')"""


def _action(label: str) -> str:
    return f"""coalesce((SELECT CASE WHEN enabled THEN (SELECT action FROM doing) END FROM policy p
               WHERE p.label = {label}), 'none')"""


# --- policy ----------------------------------------------------------------------------------


@query("label_policy", f"""
    WITH {_policy_sql(CHANGED_SETTINGS)}, {views.COMMENTS_SQL}
    SELECT comment_id, label, {_action('c.label')} AS action FROM comments c""")
def label_policy(spark, folder):
    comments = views.comments(spark, folder).select("comment_id", "label")
    return policy.with_action(comments, policy.settings_table(spark, CHANGED_SETTINGS))


@query("policy_actions", f"""
    WITH {_policy_sql({})}, {o.FLAGGED_SQL}
    SELECT comment_id, rule_label, {_action('f.rule_label')} AS action FROM flagged f""")
def policy_actions(spark, folder):
    flagged = cascade.flag(views.comments_seeded(spark, folder)).select("comment_id", "rule_label")
    return policy.with_action(flagged, policy.settings_table(spark), label="rule_label")


# every role gets a label, so that tops and replies of a thread differ
_ROLE_LABEL = "CASE author_channel_id WHEN 'user' THEN (CASE WHEN length(text) % 3 = 0 THEN 'SCAM' ELSE 'VALID' END) " \
    "WHEN 'assistant' THEN (CASE WHEN length(text) % 5 = 0 THEN 'LINK_ONLY' ELSE 'VALID' END) END"


@query("thread_cascade", f"""
    WITH {_policy_sql(CHANGED_SETTINGS)}, {views.THREADS_SQL}, labelled AS (
        SELECT *, {_ROLE_LABEL} AS label FROM threads)
    , acted AS (SELECT *, {_action('l.label')} AS action FROM labelled l)
    SELECT comment_id, action, action = 'remove' OR thread_id IN (
        SELECT thread_id FROM acted WHERE is_top AND action = 'remove') AS hidden
    FROM acted""")
def thread_cascade(spark, folder):
    rows = threads.flatten(views.documents_nested(spark, folder)).withColumn("label", F.expr(_ROLE_LABEL))
    acted = policy.with_action(
        rows.select("comment_id", "thread_id", "is_top", "label"), policy.settings_table(spark, CHANGED_SETTINGS)
    )
    return policy.cascade_threads(acted).select("comment_id", "action", "hidden")


@query("rules_then_model", f"""
    WITH {o.LIVE_FLAGGED_SQL}
    SELECT comment_id, CASE WHEN rule_label <> 'VALID' THEN rule_label ELSE coalesce(label, 'VALID') END AS verdict
    FROM flagged""")
def rules_then_model(spark, folder):
    flagged = cascade.flag(views.comments_seeded(spark, folder), live=True, html="html")
    verdict = cascade.rules_then_model(F.col("rule_label"), F.col("label"))
    return flagged.select("comment_id", verdict.alias("verdict"))


# --- streams ---------------------------------------------------------------------------------

# a comment is sighted by several events; the author and text depend on the comment only
_FEED_SQL = """
feed AS (
    SELECT event_id, ts, 'c' || user_id AS comment_id,
           CASE user_id % 4 WHEN 0 THEN 'text me on' ELSE 'user ' || user_id END AS author_name,
           CASE user_id % 5 WHEN 0 THEN 'http://example.com/' || user_id WHEN 1 THEN 'my niece is burning'
                WHEN 2 THEN 'the waffle house has found its new host' ELSE 'hello ' || user_id END AS text
    FROM events)
, labels_once AS (
    SELECT DISTINCT comment_id, CASE WHEN author_name = 'text me on' THEN 'SCAM' WHEN text LIKE 'my niece%' THEN 'SCAM'
        WHEN text LIKE 'the waffle%' THEN 'OTHER_SPAM' WHEN text LIKE 'http:%' THEN 'LINK_ONLY' ELSE 'VALID' END AS label
    FROM feed)"""


def _as_feed(events):
    user = F.col("user_id").cast("string")
    return events.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("c"), user).alias("comment_id"),
        F.when(F.col("user_id") % 4 == 0, "text me on").otherwise(F.concat(F.lit("user "), user)).alias("author_name"),
        F.when(F.col("user_id") % 5 == 0, F.concat(F.lit("http://example.com/"), user))
        .when(F.col("user_id") % 5 == 1, "my niece is burning")
        .when(F.col("user_id") % 5 == 2, "the waffle house has found its new host")
        .otherwise(F.concat(F.lit("hello "), user)).alias("text"),
    )


def _feed_stream(spark, folder):
    schema = table(spark, folder, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    return _as_feed(stream)


def _log(spark, folder) -> str:
    path = work_path(spark, "predictions")
    live.classify_once(_feed_stream(spark, folder), path, work_path(spark, "live"), ["ts", "event_id"]).awaitTermination()
    return path


@query("stream_dedupe", f"WITH {_FEED_SQL} SELECT comment_id, label FROM labels_once")
def stream_dedupe(spark, folder):
    return live.predictions(spark, _log(spark, folder)).select("comment_id", "label")


@query("stream_first_sightings", f"WITH {_FEED_SQL} SELECT DISTINCT comment_id FROM feed")
def stream_first_sightings(spark, folder):
    path = work_path(spark, "sightings")
    first = live.first_sightings(_feed_stream(spark, folder), "ts", "1 hour").select("comment_id")
    (
        first.writeStream.option("checkpointLocation", work_path(spark, "sightings-state"))
        .trigger(availableNow=True).format("parquet").start(path).awaitTermination()
    )
    return spark.read.schema(first.schema).parquet(path)


@query("stream_scoring", f"""
    WITH {_FEED_SQL} SELECT event_id, comment_id, label AS rule_label FROM feed JOIN labels_once USING (comment_id)""")
def stream_scoring(spark, folder):
    path = work_path(spark, "scored")
    scored = live.score_stream(_feed_stream(spark, folder)).select("event_id", "comment_id", "rule_label")
    (
        scored.writeStream.option("checkpointLocation", work_path(spark, "scored-state"))
        .trigger(availableNow=True).format("parquet").start(path).awaitTermination()
    )
    return spark.read.schema(scored.schema).parquet(path)


@query("stream_actions", f"""
    WITH {_policy_sql(CHANGED_SETTINGS)}, {_FEED_SQL}
    SELECT event_id, comment_id, label, {_action('l.label')} AS action FROM feed JOIN labels_once l USING (comment_id)""")
def stream_actions(spark, folder):
    """Every sighting gets the logged label and the action of the settings as they are now."""
    sightings = _as_feed(table(spark, folder, "events")).select("event_id", "comment_id")
    log = live.predictions(spark, _log(spark, folder))
    return live.live_actions(sightings, log, policy.settings_table(spark, CHANGED_SETTINGS))


_HALVES = "CASE WHEN event_id % 2 = 0 THEN {} ELSE {} END"


@query("stream_settings", f"""
    WITH {_policy_sql({})}, {_FEED_SQL}
    , links2(label, setting) AS (SELECT * FROM links), settings2(setting, value) AS (
        SELECT setting, CASE setting {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in CHANGED_SETTINGS.items())} ELSE value END FROM settings)
    , policy2 AS (SELECT label, bool_or(value = 'true') AS enabled FROM links2 JOIN settings2 USING (setting) GROUP BY label)
    SELECT event_id, comment_id, l.label, {_HALVES.format(
        _action('l.label'),
        "coalesce((SELECT CASE WHEN enabled THEN (SELECT value FROM settings2 WHERE setting = 'action') END FROM policy2 p WHERE p.label = l.label), 'none')")} AS action
    FROM feed JOIN labels_once l USING (comment_id)""")
def stream_settings(spark, folder):
    """Two batches of a running stream with a change of settings between them."""
    feed, out, settings, state = (work_path(spark, n) for n in ("feed", "acted", "settings", "acting"))
    events = _as_feed(table(spark, folder, "events"))
    for half, changes in ((0, {}), (1, CHANGED_SETTINGS)):
        events.where(F.col("event_id") % 2 == half).write.mode("append").parquet(feed)
        live.save_settings(policy.settings_table(spark, changes), settings)
        stream = spark.readStream.schema(events.schema).parquet(feed)
        live.act_on_stream(stream, settings, out, state).awaitTermination()
    return spark.read.parquet(out).select("event_id", "comment_id", "label", "action")


@query("rules_switch", f"""
    WITH {o.LIVE_FLAGGED_SQL}
    SELECT comment_id, 'on' AS rules, rule_label AS label FROM flagged UNION ALL SELECT comment_id, 'off', 'VALID' FROM flagged""")
def rules_switch(spark, folder):
    """The live classifier with ``use-rules`` on and off."""
    rows = views.comments_seeded(spark, folder)
    parts = [
        live.rule_classifier(rows, policy.settings_table(spark, {"use-rules": value})).select("comment_id", F.lit(name).alias("rules"), "label")
        for name, value in (("on", "true"), ("off", "false"))
    ]
    return parts[0].unionByName(parts[1])


@query("stream_ingest", f"""
    WITH {views.THREADS_SQL}
    SELECT comment_id, video_id, text FROM threads WHERE author_channel_id IS NOT NULL AND conv_id % 5 <> 0
        AND page <= 10""")
def stream_ingest(spark, folder):
    """New files only: a first landing is ingested, then the same documents are landed again."""
    path, checkpoint = work_path(spark, "threads"), work_path(spark, "ingest")
    comments = CommentTable(spark, work_path(spark, "comments"))
    documents = written_table(views.documents_nested(spark, folder), "documents")
    for _ in range(2):
        threads.land_threads(documents, path)
        ingest.ingest_stream(ingest.stream_documents(spark, path), comments, checkpoint).awaitTermination()
    return comments.read().select("comment_id", "video_id", "text")

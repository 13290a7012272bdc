"""Comment-shaped views over the test tables, as DataFrames and as the same thing in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commentlens.operators.ranking import first_per_key
from commentlens.plans.registry import spread, table

# Planted rows: (doc_id % 32, author or None, text before, text after). One per cascade rule
# and per normalisation path, because natural rule hits are rare in the test prose.
PLANTS = (
    (0, "text me on", "", ""),
    (1, "рinnеd by", "", ""),
    (2, "with no vid", "", ""),
    (3, "check video", "", ""),
    (4, "what an app", "", ""),
    (5, "what happened", "", ""),
    (6, None, "my niece is burning ", ""),
    (7, None, "", " is trash, my content is better"),
    (8, None, "", " free vbucks http://x.example.com"),
    (9, "contact me", "", " find my username above"),
    (10, None, "", " the waffle house has found its new host"),
    (11, None, "", " ①②③④⑤⑥"),
    (12, None, "", " ①②③④⑤"),
    (13, None, "", " call ➕1 555"),
    (14, None, "", " call +1 555"),
    (15, None, "", " here finally youtu.be/abc"),
    (17, None, "", " look http://example.com/a?b=c#d now"),
    (18, None, "", " 𝐟𝐫𝐞𝐞 𝐕𝐁𝐔𝐂𝐊𝐒 http://a.b.com"),
    (19, "@bob 👉", "", ""),
    (20, None, "", " i appreciate and recommend ☝"),
    (21, None, "", " full video ▶️ youtu.be/x"),
    (22, None, "a..b--c  ``d`` ", "  !!"),
    (23, "ᴛᴇʟᴇ gram", "", ""),
    (24, None, "http://192.168.1.20:8080/admin?x=1 ", ""),
    (25, None, "", " see http://localhost/x"),
    (26, None, "", " ftp://8.8.8.8/file"),
    (27, None, "", " http://[2001:db8::1]/p"),
    (28, "@c dmme", "", " ☝ 🎁"),
)

# further rows that have a text of their own
ADDED = ((16, "http://example.com/watch"), (30, "https://sub.example.co.uk:8080/a/b?c=d#e"))


def _case(column: str, branches, default: str) -> str:
    whens = " ".join(f"WHEN {k} THEN {v}" for k, v in branches)
    return f"CASE {column} % 32 {whens} ELSE {default} END"


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def planted_author(doc_id: str, author: str) -> str:
    return _case(doc_id, ((k, _quoted(a)) for k, a, _, _ in PLANTS if a), author)


def planted_text(doc_id: str, text: str) -> str:
    branches = [(k, f"{_quoted(before)} || {text} || {_quoted(after)}")
                for k, _, before, after in PLANTS if before or after]
    return _case(doc_id, branches, text)


IS_ADDED = f"doc_id % 32 IN ({', '.join(str(k) for k, _ in ADDED)})"
ADDED_TEXT = _case("doc_id", ((k, _quoted(whole)) for k, whole in ADDED), "''")

# stands in for the rendered comment: anchors for linked text, one of them a timestamp link
HTML = (
    "CASE doc_id % 32 WHEN 17 THEN '<p>look <a href=\"http://example.com/a\">here</a></p>' "
    "WHEN 29 THEN '<a href=\"/watch?v=abcdefghijk&amp;t=10\">0:10</a>' ELSE '' END"
)

_LABEL = "CASE WHEN toxic = 1 THEN 'SCAM' WHEN quality = 0 THEN 'OTHER_SPAM' WHEN quality = 1 THEN 'VALID' END"

_COLUMNS = {
    "comment_id": "cast(doc_id AS {string})",
    "video_id": "source",
    "text": "text",
    "likes": "n_chars % 100",
    "publish_date": "'2024-01-01T00:00:00Z'",
    "update_date": "'2024-01-01T00:00:00Z'",
    "author_name": "lang || ' user ' || cast(n_chars % 13 AS {string})",
    "author_profile_url": "'http://img.example.com/' || cast(n_chars % 13 AS {string})",
    "author_channel_id": "'ch' || cast(n_chars % 13 AS {string})",
    "label": _LABEL,
    "score": "cast(doc_id % 1000 AS double) / 1000",
    "moderated": f"({_LABEL}) IS NOT NULL AND doc_id % 2 = 0",
    "doc_id": "doc_id",
}


def comments(spark: SparkSession, folder: str) -> DataFrame:
    """``documents`` as comments, labels attached."""
    documents = spread(table(spark, folder, "documents"), "doc_id")
    joined = documents.join(table(spark, folder, "labels"), "doc_id", "left")
    return joined.selectExpr(*(f"{e.format(string='string')} AS {n}" for n, e in _COLUMNS.items()))


def comments_seeded(spark: SparkSession, folder: str) -> DataFrame:
    """``comments`` with spam planted in author names and texts, rows added, plus ``html``."""
    rows = (
        comments(spark, folder)
        .withColumn("author_name", F.expr(planted_author("doc_id", "author_name")))
        .withColumn("html", F.expr(HTML))
    )
    own = F.struct("comment_id", F.expr(planted_text("doc_id", "text")).alias("text"))
    added = F.struct(F.concat(F.lit("-"), "comment_id").alias("comment_id"), F.expr(ADDED_TEXT).alias("text"))
    both = F.explode(F.when(F.expr(IS_ADDED), F.array(own, added)).otherwise(F.array(own)))
    rows = rows.withColumn("__own", both)
    return rows.withColumns({"comment_id": F.col("__own.comment_id"), "text": F.col("__own.text")}).drop("__own")


COMMENTS_SQL = (
    "comments AS (SELECT "
    + ", ".join(f"{e.format(string='varchar')} AS {n}" for n, e in _COLUMNS.items())
    + " FROM (SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)))"
)

SEEDED_SQL = (
    COMMENTS_SQL
    + ", seeded AS (SELECT * REPLACE ("
    + planted_author("doc_id", "author_name") + " AS author_name, "
    + planted_text("doc_id", "text") + f" AS text), {HTML} AS html FROM comments "
    + "UNION ALL SELECT * REPLACE ('-' || comment_id AS comment_id, " + planted_author("doc_id", "author_name")
    + f" AS author_name, {ADDED_TEXT} AS text), {HTML} AS html FROM comments WHERE {IS_ADDED})"
)


def documents_nested(spark: SparkSession, folder: str) -> DataFrame:
    """``conversations`` as thread documents: a page per two turns, 32 pages per document.

    The first row of a page is the top-level comment. Rows with role ``system`` have no author
    id. Turns are unique per conversation, so every list has a fixed bound.
    """
    rows = first_per_key(table(spark, folder, "conversations"), ["conv_id", "turn"], [F.col("text")])
    node = F.struct(
        F.format_string("c%d.%d", "conv_id", "turn").alias("id"),
        F.struct(
            F.format_string("v%d", "conv_id").alias("videoId"),
            F.col("text").alias("textOriginal"),
            F.length("text").cast("bigint").alias("likeCount"),
            F.lit("2024-01-01T00:00:00Z").alias("publishedAt"),
            F.lit("2024-01-01T00:00:00Z").alias("updatedAt"),
            F.col("role").alias("authorDisplayName"),
            F.lit("u").alias("authorProfileImageUrl"),
            F.when(F.col("role") != "system", F.struct(F.col("role").alias("value"))).alias("authorChannelId"),
        ).alias("snippet"),
    )
    pages = (
        rows.select("conv_id", F.expr("turn div 64").alias("part"), F.expr("turn div 2").alias("page"), "turn",
                    node.alias("node"))
        .groupBy("conv_id", "part", "page")
        .agg(F.sort_array(F.collect_list(F.struct("turn", "node"))).alias("nodes"))
    )
    item = F.struct(
        F.struct(F.col("nodes")[0]["node"].alias("topLevelComment")).alias("snippet"),
        F.struct(F.transform(F.slice("nodes", 2, F.size("nodes")), lambda n: n["node"]).alias("comments")).alias("replies"),
    )
    return (
        pages.select("conv_id", "part", "page", F.array(item).alias("items"))
        .groupBy("conv_id", "part")
        .agg(F.sort_array(F.collect_list(F.struct("page", "items"))).alias("pages"))
        .select(
            F.format_string("v%d", "conv_id").alias("video_id"),
            F.lit(0.0).alias("retrieval_time"),
            F.struct(
                F.when(F.col("conv_id") % 5 == 0, F.array().cast("array<struct<id:string>>"))
                .otherwise(F.array(F.struct(F.format_string("v%d", "conv_id").alias("id")))).alias("items")
            ).alias("video_info"),
            F.transform("pages", lambda p: F.struct(p["items"].alias("items"))).alias("comments_info"),
        )
    )


THREADS_SQL = """
    turns AS (SELECT conv_id, turn, min(role) AS role, min(text) AS text FROM conversations GROUP BY ALL),
    threads AS (
        SELECT 'c' || conv_id || '.' || turn AS comment_id, 'v' || conv_id AS video_id, conv_id, turn, text,
               CASE WHEN role <> 'system' THEN role END AS author_channel_id,
               'c' || conv_id || '.' || min(turn) OVER page AS thread_id,
               turn = min(turn) OVER page AS is_top, turn // 2 AS page
        FROM turns WINDOW page AS (PARTITION BY conv_id, turn // 2))
"""


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


#: Four versions of each vector, the last about 0.97 similar to the first.
NEAR_VECTORS_SQL = """v AS (SELECT vec_id * 4 + k AS id,
    [e::double * (1 + k * 0.1 * ((i * 7 + vec_id) % 3 - 1)) FOR e, i IN embedding] AS e
    FROM embeddings, range(4) versions(k))"""


def near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """``embeddings`` in four versions each that are near one another."""
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding", F.explode(F.expr("sequence(0L, 3L)")).alias("k"))
    scale = lambda i: 1 + F.col("k") * F.lit(0.1) * ((i * 7 + F.col("vec_id")) % 3 - 1)
    return rows.select((F.col("vec_id") * 4 + F.col("k")).alias("id"), F.transform("embedding", lambda e, i: e.cast("double") * scale(i + 1)).alias("embedding"))


def vector_comments(spark: SparkSession, folder: str) -> DataFrame:
    """``embeddings`` as stored comments with review state."""
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("comment_id"),
        F.expr("CASE label % 3 WHEN 0 THEN 'SCAM' WHEN 1 THEN 'VALID' ELSE 'SELF_PROMO' END").alias("label"),
        F.lit(None).cast("double").alias("score"),
        (F.col("vec_id") % 3 != 0).alias("moderated"),
    )


VECTOR_COMMENTS_SQL = """
    stored AS (
        SELECT vec_id AS comment_id,
               CASE label % 3 WHEN 0 THEN 'SCAM' WHEN 1 THEN 'VALID' ELSE 'SELF_PROMO' END AS label,
               CAST(NULL AS double) AS score, vec_id % 3 <> 0 AS moderated
        FROM embeddings)
"""


def links(spark: SparkSession, folder: str) -> DataFrame:
    """``pages`` with an image and an absolute or a timestamp anchor in front."""
    return table(spark, folder, "pages").withColumn("html", F.expr(PAGE_HTML))


PAGE_HTML = (
    "'<img src=\"i.png\" alt=\"pic ' || cast(page_id % 7 AS varchar(20)) || '\">' || CASE WHEN page_id % 4 = 0 "
    "THEN '<a href=\"/watch?v=abcdefghijk&amp;t=42\">0:42</a>' ELSE '<a class=\"x\" href=\"' || url || '\">src</a>' END || html"
)

LINKS_SQL = f"links AS (SELECT page_id, url, {PAGE_HTML} AS html FROM pages)"

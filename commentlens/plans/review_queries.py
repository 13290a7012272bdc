"""Queries for review queues, similarity, communities and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from commentlens.functions import scores
from commentlens.operators import communities, evaluate, features, review, similarity, store
from commentlens.plans import views
from commentlens.plans.registry import query, table
from commentlens.session import merged, work_path, written_table
from commentlens.sources import tables

# the test vectors are spread out, so communities need a low threshold and size
THRESHOLD, MIN_SIZE = 0.30, 5


# --- author review ---------------------------------------------------------------------------

_QUEUE_SQL = views.COMMENTS_SQL + """
, queue AS (SELECT * FROM comments WHERE NOT moderated AND score >= 0.5)
, groups AS (SELECT author_channel_id, count(*) AS n, first(label ORDER BY text, comment_id) AS suggested
             FROM queue GROUP BY author_channel_id)"""


def _queue(spark, folder):
    return store.review_eligible(views.comments(spark, folder), 0.5)


@query("author_queue", f"WITH {_QUEUE_SQL} SELECT author_channel_id, n, suggested FROM groups")
def author_queue(spark, folder):
    return review.author_queue(_queue(spark, folder))


@query("author_preview", f"""
    WITH {_QUEUE_SQL}, ranked AS (
        SELECT author_channel_id, comment_id,
               row_number() OVER (PARTITION BY author_channel_id ORDER BY text, comment_id) AS up,
               row_number() OVER (PARTITION BY author_channel_id ORDER BY text DESC, comment_id DESC) AS down
        FROM queue)
    SELECT author_channel_id, comment_id, 'first' AS side, up AS position FROM ranked WHERE up <= 3
    UNION ALL SELECT author_channel_id, comment_id, 'last', down FROM ranked WHERE down <= 3""")
def author_preview(spark, folder):
    return review.author_preview(_queue(spark, folder)).select("author_channel_id", "comment_id", "side", "position")


@query("apply_author_decisions", f"""
    WITH {_QUEUE_SQL}, decisions AS (
        SELECT DISTINCT author_channel_id, CASE cast(substr(author_channel_id, 3) AS int) % 3
            WHEN 0 THEN '0' WHEN 1 THEN '' ELSE 'SELF_PROMO' END AS response FROM comments)
    , answers AS (
        SELECT author_channel_id, CASE response WHEN '0' THEN suggested ELSE response END AS chosen
        FROM decisions JOIN groups USING (author_channel_id) WHERE response <> '')
    , changed AS (SELECT comment_id, chosen FROM queue JOIN answers USING (author_channel_id))
    SELECT c.comment_id, CASE WHEN u.comment_id IS NULL THEN c.label ELSE u.chosen END AS label,
           c.moderated OR u.comment_id IS NOT NULL AS moderated
    FROM comments c LEFT JOIN changed u USING (comment_id)""")
def apply_author_decisions(spark, folder):
    comments = views.comments(spark, folder)
    number = F.substring("author_channel_id", 3, 9).cast("int") % 3
    decisions = comments.select("author_channel_id").distinct().withColumn(
        "response", F.when(number == 0, "0").when(number == 1, "").otherwise("SELF_PROMO")
    )
    result = review.apply_author_decisions(comments, _queue(spark, folder), decisions)
    return result.select("comment_id", "label", "moderated")


# --- similarity ------------------------------------------------------------------------------

_DISTINCT_SQL = "u AS (SELECT min(vec_id) AS id, count(*) AS copies, embedding::double[] AS e FROM embeddings GROUP BY embedding)"


@query("cosine_pairs", f"""
    WITH {_DISTINCT_SQL}
    SELECT a.id AS left_id, b.id AS right_id, round(list_cosine_similarity(a.e, b.e), 5) AS sim,
           a.copies AS left_copies, b.copies AS right_copies
    FROM u a, u b WHERE list_cosine_similarity(a.e, b.e) >= {THRESHOLD}""")
def cosine_pairs(spark, folder):
    pairs = similarity.similar_pairs(views.vectors(spark, folder), THRESHOLD)
    return pairs.withColumn("sim", F.round("sim", 5))


_NEAR_SQL = f"""
near AS (SELECT a.vec_id AS i, b.vec_id AS j,
                list_cosine_similarity(a.embedding::double[], b.embedding::double[]) AS sim
         FROM embeddings a, embeddings b)
, hit AS (SELECT i, j FROM near WHERE sim >= {THRESHOLD})
, dense AS (SELECT i, count(*) AS n FROM hit GROUP BY i HAVING count(*) >= {MIN_SIZE})"""


@query("dense_rows", f"WITH {_NEAR_SQL} SELECT i AS id, n FROM dense")
def dense_rows(spark, folder):
    placed, n_tiles = similarity.place(views.vectors(spark, folder))
    return similarity.dense_rows(placed, n_tiles, THRESHOLD, MIN_SIZE)


@query("top_k_neighbours", f"""
    WITH {_NEAR_SQL}
    SELECT i AS id, j AS neighbour, round(sim, 5) AS sim, row_number() OVER nearest AS rank FROM near
    WINDOW nearest AS (PARTITION BY i ORDER BY round(sim, 9) DESC, j) QUALIFY row_number() OVER nearest <= 5""")
def top_k_neighbours(spark, folder):
    placed, n_tiles = similarity.place(views.vectors(spark, folder))
    return similarity.top_k(placed, n_tiles, 5).withColumn("sim", F.round("sim", 5))


# the same at the threshold of near copies, where rows meet by hash tables
_NEAR_COPIES_SQL = views.NEAR_VECTORS_SQL + f"""
, meet AS (SELECT a.id AS i, b.id AS j, list_cosine_similarity(a.e, b.e) AS sim FROM v a, v b
           WHERE list_cosine_similarity(a.e, b.e) >= {communities.THRESHOLD})"""


@query("near_counts", f"WITH {_NEAR_COPIES_SQL} SELECT i AS id, count(*) AS n FROM meet GROUP BY i HAVING count(*) >= 2")
def near_counts(spark, folder):
    return similarity.near_counts(views.near_vectors(spark, folder), communities.THRESHOLD, 2)


@query("near_pairs", f"WITH {_NEAR_COPIES_SQL} SELECT i AS left_id, j AS right_id, round(sim, 5) AS sim, 1 AS left_copies, 1 AS right_copies FROM meet")
def near_pairs(spark, folder):
    pairs = similarity.similar_pairs(views.near_vectors(spark, folder), communities.THRESHOLD, recall=similarity.RECALL)
    return pairs.withColumn("sim", F.round("sim", 5))


@query("near_top_k", f"""
    WITH {_NEAR_COPIES_SQL}
    SELECT i AS id, j AS neighbour, round(sim, 5) AS sim, row_number() OVER nearest AS rank FROM meet
    WINDOW nearest AS (PARTITION BY i ORDER BY round(sim, 9) DESC, j) QUALIFY row_number() OVER nearest <= 3""")
def near_top_k(spark, folder):
    return similarity.near_top_k(views.near_vectors(spark, folder), communities.THRESHOLD, 3).withColumn("sim", F.round("sim", 5))


# the greedy walk over the candidates, largest neighbourhood first, carrying the taken ids
_COMMUNITIES_SQL = _NEAR_SQL + f"""
, ordered AS (SELECT i, n, row_number() OVER (ORDER BY n DESC, i) AS step FROM dense)
, lists AS (SELECT o.step, o.i AS seed, o.n AS n0, list(h.j ORDER BY h.j) AS around
            FROM ordered o JOIN hit h ON h.i = o.i GROUP BY ALL)
, greedy AS (
    SELECT 0::bigint AS step, []::bigint[] AS taken, []::bigint[] AS members, NULL::bigint AS seed, NULL::bigint AS n0
    UNION ALL
    SELECT step, CASE WHEN len(remainder) >= {MIN_SIZE} THEN list_concat(taken, remainder) ELSE taken END,
           CASE WHEN len(remainder) >= {MIN_SIZE} THEN remainder ELSE [] END, seed, n0
    FROM (SELECT l.step, g.taken, l.seed, l.n0,
                 list_filter(l.around, lambda x: NOT list_contains(g.taken, x)) AS remainder
          FROM greedy g JOIN lists l ON l.step = g.step + 1))
, found AS (SELECT seed, n0, len(members) AS size, unnest(members) AS id FROM greedy WHERE len(members) > 0)
, numbered AS (SELECT seed, id, size, dense_rank() OVER (ORDER BY size DESC, n0 DESC, seed) AS community_id FROM found)
"""

_SCORED_SQL = _COMMUNITIES_SQL + """
, parts AS (SELECT community_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos
            FROM numbered JOIN embeddings ON vec_id = id)
, means AS (SELECT community_id, pos, avg(v::double) AS m FROM parts GROUP BY ALL)
, centroids AS (SELECT community_id, list(m ORDER BY pos) AS centroid FROM means GROUP BY community_id)
, rated AS (SELECT community_id, id, round(list_cosine_similarity(centroid, embedding::double[]), 5) AS score
            FROM numbered JOIN centroids USING (community_id) JOIN embeddings ON vec_id = id)
, scored AS (SELECT *, row_number() OVER (PARTITION BY community_id ORDER BY score DESC, id) AS rank FROM rated)
, state AS (SELECT s.*, t.label, t.moderated FROM scored s JOIN stored t ON t.comment_id = s.id)
"""


def _communities(spark, folder):
    found = communities.detect(views.vectors(spark, folder), THRESHOLD, MIN_SIZE)
    return communities.numbered(found)


def _scored(spark, folder):
    vectors = views.vectors(spark, folder)
    return communities.scored(_communities(spark, folder), vectors).withColumnRenamed("id", "comment_id")


@query("communities", f"WITH RECURSIVE {_COMMUNITIES_SQL} SELECT community_id, seed, size, id FROM numbered")
def detect_communities(spark, folder):
    return _communities(spark, folder).select("community_id", "seed", "size", "id")


@query("community_scores", f"""
    WITH RECURSIVE {views.VECTOR_COMMENTS_SQL}, {_SCORED_SQL}
    SELECT community_id, id AS comment_id, score, rank FROM scored""")
def community_scores(spark, folder):
    return _scored(spark, folder).select("community_id", "comment_id", "score", "rank")


_CHUNK_SQL = "cast('0x' || substr(md5(cast({} AS varchar)), 1, 8) AS bigint) % (SELECT ceil(count(*) / 250)::bigint FROM embeddings)"
_CHUNKED_SQL = _COMMUNITIES_SQL.replace(
    f"FROM near WHERE sim >= {THRESHOLD}", f"FROM near WHERE sim >= {THRESHOLD} AND {_CHUNK_SQL.format('i')} = {_CHUNK_SQL.format('j')}"
).replace(f">= {MIN_SIZE}", ">= 3")


@query("chunked_communities", f"""
    WITH RECURSIVE {_CHUNKED_SQL} SELECT {_CHUNK_SQL.format('seed')} AS chunk, community_id, seed, size, id FROM numbered""")
def chunked_communities(spark, folder):
    """Chunks of bounded size: neighbours never span chunks."""
    found = communities.detect(views.vectors(spark, folder), THRESHOLD, 3, chunk_rows=250, tile_rows=64)
    return communities.numbered(found).select("chunk", "community_id", "seed", "size", "id")


_AGREED_SQL = f"""
, tally AS (SELECT community_id, label, count(*) AS n, min(rank) AS first_rank FROM state WHERE moderated GROUP BY ALL)
, sizes AS (SELECT community_id, count(*) AS size, count(*) FILTER (moderated) AS reviewed FROM state GROUP BY ALL)
, agreed AS (
    SELECT community_id, reviewed / size AS ratio, first(label ORDER BY n DESC, first_rank) AS label
    FROM sizes JOIN tally USING (community_id) WHERE reviewed < size AND reviewed / size >= {communities.CONSENSUS}
    GROUP BY ALL)"""


@query("consensus_labels", f"""
    WITH RECURSIVE {views.VECTOR_COMMENTS_SQL}, {_SCORED_SQL} {_AGREED_SQL}
    SELECT community_id, round(ratio, 5) AS ratio, label FROM agreed""")
def consensus_labels(spark, folder):
    stored = views.vector_comments(spark, folder)
    state = _scored(spark, folder).drop("score").join(merged(stored), "comment_id")
    return communities.consensus(state).withColumn("ratio", F.round("ratio", 5))


@query("consensus_propagate", f"""
    WITH RECURSIVE {views.VECTOR_COMMENTS_SQL}, {_SCORED_SQL} {_AGREED_SQL}
    , given AS (SELECT s.id, a.label, s.score FROM state s JOIN agreed a USING (community_id) WHERE NOT s.moderated)
    SELECT c.comment_id, coalesce(g.label, c.label) AS label, coalesce(g.score, -1) AS score, c.moderated
    FROM stored c LEFT JOIN given g ON g.id = c.comment_id""")
def consensus_propagate(spark, folder):
    members = written_table(_scored(spark, folder), "members")
    result = communities.propagate(views.vector_comments(spark, folder), members)
    return result.withColumn("score", F.coalesce("score", F.lit(-1.0)))


@query("community_preview", f"""
    WITH RECURSIVE {views.VECTOR_COMMENTS_SQL}, {_SCORED_SQL}
    , ranked AS (SELECT community_id, id, row_number() OVER (PARTITION BY community_id ORDER BY rank) AS up,
                        row_number() OVER (PARTITION BY community_id ORDER BY rank DESC) AS down
                 FROM state WHERE NOT moderated)
    SELECT community_id, id AS comment_id, 'first' AS side, up AS position FROM ranked WHERE up <= 3
    UNION ALL SELECT community_id, id, 'last', down FROM ranked WHERE down <= 3""")
def community_preview(spark, folder):
    stored = views.vector_comments(spark, folder).select("comment_id", "moderated")
    members = written_table(_scored(spark, folder), "members").join(merged(stored), "comment_id")
    return review.community_preview(members).select("community_id", "comment_id", "side", "position")


@query("reviewed_histogram", f"""
    WITH RECURSIVE {views.VECTOR_COMMENTS_SQL}, {_SCORED_SQL}
    SELECT community_id, label, count(*) AS n FROM state WHERE moderated GROUP BY ALL""")
def reviewed_histogram(spark, folder):
    stored = views.vector_comments(spark, folder).drop("score")
    return review.reviewed_histogram(_scored(spark, folder).join(merged(stored), "comment_id"))


@query("community_decisions", f"""
    WITH RECURSIVE {views.VECTOR_COMMENTS_SQL}, {_SCORED_SQL}
    , answers AS (SELECT DISTINCT community_id, CASE community_id % 3 WHEN 0 THEN 'X' WHEN 1 THEN 'SPONSOR' END AS response
                  FROM numbered)
    , changed AS (SELECT id, response FROM state JOIN answers USING (community_id)
                  WHERE (response = 'X' OR (response IS NOT NULL AND NOT moderated))
                  AND community_id IN (SELECT community_id FROM state WHERE NOT moderated))
    SELECT c.comment_id, CASE WHEN u.id IS NULL THEN c.label WHEN response <> 'X' THEN response END AS label,
           CASE WHEN u.id IS NULL THEN c.moderated ELSE response <> 'X' END AS moderated
    FROM stored c LEFT JOIN changed u ON u.id = c.comment_id""")
def community_decisions(spark, folder):
    members = written_table(
        _communities(spark, folder).select("community_id", F.col("id").alias("comment_id")), "members"
    )
    key = F.col("community_id") % 3
    decisions = members.select("community_id").distinct().withColumn(
        "response", F.when(key == 0, review.RESET).when(key == 1, "SPONSOR")
    )
    result = review.apply_community_decisions(views.vector_comments(spark, folder), members, decisions)
    return result.select("comment_id", "label", "moderated")


# --- scores and metrics ----------------------------------------------------------------------

# eleven classes: element i of the vector counts for class i % 11
_LOGITS_SQL = """logits AS (
    SELECT vec_id, list_transform(range(1, 12), lambda k: 20 * list_sum(list_transform(embedding[k:len(embedding):11],
        lambda x: x::double))) AS z FROM embeddings)"""


@query("class_scores", f"""
    WITH {_LOGITS_SQL}, p AS (
        SELECT vec_id, list_transform(z, lambda x: exp(x - list_max(z))) AS w, list_position(z, list_max(z)) - 1 AS top
        FROM logits)
    SELECT vec_id, CAST(top AS bigint) AS model_id, round(list_max(w) / list_sum(w), 5) AS probability,
           top <> 0 AND list_max(w) / list_sum(w) >= 0.9 AS ask FROM p""")
def class_scores(spark, folder):
    def total(k):
        own = F.filter("embedding", lambda x, i: i % 11 == k)
        return F.aggregate(own, F.lit(0.0), lambda acc, x: acc + x.cast("double")) * 20

    logits = table(spark, folder, "embeddings").select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(10)), total).alias("z"))
    rated = logits.select("vec_id", scores.argmax(F.col("z")).alias("model_id"), scores.softmax(F.col("z")).alias("p"))
    probability = F.array_max("p")
    return rated.select(
        "vec_id", "model_id", F.round(probability, 5).alias("probability"),
        scores.is_confident(scores.label_of(F.col("model_id")), probability).alias("ask"),
    )


# a stand-in prediction that is right about four times in five
_PREDICTION = "CASE WHEN n_likes % 5 = 0 THEN 'SCAM' WHEN n_likes % 11 = 0 THEN 'SPONSOR' ELSE label END"
_JUDGED_SQL = views.COMMENTS_SQL + f"""
, judged AS (SELECT comment_id, text, label, {_PREDICTION.replace('n_likes', 'likes')} AS prediction
             FROM comments WHERE label IS NOT NULL)"""


def _judged(spark, folder):
    rows = views.comments(spark, folder).filter(F.col("label").isNotNull())
    return rows.withColumn("prediction", F.expr(_PREDICTION.replace("n_likes", "likes")))


_PER_CLASS_SQL = _JUDGED_SQL + """
, classes AS (SELECT DISTINCT label FROM judged UNION SELECT DISTINCT prediction FROM judged)
, per_class AS (
    SELECT c.label, count(*) FILTER (j.label = c.label) AS support, count(*) FILTER (prediction = c.label) AS guesses,
           count(*) FILTER (j.label = c.label AND prediction = c.label) AS hits
    FROM classes c, judged j GROUP BY c.label)
, rates AS (SELECT *, CASE WHEN guesses > 0 THEN hits / guesses ELSE 0 END AS p,
                   CASE WHEN support > 0 THEN hits / support ELSE 0 END AS r FROM per_class)
"""


@query("eval_metrics", f"""
    WITH {_PER_CLASS_SQL}
    SELECT CAST(sum(support) AS bigint) AS samples, least(150, CAST(sum(support) AS bigint)) AS eval_samples,
           round(sum(hits) / sum(support), 6) AS accuracy,
           round(avg(r) FILTER (support > 0), 6) AS balanced_accuracy,
           round(sum(support * p) / sum(support), 6) AS precision, round(sum(support * r) / sum(support), 6) AS recall,
           round(sum(support * CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END) / sum(support), 6) AS fscore
    FROM rates""")
def eval_metrics(spark, folder):
    report = evaluate.evaluate(_judged(spark, folder), cap=150)
    rounded = ("accuracy", "balanced_accuracy", "precision", "recall", "fscore")
    return report.select("samples", "eval_samples", *(F.round(c, 6).alias(c) for c in rounded))


@query("confusion_matrix", f"""
    WITH {_JUDGED_SQL} SELECT label AS truth, prediction AS predicted, count(*) AS n FROM judged GROUP BY ALL""")
def confusion_matrix(spark, folder):
    return evaluate.confusion(_judged(spark, folder))


@query("prediction_file", f"""
    WITH {_JUDGED_SQL} SELECT cast(comment_id AS bigint) AS index, md5(text) AS text, prediction FROM judged""")
def prediction_file(spark, folder):
    path = work_path(spark, "predictions")
    rows = _judged(spark, folder).select(F.col("comment_id").cast("bigint").alias("index"), "text", "prediction")
    tables.write_predictions(rows, path)
    return tables.read_predictions(spark, path).withColumn("text", F.md5("text"))


@query("text_embeddings")
def text_embeddings(spark, folder):
    """TF-IDF vectors of the comments; reports their dimension and norm."""
    embedded = features.embed(views.comments_seeded(spark, folder), n_features=256)
    norm = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x)
    return embedded.select("id", F.size("embedding").alias("size"), F.round(norm, 3).alias("norm"))


@query("score_queue")
def score_queue(spark, folder):
    """Train on the labelled comments, then queue confident predictions on the unreviewed ones."""
    comments = views.comments_seeded(spark, folder)
    model = features.train(store.training_eligible(comments), n_features=1 << 10, max_iter=10)
    queue = features.prediction_queue(model, comments, minimum=0.5)
    return queue.select("comment_id", "prediction_label", F.round("probability", 3).alias("probability"))



import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from commentlens.functions import scores, tokens
from commentlens.operators import communities, evaluate, policy, review, similarity, wordpieces
from commentlens.plans import review_queries
from tests.test_tables import comment, frame


def test_author_queue_and_decisions(spark):
    stored = frame(spark, [
        comment("1", "SCAM", score=0.99, author_channel_id="a", text="b"),
        comment("2", "VALID", score=0.99, author_channel_id="a", text="a"),
        comment("3", "SCAM", score=0.99, author_channel_id="b", text="a"),
        comment("4", "SCAM", author_channel_id="a", text="c"),
    ])
    queue = stored.filter("score >= 0.95")
    assert [(r.author_channel_id, r.n, r.suggested) for r in review.author_queue(queue).collect()] == [
        ("a", 2, "VALID"), ("b", 1, "SCAM")]
    decisions = spark.createDataFrame([("a", "0"), ("b", "")], "author_channel_id string, response string")
    rows = review.apply_author_decisions(stored, queue, decisions).orderBy("comment_id").collect()
    assert [(r.label, r.moderated) for r in rows] == [
        ("VALID", True), ("VALID", True), ("SCAM", False), ("SCAM", False)]


def clustered(seed, n, hot=0.35, dim=8):
    """Random vectors where one cluster holds a third of all rows, some of them exact copies."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    owner = np.where(rng.random(n) < hot, 0, rng.integers(0, 6, n))
    noise = rng.normal(scale=0.35, size=(n, dim))
    noise[rng.random(n) < 0.2] = 0
    return (centres[owner] + noise).astype(np.float32)


def sequential(vectors, threshold, minimum):
    """The greedy definition, row by row."""
    unit = vectors.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= threshold
    minimum = min(minimum, len(vectors))
    candidates = sorted((i for i in range(len(vectors)) if near[i].sum() >= minimum), key=lambda i: (-near[i].sum(), i))
    taken, found = set(), {}
    for i in candidates:
        left = [j for j in np.flatnonzero(near[i]) if j not in taken]
        if len(left) >= minimum:
            taken.update(left)
            found[i] = {int(j) for j in left}
    return found


def as_frame(spark, vectors):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id bigint, embedding array<float>")


@pytest.mark.parametrize("seed, threshold, minimum", [(1, 0.9, 5), (2, 0.8, 10), (3, 0.95, 3)])
def test_communities_equal_the_sequential_definition(spark, seed, threshold, minimum):
    vectors = clustered(seed, 240)
    want = sequential(vectors, threshold, minimum)
    for options in ({}, {"tile_rows": 50}, {"tile_rows": 80, "walk_entries": 0}, {"walk_entries": 400}):
        if options.get("walk_entries") == 0 and seed != 1:
            continue
        rows = communities.detect(as_frame(spark, vectors), threshold, minimum, **options).collect()
        got = {}
        for r in rows:
            got.setdefault(r.seed, set()).add(r.id)
        assert got == want, options


def test_chains_of_candidates_take_few_rounds(spark, monkeypatch):
    angle = 2 * np.pi * np.arange(200) / 200
    circle = np.stack([np.cos(angle), np.sin(angle)], axis=1).astype(np.float32)
    near = float(np.cos(2.5 * angle[1]))
    want = sequential(circle, near, 2)
    rounds, run = [], communities._round
    monkeypatch.setattr(communities, "_round", lambda *a: rounds.append(1) or run(*a))
    got = {}
    for r in communities.detect(as_frame(spark, circle), near, 2, walk_entries=400).collect():
        got.setdefault(r.seed, set()).add(r.id)
    # every candidate waits for the one before it, five entries each
    assert got == want and len(rounds) <= 4


def broadcasts(df):
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def test_rows_of_communities_are_not_broadcast(spark, monkeypatch):
    plans, write = {}, communities.written_table
    monkeypatch.setattr(communities, "written_table", lambda df, name: plans.setdefault(name, []).append(broadcasts(df)) or write(df, name))
    vectors = as_frame(spark, clustered(1, 240))
    found = communities.numbered(communities.detect(vectors, 0.9, 5, walk_entries=400))
    # the sizes of the chunks are the only rows that may pass through the driver
    assert max(plans.pop("communities-centres")) <= 1 and len(plans["communities-walked"]) > 1
    assert not any(sum(n) for n in plans.values())
    scored = write(communities.scored(found, vectors).withColumnRenamed("id", "comment_id"), "members")
    stored = write(scored.select("comment_id", F.lit("SCAM").alias("label"), F.lit(None).cast("double").alias("score"),
                                 (F.col("comment_id") % 3 != 0).alias("moderated")), "stored")
    decisions = scored.select("community_id", F.lit("X").alias("response")).distinct()
    results = [found, communities.scored(found, vectors), communities.propagate(stored, scored),
               review.apply_community_decisions(stored, scored, decisions)]
    assert [broadcasts(df) for df in results] == [0] * 4
    assert communities.propagate(stored, scored).count() == stored.count() > 100


@pytest.mark.parametrize("name", ["consensus_labels", "reviewed_histogram", "community_preview"])
def test_members_meet_stored_rows_without_a_broadcast(spark, tmp_path, monkeypatch, name):
    members = spark.range(1, 7).select(F.lit(1).cast("bigint").alias("community_id"), F.col("id").alias("comment_id"),
                                       F.lit(0.5).alias("score"), F.col("id").alias("rank"))
    rows = [(i, [1.0, float(i)], i % 3) for i in range(1, 7)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(review_queries, "_scored", lambda *_: members)
    result = getattr(review_queries, name)(spark, str(tmp_path))
    assert broadcasts(result) == 0 and result.count() == {"consensus_labels": 1, "reviewed_histogram": 2, "community_preview": 4}[name]


def test_a_task_holds_few_similarities(spark):
    vectors = as_frame(spark, np.eye(3, dtype=np.float32)[np.arange(3000) % 3])
    placed, n_tiles = similarity.place(vectors)
    held = similarity.tiled(placed, placed, n_tiles, lambda left, right, slabs: {"n": np.array([max(s.size for _, s in slabs)])}, n="bigint")
    assert held.agg(F.max("n")).first()[0] <= similarity._CELLS


def test_rows_that_meet_their_own_kind_are_sent_once(spark):
    placed, plan = similarity.place_hashed(as_frame(spark, clustered(7, 200, hot=0.0, dim=32)), 0.95, bucket_rows=50)
    assert plan.tables > 1 and plan.hot.count() == 0
    assert similarity._buckets(placed, placed, plan, [])[0].count() == 200 * plan.tables
    assert similarity._buckets(placed, placed.select("*"), plan, [])[0].count() == 2 * 200 * plan.tables


def test_minimum_is_clamped_and_chunks_do_not_mix(spark):
    vectors = np.ones((4, 3), dtype=np.float32)
    rows = communities.numbered(communities.detect(as_frame(spark, vectors), 0.9, 25)).collect()
    assert {(r.community_id, r.seed, r.size) for r in rows} == {(1, 0, 4)}
    many = as_frame(spark, clustered(5, 300))
    rows = communities.detect(many, 0.9, 3, chunk_rows=100).collect()
    chunk = {r.id: r.chunk for r in rows}
    assert len(set(chunk.values())) == 3
    assert all(chunk[r.seed] == r.chunk for r in rows if r.seed in chunk)


def test_scores_rank_and_consensus(spark):
    members = spark.createDataFrame(
        [(1, i, float(i), i, lab, mod) for i, (lab, mod) in enumerate(
            [("SCAM", True), ("SCAM", True), (None, False), ("VALID", False)], 1)],
        "community_id bigint, comment_id bigint, score double, rank bigint, label string, moderated boolean")
    assert [tuple(r) for r in communities.consensus(members).collect()] == [(1, 0.5, "SCAM")]
    stored = members.select("comment_id", "label", F.lit(None).cast("double").alias("score"), "moderated")
    rows = communities.propagate(stored, members.drop("label", "moderated")).orderBy("comment_id").collect()
    assert [(r.label, r.score, r.moderated) for r in rows] == [
        ("SCAM", None, True), ("SCAM", None, True), ("SCAM", 3.0, False), ("SCAM", 4.0, False)]


def test_consensus_tie_goes_to_first_in_rank(spark):
    members = spark.createDataFrame(
        [(1, 1, "VALID", True), (1, 2, "SCAM", True), (1, 3, None, False)],
        "community_id bigint, rank bigint, label string, moderated boolean")
    assert communities.consensus(members).first().label == "VALID"


def test_community_decisions(spark):
    stored = frame(spark, [comment("1", "SCAM", True, 0.5), comment("2", None, False, 0.5), comment("3", "SCAM", True, 0.5),
                           comment("4", None, False, 0.7)])
    members = spark.createDataFrame([(1, "1"), (1, "2"), (2, "3"), (2, "4")], "community_id bigint, comment_id string")
    decisions = spark.createDataFrame([(1, "X"), (2, "EXPLICIT")], "community_id bigint, response string")
    rows = review.apply_community_decisions(stored, members, decisions).orderBy("comment_id").collect()
    assert [(r.label, r.score, r.moderated) for r in rows] == [
        (None, None, False), (None, None, False), ("SCAM", 0.5, True), ("EXPLICIT", 0.7, True)]


def test_a_reviewed_community_is_not_open_to_decisions(spark):
    stored = frame(spark, [comment("1", "SCAM", True, 0.5), comment("2", "VALID", True, 0.6)])
    members = spark.createDataFrame([(1, "1"), (1, "2")], "community_id bigint, comment_id string")
    decisions = spark.createDataFrame([(1, "X")], "community_id bigint, response string")
    rows = review.apply_community_decisions(stored, members, decisions).orderBy("comment_id").collect()
    assert [(r.label, r.score, r.moderated) for r in rows] == [("SCAM", 0.5, True), ("VALID", 0.6, True)]


def test_community_numbers_are_unique_over_chunks(spark):
    vectors = np.repeat(np.eye(12, dtype=np.float32), 20, axis=0)
    found = communities.detect(as_frame(spark, vectors), 0.9, 3, chunk_rows=120)
    rows = communities.numbered(found).collect()
    assert len({r.chunk for r in rows}) == 2
    assert len({(r.chunk, r.seed) for r in rows}) == len({r.community_id for r in rows}) > 12
    whole = communities.numbered(communities.detect(as_frame(spark, vectors), 0.9, 3, tile_rows=50)).collect()
    assert {(r.community_id, r["size"]) for r in whole} == {(k, 20) for k in range(1, 13)}


def test_similarity_operators_against_brute_force(spark):
    vectors = clustered(9, 120)
    unit = vectors.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    sims = unit @ unit.T
    placed, n_tiles = similarity.place(as_frame(spark, vectors), tile_rows=40)
    assert n_tiles == 3
    counts = {r.id: r.n for r in similarity.neighbour_counts(placed, n_tiles, 0.8).collect()}
    assert counts == {i: int((sims[i] >= 0.8).sum()) for i in range(120)}
    top = {(r.id, r["rank"]): r.neighbour for r in similarity.top_k(placed, n_tiles, 4).collect()}
    for i in range(120):
        order = sorted(range(120), key=lambda j: (-round(sims[i, j], 9), j))[:4]
        assert [top[i, k] for k in range(1, 5)] == order
    pairs = similarity.similar_pairs(as_frame(spark, vectors), 0.8, tile_rows=40).collect()
    assert sum(r.left_copies * r.right_copies for r in pairs) == int((sims >= 0.8).sum())


def near_copies(seed, groups, size, dim=48, noise=0.12):
    """Groups of near copies, a hot group of a third of all rows, some exact copies and a row of zeros."""
    rng = np.random.default_rng(seed)
    owner = np.concatenate([np.repeat(np.arange(groups), size), np.zeros(groups * size // 2, np.int64)])
    vectors = rng.normal(size=(groups, dim))[owner] + rng.normal(scale=noise, size=(len(owner), dim))
    vectors[5], vectors[7], vectors[11] = vectors[4], vectors[4], 0
    return vectors.astype(np.float32)


def test_hashed_similarity_against_brute_force(spark):
    vectors = near_copies(3, 90, 6)
    unit = vectors.astype(np.float64)
    unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-300)
    sims = unit @ unit.T
    data = as_frame(spark, vectors).withColumn("bucket", F.lit("extra"))
    # small buckets and tiles, so that there are several tables and the hot bucket is dealt out
    placed, plan = similarity.place_hashed(data, 0.95, bucket_rows=20, tile_rows=64)
    assert plan.bits == 6 and plan.tables > 8 and plan.hot.count() > 0
    near = sims >= 0.95
    counts = {r.id: r.n for r in similarity.neighbour_counts(placed, plan, 0.95).collect()}
    want = near.sum(axis=1)
    assert sum(counts.values()) >= 0.999 * want.sum() and all(counts[i] <= want[i] for i in counts)
    weighted = {r.id: r.n for r in similarity.near_counts(data, 0.95, bucket_rows=20, tile_rows=64).collect()}
    assert all(weighted[i] == weighted[4] for i in (5, 7)) and weighted.get(11, 0) == 0
    assert sum(weighted.values()) >= 0.999 * want.sum() and all(weighted[i] <= want[i] for i in weighted)
    top = {}
    for r in similarity.top_k(placed, plan, 3).collect():
        top.setdefault(r.id, []).append((r["rank"], r.neighbour))
    same = 0
    for i in range(len(vectors)):
        order = sorted(np.flatnonzero(near[i]), key=lambda j: (-round(sims[i, j], 9), j))[:3]
        same += [j for _, j in sorted(top.get(i, []))] == order
    assert same >= 0.999 * len(vectors)
    pairs = similarity.similar_pairs(data, 0.95, recall=0.9999).collect()
    assert sum(r.left_copies * r.right_copies for r in pairs) >= 0.999 * near.sum()
    assert len({(r.left_id, r.right_id) for r in pairs}) == len(pairs)
    empty = data.limit(0)
    assert similarity.near_counts(empty, 0.95).collect() == [] and similarity.near_top_k(empty, 0.95, 3).collect() == []


def test_hash_tables_keep_buckets_small_and_recall_high():
    for rows, bits in ((100, 0), (1024, 1), (10**6, 11), (10**9, 21)):
        got, tables = similarity.hash_tables(rows, 0.95, 0.99)
        assert got == bits and 1 - (1 - (1 - np.arccos(0.95) / np.pi) ** bits) ** tables >= 0.99
    # the rows that are sent out grow with the tables: less than threefold from a thousand to a billion rows per bit of size
    assert similarity.hash_tables(10**9, 0.95, 0.9)[1] <= 25


def test_hashed_work_grows_in_proportion(spark):
    """Pairs that meet, on 1, 4 and 16 times the rows."""
    met = []
    for times in (1, 4, 16):
        rng = np.random.default_rng(times)
        vectors = rng.normal(size=(500 * times, 32)).astype(np.float32)
        placed, plan = similarity.place_hashed(as_frame(spark, vectors), 0.95, 0.99, bucket_rows=64)
        sizes = placed.select(F.posexplode("marks").alias("table", "bucket")).groupBy("table", "bucket").count()
        met.append(sizes.agg(F.sum(F.col("count") * F.col("count"))).first()[0])
    assert met[1] < 9 * met[0] and met[2] < 9 * met[1] and met[2] < 0.25 * 16 * 16 * met[0]


def test_hashed_communities_equal_the_sequential_definition(spark):
    vectors = near_copies(4, 30, 6)
    want = sequential(np.where(vectors == 0, 1e-9, vectors), 0.95, 3)
    got = {}
    for r in communities.detect(as_frame(spark, vectors), 0.95, 3, recall=0.9999).collect():
        got.setdefault(r.seed, set()).add(r.id)
    assert {s: m - {11} for s, m in got.items()} == {s: m - {11} for s, m in want.items()}


def test_wordpieces_against_greedy_walk(spark):
    rng = random.Random(2)
    vocabulary = {p: i for i, p in enumerate(["a", "ab", "abc", "b", "##a", "##b", "##bc", "##cab", "##c", "ca"])}
    words = sorted({"".join(rng.choices("abcd", weights=[4, 4, 3, 1], k=rng.randrange(1, 9))) for _ in range(200)})

    def greedy(word):
        pieces, start = [], 0
        while start < len(word):
            for end in range(len(word), start, -1):
                piece = ("##" if start else "") + word[start:end]
                if piece in vocabulary:
                    pieces.append(piece)
                    start = end
                    break
            else:
                return ["[UNK]"]
        return pieces

    vocab = spark.createDataFrame(list(vocabulary.items()), "piece string, id bigint")
    got = wordpieces.split_tokens(spark.createDataFrame([(w,) for w in words], "token string"), vocab)
    assert {r.token: r.pieces for r in got.collect()} == {w: greedy(w) for w in words}
    joined = wordpieces._split_by_join(spark.createDataFrame([(w,) for w in words], "token string"), vocab)
    assert {r.token: (r.pieces, r.ids) for r in joined.collect()} == {r.token: (r.pieces, r.ids) for r in got.collect()}


def test_a_long_token_is_walked_quickly():
    pieces = wordpieces.Pieces([("a" * n, n) for n in range(1, 40)] + [("##" + "a" * n, 100 + n) for n in range(1, 40)] + [("a", 7)])
    start = time.perf_counter()
    assert pieces.walk("a" * 20_000)[1] == [39] + [139] * 511 + [132] and pieces.walk("a") == (["a"], [7])
    assert pieces.walk("a" * 20_000 + "b") == (["[UNK]"], [100]) and pieces.walk("") == (["[UNK]"], [100])
    assert time.perf_counter() - start < 1


def test_vocabularies_beyond_the_broadcast_bound(spark, monkeypatch):
    vocab = spark.createDataFrame([("a", 1), ("##b", 2), ("b", 3)], "piece string, id bigint")
    df = spark.createDataFrame([("1", "a ab ba"), ("2", None), ("3", "")], "k string, text string")
    small = sorted(tuple(r) for r in wordpieces.encode(df, vocab, "k").collect())
    monkeypatch.setattr(wordpieces, "BROADCAST_ROWS", 2)
    assert sorted(tuple(r) for r in wordpieces.encode(df, vocab, "k").collect()) == small == [("1", [1, 1, 2, 100]), ("2", []), ("3", [])]


def test_token_arrays(spark):
    df = spark.createDataFrame([("it's 2 o'clock!",)], "t string")
    row = df.select(tokens.pretokenise(F.col("t")).alias("t")).first()
    assert row.t == ["it", "'", "s", "2", "o", "'", "clock", "!"]
    ids = F.array(F.lit(5).cast("bigint"), F.lit(6).cast("bigint"))
    padded, cut, marked = df.select(tokens.pad_or_truncate(ids, 3), tokens.pad_or_truncate(ids, 1), tokens.with_markers(ids)).first()
    assert (padded, cut, marked) == ([5, 6, 0], [5], [101, 5, 6, 102])
    short, exact, over = df.select(*(tokens.fixed_length(ids, n) for n in (5, 4, 3))).first()
    assert (short, exact, over) == ([101, 5, 6, 102, 0], [101, 5, 6, 102], [101, 5, 102])


def test_encoding_keeps_whole_texts(spark):
    vocab = wordpieces.numbered_pieces(spark.createDataFrame([("b",), ("a",), ("##b",), ("a",)], "piece string"))
    assert {r.piece: r.id for r in vocab.collect()} == {"##b": 1000, "a": 1001, "b": 1002}
    df = spark.createDataFrame([("1", "a ab " * 300), ("2", ""), ("3", "x b")], "k string, text string")
    whole = {r.k: r.ids for r in wordpieces.encode(df, vocab, "k").collect()}
    assert whole == {"1": [1001, 1001, 1000] * 300, "2": [], "3": [100, 1002]}
    cut = {r.k: r.ids for r in wordpieces.encode(df, vocab, "k", length=4).collect()}
    assert cut == {"1": [1001, 1001, 1000, 1001], "2": [], "3": [100, 1002]}


def test_metrics(spark):
    df = spark.createDataFrame([("A", "A"), ("A", "A"), ("B", "A")], "label string, prediction string")
    row = evaluate.evaluate(df, cap=2).first()
    assert row.balanced_accuracy == 0.5 and abs(row.accuracy - 2 / 3) < 1e-9
    assert abs(row.precision - (2 * (2 / 3)) / 3) < 1e-9 and row.eval_samples == 2
    assert abs(row.fscore - 2 * 0.8 / 3) < 1e-9


def test_scores(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],), ([],)], "z array<double>")
    assert [r[0] for r in df.select(scores.argmax(F.col("z"))).collect()] == [1, -1]
    row = spark.range(1).select(
        scores.is_confident(F.lit("SCAM"), F.lit(0.9)), scores.is_confident(F.lit("VALID"), F.lit(1.0)),
        scores.label_of(F.lit(1)), scores.model_id_of(F.lit("SCAM")), scores.model_id_of(F.lit("x"))).first()
    assert tuple(row) == (True, False, "SCAM", 1, None)


def test_policy_and_threads(spark):
    rows = spark.createDataFrame(
        [("t1", "t1", True, "SCAM"), ("r1", "t1", False, "VALID"), ("t2", "t2", True, "VALID"),
         ("r2", "t2", False, "SCAM"), ("r3", "t2", False, "REPLY_TO_SCAM")],
        "comment_id string, thread_id string, is_top boolean, label string")
    acted = policy.with_action(rows, policy.settings_table(spark, {"action": "remove"}))
    hidden = {r.comment_id: r.hidden for r in policy.cascade_threads(acted).collect()}
    assert hidden == {"t1": True, "r1": True, "t2": False, "r2": True, "r3": False}
    defaults = {r.label: (r.enabled, r.action) for r in policy.label_policy(policy.settings_table(spark)).collect()}
    assert {k for k, (on, _) in defaults.items() if on} == {"SCAM", "EXPLICIT", "LINK_SPAM", "OTHER_SPAM"}
    assert {a for _, a in defaults.values()} == {"blur"}
    linked = policy.settings_table(spark, {"rules-links-contains": "true"})
    on = {r.label for r in policy.label_policy(linked).filter("enabled").collect()}
    assert {"LINK_ONLY", "LINK_CONTAINS"} <= on

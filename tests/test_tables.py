import json
import random

import pytest
from pyspark.sql import functions as F

from commentlens.operators import dataset, ranking, store
from commentlens.schema import COMMENTS, LABELS
from commentlens.sources import tables, threads
from commentlens.streaming import ingest

DOCUMENT = {
    "video_id": "v1", "retrieval_time": 1700000000.0, "video_info": {"items": [{}]},
    "comments_info": [{"items": [{
        "snippet": {"topLevelComment": {"id": "c1", "snippet": {
            "videoId": "v1", "textOriginal": "first", "likeCount": 3, "publishedAt": "2023-01-01T00:00:00Z",
            "updatedAt": "2023-01-01T00:00:00Z", "authorDisplayName": "ann", "authorProfileImageUrl": "u",
            "authorChannelId": {"value": "ch1"}}}},
        "replies": {"comments": [{"id": "c1.r1", "snippet": {
            "videoId": "v1", "textOriginal": "reply", "likeCount": 0, "publishedAt": "2023-01-02T00:00:00Z",
            "updatedAt": "2023-01-02T00:00:00Z", "authorDisplayName": "bob", "authorProfileImageUrl": "u"}}]}}],
        "nextPageToken": "p2"}],
}


def comment(i, label=None, moderated=False, score=None, **other):
    row = dict(comment_id=i, video_id="v", text=f"t{i}", likes=1, publish_date="d", update_date="d", author_name="a",
               author_profile_url="u", author_channel_id="ch", label=label, score=score, moderated=moderated)
    return {**row, **other}


def frame(spark, rows, schema=COMMENTS):
    relaxed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return spark.createDataFrame([tuple(r[f.name] for f in schema.fields) for r in rows], relaxed)


def test_thread_document(spark, tmp_path):
    (tmp_path / "v1.json").write_text(json.dumps(DOCUMENT, indent=1))
    documents = threads.read_threads(spark, str(tmp_path), one_document_per_file=True)
    rows = threads.flatten(documents).orderBy("comment_id").collect()
    assert [(r.comment_id, r.thread_id, r.is_top, r.author_channel_id) for r in rows] == [
        ("c1", "c1", True, "ch1"), ("c1.r1", "c1", False, None)]
    table = tables.CommentTable(spark, str(tmp_path / "stored"))
    for _ in range(2):
        ingest.ingest(documents, table)
    assert [(r.comment_id, r.likes, r.moderated) for r in table.read().collect()] == [("c1", 3, False)]


def test_page_cap_keeps_one_more(spark):
    pages = [{"items": []}] * 12
    df = spark.read.schema(threads.THREAD_DOCUMENT).json(
        spark.sparkContext.parallelize([json.dumps({**DOCUMENT, "comments_info": pages})]))
    assert threads.cap_pages(df).select(F.size("comments_info")).first()[0] == 11
    missing = {**DOCUMENT, "video_info": {"items": []}}
    df = spark.read.schema(threads.THREAD_DOCUMENT).json(spark.sparkContext.parallelize([json.dumps(missing)]))
    assert threads.existing_videos(df).count() == 0


def test_insert_or_ignore(spark):
    stored = frame(spark, [comment("c1", text="old")])
    incoming = frame(spark, [comment("c1", text="new"), comment("c2", text="a"), comment("c2", text="b"),
                             comment("c3", author_channel_id=None)])
    merged = store.insert_or_ignore(stored, incoming, [F.col("text")])
    assert sorted((r.comment_id, r.text) for r in merged.collect()) == [("c1", "old"), ("c2", "a")]


def test_update_by_key(spark):
    stored = frame(spark, [comment("c1", "SCAM", True), comment("c2", "VALID")])
    updates = frame(spark, [comment("c1", None, False), comment("zz", "SCAM")])
    rows = store.update_by_key(stored, updates).orderBy("comment_id").collect()
    assert [(r.comment_id, r.label, r.moderated) for r in rows] == [("c1", None, False), ("c2", "VALID", False)]
    assert store.update_by_key(stored, updates.limit(0)).count() == 2


def test_training_eligible(spark):
    rows = [comment("1", "VALID"), comment("2", "SCAM"), comment("3", "SCAM", True), comment("4", None, True)]
    assert sorted(r.comment_id for r in store.training_eligible(frame(spark, rows)).collect()) == ["1", "3"]


def test_review_floor_is_inclusive(spark):
    rows = [comment("1", score=0.95), comment("2", score=0.94), comment("3"), comment("4", score=1.0, moderated=True)]
    assert [r.comment_id for r in store.review_eligible(frame(spark, rows)).collect()] == ["1"]


def test_caller_sql(spark):
    rows = frame(spark, [comment(str(i)) for i in range(5)])
    got = store.comments_sql(spark, "SELECT * FROM {c} WHERE comment_id > :x", {"x": "2"}, shuffle=True, c=rows)
    assert got.count() == 2
    with pytest.raises(ValueError):
        store.comments_sql(spark, "SELECT * FROM {c} LIMIT 1", shuffle=True, c=rows)
    with pytest.raises(ValueError):
        store.comments_sql(spark, "SELECT 1 AS other FROM {c}", c=rows)


def test_dedupe_before_cap(spark):
    rows = [comment("1", "SCAM", True, author_name="a", text="x"), comment("2", "SCAM", True, author_name="a", text="x"),
            comment("3", "SCAM", True, author_name="b", text="y")]
    built = dataset.build_dataset(frame(spark, rows), cap=1).collect()
    assert len(built) == 1
    assert dataset.build_dataset(frame(spark, rows), cap=9).count() == 2


def skewed(spark, n=6000):
    """One key owns a third of the rows and more."""
    rng = random.Random(3)
    rows = [(f"r{i}", "hot" if i % 3 == 0 else f"k{rng.randrange(40)}", rng.randrange(50)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "comment_id string, k string, v int").repartition(8)


def test_top_n_per_key_is_exact(spark):
    rows, df = skewed(spark)
    keyed = df.withColumn("h", ranking.seeded_order("s", "comment_id"))
    for n in (1, 7, 150, 5000):
        got = ranking.top_n_per_key(keyed, ["k"], "h", n, "comment_id")
        hashes = {r.comment_id: (r.h, r.k) for r in keyed.collect()}
        want = set()
        for key in {r[1] for r in rows}:
            mine = sorted((h, i) for i, (h, k) in hashes.items() if k == key)
            want |= {i for _, i in mine[:n]}
        assert {r.comment_id for r in got.collect()} == want


def test_rank_within_both_ways(spark):
    _, df = skewed(spark)
    order = [F.desc("v"), F.col("comment_id")]
    plain = {(r.comment_id, r["rank"]) for r in ranking.rank_within(df, ["k"], order).collect()}
    ranged = {(r.comment_id, r["rank"]) for r in ranking.rank_within(df, ["k"], order, max_group_rows=10).collect()}
    assert plain == ranged and len(plain) == 6000


def test_hot_keys_are_cut_before_the_shuffle(spark):
    _, df = skewed(spark)
    plan = ranking.first_per_key(df, ["k"], [F.col("v"), F.col("comment_id")])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in text and "Partial" in text


def test_edges_overlap_in_small_groups(spark):
    df = spark.createDataFrame([("a", t) for t in "pqrs"], "k string, t string")
    got = {(r.t, r.side, r.position) for r in ranking.edge_rows(df, ["k"], [F.col("t")]).collect()}
    assert got == {("p", "first", 1), ("q", "first", 2), ("r", "first", 3), ("s", "last", 1), ("r", "last", 2), ("q", "last", 3)}


def test_splits_partition_the_input(spark):
    df = spark.range(20_000).select(F.col("id").cast("string").alias("comment_id"))
    shares = {r.s: r.n / 20_000 for r in df.groupBy(dataset.split_column().alias("s")).agg(F.count("*").alias("n")).collect()}
    assert abs(shares["train"] - 0.8) < 0.02 and abs(shares["valid"] - 0.1) < 0.02 and abs(shares["test"] - 0.1) < 0.02


def test_round_trips(spark, tmp_path):
    rows = frame(spark, [comment(str(i), "VALID") for i in range(40)] + [comment("40", "VALID", text="t39")])
    tables.write_dataset(dataset.build_dataset(rows), str(tmp_path / "d"))
    everything = tables.read_dataset(spark, str(tmp_path / "d"), ("train", "valid", "test"))
    assert everything.count() == 40
    assert tables.read_dataset(spark, str(tmp_path / "d")).count() == everything.filter("split <> 'test'").count()
    odd = spark.createDataFrame([(1, 'say "hi"\tthere\nyou\\', "VALID")], "index bigint, text string, prediction string")
    tables.write_predictions(odd, str(tmp_path / "p"))
    assert tables.read_predictions(spark, str(tmp_path / "p")).collect() == odd.collect()


def test_prediction_files_split_and_keep_every_character(spark, tmp_path):
    texts = ["a\tb", "line\nfeed", "carriage\r\nreturn", 'quo"te', "'", "\\", "\\n", "\\\\t", r"\N", "", " lead and trail ", "#", "\0zero", None, "é\u2028中\x85", "\\0"]
    rows = [(i, texts[i % len(texts)], "VALID" if i % 5 else None) for i in range(4000)]
    frame_ = spark.createDataFrame(rows, "index bigint, text string, prediction string").coalesce(1)
    tables.write_predictions(frame_, str(tmp_path / "p"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        back = tables.read_predictions(spark, str(tmp_path / "p"))
        assert back.rdd.getNumPartitions() > 2
        assert sorted(back.collect(), key=lambda r: r[0]) == sorted(frame_.collect(), key=lambda r: r[0])
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_unknown_fields_survive_the_landing(spark, tmp_path):
    whole = {**DOCUMENT, "video_info": {"items": [{"id": "v1"}], "etag": "x", "deep": {"list": [1, {"k": None}]}}}
    threads.land_raw(spark.createDataFrame([(json.dumps(whole),), (json.dumps({"video_id": "v2"}),)], "document string"), str(tmp_path / "raw"))
    raw = threads.read_raw(spark, str(tmp_path / "raw"))
    rows = {r.video_id: r for r in raw.select("video_id", "retrieval_time", F.to_json("video_info").alias("info"), F.to_json("comments_info").alias("pages")).collect()}
    assert json.loads(rows["v1"].info) == whole["video_info"] and json.loads(rows["v1"].pages) == DOCUMENT["comments_info"]
    assert rows["v2"].info is None and rows["v2"].retrieval_time > 1.6e9
    flat = threads.flatten(threads.typed(raw)).orderBy("comment_id").collect()
    assert [(r.comment_id, r.author_channel_id) for r in flat] == [("c1", "ch1"), ("c1.r1", None)]


def test_an_insert_reads_the_folders_of_its_ids_only(spark, tmp_path):
    table = tables.CommentTable(spark, str(tmp_path / "t"))
    for start in (0, 500):
        table.insert(frame(spark, [comment(f"k{i:04d}") for i in range(start, start + 500)]), [F.col("text")])
    few = frame(spark, [comment("k0003"), comment("k0700"), comment("new")])
    files = {r[0] for r in table.near(few).select(F.input_file_name()).distinct().collect()}
    every = {r[0] for r in table.read().select(F.input_file_name()).distinct().collect()}
    assert 0 < len(files) <= 6 < len(every)
    table.insert(few, [F.col("text")])
    assert table.read().count() == 1001 and table.read().select("comment_id").distinct().count() == 1001
    table.insert(few.limit(0), [F.col("text")])
    assert table.read().count() == 1001


def test_texts_are_not_written_before_the_cap(spark, tmp_path):
    rows = frame(spark, [comment(str(i), "VALID", text=f"t{i % 30}", author_name=f"a{i % 2}") for i in range(200)])
    written = []
    plain = dataset.written_table
    dataset.written_table = lambda df, name: written.append(df.columns) or plain(df, name)
    try:
        built = dataset.build_dataset(rows, cap=7).collect()
    finally:
        dataset.written_table = plain
    assert written == [["comment_id", "label"]] and len(built) == 7
    assert len({(r.author_name, r.text) for r in built}) == 7


def test_batched_map(spark):
    from commentlens.operators.mapping import map_batches

    sizes = spark.sparkContext.accumulator(0)

    def function(columns):
        assert set(columns) == {"a", "b"} and 0 < len(columns["a"]) <= 3
        sizes.add(1)
        return {"b": [x * 2 if x is not None else None for x in columns["b"].to_pylist()], "n": [len(x) for x in columns["a"].to_pylist()]}

    df = spark.createDataFrame([("x" * i, i if i % 4 else None, i) for i in range(10)], "a string, b bigint, c int").repartition(12)
    got = map_batches(df, function, "b bigint, n int", ["a", "b"], batch_rows=3)
    assert got.columns == ["a", "c", "b", "n"]
    assert sorted((r.c, r.a, r.b, r.n) for r in got.collect()) == [(i, "x" * i, 2 * i if i % 4 else None, i) for i in range(10)]
    assert map_batches(df.limit(0), function, "b bigint, n int", ["a", "b"]).collect() == []
    with pytest.raises(Exception, match="as many rows"):
        map_batches(df, lambda c: {"n": [1]}, "n int").coalesce(1).collect()


def test_label_counts_are_zero_filled(spark):
    counts = {r.label: r.n for r in dataset.label_counts(frame(spark, [comment("1", "SCAM")])).collect()}
    assert set(counts) == set(LABELS) and counts["SCAM"] == 1 and counts["SPONSOR"] == 0


def test_rewrite_and_shared_folder(spark, tmp_path):
    from commentlens.session import shared_dir, work_path, written_table

    table = tables.CommentTable(spark, str(tmp_path / "v1"))
    table.insert(frame(spark, [comment("1"), comment("2")]), [F.col("text")])
    updated = store.update_by_key(table.read(), frame(spark, [comment("2", "SCAM", True)]))
    newer = table.rewrite(updated, str(tmp_path / "v2"))
    assert {(r.comment_id, r.label, r.moderated) for r in newer.read().collect()} == {("1", None, False), ("2", "SCAM", True)}
    assert table.read().filter("moderated").count() == 0
    assert work_path(spark, "x").startswith(shared_dir(spark))
    assert written_table(table.read(), "copy").count() == 2
    before = spark.conf.get("spark.checkpoint.dir", None)
    assert before is None or before.rstrip("/") == shared_dir(spark)

from pyspark.sql import functions as F

from commentlens.operators import policy
from commentlens.streaming import live

ROWS = [("a", 1, "text me on", "hi"), ("b", 2, "bob", "hi"), ("a", 3, "bob", "changed"), ("c", 4, "bob", "http://x.org")]
SCHEMA = "comment_id string, n int, author_name string, text string"


def test_each_id_is_classified_once_over_several_runs(spark, tmp_path):
    feed, log, state = (str(tmp_path / n) for n in ("feed", "log", "state"))

    def arrive(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(feed)
        stream = spark.readStream.schema(SCHEMA).parquet(feed)
        live.classify_once(stream, log, state, ["n"]).awaitTermination()

    arrive(ROWS)
    first = {r.comment_id: r.label for r in live.predictions(spark, log).collect()}
    assert first == {"a": "SCAM", "b": "VALID", "c": "LINK_ONLY"}
    arrive([("b", 5, "text me on", "hi"), ("d", 6, "bob", "my niece is burning")])
    rows = live.predictions(spark, log).collect()
    assert len(rows) == 4 and {r.comment_id: r.label for r in rows} == {**first, "d": "SCAM"}

    sightings = spark.createDataFrame(ROWS, SCHEMA)
    for action in ("blur", "remove"):
        acted = live.live_actions(sightings, live.predictions(spark, log), policy.settings_table(spark, {"action": action}))
        assert sorted((r.comment_id, r.action) for r in acted.collect()) == [
            ("a", action), ("a", action), ("b", "none"), ("c", "none")]


def test_stream_equals_batch(spark, tmp_path):
    feed, out = str(tmp_path / "feed"), str(tmp_path / "out")
    spark.createDataFrame(ROWS, SCHEMA).repartition(3).write.parquet(feed)
    stream = live.score_stream(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(feed))
    stream.writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).format(
        "parquet").start(out).awaitTermination()
    batch = live.score_stream(spark.createDataFrame(ROWS, SCHEMA))
    key = ["comment_id", "n", "rule_label"]
    assert sorted(spark.read.parquet(out).select(key).collect()) == sorted(batch.select(key).collect())


def test_watermarked_variant_drops_repeats(spark, tmp_path):
    feed = str(tmp_path / "feed")
    rows = spark.createDataFrame(ROWS, SCHEMA).withColumn("ts", F.timestamp_seconds(F.col("n")))
    rows.write.parquet(feed)
    stream = live.first_sightings(spark.readStream.schema(rows.schema).parquet(feed), "ts", "1 hour")
    stream.writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).format(
        "parquet").start(str(tmp_path / "out")).awaitTermination()
    assert sorted(r.comment_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]


def test_rules_can_be_switched_off(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    off = policy.settings_table(spark, {"use-rules": "false"})
    assert {r.label for r in live.rule_classifier(rows, off).collect()} == {"VALID"}
    on = policy.settings_table(spark)
    assert {r.label for r in live.rule_classifier(rows, on).collect()} == {"SCAM", "VALID", "LINK_ONLY"}


def test_a_batch_reads_the_log_folders_of_its_ids(spark, tmp_path):
    """Several files and one per trigger: an id is logged once, also if it comes back days later."""
    feed, log, state = (str(tmp_path / n) for n in ("feed", "log", "state"))
    for day in range(4):
        rows = [(f"id{i}", day, "bob", "hi") for i in range(day, 40 + day)]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(feed)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(feed)
    live.classify_once(stream, log, state, ["n"]).awaitTermination()
    rows = live.predictions(spark, log).collect()
    assert len(rows) == 43 == len({r.comment_id for r in rows}) and {r.batch_id for r in rows} == {0, 1, 2, 3}
    one = spark.createDataFrame([("id1",)], "comment_id string")
    known = live.predictions(spark, log).filter(F.col("bucket").isin(live.held_buckets(one, live.LOG_BUCKETS)))
    files = known.select(F.input_file_name()).distinct().count()
    assert files < live.predictions(spark, log).select(F.input_file_name()).distinct().count() / 3


def test_settings_changed_between_batches_take_effect(spark, tmp_path):
    feed, settings, out, state = (str(tmp_path / n) for n in ("feed", "settings", "out", "state"))
    for n, changes in enumerate(({"action": "blur"}, {"action": "remove"}, {"use-rules": "false"})):
        live.save_settings(policy.settings_table(spark, changes), settings)
        spark.createDataFrame([(f"{i}{n}", n, a, t) for i, _, a, t in ROWS[:2]], SCHEMA).coalesce(1).write.mode("append").parquet(feed)
        live.act_on_stream(spark.readStream.schema(SCHEMA).parquet(feed), settings, out, state).awaitTermination()
    rows = spark.read.parquet(out).collect()
    assert sorted((r.comment_id, r.label, r.action) for r in rows) == [
        ("a0", "SCAM", "blur"), ("a1", "SCAM", "remove"), ("a2", "VALID", "none"), ("b0", "VALID", "none"), ("b1", "VALID", "none"), ("b2", "VALID", "none")]

"""A training corpus from ``documents``: quality, exact copies, near copies, benchmark leaks, source mix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commentlens.llm import bytecnn
from commentlens.llm.blocknames import collapsed, exact_duplicates
from commentlens.llm.circulant import near_duplicates
from commentlens.llm.contain import contaminated
from commentlens.llm.mixing import mixed
from commentlens.plans.registry import table
from commentlens.session import written_table

#: A document goes if its score is below this; lower than the classifier's own cut, to spare clean ones.
REJECT_BELOW = 0.5


def _only(docs: DataFrame, wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows whose id is in ``wanted`` (distinct ids); null ids meet each other."""
    ids = wanted.select(F.col(id_col).alias("__id"))
    return docs.join(ids, docs[id_col].eqNullSafe(F.col("__id")), "left_semi")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte network does not reject."""
    network = bytecnn.train(docs, table(spark, sf_dir, "labels"))
    return bytecnn.scored(docs, network).where(F.col("score") >= REJECT_BELOW).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of equal texts; of rows that repeat id and text, one.

    A row goes or stays by its own text, also where other rows have its id or, like it, none.
    """
    decided = exact_duplicates(docs)
    pair = decided.select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"), "kept")
    hashed = docs.withColumn("__own", F.sha2(collapsed(F.col("text")), 256))
    same = hashed["doc_id"].eqNullSafe(F.col("__id")) & (hashed["__own"] == F.col("__sha"))
    stay = hashed.join(pair.where("kept").drop("kept"), same, "left_semi")
    repeats = written_table(pair.groupBy("__id", "__sha").count().where("count > 1").drop("count"), "pipeline-repeats")
    if not repeats.isEmpty():
        stay = stay.join(repeats, same, "left_anti").unionByName(stay.join(repeats, same, "left_semi").dropDuplicates(["doc_id", "__own"]))
    return stay.select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more.

    Rows of one id are one document here; rows without id stay.
    """
    return _only(docs, near_duplicates(docs).where("kept").select("doc_id").distinct())


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; each row goes or stays by its own text, whatever its id."""
    found = contaminated(docs, table(spark, sf_dir, "benchmark"), with_digest=True)
    leaks = written_table(found.select(F.col("text_sha256").alias("__sha")).distinct(), "pipeline-leaks")
    own = F.sha2(F.coalesce(docs["text"], F.lit("")), 256)
    return docs.join(leaks, own == F.col("__sha"), "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its ``copies`` says, numbered by ``copy``, so that the languages meet their target weights.

    A document with no copies is dropped.
    """
    rows = mixed(docs, table(spark, sf_dir, "labels"))
    numbers = F.when(F.col("copies") > 0, F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return rows.select(*(c for c in rows.columns if c != "copy"), F.explode(numbers).alias("copy"))


STAGES = [
    ("quality_classifier", quality),
    ("exact_dedup", exact),
    ("minhash_near_dedup", near),
    ("benchmark_decontamination", decontaminated),
    ("source_mixing", mix),
]

#: Two stages fit models, which SQL can't express; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each over the written result of the one before."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

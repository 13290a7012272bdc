"""Human review: author queues, previews, suggestions and applying decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commentlens.operators.ranking import edge_rows
from commentlens.operators.store import update_by_key
from commentlens.session import merged

# Answers that are not label names.
ACCEPT, RESET = "0", "X"


def author_groups(df: DataFrame) -> DataFrame:
    """Rows per author and the suggested label: that of the first row by text."""
    return df.groupBy("author_channel_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.struct("text", "comment_id", "label"))["label"].alias("suggested"),
    )


def author_queue(df: DataFrame) -> DataFrame:
    """Authors by group size, largest first; ties by id."""
    return author_groups(df).orderBy(F.desc("n"), "author_channel_id")


def author_preview(df: DataFrame, n: int = 3) -> DataFrame:
    """First and last rows by text for each author."""
    return edge_rows(df, ["author_channel_id"], [F.col("text"), F.col("comment_id")], n)


def apply_author_decisions(stored: DataFrame, queue: DataFrame, decisions: DataFrame) -> DataFrame:
    """Write the answers back: ``0`` accepts the suggestion, empty skips, else a label name.

    ``decisions`` holds one ``response`` per ``author_channel_id``. Only queue rows change,
    and they become moderated.
    """
    answered = decisions.filter(F.col("response").isNotNull() & (F.col("response") != ""))
    chosen = answered.join(author_groups(queue), "author_channel_id").select(
        "author_channel_id",
        F.when(F.col("response") == ACCEPT, F.col("suggested")).otherwise(F.col("response")).alias("chosen"),
    )
    updates = (
        queue.join(chosen, "author_channel_id")
        .withColumns({"label": F.col("chosen"), "moderated": F.lit(True)})
        .select(*queue.columns)
    )
    return update_by_key(stored, updates)


def community_preview(members: DataFrame, n: int = 3) -> DataFrame:
    """First and last unreviewed members of each community in score order."""
    open_rows = members.filter(~F.col("moderated"))
    return edge_rows(open_rows, ["community_id"], [F.col("rank")], n)


def reviewed_histogram(members: DataFrame) -> DataFrame:
    """Labels of the reviewed members per community."""
    return (
        members.filter("moderated").groupBy("community_id", "label").agg(F.count(F.lit(1)).alias("n"))
    )


def apply_community_decisions(stored: DataFrame, members: DataFrame, decisions: DataFrame) -> DataFrame:
    """``X`` resets every member; a label goes to the unreviewed members only, score untouched.

    A community without unreviewed members is not open to a decision and stays as it is.
    ``members`` holds ``community_id, comment_id``; ``decisions`` one ``response`` per community.
    """
    answered = decisions.filter(F.col("response").isNotNull() & (F.col("response") != ""))
    found = stored.join(merged(members.select("community_id", "comment_id")), "comment_id")
    undecided = found.filter(~F.col("moderated")).select("community_id").distinct()
    touched = (
        found.join(merged(answered.join(merged(undecided), "community_id")), "community_id")
        .filter((F.col("response") == RESET) | ~F.col("moderated"))
    )
    reset = F.col("response") == RESET
    updates = touched.select(
        *(c for c in stored.columns if c not in ("label", "score", "moderated")),
        F.when(~reset, F.col("response")).alias("label"),
        F.when(~reset, F.col("score")).alias("score"),
        (~reset).alias("moderated"),
    )
    return update_by_key(stored, merged(updates))

"""Greedy communities of near-identical rows, their scores, and label propagation.

A row with enough neighbours is a candidate centre. Taken from the largest neighbourhood down,
a candidate claims its neighbours that are still free, if enough are left. The whole table is one
chunk unless the caller asks for more; neighbours never span chunks. The first candidates of a chunk, as many
as have few enough free neighbours by count, are settled by one walk over their lists. The others then go through
a round that never lists neighbours: a candidate is accepted once it is the best remaining candidate for every
free neighbour it has, and candidates with too few are dropped. Walks shorten the chains of candidates that wait
for one another, rounds settle any number of candidates that don't; both give the greedy result. What a step
leaves is written as a table, whose size the next step's plan starts from. Joins by id or seed are merge joins, so
what passes through the driver doesn't grow with the table.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from commentlens.operators import similarity
from commentlens.operators.ranking import rank_within
from commentlens.operators.store import update_by_key
from commentlens.session import merged, written_table

THRESHOLD = 0.95
MIN_SIZE = 25
CONSENSUS = 0.5

# neighbour-list entries of one chunk that one task may walk over
WALK_ENTRIES = 5_000_000
# candidates of one chunk that a walk may settle
LEAD_ROWS = 50_000

# marks a row of ``_round`` that is a member's claim rather than a centre's count
CLAIM = -1


def _round(centres: DataFrame, members: DataFrame, n_tiles: int, threshold: float) -> DataFrame:
    """Per tile: free neighbours of each centre, and the best centre of each free member."""

    def claim(left, right, slabs):
        remaining = np.zeros(len(left["id"]), dtype=np.int64)
        best = np.full(len(right["id"]), -1, dtype=np.int64)
        for part, sims in slabs:
            near = sims >= threshold
            remaining[part] = near.sum(axis=1)
            open_columns = np.nonzero((best < 0) & near.any(axis=0))[0]
            best[open_columns] = part.start + near[:, open_columns].argmax(axis=0)
        hit = best >= 0
        return {
            "centre": np.concatenate([left["id"], left["id"][best[hit]]]),
            "n0": np.concatenate([left["n0"], left["n0"][best[hit]]]),
            "member": np.concatenate([left["id"], right["id"][hit]]),
            "remaining": np.concatenate([remaining, np.full(int(hit.sum()), CLAIM)]),
        }

    return similarity.tiled(
        centres, members, n_tiles, claim, centre="id", n0="bigint", member="id", remaining="bigint"
    )


def _walk(centres: DataFrame, members: DataFrame, n_tiles: int, threshold: float) -> DataFrame:
    """``chunk, seed, n0, id``: the greedy walk per chunk over listed neighbours."""

    def entries(left, right, slabs):
        for part, sims in slabs:
            i, j = np.nonzero(sims >= threshold)
            at = part.start + i
            yield {"chunk": left["chunk"][at], "seed": left["id"][at], "n0": left["n0"][at],
                   "needed": left["needed"][at], "id": right["id"][j]}

    def settle(table: pa.Table) -> pa.Table:
        table = table.sort_by([("n0", "descending"), ("seed", "ascending"), ("id", "ascending")])
        _, codes = np.unique(table["id"].to_numpy(), return_inverse=True)
        seeds, needed = table["seed"].to_numpy(), table["needed"].to_numpy()
        starts = np.flatnonzero(np.r_[True, seeds[1:] != seeds[:-1]])
        taken = np.zeros(codes.max() + 1, dtype=bool)
        kept = []
        for start, end in zip(starts, np.r_[starts[1:], len(codes)]):
            free = start + np.flatnonzero(~taken[codes[start:end]])
            if len(free) >= needed[start]:
                taken[codes[free]] = True
                kept.append(free)
        rows = np.concatenate(kept) if kept else np.zeros(0, dtype=np.int64)
        return table.select(["chunk", "seed", "n0", "id"]).take(rows)

    listed = similarity.tiled(
        centres, members, n_tiles, entries, chunk="bigint", seed="id", n0="bigint", needed="bigint", id="id"
    )
    id_type = centres.schema["id"].dataType.simpleString()
    return listed.groupBy("chunk").applyInArrow(settle, f"chunk bigint, seed {id_type}, n0 bigint, id {id_type}")


def _lead(centres: DataFrame, walk_entries: int) -> DataFrame:
    """``chunk, id`` of the first candidates, whose neighbour lists hold at most ``walk_entries`` together."""
    order = Window.partitionBy("chunk").orderBy(F.desc("n0"), "id")
    first = centres.select("chunk", "id", "n0", "remaining").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= LEAD_ROWS)
    # all of one id, should it repeat
    entries = F.sum("remaining").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return first.withColumn("entries", entries).filter(F.col("entries") <= walk_entries).select("chunk", "id").distinct()


def detect(vectors: DataFrame, threshold: float = THRESHOLD, min_size: int = MIN_SIZE,
           chunk_rows: int | None = None, tile_rows: int = similarity.TILE_ROWS,
           walk_entries: int = WALK_ENTRIES, recall: float | None = None) -> DataFrame:
    """``chunk, seed, n0, id`` of every community member; ``vectors`` is ``id, embedding``.

    With ``recall`` rows meet by hash tables, for a high threshold, instead of every tile with every other.
    """
    if recall is None:
        placed, n_tiles = similarity.place(vectors, chunk_rows, tile_rows)
        placed = written_table(placed, "communities-placed")
    else:
        placed, n_tiles = similarity.place_hashed(vectors, threshold, recall)
    sizes = placed.groupBy("chunk").agg(F.count(F.lit(1)).alias("rows"))
    counts = similarity.neighbour_counts(placed, n_tiles, threshold).withColumnRenamed("n", "n0")
    # the minimum is clamped to the chunk size; there is one size row per chunk
    centres = written_table(
        placed.join(merged(counts), "id").join(sizes, "chunk")
        .withColumn("needed", F.least(F.lit(min_size).cast("bigint"), F.col("rows")))
        .filter(F.col("n0") >= F.col("needed"))
        .drop("rows")
        .withColumn("remaining", F.col("n0")),
        "communities-centres",
    )
    members, found = placed, []
    while True:
        lead = written_table(_lead(centres, walk_entries), "communities-lead")
        walked = _walk(centres.join(merged(lead), ["chunk", "id"], "left_semi"), members, n_tiles, threshold)
        found.append(written_table(walked, "communities-walked"))
        centres = centres.join(merged(lead), ["chunk", "id"], "left_anti")
        if centres.isEmpty():
            return reduce(DataFrame.unionByName, found)
        members = written_table(members.join(merged(found[-1].select("id")), "id", "left_anti"), "communities-free")
        seen = written_table(_round(centres, members, n_tiles, threshold), "communities-seen")
        best = (
            seen.filter(F.col("remaining") == CLAIM)
            .groupBy("member").agg(F.min(F.struct((-F.col("n0")).alias("by"), "centre"))["centre"].alias("seed"))
        )
        claims = best.groupBy(F.col("seed").alias("id")).agg(F.count(F.lit(1)).alias("claims"))
        left = (
            seen.filter(F.col("remaining") != CLAIM)
            .groupBy(F.col("centre").alias("id")).agg(F.sum("remaining").alias("remaining"))
        )
        state = written_table(
            centres.drop("embedding", "remaining").join(merged(left), "id", "left").join(merged(claims), "id", "left")
            .withColumn("alive", F.coalesce(F.col("remaining") >= F.col("needed"), F.lit(False)))
            .withColumn("ready", F.col("alive") & F.coalesce(F.col("claims") == F.col("remaining"), F.lit(False))),
            "communities-state",
        )
        accepted = written_table(
            best.join(merged(state.filter("ready").select(F.col("id").alias("seed"), "chunk", "n0")), "seed")
            .select("chunk", "seed", "n0", F.col("member").alias("id")),
            "communities-accepted",
        )
        found.append(accepted)
        if len(found) > 8:
            found = [written_table(reduce(DataFrame.unionByName, found), "communities-found")]
        waiting = state.filter(F.col("alive") & ~F.col("ready")).select("id", "remaining")
        centres = written_table(centres.drop("remaining").join(merged(waiting), "id"), "communities-centres")
        # a member without a candidate now never gets one later
        members = written_table(
            members.join(merged(best.select(F.col("member").alias("id"))), "id", "left_semi")
            .join(merged(accepted.select("id")), "id", "left_anti"),
            "communities-members",
        )


def numbered(members: DataFrame) -> DataFrame:
    """Add ``community_id``: 1-based position by size, then original size, then seed, over all chunks."""
    sizes = members.groupBy("chunk", "seed", "n0").agg(F.count(F.lit(1)).alias("size"))
    order = [F.desc("size"), F.desc("n0"), F.col("seed")]
    ids = rank_within(sizes.withColumn("__all", F.lit(0)), ["__all"], order, "community_id")
    return members.join(merged(ids.select("chunk", "seed", "size", "community_id")), ["chunk", "seed"])


def cosine(a: Column, b: Column) -> Column:
    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda acc, v: acc + v)

    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def centroids(members: DataFrame, keys) -> DataFrame:
    """Element mean of the member vectors, combined before the shuffle."""
    vector = array_to_vector(F.col("embedding").cast("array<double>"))
    return members.groupBy(*keys).agg(vector_to_array(Summarizer.mean(vector)).alias("centroid"))


def scored(members: DataFrame, vectors: DataFrame, keys=("chunk", "seed")) -> DataFrame:
    """Add ``score`` (cosine to the centroid, five decimals) and ``rank`` (best first, ties by id)."""
    keys = list(keys)
    full = members.join(merged(vectors.select("id", "embedding")), "id")
    rated = (
        full.join(merged(centroids(full, keys)), keys)
        .withColumn("score", F.round(cosine(F.col("centroid"), F.col("embedding")), 5))
        .drop("centroid", "embedding")
    )
    return rank_within(rated, keys, [F.desc("score"), F.col("id")])


def consensus(members: DataFrame, threshold: float = CONSENSUS) -> DataFrame:
    """``community_id, ratio, label``: communities reviewed enough, and their most common label.

    ``members`` has ``community_id, rank, label, moderated``. Ties go to the label seen first
    in rank order; communities without open rows are left out.
    """
    per_label = members.groupBy("community_id", "label", "moderated").agg(
        F.count(F.lit(1)).alias("n"), F.min("rank").alias("first_rank")
    )
    reviewed = F.when(F.col("moderated"), F.col("n"))
    chosen = F.min(
        F.when(F.col("moderated"), F.struct((-F.col("n")).alias("by"), "first_rank", "label"))
    )
    return (
        per_label.groupBy("community_id")
        .agg(F.sum("n").alias("size"), F.coalesce(F.sum(reviewed), F.lit(0)).alias("reviewed"), chosen.alias("top"))
        .withColumn("ratio", F.col("reviewed") / F.col("size"))
        .filter((F.col("reviewed") < F.col("size")) & (F.col("ratio") >= threshold))
        .select("community_id", "ratio", F.col("top.label").alias("label"))
    )


def propagate(stored: DataFrame, members: DataFrame, threshold: float = CONSENSUS) -> DataFrame:
    """The table with consensus labels and scores on unreviewed members; ``moderated`` stays false.

    ``members`` is ``community_id, comment_id, score, rank``.
    """
    state = members.join(merged(stored.select("comment_id", "label", "moderated")), "comment_id")
    agreed = consensus(state, threshold).select("community_id", F.col("label").alias("__label"))
    updates = (
        stored.filter(~F.col("moderated"))
        .join(merged(members.select("community_id", "comment_id", F.col("score").alias("__score"))), "comment_id")
        .join(merged(agreed), "community_id")
        .withColumns({"label": F.col("__label"), "score": F.col("__score")})
        .select(*stored.columns)
    )
    return update_by_key(stored, merged(updates))

"""Cosine similarity over tiles of vectors.

One task multiplies one tile of centres with one tile of members and emits per-row reductions (counts,
best centre, top k), never the pairs inside a group. Which tiles meet is the caller's choice:

* ``place``: rows are hashed into tiles and every tile meets every other one. Exact, and the work grows
  with the square of the table, or of its chunks if the caller asks for ``chunk_rows``.
* ``place_hashed``: for a high threshold. Random hyperplanes give each row a bucket in each of several
  tables; rows meet where they share a bucket, and a pair counts in the first table that it shares. The
  number of bits follows the size of the table, so buckets stay small and the work grows in proportion;
  the number of tables follows from the recall that is asked for. Similarities are exact, buckets that
  many rows share are dealt in tiles. ``near_*`` collapse equal vectors first.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from commentlens.session import written_table

TILE_ROWS = 16_384
_SLAB = 2_048
# similarities that a task holds at a time, 32 MB
_CELLS = 1 << 22
#: Hashed placement: chance that a pair at the threshold meets, rows that a bucket has on average, rows that meet in a task.
RECALL, BUCKET_ROWS, HASHED_TILE_ROWS = 0.9999, 2_048, 8_192
#: What a pair counts as that is below the threshold or has met in an earlier table.
_FAR = -2.0


def place(vectors: DataFrame, chunk_rows: int | None = None, tile_rows: int = TILE_ROWS) -> tuple[DataFrame, int]:
    """Add ``chunk`` and ``tile`` to ``id, embedding``; also return the tiles per chunk."""
    total = vectors.count()
    n_chunks = max(1, math.ceil(total / chunk_rows)) if chunk_rows else 1
    n_tiles = max(1, math.ceil(math.ceil(total / n_chunks) / tile_rows))
    return (
        vectors.withColumns({
            "chunk": F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 8), 16, 10).cast("bigint") % n_chunks,
            "tile": F.pmod(F.xxhash64(F.lit("tile"), "id"), F.lit(n_tiles)),
        }),
        n_tiles,
    )


@dataclass(frozen=True)
class Hashed:
    """How rows meet: bits of a bucket, tables, and the tiles of ``hot(table, bucket, n_tiles)`` buckets."""

    threshold: float
    bits: int
    tables: int
    hot: DataFrame


def hash_tables(rows: int, threshold: float, recall: float = RECALL, bucket_rows: int = 512) -> tuple[int, int]:
    """Bits and tables with which a pair at the threshold shares a bucket with a chance of ``recall``."""
    bits = min(62, max(0, math.ceil(math.log2(max(rows, 1) / bucket_rows))))
    one = (1 - math.acos(min(1.0, threshold)) / math.pi) ** bits
    return bits, 1 if one >= recall else math.ceil(math.log(1 - recall) / math.log(1 - one))


def _marks(bits: int, tables: int, seed: int):
    kind = np.int32 if bits < 31 else np.int64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = None
        for batch in batches:
            unit = _unit_matrix(pa.chunked_array([batch.column(1)]))
            if planes is None and unit.shape[0]:
                planes = np.random.default_rng(seed).normal(size=(unit.shape[1], bits * tables))
            marks = np.zeros((len(batch), tables), kind)
            for low in range(0, len(batch) if bits else 0, _SLAB):
                side = (unit[low:low + _SLAB] @ planes > 0).reshape(-1, tables, bits)
                marks[low:low + _SLAB] = (side << np.arange(bits)).sum(axis=2)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(marks), pa.list_(pa.from_numpy_dtype(kind)))], names=[*batch.schema.names, "marks"])

    return run


def place_hashed(vectors: DataFrame, threshold: float, recall: float = RECALL, bucket_rows: int = BUCKET_ROWS,
                 tile_rows: int = HASHED_TILE_ROWS, seed: int = 7) -> tuple[DataFrame, Hashed]:
    """Add ``marks`` (a bucket per table), ``chunk`` and ``tile`` to ``id, embedding`` and, if any, ``copies``; also return how rows meet."""
    bits, tables = hash_tables(vectors.count(), threshold, recall, bucket_rows)
    kept = vectors.select("id", "embedding", *(["copies"] if "copies" in vectors.columns else []))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema)
    marked = kept.mapInArrow(_marks(bits, tables, seed), f"{fields}, marks array<{'int' if bits < 31 else 'bigint'}>")
    placed = written_table(marked.withColumns({"chunk": F.lit(0).cast("bigint"), "tile": F.xxhash64(F.lit("tile"), "id")}), "vectors-placed")
    sizes = placed.select(F.posexplode("marks").alias("table", "bucket")).groupBy("table", "bucket").agg(F.count(F.lit(1)).alias("rows"))
    hot = sizes.where(F.col("rows") > tile_rows).select("table", "bucket", F.ceil(F.col("rows") / tile_rows).alias("n_tiles"))
    return placed, Hashed(threshold, bits, tables, written_table(hot, "vectors-hot"))


def _unit_matrix(column: pa.ChunkedArray) -> np.ndarray:
    arrays = column.combine_chunks()
    if len(arrays) == 0:
        return np.zeros((0, 1))
    matrix = arrays.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(arrays), -1)
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms == 0, 1.0, norms)


def _mark_matrix(column: pa.ChunkedArray) -> np.ndarray:
    arrays = column.combine_chunks()
    return arrays.flatten().to_numpy().reshape(len(arrays), -1) if len(arrays) else np.zeros((0, 1), np.int64)


Reduce = Callable[[dict, dict, Iterator[tuple[slice, np.ndarray]]], dict | Iterator[dict]]


def _grid(centres: DataFrame, members: DataFrame, n_tiles: int, extra: list[str]) -> tuple[DataFrame, list[str]]:
    """Both sides once for every tile of the other, and the columns of a group."""
    tiles = F.sequence(F.lit(0).cast("bigint"), F.lit(n_tiles - 1).cast("bigint"))
    left = centres.select("chunk", F.col("tile").alias("row_tile"), F.explode(tiles).alias("col_tile"), F.lit(True).alias("is_centre"), "id", "embedding", *extra)
    right = members.select(
        "chunk", F.explode(tiles).alias("row_tile"), F.col("tile").alias("col_tile"),
        F.lit(False).alias("is_centre"), "id", "embedding", *(F.col(c) if c == "copies" else F.lit(0).cast("bigint").alias(c) for c in extra),
    )
    return left.unionByName(right), ["chunk", "row_tile", "col_tile"]


def _buckets(centres: DataFrame, members: DataFrame, plan: Hashed, extra: list[str]) -> tuple[DataFrame, list[str]]:
    """Both sides once for every table, in hot buckets once for every tile of the other.

    Rows that meet their own kind are sent once where the bucket is one group; ``is_centre`` is null then.
    """
    sides = []
    alone = centres is members
    for side, is_centre in ((centres, True), (members, False)):
        columns = [F.col(c) if is_centre or c == "copies" else F.lit(0).cast("bigint").alias(c) for c in extra]
        rows = side.select("chunk", F.posexplode("marks").alias("table", "bucket"), "tile", "id", "embedding", "marks", *columns)
        rows = rows.join(plan.hot, ["table", "bucket"], "left").withColumn("n_tiles", F.coalesce("n_tiles", F.lit(1)))
        if alone and not is_centre:
            rows = rows.where("n_tiles > 1")
        rows = rows.withColumn("is_centre", F.when((F.col("n_tiles") > 1) | F.lit(not alone), F.lit(is_centre)))
        own, every = F.pmod("tile", F.col("n_tiles")), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_tiles") - 1))
        names = ("row_tile", "col_tile") if is_centre else ("col_tile", "row_tile")
        sides.append(rows.select("*", own.alias(names[0]), every.alias(names[1])).drop("tile", "n_tiles"))
    return sides[0].unionByName(sides[1]), ["chunk", "table", "bucket", "row_tile", "col_tile"]


def _met_first(sims: np.ndarray, part: slice, table: int, threshold: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The similarities of the pairs that reach the threshold and share no bucket of an earlier table."""
    sims[sims < threshold] = _FAR
    if table:
        i, j = np.nonzero(sims > _FAR)
        met = np.zeros(len(i), bool)
        for earlier in range(table):
            met |= a[part][i, earlier] == b[j, earlier]
        sims[i[met], j[met]] = _FAR
    return sims


def tiled(centres: DataFrame, members: DataFrame, plan: int | Hashed, reduce: Reduce, **output: str) -> DataFrame:
    """Run ``reduce`` on every (centre tile, member tile) that meets.

    Both sides have ``id, embedding`` and the columns of their placement; ``plan`` is what it returned. Centres may
    carry a priority ``n0`` and a minimum ``needed``, both sides their ``copies``.
    ``reduce`` gets both sides as column dictionaries and the similarity matrix in slabs of
    centre rows, best priority first. It returns its columns, or yields them part by part.
    ``output`` names the columns; type ``id`` is that of ids.
    """
    hashed = isinstance(plan, Hashed)
    extra = [c for c in ("n0", "needed", "copies") if c in centres.columns]
    both, keys = (_buckets if hashed else _grid)(centres, members, plan, extra)
    id_type = centres.schema["id"].dataType.simpleString()
    types = {name: id_type if kind == "id" else kind for name, kind in output.items()}
    threshold = plan.threshold if hashed else 0.0
    ordered = "n0" in extra

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        side = table["is_centre"]
        rows, columns = table.filter(pc.fill_null(side, True)), table.filter(pc.fill_null(pc.invert(side), True))
        del table
        if ordered:
            order = np.argsort(rows["id"].to_numpy(), kind="stable")
            order = order[np.argsort(-rows["n0"].to_numpy()[order], kind="stable")]
            rows = rows.take(order)
        left_side = {c: rows[c].to_numpy() for c in ["id", "chunk", *extra]}
        right_side = {c: columns[c].to_numpy() for c in ["id", *(["copies"] if "copies" in extra else [])]}
        a, b = _unit_matrix(rows["embedding"]), _unit_matrix(columns["embedding"]).T
        if hashed:
            number = (rows if len(rows) else columns)["table"][0].as_py()
            a_marks, b_marks = _mark_matrix(rows["marks"]), _mark_matrix(columns["marks"])

        def slabs():
            if len(rows) and len(columns):
                size = max(1, min(_SLAB, _CELLS // len(columns)))
                for start in range(0, len(rows), size):
                    part = slice(start, min(start + size, len(rows)))
                    sims = a[part] @ b
                    yield part, _met_first(sims, part, number, threshold, a_marks, b_marks) if hashed else sims

        result = reduce(left_side, right_side, slabs())
        arrow = {"id": rows.schema.field("id").type, "bigint": pa.int64(), "double": pa.float64()}
        for part in [result] if isinstance(result, dict) else result:
            yield pa.RecordBatch.from_pydict({name: pa.array(part[name], type=arrow[kind]) for name, kind in output.items()})

    # a group is two tiles
    return both.groupBy(*keys).applyInArrow(run, ", ".join(f"{name} {kind}" for name, kind in types.items()))


def _nearest(sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and similarities, to nine decimals, of the ``k`` largest of each row; of equal ones the first.

    ``sims`` is used up. Pairs that do not count are left out.
    """
    if not k:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    far = np.negative(sims, out=sims)
    near = far < -_FAR - 0.5
    if np.count_nonzero(near) > far.size // 16:
        # only what may be among the first after rounding is rounded and sorted
        near &= far <= np.partition(far, k - 1, axis=1)[:, k - 1:k] + 2e-9
    i, j = np.nonzero(near)
    value = np.round(far[i, j], 9)
    order = np.lexsort((j, value, i))
    i, j, value = i[order], j[order], value[order]
    first = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[first], j[first], -value[first]


def neighbour_counts(placed: DataFrame, n_tiles: int | Hashed, threshold: float) -> DataFrame:
    """``id, n``: rows of the same chunk with cosine at least ``threshold``, itself included; ``copies`` weigh them, if any."""

    def count(left, right, slabs):
        n = np.zeros(len(left["id"]), dtype=np.int64)
        for part, sims in slabs:
            near = sims >= threshold
            n[part] = near @ right["copies"] if "copies" in right else near.sum(axis=1)
        return {"id": left["id"], "n": n}

    return tiled(placed, placed, n_tiles, count, id="id", n="bigint").groupBy("id").agg(F.sum("n").alias("n"))


def dense_rows(placed: DataFrame, n_tiles: int | Hashed, threshold: float, minimum: int) -> DataFrame:
    """Rows with at least ``minimum`` neighbours."""
    return neighbour_counts(placed, n_tiles, threshold).filter(F.col("n") >= minimum)


def top_k(placed: DataFrame, n_tiles: int | Hashed, k: int) -> DataFrame:
    """``id, neighbour, sim, rank``: the ``k`` most similar rows (itself included), ties by id; hashed, of those at the threshold."""

    def nearest(left, right, slabs):
        order = np.argsort(right["id"], kind="stable")
        for part, sims in slabs:
            i, j, found = _nearest(sims[:, order], min(k, sims.shape[1]))
            yield {"id": left["id"][part][i], "neighbour": right["id"][order][j], "sim": found}

    partial = tiled(placed, placed, n_tiles, nearest, id="id", neighbour="id", sim="double").where(F.col("sim") > _FAR)
    window = Window.partitionBy("id").orderBy(F.desc("sim"), "neighbour")
    return (
        partial.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)
        .withColumn("rank", F.col("rank").cast("bigint"))
    )


def distinct_vectors(vectors: DataFrame) -> DataFrame:
    """One row per distinct vector: smallest ``id`` and ``copies``; copies are merged before the shuffle."""
    return vectors.groupBy("embedding").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))


def similar_pairs(vectors: DataFrame, threshold: float, chunk_rows: int | None = None,
                  tile_rows: int = TILE_ROWS, recall: float | None = None) -> DataFrame:
    """``left_id, right_id, sim, left_copies, right_copies`` with cosine at least ``threshold``.

    Pairs are between distinct vectors, a row with itself included, so a group of identical
    copies gives one pair and its size instead of the square of it. With ``recall`` rows meet by hash tables.
    """
    unique = written_table(distinct_vectors(vectors).where("id is not null"), "vectors-distinct")
    if recall is None:
        placed, plan = place(unique, chunk_rows, tile_rows)
    else:
        placed, plan = place_hashed(unique, threshold, recall)

    def pairs(left, right, slabs):
        for part, sims in slabs:
            i, j = np.nonzero(sims >= threshold)
            yield {"left_id": left["id"][part][i], "right_id": right["id"][j], "sim": sims[i, j],
                   "left_copies": left["copies"][part][i], "right_copies": right["copies"][j]}

    return tiled(placed, placed, plan, pairs, left_id="id", right_id="id", sim="double", left_copies="bigint", right_copies="bigint")


def near_counts(vectors: DataFrame, threshold: float, minimum: int = 1, recall: float = RECALL, bucket_rows: int = BUCKET_ROWS,
                tile_rows: int = HASHED_TILE_ROWS) -> DataFrame:
    """``id, n`` of the rows with at least ``minimum`` neighbours at the threshold, itself included, by hash tables.

    Equal vectors meet others once and count as often as they occur. A vector of zeros has no neighbours.
    """
    unique = written_table(distinct_vectors(vectors), "vectors-distinct")
    placed, plan = place_hashed(unique, threshold, recall, bucket_rows, tile_rows)
    counts = neighbour_counts(placed, plan, threshold).where(F.col("n") >= minimum)
    single = unique.where("copies = 1").select("id")
    repeated = unique.where("copies > 1").select(F.col("id").alias("first"), "embedding")
    # only rows with copies are looked up by their vector
    owners = vectors.join(repeated, "embedding").select("id", "first").unionByName(single.select("id", F.col("id").alias("first")))
    return owners.join(counts.withColumnRenamed("id", "first"), "first").select("id", "n")


def near_top_k(vectors: DataFrame, threshold: float, k: int, recall: float = RECALL, bucket_rows: int = BUCKET_ROWS,
               tile_rows: int = HASHED_TILE_ROWS) -> DataFrame:
    """``id, neighbour, sim, rank`` between distinct vectors (the smallest id of each): the ``k`` nearest at the threshold."""
    placed, plan = place_hashed(distinct_vectors(vectors).select("id", "embedding"), threshold, recall, bucket_rows, tile_rows)
    return top_k(placed, plan, k)

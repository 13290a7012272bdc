"""Near-duplicates by circulant MinHash, banding and exact Jaccard verification.

Two permutations of the 32-bit universe give all coordinates: the first spreads the shingles, the
second is read at a circular shift, so coordinate k of a set S is min over s of p(q(s) + k). The
coordinates are cut into bands; documents that share a band are candidates, and each candidate pair
is confirmed on the full shingle sets. With 48 bands of 6, a pair at similarity 0.8 shares no band
with a probability of 5e-7.

Copies (equal shingle sets) form one class, and classes are compared. A bucket of m classes isn't
expanded into m^2 pairs. Its members are compared with its smallest member, first one pair per
member, then the rest of those pairs; each time, what is already connected is left out. Only members
of one bucket that are still in different components after that are compared all with all, in tiles
whose pairs never become rows. No pair that shares a band is left untested unless its two ends are
known to be connected.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commentlens.llm.graph import components
from commentlens.llm.wordhash import shingle_set, slices
from commentlens.session import written_table

BANDS = 48
ROWS = 6
#: Members of one hub that a task compares.
HUB_MEMBERS = 500
#: Members of one block of a bucket, and columns of the incidence table that are multiplied at once.
TILE, COLUMNS = 512, 2048
_RUN = 1 << 15


def _permuted(x: np.ndarray, out: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit integers; ``out`` is a buffer of the same length."""
    np.right_shift(x, np.uint32(16), out=out)
    x ^= out
    x *= np.uint32(0x85EBCA6B)
    np.right_shift(x, np.uint32(13), out=out)
    x ^= out
    x *= np.uint32(0xC2B2AE35)
    np.right_shift(x, np.uint32(16), out=out)
    x ^= out
    return x


def signatures(sets: list[np.ndarray], size: int) -> np.ndarray:
    """Circulant MinHash of non-empty sets, one row of ``size`` coordinates each."""
    out = np.full((len(sets), size), 0xFFFFFFFF, np.uint32)
    if not sets:
        return out
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    spread = np.concatenate(sets)
    spread = (spread ^ (spread >> np.uint64(32))).astype(np.uint32)
    spread = _permuted(spread ^ np.uint32(0x5BD1E995), np.empty_like(spread))
    for low in range(0, len(spread), _RUN):  # a run stays in the processor's cache
        part, owners = spread[low:low + _RUN], owner[low:low + _RUN]
        firsts = np.flatnonzero(np.concatenate(([True], owners[1:] != owners[:-1])))
        rows = owners[firsts]
        value, spare = np.empty_like(part), np.empty_like(part)
        for k in range(size):
            np.add(part, np.uint32(k * 0x61C88647 & 0xFFFFFFFF), out=value)
            least = np.minimum.reduceat(_permuted(value, spare), firsts)
            out[rows, k] = np.minimum(out[rows, k], least)
    return out


def band_keys(rows: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key per band, different bands having different keys."""
    parts = rows.reshape(len(rows), bands, rows.shape[1] // bands)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), parts.shape[:2]).copy()
    for k in range(parts.shape[2]):
        out = (out ^ parts[:, :, k]) * np.uint64(0x9FB21C651E98DF25)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def _digest(found: np.ndarray) -> bytes | None:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None


def _signed(texts_size: int, bands: int, rows: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("class", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1), lower=True):
                sets = [shingle_set(part.hashes[a:b], texts_size) for a, b in zip(part.first[:-1], part.first[1:], strict=True)]
                full = [i for i, s in enumerate(sets) if len(s)]
                keys = band_keys(signatures([sets[i] for i in full], bands * rows), bands)
                listed: list = [None] * len(sets)
                for i, row in zip(full, keys, strict=True):
                    listed[i] = row
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(part.row, len(part)).cast(pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_digest(s) for s in sets], pa.binary()),
                    pa.array(listed, pa.list_(pa.int64())),
                ], schema=schema)

    return run


def _classed(shingle: int):
    """The class of each row with its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1), lower=True):
                sets = [shingle_set(part.hashes[a:b], shingle) for a, b in zip(part.first[:-1], part.first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(part.row, len(part)).cast(pa.int64()), pa.array([_digest(s) for s in sets], pa.binary()),
                    batch.column(1).slice(part.row, len(part)),
                ], names=["doc_id", "class", "text"])

    return run


def _compare(shingle: int, percent: int):
    """Rows sorted by hub, part and role: the hub's own text comes before those of its members."""

    def sets_of(texts: pd.Series) -> Iterator[np.ndarray]:
        for part in slices(pa.array(texts, pa.large_string()), lower=True):
            for a, b in zip(part.first[:-1], part.first[1:], strict=True):
                yield shingle_set(part.hashes[a:b], shingle)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hub, own = None, np.zeros(0, np.uint64)
        for frame in frames:
            linked = []
            for key, node, found in zip(frame["hub"], frame["node"], sets_of(frame["text"]), strict=True):
                if key == node:
                    hub, own = key, found
                elif key == hub and len(found):
                    small, large = sorted((len(own), len(found)))
                    if 100 * small < percent * large:
                        continue
                    shared = len(np.intersect1d(own, found, assume_unique=True))
                    if 100 * shared >= percent * (small + large - shared):
                        linked.append((node, key))
            yield pd.DataFrame(linked, columns=["a", "b"])

    return run


def _confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Those of ``pairs(node, hub)`` that are linked, as ``a, b``. ``texts``: node, text.

    A hub's members are dealt out over as many parts as they need, and its text goes to each part.
    """
    pairs = written_table(pairs, "circulant-pairs")
    parts = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / HUB_MEMBERS).cast("int").alias("parts"))
    parts = written_table(parts, "circulant-parts")
    members = pairs.join(parts, "hub").select("hub", "node", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"))
    hubs = parts.select("hub", F.col("hub").alias("node"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    wanted = written_table(members.unionByName(hubs), "circulant-wanted")
    rows = wanted.join(texts, "node").withColumn("role", (F.col("hub") != F.col("node")).cast("int"))
    spread = rows.select("hub", "part", "role", "node", "text").repartition("hub", "part").sortWithinPartitions("hub", "part", "role")
    return written_table(spread.select("hub", "node", "text").mapInPandas(_compare(shingle, percent), "a long, b long"), "circulant-links")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, ``n_shingles``, ``component_id``, ``kept``, ``class_size``.

    Documents are linked if 100 * intersection >= ``percent`` * union of their sets of distinct word
    shingles (A-Z lower-cased; fewer words than ``shingle`` make one). A null, empty or blank text
    has an empty set and no links. ``component_id`` is the smallest id reachable over links. A row
    without id can't be reached: its component is null and it is kept. Rows that repeat an id are
    judged and linked by their own texts. Equal sets make one class of ``class_size`` rows. An empty table gives an empty
    result; other columns are ignored.
    """
    plain = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    signed = written_table(
        plain.mapInArrow(_signed(shingle, bands, rows), "doc_id long, n_shingles long, class binary, bands array<long>"),
        "circulant-signed",
    )
    filled = signed.where("class IS NOT NULL")
    # ids of rows with different sets, an empty one too; their classes get numbers of their own as nodes, below all ids
    mark = F.xxhash64("class")
    repeated = signed.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(mark).alias("low"), F.max(mark).alias("high"))
    repeated = written_table(repeated.where("low <> high").select("doc_id"), "circulant-repeated")
    own = filled.groupBy("class").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("class_size"))
    clash = not repeated.isEmpty()
    if clash:
        number = F.lit(-(1 << 62)) - F.shiftrightunsigned(mark, 2)
        own = own.join(repeated.select(F.col("doc_id").alias("least"), F.lit(True).alias("several")), "least", "left")
        own = own.withColumn("node", F.when(F.col("several"), number).otherwise(F.col("least"))).drop("several")
    else:
        own = own.withColumn("node", F.col("least"))
    classes = written_table(own.select("class", "node", "least", "class_size"), "circulant-classes")
    # the representative's own row carries the bands of its class
    heads = filled.where("doc_id IS NOT NULL").join(classes.select("class", "node", F.col("least").alias("doc_id")), ["class", "doc_id"])
    keys = written_table(
        heads.select("node", "n_shingles", F.explode("bands").alias("key")).distinct(), "circulant-keys",
    )
    buckets = written_table(
        keys.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last"))
        .where("hub < last").select("key", "hub"), "circulant-buckets",
    )
    shared = written_table(keys.join(buckets, "key").select("key", "node", "n_shingles", "hub"), "circulant-shared")
    nodes = shared.select("node").distinct()
    texts = plain.select(F.col("doc_id").alias("node"), "text").join(nodes, "node", "left_semi")
    if clash:
        several = plain.join(repeated, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(_classed(shingle), "doc_id long, class binary, text string")
        numbered = classes.where("node <> least").select("class", "node", F.col("least").alias("doc_id"))
        told = several.join(numbered, ["class", "doc_id"]).select("node", "text").join(nodes, "node", "left_semi").dropDuplicates(["node"])
        texts = texts.join(repeated.withColumnRenamed("doc_id", "node"), "node", "left_anti").unionByName(told)
    texts = written_table(texts, "circulant-texts")

    # one pair per member: its smallest hub
    tested = shared.where("node <> hub").groupBy("node").agg(F.min("hub").alias("hub"))
    links = _confirmed(tested, texts, shingle, percent)
    roots = components(links)

    # the other hubs of members that are in another component
    rest = _apart(shared.where("node <> hub").select("node", "hub").distinct(), roots, "node", "hub").join(tested, ["node", "hub"], "left_anti")
    rest = written_table(rest, "circulant-rest")
    if not rest.isEmpty():
        links = links.unionByName(_confirmed(rest, texts, shingle, percent))
        tested = tested.unionByName(rest)
        roots = components(links)

    # what is left: members of one bucket in different components, none of which is its hub's
    rooted = shared.where("node <> hub").join(roots.select("node", "root"), "node", "left")
    rooted = written_table(rooted.select("key", "node", F.coalesce("root", "node").alias("root")), "circulant-rooted")
    mixed = rooted.groupBy("key").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("size"), F.sum(F.xxhash64("node") % (1 << 40)).alias("members"),
        F.bit_xor(F.xxhash64(F.col("node"), F.lit(1))).alias("others"))
    # buckets with the same members are compared once
    mixed = mixed.where("low < high").groupBy("low", "high", "size", "members", "others").agg(F.min("key").alias("key"))
    mixed = written_table(mixed.select("key", F.ceil(F.col("size") / TILE).cast("int").alias("blocks")), "circulant-mixed")
    if not mixed.isEmpty():
        links = links.unionByName(_tiled(rooted.join(mixed, "key").select("key", "node", "blocks"), texts, shingle, percent))
        roots = components(links)

    named = classes.join(roots, "node", "left").select("class", "class_size", "least", F.coalesce("root", "node").alias("component"))
    if clash:
        # the smallest id of a component is not its smallest node
        named = written_table(named.withColumnRenamed("component", "root"), "circulant-rooted-classes")
        named = named.join(named.groupBy("root").agg(F.min("least").alias("component")), "root")
    named = written_table(named.select("class", "class_size", "component"), "circulant-named")
    out = signed.drop("bands").join(named, "class", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component", "doc_id"))
    return out.select(
        F.col("doc_id").alias(id_col), "n_shingles", component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"),
    )


def _joined(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """The smallest position that each set reaches over links, by tiles of a product of incidence columns."""
    sizes = np.array([len(x) for x in sets])
    owners = np.repeat(np.arange(len(sets)), sizes)
    values, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.full(len(values), -1)
    number[count > 1] = np.arange((count > 1).sum())
    column = number[column]
    order = np.argsort(column, kind="stable")
    column, owners = column[order], owners[order]
    shared = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [low, low + COLUMNS])
        part = np.zeros((len(sets), COLUMNS), np.float32)
        part[owners[a:b], column[a:b] - low] = 1
        shared += part @ part.T
    linked = 100 * shared >= percent * (sizes[:, None] + sizes[None, :] - shared)
    np.fill_diagonal(linked, True)
    label = np.arange(len(sets))
    while True:
        lower = np.where(linked, label[None, :], len(sets)).min(axis=1)
        if (lower == label).all():
            return label
        label = lower


def _tile(shingle: int, percent: int):
    """Rows sorted by tile; a tile's members are compared with each other, all at once."""

    def links(nodes: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
        return [(nodes[i], nodes[r]) for i, r in enumerate(_joined(sets, percent)) if nodes[i] != nodes[r]] if len(sets) > 1 else []

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tile, nodes, sets = None, [], []
        for frame in frames:
            out: list = []
            row = 0
            for part in slices(pa.array(frame["text"], pa.large_string()), lower=True):
                for a, b in zip(part.first[:-1], part.first[1:], strict=True):
                    here = (frame["key"].iat[row], frame["low"].iat[row], frame["high"].iat[row])
                    if here != tile:
                        out.extend(links(nodes, sets))
                        tile, nodes, sets = here, [], []
                    nodes.append(frame["node"].iat[row])
                    sets.append(shingle_set(part.hashes[a:b], shingle))
                    row += 1
            yield pd.DataFrame(out, columns=["a", "b"])
        yield pd.DataFrame(links(nodes, sets), columns=["a", "b"])

    return run


def _tiled(members: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links among the members of each bucket. Blocks of about ``TILE`` members meet each other in tiles."""
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    met = members.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = written_table(met.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "node"), "circulant-tiles")
    rows = met.join(texts, "node").select("key", "low", "high", "node", "text")
    spread = rows.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    return written_table(spread.mapInPandas(_tile(shingle, percent), "a long, b long"), "circulant-links")


def _apart(pairs: DataFrame, roots: DataFrame, one: str, other: str) -> DataFrame:
    """The pairs whose ends have different roots; a node without root is its own."""
    left = roots.select(F.col("node").alias(one), F.col("root").alias("r1"))
    right = roots.select(F.col("node").alias(other), F.col("root").alias("r2"))
    return (
        pairs.join(left, one, "left").join(right, other, "left")
        .where(F.coalesce("r1", one) != F.coalesce("r2", other)).select(one, other)
    )

"""Removal of passages that another document has too, by super-k-mer partitioning.

A window is ``words`` consecutive words. Its minimiser is the smallest hash among its ``gram``-word
runs. Consecutive windows with one minimiser form a super-k-mer. A window that two documents have
has one minimiser in both, so a minimiser of a single document rules out all its windows; only
super-k-mers with a minimiser of several documents travel on, each as one packed string, to the
bucket of its minimiser. In the bucket, equal strings meet as one, and its windows are compared as
byte strings, so hashes never decide which windows are equal.

A minimiser that more than ``HOT_DOCS`` documents have may stand in as many contexts. Its windows
travel one by one and are counted by a plain aggregate, which combines before the shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commentlens.llm.wordhash import SPACE, grams, slices
from commentlens.session import written_table

WORDS = 50
GRAM = 16
HOT_DOCS = 4096
#: Stands for a null id, which sorts after all others.
NO_ID = (1 << 63) - 1
_SIGNED = np.int64


def _minimised(hashes: np.ndarray, words: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimiser, first window and number of windows of each super-k-mer of one text."""
    if len(hashes) < words:
        return np.zeros(0, _SIGNED), np.zeros(0, np.int32), np.zeros(0, np.int32)
    runs = grams(hashes, gram)
    span = words - gram + 1
    count = len(hashes) - words + 1
    place = np.lib.stride_tricks.sliding_window_view(runs, span).argmin(axis=1) + np.arange(count)
    starts = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    return runs[place[starts]].view(_SIGNED), starts.astype(np.int32), np.diff(np.append(starts, count)).astype(np.int32)


_PARTED = "id long, sha string, n_words long, minis array<long>, starts array<int>, counts array<int>"


def _parted(words: int, gram: int):
    schema = pa.schema([
        ("id", pa.int64()), ("sha", pa.string()), ("n_words", pa.int64()),
        ("minis", pa.list_(pa.int64())), ("starts", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1)):
                texts = batch.column(1).slice(part.row, len(part))
                parts = [_minimised(part.hashes[a:b], words, gram) for a, b in zip(part.first[:-1], part.first[1:], strict=True)]
                shas = [hashlib.sha256(b" ".join((t.as_py() or "").encode().split())).hexdigest() for t in texts]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(part.row, len(part)), pa.array(shas), pa.array(np.diff(part.first), pa.int64()),
                    *(pa.array([p[k] for p in parts], schema.field(3 + k).type) for k in range(3)),
                ], schema=schema)

    return run


def _cuts(text: str | None, words: int, starts: list, counts: list, minis: list, hots: list) -> Iterator[tuple[int, int, bytes]]:
    """Minimiser (null for a single window of a hot one), start and packed words of each candidate."""
    raw = (text or "").encode().split()
    for start, count, mini, hot in zip(starts, counts, minis, hots, strict=True):
        if hot:
            for k in range(start, start + count):
                yield None, k, b" ".join(raw[k:k + words])
        else:
            yield mini, start, b" ".join(raw[start:start + count + words - 1])


def _digest(packed: bytes) -> bytes:
    return hashlib.blake2b(packed, digest_size=16).digest()


def _packed(words: int, occurrences: bool):
    """Candidates of a text: the packed strings with their range of ids, or where each one occurs."""
    kinds = (
        [("digest", pa.binary()), ("id", pa.int64()), ("sha", pa.string()), ("start", pa.int32())] if occurrences
        else [("mini", pa.int64()), ("packed", pa.binary()), ("low", pa.int64()), ("high", pa.int64())]
    )
    schema = pa.schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, shas = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            seen: dict = {}
            rows: list = []
            size = 0
            for i, identity in enumerate(ids):
                lists = [batch.column(k)[i].as_py() for k in range(3, 7)]
                for mini, start, packed in _cuts(batch.column(2)[i].as_py(), words, *lists):
                    size += 64 if occurrences else len(packed)
                    if occurrences:
                        rows.append((_digest(packed), identity, shas[i], start))
                    else:
                        low, high = seen.get((mini, packed), (identity, identity))
                        seen[(mini, packed)] = min(low, identity), max(high, identity)
                if size > 8 << 20:
                    yield from flush(rows, seen)
                    rows, seen, size = [], {}, 0
            yield from flush(rows, seen)

    def flush(rows: list, seen: dict) -> Iterator[pa.RecordBatch]:
        out = rows or [(mini, packed, low, high) for (mini, packed), (low, high) in seen.items()]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), kinds, strict=True)], schema=schema)

    return run


def _runs_of(group: list[tuple[bytes, int, int]], words: int) -> Iterator[tuple[bytes, int, int, int]]:
    """Of the distinct strings of one minimiser: digest, first and last window, smallest id that has them.

    Only windows with a smaller id than the largest one of the string are listed.
    """
    if len(group) == 1:
        packed, low, high = group[0]
        if low < high:
            yield _digest(packed), 0, packed.count(b" ") + 1 - words, low
        return
    least: dict[bytes, int] = {}
    cut = []
    for packed, low, _ in group:
        edges = [-1, *(np.flatnonzero(np.frombuffer(packed, np.uint8) == 32).tolist()), len(packed)]
        windows = [packed[edges[k] + 1:edges[k + words]] for k in range(len(edges) - words)]
        cut.append(windows)
        for w in windows:
            if least.get(w, NO_ID) >= low:
                least[w] = low
    for (packed, _, high), windows in zip(group, cut, strict=True):
        begin, digest = 0, _digest(packed)
        mins = [least[w] for w in windows]
        for k in range(1, len(mins) + 1):
            if k == len(mins) or mins[k] != mins[begin]:
                if mins[begin] < high:
                    yield digest, begin, k - 1, mins[begin]
                begin = k


def _sorted_bucket(words: int):
    """Rows sorted by mini and packed string; equal strings of different tasks follow each other."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mini, group = None, []
        for frame in frames:
            out: list = []
            for key, packed, low, high in zip(frame["mini"], frame["packed"], frame["low"], frame["high"], strict=True):
                if key != mini:
                    out.extend(_runs_of(group, words))
                    mini, group = key, []
                if group and group[-1][0] == packed:
                    group[-1] = packed, min(low, group[-1][1]), max(high, group[-1][2])
                else:
                    group.append((bytes(packed), low, high))
            yield pd.DataFrame(out, columns=["digest", "first", "last", "least"])
        yield pd.DataFrame(list(_runs_of(group, words)) if group else [], columns=["digest", "first", "last", "least"])

    return run


def _removed(words: int, with_text: bool):
    schema = pa.schema([("id", pa.int64()), ("sha", pa.string()), ("n_removed", pa.int64()), ("kept_sha", pa.string()), ("kept_text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, shas, texts = [], [], []
            for i in range(len(batch)):
                raw = (batch.column(2)[i].as_py() or "").encode().split()
                covered = np.zeros(len(raw) + 1, np.int64)
                np.add.at(covered, np.asarray(batch.column(3)[i].as_py(), int), 1)
                np.add.at(covered, np.asarray(batch.column(4)[i].as_py(), int), -1)
                gone = np.cumsum(covered)[:-1] > 0
                kept = b" ".join(w for w, g in zip(raw, gone.tolist(), strict=True) if not g)
                removed.append(int(gone.sum()))
                shas.append(hashlib.sha256(kept).hexdigest())
                texts.append(kept.decode() if with_text else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(shas, pa.string()), pa.array(texts, pa.string())], schema=schema)

    return run


def drop_repeats(docs: DataFrame, words: int = WORDS, gram: int = GRAM, hot_docs: int = HOT_DOCS, with_text: bool = False,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, ``n_words``, ``n_removed``, ``kept_sha256`` (and ``kept_text``).

    A word goes if a window of ``words`` words that covers it starts in a document with a smaller id
    too. Windows are judged on the input. A null text has no words. A null id is larger than all
    others; rows of equal id, null ones included, never remove words from each other. Texts below
    ``words`` words lose nothing. An empty table gives an empty result; other columns are ignored.
    """
    identity = F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID))
    parted = written_table(
        docs.select(identity.alias("id"), docs[text_col].alias("text")).mapInArrow(_parted(words, gram), _PARTED), "kmers-parted",
    )
    listed = parted.select("id", "sha", F.explode(F.arrays_zip("minis", "starts", "counts")).alias("k")).select(
        "id", "sha", F.col("k.minis").alias("mini"), F.col("k.starts").alias("start"), F.col("k.counts").alias("count"))
    shared = written_table(
        listed.groupBy("mini").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count(F.lit(1)).alias("n"))
        .where("low < high").select("mini", (F.col("n") > hot_docs).alias("hot")), "kmers-shared",
    )
    spans = listed.join(shared, "mini").groupBy("id", "sha").agg(F.collect_set(F.struct("start", "count", "mini", "hot")).alias("k"))
    spans = written_table(
        spans.select("id", "sha", F.col("k.start").alias("starts"), F.col("k.count").alias("counts"), F.col("k.mini").alias("minis"),
                     F.col("k.hot").alias("hots")), "kmers-spans",
    )
    plain = F.trim(F.regexp_replace(F.coalesce(docs[text_col], F.lit("")), SPACE, " "))
    texts = docs.select(identity.alias("id"), plain.alias("text")).withColumn("sha", F.sha2("text", 256))
    texts = written_table(
        texts.join(spans, ["id", "sha"]).select("id", "sha", "text", "starts", "counts", "minis", "hots"), "kmers-texts",
    )

    candidates = texts.mapInArrow(_packed(words, False), "mini long, packed binary, low long, high long")
    runs = (
        candidates.where("mini IS NOT NULL").repartition("mini").sortWithinPartitions("mini", "packed")
        .mapInPandas(_sorted_bucket(words), "digest binary, first int, last int, least long")
    )
    runs = written_table(runs, "kmers-runs")
    if not shared.where("hot").isEmpty():
        windows = candidates.where("mini IS NULL").groupBy("packed").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high")
        single = windows.select("packed", "low").mapInPandas(_window_digests, "digest binary, first int, last int, least long")
        runs = runs.unionByName(written_table(single, "kmers-hot-runs"))
    found = texts.mapInArrow(_packed(words, True), "digest binary, id long, sha string, start int")
    flagged = (
        found.join(runs, "digest").where("id > least").groupBy("id", "sha")
        .agg(F.collect_set(F.struct((F.col("start") + F.col("first")).alias("a"), (F.col("start") + F.col("last") + words).alias("b"))).alias("r"))
        .select("id", "sha", F.col("r.a").alias("begins"), F.col("r.b").alias("stops"))
    )
    changed = texts.select("id", "sha", "text").join(written_table(flagged, "kmers-flagged"), ["id", "sha"]).select("id", "sha", "text", "begins", "stops")
    changed = changed.mapInArrow(_removed(words, with_text), "id long, sha string, n_removed long, kept_sha string, kept_text string")
    changed = changed.dropDuplicates(["id", "sha"])
    out = parted.select("id", "sha", "n_words").join(changed, ["id", "sha"], "left")
    columns = [
        F.when(F.col("id") != NO_ID, F.col("id")).alias(id_col), "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("kept_sha", "sha").alias("kept_sha256"),
    ]
    return out.select(*columns, *(["kept_text"] if with_text else []))


def _window_digests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        yield pd.DataFrame({"digest": [_digest(bytes(p)) for p in frame["packed"]], "first": 0, "last": 0, "least": frame["low"]})

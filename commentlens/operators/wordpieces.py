"""Vocabulary lookups and greedy longest-match subwords.

A vocabulary of up to ``BROADCAST_ROWS`` pieces is broadcast as one map per piece length, and each token
is walked once inside its row, so the work follows the letters of a token and nothing is shuffled. A
larger one is joined with every stretch of the distinct tokens, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commentlens.functions import tokens as token_fn
from commentlens.operators.ranking import rank_within
from commentlens.session import broadcast_if_small, written_table

BROADCAST_ROWS = 500_000

# Fixed value: id of an unknown token.
UNKNOWN_ID = 100

# tokens whose pieces a task remembers
_REMEMBERED = 200_000

# ids are below this
_SIZE = 1 << 40


class Pieces:
    """Starting and continuing pieces by length, the longest first."""

    def __init__(self, rows: list[tuple[str, int]]):
        lengths: tuple[dict[int, dict[str, int]], dict[int, dict[str, int]]] = ({}, {})
        for piece, number in rows:
            inside = piece.startswith("##")
            text = piece[2:] if inside else piece
            known = lengths[inside].setdefault(len(text), {})
            known[text] = max(number, known.get(text, number))
        # a start may also be spelt like a continuation
        for piece, number in rows:
            if piece.startswith("##"):
                lengths[0].setdefault(len(piece), {})[piece] = number
        self.starts, self.inner = (sorted(((n, m) for n, m in side.items() if n), reverse=True) for side in lengths)

    def walk(self, token: str) -> tuple[list[str], list[int]]:
        """The longest piece at every start that is reached; the whole token is unknown if one has none."""
        pieces, ids, at = [], [], 0
        while at < len(token):
            for length, known in self.inner if at else self.starts:
                number = known.get(token[at:at + length]) if at + length <= len(token) else None
                if number is not None:
                    break
            else:
                break
            pieces.append(("##" if at else "") + token[at:at + length])
            ids.append(number)
            at += length
        return (pieces, ids) if pieces and at == len(token) else ([token_fn.UNKNOWN], [UNKNOWN_ID])


def _broadcast_pieces(vocabulary: DataFrame):
    """The vocabulary for the tasks, or None if it has more than ``BROADCAST_ROWS`` pieces."""
    rows = vocabulary.select("piece", "id").limit(BROADCAST_ROWS + 1).collect()
    if len(rows) > BROADCAST_ROWS:
        return None
    return vocabulary.sparkSession.sparkContext.broadcast(Pieces([(r.piece, r.id) for r in rows if r.piece is not None]))


def _split_walk(pieces):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = pieces.value.walk
        for batch in batches:
            found = [walk(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.list_(pa.string())), pa.array([f[1] for f in found], pa.list_(pa.int64()))],
                names=["token", "pieces", "ids"])

    return run


def _encode_walk(pieces, length: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, known = pieces.value.walk, {}
        for batch in batches:
            out = []
            for tokens in batch.column(1):
                ids: list[int] = []
                for token in tokens.as_py() or []:
                    if token not in known:
                        if len(known) >= _REMEMBERED:
                            known.clear()
                        known[token] = walk(token)[1]
                    ids += known[token]
                out.append(ids[:length])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], names=[batch.schema.names[0], "ids"])

    return run


def token_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Occurrences of each token."""
    tokens = df.select(F.explode(token_fn.pretokenise(F.col(text))).alias("token"))
    return tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def numbered_pieces(pieces: DataFrame, first_id: int = 1000) -> DataFrame:
    """``piece, id`` from a column ``piece``: distinct pieces, numbered in their order."""
    distinct = pieces.select("piece").distinct().withColumn("__all", F.lit(0))
    ranked = rank_within(distinct, ["__all"], [F.col("piece")], "id")
    return ranked.select("piece", (F.col("id") + (first_id - 1)).alias("id"))


def lookup_ids(tokens: DataFrame, vocabulary: DataFrame, token: str = "token") -> DataFrame:
    """Add ``id``; NULL for tokens outside the vocabulary."""
    return tokens.join(broadcast_if_small(vocabulary, BROADCAST_ROWS), F.col(token) == F.col("piece"), "left").drop(
        "piece"
    )


def split_tokens(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``token, pieces, ids`` for distinct ``token`` rows.

    At every start the longest vocabulary piece wins; continuations carry ``##``. If some
    reached start has no piece, the whole token is unknown. Of equal pieces the highest id counts.
    """
    pieces = _broadcast_pieces(vocabulary)
    if pieces is None:
        return _split_by_join(tokens, vocabulary)
    return tokens.select("token").mapInArrow(_split_walk(pieces), "token string, pieces array<string>, ids array<bigint>")


def _split_by_join(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The same for a vocabulary of any size; no piece is longer than its longest, so only that many lengths are tried."""
    longest = vocabulary.agg(F.max(F.length(F.regexp_replace("piece", "^##", "")))).first()[0] or 1
    n_chars = F.length("token")
    # one shuffle of the tokens serves both aggregates below; the partition count is fixed because
    # each token grows by its length times the piece lengths
    partitions = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tokens = tokens.select("token").repartition(partitions, "token")
    starts = tokens.select("token", F.explode(F.sequence(F.lit(1), n_chars)).alias("start"))
    room = F.least(n_chars - F.col("start") + 1, F.lit(longest))
    candidates = starts.select(
        "token", "start", F.explode(F.sequence(F.lit(1), room)).alias("size")
    ).withColumn(
        "candidate",
        F.concat(F.when(F.col("start") > 1, "##").otherwise(""), F.expr("substring(token, start, size)")),
    )
    found = candidates.join(
        broadcast_if_small(vocabulary, BROADCAST_ROWS), F.col("candidate") == F.col("piece")
    )
    # size and id in one number, so that the aggregate keeps a fixed-width buffer
    best = found.groupBy("token", "start").agg(F.max(F.col("size") * F.lit(_SIZE) + F.col("id")).alias("best"))
    # a token has as many entries as characters
    spans = best.groupBy("token").agg(
        F.map_from_entries(F.collect_list(F.struct("start", "best"))).alias("spans")
    )
    walk = F.expr(f"""
        aggregate(
            sequence(1, length(token)),
            named_struct('next', 1, 'pieces', cast(array() as array<string>), 'ids', cast(array() as array<bigint>)),
            (acc, i) -> CASE
                WHEN acc.next <> i OR spans[i] IS NULL THEN acc
                ELSE named_struct(
                    'next', i + cast(spans[i] div {_SIZE} as int),
                    'pieces', concat(acc.pieces, array(concat(
                        CASE WHEN i > 1 THEN '##' ELSE '' END, substring(token, i, cast(spans[i] div {_SIZE} as int))))),
                    'ids', concat(acc.ids, array(spans[i] % {_SIZE})))
            END)
    """)
    walked = tokens.join(spans, "token", "left").withColumn("walk", F.when(F.col("spans").isNotNull(), walk))
    complete = F.col("walk.next") == n_chars + 1
    return walked.select(
        "token",
        F.when(complete, F.col("walk.pieces")).otherwise(F.array(F.lit(token_fn.UNKNOWN))).alias("pieces"),
        F.when(complete, F.col("walk.ids")).otherwise(F.array(F.lit(UNKNOWN_ID).cast("bigint"))).alias("ids"),
    )


def encode(df: DataFrame, vocabulary: DataFrame, key: str, text: str = "text", length: int | None = None) -> DataFrame:
    """``key, ids``: the subword ids of each text, or its first ``length`` ones.

    A token gives at least one id, so with a ``length`` only that many tokens are looked up.
    """
    tokens = token_fn.pretokenise(F.col(text))
    head = df.select(key, (tokens if length is None else F.slice(tokens, 1, length)).alias("tokens"))
    pieces = _broadcast_pieces(vocabulary)
    if pieces is not None:
        return head.mapInArrow(_encode_walk(pieces, length), f"{key} {df.schema[key].dataType.simpleString()}, ids array<bigint>")
    # read by the distinct tokens and by the join
    head = written_table(head, "token-heads")
    exploded = head.select(key, F.posexplode_outer("tokens").alias("pos", "token"))
    distinct = exploded.select("token").filter(F.col("token").isNotNull()).distinct()
    parts = F.when(F.col("ids").isNotNull(), F.struct("pos", "ids"))
    # as many rows per key as its text has tokens
    joined = exploded.join(_split_by_join(distinct, vocabulary).select("token", "ids"), "token", "left")
    ids = joined.groupBy(key).agg(F.sort_array(F.collect_list(parts)).alias("parts"))
    ids = ids.select(key, F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))
    return ids if length is None else ids.withColumn("ids", F.slice("ids", 1, length))

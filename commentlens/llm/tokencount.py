"""Token counts of whole texts under a byte-level BPE vocabulary, by rank-synchronous array merging.

Each Arrow task cuts and merges its own rows; nothing is shuffled. The vocabulary is broadcast, and
its size does not depend on the data.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commentlens.llm.bytebpe import SLICE_CHARS, Encoder, load_vocabulary, pieces

LIMIT = 1024
_encoders: dict[str, Encoder] = {}


def encoder_of(path: str, vocabulary) -> Encoder:
    """One encoder per Python worker and vocabulary, so that later tasks find its memo."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(vocabulary)
    return _encoders[path]


def _grouped(texts: Iterator[str], size: int) -> Iterator[tuple[int, list[str]]]:
    """Number of the first text and parts of about ``size`` characters in all, each with its text's number."""
    numbers, parts, held = [], [], 0
    for number, text in enumerate(texts):
        for part in pieces(text, size):
            numbers.append(number)
            parts.append(part)
            held += len(part)
            if held >= size:
                yield numbers, parts
                numbers, parts, held = [], [], 0
    if parts:
        yield numbers, parts


def _counter(path: str, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path, shared.value)
        special = re.compile("|".join(map(re.escape, sorted(shared.value.specials, key=len, reverse=True)))) if shared.value.specials else None
        for batch in batches:
            texts = batch.column(1)
            tokens = np.zeros(len(batch), np.int64)
            owners: list[int] = []

            def parts() -> Iterator[str]:
                for row in range(len(texts)):
                    text = texts[row].as_py() or ""
                    # a special string is one token, and texts on both sides of it are cut on their own
                    plain = special.split(text) if special and special.search(text) else [text]
                    tokens[row] += len(plain) - 1
                    for part in plain:
                        owners.append(row)
                        yield part

            for numbers, group in _grouped(parts(), SLICE_CHARS):
                np.add.at(tokens, np.array(owners)[numbers], encoder.count(group))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(tokens)], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit`` (more than ``limit`` tokens).

    ``path`` is a byte-level BPE ``tokenizer.json``, read by the driver. No begin, end or other special tokens are
    added; special strings inside a text are one token each, as the library's default has it. Nothing is truncated
    or padded. A null text is empty and has no tokens. Ids may be null or repeat; each row is counted on its own.
    Texts of any length are counted in parts of about a million characters, cut where no token can cross. An empty
    table gives an empty result; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load_vocabulary(path))
    plain = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), F.coalesce(F.octet_length(docs[text_col]), F.lit(0)).cast("long").alias("n_bytes"))
    counted = plain.mapInArrow(_counter(path, shared), "doc_id long, n_bytes long, n_tokens long")
    return counted.select(F.col("doc_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

"""Token arrays for the model input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sequence length, and start, end and padding ids.
SEQUENCE_LENGTH = 128
START_ID, END_ID, PAD_ID = 101, 102, 0
UNKNOWN = "[UNK]"


def pretokenise(text: Column) -> Column:
    """Maximal runs of ASCII word characters, and other marks one by one, in order."""
    return F.regexp_extract_all(text, F.lit(r"\w+|[^\s\w]"), 0)


def pad_or_truncate(ids: Column, length: int = SEQUENCE_LENGTH, pad: int = PAD_ID) -> Column:
    kept = F.slice(ids, 1, length)
    return F.concat(kept, F.array_repeat(F.lit(pad).cast("bigint"), length - F.size(kept)))


def with_markers(ids: Column) -> Column:
    return F.concat(F.array(F.lit(START_ID).cast("bigint")), ids, F.array(F.lit(END_ID).cast("bigint")))


def fixed_length(ids: Column, length: int = SEQUENCE_LENGTH) -> Column:
    """Markers around as many ids as fit, then padding; the markers count."""
    return pad_or_truncate(with_markers(F.slice(ids, 1, length - 2)), length)


def attention_mask(ids: Column) -> Column:
    return F.transform(ids, lambda _: F.lit(1).cast("bigint"))

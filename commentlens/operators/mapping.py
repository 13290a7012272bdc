"""A user's function on column batches, run inside Arrow tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

#: Gets the chosen columns of a batch and returns the new columns, as many rows each.
BatchFunction = Callable[[dict[str, pa.Array]], dict[str, pa.Array | list]]


def _as_array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, kind)


def map_batches(df: DataFrame, function: BatchFunction, schema: str, columns: Sequence[str] | None = None, batch_rows: int = 1000) -> DataFrame:
    """``df`` with the columns that ``function`` returns, replaced or added.

    ``schema`` declares them as DDL. ``function`` gets ``columns`` (all by default) of at most ``batch_rows`` rows at a time,
    never an empty batch, and must keep the number and order of rows. Partitions without rows give none.
    """
    spark = df.sparkSession
    declared = spark.createDataFrame([], schema).schema
    kept = [c for c in df.columns if c not in declared.names]
    given = list(columns) if columns is not None else df.columns
    carried = [f"__kept_{c}" for c in kept]
    arrow = to_arrow_schema(declared)
    fields = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept] + [f"`{f.name}` {f.dataType.simpleString()}" for f in declared]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), batch_rows):
                part = batch.slice(low, batch_rows)
                out = function({c: part.column(i) for i, c in enumerate(given)})
                missing = [c for c in declared.names if c not in out]
                if missing:
                    raise ValueError(f"the function returned no {missing}")
                new = [_as_array(out[c], arrow.field(c).type) for c in declared.names]
                if any(len(x) != len(part) for x in new):
                    raise ValueError("the function must return as many rows as it got")
                yield pa.RecordBatch.from_arrays([*(part.column(len(given) + i) for i in range(len(kept))), *new], names=[*kept, *declared.names])

    both = df.select(*(df[c] for c in given), *(df[c].alias(a) for c, a in zip(kept, carried, strict=True)))
    return both.mapInArrow(run, ", ".join(fields))

"""Adding computed columns to a table, one bounded piece of an Arrow batch at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lapforge.llm.words import PIECE_BYTES, pieces


def with_columns(
    df: DataFrame,
    column: str,
    fields: list[T.StructField],
    prepare: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]],
    keep: list[str] | None = None,
    most: int = PIECE_BYTES,
) -> DataFrame:
    """`df` with `fields` computed from the text `column`.

    `prepare` runs once per task and returns the function that gives the new arrays of a
    piece. Columns of `df` with the name of a new one give way to it. `keep` names the
    columns to carry along, by default all.
    """
    names = [f.name for f in fields]
    kept = [c for c in (df.columns if keep is None else keep) if c not in names]
    schema = T.StructType([*(df.schema[c] for c in kept), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = prepare()
        for batch in batches:
            for piece in pieces(batch, column, most):
                arrays = [piece.column(c) for c in kept] + make(piece)
                yield pa.RecordBatch.from_arrays(arrays, names=kept + names)

    picked = df.select(*dict.fromkeys([*kept, column]))
    return picked.mapInArrow(run, schema)


def texts(column: pa.Array) -> list[str]:
    """The texts of a column, null as empty."""
    return [t or "" for t in column.to_pylist()]

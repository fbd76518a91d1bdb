"""Arrow batches through plain Python column lists; nulls and 64-bit integers survive as they are."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def map_columns(df: DataFrame, function: Callable[..., tuple], schema: str) -> DataFrame:
    """``function`` gets each batch's columns as lists and returns the output columns as lists or arrays."""
    kind = StructType.fromDDL(schema)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                out = function(*[c.to_pylist() for c in b.columns])
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, arrow.types)], schema=arrow)

    return df.mapInArrow(run, kind)


def columns(rows: list[tuple], width: int) -> tuple:
    """Rows as ``width`` columns."""
    return tuple(map(list, zip(*rows))) if rows else tuple([] for _ in range(width))

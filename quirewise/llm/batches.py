"""Columns computed from Arrow batches of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from ..functions.streams import pieces
from ..session import bound_batches


def add_columns(df: DataFrame, schema: str, compute: Callable[[pa.RecordBatch], list[pa.Array]], text: str = "text") -> DataFrame:
    """``df`` with the columns of ``schema``, computed from slices of bounded text; same names are replaced."""
    bound_batches(df.sparkSession)
    new = _parse_datatype_string(schema).fields
    kept = df.drop(*(f.name for f in new))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in pieces(batch, text):
                yield pa.RecordBatch.from_arrays([*part.columns, *compute(part)], [*batch.schema.names, *(f.name for f in new)])

    return kept.mapInArrow(batches, StructType([*kept.schema.fields, *(StructField(f.name, f.dataType) for f in new)]))

"""Columns that a Python function of a row makes, added while the rows pass through.

Spark's own Python columns keep each row, with all its other columns, in a queue
until the results of its batch are back; what does not fit in memory goes to a
local file for as long as the task runs.  With some texts in a row that took 44
times the input of disk (0.1 GB).  Here rows go to Python and come back: no row waits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Rows whose Python objects exist at a time; batches leave in this size.
ROWS_AT_ONCE = 250


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches: texts are large, and Spark's batches have 10,000 rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(at, ROWS_AT_ONCE)


def with_python_columns(
    df: DataFrame, rules: dict[str, tuple[T.DataType, Callable, tuple[str, ...]]], drop: tuple[str, ...] = ()
) -> DataFrame:
    """Adds for each rule ``name: (type, function, argument columns)`` a column, then leaves out ``drop``.

    A null first argument gives null.  A function with a struct type returns a tuple of its fields.
    """
    kept = [f for f in df.schema.fields if f.name not in drop]
    schema = T.StructType([*kept, *(T.StructField(name, kind) for name, (kind, _, _) in rules.items())])
    kinds = {name: to_arrow_type(kind) for name, (kind, _, _) in rules.items()}
    fields = {name: kind.names if isinstance(kind, T.StructType) else None for name, (kind, _, _) in rules.items()}
    passed = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = []
            for name, (_, function, given) in rules.items():
                rows = zip(*(batch.column(c).to_pylist() for c in given))
                values = [None if row[0] is None else function(*row) for row in rows]
                if names := fields[name]:
                    values = [None if v is None else dict(zip(names, v)) for v in values]
                found.append(pa.array(values, kinds[name]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in passed), *found], names=[*passed, *rules])

    return df.mapInArrow(run, schema)

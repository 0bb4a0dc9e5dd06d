"""The keyed, ordered fold: state carried over the sorted rows of each key, for results that depend on earlier decisions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Arrow's types of the columns that folds and machines add.
ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "timestamp_ntz": pa.timestamp("us")}


def schema_with(df: DataFrame, added: dict[str, str]) -> str:
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + [f"`{n}` {t}" for n, t in added.items()])


def keyed_fold(df: DataFrame, keys: list[str], order: list[str], step: Callable, added: dict[str, str]) -> DataFrame:
    """Adds the columns `added` (name to type): step(state, row) gives the next state and the added values.

    Rows are dealt by key and sorted; memory is one batch and one state, whatever the size of a key. State is None at a key's
    first row. Rows are dictionaries of the columns with Python's own values: whole numbers stay whole, whatever else is null in
    their batch. The columns that were there pass as they came.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                key = tuple(row[k] for k in keys)
                if key != last:
                    last, state = key, None
                state, new = step(state, row)
                out.append(new)
            extra = [pa.array([x[i] for x in out], ARROW[t]) for i, t in enumerate(added.values())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, *added])

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema_with(df, added))

"""Column names that don't clash with a table's own."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores after it until no column of ``df`` has that name in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_outputs(df: DataFrame, *outputs: T.StructField) -> T.StructType:
    """The schema of ``df`` with ``outputs`` at its end; columns named like one of these in any case go."""
    names = {f.name.lower() for f in outputs}
    return T.StructType([f for f in df.schema.fields if f.name.lower() not in names] + list(outputs))


def map_in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """``df.mapInArrow(run, schema)``, also where names of ``df`` have dots, which Spark would take for fields."""
    names = df.columns
    if not any("." in c for c in names):
        return df.mapInArrow(run, schema)
    plain = [T.StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(schema.fields)]

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(b.rename_columns(names) for b in batches):
            yield batch.rename_columns([f.name for f in plain])

    return df.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(renamed, T.StructType(plain)).toDF(*schema.names)

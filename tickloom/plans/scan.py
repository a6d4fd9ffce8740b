"""Sequential scans over sorted series.

For recurrences that no window frame expresses. Spark hashes rows by key and sorts them within partitions, and a kernel
walks them batch by batch with its state: memory does not grow with the length of a series.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType


class Kernel:
    """State of one series. push() gets columns of consecutive rows and returns the made columns; missing numbers are NaN."""

    def push(self, columns: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        raise NotImplementedError


def _values(array: pa.Array) -> np.ndarray:
    if pa.types.is_floating(array.type) or pa.types.is_integer(array.type):
        return np.asarray(array.cast(pa.float64()).fill_null(np.nan))
    if pa.types.is_boolean(array.type):
        return np.asarray(array.fill_null(False).cast(pa.int8())).astype(bool)
    return np.array(array.to_pylist(), dtype=object)


def _arrow(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    values = np.asarray(values)
    if values.dtype.kind == "f":
        missing = np.isnan(values)
        if pa.types.is_floating(kind):
            return pa.array(values, type=kind, mask=missing)
        return pa.array(np.where(missing, 0, values).astype(np.int64), mask=missing).cast(kind)
    return pa.array(values.tolist() if values.dtype == object else values).cast(kind)


def scan(df: DataFrame, keys: list[str], order: list[str | Column], reads: list[str], makes: str, kernel: Callable[[], Kernel]) -> DataFrame:
    """Add the columns of the schema makes, computed from columns reads by a new kernel for each series.

    keys name the series, order sorts its rows. A row number over the series asks Spark for rows hashed by key and sorted, so
    that there is no further shuffle or sort where windows over the same series stand before.
    """
    made = df.sparkSession.createDataFrame([], makes).schema
    names, kinds = [f.name for f in made], [to_arrow_type(f.dataType) for f in made]
    kept = [c for c in df.columns if c not in names]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in [*df.select(*kept).schema, *made]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keyed = [batch.column(batch.schema.names.index(k)).to_pylist() for k in keys]
            tuples = list(zip(*keyed, strict=True))
            starts = [k for k in range(len(tuples)) if k == 0 or tuples[k] != tuples[k - 1]]
            parts: dict[str, list[pa.Array]] = {n: [] for n in names}
            columns = {c: _values(batch.column(batch.schema.names.index(c))) for c in reads}
            for first, last in zip(starts, [*starts[1:], len(tuples)], strict=True):
                if state is None or tuples[first] != current:
                    current, state = tuples[first], kernel()
                out = state.push({c: v[first:last] for c, v in columns.items()})
                for n, kind in zip(names, kinds, strict=True):
                    parts[n].append(_arrow(out[n], kind))
            rest = [batch.column(batch.schema.names.index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*rest, *(pa.concat_arrays(parts[n]) for n in names)], names=[*kept, *names])

    ordered = df.select(*kept, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).alias("__row"))
    return ordered.mapInArrow(run, ", ".join(fields))


def fold(df: DataFrame, keys: list[str], order: list[str | Column], reads: list[str], makes: str, kernel: Callable[[], Kernel], by: list[str] | None = None) -> DataFrame:
    """One row a series: its keys, and the columns of the schema makes from result() of a kernel that has walked columns reads.

    by are keys that tell the series apart without the others, where a window over them has stood before (all keys by default)."""
    made = df.sparkSession.createDataFrame([], makes).schema
    schema = StructType([*df.select(*keys).schema, *made])
    kinds = [to_arrow_type(f.dataType) for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, done = None, None, []
        for batch in batches:
            keyed = list(zip(*(batch.column(k).to_pylist() for k in range(len(keys))), strict=True))
            starts = [k for k in range(len(keyed)) if k == 0 or keyed[k] != keyed[k - 1]]
            columns = {c: _values(batch.column(len(keys) + k)) for k, c in enumerate(reads)}
            for first, last in zip(starts, [*starts[1:], len(keyed)], strict=True):
                if state is None or keyed[first] != current:
                    if state is not None:
                        done.append((*current, *(state.result()[f.name] for f in made)))
                    current, state = keyed[first], kernel()
                state.push({c: v[first:last] for c, v in columns.items()})
        if state is not None:
            done.append((*current, *(state.result()[f.name] for f in made)))
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], type=kind) for k, kind in enumerate(kinds)], names=schema.names)

    ordered = df.select(*keys, *(F.col(f"`{c}`") for c in reads), F.row_number().over(Window.partitionBy(*(by or keys)).orderBy(*order)).alias("__row"))
    return ordered.mapInArrow(run, schema)

"""Arrow batches in, Arrow batches out: the one way the operators run Python inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows and bytes of text worked on at once inside a batch; they bound the objects alive, not the rows handled.
SLICE_ROWS, SLICE_BYTES = 4096, 4 << 20


def slices(batch: pa.RecordBatch, sized_by: str | None) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch within the bounds; a single longer text is a slice of its own."""
    if sized_by is None or not batch.num_rows:
        bounds = [*range(0, batch.num_rows, SLICE_ROWS), batch.num_rows]
    else:
        sizes = pc.fill_null(pc.binary_length(batch.column(sized_by)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, bounds = np.cumsum(sizes), [0]
        while bounds[-1] < batch.num_rows:
            start = bounds[-1]
            before = ends[start - 1] if start else 0
            bounds.append(int(max(start + 1, min(start + SLICE_ROWS, np.searchsorted(ends, before + SLICE_BYTES, "right")))))
    for start, end in zip(bounds, bounds[1:], strict=False):
        yield batch.slice(start, end - start)


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], schema: StructType, sized_by: str | None = None) -> DataFrame:
    """Run ``make()`` once per task and its result on every slice of rows; it returns one column per field of ``schema``.

    Memory is bounded by one slice. A lost task is simply run again, as nothing is kept outside it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # What earlier tasks of this worker freed goes back first: the next stage may need other tables.
        pa.default_memory_pool().release_unused()
        work, arrow = make(), to_arrow_schema(schema)
        for batch in batches:
            for part in slices(batch, sized_by):
                columns = work(part)
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip((columns[f.name] for f in arrow), arrow, strict=True)],
                    schema=arrow,
                )

    return df.mapInArrow(run, schema)


def fold_batches(df: DataFrame, make: Callable[[], tuple[Callable[[pa.RecordBatch], None], Callable[[], dict]]], schema: StructType, sized_by: str | None = None) -> DataFrame:
    """As ``map_batches``, but ``make()`` also returns what gives the columns of the whole task after its last slice.

    Memory is bounded by one slice and by what the task gathers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.default_memory_pool().release_unused()
        (work, result), arrow = make(), to_arrow_schema(schema)
        for batch in batches:
            for part in slices(batch, sized_by):
                work(part)
        columns = result()
        yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession, size: int = 8 << 20) -> Iterator[None]:
    """Arrow batches of about ``size`` bytes for what runs inside: rows that pack many values are few but large."""
    before = spark.conf.get(_BATCH_BYTES)
    spark.conf.set(_BATCH_BYTES, str(size))
    try:
        yield
    finally:
        spark.conf.set(_BATCH_BYTES, before)


def packed(numbers: np.ndarray) -> bytes:
    """Numbers with their first bytes first, then their second ones and so on: small or slowly rising ones compress well."""
    return numbers.view(np.uint8).reshape(-1, numbers.itemsize).T.tobytes()


def unpacked(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).reshape(-1)


_HELD: dict[tuple, object] = {}


def held(make: Callable, *args):
    """``make(*args)``, kept by this worker process until another is asked for.

    A worker goes on from one stage to the next; the tables of the last one must be gone before the next are built.
    """
    key = make, args
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make(*args)
    return _HELD[key]


def filter_batches(df: DataFrame, make: Callable[[], Callable[[pa.Array], list[bool]]], text: str = "text") -> DataFrame:
    """The rows of ``df`` whose text the result of ``make()`` keeps; all columns pass through."""

    def maker():
        keeps = make()

        def work(batch):
            kept = pa.array(keeps(filled(batch.column(text))), pa.bool_())
            return dict(zip(batch.schema.names, batch.filter(kept).columns, strict=True))

        return work

    return map_batches(df, maker, df.schema, text)


def filled(texts: pa.Array) -> pa.Array:
    """The texts of a batch, null as the empty text."""
    return pc.fill_null(texts, "")


def list_of(offsets: np.ndarray, values: pa.Array) -> pa.Array:
    """One list per row, values[offsets[i]:offsets[i + 1]]."""
    return pa.LargeListArray.from_arrays(pa.array(offsets, type=pa.int64()), values)

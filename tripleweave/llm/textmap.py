"""Narrow text kernels: Arrow batches in, a few columns out, no shuffle.

``with_text_columns`` hands a kernel the UTF-8 bytes of a text column in pieces of bounded size and
puts the kernel's columns beside the columns the caller keeps. ``column_of`` gives a column made from
another one: only that column goes to the worker and back, the other columns stay in the JVM.

Workers live on between tasks. At the end of each task they give back the memory that they have freed,
so what an executor holds doesn't add up the peaks of all workers that it ever started.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tripleweave.llm.shipping import ship

#: Bytes of text that a kernel sees at once; a longer text comes alone.
PIECE_BYTES = 1 << 20


def unused(taken: Sequence[str], name: str) -> str:
    """``name``, with underscores before it as long as a column has that name (in any case)."""
    lower = {x.lower() for x in taken}
    while name.lower() in lower:
        name = f"_{name}"
    return name


def pieces(batch: pa.RecordBatch, column: int, size: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Slices of a batch whose texts together have at most ``size`` bytes (or that have one row)."""
    if batch.num_rows == 0:
        return
    texts = batch.column(column).cast(pa.large_binary())
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    first, held = 0, 0
    for i, n in enumerate([*lengths, size + 1]):
        if i > first and held + n > size:
            yield batch.slice(first, i - first), texts.slice(first, i - first).to_pylist()
            first, held = i, 0
        held += n


def with_text_columns(
    df: DataFrame,
    text: str,
    keep: Sequence[str],
    fields: Sequence[T.StructField],
    kernel: Callable[[list[bytes | None]], list],
) -> DataFrame:
    """``keep`` columns and the kernel's ``fields``, one row for each row of ``df``.

    kernel: from the texts (None for null) to one sequence of values for each field. The fields' names
    must not clash with those kept; ``unused`` finds free ones.
    """
    keep, fields = list(keep), list(fields)
    source = df.select(df[text].cast("string").alias("__text"), *[df[c].alias(f"__k{i}") for i, c in enumerate(keep)])
    out = T.StructType([T.StructField(c, df.schema[c].dataType, True) for c in keep] + fields)
    kinds = [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces(batch, 0):
                made = [x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, k) for x, k in zip(kernel(texts), kinds)]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *made], names=out.names)

    return arrow_map(source, run, out)


@lru_cache(maxsize=1)
def _allocator() -> Callable[[int], int] | None:
    """The C library's call that gives freed memory back, if it has one; from then on Arrow allocates there too."""
    pa.set_memory_pool(pa.system_memory_pool())
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def thrifty(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, whose worker gives freed memory back when it ends."""

    def outer(batches: Iterator) -> Iterator:
        trim = _allocator()
        try:
            yield from run(batches)
        finally:
            if trim:
                trim(0)

    return outer


def arrow_map(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """mapInArrow, with this package known to the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(thrifty(run), schema)


def column_of(df: DataFrame, column: Column, kind: T.DataType, made: Callable[[pa.Array], pa.Array]) -> Column:
    """A column of ``df``: what ``made`` gives for each batch of the values of ``column``."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for values in batches:
            yield made(values)

    outer = thrifty(run)

    def of_values(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from outer(batches)

    of_values.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(of_values, kind)(column)


def text_column(df: DataFrame, text: str, kind: T.DataType, kernel: Callable[[list[bytes | None]], Sequence]) -> Column:
    """A column of ``df`` from the texts' UTF-8 bytes, which the kernel gets in pieces of bounded size."""
    of = to_arrow_type(kind)

    def made(values: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([values], names=["text"])
        parts = [x if isinstance(x, pa.Array) else pa.array(x, of) for x in (kernel(texts) for _, texts in pieces(batch, 0))]
        return pa.concat_arrays(parts) if parts else pa.array([], of)

    return column_of(df, df[text].cast("string"), kind, made)

"""Text helpers of the operators that run in Python tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def held_out(key: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5, is 0. A null id counts as held out: nothing is learned from it."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5, F.lit(0)) == 0


def by_weight(batches: Iterator[pa.RecordBatch], column: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the strings of ``column`` in one have about ``most`` characters at most; a longer
    single row is a batch of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.utf8_length(batch.column(column)), 0), dtype=np.int64)
        start, total = 0, 0
        for i, n in enumerate(sizes):
            if total and total + n > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        yield batch.slice(start)


def map_rows(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """``rows.mapInArrow(run, schema)`` for columns of any name: it does not find names with dots itself."""
    names = rows.columns
    plain = T.StructType([T.StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(schema.fields)])

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(b.rename_columns(names) for b in batches):
            yield out.rename_columns(plain.names)

    return rows.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(named, plain).toDF(*schema.names)

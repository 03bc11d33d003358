"""Helpers shared by the training-data operators: Arrow batches in bounded slices."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text a worker handles at once; one longer text is a slice of its own.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs of at most ``limit`` bytes of ``column``, one row at least."""
    begin, held = 0, 0
    for at, size in enumerate(pa.compute.binary_length(batch.column(column)).to_pylist()):
        if held and held + (size or 0) > limit:
            yield batch.slice(begin, at - begin)
            begin, held = at, 0
        held += size or 0
    if begin < batch.num_rows:
        yield batch.slice(begin)


def raw_texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The UTF-8 bytes of each text; null is empty."""
    return [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]


def map_slices(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, text: str = "text") -> DataFrame:
    """``work`` over every slice of ``df``'s Arrow batches. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                out = work(part)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)

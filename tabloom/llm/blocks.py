"""Arrow batches in blocks of bounded text size, for the operators that work on whole texts in numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 4 << 20  # a block ends once its texts reach this size; one longer text is a block of its own


def cut(batch: pa.RecordBatch, column: str = "text", max_bytes: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` of about ``max_bytes`` of text each; every row is in one slice."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    block = np.cumsum(sizes) // max_bytes
    edges = np.flatnonzero(np.diff(block)) + 1
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(sizes)]):
        if b > a:
            yield batch.slice(a, b - a)


def map_blocks(df: DataFrame, fn: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema, column: str = "text") -> DataFrame:
    """``fn()`` makes one function per task; it turns each block into rows of ``schema``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = fn()
        for batch in batches:
            for part in cut(batch, column):
                out = work(part)
                if out is not None:
                    yield out

    return df.mapInArrow(run, schema)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of every text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def as_texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one if ``df`` has such a column already."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keep_rows(df: DataFrame, fn: Callable[[], Callable[[pa.RecordBatch], np.ndarray]], column: str = "text") -> DataFrame:
    """Rows of ``df`` with all their columns; ``fn()`` makes one function per task that marks the rows of a block to keep."""

    def make():
        marks = fn()
        return lambda block: block.filter(pa.array(marks(block), pa.bool_()))

    return map_blocks(df, make, df.schema, column)


def read_documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts_of(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns with the text last, so that the scan reads nothing else."""
    return docs.select(*[F.col(c) for c in columns], F.col("text"))

"""Helpers shared by the corpus operators: tables, durable cuts of lineage, Arrow kernels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..durable import cut

__all__ = ["ASCII_SPACE", "cut", "fold", "slices", "table", "text_buffer"]

#: ASCII white space, the separators of words in the contracts: space and \t \n \v \f \r.
ASCII_SPACE = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one of the Parquet tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(seed: int, column, modulus: int):
    """``crc32(id as text) mod modulus == seed``: the contracts' hold-out rule."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus)) == seed


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its n+1 offsets, nulls counted as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 16 << 20):
    """Cut a batch so that one piece holds at most ``most_bytes`` of text (or a single row)."""
    _, offsets = text_buffer(batch.column(column))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most_bytes, "right")) - 1)
        end = min(end, batch.num_rows)
        yield batch.slice(start, end - start)
        start = end

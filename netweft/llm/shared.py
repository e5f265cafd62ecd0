"""What the operators of this subpackage share: lineage cuts, Arrow kernels and id hashing."""

from __future__ import annotations

import ctypes
import gc
import sys
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from ..session import remove, shared_folder, stored

#: Words of every contract: runs of characters other than these six.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows and bytes that a kernel gives back at a time.
OUT_ROWS, OUT_BYTES = 2000, 4 << 20


def cut(df: DataFrame, label: str) -> DataFrame:
    """The same rows, written to the shared folder and read again: lost executors cost no recomputation."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    stored.append(path)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``cut`` stored and that nothing reads any more, and let finished shuffles go with them."""
    for t in tables:
        remove(t.sparkSession, t.stored_at)
    release(tables[0].sparkSession)


def release(spark: SparkSession) -> None:
    """Let the driver notice that it no longer refers to finished shuffles, whose files executors then remove."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def arrow_kernel(df: DataFrame, schema: str | StructType, rows: Callable[[pa.RecordBatch], Iterator[dict]]) -> DataFrame:
    """mapInArrow whose kernel gives column dicts for parts of a batch."""
    target = arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in rows(batch):
                yield pa.RecordBatch.from_arrays([pa.array(part[f.name], f.type) if not isinstance(part[f.name], pa.Array) else part[f.name].cast(f.type) for f in target], schema=target)

    return df.mapInArrow(giving_back(run), schema)


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same kernel; when its task ends, freed memory is returned."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return whole


def give_back() -> None:
    """Return what a kernel has freed to the system: a worker serves task after task, of other kernels too."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        with suppress(OSError, AttributeError):  # a C library without it keeps what it has
            ctypes.CDLL(None).malloc_trim(0)


def arrow_schema(spark: SparkSession, schema: str | StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(parsed(schema))


def parsed(schema: str | StructType) -> StructType:
    return _parse_datatype_string(schema) if isinstance(schema, str) else schema


def slices(batch: pa.RecordBatch, column: str, size: int = OUT_BYTES, most: int = OUT_ROWS) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``size`` bytes in ``column`` and ``most`` rows; at least one row each."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = held = 0
    for k, n in enumerate(lengths):
        if k > start and (held + n > size or k - start >= most):
            yield batch.slice(start, k - start)
            start, held = k, 0
        held += n
    if start < len(lengths):
        yield batch.slice(start)

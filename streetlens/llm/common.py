"""What several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from streetlens.sources.session import settled

#: Characters of text that an Arrow-side loop turns into Python objects at a time.
SLICE_CHARS = 4_000_000
#: Bytes of a batch that goes to a Python worker: Spark's own default of 64 MB, in a few
#: copies on either side, is much of an executor's memory.
BATCH_BYTES = 8 << 20
#: Arrow's types of the columns that operators return.
ARROW = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}
#: ASCII white space; what contracts call a word is a run of anything else.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage by a reliable checkpoint in the folder that the session names."""
    return settled(df)


def small_batches(spark: SparkSession) -> None:
    """Bound the batches of the session by BATCH_BYTES, unless they are smaller yet."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).lower().removesuffix("b")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def id_crc(col: str | Column) -> Column:
    """Unsigned crc32 of an id written as text; of the empty text for null."""
    return F.crc32(F.coalesce(F.col(col).cast("string") if isinstance(col, str) else col.cast("string"), F.lit("")))


def slices(batches: Iterator[pa.RecordBatch], text_field: int = 1) -> Iterator[pa.RecordBatch]:
    """Cut record batches into runs of rows with about SLICE_CHARS bytes of text at most,
    so that very long texts do not pile up as Python objects."""
    for batch in batches:
        if not batch.num_rows:
            continue
        bytes_before = 0
        start = 0
        lengths = pc.fill_null(pc.binary_length(batch.column(text_field)), 0).to_pylist()
        for i, n in enumerate(lengths):
            if i > start and bytes_before + n > SLICE_CHARS:
                yield batch.slice(start, i - start)
                start, bytes_before = i, 0
            bytes_before += n
        yield batch.slice(start)


def given_back() -> None:
    """Let the system have what Arrow and the C library hold free. A Python worker outlives
    its task, and what a stage has freed would count beside what the next one takes."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)):
        trim(0)


def map_slices(df: DataFrame, per_slice: Callable[[], Callable[[pa.RecordBatch], dict]], schema: str, text_field: int = 1) -> DataFrame:
    """mapInArrow over slices. per_slice is called once per task and returns the
    function that turns a slice into a dict of columns in the order of schema."""
    small_batches(df.sparkSession)
    arrow = pa.schema([pa.field(f.name, ARROW[f.dataType.simpleString()]) for f in StructType.fromDDL(schema)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = per_slice()
        for part in slices(batches, text_field):
            out = fn(part)
            yield pa.RecordBatch.from_arrays([_column(out[f.name], f.type) for f in arrow], schema=arrow)
        fn = part = out = None
        given_back()

    return df.mapInArrow(run, schema)


def _column(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, kind)

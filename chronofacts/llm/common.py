"""What the operators of this subpackage share: ASCII word splitting, Arrow row maps and stage storage."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_KEEP = b"0123456789abcdefghijklmnopqrstuvwxyz"
#: Lower-cases A-Z and turns every other ASCII byte that is not a letter or digit into a space; bytes from 0x80 stay.
WORD_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or c in _KEEP else 32 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    """UTF-8 words of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z; null has none."""
    return text.translate(WORD_TABLE).split() if text else []


def utf8(batch: pa.RecordBatch, at: int) -> list[bytes | None]:
    """A string column as UTF-8 bytes, without decoding."""
    column = batch.column(at)
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()).to_pylist()


def parquet(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back, so that lost executors recompute nothing above it.

    The folder is the cluster's ``spark.checkpoint.dir``. Only a local master (tests) may go without; then a temporary one is made.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint()


def fresh_name(df: DataFrame, base: str) -> str:
    """``base``, or ``base`` with underscores so that no column of ``df`` has that name in any case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = "_" + base
    return base


#: Bytes of a column that are Python objects at once.
SLICE_BYTES = 4 << 20


def slices(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """Stretches of rows of a batch whose column ``at`` (strings or binary) holds about ``SLICE_BYTES``; a larger value stands alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < batch.num_rows:
        behind = int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + SLICE_BYTES, "right"))
        yield batch.slice(begin, max(1, behind - begin))
        begin = max(begin + 1, behind)


def give_back() -> None:
    """Return freed memory to the system, so that a worker that is used again does not keep what its last task needed."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def add_column(df: DataFrame, name: str, kind: T.DataType, source: str, make: Callable[[], Callable[[list], list]]) -> DataFrame:
    """``df`` with one more column: ``make()``, called once in each task, returns what turns a batch of ``source`` (UTF-8 bytes) into values."""
    schema = T.StructType([*df.schema.fields, T.StructField(name, kind)])
    at = df.columns.index(source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        f, arrow = make(), to_arrow_type(kind)
        for batch in batches:
            for part in slices(batch, at):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(f(utf8(part, at)), arrow)], names=[*batch.schema.names, name])
        del f
        give_back()

    return df.mapInArrow(run, schema)

"""What the operators of this subpackage share: shared-folder tables, hashing, words."""

from __future__ import annotations

import atexit
import ctypes
import ctypes.util
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Word separators: the ASCII white space that ``bytes.split()`` also splits on.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data folder, through Spark's own reader (any file system)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where it is unset and the session is local (tests), a fresh temporary folder is set; on a cluster
    without the setting the call fails, since a machine-local folder would lose data there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    held = getattr(shared_dir, "own", None)
    if held is None:
        master = spark.sparkContext.master
        if not master.startswith("local[") and master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        held = shared_dir.own = tempfile.mkdtemp(prefix="shared-")
    return held


_written: list[str] = []


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a folder made by ``materialise`` or ``new_path``."""
    at = _path(spark, path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    if path in _written:
        _written.remove(path)


def _drop_all() -> None:
    spark = SparkSession.getActiveSession()
    for path in list(_written):
        try:
            drop_path(spark, path)
        except Exception:  # the JVM may be gone at exit; the folder's owner cleans up then
            return


atexit.register(_drop_all)


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet; deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes ``df`` as a table in the shared folder and reads it back.

    Executors that get lost later lose nothing of it. The table's path is in ``.shared_path``.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


_slot: list = []


def worker_cache(key: object, make: Callable[[], object]):
    """What ``make`` gives, kept in this worker until another key is asked for.

    Workers outlive stages; one slot for all operators keeps an earlier stage's tables out of a later
    one's memory.
    """
    if not _slot or _slot[0] != key:
        _slot.clear()
        gc.collect()
        libc = ctypes.CDLL(ctypes.util.find_library("c"))
        if hasattr(libc, "malloc_trim"):
            libc.malloc_trim(0)  # hand freed memory back
        _slot.extend([key, make()])
    return _slot[1]


def row_of(columns: list[str]) -> Column:
    """Columns that an operator carries along, in a struct ``row``: their names meet none of its own."""
    return F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`").alias(f"f{k}") for k, c in enumerate(columns)]).alias("row")


def fields_of(columns: list[str]) -> list[Column]:
    """The columns that ``row_of`` put away."""
    return [F.col(f"row.f{k}").alias(c) for k, c in enumerate(columns)]


def row_schema(df: DataFrame, more: str) -> StructType:
    """``row`` as it is in ``df``, and the columns of the DDL ``more``."""
    return StructType([df.schema["row"], *StructType.fromDDL(more).fields])


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType) -> DataFrame:
    """``df`` with every Arrow batch replaced by ``fn`` of it (None: no rows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def by_size(batch: pa.RecordBatch, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` bytes, judged by its last column (a text or binary)."""
    if not batch.num_rows:
        return
    column = batch.column(batch.num_columns - 1)
    ends = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + batch.num_rows + 1]
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + most, "right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


#: Bytes of a table that is sent whole to every executor at most.
SENT = 16 << 20


def sized(df: DataFrame, most: int = SENT) -> DataFrame:
    """``df`` marked for a broadcast if its rows, summed first, hold at most ``most`` bytes; else as it is.

    The sum reads ``df``: it should be a written table.
    """
    width = F.lit(16 * len(df.columns))
    for f in df.schema.fields:
        if f.dataType.typeName() in ("string", "binary", "array"):
            width = width + F.coalesce(F.octet_length(F.col(f"`{f.name}`").cast("string")), F.lit(0))
    held = df.agg(F.coalesce(F.sum(width.cast("long")), F.lit(0))).first()[0]
    return F.broadcast(df) if held <= most else df

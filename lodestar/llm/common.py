"""What the operators share: tables, cut lineage, size checks for broadcasts."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes of a broadcast side; above either the operators join by shuffle instead.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 24 << 20
#: Bytes of an Arrow batch, and what Spark gives where no size is set.  A batch's largest buffer fits in 4 MB, which
#: Arrow's pool has; larger ones come from the C library, whose heaps keep the more, the larger what was freed once.
BATCH_BYTES = (4 << 20) - (256 << 10)
DEFAULT_BYTES = "67108864b"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def lean(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of at most BATCH_BYTES, unless the session sets less: executors and their Python workers then
    hold some megabytes of text at a time, however long the documents are.  The session gets its setting back."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    if before == DEFAULT_BYTES:
        spark.conf.set(name, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def trim() -> None:
    """Hand freed memory of this Python worker back to the system; workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library
        pass


def tidy(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of plans that have been cut: it does so when the driver forgets the plans.

    Executors collect too, as their heaps shrink and buffers beside these are freed only then; what one step took
    would else count in all later ones.  There is a task for each core, so that idle executors all get some.
    """
    gc.collect()
    spark._jvm.System.gc()
    if not spark.sparkContext.master.startswith("local["):
        cores = spark.sparkContext.defaultParallelism
        spark.range(0, cores, 1, cores).select(F.expr("reflect('java.lang.System', 'gc')")).collect()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; in local mode, where none is named, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="lodestar-")
    atexit.register(shutil.rmtree, folder, True)
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


_active = threading.local()


def _folders(spark: SparkSession) -> list[str]:
    """The base folder and those of the scratches that are open in this thread, the innermost last."""
    return [f"{checkpoint_dir(spark).rstrip('/')}/lodestar", *getattr(_active, "folders", ())]


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are cut within are removed at the end, but those of ``keep``."""
    before = tuple(getattr(_active, "folders", ()))
    folder = f"{_folders(spark)[0]}/{uuid.uuid4().hex}"
    _active.folders = (*before, folder)
    try:
        yield
    finally:
        _active.folders = before
        remove(spark, folder)
        if not before:
            tidy(spark)


def _written(df: DataFrame, folder: str) -> DataFrame:
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """The same rows read from a Parquet table in the shared folder: lineage ends there and survives lost executors."""
    return _written(df, _folders(df.sparkSession)[-1])


def keep(df: DataFrame) -> DataFrame:
    """As cut, but the table outlives the scratch it is made in: what an operator returns."""
    folders = _folders(df.sparkSession)
    return _written(df, folders[max(0, len(folders) - 2)])


def _width(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        inner = 8 * len(kind.elementType.fields) if isinstance(kind.elementType, T.StructType) else 16
        return F.greatest(F.size(c), F.lit(0)) * inner + 16
    if isinstance(kind, T.StructType):
        return F.lit(16 * len(kind.fields))
    return F.lit(8)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether a side has at most so many rows and bytes; stops reading beyond the rows."""
    width = F.lit(16).cast("long")
    for f in df.schema.fields:
        width = width + _width(F.col(f"`{f.name}`"), f.dataType)
    n, total = df.select(width.alias("width")).limit(rows + 1).agg(F.count("*"), F.sum("width")).head()
    return n <= rows and (total or 0) <= size


def beside(df: DataFrame) -> DataFrame:
    """The smaller side of a join: broadcast where its size allows."""
    return F.broadcast(df) if small(df) else df


def semi(big: DataFrame, keys: DataFrame, on: str | list[str], keep: bool = True) -> DataFrame:
    """Rows of big whose key is (or isn't) among keys; keys is broadcast if it is small, else both are shuffled."""
    return big.join(beside(keys), on, "left_semi" if keep else "left_anti")

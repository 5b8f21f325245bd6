"""Shared helpers: table access, tables in the shared folder, lean Python workers, and the white-space word rule."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import shared_dir, ship

#: A word is a run of anything but space, tab, LF, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of one Arrow batch that goes to a Python worker (a longer row is alone).
BATCH_BYTES = 8 << 20


def prepare(spark: SparkSession) -> None:
    """Send the package to the executors, and (once a session) bound the batches Python workers get in bytes as well as rows."""
    ship(spark)
    sc = spark.sparkContext
    if not getattr(sc, "_millrace_batches", False):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        sc._millrace_batches = True


def release() -> None:
    """Give memory that is free back to the system (a no-op where the C library cannot)."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def _large_blocks_go_back() -> None:
    """Have the C library map blocks of 1 MiB or more on their own, so that freeing one returns it at once."""
    try:
        ctypes.CDLL(None).mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
    except (AttributeError, OSError):
        pass


def lean(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``function`` of Arrow batches for a worker that lives on after its task: what the task used is given back.

    Arrow's own allocator keeps the most it ever held, so batches come from the system's instead.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        _large_blocks_go_back()
        try:
            yield from function(batches)
        finally:
            release()

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/millrace/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**{"compression": "zstd"} | options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._millrace_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by written() that no later plan reads."""
    for df in tables:
        path = getattr(df, "_millrace_path", None)
        if path:
            spark = df.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def own_names(df: DataFrame, *names: str) -> list[str]:
    """For each name, one that no column of ``df`` has (Spark's names ignore case): extra columns may be called anything."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_of(df: DataFrame, col: str = "text") -> Column:
    """The text column with null as empty."""
    return F.coalesce(df[f"`{col}`"], F.lit(""))


def n_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def default_parallelism(spark: SparkSession) -> int:
    return spark.sparkContext.defaultParallelism

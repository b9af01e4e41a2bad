"""Intermediate tables in the folder that the driver and all executors share, numbering of rows, memory of Python workers."""

from __future__ import annotations

import atexit
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_ROOTS: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """A folder of this application under spark.checkpoint.dir; a temporary one only on a local master where that is unset."""
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
        if not base and spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = base or "file://" + tempfile.mkdtemp(prefix="lectern-")
        _ROOTS[app] = f"{base.rstrip('/')}/lectern-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _ROOTS[app])
    return _ROOTS[app]


def _remove(spark: SparkSession, root: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session has ended before: the folder stays for the cluster's own cleaning
        pass


def materialize(df: DataFrame, name: str, blobs: bool = False) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends here and survives lost executors.

    blobs: rows are megabytes each. A reader takes the rows of one row group at a time, so groups are kept small.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    writer = df.write.option("compression", "zstd")
    if blobs:
        writer = writer.option("parquet.block.size", 16 << 20)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def frees_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a write in here go when it ends, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    now = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, now)


def numbered(df: DataFrame, order: list) -> DataFrame:
    """df with n = 0, 1, ... in the given order, without gathering rows in one task.

    A range sort is written once, so that every reader sees the same places; these and the partitions' offsets add up.
    """
    sorted_ = df.orderBy(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    rows = materialize(sorted_, "numbered")
    # the upper bits of _at are the partition's number, the lower 33 the place in it; there is one row per partition
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = sizes.withColumn("_before", F.sum("_rows").over(Window.orderBy("_part")) - F.col("_rows")).select("_part", "_before")
    return rows.join(F.broadcast(before), "_part").withColumn("n", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_at", "_before")


def bound_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Arrow batches of a few megabytes in this session: Python workers keep the memory that their largest batch took."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key)
    if spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(now) > most:
        spark.conf.set(key, f"{most}b")


def give_back() -> None:
    """Memory that was freed in this process goes back to the system, where its C library can do that."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run):
    """A function over batches after each of which, and at its end, the worker gives back what it has freed: Python workers
    live on from task to task, and several of them share an executor with its JVM."""

    @functools.wraps(run)
    def wrapped(batches):
        def each():
            for batch in batches:
                yield batch
                del batch
                give_back()

        try:
            yield from run(each())
        finally:
            give_back()

    return wrapped

"""Shared helpers: reading tables, and stages written to the folder that driver and executors share."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python task works on at once.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where that is unset, a temporary one of the application on one machine
    (tests); on a cluster an error, for its executors share no local folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[.*\])?$", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        found = _own.setdefault(app, "") or f"file://{tempfile.mkdtemp(prefix='spark-')}"
        _own[app] = found
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: ``df`` as a written table in the shared folder, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    del df
    release(spark)
    return out


def apart(df: DataFrame, *keys: str) -> DataFrame:
    """The same rows with long keys that Spark no longer takes for partitioned. A join of an aggregate with the rows it
    came from then shuffles both sides for itself, and Spark may split a partition that one key swells."""
    return df.withColumns({k: F.col(k) + F.lit(0).cast("long") for k in keys})


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of finished stages, which it does once the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(df: DataFrame) -> None:
    """Deletes the files of a staged table that nothing will read again."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def light(run):
    """A task's function that gives freed memory back to the system at its end; executors keep their Python workers."""

    def task(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return task


def slices(texts, most: int = SLICE_BYTES, rows: int = 1 << 16):
    """(first, last) of runs of texts of about ``most`` characters; a longer text stands alone."""
    first = size = 0
    for i, t in enumerate(texts):
        n = len(t)
        if i > first and (size + n > most or i - first >= rows):
            yield first, i
            first, size = i, 0
        size += n
    if first < len(texts):
        yield first, len(texts)

"""What all operators share: durable intermediate tables and input checks."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names; one of our own only where it is unset."""
    sc = spark.sparkContext
    folder = sc.getCheckpointDir()
    if folder is None:
        folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="ckpt-"))
        folder = sc.getCheckpointDir()
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """Compute once, into the shared folder: lineage ends there and lost executors lose nothing."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """As checkpoint(), but as a compressed Parquet table, for tables that are large."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of stored() that nothing reads any more."""
    for table in tables:
        jvm = table.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(table.stored_path)
        path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def let_go(spark: SparkSession) -> None:
    """Collect the driver's garbage, so that Spark deletes the shuffle files and broadcasts of jobs that are over."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def trim() -> None:
    """Give memory that is free but held back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def tidy(run):
    """A function over Arrow batches that gives its memory back when it ends, as the worker lives on through later stages."""

    @wraps(run)
    def inner(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return inner


def fresh(name: str, taken) -> str:
    """``name``, with underscores after it where a column of that name (whatever its case) is already there."""
    taken = {c.lower() for c in taken}
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

"""What the training-data operators share: reading tables, cutting lineage, splitting words."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a longest run of these; `bytes.split()` cuts at the same six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, a local one in local mode (tests), else an error."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not set_dir:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        set_dir = f"file://{tempfile.mkdtemp(prefix='lectern-')}"
        spark.sparkContext.setCheckpointDir(set_dir)
        spark.conf.set("spark.checkpoint.dir", set_dir)
    return set_dir


#: What an Arrow batch holds at most while a staged table is written.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs planned inside send small Arrow batches to Python workers, whose memory (and the buffers that fill them) is small then."""
    before = {k: spark.conf.get(k, None) for k in BATCH}
    try:
        for k, v in BATCH.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def staged(df: DataFrame, label: str) -> DataFrame:
    """`df` written as Parquet to the shared folder and read again: lineage ends there, and a lost executor loses nothing.

    The files go when the session's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lectern-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Returns a worker's free memory to the system; workers live on between tasks, next to a JVM that grows."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(batches: Iterator[pa.RecordBatch], column: str, rows: int = 512, size: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The batches in slices of so many rows and bytes of a text or binary column at most (a longer value is a slice of its own)."""
    try:
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            at = 0
            while at < len(ends):
                fits = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right"))
                to = min(max(fits, at + 1), at + rows)
                yield batch.slice(at, to - at)
                at = to
    finally:
        give_back()


def crc32_of(text: str | Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes; of nothing (0) for null."""
    return F.coalesce(F.crc32(F.encode(F.col(text) if isinstance(text, str) else text, "UTF-8")), F.lit(0)).cast("long")


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def fresh(columns: list[str], *wanted: str) -> list[str]:
    """Names for working columns that no column of the input has."""
    taken = {c.lower() for c in columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out

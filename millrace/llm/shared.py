"""Small helpers that several operators of this subpackage use."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the operators' contracts define it (space and U+0009 to U+000D), as a Java regular expression class.
SPACE = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session. Only where all is one machine (as in tests) it may be unset; then a temporary one is made."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        if not folder and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="millrace-"))
    return folder or jsc.getCheckpointDir().get()


def size_in_bytes(df: DataFrame, text_col: str) -> int:
    """Spark's estimate of a column's size, of files their size, without a job; where Spark has none, the texts' bytes, counted."""
    estimate = int(str(df.select(text_col)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return estimate if estimate < 1 << 58 else df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, so that a lost executor costs no more than a reread."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored_at(df: DataFrame) -> tuple[DataFrame, str]:
    """Like cut(), for wide or many rows: as a compressed table in the shared folder; with its path."""
    df.write.parquet(path := f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}")
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame) -> DataFrame:
    return stored_at(df)[0]


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes a table of stored_at() that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def small_batches(spark: SparkSession) -> None:
    """Has Spark hand texts to Python in Arrow batches of 8 MB, where the session has Spark's own limit of 64 MB."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(limit, "67108864b") == "67108864b":
        spark.conf.set(limit, str(8 << 20))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text, in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def release() -> None:
    """Gives memory that a worker has freed back to the system, so that workers that wait for other stages hold little."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc keeps what is freed
    if trim:
        trim(0)


def in_slices(texts, size: int = 2 << 20):
    """(start, slice) of an Arrow array of texts, each of about `size` bytes, or one text: so that working copies stay small."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield at, texts.slice(at, end - at)
        at = end
    release()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

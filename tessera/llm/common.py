"""What the training-data operators share: inputs, durable intermediates, words."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid
import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than these (space and U+0009 to U+000D).
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of the Arrow batches that small_batches() asks for; a batch ends with the row that reaches them.
BATCH_BYTES = 4 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, cast; a missing one is null.

    The operators begin with this, so that extra columns, whatever their names, don't
    meet the operators' own.  columns: a type for each name.
    """
    return df.select(*(F.col(f"`{c}`").cast(t).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in columns.items()))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Where it is unset and Spark runs in one process (tests), a local one is set.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="tessera-"))
    return sc.getCheckpointDir()


def new_path(spark: SparkSession) -> str:
    """A new path in the shared folder, which release() deletes later."""
    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    _paths.append(path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared folder and read back: lineage ends there.

    A lost executor doesn't lose it, and later stages read only the columns they use.
    """
    spark = df.sparkSession
    path = new_path(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _of[path] = weakref.ref(out)
    return out


#: Paths written so far and not deleted, and the tables read from them.
_paths: list[str] = []
_of: dict[str, weakref.ref] = {}


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Delete paths that new_path() gave."""
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()
    for p in paths:
        _paths.remove(p)
        _of.pop(p, None)
        path = path_of(p)
        path.getFileSystem(conf).delete(path, True)
    if paths:
        forget_shuffles(spark)


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python functions in Arrow batches of BATCH_BYTES, unless the session sets a limit itself.

    Spark's own limits (10,000 rows, 256 MB) let a batch of long texts take tens of megabytes
    in the JVM, outside its heap, for every task, and as much in each worker.  The setting
    stays, as tables that operators return are planned and run after they have returned.
    """
    if spark.conf.get(key := "spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set(key, BATCH_BYTES)


def forget_shuffles(spark: SparkSession) -> None:
    """Spark deletes the files of shuffles that nothing refers to when the driver's garbage is collected."""
    gc.collect()
    spark._jvm.System.gc()


def drop(*tables: DataFrame) -> None:
    """Delete what materialize() wrote for these tables; nothing may read them any more."""
    if tables:
        delete(tables[0].sparkSession, [p for p, t in list(_of.items()) if any(t() is x for x in tables)])


def written() -> list[str]:
    """The paths in the shared folder that haven't been deleted."""
    return list(_paths)


def release(spark: SparkSession, before: list[str], keep: DataFrame) -> None:
    """Delete everything written since `before` was taken, except what `keep` reads."""
    used = keep.inputFiles()
    delete(spark, [p for p in _paths if p not in before and not any(os.path.basename(p) in f for f in used)])


def bitmap(df: DataFrame, column: str, bits: int) -> bytes:
    """A table of `bits` bits with those of the values' cells set; the driver gets at most bits / 64 rows."""
    cell = F.pmod(F.col(column), F.lit(bits))
    words = df.select(cell.cast("long").alias("cell")).select(F.shiftright("cell", 6).alias("word"), F.expr("shiftleft(1L, cast(cell & 63 as int))").alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    marks = np.zeros(bits // 64, np.int64)
    marks[found["word"].to_numpy()] = found["bits"].to_numpy()
    return marks.tobytes()


def in_batches(batches: Iterator[pa.RecordBatch], limit: int = 16 << 20, column: str | None = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in batches of `limit` bytes of text (None: the last column) and at most one row beyond, whatever the texts' lengths."""
    for batch in batches:
        k = batch.schema.get_field_index(column) if column else batch.num_columns - 1
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(k)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            done = ends[start - 1] if start else 0
            end = min(int(np.searchsorted(ends, done + limit)) + 1, batch.num_rows)
            yield batch.slice(start, end - start)
            start = end

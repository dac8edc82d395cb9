"""What the operators share: the shared folder, written tables, document keys and batch slicing."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text handled at once inside a kernel, in bytes; bounds a Python worker's memory whatever the batch size.
SLICE_BYTES = 1 << 20
#: Text in one Arrow batch between the JVM and a Python worker.
BATCH_BYTES = 8 << 20
#: Bytes of a written table that a task holds before it writes them.
ROW_GROUP = 16 << 20
#: Rows handled at once inside a kernel, however short.
SLICE_ROWS = 1 << 15
#: Rows of ids or short keys that are broadcast at most; some 20 MB.
SENT_ROWS = 1 << 20


def shared_root(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir. Only where it is unset on one machine (tests), a local one is set."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        root = "file://" + os.path.join(tempfile.gettempdir(), f"textloom-{uuid.uuid4().hex}")
        spark.sparkContext.setCheckpointDir(root)
        spark.conf.set("spark.checkpoint.dir", root)
    return qualified(spark, root)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system, which is Spark's default one where it names none; what isn't Spark can then read it too."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return re.sub("^file:/+", "file:///", whole).rstrip("/")


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches end by bytes as well as by rows, so that long texts don't fill a worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > BATCH_BYTES:
        spark.conf.set(key, BATCH_BYTES)


_made: list[Workspace] = []


def made() -> int:
    """How many workspaces there are: a mark for release()."""
    return len(_made)


def release(since: int = 0) -> None:
    """Deletes the workspaces made after the mark; what was built on their tables must be written by then. The rest go as the driver ends."""
    while len(_made) > since:
        ws = _made.pop()
        with contextlib.suppress(Exception):  # the session may be gone already
            ws.drop("")


atexit.register(release)


class Workspace:
    """A fresh folder under the shared root; tables written there cut lineage, so a lost executor costs one stage at most."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_root(spark)}/textloom/{name}-{uuid.uuid4().hex}"
        bound_batches(spark)
        _made.append(self)
        # the shuffles of a query are deleted as it ends, so that the next table finds the room
        spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", True)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        schema = df.schema
        df.write.option("parquet.block.size", ROW_GROUP).parquet(f"{self.path}/{name}", compression="zstd")
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def sized(ids: DataFrame) -> DataFrame:
    """A written table of a key or two a row: broadcast up to SENT_ROWS, else left for a shuffled join."""
    return F.broadcast(ids) if ids.count() <= SENT_ROWS else ids


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table; one that lies in fewer splits than half the cores (a small file) is dealt out, as its kernels would else run in one task."""
    bound_batches(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() < cores else df


def binaries(column: pa.Array) -> list[bytes]:
    """UTF-8 of each value, nulls as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def give_back() -> None:
    """Freed memory goes back to the system: a worker goes on to other kernels, and what each left behind would add up."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries don't have it
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterable[pa.RecordBatch], by: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of each batch in runs of about `limit` bytes of column `by`, at least one row each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(by)), 0), dtype=np.int64)
        ends, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = min(at + SLICE_ROWS, max(at + 1, int(np.searchsorted(ends, base + limit, side="right"))))
            yield batch.slice(at, to - at)
            at = to
    give_back()


def lists(values: np.ndarray, counts: Iterable[int], kind: pa.DataType) -> pa.ListArray:
    """A list array from flat values and the length of each list."""
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))

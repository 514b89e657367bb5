"""Session helpers shared by every plan: table access, code shipping, shared scratch space."""

from __future__ import annotations

import atexit
import contextvars
import ctypes
import shutil
import tempfile
import uuid
import weakref
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_shipped: weakref.WeakSet = weakref.WeakSet()
#: Folders of tables that spill_table() wrote, by the DataFrame that reads them; and those written inside the innermost materialize().
_folders: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()
_inside: contextvars.ContextVar = contextvars.ContextVar("treegrain_inside", default=None)


def ship_code(spark: SparkSession) -> None:
    """Send this package to the executors once per SparkContext, so that Python stages can import it there."""
    sc = spark.sparkContext
    if sc in _shipped:
        return
    root = Path(__file__).resolve().parent
    if root.is_dir() and not str(root).endswith(".zip"):
        at = tempfile.mkdtemp(prefix="treegrain-code-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
        to = Path(at) / "treegrain_code.zip"
        with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, str(p.relative_to(root.parent)))
        sc.addPyFile(str(to))
    _shipped.add(sc)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in the place that all executors see: spark.checkpoint.dir. Where it is unset, a master on one machine gets a
    temporary folder that goes when the process ends; any other master is an error, since executors there don't share the driver's disk."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        there = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = there.get() if there.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="treegrain-shared-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
        root = f"file://{at}"
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/treegrain-{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def purge(spark: SparkSession) -> None:
    """Delete the tables that this application has written into the shared folder; results that have not been written elsewhere go with them."""
    _delete(spark, shared_dir(spark))


def spill_table(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage, survives lost executors."""
    to = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(to)
    back = spark.read.schema(df.schema).parquet(to)
    _folders[back] = to
    if _inside.get() is not None:
        _inside.get().append(to)
    return back


def discard(df: DataFrame) -> None:
    """Delete a table of spill_table() that nothing will read again."""
    to = _folders.pop(df, None)
    if to:
        _delete(df.sparkSession, to)


def materialize(spark: SparkSession, make: Callable[[], DataFrame], label: str) -> DataFrame:
    """spill_table() of what make() gives; the tables that were spilled on the way have been read by then and are deleted."""
    token = _inside.set([])
    try:
        df = make()
        passing = list(_inside.get())
    finally:
        _inside.reset(token)
    back = spill_table(spark, df, label)
    for folder in passing:
        _delete(spark, folder)
    return back


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of df has, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def spread(df: DataFrame) -> DataFrame:
    """Give costly work on texts at least as many partitions as there are cores; large inputs already have them and aren't moved."""
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def gather(df: DataFrame) -> DataFrame:
    """At most twice as many partitions as there are cores, nothing shuffled: for stages of which each task gives some rows for every query, so that these grow with the queries only."""
    return df.coalesce(2 * df.sparkSession.sparkContext.defaultParallelism)


def runs(batch: pa.RecordBatch, sizes: np.ndarray, limit: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose sizes come to at most `limit` each (one row, if it alone is larger): what is made of one doesn't grow with the batch."""
    ends, i = np.cumsum(sizes), 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + limit, "right")))
        yield batch.slice(i, j - i)
        i = j


def tidy(stage: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A stage that gives freed memory back to the system when a task ends, since workers live on beside those of other stages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from stage(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):
                pass  # another C library

    return run

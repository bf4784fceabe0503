"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch: bounds what a Python worker holds when texts are long.
ARROW_ROWS = 1000
#: A key is heavy with more than this share of all rows, so that there are few heavy keys whatever the data.
HEAVY_SHARE, HEAVY_LEAST = 1000, 10_000

#: Paths of the tables staged inside the innermost ``scratch`` block.
_scopes: list[list[tuple[SparkSession, str]]] = []


def tune(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for long texts.

    The setting stays, as Spark reads it when the returned query runs.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def checkpoint_root(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only in local mode where none is configured."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    jsc = spark.sparkContext._jsc.sc()
    if not jsc.getCheckpointDir().isDefined():
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="framelark-"))
    return jsc.getCheckpointDir().get()


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    The lineage ends at files that every executor sees, so a lost executor
    costs a re-read and not a recomputation.  Tables that are staged inside a
    ``scratch`` block go with it; others stay, as the caller's query reads them.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _scopes:
        _scopes[-1].append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Remove staged tables that nothing reads any more."""
    for t in tables:
        dropped(t.sparkSession, t._staged_at)


def dropped(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Remove the tables staged inside the block at its end.

    What the block returns must be written by then, outside of the staging
    (``kept`` does that).
    """
    _scopes.append([])
    try:
        yield
    finally:
        for spark, path in _scopes.pop():
            dropped(spark, path)


def kept(make: Callable[[], DataFrame]) -> DataFrame:
    """``make()`` staged, without the tables that were staged on the way."""
    with scratch():
        df = make()
        outer = _scopes.pop()
        try:
            out = staged(df)
        finally:
            _scopes.append(outer)
    return out


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Remove the shuffle files of each query that ends inside the block.

    Else they stay until the driver happens to collect its garbage, and the
    steps of a long operator add up on the executors' disks.  A DataFrame must
    not be run twice inside the block; ``staged`` and counts are runs of their own.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


@functools.cache
def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:
        return None


def release() -> None:
    """Give unused memory back, so that a reused worker doesn't keep its peak."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    libc = _libc()
    if libc is not None and hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def trimmed(run: Callable) -> Callable:
    """A batch function that gives its memory back at the end of a task."""

    @functools.wraps(run)
    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return outer


def hash_sample(df: DataFrame, keys: list[str], bound: int) -> DataFrame:
    """At most ``bound`` rows, those of the smallest hashes of ``keys``.

    Rows far beyond the bound are ruled out by a threshold on the hash before
    anything is sorted, so tasks send few more than ``bound`` rows in all.
    """
    total = df.count()
    h = F.xxhash64(*keys)
    if total > 2 * (2 * bound + 1000):
        df = df.where(h < F.lit(-(2**63) + 2**64 * (2 * bound + 1000) // total))
    return df.orderBy(h, *keys).limit(bound)


def join_unique(left: DataFrame, right: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """Inner join with a side that holds one row a key, whose ``count`` tells the left rows of the key.

    Keys that hold more than a thousandth of all ``total`` left rows are joined
    by broadcast (there are at most a thousand of them), so no task gets them
    as a whole; all other keys meet by a shuffle.  The hint keeps it at that:
    Spark does not count the rows that an explode adds and would broadcast
    either side, however large.
    """
    most = max(HEAVY_LEAST, total // HEAVY_SHARE)
    heavy = F.broadcast(right.where(F.col(count) > most))
    rest = left.join(heavy.select(*keys), keys, "left_anti")
    return left.join(heavy, keys).unionByName(rest.join(right.where(F.col(count) <= most).hint("merge"), keys))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def groups_of(
    batches: Iterator[pa.RecordBatch], keys: list[str], rows: int, size: int | None = None
) -> Iterator[pa.Table]:
    """Cut a stream sorted by ``keys`` into tables of whole groups.

    A table closes at the first group border after ``rows`` rows, or ``size``
    bytes; a group is never split, so callers bound the group's size before.
    """
    import numpy as np

    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < rows and (size is None or sum(b.nbytes for b in held) < size):
            continue
        whole = pa.Table.from_batches(held)
        cols = [whole.column(k).to_numpy() for k in keys]
        last = np.ones(count, dtype=bool)
        for c in cols:
            last &= c == c[-1]
        cut = int(np.argmax(last))
        if cut:
            yield whole.slice(0, cut)
            rest = whole.slice(cut).combine_chunks()
            held, count = rest.to_batches(), rest.num_rows
        else:
            held, count = [*whole.to_batches()], count
    if count:
        yield pa.Table.from_batches(held)

"""Run telemetry, timing and summaries as files."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the telemetry log, in order (fixed values).
TELEMETRY = (
    "wall_time", "run_id", "machine", "elapsed_sec", "phase", "batch_idx", "n_batches", "frame_in_batch", "batch_size",
    "overall_pct", "estimate_remaining_sec", "det_ema", "rep_ema", "warm_batches_count", "note",
)


def telemetry(rows: DataFrame) -> DataFrame:
    """Rows with the columns of the log; those that ``rows`` lacks are empty."""
    cols = [F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in TELEMETRY]
    return rows.select(*cols)


def append_telemetry(rows: DataFrame, folder: str) -> None:
    """Append rows to the log as CSV."""
    telemetry(rows).write.mode("append").option("header", "true").csv(folder)


def write_timing(timing: DataFrame, folder: str) -> None:
    """``sec_per_frame, image_pixels, app_version`` of a run, for the next one's first estimate."""
    timing.select("sec_per_frame", "image_pixels", "app_version").write.mode("overwrite").json(folder)


def write_summary(lines: DataFrame, folder: str) -> None:
    lines.select("value").write.mode("overwrite").text(folder)


def write_masks(pixels: DataFrame, folder: str) -> None:
    """Masks as pixel sets, a folder per frame."""
    pixels.write.mode("overwrite").partitionBy("f").parquet(folder)


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def replace_mask(pixels: DataFrame, folder: str) -> bool:
    """Write a static mask if it has any pixel, else remove the one that is there; say whether it was written."""
    if pixels.isEmpty():
        fs, at = _file_system(pixels.sparkSession, folder)
        fs.delete(at, True)
        return False
    pixels.write.mode("overwrite").parquet(folder)
    return True


def cached(spark: SparkSession, folder: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``folder``; built and written if there is none yet (a defect map, say)."""
    fs, at = _file_system(spark, folder)
    if not fs.exists(at):
        build().write.mode("overwrite").parquet(folder)
    return spark.read.parquet(folder)


def writable(spark: SparkSession, folder: str) -> bool:
    """Whether a file can be made in ``folder`` (and is removed again)."""
    from py4j.protocol import Py4JJavaError

    fs, at = _file_system(spark, f"{folder.rstrip('/')}/.probe-{uuid.uuid4().hex}")
    try:
        fs.create(at).close()
        return bool(fs.delete(at, False))
    except Py4JJavaError:
        return False


#: What a run ends with, and the exit code of each (fixed values).
DONE, FAILED = 0, 2


def guarded(write: Callable[[], None]) -> tuple[int, str]:
    """Run a sink and turn a failed write into an exit code and a reason."""
    from pyspark.errors import PySparkException

    try:
        write()
    except (PySparkException, OSError) as e:
        return FAILED, f"could not write: {str(e).splitlines()[0]}"
    return DONE, ""

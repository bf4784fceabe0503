"""A run in batches: one after the other, each written before the next begins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelark.operators import manifest
from framelark.sources.sinks import _file_system


def run_batches(
    files: DataFrame, work: Callable[[DataFrame], DataFrame], folder: str, size: int = 20, halo: int = 1, stop: Callable[[], bool] = lambda: False
) -> int:
    """Give each batch of indexed ``files``, with its halo, to ``work`` and write what comes back under ``folder``.

    A batch that an earlier run has written whole is left as it is, so a run
    that was stopped goes on where it ended; ``stop`` is asked before each
    batch.  Says how many batches have been written.  This is for work that
    must go in turns; all else is better done as one query.
    """
    spark = files.sparkSession
    rows = manifest.batches(files, size, halo)
    last = files.agg(F.max("frame_idx")).first()[0]
    done = 0
    for b in range(0 if last is None else last // size + 1):
        if stop():
            break
        fs, at = _file_system(spark, f"{folder.rstrip('/')}/batch={b}/_SUCCESS")
        if not fs.exists(at):
            work(rows.where(F.col("batch") == b)).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/batch={b}")
            done += 1
    return done

"""Progress, throttling and summaries of runs."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def remaining(ticks: DataFrame, run: str, at: str, total: Column, seed: Column | None = None, trust: float = 2.0, pad: float = 1.2) -> DataFrame:
    """``ticks`` with ``work_done`` and ``remaining_sec``.

    ``at`` is in seconds and each tick adds ``work`` (frames).  From ``trust``
    frames on the measured rate counts, before that ``seed`` (seconds a frame)
    if there is one; estimates are padded.  Without either they are null.
    """
    w = Window.partitionBy(run).orderBy(at, "tick").rowsBetween(Window.unboundedPreceding, 0)
    done, spent = F.sum("work").over(w), F.col(at) - F.min(at).over(w)
    out = ticks.withColumn("work_done", done).withColumn("_spent", spent).withColumn("_left", total - F.col("work_done"))
    measured = F.when((F.col("work_done") >= trust) & (F.col("_spent") > 0), F.col("_left") / (F.col("work_done") / F.col("_spent")) * pad)
    seeded = F.col("_left") * seed * pad if seed is not None else F.lit(None).cast("double")
    return out.withColumn("remaining_sec", F.when(F.col("_left") <= 0, 0.0).otherwise(F.coalesce(measured, seeded))).drop("_spent", "_left")


def first_estimate(estimates: DataFrame, run: str, order: str) -> DataFrame:
    """The first estimate of every run that is not null."""
    known = estimates.where(F.col("remaining_sec").isNotNull())
    return known.groupBy(run).agg(F.min_by("remaining_sec", order).alias("first_estimate"))


def seed_rate(timing: DataFrame, pixels: int) -> DataFrame:
    """Seconds a frame of an earlier run at this image size; older files give them by 20 frames."""
    scale = F.lit(float(pixels)) / F.col("image_pixels")
    spf = F.coalesce(F.when(F.col("sec_per_frame") > 0, F.col("sec_per_frame")), F.when(F.col("warm_batch_mean") > 0, F.col("warm_batch_mean") / 20))
    return timing.select(F.when(F.col("image_pixels") > 0, spf * scale).alias("sec_per_frame"))


def throttled(rows: DataFrame, run: str, at: str, gap: float, forced: str | None = None) -> DataFrame:
    """Rows that come ``gap`` or more after the last one kept of their run, or are forced.

    The state is one time per run, so a run streams through its task in order.
    """
    schema = rows.schema

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, None
        for batch in batches:
            names = batch.schema.names
            must = batch.column(names.index(forced)).to_pylist() if forced else [False] * batch.num_rows
            flags = []
            for r, t, m in zip(batch.column(names.index(run)).to_pylist(), batch.column(names.index(at)).to_pylist(), must, strict=True):
                if r != now:
                    now, last = r, None
                ok = bool(m) or last is None or t - last >= gap
                last = t if ok else last
                flags.append(ok)
            yield batch.filter(pa.array(flags, pa.bool_()))

    return rows.repartition(run).sortWithinPartitions(run, at).mapInArrow(keep, schema)


def until_failures(rows: DataFrame, run: str, order: list[str], failed: Column, cap: int = 1) -> DataFrame:
    """Rows of a run up to the failure that exceeds ``cap``, with the running count."""
    w = Window.partitionBy(run).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("failures", F.sum(failed.cast("int")).over(w)).where(F.col("failures") <= cap)


def newest_release(tags: DataFrame, version: str, local: float = 0.0, order: str = "seen") -> DataFrame:
    """The release of the largest version above ``local``; of equals the first seen."""
    return tags.where(F.col(version) > local).orderBy(F.desc(version), F.asc(order)).limit(1)


def releases(feed: DataFrame, body: str = "value") -> DataFrame:
    """``(tag_name, body, assets)`` of a landed release feed, an object or an array in each row; broken rows give nothing."""
    one = "struct<tag_name:string,body:string,assets:array<struct<name:string,browser_download_url:string>>>"
    text = F.trim(F.col(body))
    listed = F.when(text.startswith("["), text).otherwise(F.concat(F.lit("["), text, F.lit("]")))
    rows = feed.select(F.explode(F.from_json(listed, f"array<{one}>")).alias("r")).select("r.*")
    return rows.where(F.col("tag_name").isNotNull())


@contextlib.contextmanager
def cancellable(spark: SparkSession, tag: str) -> Iterator[None]:
    """Jobs started inside can be stopped from elsewhere with ``cancel(spark, tag)``."""
    spark.addTag(tag)
    try:
        yield
    finally:
        spark.removeTag(tag)


def cancel(spark: SparkSession, tag: str) -> int:
    """Stop all running jobs of a tag; how many there were."""
    return len(spark.interruptTag(tag))


def summary(counts: DataFrame, title: str = "Run summary") -> DataFrame:
    """One text row: a title and a line for every column of the one-row ``counts``."""
    lines = [F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("-"))) for c in counts.columns]
    return counts.select(F.concat_ws("\n", F.lit(title), *lines).alias("value"))

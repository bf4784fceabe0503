"""Listing, choosing and batching the files of a sequence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Suffixes that count as frames (fixed values).
IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "tif", "tiff")


def images(files: DataFrame, ext: str = "ext") -> DataFrame:
    """Files whose suffix, whatever its case, is that of an image."""
    return files.where(F.lower(F.ltrim(F.col(ext), F.lit("."))).isin(*IMAGE_SUFFIXES))


def indexed(files: DataFrame, order: Sequence[str], sequence: Sequence[str] = (), buckets: int = 64) -> DataFrame:
    """Add ``frame_idx``, the place of a file in its sequence, from 0.

    ``sequence`` names the columns that tell sequences apart (say, the folder):
    each is ranked by itself.  Without them all files are one sequence, which
    is ranked by ranges of the first of ``order``: a sample chooses where ranges
    begin, counts by range (a few rows) tell where each starts.
    """
    if sequence:
        w = Window.partitionBy(*sequence).orderBy(*order)
        return files.withColumn("frame_idx", (F.row_number().over(w) - 1).cast("bigint"))
    first = F.col(order[0])
    sample = files.where(first.isNotNull()).select(first.alias("v")).distinct().orderBy(F.xxhash64("v")).limit(16 * buckets)
    values = sorted(r.v for r in sample.collect())  # a bounded sample; any choice of cuts is right
    at = sorted({values[len(values) * k // buckets] for k in range(1, buckets)}) if values else []

    def bucket(cuts: list, below: int) -> Column:
        if not cuts:
            return F.lit(below)
        mid = len(cuts) // 2
        return F.when(first >= F.lit(cuts[mid]), bucket(cuts[mid + 1 :], below + mid + 1)).otherwise(bucket(cuts[:mid], below))

    dealt = files.withColumn("_bucket", bucket(at, 0))  # nulls are in the first range, and first in it
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # ``buckets`` rows
    starts = dealt.groupBy("_bucket").agg(F.count("*").alias("_n"))
    starts = starts.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order)) - 1 + F.col("_start")
    return dealt.join(F.broadcast(starts), "_bucket").withColumn("frame_idx", place.cast("bigint")).drop("_bucket", "_start")


def prefer_tiff(files: DataFrame, order: Sequence[str] = ("path",), stem: str = "stem", ext: str = "ext") -> DataFrame:
    """One file per stem: a TIFF before any other, else the first."""
    tiff = F.lower(F.col(ext)).isin("tif", "tiff")
    w = Window.partitionBy(stem).orderBy(tiff.desc(), *order)
    return files.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def dominant(files: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The most frequent combination of ``keys``; of equals the one seen first."""
    n = files.groupBy(*keys).agg(F.count("*").alias("n_files"), F.min(order).alias("first_seen"))
    return n.orderBy(F.desc("n_files"), F.asc("first_seen")).limit(1)


def of_dominant_size(files: DataFrame, keys: Sequence[str] = ("w", "h"), order: str = "path") -> DataFrame:
    """Files of the dominant resolution; the one-row side is broadcast."""
    return files.join(F.broadcast(dominant(files, keys, order).select(*keys)), list(keys), "left_semi")


def size_breakdown(files: DataFrame, keys: Sequence[str] = ("w", "h"), name: str = "path", samples: int = 5) -> DataFrame:
    """Count, dominance and the first names of every resolution."""
    counts = files.groupBy(*keys).agg(F.count("*").alias("n_files"), F.min(name).alias("first_seen"))
    top = F.broadcast(dominant(files, keys, name).select(*keys, F.lit(True).alias("is_dominant")))
    w = Window.partitionBy(*keys).orderBy(name)  # a group limit: tasks send ``samples`` rows a key
    first = files.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= samples)
    named = first.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list(name)), ",").alias("samples"))
    out = counts.join(top, list(keys), "left").join(named, list(keys))
    return out.select(*keys, "n_files", F.coalesce("is_dominant", F.lit(False)).alias("is_dominant"), "samples")


def batches(files: DataFrame, size: int = 20, halo: int = 1, index: str = "frame_idx") -> DataFrame:
    """Each file in its batch (``is_core``) and as halo in those next to it.

    The last files may also be halo of a batch after the last one, which has no
    core rows.
    """
    i = F.col(index)
    own = F.floor(i / size).cast("int")
    near = F.sequence(F.floor((i - halo) / size).cast("int"), F.floor((i + halo) / size).cast("int"))
    out = files.withColumn("_own", own).withColumn("batch", F.explode(near)).where("batch >= 0")
    return out.withColumn("is_core", F.col("_own") == F.col("batch")).drop("_own")


def core_batches(files: DataFrame, size: int = 20, index: str = "frame_idx") -> DataFrame:
    """``batch``: the run of ``size`` frames that a frame lies in; the last is shorter."""
    return files.withColumn("batch", F.floor(F.col(index) / size).cast("int"))


def readable(files: DataFrame, data: str = "data", why: str = "why") -> tuple[DataFrame, DataFrame]:
    """Files with a decoded image, and the others with their reasons counted."""
    bad = files.where(F.col(data).isNull())
    return files.where(F.col(data).isNotNull()), bad.groupBy(why).agg(F.count("*").alias("n_files"))


def homogeneous(files: DataFrame, keys: Sequence[str] = ("width", "height", "bit_depth")) -> DataFrame:
    """One row that says ``ok``, or an error if ``keys`` take several values."""
    n = F.count_distinct(F.struct(*keys))
    return files.agg(F.when(n <= 1, "ok").otherwise(F.raise_error(F.lit("frames differ in size or depth"))).alias("state"))


def at_least(files: DataFrame, frames: int = 3) -> DataFrame:
    """One row with the count, or an error if there are fewer frames."""
    n = F.count("*")
    return files.agg(F.when(n >= frames, n).otherwise(F.raise_error(F.lit("too few frames"))).alias("n_frames"))


def within_policy(files: DataFrame, failed: Column, on_bad: str = "skip", most: int | None = None) -> DataFrame:
    """The files that did not fail; with ``stop``, or beyond ``most`` skipped ones, an error in place of rows."""
    if on_bad not in ("skip", "stop"):
        raise ValueError("on_bad must be skip or stop")
    limit = 0 if on_bad == "stop" else most
    bad = F.coalesce(failed, F.lit(True))
    if limit is None:
        return files.where(~bad)
    n = files.agg(F.count_if(bad).alias("_bad"))
    too_many = F.raise_error(F.concat(F.lit("unreadable frames: "), F.col("_bad").cast("string"))).cast("boolean")
    checked = files.crossJoin(F.broadcast(n)).where(F.when(F.col("_bad") > limit, too_many).otherwise(F.lit(True)))  # one row on the right
    return checked.where(~bad).drop("_bad")


def without_edges(frames: DataFrame, skip: int, index: str = "frame_idx") -> DataFrame:
    """Frames but for the first and last ``skip``."""
    last = frames.agg((F.max(index) - skip).alias("_last"))
    return frames.crossJoin(F.broadcast(last)).where(F.col(index).between(F.lit(skip), F.col("_last"))).drop("_last")  # one row on the right


def first_frames(files: DataFrame, limit: int | None, order: Sequence[str] = ("path",)) -> DataFrame:
    return files if limit is None else files.orderBy(*order).limit(limit)


def shared_metadata(frames: DataFrame, meta: Sequence[str], index: str = "frame_idx") -> DataFrame:
    """The metadata of the first frame, for all: one row, broadcast."""
    first = frames.agg(F.min_by(F.struct(*meta), index).alias("_m")).select("_m.*")
    return frames.drop(*meta).crossJoin(F.broadcast(first))  # one row on the right


def union_distinct(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def bad_files(files: DataFrame, failed: Column) -> DataFrame:
    """The side output of skipped files: what is known of each, and one fingerprint for all."""
    return files.where(failed).withColumn("fingerprint", F.lit("unreadable-frame"))

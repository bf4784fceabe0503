"""Operators along the frames of one pixel position."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelark.operators.pixels import box_median, inside_ring_mean, over_frames, ring_mean


def _here():
    return Window.partitionBy("y", "x").orderBy("f")


def clean_sky(px: DataFrame, percent: float = 50, value: str = "v") -> DataFrame:
    """``(y, x, value)``: the linear percentile over time, truncated.

    The aggregate keeps counts by distinct level, so its state is bounded by
    the number of levels and combines on the map side.
    """
    level = F.floor(F.percentile(F.col(value), F.lit(percent / 100))).cast("int")
    return px.groupBy("y", "x").agg(level.alias(value))


def residual(px: DataFrame, sky: DataFrame, absolute: bool = False) -> DataFrame:
    """``px`` with ``d``: what a sample has above the clean sky (or its distance)."""
    back = sky.select("y", "x", F.col("v").alias("_b"))
    d = F.col("v") - F.col("_b")
    return px.join(back, ["y", "x"]).withColumn("d", F.abs(d) if absolute else F.greatest(d, F.lit(0))).drop("_b")


def neighbour_difference(px: DataFrame, value: str = "v") -> DataFrame:
    """``px`` with ``d``: the smaller excess over the frame before and after.

    A frame at either end of the sequence is compared with the one it has;
    a lone frame has none and gets null.
    """
    d = F.least(F.col(value) - F.lag(value).over(_here()), F.col(value) - F.lead(value).over(_here()))
    return px.withColumn("d", F.when(d.isNotNull(), F.greatest(d, F.lit(0))))


def repaired_by_average(px: DataFrame, mask: DataFrame) -> DataFrame:
    """Masked pixels with ``repaired``: the truncated mean of the frames around.

    With one neighbour it is copied; with none the sample stays.  Neighbours'
    own masks are not looked at.
    """
    p, n = F.lag("v").over(_here()), F.lead("v").over(_here())
    both = px.withColumn("_p", p).withColumn("_n", n).join(mask, ["f", "y", "x"], "left_semi")
    mean = F.floor((F.col("_p") + F.col("_n")) / 2).cast("int")
    return both.withColumn("repaired", F.coalesce(mean, "_p", "_n", "v")).drop("_p", "_n")


def repaired_by_sky(px: DataFrame, mask: DataFrame, sky: DataFrame) -> DataFrame:
    """Masked pixels with ``repaired``: the clean sky where there is one."""
    back = sky.select("y", "x", F.col("v").alias("_b"))
    out = px.join(mask, ["f", "y", "x"], "left_semi").join(back, ["y", "x"], "left")
    return out.withColumn("repaired", F.coalesce("_b", "v")).drop("_b")


def _in_most_frames(px: DataFrame, measure, values: tuple[str, ...], needed) -> DataFrame:
    """``(y, x, hits, ...)`` of positions whose ``needed(column, n)`` holds of the summed measures of all frames.

    A kernel gives one number a pixel, so nothing is joined back; the number of
    frames is a one-row aggregate beside the sums.
    """
    found = over_frames(px, measure, "hit", values)
    n = px.agg(F.count_distinct("f").alias("n"))
    sums = found.groupBy("y", "x").agg(F.count_if(F.col("hit").cast("int").bitwiseAND(1) > 0).alias("hits"), *[
        F.count_if(F.col("hit").cast("int").bitwiseAND(1 << k) > 0).alias(f"hits{k}") for k in range(1, 4)
    ])
    return sums.crossJoin(F.broadcast(n)).where(needed(F.col("n")))  # one row on the right


def hot_pixels(px: DataFrame, ratio: float = 2.0, least: int = 5, size: int = 9, fraction: float = 0.8) -> DataFrame:
    """``(y, x, hits)`` of positions far above their surroundings in most frames.

    A hit is a sample above ``least`` and above ``ratio`` times the spatial
    median (1 at least); ``int(n * fraction)`` hits are needed.
    """

    def measure(p: np.ndarray) -> np.ndarray:
        v = p[..., 0]
        return ((v / np.maximum(box_median(v, size), 1.0) > ratio) & (v > least)).astype(float)

    return _in_most_frames(px, measure, ("v",), lambda n: F.col("hits") >= F.floor(n * fraction)).select("y", "x", "hits")


def coloured_hot_pixels(
    bgr: DataFrame, ratio: float = 2.0, least: int = 5, excess: float = 60, size: int = 9, fraction: float = 0.8
) -> DataFrame:
    """``(y, x)`` that are hot in a channel and stand out from the other channels.

    Both conditions must hold often enough, each counted by itself: not
    necessarily in the same frames.
    """

    def measure(p: np.ndarray) -> np.ndarray:
        hot = [(p[..., c] / np.maximum(box_median(p[..., c], size), 1.0) > ratio) & (p[..., c] > least) for c in range(3)]
        top = p.max(axis=2)
        out = top - (p.sum(axis=2) - top) / 2 >= excess
        return sum((b.astype(float) * (1 << k) for k, b in enumerate((out, *hot))), np.zeros(p.shape[:2]))

    def needed(n):
        some = F.greatest("hits1", "hits2", "hits3") >= F.floor(n * fraction)
        return some & (F.col("hits") >= F.floor(n * fraction))

    return _in_most_frames(bgr, measure, ("b", "g", "r"), needed).select("y", "x")


def ring_contrast(px: DataFrame, centre: float, inner: float, fraction: float, low: int = 2, high: int = 3) -> DataFrame:
    """``(y, x, hits)`` of positions that differ from a ring around them, as their neighbours do.

    Rings hold in-image pixels only; ``ceil(n * fraction)`` hits are needed.
    """

    def measure(p: np.ndarray) -> np.ndarray:
        v = p[..., 0]
        far = inside_ring_mean(v, low, high)
        c, i = v - far, inside_ring_mean(v, 1, 1) - far
        return ((np.abs(c) >= centre) & (np.abs(i) >= inner) & (c * i > 0)).astype(float)

    return _persistent(px, measure, ("v",), fraction)


def chromatic_defects(
    bgr: DataFrame, centre: float = 40, inner: float = 20, low: int = 5, high: int = 8, fraction: float = 0.8
) -> DataFrame:
    """``ring_contrast`` of a channel's excess over the two others, for any channel; borders replicated."""

    def measure(p: np.ndarray) -> np.ndarray:
        hit = np.zeros(p.shape[:2], bool)
        for own in range(3):
            d = p[..., own] - 0.5 * (p.sum(axis=2) - p[..., own])
            hit |= _stands_out(d, centre, inner, low, high)
        return hit.astype(float)

    return _persistent(bgr, measure, ("b", "g", "r"), fraction)


def white_defects(
    bgr: DataFrame, centre: float = 30, inner: float = 15, low: int = 5, high: int = 8, fraction: float = 0.8
) -> DataFrame:
    """``ring_contrast`` of the mean of the channels; borders replicated."""
    measure = lambda p: _stands_out(p.mean(axis=2), centre, inner, low, high).astype(float)
    return _persistent(bgr, measure, ("b", "g", "r"), fraction)


def _stands_out(d: np.ndarray, centre: float, inner: float, low: int, high: int) -> np.ndarray:
    far = ring_mean(d, 2 * high + 1, 2 * low - 1)
    c, i = d - far, ring_mean(d, 3, 1) - far
    return (np.abs(c) >= centre) & (np.abs(i) >= inner) & (c * i > 0)


def _persistent(px: DataFrame, measure, values: tuple[str, ...], fraction: float) -> DataFrame:
    return _in_most_frames(px, measure, values, lambda n: F.col("hits") >= F.ceil(n * fraction)).select("y", "x", "hits")


def median_and_mad(px: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """``(keys, med, mad)``: the median of a group, and the median distance from it."""
    med = px.groupBy(*keys).agg(F.percentile(value, F.lit(0.5)).alias("med"))
    away = F.percentile(F.abs(F.col(value) - F.col("med")), F.lit(0.5)).alias("mad")
    return px.join(med, keys).groupBy(*keys, "med").agg(away)


def row_gain(plane: DataFrame, boost: float = 3.0, epsilon: float = 2.0, smooth: int | None = 1) -> DataFrame:
    """``(y, q, gain)``: brightness of each image row against the dark sky.

    ``smooth`` is the odd width of a Gaussian over the rows (1: none; None: a
    tenth of the height, 201 at most).  One row per image row, so the window
    over all of them is bounded by the frame's height.
    """
    rows = plane.groupBy("y").agg(F.percentile(F.col("v"), F.lit(0.75)).alias("q"))
    if smooth is None:
        smooth = min(rows.count() // 10 | 1, 201)
    if smooth > 1:
        r, sigma = smooth // 2, smooth / 3.0
        w = Window.orderBy("y")
        total, weights = F.lit(0.0), 0.0
        first, last = F.first("q").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.last("q").over(w.rowsBetween(0, Window.unboundedFollowing))
        for k in range(-r, r + 1):
            g = math.exp(-k * k / (2 * sigma * sigma))
            near = F.lag("q", -k).over(w) if k < 0 else F.lead("q", k).over(w)
            total, weights = total + g * F.coalesce(near, first if k < 0 else last), weights + g
        rows = rows.withColumn("q", total / weights)
    ref = rows.agg(F.greatest(F.percentile("q", F.lit(0.2)), F.lit(5.0)).alias("ref"))
    gain = F.least(F.greatest((F.col("q") + epsilon) / (F.col("ref") + epsilon), F.lit(1.0)), F.lit(boost))
    return rows.crossJoin(F.broadcast(ref)).select("y", "q", gain.alias("gain"))  # one row on the right


def with_gain(px: DataFrame, gain: DataFrame) -> DataFrame:
    """Samples times their row's gain, clipped and truncated."""
    v = F.least(F.floor(F.col("v") * F.col("gain")), F.lit(255)).cast("int")
    return px.join(gain.select("y", "gain"), "y").withColumn("v", v).drop("gain")


def wide_median(px: DataFrame, half: int) -> DataFrame:
    """``px`` with ``m``: the truncated median over the ``half`` frames either side."""
    w = _here().rowsBetween(-half, half)
    return px.withColumn("m", F.floor(F.expr("percentile(v, 0.5)").over(w)).cast("int"))

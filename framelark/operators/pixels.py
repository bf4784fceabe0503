"""Sparse masks as pixel sets ``(f, y, x)``, and per-pixel neighbourhoods."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelark.operators._frames import per_frame, starts_of

PIXEL = ["f", "y", "x"]


def mask(px: DataFrame, above: int, value: str = "v") -> DataFrame:
    """Pixels above a threshold (strictly)."""
    return px.where(F.col(value) > above).select(*PIXEL)


def mask_union(*masks: DataFrame) -> DataFrame:
    out = masks[0].select(*PIXEL)
    for m in masks[1:]:
        out = out.union(m.select(*PIXEL))
    return out.distinct()


def mask_union_all(*masks: DataFrame) -> DataFrame:
    """All pixels of all masks, as often as they stand in them."""
    out = masks[0].select(*PIXEL)
    for m in masks[1:]:
        out = out.unionAll(m.select(*PIXEL))
    return out


def inverted(pixels: DataFrame, extents: DataFrame) -> DataFrame:
    """The pixels that a mask does not hold, of frames of ``extents(f, h, w)``."""
    whole = extents.select("f", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("y"), "w")
    whole = whole.select("f", "y", F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("x"))
    return whole.join(pixels.select(*PIXEL), PIXEL, "left_anti")


def mask_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, PIXEL, "left_anti")


def mask_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, PIXEL, "left_semi")


def in_sky(pixels: DataFrame, foreground: DataFrame) -> DataFrame:
    """Rows that lie on no pixel ``(y, x)`` of the static foreground."""
    return pixels.join(foreground, ["y", "x"], "left_anti")


def centroids_in_sky(points: DataFrame, foreground: DataFrame) -> DataFrame:
    """Points ``(x, y)`` whose pixel is not foreground."""
    return points.join(foreground, ["x", "y"], "left_anti")


def ellipse(size: int) -> list[tuple[int, int]]:
    """(dy, dx) of an elliptic structuring element of odd ``size``."""
    r = size // 2
    out = []
    for dy in range(-r, r + 1):
        half = round(r * np.sqrt(max(0, r * r - dy * dy)) / r) if r else 0
        out += [(dy, dx) for dx in range(-half, half + 1)]
    return out


def square(size: int) -> list[tuple[int, int]]:
    r = size // 2
    return [(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1)]


def dilated(pixels: DataFrame, element: Iterable[tuple[int, int]], height: int | None = None, width: int | None = None) -> DataFrame:
    """Every pixel that the element covers when it is put on a pixel of the mask."""
    steps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in element])
    out = pixels.select("f", "y", "x", F.explode(steps).alias("s"))
    out = out.select("f", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"))
    if height is not None:
        out = out.where(F.col("y").between(0, height - 1))
    if width is not None:
        out = out.where(F.col("x").between(0, width - 1))
    return out.distinct()


def resized(pixels: DataFrame, old: tuple[int, int], new: tuple[int, int]) -> DataFrame:
    """Nearest-neighbour resize of a mask from (height, width) to (height, width)."""
    (h0, w0), (h, w) = old, new
    rows = lambda n, n0, c: F.sequence(
        F.ceil(F.col(c) * n / n0).cast("int"), F.ceil((F.col(c) + 1) * n / n0).cast("int") - 1
    )
    fits = pixels.where((F.ceil(F.col("y") * h / h0) < F.ceil((F.col("y") + 1) * h / h0)) & (F.ceil(F.col("x") * w / w0) < F.ceil((F.col("x") + 1) * w / w0)))
    tall = fits.select("f", F.explode(rows(h, h0, "y")).alias("y"), "x")
    return tall.select("f", "y", F.explode(rows(w, w0, "x")).alias("x"))


def disk(radius: int) -> list[tuple[int, int]]:
    r = range(-radius, radius + 1)
    return [(dy, dx) for dy in r for dx in r if dx * dx + dy * dy <= radius * radius]


def brushed(strokes: DataFrame, radius: int) -> DataFrame:
    """Pixels of line strokes ``(f, x0, y0, x1, y1)`` painted with a round brush."""
    length = F.sqrt(F.pow(F.col("x1") - F.col("x0"), 2) + F.pow(F.col("y1") - F.col("y0"), 2))
    n = F.greatest(F.lit(1), F.ceil(length / max(1, radius // 3)).cast("int"))
    dots = strokes.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n"))))
    at = lambda a, b: F.bround(F.col(a) + F.col("k") / F.col("n") * (F.col(b) - F.col(a))).cast("int")
    return dilated(dots.select("f", at("y0", "y1").alias("y"), at("x0", "x1").alias("x")).distinct(), disk(radius))


def has_pixels(pixels: DataFrame) -> bool:
    return not pixels.isEmpty()


def states(pixels: DataFrame, frames: DataFrame) -> DataFrame:
    """``(f, marked)``: whether a frame of ``frames(f)`` has any pixel set."""
    some = pixels.select("f", F.lit(True).alias("marked")).distinct()
    return frames.select("f").join(some, "f", "left").select("f", F.coalesce("marked", F.lit(False)).alias("marked"))


def repainted(px: DataFrame, pixels: DataFrame, fill: DataFrame, value: str = "v") -> DataFrame:
    """Masked samples replaced from ``fill(y, x, value)``; the others as they are."""
    marked = pixels.select(*PIXEL, F.lit(1).alias("_m"))
    back = fill.select("y", "x", F.col(value).alias("_b"))
    out = px.join(marked, PIXEL, "left").join(back, ["y", "x"], "left")
    return out.withColumn(value, F.when(F.col("_m") == 1, F.coalesce("_b", value)).otherwise(F.col(value))).drop("_m", "_b")


def debug_overlay(px: DataFrame, pixels: DataFrame, colour: int = 255) -> DataFrame:
    """Samples with the masked ones half covered by ``colour``."""
    marked = pixels.select(*PIXEL, F.lit(1).alias("_m"))
    seen = F.when(F.col("_m") == 1, F.floor(0.5 * colour + 0.5 * F.col("v")).cast("int")).otherwise(F.col("v"))
    return px.join(marked, PIXEL, "left").withColumn("v", seen).drop("_m")


def over_frames(px: DataFrame, measure: Callable[[np.ndarray], np.ndarray], name: str, values: tuple[str, ...] = ("v",)) -> DataFrame:
    """Run a dense kernel on each frame: ``(f, y, x, name)`` for all its pixels.

    The kernel gets the frame as an array (height, width, channels), with NaN
    where a pixel is missing, and returns one plane.
    """

    def kernel(t: pa.Table) -> pa.Table:
        f, y, x = (t.column(c).to_numpy() for c in PIXEL)
        v = np.column_stack([t.column(c).to_numpy().astype(np.float64) for c in values])
        out = np.zeros(len(f))
        at = starts_of(f)
        for lo, hi in zip(at, np.append(at[1:], len(f)), strict=True):
            s = slice(lo, hi)
            plane = np.full((y[s].max() + 1, x[s].max() + 1, len(values)), np.nan)
            plane[y[s], x[s]] = v[s]
            out[s] = measure(plane)[y[s], x[s]]
        return pa.table([t.column("f"), t.column("y"), t.column("x"), pa.array(out)], names=[*PIXEL, name])

    kind = px.schema["f"].dataType.simpleString()
    return per_frame(px.select(*PIXEL, *values), ["f"], kernel, f"f {kind}, y int, x int, {name} double")


def box_median(plane: np.ndarray, size: int) -> np.ndarray:
    """Spatial median with replicated borders, the centre included; a strip of rows at a time."""
    r = size // 2
    wide = np.pad(plane, r, mode="edge")
    windows = np.lib.stride_tricks.sliding_window_view(wide, (size, size))
    step = max(1, (1 << 22) // (plane.shape[1] * size * size))
    return np.concatenate([np.median(windows[at : at + step], axis=(2, 3)) for at in range(0, len(plane), step)])


def box_sum(plane: np.ndarray, size: int) -> np.ndarray:
    """Sums over a square with replicated borders, from an integral image."""
    r = size // 2
    total = np.pad(np.pad(plane, r, mode="edge").cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    return total[size:, size:] - total[:-size, size:] - total[size:, :-size] + total[:-size, :-size]


def ring_mean(plane: np.ndarray, outer: int, inner: int) -> np.ndarray:
    """Mean between two squares of odd sides, borders replicated."""
    return (box_sum(plane, outer) - box_sum(plane, inner)) / (outer * outer - inner * inner)


def inside_ring_mean(plane: np.ndarray, low: int, high: int) -> np.ndarray:
    """Mean of the in-image pixels at Chebyshev distance ``low`` to ``high``."""

    def sums(p: np.ndarray, r: int) -> np.ndarray:
        total = np.pad(np.pad(p, r).cumsum(0).cumsum(1), ((1, 0), (1, 0)))
        n = 2 * r + 1
        return total[n:, n:] - total[:-n, n:] - total[n:, :-n] + total[:-n, :-n]

    one = np.ones_like(plane)
    return (sums(plane, high) - sums(plane, low - 1)) / (sums(one, high) - sums(one, low - 1))

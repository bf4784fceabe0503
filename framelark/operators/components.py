"""Connected components of masks, and what is measured on them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelark.operators._frames import per_frame, roots
from framelark.operators.pixels import ellipse

#: Pixel rows are this far apart in a label.
ROW = 1 << 20


def labelled(mask: DataFrame) -> DataFrame:
    """``(f, y, x, label)``: 8-connected components; a label is the least ``y * ROW + x``."""

    def kernel(t: pa.Table) -> pa.Table:
        f, y, x = (t.column(c).to_numpy().astype(np.int64) for c in ("f", "y", "x"))
        frame = np.cumsum(np.append(True, f[1:] != f[:-1])) - 1
        wide = int(x.max() - x.min()) + 3 if len(x) else 1
        high = int(y.max() - y.min()) + 3 if len(y) else 1
        key = (frame * high + y - y.min() + 1) * wide + x - x.min() + 1
        pairs = []
        for step in (1, wide - 1, wide, wide + 1):
            at = np.searchsorted(key, key + step)
            at[at == len(key)] = 0
            hit = np.nonzero(key[at] == key + step)[0]
            pairs.append((hit, at[hit]))
        root = roots(len(key), np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs]))
        label = (y * ROW + x)[root]  # rows are in order, so the root is the first pixel
        return pa.table([t.column("f"), t.column("y"), t.column("x"), pa.array(label)], names=["f", "y", "x", "label"])

    kind = mask.schema["f"].dataType.simpleString()
    pixels = mask.select("f", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x")).distinct()
    return per_frame(pixels, ["f"], kernel, f"f {kind}, y int, x int, label bigint", ["y", "x"])


def stats(pixels: DataFrame) -> DataFrame:
    """Area, box and centroid (half to even) of every label."""
    return pixels.groupBy("f", "label").agg(
        F.count("*").alias("area"),
        F.min("x").alias("left_x"),
        F.min("y").alias("top_y"),
        (F.max("x") - F.min("x") + 1).alias("width"),
        (F.max("y") - F.min("y") + 1).alias("height"),
        F.bround(F.avg("x")).cast("int").alias("cx"),
        F.bround(F.avg("y")).cast("int").alias("cy"),
    )


def small_filter(pixels: DataFrame, least: int, colours: DataFrame | None = None) -> DataFrame:
    """Pixels of components of at least ``least`` pixels, or of reddish ones.

    ``colours(f, y, x, b, g, r)`` gives the mean colour of a component; reddish
    is a mean red above 80 and above 1.5 times both others.
    """
    if colours is None:
        keep = pixels.groupBy("f", "label").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    else:
        mean = pixels.join(colours, ["f", "y", "x"], "left").groupBy("f", "label").agg(
            F.count("*").alias("n"), *[F.avg(c).alias(c) for c in ("b", "g", "r")]
        )
        keep = mean.where((F.col("n") >= least) | F.coalesce(reddish(), F.lit(False)))
    return pixels.join(keep.select("f", "label"), ["f", "label"], "left_semi")


def reddish():
    r = F.col("r")
    return (r > 80) & (r > 1.5 * F.col("g")) & (r > 1.5 * F.col("b"))


def trails_per_frame(pixels: DataFrame) -> DataFrame:
    """``(f, trails, pixels)`` of frames that have any component."""
    parts = pixels.groupBy("f", "label").agg(F.count("*").alias("n"))
    return parts.groupBy("f").agg(F.count("*").alias("trails"), F.sum("n").alias("pixels"))


def run_rollup(per_frame_counts: DataFrame, batch: int = 20) -> DataFrame:
    """Totals by batch of frames and, with a null batch, of the whole run."""
    n = per_frame_counts.withColumn("batch", F.floor(F.col("f") / batch).cast("bigint"))
    return n.rollup("batch").agg(
        F.count("*").alias("frames_with_trails"),
        F.sum("trails").alias("trails"),
        F.sum("pixels").alias("pixels"),
        F.expr("sum(pixels) div count(*)").alias("mean_pixels"),
    )


def overlaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(f, a, b, shared)``: pixels that two labelled sets share."""
    left = a.select("f", "y", "x", F.col("label").alias("a"))
    right = b.select("f", "y", "x", F.col("label").alias("b"))
    return left.join(right, ["f", "y", "x"]).groupBy("f", "a", "b").agg(F.count("*").alias("shared"))


def touched(blobs: DataFrame, components: DataFrame) -> DataFrame:
    """For each blob (already dilated) the component it shares most pixels with."""
    n = overlaps(blobs, components)
    return n.groupBy("f", "a").agg(F.max_by("b", F.struct("shared", -F.col("b"))).alias("b"), F.max("shared").alias("shared"))


def axes(points: DataFrame, *keys: str) -> DataFrame:
    """Principal axes of points ``(x, y)`` by ``keys`` (three points at least).

    ``n, mx, my, angle`` (degrees, 0 to 180), ``length`` and ``thick`` (extent
    along and across, thick at least 1), ``aspect``, and ``major``/``minor``
    (the larger and smaller variance).
    """
    first = points.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg("x").alias("mx"),
        F.avg("y").alias("my"),
        F.var_samp("x").alias("a"),
        F.covar_samp("x", "y").alias("b"),
        F.var_samp("y").alias("c"),
    )
    first = first.where("n >= 3")
    half, gap = (F.col("a") + F.col("c")) / 2, F.sqrt(F.pow((F.col("a") - F.col("c")) / 2, 2) + F.pow(F.col("b"), 2))
    first = first.select(
        *keys, "n", "mx", "my", (half + gap).alias("major"), F.greatest(half - gap, F.lit(0.0)).alias("minor"),
        (F.atan2(2 * F.col("b"), F.col("a") - F.col("c")) / 2).alias("t"),
    )
    near = points.join(first, list(keys))
    p = (F.col("x") - F.col("mx")) * F.cos("t") + (F.col("y") - F.col("my")) * F.sin("t")
    q = (F.col("y") - F.col("my")) * F.cos("t") - (F.col("x") - F.col("mx")) * F.sin("t")
    out = near.groupBy(*keys, "n", "mx", "my", "major", "minor", "t").agg(
        (F.max(p) - F.min(p)).alias("length"), F.greatest(F.max(q) - F.min(q), F.lit(1.0)).alias("thick")
    )
    angle = F.pmod(F.degrees("t"), F.lit(180.0))
    return out.select(*keys, "n", "mx", "my", "major", "minor", angle.alias("angle"), "length", "thick", (F.col("length") / F.col("thick")).alias("aspect"))


def elongation(points: DataFrame, *keys: str, least: int = 3) -> DataFrame:
    """Ratio of the axes' standard deviations, the smaller at least 0.5."""
    a, b, c = F.var_samp("x"), F.covar_samp("x", "y"), F.var_samp("y")
    half, gap = (a + c) / 2, F.sqrt(F.pow((a - c) / 2, 2) + F.pow(b, 2))
    ratio = F.sqrt(half + gap) / F.greatest(F.lit(0.5), F.sqrt(F.greatest(half - gap, F.lit(0.0))))
    return points.groupBy(*keys).agg(F.count("*").alias("n"), ratio.alias("elongation")).where(F.col("n") >= least)


def plausible(shapes: DataFrame, large: int = 1500, aspect: float = 5, bright: float = 0.03) -> DataFrame:
    """Components that are small, long, or bright enough (``bright_frac``)."""
    return shapes.where((F.col("area") < large) | (F.col("aspect") >= aspect) | (F.col("bright_frac") >= bright))


#: Limits of the trim (fixed values): box growth, deviations, pixels of sky, of a blob and of what is kept, dilation.
TRIM = {"grow": 1.5, "sigma": 2.0, "sky": 100, "blob": 50, "keep": 30, "dilate": 3}


def brightness_trim(pixels: DataFrame, px: DataFrame, limits: dict = TRIM) -> DataFrame:
    """``(f, y, x, label)``: each component's pixels above the sky around it.

    The sky are the other pixels of a box that has grown around the component;
    with too few of them it stays as it is.  Above the sky's median by so many
    deviations (by its MAD), blobs that are large enough stay, are dilated
    inside the component, and go altogether if too little is left.  A frame is
    one array in its task.
    """

    def kernel(t: pa.Table) -> pa.Table:
        f, y, x, v = (t.column(c).to_numpy() for c in ("f", "y", "x", "v"))
        label = np.nan_to_num(t.column("label").to_numpy(zero_copy_only=False).astype(float), nan=-1).astype(np.int64)
        out: list[np.ndarray] = []
        at = np.nonzero(np.append(True, f[1:] != f[:-1]))[0] if len(f) else []
        for lo, hi in zip(at, np.append(at[1:], len(f)), strict=True):
            ys, xs = y[lo:hi], x[lo:hi]
            plane, tag = np.full((ys.max() + 1, xs.max() + 1), np.nan), np.full((ys.max() + 1, xs.max() + 1), -1, np.int64)
            plane[ys, xs], tag[ys, xs] = v[lo:hi], label[lo:hi]
            own = np.nonzero(label[lo:hi] >= 0)[0]
            order = own[np.argsort(label[lo:hi][own], kind="stable")]
            cut = np.nonzero(np.append(True, np.diff(label[lo:hi][order]) != 0))[0] if len(order) else []
            for a, b in zip(cut, np.append(cut[1:], len(order)), strict=True):
                rows = order[a:b]
                py, px_ = ys[rows], xs[rows]
                stay = _trimmed(plane, tag == label[lo:hi][rows[0]], py, px_, limits)
                out.append(lo + rows[stay[py, px_]])
        keep = np.sort(np.concatenate(out)) if out else np.zeros(0, np.int64)
        names = ["f", "y", "x"]
        return pa.table([*(t.column(c).take(pa.array(keep)) for c in names), pa.array(label[keep])], names=[*names, "label"])

    kind = px.schema["f"].dataType.simpleString()
    rows = px.select("f", "y", "x", "v").join(pixels.select("f", "y", "x", "label"), ["f", "y", "x"], "left")
    rows = rows.join(pixels.select("f").distinct(), "f", "left_semi")
    return per_frame(rows.select("f", "y", "x", "v", "label"), ["f"], kernel, f"f {kind}, y int, x int, label bigint", ["y", "x"])


def _trimmed(plane: np.ndarray, own: np.ndarray, ys: np.ndarray, xs: np.ndarray, limits: dict) -> np.ndarray:
    high, wide = np.ptp(ys), np.ptp(xs)
    by, bx = (int(n * (limits["grow"] - 1) / 2) for n in (high, wide))
    box = (slice(max(0, ys.min() - by), ys.max() + by + 1), slice(max(0, xs.min() - bx), xs.max() + bx + 1))
    sky = plane[box][~own[box]]
    sky = sky[~np.isnan(sky)]
    if len(sky) < limits["sky"]:
        return own
    base = np.median(sky)
    bright = own & (plane > base + limits["sigma"] * 1.4826 * np.median(np.abs(sky - base)))
    spots = np.argwhere(bright)
    at = np.full(plane.shape, -1)
    at[tuple(spots.T)] = np.arange(len(spots))
    wider = np.pad(at, 1, constant_values=-1)
    pairs = [(at, wider[1 + dy : 1 + dy + plane.shape[0], 1 + dx : 1 + dx + plane.shape[1]]) for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1))]
    pairs = [(a[(a >= 0) & (b >= 0)], b[(a >= 0) & (b >= 0)]) for a, b in pairs]
    root = roots(len(spots), np.concatenate([a for a, _ in pairs]), np.concatenate([b for _, b in pairs]))
    large = np.bincount(root, minlength=len(spots))[root] >= limits["blob"]
    left = np.zeros_like(own)
    left[tuple(spots[large].T)] = True
    r = limits["dilate"]
    grown = np.zeros_like(own)
    for dy, dx in ellipse(2 * r + 1) if left.any() else ():
        y0, y1 = max(0, dy), plane.shape[0] + min(0, dy)
        x0, x1 = max(0, dx), plane.shape[1] + min(0, dx)
        grown[y0:y1, x0:x1] |= left[y0 - dy : y1 - dy, x0 - dx : x1 - dx]
    left = grown & own
    return left if left.sum() >= limits["keep"] else np.zeros_like(own)

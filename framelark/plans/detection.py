"""Detection as a whole: candidates, verified motion, tiles with a detector."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelark.functions import pixel
from framelark.operators import components, geometry, kernels, motion, pixels, temporal
from framelark.operators._frames import per_frame, starts_of


def candidates(bgr: DataFrame, threshold: int, least: int, margin: int, width: int, height: int, most: int = 2000, gain: DataFrame | None = None) -> DataFrame:
    """``(f, ch, x, y, peak)``: centres of what shines up in one frame only, by channel class.

    Colour is the larger of the red and green advantage, gray the luminance.
    A candidate's ``peak`` is the value at its rounded centre, 0 if that lies
    outside it; of a frame and class the ``most`` largest stay.
    """
    b, g, r = F.col("b"), F.col("g"), F.col("r")
    levels = {"color": F.greatest(pixel.advantage(r, g, b), pixel.advantage(g, r, b)), "gray": pixel.gray(b, g, r)}
    sides = []
    for ch, level in levels.items():
        px = bgr.select("f", "y", "x", level.alias("v"))
        px = temporal.neighbour_difference(temporal.with_gain(px, gain) if gain is not None else px)
        bright = px.where(F.col("d") > threshold).select("f", "y", "x", "d")
        spots = components.stats(components.labelled(bright)).where(F.col("area") >= least)
        spots = spots.select("f", F.col("cx").alias("x"), F.col("cy").alias("y"))
        spots = spots.join(bright, ["f", "y", "x"], "left").select("f", F.lit(ch).alias("ch"), "x", "y", F.coalesce("d", F.lit(0)).alias("peak"))
        sides.append(motion.within_margin(spots, margin, width, height))
    return motion.strongest(sides[0].unionByName(sides[1]), most)


def verified_motion(
    obs: DataFrame, frames: int, nearest: int, farthest: int, bin_size: int, votes: int, each: int,
    look_ahead: int, tolerance: int, radius: float, least: int, elongation: float, cell: int, share: float,
) -> DataFrame:
    """``(f, x, y)``: observations that belong to verified, elongated and passing motion."""
    moves = motion.pairs(obs, nearest, farthest)
    top = motion.peaks(motion.histogram(moves, bin_size, farthest), bin_size, farthest, votes, each)
    found = motion.chain_verified(motion.members(moves, top, bin_size), obs, look_ahead, tolerance, frames)
    groups = motion.clusters(found, radius)
    kept = groups.join(motion.long_clusters(groups, least, elongation).select("f", "label"), ["f", "label"], "left_semi")
    return motion.not_persistent(kept.select("f", "x", "y"), cell, share, frames)


def continuous_trails(
    px: DataFrame, sky: DataFrame, threshold: int, votes: int, star_angle: float, star_tolerance: float, angle: float, distance: float, band: int, edge: int, width: int, height: int
) -> DataFrame:
    """``(f, x, y)`` along lines that show in the residual of neighbouring frames too."""
    bright = temporal.residual(px, sky).where(F.col("d") > threshold)
    lines = geometry.hough(bright.select("f", "y", "x"), least=votes)
    lines = geometry.not_parallel(lines, star_angle, star_tolerance)
    lines = geometry.matched_lines(lines, angle, distance)
    t = F.radians("angle")
    along = F.col("x") * F.cos(t) + F.col("y") * F.sin(t)
    off = F.col("y") * F.cos(t) - F.col("x") * F.sin(t)
    # pixels meet the lines of their frame and direction in bands of one pixel across
    turns = F.broadcast(lines.select("angle").distinct())  # at most as many as directions are counted
    spots = bright.select("f", "y", "x").crossJoin(turns).withColumn("_band", F.floor(off).cast("bigint"))
    near = lines.withColumn("_band", F.explode(F.sequence(F.floor(F.col("rho") - 1).cast("bigint"), F.floor(F.col("rho") + 1).cast("bigint"))))
    ends = spots.join(near, ["f", "angle", "_band"]).where(F.abs(off - F.col("rho")) <= 1)
    ends = ends.groupBy("f", "angle", "rho").agg(F.min(along).alias("p"), F.max(along).alias("q"))
    at = lambda c: ((F.col(c) * F.cos(t) - F.col("rho") * F.sin(t)), (F.col(c) * F.sin(t) + F.col("rho") * F.cos(t)))
    (x1, y1), (x2, y2) = at("p"), at("q")
    segments = ends.select("f", x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))
    return geometry.segment_points(segments, band, edge, width, height)


def tiled(samples: DataFrame, detector: Callable[[np.ndarray], list[tuple[float, np.ndarray]]], width: int, height: int, tile: int = 640, overlap: float = 0.2) -> DataFrame:
    """``(f, det_id, s, x0, y0, x1, y1, ys, xs)``: a detector run on overlapping tiles.

    ``detector`` gets a tile (height, width, BGR of 8 bits) and returns scores
    with boolean masks; their pixels come back in places of the frame.
    """
    spark = samples.sparkSession
    tiles = geometry.tile_origins(spark.createDataFrame([(width, height)], "w int, h int"), tile, overlap)

    def kernel(t: pa.Table) -> pa.Table:
        f, x0, y0, y, x = (t.column(c).to_numpy() for c in ("f", "x0", "y0", "y", "x"))
        v = np.column_stack([t.column(c).to_numpy() for c in ("b", "g", "r")])
        rows = []
        at = starts_of(f, x0, y0)
        for lo, hi in zip(at, np.append(at[1:], len(f)), strict=True):
            s = slice(lo, hi)
            image = np.zeros((min(tile, height - y0[lo]), min(tile, width - x0[lo]), 3), np.uint8)
            image[y[s] - y0[lo], x[s] - x0[lo]] = np.clip(v[s], 0, 255)
            for k, (score, mask) in enumerate(detector(image)):
                ys, xs = np.nonzero(mask)
                if len(ys):
                    ys, xs = ys + y0[lo], xs + x0[lo]
                    rows.append((f[lo], f"{x0[lo]}-{y0[lo]}-{k}", float(score), xs.min(), ys.min(), xs.max() + 1, ys.max() + 1, ys.tolist(), xs.tolist()))
        cols = list(zip(*rows, strict=True)) if rows else [()] * 9
        many = pa.list_(pa.int32())
        kinds = (t.schema.field("f").type, pa.string(), pa.float64(), *[pa.int32()] * 4, many, many)
        names = ["f", "det_id", "s", "x0", "y0", "x1", "y1", "ys", "xs"]
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    kind = samples.schema["f"].dataType.simpleString()
    schema = f"f {kind}, det_id string, s double, x0 int, y0 int, x1 int, y1 int, ys array<int>, xs array<int>"
    placed = geometry.in_tiles(samples, tiles, tile)
    return per_frame(placed.select("f", "x0", "y0", "y", "x", "b", "g", "r"), ["f", "x0", "y0"], kernel, schema)


def detected_mask(found: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``(f, y, x)`` of the detections that greedy suppression keeps."""
    boxes = geometry.ranked(found)
    kept = boxes.join(geometry.suppressed(boxes, threshold), ["f", "rk"], "left_semi")
    return kept.select("f", F.explode(F.arrays_zip("ys", "xs")).alias("p")).select("f", F.col("p.ys").alias("y"), F.col("p.xs").alias("x")).distinct()


def dual_masks(found: DataFrame, threshold: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """``(f, y, x)`` of one set of detections after suppression, and after merging, of which the first is part."""
    boxes = geometry.ranked(found)
    roots = geometry.merged_boxes(boxes, threshold)
    spots = boxes.join(roots, ["f", "rk"]).select("f", F.explode(F.arrays_zip("ys", "xs")).alias("p"))
    merged = spots.select("f", F.col("p.ys").alias("y"), F.col("p.xs").alias("x")).distinct()
    return detected_mask(found, threshold), merged


def at_seams(parts: DataFrame, width: int, height: int, tile: int = 640, overlap: float = 0.2, reach: int = 8) -> DataFrame:
    """``(f, label)`` of the parts whose box ends at an inner seam between tiles."""
    spark = parts.sparkSession
    rows = geometry.tile_origins(spark.createDataFrame([(width, height)], "w int, h int"), tile, overlap).collect()  # tiles of one frame
    inner = lambda starts, size: sorted({v for s in starts for v in (s, s + tile) if 0 < v < size})
    seams = inner({r.x0 for r in rows}, width), inner({r.y0 for r in rows}, height)
    box = components.stats(parts).select(
        "f", "label", F.col("left_x").alias("x0"), F.col("top_y").alias("y0"),
        (F.col("left_x") + F.col("width")).alias("x1"), (F.col("top_y") + F.col("height")).alias("y1"),
    )
    return geometry.near_seams(box, *seams, reach).select("f", "label")


def axis_extended(
    parts: DataFrame, blobs: DataFrame, height: int, width: int, least: int = 30, most: float = 3.0, share: float = 0.9,
    truncated: DataFrame | None = None,
) -> DataFrame:
    """Labelled ``parts`` drawn out along their axis over the ``blobs`` that touch them.

    With ``truncated(f, label)`` (see ``at_seams``) only those parts grow.

    A blob counts if it has ``least`` pixels and at most ``most`` times its
    part's; the drawn band has ``share`` of the part's thickness.
    """
    wide = pixels.dilated(blobs.select("f", "y", "x"), pixels.square(5), height, width)
    near = components.touched(components.labelled(wide).select("f", "y", "x", "label"), parts)
    grown = components.labelled(wide).withColumnRenamed("label", "a").join(near.select("f", "a", F.col("b").alias("label")), ["f", "a"])
    sizes = parts.groupBy("f", "label").agg(F.count("*").alias("own"))
    inner = grown.join(blobs.select("f", "y", "x"), ["f", "y", "x"], "left_semi")
    counts = inner.groupBy("f", "label").agg(F.count("*").alias("n")).join(sizes, ["f", "label"])
    fits = counts.where((F.col("n") >= least) & (F.col("n") <= most * F.col("own"))).select("f", "label")
    if truncated is not None:
        fits = fits.join(truncated, ["f", "label"], "left_semi")
    axes = components.axes(parts, "f", "label").join(fits, ["f", "label"], "left_semi").withColumn("t", F.radians("angle"))
    along = (F.col("x") - F.col("mx")) * F.cos("t") + (F.col("y") - F.col("my")) * F.sin("t")
    both = parts.select("f", "label", "y", "x").union(inner.select("f", "label", "y", "x"))
    reach = both.join(axes, ["f", "label"]).groupBy("f", "label", "mx", "my", "t", "thick").agg(F.min(along).alias("lo"), F.max(along).alias("hi"))
    p = F.explode(F.sequence(F.floor(F.col("lo") * 2), F.ceil(F.col("hi") * 2))).alias("p")
    line = reach.select("*", p)
    half = F.floor(F.col("thick") * share).cast("int")
    line = line.withColumn("q", F.explode(F.sequence(-half, half)))
    x = F.bround(F.col("mx") + F.col("p") / 2 * F.cos("t") - F.col("q") / 2 * F.sin("t")).cast("int")
    y = F.bround(F.col("my") + F.col("p") / 2 * F.sin("t") + F.col("q") / 2 * F.cos("t")).cast("int")
    drawn = line.select("f", "label", y.alias("y"), x.alias("x"))
    drawn = drawn.where(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1))
    return parts.select("f", "label", "y", "x").union(drawn).distinct()


def cleaned_frames(bgr: DataFrame, mask: DataFrame, least: int = 1, pad: int = 60) -> DataFrame:
    """``(f, y, x, b, g, r)`` with the masked trails repaired from the frames around."""
    parts = components.small_filter(components.labelled(mask), least).select("f", "y", "x", "label")
    out = bgr
    for c in ("b", "g", "r"):
        fixed = kernels.repaired_by_bridge(bgr.select("f", "y", "x", F.col(c).alias("v")), parts, pad)
        fixed = fixed.withColumnRenamed("repaired", "_new")
        out = out.join(fixed, ["f", "y", "x"], "left").withColumn(c, F.coalesce("_new", c)).drop("_new")
    return out

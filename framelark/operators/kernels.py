"""Dense numeric kernels on frames: shifts, warps, repair and filling."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelark.operators._frames import per_frame, starts_of


def phase_shift(a: np.ndarray, b: np.ndarray, window: bool = True) -> tuple[float, float, float]:
    """``(dx, dy, response)``: how far ``b`` is moved against ``a``.

    Phase correlation under a Hann window; the peak is the centroid of the 5 x 5
    around the largest value, the response its share of all.
    """
    a, b = a.astype(float), b.astype(float)
    if window and min(a.shape) > 2:
        w = np.outer(np.hanning(a.shape[0]), np.hanning(a.shape[1]))
        a, b = a * w, b * w
    cross = np.fft.fft2(a).conj() * np.fft.fft2(b)
    size = np.abs(cross)
    r = np.fft.fftshift(np.fft.ifft2(np.where(size > 1e-12, cross / np.maximum(size, 1e-12), 0)).real)
    y, x = np.unravel_index(np.argmax(r), r.shape)
    ys, xs = slice(max(0, y - 2), y + 3), slice(max(0, x - 2), x + 3)
    near = np.maximum(r[ys, xs], 0)
    gy, gx = np.mgrid[ys.start : ys.start + near.shape[0], xs.start : xs.start + near.shape[1]]
    total = near.sum()
    if total <= 0:
        return 0.0, 0.0, 0.0
    return float((gx * near).sum() / total - r.shape[1] // 2), float((gy * near).sum() / total - r.shape[0] // 2), float(total)


def moved(plane: np.ndarray, dx: float, dy: float, border: str = "edge") -> np.ndarray:
    """Bilinear translation: content goes ``dx`` right and ``dy`` down; ``border`` as in numpy.pad."""
    h, w = plane.shape[:2]
    r = int(np.ceil(max(abs(dx), abs(dy)))) + 1
    if border == "reflect":
        r = min(r, h - 1, w - 1) if min(h, w) > 1 else 0
    wide = np.pad(plane.astype(float), ((r, r), (r, r)) + ((0, 0),) * (plane.ndim - 2), mode=border if r else "edge")
    y = np.clip(np.arange(h) - dy + r, 0, h + 2 * r - 1)
    x = np.clip(np.arange(w) - dx + r, 0, w + 2 * r - 1)
    y0, x0 = np.minimum(np.floor(y).astype(int), h + 2 * r - 2), np.minimum(np.floor(x).astype(int), w + 2 * r - 2)
    extra = (1,) * (plane.ndim - 2)
    fy, fx = (y - y0).reshape(-1, 1, *extra), (x - x0).reshape(1, -1, *extra)
    top = wide[y0][:, x0] * (1 - fx) + wide[y0][:, x0 + 1] * fx
    low = wide[y0 + 1][:, x0] * (1 - fx) + wide[y0 + 1][:, x0 + 1] * fx
    return top * (1 - fy) + low * fy


def harmonic_fill(plane: np.ndarray, hole: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Fill ``hole`` with the harmonic surface of its rim (an approximation of flow inpainting)."""
    out = plane.astype(float).copy()
    if not hole.any() or hole.all():
        return out
    out[hole] = out[~hole].mean()
    for _ in range(rounds):
        wide = np.pad(out, 1, mode="edge")
        mean = (wide[:-2, 1:-1] + wide[2:, 1:-1] + wide[1:-1, :-2] + wide[1:-1, 2:]) / 4
        change = np.abs(mean[hole] - out[hole]).max()
        out[hole] = mean[hole]
        if change < 1e-3:
            break
    return out


def repaired_component(
    here: np.ndarray, mask: np.ndarray, before: np.ndarray | None, after: np.ndarray | None, pad: int = 60, response: float = 0.3
) -> np.ndarray:
    """``here`` with one component's pixels taken from the frames around.

    Within the padded box both neighbours are moved half way towards each other
    along their phase shift and averaged (plainly averaged if the response is
    low); a single neighbour is copied; without any nothing changes.
    """
    out = here.copy()
    if before is None and after is None or not mask.any():
        return out
    ys, xs = np.nonzero(mask)
    box = (slice(max(0, ys.min() - pad), ys.max() + pad + 1), slice(max(0, xs.min() - pad), xs.max() + pad + 1))
    if before is None or after is None:
        fill = (before if after is None else after)[box].astype(float)
    else:
        p, n = before[box].astype(float), after[box].astype(float)
        flat = (lambda v: v.mean(axis=2) if v.ndim == 3 else v)
        dx, dy, r = phase_shift(flat(p), flat(n))
        if r >= response:
            p, n = moved(p, dx / 2, dy / 2, "reflect"), moved(n, -dx / 2, -dy / 2, "reflect")
        fill = (p + n) / 2
    part = mask[box]
    out[box][part] = np.floor(fill[part]).astype(here.dtype)
    return out


def repaired_by_bridge(px: DataFrame, labelled: DataFrame, pad: int = 60, response: float = 0.3) -> DataFrame:
    """``(f, y, x, repaired)`` of the labelled pixels, from the frames before and after.

    Frames travel with their neighbours: each row goes to the frame it belongs
    to and to the two beside it, so a task never needs more than three frames.
    """
    near = px.select(F.explode(F.array(F.col("f") - 1, F.col("f"), F.col("f") + 1)).alias("frame"), "f", "y", "x", "v")
    frames = labelled.select(F.col("f").alias("frame")).distinct()
    near = near.join(frames, "frame", "left_semi")
    tags = labelled.select(F.col("f").alias("frame"), "f", "y", "x", "label")
    rows = near.join(tags, ["frame", "f", "y", "x"], "left")

    def kernel(t: pa.Table) -> pa.Table:
        g, f, y, x, v = (t.column(c).to_numpy() for c in ("frame", "f", "y", "x", "v"))
        label = t.column("label").to_numpy(zero_copy_only=False)
        label = np.where(np.isnan(label.astype(float)), -1, label.astype(float)).astype(np.int64)
        out: list[tuple] = []
        at = starts_of(g)
        for lo, hi in zip(at, np.append(at[1:], len(g)), strict=True):
            h, w = int(y[lo:hi].max()) + 1, int(x[lo:hi].max()) + 1
            planes: dict[int, np.ndarray] = {}
            tag = np.full((h, w), -1, dtype=np.int64)
            for d in (-1, 0, 1):
                s = lo + np.nonzero(f[lo:hi] == g[lo] + d)[0]
                if len(s):
                    planes[d] = np.zeros((h, w), dtype=np.int64)
                    planes[d][y[s], x[s]] = v[s]
                if d == 0:
                    tag[y[s], x[s]] = label[s]
            done = planes[0].copy()
            ys, xs = np.nonzero(tag >= 0)
            order = np.argsort(tag[ys, xs], kind="stable")
            ys, xs = ys[order], xs[order]
            for s in np.split(np.arange(len(ys)), np.nonzero(np.diff(tag[ys, xs]))[0] + 1):
                box = (slice(max(0, ys[s].min() - pad), ys[s].max() + pad + 1), slice(max(0, xs[s].min() - pad), xs[s].max() + pad + 1))
                sides = [planes[d][box] if d in planes else None for d in (-1, 1)]
                done[box] = repaired_component(done[box], tag[box] == tag[ys[s[0]], xs[s[0]]], *sides, pad, response)
            out.append((np.full(len(ys), g[lo]), ys, xs, done[ys, xs]))
        kinds = (t.schema.field("frame").type, pa.int32(), pa.int32(), pa.int32())
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4
        return pa.table([pa.array(c).cast(k) for c, k in zip(cols, kinds, strict=True)], names=["f", "y", "x", "repaired"])

    kind = px.schema["f"].dataType.simpleString()
    return per_frame(rows.select("frame", "f", "y", "x", "v", "label"), ["frame"], kernel, f"f {kind}, y int, x int, repaired int", ["f", "y", "x"])


def middle_frame(px: DataFrame):
    """The frame in the middle of the sequence: of ``n`` the one with ``n // 2`` before it."""
    frames = px.select("f").distinct()
    n = frames.count()
    return frames.orderBy("f").limit(n // 2 + 1).agg(F.max("f")).first()[0]


def _reference(px: DataFrame, reference: int):
    """One frame as an array, sent once to every executor."""
    t = px.where(F.col("f") == reference).select("y", "x", "v").toArrow()
    y, x, v = (t.column(c).to_numpy() for c in ("y", "x", "v"))
    base = np.zeros((int(y.max()) + 1, int(x.max()) + 1) if len(y) else (1, 1))
    base[y, x] = v
    return px.sparkSession.sparkContext.broadcast(base)


def aligned(px: DataFrame, reference: int | None = None) -> DataFrame:
    """``(f, dx, dy, response)``: the shift of each frame against a reference frame (the middle one).

    The reference frame (one frame) is broadcast.
    """
    sent = _reference(px, middle_frame(px) if reference is None else reference)

    def kernel(t: pa.Table) -> pa.Table:
        f, y, x, v = (t.column(c).to_numpy() for c in ("f", "y", "x", "v"))
        at = starts_of(f)
        out = []
        for lo, hi in zip(at, np.append(at[1:], len(f)), strict=True):
            plane = np.zeros_like(sent.value)
            plane[y[lo:hi], x[lo:hi]] = v[lo:hi]
            out.append((f[lo], *phase_shift(sent.value, plane)))
        cols = list(zip(*out, strict=True))
        kinds = (t.schema.field("f").type, pa.float64(), pa.float64(), pa.float64())
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["f", "dx", "dy", "response"])

    kind = px.schema["f"].dataType.simpleString()
    return per_frame(px.select("f", "y", "x", "v"), ["f"], kernel, f"f {kind}, dx double, dy double, response double", ["y", "x"])


def _dense(px: DataFrame, change, border_rows: list[str]) -> DataFrame:
    """``(f, y, x, v)`` of frames that ``change(plane, figures)`` has made anew; figures are constant in a frame."""

    def kernel(t: pa.Table) -> pa.Table:
        f, y, x, v = (t.column(c).to_numpy() for c in ("f", "y", "x", "v"))
        extra = [t.column(c).to_numpy(zero_copy_only=False) for c in border_rows]
        out = np.zeros(len(f))
        at = starts_of(f)
        for lo, hi in zip(at, np.append(at[1:], len(f)), strict=True):
            s = slice(lo, hi)
            plane = np.zeros((int(y[s].max()) + 1, int(x[s].max()) + 1))
            plane[y[s], x[s]] = v[s]
            out[s] = change(plane, *(c[lo] for c in extra))[y[s], x[s]]
        return pa.table([t.column("f"), t.column("y"), t.column("x"), pa.array(out)], names=["f", "y", "x", "v"])

    kind = px.schema["f"].dataType.simpleString()
    return per_frame(px.select("f", "y", "x", "v", *border_rows), ["f"], kernel, f"f {kind}, y int, x int, v double", ["y", "x"])


def translated(px: DataFrame, shifts: DataFrame, border: str = "edge") -> DataFrame:
    """``(f, y, x, v)``: frames moved by their ``shifts(f, dx, dy)``, bilinear, ``border`` as in numpy.pad."""
    moves = px.join(shifts.select("f", "dx", "dy"), "f")
    return _dense(moves, lambda plane, dx, dy: moved(plane, float(dx), float(dy), border), ["dx", "dy"])


def aligned_frames(px: DataFrame, reference: int | None = None) -> DataFrame:
    """``(f, y, x, v)``: all frames moved onto the reference frame (the middle one), borders replicated."""
    back = aligned(px, reference).select("f", (-F.col("dx")).alias("dx"), (-F.col("dy")).alias("dy"))
    return translated(px, back)


def inpainted(px: DataFrame, mask: DataFrame, rounds: int = 400) -> DataFrame:
    """``(f, y, x, v)``: masked pixels of each frame filled from their rim (see ``harmonic_fill``).

    Frames without a masked pixel are left as they are; others hold NaN inside
    the hole while they are an array in their task.
    """
    marked = mask.select("f", "y", "x", F.lit(1).alias("_m"))
    rows = px.select("f", "y", "x", "v").join(marked, ["f", "y", "x"], "left")
    rows = rows.withColumn("v", F.when(F.col("_m") == 1, F.lit(float("nan"))).otherwise(F.col("v"))).drop("_m")
    return _dense(rows, lambda plane: harmonic_fill(np.nan_to_num(plane), np.isnan(plane), rounds), [])


def star_angle(shifts: DataFrame, least: float = 0.5) -> DataFrame:
    """One row: the median direction of the shifts that are not trivial."""
    from framelark.functions.pixel import line_angle

    far = shifts.where(F.sqrt(F.pow("dx", 2) + F.pow("dy", 2)) >= least)
    return far.agg(F.percentile(line_angle(F.col("dx"), F.col("dy")), F.lit(0.5)).alias("star_angle"))

"""From point observations to verified motion.

Distance joins never compare all points of two frames: points are dealt to
grid cells as wide as the largest distance, and meet those of the nine cells
around under an equi-join.  Spark does not count the rows that such a dealing
adds and would broadcast sides of any size, so these joins ask for a merge.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelark.operators._frames import per_frame, roots
from framelark.operators.components import ROW


def _cell(c: Column, size: int) -> Column:
    return F.floor(c / size).cast("bigint")


def _around(x: Column, y: Column, size: int) -> Column:
    """The nine cells around a point."""
    return F.array(
        *[F.struct((_cell(x, size) + i).alias("gx"), (_cell(y, size) + j).alias("gy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    )


def pairs(obs: DataFrame, nearest: int, farthest: int) -> DataFrame:
    """``(f, ch, x, y, dx, dy)``: points of adjacent frames and one channel.

    Their distance lies between the two limits, both included.
    """
    a = obs.select("f", "ch", "x", "y", F.explode(_around(F.col("x"), F.col("y"), farthest)).alias("g")).select("f", "ch", "x", "y", "g.*")
    b = obs.select(
        (F.col("f") - 1).alias("f"), "ch", F.col("x").alias("x2"), F.col("y").alias("y2"),
        _cell(F.col("x"), farthest).alias("gx"), _cell(F.col("y"), farthest).alias("gy"),
    )
    dx, dy = F.col("x2") - F.col("x"), F.col("y2") - F.col("y")
    out = a.join(b.hint("merge"), ["f", "ch", "gx", "gy"]).select("f", "ch", "x", "y", dx.alias("dx"), dy.alias("dy"))
    return out.where((F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")).between(nearest**2, farthest**2))


def histogram(moves: DataFrame, bin_size: int, farthest: int) -> DataFrame:
    """``(ix, iy, total, color, gray)`` votes by bins of displacement."""
    ix, iy = (F.floor((F.col(c) + farthest) / bin_size).cast("int") for c in ("dx", "dy"))
    return moves.groupBy(ix.alias("ix"), iy.alias("iy")).agg(
        F.count("*").alias("total"), F.count_if(F.col("ch") == "color").alias("color"), F.count_if(F.col("ch") == "gray").alias("gray")
    )


def peaks(votes: DataFrame, bin_size: int, farthest: int, total: int, each: int, reach: int = 2) -> DataFrame:
    """``(dx, dy, votes)`` of bins that no bin within ``reach`` exceeds; plateaus stay."""
    steps = [(i, j) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)]
    near = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps])).alias("s")
    spread = votes.select("ix", "iy", "total", near)
    best = spread.groupBy((F.col("ix") + F.col("s.i")).alias("ix"), (F.col("iy") + F.col("s.j")).alias("iy")).agg(F.max("total").alias("best"))
    top = votes.join(best, ["ix", "iy"]).where(
        (F.col("total") == F.col("best")) & (F.col("total") >= total) & (F.col("color") >= each) & (F.col("gray") >= each)
    )
    centre = lambda c: (F.col(c) * bin_size - farthest + bin_size // 2).cast("int")
    return top.select(centre("ix").alias("dx"), centre("iy").alias("dy"), F.col("total").alias("votes"))


def top_peaks(found: DataFrame, most: int = 10) -> DataFrame:
    """The ``most`` peaks of most votes; equals in row-major order."""
    return found.orderBy(F.desc("votes"), "dx", "dy").limit(most)


def votes_table(votes: DataFrame, floors: tuple[int, ...] = (10, 15, 20, 25, 30)) -> DataFrame:
    """How many bins reach each of the vote floors."""
    rows = [F.struct(F.lit(t).alias("floor"), F.count_if(F.col("total") >= t).alias("bins")) for t in floors]
    return votes.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def members(moves: DataFrame, top: DataFrame, bin_size: int) -> DataFrame:
    """``(dxp, dyp, f, x, y)``: both ends of every pair that a peak explains.

    The peaks are broadcast: there are fewer than bins in the histogram, whose
    number is set by the largest move.
    """
    p = F.broadcast(top.select(F.col("dx").alias("dxp"), F.col("dy").alias("dyp")))
    near = (F.abs(F.col("dx") - F.col("dxp")) <= bin_size) & (F.abs(F.col("dy") - F.col("dyp")) <= bin_size)
    ends = F.array(
        F.struct("f", "x", "y"),
        F.struct((F.col("f") + 1).alias("f"), (F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y")),
    )
    return moves.join(p, near).select("dxp", "dyp", F.explode(ends).alias("e")).select("dxp", "dyp", "e.*").distinct()


def chain_verified(found: DataFrame, obs: DataFrame, look_ahead: int, tolerance: int, frames: int, margin: int = 2) -> DataFrame:
    """Members that further observations along their motion confirm.

    Kept are those with a hit on both sides within ``look_ahead`` frames, with
    two on one side (the second at most two frames after the first), or with
    one hit if they lie within ``margin`` of the first or last frame.

    The observations, of which there are fewer than expected places, are dealt
    to the nine cells around them; hits are bits of one number a member.
    """
    far = look_ahead + 1
    ks = [k for k in range(-far, far + 1) if k]
    a = found.select("dxp", "dyp", "f", "x", "y", F.explode(F.array(*map(F.lit, ks))).alias("k"))
    a = a.select("*", (F.col("f") + F.col("k")).alias("fk"), (F.col("x") + F.col("k") * F.col("dxp")).alias("ex"), (F.col("y") + F.col("k") * F.col("dyp")).alias("ey"))
    a = a.select("*", _cell(F.col("ex"), tolerance).alias("gx"), _cell(F.col("ey"), tolerance).alias("gy"))
    b = obs.select(F.col("f").alias("fk"), F.col("x").alias("ox"), F.col("y").alias("oy")).distinct()
    b = b.select("*", F.explode(_around(F.col("ox"), F.col("oy"), tolerance)).alias("g")).select("fk", "ox", "oy", "g.*")
    dx, dy = F.col("ox") - F.col("ex"), F.col("oy") - F.col("ey")
    hits = a.join(b.hint("merge"), ["fk", "gx", "gy"]).where(dx * dx + dy * dy <= tolerance**2).groupBy("dxp", "dyp", "f", "x", "y")
    hits = hits.agg(F.bit_or(F.expr(f"shiftleft(1L, k + {far})")).alias("bits"))

    def side(sign: int) -> tuple[Column, Column]:
        steps = F.filter(F.array(*map(F.lit, range(1, far + 1))), lambda k: F.getbit("bits", sign * k + far) == 1)
        first = F.array_min(F.filter(steps, lambda k: k <= look_ahead))
        return first, F.exists(steps, lambda k: (k > first) & (k <= first + 2))

    (fwd, fwd2), (bwd, bwd2) = side(1), side(-1)
    at_end = (F.col("f") < margin) | (F.col("f") >= frames - margin)
    some = fwd.isNotNull() | bwd.isNotNull()
    keep = (fwd.isNotNull() & bwd.isNotNull()) | (fwd.isNotNull() & fwd2) | (bwd.isNotNull() & bwd2) | (at_end & some)
    return hits.where(keep).select("dxp", "dyp", "f", "x", "y")


def not_persistent(points: DataFrame, cell: int, share: float, frames: int) -> DataFrame:
    """Points in grid cells that have points in at most ``share`` of all frames."""
    gx, gy = _cell(F.col("x"), cell), _cell(F.col("y"), cell)
    cells = points.select("f", gx.alias("gx"), gy.alias("gy")).groupBy("gx", "gy").agg(F.count_distinct("f").alias("n"))
    calm = cells.where(F.col("n") <= share * frames).select("gx", "gy")
    return points.withColumn("gx", gx).withColumn("gy", gy).join(calm, ["gx", "gy"], "left_semi").drop("gx", "gy")


def clusters(points: DataFrame, radius: float) -> DataFrame:
    """``(f, x, y, label)``: distinct points of a frame chained by gaps of at most ``radius``."""

    def kernel(t: pa.Table) -> pa.Table:
        f, x, y = (t.column(c).to_numpy().astype(np.int64) for c in ("f", "x", "y"))
        bounds = np.append(np.nonzero(np.append(True, f[1:] != f[:-1]))[0], len(f))
        lefts, rights = [], []
        # rows of a frame are sorted by x: only points within the radius along x meet
        frame = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        wide = int(x.max() - x.min() + radius) + 2 if len(x) else 1
        key = frame * wide + x - (x.min() if len(x) else 0)
        stop = np.searchsorted(key, key + int(radius), side="right")
        after = stop - np.arange(len(f)) - 1
        for part in np.array_split(np.arange(len(f)), max(1, int(after.sum()) >> 22)):
            i = np.repeat(part, after[part])
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(after[part]) - after[part], after[part])
            near = (x[j] - x[i]) ** 2 + (y[j] - y[i]) ** 2 <= radius**2
            lefts.append(i[near])
            rights.append(j[near])
        root = roots(len(f), np.concatenate([*lefts, [0]]).astype(int), np.concatenate([*rights, [0]]).astype(int)) if len(f) else f
        name = y * ROW + x
        least = np.full(len(f), np.iinfo(np.int64).max)
        np.minimum.at(least, root, name)
        return pa.table([t.column("f"), t.column("x"), t.column("y"), pa.array(least[root])], names=["f", "x", "y", "label"])

    spots = points.select("f", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y")).distinct()
    kind = points.schema["f"].dataType.simpleString()
    return per_frame(spots, ["f"], kernel, f"f {kind}, x int, y int, label bigint", ["x", "y"])


def directed_mask(points: DataFrame, angles: list[float], band: int, height: int, width: int, radius: int = 300, tolerance: float = 30, least: int = 2) -> DataFrame:
    """``(f, y, x)``: clusters of points along one of ``angles``, drawn out.

    Points that lie along a direction within ``radius`` form clusters; of those
    with ``least`` points each gets a disk of ``band``, and points that follow
    each other along the cluster's axis are joined by strokes as wide.
    """
    from framelark.operators import geometry, pixels

    edges = geometry.directed_edges(points, angles, radius, tolerance)
    spots = points.select("f", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y")).distinct()
    labels = linked_points(spots, edges)
    large = labels.groupBy("f", "label").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    kept = labels.join(large, ["f", "label"], "left_semi")
    strokes = geometry.along_axis(kept.select("f", "label", "x", "y"), ["f", "label"])
    strokes = strokes.select("f", F.col("x1").alias("x0"), F.col("y1").alias("y0"), F.col("x2").alias("x1"), F.col("y2").alias("y1"))
    disks = pixels.dilated(kept.select("f", "y", "x"), pixels.disk(band), height, width)
    drawn = pixels.brushed(strokes, band).where(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1))
    return disks.unionByName(drawn).distinct()


def linked_points(points: DataFrame, edges: DataFrame) -> DataFrame:
    """``(f, x, y, label)``: points ``(f, x, y)`` chained by ``edges(f, ax, ay, bx, by)`` of their frame."""
    ends = edges.select("f", F.col("ax").alias("x"), F.col("ay").alias("y"), F.col("bx"), F.col("by"))
    rows = points.select("f", "x", "y", F.lit(None).cast("int").alias("bx"), F.lit(None).cast("int").alias("by")).unionByName(ends)

    def kernel(t: pa.Table) -> pa.Table:
        f, x, y = (t.column(c).to_numpy().astype(np.int64) for c in ("f", "x", "y"))
        bx, by = (np.nan_to_num(t.column(c).to_numpy(zero_copy_only=False).astype(float), nan=-1).astype(np.int64) for c in ("bx", "by"))
        frame = np.cumsum(np.append(True, f[1:] != f[:-1])) - 1
        own = (frame << 42) | (y << 21) | x
        spot = t.column("bx").is_null().to_numpy(zero_copy_only=False)
        keys, first = np.unique(own[spot], return_index=True)
        a, b = np.searchsorted(keys, own[~spot]), np.searchsorted(keys, ((frame << 42) | (by << 21) | bx)[~spot])
        root = roots(len(keys), a, b)
        at = np.nonzero(spot)[0][first]
        names = (y * ROW + x)[at]
        least = np.full(len(keys), np.iinfo(np.int64).max)
        np.minimum.at(least, root, names)
        return pa.table([t.column("f").take(pa.array(at)), pa.array(x[at].astype(np.int32)), pa.array(y[at].astype(np.int32)), pa.array(least[root])], names=["f", "x", "y", "label"])

    kind = points.schema["f"].dataType.simpleString()
    return per_frame(rows.select("f", "x", "y", "bx", "by"), ["f"], kernel, f"f {kind}, x int, y int, label bigint")


def long_clusters(labelled: DataFrame, least: int, elongation: float) -> DataFrame:
    """``(f, label, n, elongation)`` of clusters that are large and long enough.

    Two points always lie on a line.
    """
    a, b, c = F.var_samp("x"), F.covar_samp("x", "y"), F.var_samp("y")
    half, gap = (a + c) / 2, F.sqrt(F.pow((a - c) / 2, 2) + F.pow(b, 2))
    ratio = F.sqrt((half + gap) / (half - gap + 1e-6))
    n = labelled.groupBy("f", "label").agg(F.count("*").alias("n"), ratio.alias("elongation"))
    return n.where((F.col("n") >= least) & ((F.col("n") < 3) | (F.col("elongation") >= elongation)))


def _gap_filled_once(found: DataFrame, kept: DataFrame, most: int, tolerance: int) -> DataFrame:
    at = ["dxp", "dyp", "f"]
    empty = found.select(*at).distinct().join(kept.hint("merge"), at, "left_anti")
    reach = F.sequence(F.lit(1), F.lit(most))
    moved = kept.withColumn("back", F.explode(reach)).select(
        "dxp", "dyp", (F.col("f") + F.col("back")).alias("f"),
        (F.col("x") + F.col("back") * F.col("dxp")).alias("x"), (F.col("y") + F.col("back") * F.col("dyp")).alias("y"),
    )
    moved = moved.join(empty.hint("merge"), at).withColumn("fwd", F.explode(reach))
    moved = moved.select("*", (F.col("f") + F.col("fwd")).alias("fv"), (F.col("x") + F.col("fwd") * F.col("dxp")).alias("ex"), (F.col("y") + F.col("fwd") * F.col("dyp")).alias("ey"))
    moved = moved.withColumn("g", F.explode(_around(F.col("ex"), F.col("ey"), tolerance))).select("*", "g.gx", "g.gy")
    sure = kept.select("dxp", "dyp", F.col("f").alias("fv"), F.col("x").alias("ox"), F.col("y").alias("oy"), _cell(F.col("x"), tolerance).alias("gx"), _cell(F.col("y"), tolerance).alias("gy"))
    d2 = F.pow(F.col("ox") - F.col("ex"), 2) + F.pow(F.col("oy") - F.col("ey"), 2)
    return moved.join(sure.hint("merge"), ["dxp", "dyp", "fv", "gx", "gy"]).where(d2 <= tolerance**2).select(*at, "x", "y").distinct()


def gap_filled(found: DataFrame, kept: DataFrame, most: int, tolerance: int, passes: int = 1) -> DataFrame:
    """``(dxp, dyp, f, x, y)``: points made up where a motion lost its frame.

    A frame in which a peak has ``found`` members but none ``kept`` gets the
    points of a kept frame up to ``most`` before it, moved along, if a kept
    frame up to ``most`` after it has a point where they would be.  Further
    ``passes`` take the points made up as kept, until one adds none.
    """
    cols = ["dxp", "dyp", "f", "x", "y"]
    out = _gap_filled_once(found, kept, most, tolerance)
    for _ in range(passes - 1):
        more = _gap_filled_once(found, kept.select(*cols).unionByName(out.select(*cols)), most, tolerance)
        if more.isEmpty():
            break
        out = out.unionByName(more)
    return out


def snapped(points: DataFrame, targets: DataFrame, radius: int) -> DataFrame:
    """``(f, y, x, ny, nx)``: each point's nearest target pixel within a square.

    Ties go to the first in row-major order; without a target a point stays.
    """
    r = range(-radius, radius + 1)
    steps = F.array(*[F.struct(F.lit(i * i + j * j).alias("d"), F.lit(i).alias("dy"), F.lit(j).alias("dx")) for i in r for j in r])
    near = points.select("f", "y", "x", F.explode(steps).alias("s"))
    near = near.select("f", "y", "x", "s", (F.col("y") + F.col("s.dy")).alias("ty"), (F.col("x") + F.col("s.dx")).alias("tx"))
    goal = targets.select("f", F.col("y").alias("ty"), F.col("x").alias("tx")).distinct()
    best = near.join(goal, ["f", "ty", "tx"]).groupBy("f", "y", "x").agg(F.min(F.struct("s.d", "ty", "tx")).alias("m"))
    out = points.select("f", "y", "x").join(best, ["f", "y", "x"], "left")
    return out.select("f", "y", "x", F.coalesce("m.ty", "y").alias("ny"), F.coalesce("m.tx", "x").alias("nx"))


def strongest(points: DataFrame, most: int = 2000) -> DataFrame:
    """The ``most`` candidates of a frame and channel by (peak, x, y), largest first."""
    from pyspark.sql import Window

    w = Window.partitionBy("f", "ch").orderBy(F.desc("peak"), F.desc("x"), F.desc("y"))
    return points.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most).drop("_k")


def within_margin(points: DataFrame, margin: int, width: int, height: int, strict: bool = False) -> DataFrame:
    """Points off the frame's edge; ``strict`` leaves out the margin line itself."""
    x, y = F.col("x"), F.col("y")
    if strict:
        return points.where((x > margin) & (x < width - margin) & (y > margin) & (y < height - margin))
    return points.where((x >= margin) & (x < width - margin) & (y >= margin) & (y < height - margin))

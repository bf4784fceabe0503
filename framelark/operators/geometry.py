"""Lines, boxes, tiles, and the greedy merges on them."""

from __future__ import annotations

import heapq
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelark.functions.pixel import angle_gap, line_angle, rho
from framelark.operators._frames import per_frame, starts_of


def lines(segments: DataFrame) -> DataFrame:
    """Segments ``(x1, y1, x2, y2, ...)`` with ``angle`` and ``rho``; those of no length go."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    some = segments.where((dx != 0) | (dy != 0))
    return some.withColumn("angle", line_angle(dx, dy)).withColumn("rho", rho(F.col("x1"), F.col("y1"), dx, dy))


def not_parallel(found: DataFrame, star_angle: float, tolerance: float) -> DataFrame:
    """Lines that do not run along the stars' own trails; a negative angle keeps all."""
    return found if star_angle < 0 else found.where(angle_gap(F.col("angle"), F.lit(star_angle)) >= tolerance)


def matched_lines(found: DataFrame, angle: float, distance: float) -> DataFrame:
    """Lines with a like one in the frame before or after.

    Both differences must stay below their limits.  Each line meets those of
    the two frames in bands of ``rho`` and of direction twice as wide as the
    limits, its own and the nearer one beside it; bands of direction wrap around
    at 180 degrees.
    """
    turns = max(1, int(90 / angle))  # equal bands, none narrower than twice the limit

    def bands(at: Column, last: int | None = None) -> tuple[Column, Column]:
        own = F.floor(at).cast("bigint")
        own = own if last is None else F.least(own, F.lit(last))
        return own, F.when(at - own < 0.5, own - 1).otherwise(own + 1)

    band, beside = bands(F.col("rho") / (2 * distance))
    turn, next_turn = bands(F.col("angle") * (turns / 180.0), turns - 1)
    next_turn = F.pmod(next_turn, F.lit(turns))
    spots = [F.struct((F.col("f") + s).alias("_f"), r.alias("_band"), t.alias("_turn")) for s in (-1, 1) for r in (band, beside) for t in (turn, next_turn)]
    # all that a match depends on, once for equal lines; the other columns stay behind, and the first like line is enough
    once = found.select("f", "angle", "rho").distinct()
    a = once.select("f", "angle", "rho", F.explode(F.array(*spots)).alias("s")).select("f", "angle", "rho", "s.*")
    b = once.select(F.col("f").alias("_g"), band.alias("_own"), turn.alias("_way"), F.col("angle").alias("_angle"), F.col("rho").alias("_rho"))
    like = (angle_gap(F.col("angle"), F.col("_angle")) < angle) & (F.abs(F.col("rho") - F.col("_rho")) < distance)
    same = (F.col("_f") == F.col("_g")) & (F.col("_band") == F.col("_own")) & (F.col("_turn") == F.col("_way"))
    kept = a.join(b.hint("merge"), same & like, "left_semi").select("f", "angle", "rho").distinct()
    return found.join(kept, ["f", "angle", "rho"], "left_semi").distinct()


def segment_points(segments: DataFrame, band: int, edge: int, width: int, height: int) -> DataFrame:
    """``(f, x, y)``: points along segments, ``band`` apart, that are off the edge."""
    length = F.sqrt(F.pow(F.col("x2") - F.col("x1"), 2) + F.pow(F.col("y2") - F.col("y1"), 2))
    n = F.greatest(F.lit(2), F.floor(length / max(1, band)).cast("int"))
    dots = segments.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n"))))
    dots = dots.withColumn("t", F.col("k") / F.col("n"))
    at = lambda a, b: (F.col(a) + F.col("t") * (F.col(b) - F.col(a))).cast("int")
    x, y = F.col("x"), F.col("y")
    inside = (x > edge) & (x < width - edge) & (y > edge) & (y < height - edge)
    return dots.select("f", at("x1", "x2").alias("x"), at("y1", "y2").alias("y")).where(inside).distinct()


def consecutive(points: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Each point joined to the next one of its group: segments ``(keys, x1, y1, x2, y2)``."""
    w = Window.partitionBy(*keys).orderBy(order)
    out = points.select(*keys, order, F.col("x").alias("x1"), F.col("y").alias("y1"), F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2"))
    return out.where(F.col("x2").isNotNull())


def along_axis(points: DataFrame, keys: list[str]) -> DataFrame:
    """Segments between a group's points in their order along its main axis."""
    from framelark.operators.components import axes

    main = axes(points, *keys).select(*keys, "mx", "my", F.radians("angle").alias("t"))
    p = (F.col("x") - F.col("mx")) * F.cos("t") + (F.col("y") - F.col("my")) * F.sin("t")
    return consecutive(points.join(main, keys).withColumn("p", p), keys, "p").drop("p")


def directed_edges(points: DataFrame, angles: list[float], radius: int = 300, tolerance: float = 30) -> DataFrame:
    """Pairs of a frame's points within ``radius`` that lie along one of ``angles``."""
    a = points.select("f", F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = points.select("f", F.col("x").alias("bx"), F.col("y").alias("by"))
    gx = lambda c: F.floor(F.col(c) / radius)
    a = a.withColumn("g", F.explode(F.array(*[F.struct((gx("ax") + i).alias("x"), (gx("ay") + j).alias("y")) for i in (-1, 0, 1) for j in (-1, 0, 1)])))
    b = b.withColumn("g", F.struct(gx("bx").alias("x"), gx("by").alias("y")))
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    ahead = (F.col("ax") < F.col("bx")) | ((F.col("ax") == F.col("bx")) & (F.col("ay") < F.col("by")))
    along = F.exists(F.array(*map(F.lit, angles)), lambda d: angle_gap(line_angle(dx, dy), d) <= tolerance)
    return a.join(b, ["f", "g"]).where(ahead & (dx * dx + dy * dy <= radius * radius) & along).drop("g")


def _ios(a: str, b: str):
    w = F.greatest(F.least(F.col(f"{a}.x1"), F.col(f"{b}.x1")) - F.greatest(F.col(f"{a}.x0"), F.col(f"{b}.x0")), F.lit(0))
    h = F.greatest(F.least(F.col(f"{a}.y1"), F.col(f"{b}.y1")) - F.greatest(F.col(f"{a}.y0"), F.col(f"{b}.y0")), F.lit(0))
    area = lambda t: (F.col(f"{t}.x1") - F.col(f"{t}.x0")) * (F.col(f"{t}.y1") - F.col(f"{t}.y0"))
    return w * h / F.least(area(a), area(b))


def ranked(boxes: DataFrame) -> DataFrame:
    """``rk``: place of a box in its frame by score, best first, ties by id."""
    return boxes.withColumn("rk", F.row_number().over(Window.partitionBy("f").orderBy(F.desc("s"), "det_id")))


def overlapping(boxes: DataFrame, threshold: float = 0.5, cell: int = 512) -> DataFrame:
    """``(f, a, b, ios)``: boxes of a frame whose intersection covers enough of the smaller.

    Boxes meet in the grid cells that both touch, and a pair counts in the cell
    of its intersection's first corner, so boxes far apart are never compared.
    """
    touched = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell).cast("int"), F.floor((F.col(hi) - 1) / cell).cast("int"))
    dealt = boxes.withColumn("gx", F.explode(touched("x0", "x1"))).withColumn("gy", F.explode(touched("y0", "y1")))
    a, b = dealt.alias("a"), dealt.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("f", "gx", "gy")]
    corner = [F.floor(F.greatest(F.col(f"a.{c}0"), F.col(f"b.{c}0")) / cell) == F.col(f"a.g{c}") for c in ("x", "y")]
    pair = (F.col("a.rk") < F.col("b.rk")) & corner[0] & corner[1]
    out = a.join(b, [*same, pair]).withColumn("ios", _ios("a", "b")).where(F.col("ios") >= threshold)
    return out.select(F.col("a.f").alias("f"), F.col("a.rk").alias("a"), F.col("b.rk").alias("b"), "ios")


def _all_pairs(n: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j), i before j, of all pairs inside groups of ``n`` rows that begin at ``start``."""
    left = np.repeat(start, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    after = np.repeat(start + n, n) - left - 1
    i = np.repeat(left, after)
    return i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(after) - after, after)


def suppressed(boxes: DataFrame, threshold: float = 0.5, together: int = 2000) -> DataFrame:
    """``(f, rk)`` that greedy suppression keeps: by rank, boxes no kept one overlaps.

    Frames of up to ``together`` boxes are decided side by side, a rank at a
    time; larger ones box by box, which needs no table of pairs.
    """

    def kernel(t: pa.Table) -> pa.Table:
        f, rk, x0, y0, x1, y1 = (t.column(c).to_numpy() for c in ("f", "rk", "x0", "y0", "x1", "y1"))
        area = (x1 - x0) * (y1 - y0)

        def over(i, j) -> np.ndarray:
            w = np.minimum(x1[i], x1[j]) - np.maximum(x0[i], x0[j])
            h = np.minimum(y1[i], y1[j]) - np.maximum(y0[i], y0[j])
            return np.maximum(w, 0) * np.maximum(h, 0) / np.minimum(area[i], area[j]) >= threshold

        at = starts_of(f)
        n = np.diff(np.append(at, len(f)))
        keep = np.ones(len(f), dtype=bool)
        for lo, size in zip(at[n > together], n[n > together], strict=True):
            for i in range(lo, lo + size):
                if keep[i]:
                    keep[i + 1 : lo + size] &= ~over(i, np.arange(i + 1, lo + size))
        few = n <= together
        i, j = _all_pairs(n[few], at[few])
        hit = over(i, j)
        i, j = i[hit], j[hit]
        turn = np.arange(len(f)) - np.repeat(at, n)
        order = np.argsort(turn[j], kind="stable")
        i, j = i[order], j[order]
        for s in np.split(np.arange(len(j)), np.nonzero(np.diff(turn[j]))[0] + 1):
            keep[j[s][keep[i[s]]]] = False
        return t.select(["f", "rk"]).filter(pa.array(keep))

    kind = boxes.schema["f"].dataType.simpleString()
    cols = boxes.select("f", "rk", "x0", "y0", "x1", "y1")
    return per_frame(cols, ["f"], kernel, f"f {kind}, rk int", ["rk"])


def merged_boxes(boxes: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``(f, rk, root)``: by rank, each box that is not yet taken takes all later ones it overlaps, as it grows.

    ``root`` is the rank of the box that took a box (its own, if none did): the
    members of a root are one detection, whose mask is their union.
    """

    def kernel(t: pa.Table) -> pa.Table:
        f, rk, *sides = (t.column(c).to_numpy() for c in ("f", "rk", "x0", "y0", "x1", "y1"))
        x0, y0, x1, y1 = (s.astype(np.int64) for s in sides)
        root = np.full(len(f), -1, dtype=np.int64)
        at = starts_of(f)
        for lo, hi in zip(at, np.append(at[1:], len(f)), strict=True):
            for i in range(lo, hi):
                if root[i] >= 0:
                    continue
                root[i] = rk[i]
                a = [x0[i], y0[i], x1[i], y1[i]]
                for j in i + 1 + np.nonzero(root[i + 1 : hi] < 0)[0]:
                    w, h = min(a[2], x1[j]) - max(a[0], x0[j]), min(a[3], y1[j]) - max(a[1], y0[j])
                    least = min((a[2] - a[0]) * (a[3] - a[1]), (x1[j] - x0[j]) * (y1[j] - y0[j]))
                    if w > 0 and h > 0 and w * h >= threshold * least:
                        root[j] = rk[i]
                        a = [min(a[0], x0[j]), min(a[1], y0[j]), max(a[2], x1[j]), max(a[3], y1[j])]
        return t.select(["f", "rk"]).append_column("root", pa.array(root.astype(np.int32)))

    kind = boxes.schema["f"].dataType.simpleString()
    cols = boxes.select("f", "rk", "x0", "y0", "x1", "y1")
    return per_frame(cols, ["f"], kernel, f"f {kind}, rk int, root int", ["rk"])


def tile_origins(extents: DataFrame, tile: int = 640, overlap: float = 0.2) -> DataFrame:
    """``(w, h, x0, y0)``: origins of tiles that cover a frame, the last ones at its border."""
    step = int(tile * (1 - overlap))

    def starts(c: str):
        last = F.greatest(F.col(c) - tile, F.lit(0))
        return F.array_distinct(F.transform(F.sequence(F.lit(0), F.ceil(last / step).cast("int")), lambda i: F.least(i * step, last)))

    rows = extents.select("w", "h", F.explode(starts("w")).alias("x0"), starts("h").alias("ys"))
    return rows.select("w", "h", "x0", F.explode("ys").alias("y0"))


def in_tiles(points: DataFrame, tiles: DataFrame, tile: int = 640) -> DataFrame:
    """Points with every tile that holds them.

    A tile touches at most four cells of a grid as wide as itself; points meet
    the tiles of their cell, which are few and broadcast.
    """
    inside = F.col("x").between(F.col("x0"), F.col("x0") + tile - 1) & F.col("y").between(F.col("y0"), F.col("y0") + tile - 1)
    cells = lambda c: F.explode(F.sequence(F.expr(f"{c} div {tile}"), F.expr(f"({c} + {tile - 1}) div {tile}")))
    dealt = tiles.select("x0", "y0", cells("x0").alias("_gx")).withColumn("_gy", cells("y0"))
    own = points.withColumn("_gx", F.expr(f"x div {tile}")).withColumn("_gy", F.expr(f"y div {tile}"))
    return own.join(F.broadcast(dealt), ["_gx", "_gy"]).where(inside).drop("_gx", "_gy")


def near_seams(boxes: DataFrame, seams_x: list[int], seams_y: list[int], reach: int = 8) -> DataFrame:
    """Boxes with a side within ``reach`` of an inner tile seam."""
    close = lambda sides, seams: F.exists(
        F.array(*map(F.lit, seams)) if seams else F.array().cast("array<int>"),
        lambda s: (F.abs(F.col(sides[0]) - s) <= reach) | (F.abs(F.col(sides[1]) - s) <= reach),
    )
    return boxes.where(close(("x0", "x1"), seams_x) | close(("y0", "y1"), seams_y))


# --- merging pieces of one trail ---------------------------------------------

#: Limits of a merge (fixed values): aspect, degrees, and pixels.
MERGE = {"aspect": 2.0, "angle": 3.0, "across": 25.0, "gap_least": 5.0, "gap_most": 150.0, "overlap": 10}


def shape(xy: np.ndarray) -> dict | None:
    """Principal-axis figures of a set of pixels; None below three."""
    if len(xy) < 3:
        return None
    mid = xy.mean(axis=0)
    values, vectors = np.linalg.eigh(np.cov((xy - mid).T))
    along, across = (xy - mid) @ vectors[:, 1], (xy - mid) @ vectors[:, 0]
    length, thick = np.ptp(along), max(np.ptp(across), 1.0)
    ends = mid + np.outer([along.min(), along.max()], vectors[:, 1])
    return {"mid": mid, "axis": vectors[:, 1], "aspect": length / thick, "ends": ends, "length": length, "thick": thick}


def merge_score(a: dict, b: dict, shared: int, limits: dict = MERGE) -> float | None:
    """How badly two pieces fit as one trail; None if they don't."""
    if min(a["aspect"], b["aspect"]) < limits["aspect"] or shared < max(1, limits["overlap"]):
        return None
    angle = np.degrees(np.arccos(min(1.0, abs(float(a["axis"] @ b["axis"])))))
    offset = b["mid"] - a["mid"]
    across = abs(a["axis"][0] * offset[1] - a["axis"][1] * offset[0])
    gap = min(np.linalg.norm(p - q) for p in a["ends"] for q in b["ends"])
    if angle > limits["angle"] or across > limits["across"] or not limits["gap_least"] <= gap <= limits["gap_most"]:
        return None
    return float(angle + across / 10 + gap / 200)


def merge_pieces(pieces: list[set[tuple[int, int]]], limits: dict = MERGE) -> list[set[tuple[int, int]]]:
    """Merge the best-fitting pair again and again; a merged piece goes to the end.

    Scores stand in a heap and are computed once for a pair, from the pixels
    that pieces share; entries of pieces that are gone are skipped.
    """
    live: dict[int, set[tuple[int, int]]] = {}
    shapes: dict[int, dict | None] = {}
    owners: dict[tuple[int, int], set[int]] = {}
    heap: list[tuple[float, int, int]] = []

    def add(k: int, piece: set[tuple[int, int]]) -> None:
        shapes[k] = shape(np.array(sorted(piece), dtype=float).reshape(-1, 2))
        shared = Counter(i for p in piece for i in owners.get(p, ()))
        for i, n in shared.items():
            s = merge_score(shapes[i], shapes[k], n, limits) if shapes[i] and shapes[k] else None
            if s is not None:
                heapq.heappush(heap, (s, i, k))
        for p in piece:
            owners.setdefault(p, set()).add(k)
        live[k] = piece

    for k, piece in enumerate(pieces):
        add(k, piece)
    new = len(pieces)
    while heap:
        _, i, j = heapq.heappop(heap)
        if i not in live or j not in live:
            continue
        both = live[i] | live[j]
        for k in (i, j):
            for p in live.pop(k):
                owners[p].discard(k)
        add(new, both)
        new += 1
    return [live[k] for k in sorted(live)]


def merged_pieces(masks: DataFrame, limits: dict = MERGE) -> DataFrame:
    """``(f, mask_id, y, x)`` with the pieces of one trail under one id, numbered anew by frame."""

    def kernel(t: pa.Table) -> pa.Table:
        f, m, y, x = (t.column(c).to_numpy() for c in ("f", "mask_id", "y", "x"))
        out: list[tuple] = []
        at = starts_of(f)
        for lo, hi in zip(at, np.append(at[1:], len(f)), strict=True):
            cut = lo + starts_of(m[lo:hi])
            by = [set(zip(x[a:b].tolist(), y[a:b].tolist(), strict=True)) for a, b in zip(cut, np.append(cut[1:], hi), strict=True)]
            for k, piece in enumerate(merge_pieces(by, limits)):
                out += [(f[lo], k, py, px) for px, py in sorted(piece)]
        cols = list(zip(*out, strict=True)) if out else [()] * 4
        kinds = (t.schema.field("f").type, pa.int32(), pa.int32(), pa.int32())
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["f", "mask_id", "y", "x"])

    kind = masks.schema["f"].dataType.simpleString()
    return per_frame(masks.select("f", "mask_id", "y", "x"), ["f"], kernel, f"f {kind}, mask_id int, y int, x int", ["mask_id", "y", "x"])


# --- crossing trails ----------------------------------------------------------


def angle_groups(angles: np.ndarray, lengths: np.ndarray, width: float = 10, least: int = 3, apart: float = 25) -> list[np.ndarray]:
    """The two largest groups of line directions, longest lines first; none if they don't tell two trails.

    The most lines within ``width`` degrees of one of them form a group, again
    and again until none is left.  The two largest must have ``least`` lines,
    and their mean directions must be ``apart``.
    """

    def gap(a, b):
        d = np.abs(a - b) % 180
        return np.minimum(d, 180 - d)

    left, groups = np.arange(len(angles)), []
    while len(left):
        near = gap(angles[left][:, None], angles[left][None]) <= width
        own = near[int(np.argmax(near.sum(axis=1)))]
        groups.append(left[own])
        left = left[~own]
    groups = sorted(groups, key=len, reverse=True)[:2]
    if len(groups) < 2 or len(groups[1]) < least or gap(*(angles[g].mean() for g in groups)) < apart:
        return []
    return [g[np.argsort(-lengths[g], kind="stable")] for g in groups]


def split_crossing(pixels: DataFrame, two_lines: DataFrame, seam: float = 3.0) -> DataFrame:
    """Pixels of a crossing with ``side`` 0 or 1: the nearer of its two lines.

    ``two_lines(f, label, cx0, cy0, a0, cx1, cy1, a1)`` holds a point and an
    angle of both; pixels about as near to either (within ``seam``) are dropped.
    """
    from framelark.functions.pixel import line_distance

    d = [line_distance(F.col("x"), F.col("y"), F.col(f"cx{i}"), F.col(f"cy{i}"), F.col(f"a{i}")) for i in (0, 1)]
    out = pixels.join(two_lines, ["f", "label"]).withColumn("_d", d[0] - d[1]).where(F.abs("_d") > seam)
    return out.select("f", "label", "y", "x", F.when(F.col("_d") < 0, 0).otherwise(1).alias("side"))


def thinned(mask: np.ndarray) -> np.ndarray:
    """A skeleton: rim pixels go in turns from four sides as long as that parts nothing (Zhang and Suen)."""
    m = np.pad(mask.astype(bool), 1)
    while True:
        gone = 0
        for turn in (0, 1):
            p = [np.roll(m, s, (0, 1)) for s in ((1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1))]
            count = sum(q.astype(int) for q in p)
            steps = sum((~a & b).astype(int) for a, b in zip(p, [*p[1:], p[0]], strict=True))
            n, e, s, w = p[0], p[2], p[4], p[6]
            free = ~(n & e & s) & ~(e & s & w) if turn == 0 else ~(n & e & w) & ~(n & s & w)
            rim = m & (count >= 2) & (count <= 6) & (steps == 1) & free
            gone += int(rim.sum())
            m = m & ~rim
        if not gone:
            return m[1:-1, 1:-1]


def line_runs(skeleton: np.ndarray, votes: int, least: float, gap: float) -> np.ndarray:
    """Straight runs (x1, y1, x2, y2) of skeleton pixels, from all line votes and not from a sample of them.

    The line of most votes gives its runs of ``least`` length, broken at gaps
    of more than ``gap``, and takes their pixels, until none has ``votes``.
    """
    ys, xs = np.nonzero(skeleton)
    t = np.radians(np.arange(180))
    out, live = [], np.ones(len(xs), dtype=bool)
    r = np.rint(np.outer(xs, np.cos(t)) + np.outer(ys, np.sin(t))).astype(int)
    shift = int(np.abs(r).max()) + 1 if len(xs) else 1
    tally = np.zeros((180, 2 * shift + 1), dtype=int)
    for k in range(180):
        np.add.at(tally[k], r[:, k] + shift, 1)
    while tally.size and tally.max() >= votes:
        k, rho = np.unravel_index(int(np.argmax(tally)), tally.shape)
        on = np.nonzero(live & (np.abs(r[:, k] + shift - rho) <= 1))[0]
        along = ys[on] * np.cos(t[k]) - xs[on] * np.sin(t[k])
        on, along = on[np.argsort(along)], np.sort(along)
        used = 0
        for run in np.split(np.arange(len(on)), np.nonzero(np.diff(along) > gap)[0] + 1):
            a, b = on[run[0]], on[run[-1]]
            if np.hypot(xs[b] - xs[a], ys[b] - ys[a]) >= least:
                out.append((xs[a], ys[a], xs[b], ys[b]))
                live[on[run]] = False
                used += len(run)
                for q in range(180):
                    np.subtract.at(tally[q], r[on[run], q] + shift, 1)
        if not used:
            tally[k, rho] = 0
    return np.array(out, dtype=float).reshape(-1, 4)


#: Limits of the crossing splitter (fixed values): pixels, aspect, skeleton, line votes, length and gap.  A trail
#: gives one run where votes are counted, and several where they are sampled: so one run is a group.
CROSSING = {"area": 5000, "aspect": 3.0, "skeleton": 30, "votes": 40, "length": 50, "gap": 15, "lines": 1}


def crossing_lines(labelled: DataFrame, limits: dict = CROSSING) -> DataFrame:
    """``two_lines`` of ``split_crossing`` for each component that is two trails crossing.

    It must be large and not long; the straight runs of its skeleton must have
    two main directions (``angle_groups``), of each of which the longest stands.
    """

    def kernel(t: pa.Table) -> pa.Table:
        f, label, y, x = (t.column(c).to_numpy() for c in ("f", "label", "y", "x"))
        rows = []
        at = starts_of(f, label)
        for lo, hi in zip(at, np.append(at[1:], len(f)), strict=True):
            if hi - lo < limits["area"]:
                continue
            ys, xs = y[lo:hi].astype(int), x[lo:hi].astype(int)
            small, large = np.sqrt(np.maximum(np.linalg.eigvalsh(np.cov(np.stack([xs, ys]))), 0))
            if large / max(0.5, small) >= limits["aspect"]:
                continue
            mask = np.zeros((np.ptp(ys) + 1, np.ptp(xs) + 1), bool)
            mask[ys - ys.min(), xs - xs.min()] = True
            bones = thinned(mask)
            if bones.sum() < limits["skeleton"]:
                continue
            runs = line_runs(bones, limits["votes"], limits["length"], limits["gap"])
            dx, dy = runs[:, 2] - runs[:, 0], runs[:, 3] - runs[:, 1]
            angles = np.degrees(np.arctan2(dy, dx)) % 180
            pair = [g[0] for g in angle_groups(angles, dx * dx + dy * dy, least=limits["lines"])]
            if pair:
                ends = [v for k in pair for v in (runs[k, 0] + xs.min(), runs[k, 1] + ys.min(), angles[k])]
                rows.append((f[lo], label[lo], *map(float, ends)))
        cols = list(zip(*rows, strict=True)) if rows else [()] * 8
        kinds = (t.schema.field("f").type, pa.int64(), *[pa.float64()] * 6)
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["f", "label", "cx0", "cy0", "a0", "cx1", "cy1", "a1"])

    kind = labelled.schema["f"].dataType.simpleString()
    shape_ = f"f {kind}, label bigint, cx0 double, cy0 double, a0 double, cx1 double, cy1 double, a1 double"
    return per_frame(labelled.select("f", "label", "y", "x"), ["f", "label"], kernel, shape_, ["y", "x"])


def crossings_split(labelled: DataFrame, limits: dict = CROSSING, seam: float = 3.0) -> DataFrame:
    """``(f, label, side, y, x)``: crossing components as two sides, all others as they are (side 0)."""
    two = crossing_lines(labelled, limits)
    parts = split_crossing(labelled, two, seam)
    rest = labelled.join(two.select("f", "label"), ["f", "label"], "left_anti").select("f", "label", "y", "x", F.lit(0).alias("side"))
    return parts.unionByName(rest).select("f", "label", "side", "y", "x")


def hough(pixels: DataFrame, angles: int = 180, rho_step: float = 1.0, least: int = 20) -> DataFrame:
    """``(f, angle, rho, votes)``: line votes of mask pixels, counted and not sampled."""
    theta = F.explode(F.sequence(F.lit(0), F.lit(angles - 1))).alias("k")
    v = pixels.select("f", "x", "y", theta).withColumn("angle", F.col("k") * (180.0 / angles))
    t = F.radians("angle")
    r = F.floor((F.col("y") * F.cos(t) - F.col("x") * F.sin(t)) / rho_step + 0.5) * rho_step
    return v.groupBy("f", "angle", r.alias("rho")).agg(F.count("*").alias("votes")).where(F.col("votes") >= least)


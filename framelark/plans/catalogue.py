"""Named queries over the general tables, each with the SQL that must agree.

Thresholds are chosen for these tables; the operators keep their own defaults.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelark.functions import pixel, text
from framelark.operators import components, geometry, kernels, manifest, motion, pixels, runlog, temporal
from framelark.sources import views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

FRAMES = 720  # hours covered by the observations

PX = """px AS (SELECT vec_id AS f, (i // 8)::INT AS y, (i % 8)::INT AS x,
  greatest(0, least(255, floor((embedding[i + 1]::DOUBLE + 0.55) * 230)))::INT AS v
  FROM embeddings, range(64) t(i))"""
BGR = """lv AS (SELECT vec_id AS f, i // 4 AS p, i % 4 AS c,
  greatest(0, least(255, floor((embedding[i + 1]::DOUBLE + 0.55) * 230)))::INT AS v FROM embeddings, range(64) t(i)),
bgr AS (SELECT f, (p // 4)::INT AS y, (p % 4)::INT AS x, max(v) FILTER (c = 0) AS b, max(v) FILTER (c = 1) AS g,
  max(v) FILTER (c = 2) AS r FROM lv GROUP BY f, p)"""
OBS = """obs AS (SELECT floor(epoch(ts) / 3600)::BIGINT - 473352 AS f, event_id, (user_id * 4)::INT AS x, floor(value)::INT AS y,
  CASE WHEN event_type IN ('error', 'purchase') THEN 'color' ELSE 'gray' END AS ch FROM events)"""
DET = """d0 AS (SELECT l_orderkey AS f, l_linenumber AS n, l_partkey AS p, l_suppkey AS u, l_quantity AS q, l_extendedprice AS s,
  (l_partkey % 300)::INT AS x0, (l_suppkey % 60)::INT AS y0 FROM lineitem),
det AS (SELECT f, row_number() OVER (PARTITION BY f ORDER BY s DESC, n, p, u, q) AS rk, x0, y0, x0 + 40 + 4 * q::INT AS x1,
  y0 + 30 + q::INT AS y1 FROM d0)"""
FILES = """files AS (SELECT 'IMG_' || doc_id // 2 AS stem, ['jpg', 'tif', 'png', 'TIFF', 'txt'][doc_id * 7 % 5 + 1] AS ext, doc_id,
  CASE WHEN doc_id % 7 = 0 THEN 3712 ELSE 5568 END AS w, CASE WHEN doc_id % 7 = 0 THEN 2475 ELSE 3712 END AS h FROM documents),
img AS (SELECT *, stem || '.' || ext AS path, row_number() OVER (ORDER BY stem || '.' || ext) - 1 AS frame_idx FROM files
  WHERE lower(ext) IN ('jpg', 'jpeg', 'png', 'tif', 'tiff'))"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# --- manifest -----------------------------------------------------------------


def _images(spark: SparkSession, d: str) -> DataFrame:
    return manifest.indexed(manifest.images(views.files(spark, d)), ["path"])


@query("scan_filter_ext", f"WITH {FILES} SELECT path, doc_id, frame_idx FROM img")
def _(spark, d):
    return _images(spark, d).select("path", "doc_id", "frame_idx")


@query(
    "dedup_prefer_tiff",
    f"""WITH {FILES} SELECT stem, path FROM img
    QUALIFY row_number() OVER (PARTITION BY stem ORDER BY lower(ext) IN ('tif', 'tiff') DESC, path) = 1""",
)
def _(spark, d):
    return manifest.prefer_tiff(_images(spark, d)).select("stem", "path")


@query(
    "dominant_resolution",
    f"""WITH {FILES}, m AS (SELECT w, h, count(*) n, min(frame_idx) s FROM img GROUP BY ALL ORDER BY n DESC, s LIMIT 1)
    SELECT path, img.w, img.h FROM img JOIN m USING (w, h)""",
)
def _(spark, d):
    return manifest.of_dominant_size(_images(spark, d), order="frame_idx").select("path", "w", "h")


@query(
    "size_breakdown",
    f"""WITH {FILES}, g AS (SELECT w, h, count(*) AS n_files, min(path) AS first_seen FROM img GROUP BY w, h)
    SELECT w, h, n_files, row_number() OVER (ORDER BY n_files DESC, first_seen) = 1 AS is_dominant,
      (SELECT string_agg(path, ',' ORDER BY path) FROM (SELECT path FROM img i WHERE i.w = g.w AND i.h = g.h ORDER BY path LIMIT 5)) AS samples
    FROM g""",
)
def _(spark, d):
    return manifest.size_breakdown(_images(spark, d))


@query(
    "batch_plan",
    f"""WITH {FILES} SELECT path, frame_idx, b::INT AS batch, b = frame_idx // 20 AS is_core
    FROM img, (SELECT unnest(range(0, (SELECT max(frame_idx) // 20 + 2 FROM img))) AS b)
    WHERE frame_idx BETWEEN b * 20 - 1 AND b * 20 + 20""",
)
def _(spark, d):
    return manifest.batches(_images(spark, d)).select("path", "frame_idx", "batch", "is_core")


# --- pixel expressions ----------------------------------------------------------


@query(
    "depth_convert",
    """SELECT l_partkey AS v, count(*) AS n, (l_partkey >> 8) AS narrow, (l_partkey // 257)::INT AS scaled,
    ((l_partkey % 256) * 257)::BIGINT AS widened FROM lineitem GROUP BY l_partkey""",
)
def _(spark, d):
    v = F.col("v")
    rows = views.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("v")).agg(F.count("*").alias("n"))
    return rows.select("v", "n", pixel.narrow(v).alias("narrow"), pixel.scaled_down(v).alias("scaled"), pixel.widen(v % 256).alias("widened"))


@query(
    "color_advantage",
    f"""WITH {BGR} SELECT f, y, x, greatest(r - (g + b) // 2, 0)::INT AS red, greatest(g - (r + b) // 2, 0)::INT AS green,
    floor(0.114::DOUBLE * b + 0.587::DOUBLE * g + 0.299::DOUBLE * r + 0.5::DOUBLE)::INT AS gray FROM bgr""",
)
def _(spark, d):
    b, g, r = F.col("b"), F.col("g"), F.col("r")
    return views.bgr(spark, d).select(
        "f", "y", "x", pixel.advantage(r, g, b).alias("red"), pixel.advantage(g, r, b).alias("green"), pixel.gray(b, g, r).alias("gray")
    )


@query(
    "channel_order_stats",
    f"""WITH {BGR} SELECT f, y, x, greatest(b, g, r) AS top, b + g + r - greatest(b, g, r) - least(b, g, r) AS mid,
    least(b, g, r) AS low, (b + g + r - greatest(b, g, r)) / 2.0::DOUBLE AS other_mean FROM bgr""",
)
def _(spark, d):
    names = ("top", "mid", "low", "other_mean")
    stats = pixel.order_stats(F.col("b"), F.col("g"), F.col("r"))
    return views.bgr(spark, d).select("f", "y", "x", *[s.alias(n) for s, n in zip(stats, names, strict=True)])


@query("red_pixels", f"WITH {BGR} SELECT f, y, x, b, g, r FROM bgr WHERE r > 80 AND r > 1.5 * g AND r > 1.5 * b")
def _(spark, d):
    return views.bgr(spark, d).where(components.reddish())


# --- temporal -------------------------------------------------------------------

SKY = "sky AS (SELECT y, x, floor(quantile_cont(v, 0.5))::INT AS v FROM px GROUP BY y, x)"

for name, share in (("clean_sky_median", 50), ("clean_sky_p25", 25), ("clean_sky_p75", 75)):
    query(name, f"WITH {PX} SELECT y, x, floor(quantile_cont(v, {share / 100}))::INT AS v FROM px GROUP BY y, x")(
        lambda spark, d, share=share: temporal.clean_sky(views.px(spark, d), share)
    )


@query("residual_threshold", f"WITH {PX}, {SKY} SELECT f, y, x, px.v - sky.v AS d FROM px JOIN sky USING (y, x) WHERE px.v - sky.v > 40")
def _(spark, d):
    px = views.px(spark, d)
    return temporal.residual(px, temporal.clean_sky(px)).where("d > 40").select("f", "y", "x", "d")


@query(
    "neighbor_min_diff",
    f"""WITH {PX}, n AS (SELECT f, y, x, least(v - lag(v) OVER w, v - lead(v) OVER w) AS d FROM px
      WINDOW w AS (PARTITION BY y, x ORDER BY f)) SELECT f, y, x, d FROM n WHERE d > 20""",
)
def _(spark, d):
    return temporal.neighbour_difference(views.px(spark, d)).where("d > 20").select("f", "y", "x", "d")


@query(
    "row_gain",
    f"""WITH {PX}, {SKY}, q AS (SELECT y, quantile_cont(v, 0.75) AS q FROM sky GROUP BY y),
    r AS (SELECT greatest(quantile_cont(q, 0.2), 5) AS ref FROM q)
    SELECT y, round(q, 6) AS q, round(least(greatest((q + 2) / (ref + 2), 1.0::DOUBLE), 3.0::DOUBLE), 6) AS gain FROM q, r""",
)
def _(spark, d):
    rows = temporal.row_gain(temporal.clean_sky(views.px(spark, d)))
    return rows.select("y", F.round("q", 6).alias("q"), F.round("gain", 6).alias("gain"))


@query(
    "hot_pixel_map",
    f"""WITH {PX}, o AS (SELECT a.f, a.y, a.x, a.v, median(b.v) AS m FROM px a, range(-1, 2) i(dy), range(-1, 2) j(dx)
      JOIN px b ON b.f = a.f AND b.y = greatest(0, least(7, a.y + dy)) AND b.x = greatest(0, least(7, a.x + dx)) GROUP BY ALL)
    SELECT y, x, count(*) FILTER (v / greatest(m, 1) > 1.2::DOUBLE AND v > 5) AS hits FROM o GROUP BY y, x
    HAVING hits >= floor(0.18 * (SELECT count(DISTINCT f) FROM px))""",
)
def _(spark, d):
    return temporal.hot_pixels(views.px(spark, d), ratio=1.2, least=5, size=3, fraction=0.18)


@query(
    "ring_contrast_map",
    f"""WITH {PX}, o AS (SELECT a.f, a.y, a.x, a.v,
        avg(b.v) FILTER (greatest(abs(b.y - a.y), abs(b.x - a.x)) = 1) AS i,
        avg(b.v) FILTER (greatest(abs(b.y - a.y), abs(b.x - a.x)) IN (2, 3)) AS o
      FROM px a JOIN px b ON a.f = b.f AND abs(a.y - b.y) <= 3 AND abs(a.x - b.x) <= 3 GROUP BY a.f, a.y, a.x, a.v)
    SELECT y, x, count(*) FILTER (abs(v - o) >= 20 AND abs(i - o) >= 5 AND (v - o) * (i - o) > 0) AS hits FROM o GROUP BY y, x
    HAVING hits >= ceil(0.22 * (SELECT count(DISTINCT f) FROM px))""",
)
def _(spark, d):
    return temporal.ring_contrast(views.px(spark, d), centre=20, inner=5, fraction=0.22)


@query(
    "repair_average",
    f"""WITH {PX}, n AS (SELECT f, y, x, v, lag(v) OVER w AS p, lead(v) OVER w AS q FROM px WINDOW w AS (PARTITION BY y, x ORDER BY f))
    SELECT f, y, x, v, coalesce(((p + q) // 2)::INT, p, q, v) AS repaired FROM n WHERE v > 160""",
)
def _(spark, d):
    px = views.px(spark, d)
    return temporal.repaired_by_average(px, pixels.mask(px, 160)).select("f", "y", "x", "v", "repaired")


@query("repair_clean_sky", f"WITH {PX}, {SKY} SELECT f, y, x, px.v, sky.v AS repaired FROM px JOIN sky USING (y, x) WHERE px.v > 160")
def _(spark, d):
    px = views.px(spark, d)
    return temporal.repaired_by_sky(px, pixels.mask(px, 160), temporal.clean_sky(px)).select("f", "y", "x", "v", "repaired")


@query("repair_star_bridge")
def _(spark, d):
    px = views.px(spark, d)
    return kernels.repaired_by_bridge(px, components.labelled(pixels.mask(px, 160)))


@query("phase_shifts")
def _(spark, d):
    return kernels.aligned(views.px(spark, d))


@query("aligned_frames")
def _(spark, d):
    return kernels.aligned_frames(views.px(spark, d))


# --- masks and components -------------------------------------------------------


@query("sky_mask", f"WITH {PX} SELECT f, y, x FROM px WHERE v > 160 AND y < 6")
def _(spark, d):
    px = views.px(spark, d)
    foreground = px.where("y >= 6").select("y", "x").distinct()
    return pixels.in_sky(pixels.mask(px, 160), foreground).select("f", "y", "x")


@query(
    "dilate_mask",
    f"""WITH {PX} SELECT DISTINCT f, y + dy AS y, x + dx AS x FROM px, (VALUES (0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)) e(dy, dx)
    WHERE v > 160 AND y + dy BETWEEN 0 AND 7 AND x + dx BETWEEN 0 AND 7""",
)
def _(spark, d):
    return pixels.dilated(pixels.mask(views.px(spark, d), 160), pixels.ellipse(3), 8, 8)


@query("mask_difference", f"WITH {PX} SELECT f, y, x FROM px WHERE v > 140 AND v <= 160")
def _(spark, d):
    px = views.px(spark, d)
    return pixels.mask_difference(pixels.mask(px, 140), pixels.mask(px, 160))


@query("mask_union", f"WITH {PX} SELECT f, y, x FROM px WHERE v > 150 OR v < 90")
def _(spark, d):
    px = views.px(spark, d)
    return pixels.mask_union(pixels.mask(px, 150), px.where("v < 90"))


@query("mask_intersection", f"WITH {PX} SELECT f, y, x FROM px WHERE v > 120 AND v < 150")
def _(spark, d):
    px = views.px(spark, d)
    return pixels.mask_intersection(pixels.mask(px, 120), px.where("v < 150"))


LABELS = f"""{PX}, m AS (SELECT f, y, x FROM px WHERE v > 160),
e AS MATERIALIZED (SELECT a.f, a.y, a.x, b.y AS y2, b.x AS x2 FROM m a JOIN m b ON a.f = b.f AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1),
r AS (SELECT f, y, x, y * 1048576::BIGINT + x AS label FROM m
  UNION SELECT e.f, e.y2, e.x2, r.label FROM r JOIN e USING (f, y, x)),
lab AS (SELECT f, y, x, min(label) AS label FROM r GROUP BY f, y, x)"""


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return components.labelled(pixels.mask(views.px(spark, d), 160))


@query(
    "mask_components",
    f"""WITH RECURSIVE {LABELS} SELECT f, label, count(*) AS area, min(x) AS left_x, min(y) AS top_y,
    max(x) - min(x) + 1 AS width, max(y) - min(y) + 1 AS height, round_even(avg(x), 0)::INT AS cx, round_even(avg(y), 0)::INT AS cy
    FROM lab GROUP BY f, label""",
)
def _(spark, d):
    return components.stats(_labelled(spark, d))


@query("small_component_filter", f"WITH RECURSIVE {LABELS} SELECT f, y, x, label FROM lab QUALIFY count(*) OVER (PARTITION BY f, label) >= 3")
def _(spark, d):
    return components.small_filter(_labelled(spark, d), 3).select("f", "y", "x", "label")


@query("trails_per_frame", f"WITH RECURSIVE {LABELS} SELECT f, count(DISTINCT label) AS trails, count(*) AS pixels FROM lab GROUP BY f")
def _(spark, d):
    return components.trails_per_frame(_labelled(spark, d))


@query(
    "run_rollup",
    f"""WITH RECURSIVE {LABELS}, t AS (SELECT f, count(DISTINCT label) AS n, count(*) AS p FROM lab GROUP BY f)
    SELECT f // 20 AS batch, count(*) AS frames_with_trails, sum(n)::BIGINT AS trails, sum(p)::BIGINT AS pixels,
    (sum(p) // count(*))::BIGINT AS mean_pixels FROM t GROUP BY ROLLUP (f // 20)""",
)
def _(spark, d):
    return components.run_rollup(components.trails_per_frame(_labelled(spark, d)))


@query(
    "mask_overlap_count",
    f"""WITH RECURSIVE {LABELS} SELECT a.f, a.label AS a, b.label AS b, count(*) AS shared FROM lab a
    JOIN lab b ON b.f = a.f + 1 AND a.y = b.y AND a.x = b.x GROUP BY ALL""",
)
def _(spark, d):
    lab = _labelled(spark, d)
    return components.overlaps(lab, lab.withColumn("f", F.col("f") - 1))


AXES = """s AS (SELECT f, count(*) AS n, avg(x) AS mx, avg(y) AS my, var_samp(x) AS a, covar_samp(x, y) AS b, var_samp(y) AS c
  FROM pts GROUP BY f)"""


@query(
    "frame_elongation",
    f"""WITH {OBS}, pts AS (SELECT f, x, y FROM obs), {AXES}, h AS (SELECT f, n, (a + c) / 2 AS half, sqrt(pow((a - c) / 2, 2) + pow(b, 2)) AS gap FROM s)
    SELECT f, n, round(sqrt(half + gap) / greatest(0.5::DOUBLE, sqrt(greatest(half - gap, 0::DOUBLE))), 6) AS elongation FROM h WHERE n >= 4""",
)
def _(spark, d):
    return components.elongation(views.obs(spark, d), "f", least=4).withColumn("elongation", F.round("elongation", 6))


@query(
    "pca_metrics",
    f"""WITH {OBS}, pts AS (SELECT f, x, y FROM obs), {AXES}, t AS (SELECT *, atan2(2 * b, a - c) / 2 AS t FROM s WHERE n >= 4),
    p AS (SELECT f, t.n, t.t, (x - mx) * cos(t.t) + (y - my) * sin(t.t) AS p, (y - my) * cos(t.t) - (x - mx) * sin(t.t) AS q FROM pts JOIN t USING (f))
    SELECT f, n, round(((degrees(t) % 180) + 180) % 180, 5) AS angle, round(max(p) - min(p), 5) AS length,
    round(greatest(max(q) - min(q), 1::DOUBLE), 5) AS thick FROM p GROUP BY f, n, t""",
)
def _(spark, d):
    out = components.axes(views.obs(spark, d).select("f", "x", "y"), "f").where("n >= 4")
    return out.select("f", "n", *[F.round(c, 5).alias(c) for c in ("angle", "length", "thick")])


# --- motion -----------------------------------------------------------------------

PAIRS = f"""{OBS}, pairs AS (SELECT a.f, a.ch, a.x, a.y, b.x - a.x AS dx, b.y - a.y AS dy FROM obs a JOIN obs b ON b.f = a.f + 1 AND a.ch = b.ch
  WHERE (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) BETWEEN 225 AND 3600)"""
HIST = f"""{PAIRS}, hist AS (SELECT floor((dx + 60) / 8.0)::INT AS ix, floor((dy + 60) / 8.0)::INT AS iy, count(*) AS total,
  count(*) FILTER (ch = 'color') AS color, count(*) FILTER (ch = 'gray') AS gray FROM pairs GROUP BY 1, 2)"""
PEAKS = f"""{HIST}, peaks AS (SELECT (ix * 8 - 56)::INT AS dx, (iy * 8 - 56)::INT AS dy, total AS votes FROM hist h
  WHERE total >= 2 AND color >= 1 AND gray >= 1 AND total = (SELECT max(total) FROM hist o WHERE abs(o.ix - h.ix) <= 2 AND abs(o.iy - h.iy) <= 2))"""
MEMBERS = f"""{PEAKS}, e AS (SELECT k.dx AS dxp, k.dy AS dyp, p.* FROM pairs p JOIN peaks k ON abs(p.dx - k.dx) <= 8 AND abs(p.dy - k.dy) <= 8),
members AS (SELECT dxp, dyp, f, x, y FROM e UNION SELECT dxp, dyp, f + 1, x + dx, y + dy FROM e)"""
CHAIN = f"""{MEMBERS}, look AS MATERIALIZED (SELECT m.*, k, f + k AS fk, x + k * dxp AS ex, y + k * dyp AS ey FROM members m, range(-6, 7) r(k) WHERE k <> 0),
hit AS (SELECT DISTINCT l.dxp, l.dyp, l.f, l.x, l.y, l.k FROM look l JOIN obs o ON o.f = l.fk
  WHERE (o.x - l.ex) * (o.x - l.ex) + (o.y - l.ey) * (o.y - l.ey) <= 256),
firsts AS (SELECT dxp, dyp, f, x, y, min(k) FILTER (k BETWEEN 1 AND 5) AS fw, min(-k) FILTER (k BETWEEN -5 AND -1) AS bw, list(k) AS ks FROM hit GROUP BY ALL),
chain AS (SELECT dxp, dyp, f, x, y FROM firsts WHERE (fw IS NOT NULL AND bw IS NOT NULL)
  OR list_contains(ks, fw + 1) OR list_contains(ks, fw + 2) OR list_contains(ks, -(bw + 1)) OR list_contains(ks, -(bw + 2))
  OR ((f < 2 OR f >= {FRAMES} - 2) AND (fw IS NOT NULL OR bw IS NOT NULL)))"""


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return motion.pairs(views.obs(spark, d), 15, 60)


def _peaks(spark: SparkSession, d: str) -> DataFrame:
    return motion.peaks(motion.histogram(_pairs(spark, d), 8, 60), 8, 60, total=2, each=1)


def _members(spark: SparkSession, d: str) -> DataFrame:
    return motion.members(_pairs(spark, d), _peaks(spark, d), 8)


def _chain(spark: SparkSession, d: str) -> DataFrame:
    return motion.chain_verified(_members(spark, d), views.obs(spark, d), 5, 16, FRAMES)


query("motion_pairs", f"WITH {PAIRS} SELECT * FROM pairs")(_pairs)
query("motion_histogram", f"WITH {HIST} SELECT * FROM hist")(lambda spark, d: motion.histogram(_pairs(spark, d), 8, 60))
query("motion_peaks", f"WITH {PEAKS} SELECT * FROM peaks")(_peaks)
query("peak_members", f"WITH {MEMBERS} SELECT * FROM members")(_members)
query("chain_verified", f"WITH {CHAIN} SELECT * FROM chain")(_chain)


@query("vote_floors", f"WITH {HIST} SELECT t::INT AS floor, count(*) FILTER (total >= t) AS bins FROM hist, (VALUES (10), (15), (20), (25), (30)) v(t) GROUP BY t")
def _(spark, d):
    return motion.votes_table(motion.histogram(_pairs(spark, d), 8, 60))


@query(
    "gap_fill",
    f"""WITH {CHAIN}, empty AS (SELECT DISTINCT dxp, dyp, f FROM members EXCEPT SELECT dxp, dyp, f FROM chain),
    moved AS MATERIALIZED (SELECT c.dxp, c.dyp, c.f + b AS f, c.x + b * c.dxp AS x, c.y + b * c.dyp AS y FROM chain c, range(1, 3) r(b)),
    l AS MATERIALIZED (SELECT m.*, m.f + w AS fv, m.x + w * m.dxp AS ex, m.y + w * m.dyp AS ey FROM moved m JOIN empty USING (dxp, dyp, f), range(1, 3) s(w))
    SELECT DISTINCT l.dxp, l.dyp, l.f, l.x::INT AS x, l.y::INT AS y FROM l JOIN chain c ON c.dxp = l.dxp AND c.dyp = l.dyp AND c.f = l.fv
    WHERE (c.x - l.ex) * (c.x - l.ex) + (c.y - l.ey) * (c.y - l.ey) <= 256""",
)
def _(spark, d):
    return motion.gap_filled(_members(spark, d), _chain(spark, d), 2, 16)


@query(
    "persistence_filter",
    f"""WITH {OBS}, c AS (SELECT x // 40 AS gx, y // 40 AS gy, count(DISTINCT f) AS n FROM obs GROUP BY 1, 2)
    SELECT f, event_id, x, y FROM obs JOIN c ON x // 40 = gx AND y // 40 = gy WHERE n <= 0.1 * {FRAMES}""",
)
def _(spark, d):
    return motion.not_persistent(views.obs(spark, d), 40, 0.1, FRAMES).select("f", "event_id", "x", "y")


@query(
    "point_clusters",
    f"""WITH RECURSIVE {OBS}, pts AS (SELECT DISTINCT f, x, y FROM obs),
    e AS MATERIALIZED (SELECT a.f, a.x, a.y, b.x AS x2, b.y AS y2 FROM pts a JOIN pts b ON a.f = b.f AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 6400),
    r AS (SELECT f, x, y, y * 1048576::BIGINT + x AS label FROM pts UNION SELECT e.f, e.x2, e.y2, r.label FROM r JOIN e USING (f, x, y)),
    l AS (SELECT f, x, y, min(label) AS label FROM r GROUP BY f, x, y),
    s AS (SELECT f, label, count(*) AS n, (var_samp(x) + var_samp(y)) / 2 AS half,
      sqrt(pow((var_samp(x) - var_samp(y)) / 2, 2) + pow(covar_samp(x, y), 2)) AS gap FROM l GROUP BY f, label HAVING count(*) >= 4),
    t AS (SELECT f, label, n, sqrt((half + gap) / (half - gap + 1e-6)) AS elongation FROM s)
    SELECT f, label, n, round(elongation, 4) AS elongation FROM t WHERE elongation >= 2""",
)
def _(spark, d):
    found = motion.long_clusters(motion.clusters(views.obs(spark, d), 80), 4, 2)
    return found.withColumn("elongation", F.round("elongation", 4))


@query(
    "snap_nearest",
    f"""WITH {PX}, p AS (SELECT f, y, x FROM px WHERE v > 160), t AS (SELECT f, y, x FROM px WHERE v > 190),
    n AS (SELECT p.f, p.y, p.x, t.y AS ty, t.x AS tx FROM p LEFT JOIN t ON p.f = t.f AND abs(p.y - t.y) <= 2 AND abs(p.x - t.x) <= 2
      QUALIFY row_number() OVER (PARTITION BY p.f, p.y, p.x ORDER BY (p.y - t.y) * (p.y - t.y) + (p.x - t.x) * (p.x - t.x), t.y, t.x) = 1)
    SELECT f, y, x, coalesce(ty, y) AS ny, coalesce(tx, x) AS nx FROM n""",
)
def _(spark, d):
    px = views.px(spark, d)
    return motion.snapped(pixels.mask(px, 160), pixels.mask(px, 190), 2)


# --- lines, boxes, tiles ------------------------------------------------------------

SEGMENTS = f"""{OBS}, seg AS (SELECT f // 24 AS f, ch, event_id, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM obs
  WINDOW w AS (PARTITION BY f // 24, ch ORDER BY event_id))"""


def _segments(spark: SparkSession, d: str) -> DataFrame:
    days = views.obs(spark, d).withColumn("f", F.floor(F.col("f") / 24).cast("bigint"))
    return geometry.consecutive(days, ["f", "ch"], "event_id")


@query(
    "line_match",
    f"""WITH {SEGMENTS}, v AS (SELECT *, CASE WHEN x2 < x1 OR (x2 = x1 AND y2 < y1) THEN -1 ELSE 1 END AS g FROM seg WHERE x2 <> x1 OR y2 <> y1),
    l AS MATERIALIZED (SELECT f, ch, event_id, ((degrees(atan2(y2 - y1, x2 - x1)) % 180) + 180) % 180 AS angle,
      g * (y1 * (x2 - x1) - x1 * (y2 - y1)) / sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS rho FROM v),
    b AS MATERIALIZED (SELECT f + j AS fk, floor(rho / 10)::BIGINT + k AS band, angle, rho FROM l, (VALUES (-1), (1)) p(j), (VALUES (-1), (0), (1)) q(k))
    SELECT DISTINCT l.f, l.ch, l.event_id, round(l.angle, 5) AS angle, round(l.rho, 5) AS rho FROM l
    JOIN b ON l.f = b.fk AND floor(l.rho / 10)::BIGINT = b.band
    WHERE least(abs(l.angle - b.angle), 180 - abs(l.angle - b.angle)) < 0.1 AND abs(l.rho - b.rho) < 10""",
)
def _(spark, d):
    found = geometry.matched_lines(geometry.lines(_segments(spark, d)), angle=0.1, distance=10)
    return found.select("f", "ch", "event_id", F.round("angle", 5).alias("angle"), F.round("rho", 5).alias("rho"))


@query(
    "segment_points",
    f"""WITH {SEGMENTS}, n AS (SELECT *, greatest(2, floor(sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)) / 40)::INT) AS n FROM seg WHERE x2 IS NOT NULL),
    t AS (SELECT *, k / n AS t FROM (SELECT *, unnest(range(0, n + 1)) AS k FROM n)),
    p AS (SELECT f, trunc(x1 + t * (x2 - x1))::INT AS x, trunc(y1 + t * (y2 - y1))::INT AS y FROM t)
    SELECT DISTINCT f, x, y FROM p WHERE x > 10 AND x < 590 AND y > 10 AND y < 481""",
)
def _(spark, d):
    return geometry.segment_points(_segments(spark, d), 40, 10, 600, 491)


@query(
    "ios_overlap_pairs",
    f"""WITH {DET}, j AS (SELECT a.f, a.rk AS a, b.rk AS b,
      greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0)
      / least((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0)) AS ios FROM det a JOIN det b ON a.f = b.f AND a.rk < b.rk)
    SELECT f, a::INT AS a, b::INT AS b, ios FROM j WHERE ios >= 0.5""",
)
def _(spark, d):
    return geometry.overlapping(geometry.ranked(views.det(spark, d)))


@query(
    "nms_greedy",
    f"""WITH RECURSIVE {DET}, dm AS MATERIALIZED (SELECT * FROM det), k AS (SELECT f, rk, [{{'a': x0, 'b': y0, 'c': x1, 'd': y1}}] AS kept, true AS ok FROM dm WHERE rk = 1
      UNION ALL SELECT n.f, n.rk, CASE WHEN n.hit THEN n.kept ELSE list_append(n.kept, n.me) END, NOT n.hit FROM (
        SELECT t.f, t.rk, k.kept, {{'a': t.x0, 'b': t.y0, 'c': t.x1, 'd': t.y1}} AS me, len(list_filter(k.kept, lambda q:
          greatest(least(t.x1, q.c) - greatest(t.x0, q.a), 0) * greatest(least(t.y1, q.d) - greatest(t.y0, q.b), 0)
          / least((t.x1 - t.x0) * (t.y1 - t.y0), (q.c - q.a) * (q.d - q.b)) >= 0.5)) > 0 AS hit
        FROM k JOIN dm t ON t.f = k.f AND t.rk = k.rk + 1) n)
    SELECT f, rk::INT AS rk FROM k WHERE ok""",
)
def _(spark, d):
    return geometry.suppressed(geometry.ranked(views.det(spark, d)))


@query(
    "tile_grid",
    f"""WITH {FILES}, s AS (SELECT DISTINCT w, h FROM img), t AS (SELECT unnest(range(0, 12)) * 512 AS o)
    SELECT DISTINCT w, h, least(a.o, w - 640)::INT AS x0, least(b.o, h - 640)::INT AS y0 FROM s, t a, t b
    WHERE a.o < w - 640 + 512 AND b.o < h - 640 + 512""",
)
def _(spark, d):
    return geometry.tile_origins(_images(spark, d).select("w", "h").distinct())


# --- run log -------------------------------------------------------------------------


@query(
    "eta_estimate",
    """WITH t AS (SELECT user_id, event_id, epoch_us(ts) / 1000000.0::DOUBLE AS s FROM events),
    w AS (SELECT *, row_number() OVER o AS work_done, s - min(s) OVER (PARTITION BY user_id) AS spent, count(*) OVER (PARTITION BY user_id) AS total FROM t
      WINDOW o AS (PARTITION BY user_id ORDER BY s, event_id))
    SELECT user_id, event_id, work_done, round(CASE WHEN total - work_done <= 0 THEN 0 WHEN work_done >= 2 AND spent > 0
      THEN (total - work_done) / (work_done / spent) * 1.2::DOUBLE END, 3) AS remaining_sec FROM w""",
)
def _(spark, d):
    e = views.table(spark, d, "events")
    totals = e.groupBy("user_id").agg(F.count("*").alias("total"))
    s = F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000
    ticks = e.select("user_id", "event_id", F.col("event_id").alias("tick"), s.alias("s"), F.lit(1).alias("work")).join(totals, "user_id")
    out = runlog.remaining(ticks, "user_id", "s", F.col("total"))
    return out.select("user_id", "event_id", "work_done", F.round("remaining_sec", 3).alias("remaining_sec"))


@query(
    "log_throttle",
    """WITH RECURSIVE e AS MATERIALIZED (SELECT event_id, user_id, epoch_us(ts) AS t FROM events),
    k AS (SELECT user_id, min(t) AS t FROM e GROUP BY user_id
      UNION ALL SELECT user_id, t FROM (SELECT k.user_id, (SELECT min(e.t) FROM e WHERE e.user_id = k.user_id AND e.t >= k.t + 64800000000) AS t FROM k) WHERE t IS NOT NULL)
    SELECT e.user_id, e.event_id, e.t FROM k JOIN e USING (user_id, t)""",
)
def _(spark, d):
    e = views.table(spark, d, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return runlog.throttled(e, "user_id", "t", 18 * 3_600_000_000)


@query(
    "bad_file_cap",
    """SELECT event_id, user_id, failures FROM (SELECT event_id, user_id, sum((event_type = 'error')::INT) OVER
    (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS failures FROM events) WHERE failures <= 1""",
)
def _(spark, d):
    e = views.table(spark, d, "events")
    return runlog.until_failures(e, "user_id", ["ts", "event_id"], F.col("event_type") == "error").select("event_id", "user_id", "failures")


TAGS = "tags AS (SELECT page_id, 'v' || regexp_extract(url, '(\\d+)', 1) || '.' || (page_id % 10) || '-beta' AS tag FROM pages)"


def _tags(spark: SparkSession, d: str) -> DataFrame:
    tag = F.concat(F.lit("v"), F.regexp_extract("url", r"(\d+)", 1), F.lit("."), (F.col("page_id") % 10).cast("string"), F.lit("-beta"))
    return views.table(spark, d, "pages").select("page_id", tag.alias("tag"))


@query(
    "version_parse",
    f"""WITH {TAGS}, t AS (SELECT page_id, tag FROM tags UNION ALL SELECT -page_id - 1, CASE page_id % 4 WHEN 0 THEN 'not-a-tag' WHEN 1 THEN 'model-v2.5' WHEN 2 THEN '' END FROM tags)
    SELECT page_id, tag, TRY_CAST(nullif(regexp_extract(tag, '^v(\\d+(?:\\.\\d+)?)', 1), '') AS DOUBLE) AS version,
    TRY_CAST(nullif(regexp_extract(trim(tag), '^model-v(\\d+(?:\\.\\d+)?)', 1), '') AS DOUBLE) AS model FROM t""",
)
def _(spark, d):
    tags = _tags(spark, d)
    odd = F.when(F.col("page_id") % 4 == 0, "not-a-tag").when(F.col("page_id") % 4 == 1, "model-v2.5").when(F.col("page_id") % 4 == 2, "")
    all_ = tags.union(tags.select((-F.col("page_id") - 1).alias("page_id"), odd.alias("tag")))
    return all_.select("page_id", "tag", text.app_version(F.col("tag")).alias("version"), text.model_version(F.col("tag")).alias("model"))


@query(
    "newest_release",
    f"""WITH {TAGS} SELECT page_id, tag, TRY_CAST(regexp_extract(tag, '^v(\\d+(?:\\.\\d+)?)', 1) AS DOUBLE) AS version FROM tags
    WHERE version > 1.5 ORDER BY version DESC, page_id LIMIT 1""",
)
def _(spark, d):
    tags = _tags(spark, d).withColumn("version", text.app_version(F.col("tag")))
    return runlog.newest_release(tags, "version", 1.5, "page_id")


@query(
    "hms_format",
    """WITH s AS (SELECT o_orderkey, greatest(trunc(o_totalprice / 10)::BIGINT, 0) AS s FROM orders)
    SELECT o_orderkey, CASE WHEN s >= 3600 THEN printf('%dh %02dm %02ds', s // 3600, s % 3600 // 60, s % 60)
    ELSE printf('%dm %02ds', s // 60, s % 60) END AS hms FROM s""",
)
def _(spark, d):
    return views.table(spark, d, "orders").select("o_orderkey", text.hms(F.col("o_totalprice") / 10).alias("hms"))


@query(
    "time_saved",
    """WITH s AS (SELECT o_orderkey, trunc(o_totalprice / 1000)::BIGINT AS n, n * 20 AS s FROM orders),
    m AS (SELECT *, greatest((round_even(s / 900.0::DOUBLE, 0) * 15)::BIGINT, 15) AS m FROM s)
    SELECT o_orderkey, n AS trails, '~' || CASE WHEN s < 60 THEN s || ' second' || CASE WHEN s <> 1 THEN 's' ELSE '' END
    WHEN m // 60 >= 1 AND m % 60 = 0 THEN m // 60 || ' hour' || CASE WHEN m // 60 <> 1 THEN 's' ELSE '' END
    WHEN m // 60 >= 1 THEN m // 60 || ' hour' || CASE WHEN m // 60 <> 1 THEN 's' ELSE '' END || ' ' || m % 60 || ' minute' || CASE WHEN m % 60 <> 1 THEN 's' ELSE '' END
    ELSE m || ' minute' || CASE WHEN m <> 1 THEN 's' ELSE '' END END AS saved FROM m""",
)
def _(spark, d):
    n = (F.col("o_totalprice") / 1000).cast("bigint")
    return views.table(spark, d, "orders").select("o_orderkey", n.alias("trails"), text.time_saved(n).alias("saved"))


@query(
    "progress_parse",
    """SELECT line, n, regexp_extract(line, '(\\d+)/(\\d+)', 1)::INT AS done, regexp_extract(line, '(\\d+)/(\\d+)', 2)::INT AS total,
    least(greatest(trunc((0 + done / total::DOUBLE * 0.67::DOUBLE) / 1 * 100)::INT, 0), 99) AS percent
    FROM (SELECT 'detecting ' || l_linenumber || '/7: IMG_' || l_partkey AS line, count(*) AS n FROM lineitem GROUP BY 1)""",
)
def _(spark, d):
    line = F.concat(F.lit("detecting "), F.col("l_linenumber").cast("string"), F.lit("/7: IMG_"), F.col("l_partkey").cast("string"))
    rows = views.table(spark, d, "lineitem").groupBy(line.alias("line")).agg(F.count("*").alias("n")).withColumn("p", text.progress(F.col("line")))
    share = text.phase_share(F.lit("detect"), F.col("p.done"), F.col("p.total"))
    return rows.select("line", "n", "p.done", "p.total", text.overall_percent(F.lit(0), share, F.lit(1)).alias("percent"))


# --- further operators --------------------------------------------------------------


@query(
    "brightness_lut",
    f"WITH {PX} SELECT v, count(*) AS n, trunc(least(greatest(255 * pow(v / 255.0::DOUBLE, 0.5::DOUBLE), 0::DOUBLE), 255::DOUBLE))::INT AS bright FROM px GROUP BY v",
)
def _(spark, d):
    rows = views.px(spark, d).groupBy("v").agg(F.count("*").alias("n"))
    return rows.select("v", "n", pixel.brightened(F.col("v"), 2.0).alias("bright"))


@query(
    "median_mad",
    f"""WITH {PX}, m AS (SELECT y, x, median(v) AS med FROM px GROUP BY y, x)
    SELECT y, x, med, median(abs(v - med)) AS mad FROM px JOIN m USING (y, x) GROUP BY y, x, med""",
)
def _(spark, d):
    return temporal.median_and_mad(views.px(spark, d), ["y", "x"])


@query(
    "wide_median",
    f"""WITH {PX} SELECT f, y, x, floor(median(v) OVER (PARTITION BY y, x ORDER BY f ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))::INT AS m FROM px""",
)
def _(spark, d):
    return temporal.wide_median(views.px(spark, d), 3).select("f", "y", "x", "m")


@query(
    "top_candidates",
    f"""WITH {PX} SELECT f, y, x, v FROM px WHERE v > 120 QUALIFY row_number() OVER (PARTITION BY f ORDER BY v DESC, x DESC, y DESC) <= 5""",
)
def _(spark, d):
    spots = views.px(spark, d).where("v > 120").withColumn("ch", F.lit("gray")).withColumn("peak", F.col("v"))
    return motion.strongest(spots, 5).select("f", "y", "x", "v")


#: The limits of a merge at the scale of frames of 8 by 8.
SMALL_MERGE = {"aspect": 1.2, "angle": 30.0, "across": 2.0, "gap_least": 0.0, "gap_most": 8.0, "overlap": 1}


def overlapping_pieces(spark: SparkSession, d: str) -> DataFrame:
    """``(f, mask_id, y, x)``: components of the left and of the right part of each frame, which share two columns."""
    bright = pixels.mask(views.px(spark, d), 140)
    left, right = (components.labelled(bright.where(s)).withColumn("side", F.lit(k)) for k, s in enumerate(("x <= 4", "x >= 3")))
    order = Window.partitionBy("f").orderBy("side", "label")
    return left.unionByName(right).withColumn("mask_id", F.dense_rank().over(order)).select("f", "mask_id", "y", "x")


@query("collinear_merge")
def _(spark, d):
    return geometry.merged_pieces(overlapping_pieces(spark, d), SMALL_MERGE)


from framelark.plans import details  # noqa: E402, F401  registers the further queries

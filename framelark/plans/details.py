"""Further named queries: single operators on the same views, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelark.functions import pixel, text
from framelark.operators import components, geometry, kernels, manifest, motion, pixels, runlog, temporal
from framelark.plans.catalogue import BGR, DET, FILES, OBS, PAIRS, PEAKS, PX, SEGMENTS, SKY, _images, _labelled, _pairs, _peaks, _segments, query
from framelark.plans import detection
from framelark.sources import images, sinks, views

# --- image files ------------------------------------------------------------------


def _files(spark: SparkSession, d: str, kind: str) -> DataFrame:
    found = images.assembled(views.bgr(spark, d))
    return found.select("f", images.encode(F.col("image"), kind).alias("content"))


def _decoded(files: DataFrame) -> DataFrame:
    return files.select("f", images.decode(F.col("content")).alias("d")).select("f", "d.*")


for kind, times in (("tif16", 257), ("tif8", 1), ("png", 1)):
    query(f"round_trip_{kind}", f"WITH {BGR} SELECT f, y, x, b * {times} AS b, g * {times} AS g, r * {times} AS r FROM bgr")(
        lambda spark, d, kind=kind: images.samples(_decoded(_files(spark, d, kind)), "f")
    )


@query("header_sizes", "SELECT vec_id AS f, k AS kind, 4 AS width, 4 AS height FROM embeddings, (VALUES ('jpeg'), ('png'), ('tif16')) v(k)")
def _(spark, d):
    parts = [_files(spark, d, k).withColumn("kind", F.lit(k)) for k in ("jpeg", "png", "tif16")]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.select("f", "kind", images.header_size(F.col("content")).alias("s")).select("f", "kind", "s.width", "s.height")


def _some_broken(spark: SparkSession, d: str) -> DataFrame:
    junk = F.when(F.col("f") % 5 == 0, F.lit("broken").cast("binary")).otherwise(F.col("content"))
    return _decoded(_files(spark, d, "tif8").withColumn("content", junk))


@query("reader_ladder", "SELECT vec_id AS f, vec_id % 5 <> 0 AS readable, CASE WHEN vec_id % 5 = 0 THEN 2 ELSE 1 END AS failed FROM embeddings")
def _(spark, d):
    return _some_broken(spark, d).select("f", F.col("image").isNotNull().alias("readable"), F.size("attempts").alias("failed"))


@query("unreadable_reasons", "SELECT 'png: ValueError: no PNG; tiff: KeyError: b''br''' AS why, count(*) AS n_files FROM embeddings WHERE vec_id % 5 = 0 HAVING count(*) > 0")
def _(spark, d):
    rows = _some_broken(spark, d).withColumn("why", text.diagnosis(F.col("attempts")))
    return manifest.readable(rows, "image", "why")[1]


# --- manifest ---------------------------------------------------------------------


@query("frame_limit", f"WITH {FILES} SELECT path FROM img ORDER BY path LIMIT 50")
def _(spark, d):
    return manifest.first_frames(_images(spark, d), 50).select("path")


@query("shared_metadata", f"WITH {FILES}, m AS (SELECT w, h FROM img WHERE frame_idx = 0) SELECT path, m.w, m.h FROM img, m")
def _(spark, d):
    return manifest.shared_metadata(_images(spark, d), ["w", "h"]).select("path", "w", "h")


@query("frame_count", f"WITH {FILES} SELECT count(*) AS n_frames FROM img")
def _(spark, d):
    return manifest.at_least(_images(spark, d), 3)


@query("uniform_size", "SELECT 'ok' AS state")
def _(spark, d):
    return manifest.homogeneous(manifest.of_dominant_size(_images(spark, d), order="frame_idx"), ["w", "h"])


@query("boundary_skip", f"WITH {FILES} SELECT path, frame_idx FROM img WHERE frame_idx BETWEEN 2 AND (SELECT max(frame_idx) FROM img) - 2")
def _(spark, d):
    return manifest.without_edges(_images(spark, d), 2).select("path", "frame_idx")


@query("core_batches", f"WITH {FILES} SELECT (frame_idx // 20)::INT AS batch, count(*) AS n FROM img GROUP BY 1")
def _(spark, d):
    return manifest.core_batches(_images(spark, d)).groupBy("batch").agg(F.count("*").alias("n"))


@query("skipped_files", f"WITH {FILES} SELECT doc_id, ext, 'unreadable-frame' AS fingerprint FROM files WHERE ext = 'txt'")
def _(spark, d):
    return manifest.bad_files(views.files(spark, d), F.col("ext") == "txt").select("doc_id", "ext", "fingerprint")


@query("skip_policy", f"WITH {FILES} SELECT doc_id, ext FROM files WHERE ext <> 'txt'")
def _(spark, d):
    return manifest.within_policy(views.files(spark, d), F.col("ext") == "txt", "skip", 10**12).select("doc_id", "ext")


@query("union_distinct", f"WITH {OBS} SELECT f, x, y FROM obs WHERE ch = 'color' UNION SELECT f, x, y FROM obs WHERE ch = 'gray'")
def _(spark, d):
    spots = views.obs(spark, d)
    return manifest.union_distinct(*[spots.where(F.col("ch") == c).select("f", "x", "y") for c in ("color", "gray")])


# --- pixel expressions --------------------------------------------------------------

CHANNELS = ("b", "g", "r")


@query(
    "channel_bias",
    f"WITH {BGR} SELECT f, y, x, b - 0.5::DOUBLE * (g + r) AS b, g - 0.5::DOUBLE * (b + r) AS g, r - 0.5::DOUBLE * (b + g) AS r, (b + g + r) / 3.0::DOUBLE AS luma FROM bgr",
)
def _(spark, d):
    b, g, r = map(F.col, CHANNELS)
    return views.bgr(spark, d).select(
        "f", "y", "x", pixel.bias(b, g, r).alias("b"), pixel.bias(g, b, r).alias("g"), pixel.bias(r, b, g).alias("r"), pixel.mean_level(b, g, r).alias("luma")
    )


@query(
    "line_distance",
    f"""WITH {OBS} SELECT event_id, round(abs((y - 240) * cos(radians(f % 180)) - (x - 300) * sin(radians(f % 180))), 6) AS far,
    round(cos(radians(f % 180)), 9) AS ux, round(sin(radians(f % 180)), 9) AS uy FROM obs""",
)
def _(spark, d):
    a = F.col("f") % 180
    far = pixel.line_distance(F.col("x"), F.col("y"), F.lit(300), F.lit(240), a)
    ux, uy = pixel.unit_vector(a)
    return views.obs(spark, d).select("event_id", F.round(far, 6).alias("far"), F.round(ux, 9).alias("ux"), F.round(uy, 9).alias("uy"))


@query(
    "resolution_limits",
    f"""WITH {FILES}, s AS (SELECT DISTINCT w, h, w * h / 19961856.0::DOUBLE AS area FROM img)
    SELECT w, h, round(area, 9) AS area, round(sqrt(area), 9) AS linear, greatest(500, trunc(2000 * area)::INT) AS least FROM s""",
)
def _(spark, d):
    area, linear = pixel.resolution_scale(F.col("w"), F.col("h"))
    least = pixel.scaled_floor(500, 2000.0, area)
    return _images(spark, d).select("w", "h").distinct().select("w", "h", F.round(area, 9).alias("area"), F.round(linear, 9).alias("linear"), least.alias("least"))


@query("mask_overlay", f"WITH {PX} SELECT f, y, x, CASE WHEN v > 127 THEN 2164195328 ELSE 0 END::BIGINT AS argb FROM px")
def _(spark, d):
    return views.px(spark, d).select("f", "y", "x", pixel.overlay(F.col("v")).alias("argb"))


@query("debug_overlay", f"WITH {PX} SELECT f, y, x, CASE WHEN v > 160 THEN floor(127.5::DOUBLE + 0.5::DOUBLE * v)::INT ELSE v END AS v FROM px")
def _(spark, d):
    px = views.px(spark, d)
    return pixels.debug_overlay(px, pixels.mask(px, 160)).select("f", "y", "x", "v")


@query("repainted", f"WITH {PX}, {SKY} SELECT f, y, x, CASE WHEN px.v > 160 THEN sky.v ELSE px.v END AS v FROM px JOIN sky USING (y, x)")
def _(spark, d):
    px = views.px(spark, d)
    return pixels.repainted(px, pixels.mask(px, 160), temporal.clean_sky(px)).select("f", "y", "x", "v")


# --- text -----------------------------------------------------------------------------


@query(
    "version_names",
    """WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'abc' ELSE '  ' || (o_orderkey % 20) || '.' || lpad((o_custkey % 1000)::VARCHAR, 3, '0') || ' ' END AS s FROM orders),
    v AS (SELECT o_orderkey, TRY_CAST(trim(s) AS DOUBLE) AS version FROM t)
    SELECT o_orderkey, version, regexp_replace(version::VARCHAR, '\\.?0+$', '') AS name FROM v""",
)
def _(spark, d):
    number = F.concat(F.lit("  "), (F.col("o_orderkey") % 20).cast("string"), F.lit("."), F.lpad((F.col("o_custkey") % 1000).cast("string"), 3, "0"), F.lit(" "))
    rows = views.table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, "abc").otherwise(number).alias("s"))
    rows = rows.select("o_orderkey", text.local_version(F.col("s")).alias("version"))
    return rows.select("o_orderkey", "version", text.display_name(F.col("version")).alias("name"))


BODY = """b AS (SELECT page_id, '  ' || chr(10) || ' Release ' || page_id || chr(13) || chr(10) || 'More.' ||
  CASE WHEN page_id % 3 = 0 THEN '' ELSE chr(10) || ' CREDITS:  someone ' || (page_id % 7) || chr(10) || 'credits: another' END AS body FROM pages)"""


def _bodies(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("page_id").cast("string")
    credit = F.concat(F.lit("\n CREDITS:  someone "), (F.col("page_id") % 7).cast("string"), F.lit("\ncredits: another"))
    body = F.concat(F.lit("  \n Release "), i, F.lit("\r\nMore."), F.when(F.col("page_id") % 3 == 0, "").otherwise(credit))
    return views.table(spark, d, "pages").select("page_id", body.alias("body"))


@query(
    "release_notes",
    f"""WITH {BODY}, l AS (SELECT page_id, list_filter(list_transform(string_split_regex(body, '\\r\\n|\\n'), lambda x: trim(x)), lambda x: x <> '') AS l FROM b)
    SELECT page_id, l[1] AS summary, trim(regexp_replace(list_filter(l, lambda x: lower(x) LIKE 'credits:%')[1], '(?i)^credits:', '')) AS credits FROM l""",
)
def _(spark, d):
    return _bodies(spark, d).select("page_id", text.release_notes(F.col("body")).alias("n")).select("page_id", "n.*")


def _assets() -> Column:
    i = F.col("page_id")
    name = F.concat(F.lit("m"), i.cast("string"), F.when(i % 3 == 0, ".PT").otherwise(".zip"))
    url = F.when(i % 2 == 0, F.concat(F.lit("u/"), i.cast("string")))
    pair = lambda n, u: F.struct(n.alias("name"), u.alias("browser_download_url"))
    return F.array(pair(name, url), pair(F.lit("last.pt"), F.when(i % 5 != 0, F.lit("u/last")).otherwise("")), pair(F.lit(None).cast("string"), F.lit("u/none")))


@query(
    "first_asset",
    """SELECT page_id, CASE WHEN page_id % 3 = 0 AND page_id % 2 = 0 THEN 'u/' || page_id WHEN page_id % 5 <> 0 THEN 'u/last' END AS url,
    coalesce(CASE WHEN page_id % 4 = 0 THEN 'own' END, CASE WHEN page_id % 3 = 0 THEN 'bundled' END, 'dev') AS model FROM pages""",
)
def _(spark, d):
    i = F.col("page_id")
    model = text.first_known(F.when(i % 4 == 0, "own"), F.when(i % 3 == 0, "bundled"), F.lit("dev"))
    return views.table(spark, d, "pages").select("page_id", text.first_asset(_assets()).alias("url"), model.alias("model"))


@query(
    "release_feed",
    f"WITH {BODY} SELECT 'v' || page_id AS tag_name, body, 3 AS n_assets FROM b WHERE page_id % 4 <> 0",
)
def _(spark, d):
    tag = F.when(F.col("page_id") % 4 != 0, F.concat(F.lit("v"), F.col("page_id").cast("string")))
    rows = _bodies(spark, d).select(F.to_json(F.array(F.struct(tag.alias("tag_name"), "body", _assets().alias("assets")))).alias("value"))
    return runlog.releases(rows).select("tag_name", "body", F.size("assets").alias("n_assets"))


@query(
    "log_elision",
    """WITH l AS (SELECT user_id, list(event_type ORDER BY event_id) AS l FROM events GROUP BY user_id)
    SELECT user_id, array_to_string(CASE WHEN len(l) > 6 THEN l[1:3] || ['...'] || l[-3:] ELSE l END, ',') AS log FROM l""",
)
def _(spark, d):
    lines = F.transform(F.sort_array(F.collect_list(F.struct("event_id", "event_type"))), lambda e: e["event_type"])
    rows = views.table(spark, d, "events").groupBy("user_id").agg(lines.alias("l"))
    return rows.select("user_id", F.array_join(text.elided(F.col("l"), 3), ",").alias("log"))


@query(
    "installers",
    """WITH s AS (SELECT DISTINCT user_id, ['win32', 'Darwin', 'linux2', 'haiku'][user_id % 4 + 1] AS s, ['x86_64', 'ARM64', 'i686', NULL][user_id % 5 % 4 + 1] AS m FROM events)
    SELECT user_id, CASE WHEN user_id + 21950 >= 22000 THEN '11' ELSE '10' END AS os, CASE WHEN s = 'Darwin' AND m IN ('x86_64', 'i686') THEN 'mac-intel'
    WHEN s = 'Darwin' THEN 'mac-arm' WHEN s = 'linux2' THEN 'linux' ELSE 'windows' END AS kind FROM s""",
)
def _(spark, d):
    u = F.col("user_id")
    pick = lambda names, i: F.element_at(F.array(*[F.lit(n).cast("string") for n in names]), (i + 1).cast("int"))
    kind = text.installer(pick(("win32", "Darwin", "linux2", "haiku"), u % 4), pick(("x86_64", "ARM64", "i686", None), u % 5 % 4))
    return views.table(spark, d, "events").select("user_id").distinct().select("user_id", text.windows_name(u + 21950).alias("os"), kind.alias("kind"))


@query(
    "file_stamp",
    """WITH s AS (SELECT page_id, concat_ws(' / ', 'app v' || (page_id % 9), CASE WHEN page_id % 2 = 0 THEN 'model v' || page_id END, 'site') AS s FROM pages)
    SELECT page_id, s AS stamp, regexp_replace(hex(encode(s)), '(..)', '\\100', 'g') || '0000' AS comment FROM s""",
)
def _(spark, d):
    i = F.col("page_id")
    parts = F.concat(F.lit("app v"), (i % 9).cast("string")), F.when(i % 2 == 0, F.concat(F.lit("model v"), i.cast("string"))), F.lit("site")
    rows = views.table(spark, d, "pages").select("page_id", text.stamp(*parts).alias("stamp"))
    return rows.select("page_id", "stamp", F.hex(text.xp_comment(F.col("stamp"))).alias("comment"))


# --- run log ----------------------------------------------------------------------------


@query(
    "timing_seed",
    """WITH t AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 0 ELSE o_custkey * 1000 END AS image_pixels, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice / 100000 ELSE 0 END AS s,
      CASE WHEN o_orderkey % 3 = 1 THEN o_totalprice / 5000 END AS w FROM orders)
    SELECT round(CASE WHEN image_pixels > 0 THEN coalesce(CASE WHEN s > 0 THEN s END, CASE WHEN w > 0 THEN w / 20 END) * (19961856.0::DOUBLE / image_pixels) END, 4) AS sec_per_frame FROM t""",
)
def _(spark, d):
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    rows = views.table(spark, d, "orders").select(
        F.when(F.col("o_orderstatus") == "F", 0).otherwise(F.col("o_custkey") * 1000).alias("image_pixels"),
        F.when(k % 3 == 0, price / 100000).otherwise(0.0).alias("sec_per_frame"),
        F.when(k % 3 == 1, price / 5000).alias("warm_batch_mean"),
    )
    return runlog.seed_rate(rows, 5472 * 3648).select(F.round("sec_per_frame", 4).alias("sec_per_frame"))


@query(
    "first_estimate",
    """WITH t AS (SELECT user_id, event_id, epoch_us(ts) / 1000000.0::DOUBLE AS s FROM events),
    w AS (SELECT *, row_number() OVER o AS n, s - min(s) OVER (PARTITION BY user_id) AS spent, count(*) OVER (PARTITION BY user_id) AS total FROM t
      WINDOW o AS (PARTITION BY user_id ORDER BY s, event_id)),
    e AS (SELECT user_id, s, CASE WHEN total - n <= 0 THEN 0 WHEN n >= 2 AND spent > 0 THEN (total - n) / (n / spent) * 1.2::DOUBLE END AS left_ FROM w)
    SELECT user_id, round(arg_min(left_, s), 3) AS first_estimate FROM e WHERE left_ IS NOT NULL GROUP BY user_id""",
)
def _(spark, d):
    e = views.table(spark, d, "events")
    totals = e.groupBy("user_id").agg(F.count("*").alias("total"))
    s = F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000
    ticks = e.select("user_id", F.col("event_id").alias("tick"), s.alias("s"), F.lit(1).alias("work")).join(totals, "user_id")
    out = runlog.first_estimate(runlog.remaining(ticks, "user_id", "s", F.col("total")), "user_id", "s")
    return out.select("user_id", F.round("first_estimate", 3).alias("first_estimate"))


@query(
    "run_summary",
    """SELECT 'Run summary' || chr(10) || 'frames: ' || count(*) || chr(10) || 'done: ' || count(*) FILTER (o_orderstatus = 'F') || chr(10) || 'first: ' || min(o_orderpriority)
    || chr(10) || 'none: -' AS value FROM orders""",
)
def _(spark, d):
    o = views.table(spark, d, "orders")
    counts = o.agg(
        F.count("*").alias("frames"), F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.min("o_orderpriority").alias("first"), F.max(F.lit(None).cast("string")).alias("none")
    )
    return runlog.summary(counts)


@query(
    "telemetry_rows",
    "SELECT " + ", ".join({"run_id": "user_id AS run_id", "phase": "event_type AS phase", "elapsed_sec": "value AS elapsed_sec"}.get(c, f"NULL::VARCHAR AS {c}") for c in sinks.TELEMETRY) + " FROM events",
)
def _(spark, d):
    e = views.table(spark, d, "events")
    return sinks.telemetry(e.select(F.col("user_id").alias("run_id"), F.col("event_type").alias("phase"), F.col("value").alias("elapsed_sec")))


# --- masks ---------------------------------------------------------------------------------


@query("mask_bag", f"WITH {PX} SELECT f, y, x FROM px WHERE v > 150 UNION ALL SELECT f, y, x FROM px WHERE v < 170")
def _(spark, d):
    px = views.px(spark, d)
    return pixels.mask_union_all(pixels.mask(px, 150), px.where("v < 170"))


@query("mask_invert", f"WITH {PX} SELECT f, y, x FROM px WHERE v <= 160")
def _(spark, d):
    px = views.px(spark, d)
    extents = px.select("f", F.lit(8).alias("h"), F.lit(8).alias("w")).distinct()
    return pixels.inverted(pixels.mask(px, 160), extents).select("f", "y", "x")


@query("mask_states", f"WITH {PX} SELECT f, coalesce(max(v > 190), false) AS marked FROM px GROUP BY f")
def _(spark, d):
    px = views.px(spark, d)
    return pixels.states(pixels.mask(px, 190), px.select("f").distinct())


@query("centroids_in_sky", f"WITH {OBS} SELECT f, event_id, x, y FROM obs WHERE (x, y) NOT IN (SELECT (x, y) FROM obs WHERE y < 100 OR x > 400)")
def _(spark, d):
    spots = views.obs(spark, d).select("f", "event_id", "x", "y")
    return pixels.centroids_in_sky(spots, spots.where("y < 100 OR x > 400").select("x", "y").distinct()).select("f", "event_id", "x", "y")


@query("mask_resize", f"WITH {PX} SELECT f, ny::INT AS y, nx::INT AS x FROM px, range(12) i(ny), range(5) j(nx) WHERE v > 160 AND y = ny * 8 // 12 AND x = nx * 8 // 5")
def _(spark, d):
    return pixels.resized(pixels.mask(views.px(spark, d), 160), (8, 8), (12, 5))


STROKES = f"""{BGR}, s AS (SELECT f, b % 16 AS x0, g % 16 AS y0, r % 16 AS x1, (b + r) % 16 AS y1 FROM bgr)"""


@query(
    "brush_strokes",
    f"""WITH {STROKES}, n AS (SELECT *, greatest(1, ceil(sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)))::INT) AS n FROM s),
    k AS (SELECT *, unnest(range(0, n + 1)) AS k FROM n),
    p AS (SELECT f, round_even(x0 + k / n * (x1 - x0), 0)::INT AS x, round_even(y0 + k / n * (y1 - y0), 0)::INT AS y FROM k)
    SELECT DISTINCT f, (y + dy)::INT AS y, (x + dx)::INT AS x FROM p, range(-2, 3) i(dy), range(-2, 3) j(dx) WHERE dy * dy + dx * dx <= 4""",
)
def _(spark, d):
    b, g, r = map(F.col, CHANNELS)
    strokes = views.bgr(spark, d).select("f", (b % 16).alias("x0"), (g % 16).alias("y0"), (r % 16).alias("x1"), ((b + r) % 16).alias("y1"))
    return pixels.brushed(strokes, 2).select("f", "y", "x")


def labels_sql(name: str, mask: str) -> str:
    """CTEs that label the pixels of a CTE ``mask(f, y, x)`` as ``name(f, y, x, label)``."""
    return f"""e_{name} AS MATERIALIZED (SELECT a.f, a.y, a.x, b.y AS y2, b.x AS x2 FROM {mask} a JOIN {mask} b ON a.f = b.f AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1),
r_{name} AS (SELECT f, y, x, y * 1048576::BIGINT + x AS label FROM {mask} UNION SELECT e.f, e.y2, e.x2, r.label FROM r_{name} r JOIN e_{name} e USING (f, y, x)),
{name} AS (SELECT f, y, x, min(label) AS label FROM r_{name} GROUP BY f, y, x)"""


@query(
    "small_red_components",
    f"""WITH RECURSIVE {BGR}, m AS (SELECT f, y, x FROM bgr WHERE greatest(b, g, r) > 150), {labels_sql("lab", "m")},
    k AS (SELECT f, label FROM lab JOIN bgr USING (f, y, x) GROUP BY f, label
      HAVING count(*) >= 6 OR (avg(r) > 80 AND avg(r) > 1.5 * avg(g) AND avg(r) > 1.5 * avg(b)))
    SELECT lab.* FROM lab JOIN k USING (f, label)""",
)
def _(spark, d):
    bgr = views.bgr(spark, d)
    lab = components.labelled(bgr.where(F.greatest(*CHANNELS) > 150).select("f", "y", "x"))
    return components.small_filter(lab, 6, bgr).select("f", "y", "x", "label")


SHAPES = """s AS (SELECT lab.f, lab.label, count(*) AS area, avg((v > 180)::INT) AS bright_frac, var_samp(lab.x) AS a, covar_samp(lab.x, lab.y) AS b, var_samp(lab.y) AS c
  FROM lab JOIN px ON lab.f = px.f AND lab.y = px.y AND lab.x = px.x GROUP BY lab.f, lab.label),
h AS (SELECT *, (a + c) / 2 AS half, sqrt(pow((a - c) / 2, 2) + pow(b, 2)) AS gap FROM s),
shapes AS (SELECT f, label, area, bright_frac, sqrt(half + gap) / greatest(0.5::DOUBLE, sqrt(greatest(half - gap, 0::DOUBLE))) AS aspect FROM h)"""


@query(
    "shape_sanity",
    f"""WITH RECURSIVE {PX}, m AS (SELECT f, y, x FROM px WHERE v > 140), {labels_sql("lab", "m")}, {SHAPES}
    SELECT f, label, area, round(aspect, 5) AS aspect FROM shapes WHERE area < 4 OR aspect >= 1.5001 OR bright_frac >= 0.4001""",
)
def _(spark, d):
    px = views.px(spark, d)
    lab = components.labelled(pixels.mask(px, 140))
    figures = lab.join(px, ["f", "y", "x"]).groupBy("f", "label").agg(F.count("*").alias("area"), F.avg((F.col("v") > 180).cast("int")).alias("bright_frac"))
    long = components.elongation(lab, "f", "label", least=2).select("f", "label", F.col("elongation").alias("aspect"))
    found = components.plausible(figures.join(long, ["f", "label"], "left"), large=4, aspect=1.5001, bright=0.4001)
    return found.select("f", "label", "area", F.round("aspect", 5).alias("aspect"))


@query(
    "truncation_touch",
    f"""WITH RECURSIVE {PX}, m AS (SELECT f, y, x FROM px WHERE v > 170), {labels_sql("lab", "m")},
    o AS (SELECT DISTINCT f, y + dy AS y, x + dx AS x FROM px, range(-1, 2) i(dy), range(-1, 2) j(dx) WHERE v > 150 AND v <= 170 AND y + dy BETWEEN 0 AND 7 AND x + dx BETWEEN 0 AND 7),
    {labels_sql("wide", "o")}, n AS (SELECT w.f, w.label AS a, l.label AS b, count(*) AS shared FROM wide w JOIN lab l ON w.f = l.f AND w.y = l.y AND w.x = l.x GROUP BY ALL)
    SELECT f, a, b, shared FROM n QUALIFY row_number() OVER (PARTITION BY f, a ORDER BY shared DESC, b) = 1""",
)
def _(spark, d):
    px = views.px(spark, d)
    blobs = pixels.mask_difference(pixels.mask(px, 150), pixels.mask(px, 170))
    wide = components.labelled(pixels.dilated(blobs, pixels.square(3), 8, 8))
    return components.touched(wide, components.labelled(pixels.mask(px, 170)))


# --- points, lines, boxes --------------------------------------------------------------------


@query(
    "edge_margins",
    f"""WITH {OBS} SELECT event_id, x >= 12 AND x < 588 AND y >= 12 AND y < 479 AS wide, x > 12 AND x < 588 AND y > 12 AND y < 479 AS strict FROM obs
    WHERE x >= 12 AND x < 588 AND y >= 12 AND y < 479""",
)
def _(spark, d):
    spots = views.obs(spark, d)
    wide = motion.within_margin(spots, 12, 600, 491)
    strict = motion.within_margin(spots, 12, 600, 491, strict=True).select("event_id", F.lit(True).alias("s"))
    return wide.join(strict, "event_id", "left").select("event_id", F.lit(True).alias("wide"), F.coalesce("s", F.lit(False)).alias("strict"))


@query("top_peaks", f"WITH {PEAKS} SELECT * FROM peaks ORDER BY votes DESC, dx, dy LIMIT 3")
def _(spark, d):
    return motion.top_peaks(_peaks(spark, d), 3)


@query(
    "star_parallel",
    f"""WITH {SEGMENTS}, a AS (SELECT f, ch, event_id, ((degrees(atan2(y2 - y1, x2 - x1)) % 180) + 180) % 180 AS a FROM seg WHERE x2 <> x1 OR y2 <> y1)
    SELECT f, ch, event_id FROM a WHERE least(abs(a - 37), 180 - abs(a - 37)) >= 20""",
)
def _(spark, d):
    return geometry.not_parallel(geometry.lines(_segments(spark, d)), 37.0, 20.0).select("f", "ch", "event_id")


@query(
    "direction_edges",
    f"""WITH {OBS}, p AS (SELECT DISTINCT f, x, y FROM obs), e AS (SELECT a.f, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS "by" FROM p a JOIN p b ON a.f = b.f AND (a.x < b.x OR (a.x = b.x AND a.y < b.y))),
    g AS (SELECT *, ((degrees(atan2("by" - ay, bx - ax)) % 180) + 180) % 180 AS d FROM e WHERE (bx - ax) * (bx - ax) + ("by" - ay) * ("by" - ay) <= 6400)
    SELECT f, ax, ay, bx, "by" FROM g WHERE least(abs(d - 31), 180 - abs(d - 31)) <= 20 OR least(abs(d - 121), 180 - abs(d - 121)) <= 20""",
)
def _(spark, d):
    spots = views.obs(spark, d).select("f", "x", "y").distinct()
    return geometry.directed_edges(spots, [31.0, 121.0], 80, 20).select("f", "ax", "ay", "bx", "by")


@query(
    "seam_boxes",
    f"""WITH {DET} SELECT f, rk::INT AS rk FROM det WHERE abs(x0 - 128) <= 8 OR abs(x1 - 128) <= 8 OR abs(x0 - 256) <= 8 OR abs(x1 - 256) <= 8 OR abs(y0 - 64) <= 8 OR abs(y1 - 64) <= 8""",
)
def _(spark, d):
    return geometry.near_seams(geometry.ranked(views.det(spark, d)), [128, 256], [64], 8).select("f", "rk")


@query(
    "tile_members",
    f"""WITH {PX}, o AS (SELECT DISTINCT least(k * 3, 3) AS o FROM range(2) r(k)) SELECT f, y, x, a.o::INT AS x0, b.o::INT AS y0 FROM px, o a, o b
    WHERE x BETWEEN a.o AND a.o + 4 AND y BETWEEN b.o AND b.o + 4""",
)
def _(spark, d):
    extents = views.px(spark, d).select(F.lit(8).alias("w"), F.lit(8).alias("h")).distinct()
    tiles = geometry.tile_origins(extents, 5, 0.4)
    return geometry.in_tiles(views.px(spark, d), tiles, 5).select("f", "y", "x", "x0", "y0")


@query(
    "star_angle",
    f"""WITH {PAIRS} SELECT round(quantile_cont(((degrees(atan2(dy, dx)) % 180) + 180) % 180, 0.5), 6) AS star_angle FROM pairs WHERE sqrt(dx * dx + dy * dy) >= 0.5""",
)
def _(spark, d):
    return kernels.star_angle(_pairs(spark, d)).select(F.round("star_angle", 6).alias("star_angle"))


# --- temporal and dense kernels ----------------------------------------------------------------


@query(
    "row_gain_applied",
    f"""WITH {PX}, {SKY}, q AS (SELECT y, quantile_cont(v, 0.75) AS q FROM sky GROUP BY y), r AS (SELECT greatest(quantile_cont(q, 0.2), 5) AS ref FROM q),
    g AS (SELECT y, least(greatest((q + 2) / (ref + 2), 1.0::DOUBLE), 3.0::DOUBLE) AS gain FROM q, r)
    SELECT f, y, x, least(floor(v * gain), 255)::INT AS v FROM px JOIN g USING (y)""",
)
def _(spark, d):
    px = views.px(spark, d)
    return temporal.with_gain(px, temporal.row_gain(temporal.clean_sky(px))).select("f", "y", "x", "v")


@query(
    "row_smoothing",
    f"""WITH {PX}, {SKY}, q AS (SELECT y, quantile_cont(v, 0.75) AS q FROM sky GROUP BY y),
    s AS (SELECT y, (exp(-0.5::DOUBLE) * coalesce(lag(q) OVER w, q) + q + exp(-0.5::DOUBLE) * coalesce(lead(q) OVER w, q)) / (1 + 2 * exp(-0.5::DOUBLE)) AS q FROM q WINDOW w AS (ORDER BY y)),
    r AS (SELECT greatest(quantile_cont(q, 0.2), 5) AS ref FROM s)
    SELECT y, round(q, 6) AS q, round(least(greatest((q + 2) / (ref + 2), 1.0::DOUBLE), 3.0::DOUBLE), 6) AS gain FROM s, r""",
)
def _(spark, d):
    rows = temporal.row_gain(temporal.clean_sky(views.px(spark, d)), smooth=3)
    return rows.select("y", F.round("q", 6).alias("q"), F.round("gain", 6).alias("gain"))


@query(
    "coloured_hot_pixels",
    f"""WITH {BGR}, c AS (SELECT f, y, x, 'b' AS c, b AS v FROM bgr UNION ALL SELECT f, y, x, 'g', g FROM bgr UNION ALL SELECT f, y, x, 'r', r FROM bgr),
    o AS (SELECT a.f, a.y, a.x, a.c, a.v, median(b.v) AS m FROM c a, range(-1, 2) i(dy), range(-1, 2) j(dx)
      JOIN c b ON b.f = a.f AND b.c = a.c AND b.y = greatest(0, least(3, a.y + dy)) AND b.x = greatest(0, least(3, a.x + dx)) GROUP BY ALL),
    n AS (SELECT count(DISTINCT f) AS n FROM bgr),
    h AS (SELECT y, x, c, count(*) FILTER (v / greatest(m, 1) > 1.1::DOUBLE AND v > 5) AS h FROM o GROUP BY ALL),
    e AS (SELECT y, x, count(*) FILTER (greatest(b, g, r) - (b + g + r - greatest(b, g, r)) / 2.0::DOUBLE >= 30) AS e FROM bgr GROUP BY ALL)
    SELECT DISTINCT y, x FROM h JOIN e USING (y, x), n WHERE h >= floor(0.2 * n) AND e >= floor(0.2 * n)""",
)
def _(spark, d):
    return temporal.coloured_hot_pixels(views.bgr(spark, d), ratio=1.1, least=5, excess=30, size=3, fraction=0.2)


def _rings(level: str) -> str:
    """CTEs: each pixel's ``c`` and ``i``, its own and its neighbours' distance from the ring around, by (f, y, x, k)."""
    return f"""{BGR}, v AS ({level}),
    o AS (SELECT a.f, a.y, a.x, a.k, a.d, avg(b.d) FILTER (greatest(abs(dy), abs(dx)) >= 2) AS far, avg(b.d) FILTER (greatest(abs(dy), abs(dx)) = 1) AS near
      FROM v a, range(-3, 4) i(dy), range(-3, 4) j(dx) JOIN v b ON b.f = a.f AND b.k = a.k AND b.y = greatest(0, least(3, a.y + dy)) AND b.x = greatest(0, least(3, a.x + dx)) GROUP BY ALL),
    r AS (SELECT f, y, x, d - far AS c, near - far AS i FROM o), n AS (SELECT count(DISTINCT f) AS n FROM bgr)"""


@query(
    "white_defect_map",
    f"""WITH {_rings("SELECT f, y, x, 0 AS k, (b + g + r) / 3.0::DOUBLE AS d FROM bgr")}, h AS (SELECT y, x, count(*) AS hits FROM r WHERE abs(c) >= 12.0007 AND abs(i) >= 3.0007 AND c * i > 0 GROUP BY y, x)
    SELECT y, x, hits FROM h, n WHERE hits >= ceil(0.2 * n)""",
)
def _(spark, d):
    return temporal.white_defects(views.bgr(spark, d), centre=12.0007, inner=3.0007, low=2, high=3, fraction=0.2)


@query(
    "chromatic_defect_map",
    f"""WITH {_rings("SELECT f, y, x, k, CASE k WHEN 0 THEN b - 0.5::DOUBLE * (g + r) WHEN 1 THEN g - 0.5::DOUBLE * (b + r) ELSE r - 0.5::DOUBLE * (b + g) END AS d FROM bgr, range(3) t(k)")},
    h AS (SELECT y, x, count(DISTINCT f) AS hits FROM r WHERE abs(c) >= 30.0007 AND abs(i) >= 8.0007 AND c * i > 0 GROUP BY y, x)
    SELECT y, x, hits FROM h, n WHERE hits >= ceil(0.2 * n)""",
)
def _(spark, d):
    return temporal.chromatic_defects(views.bgr(spark, d), centre=30.0007, inner=8.0007, low=2, high=3, fraction=0.2)


@query(
    "hough_votes",
    f"""WITH {PX}, t AS (SELECT f, k * 5.0::DOUBLE AS angle, floor((y * cos(radians(k * 5.0::DOUBLE)) - x * sin(radians(k * 5.0::DOUBLE))) / 1.0 + 0.5) * 1.0 AS rho FROM px, range(36) r(k) WHERE v > 160)
    SELECT f, angle, rho, count(*) AS votes FROM t GROUP BY ALL HAVING count(*) >= 4""",
)
def _(spark, d):
    return geometry.hough(pixels.mask(views.px(spark, d), 160), angles=36, least=4)


@query(
    "translated",
    f"""WITH {PX}, s AS (SELECT f, y, x, y - (f % 3 - 1) * 0.25::DOUBLE AS sy, x - (f % 5 - 2) * 0.5::DOUBLE AS sx FROM px),
    c AS (SELECT *, floor(sy) AS y0, floor(sx) AS x0, sy - floor(sy) AS fy, sx - floor(sx) AS fx FROM s),
    p AS (SELECT c.*, i, j, px.v FROM c, range(2) a(i), range(2) b(j) JOIN px ON px.f = c.f AND px.y = greatest(0, least(7, y0 + i)) AND px.x = greatest(0, least(7, x0 + j)))
    SELECT f, y, x, sum(v * CASE WHEN i = 1 THEN fy ELSE 1 - fy END * CASE WHEN j = 1 THEN fx ELSE 1 - fx END) AS v FROM p GROUP BY f, y, x""",
)
def _(spark, d):
    px = views.px(spark, d)
    shifts = px.select("f").distinct().select("f", ((F.col("f") % 5 - 2) * 0.5).alias("dx"), ((F.col("f") % 3 - 1) * 0.25).alias("dy"))
    return kernels.translated(px, shifts)


@query(
    "inpaint_isolated",
    f"""WITH {PX}, m AS (SELECT a.f, a.y, a.x FROM px a JOIN px b ON a.f = b.f AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 WHERE a.v > 160 GROUP BY ALL HAVING count(*) FILTER (b.v > 160) = 1)
    SELECT m.f, m.y, m.x, round(avg(n.v), 1) AS v FROM m JOIN px n ON n.f = m.f AND abs(n.y - m.y) + abs(n.x - m.x) = 1 GROUP BY ALL""",
)
def _(spark, d):
    px = views.px(spark, d)
    lab = _labelled(spark, d)
    alone = lab.join(components.stats(lab).where("area = 1").select("f", "label"), ["f", "label"], "left_semi").select("f", "y", "x")
    filled = kernels.inpainted(px, alone).join(alone, ["f", "y", "x"], "left_semi")
    return filled.select("f", "y", "x", F.round("v", 1).alias("v"))


# --- detection -----------------------------------------------------------------------------------


@query(
    "candidate_spots",
    f"""WITH RECURSIVE {BGR}, levels AS (SELECT f * 2 AS f, y, x, greatest(r - (g + b) // 2, g - (r + b) // 2, 0)::INT AS v FROM bgr
      UNION ALL SELECT f * 2 + 1, y, x, floor(0.114::DOUBLE * b + 0.587::DOUBLE * g + 0.299::DOUBLE * r + 0.5::DOUBLE)::INT FROM bgr),
    nd AS (SELECT f, y, x, least(v - lag(v) OVER w, v - lead(v) OVER w) AS d FROM levels WINDOW w AS (PARTITION BY f % 2, y, x ORDER BY f)),
    m AS (SELECT f, y, x, d FROM nd WHERE d > 20), {labels_sql("lab", "m")},
    c AS (SELECT f, round_even(avg(x), 0)::INT AS x, round_even(avg(y), 0)::INT AS y FROM lab GROUP BY f, label HAVING count(*) >= 2)
    SELECT c.f // 2 AS f, CASE WHEN c.f % 2 = 0 THEN 'color' ELSE 'gray' END AS ch, c.x, c.y, coalesce(m.d, 0) AS peak FROM c LEFT JOIN m USING (f, x, y)
    QUALIFY row_number() OVER (PARTITION BY c.f ORDER BY peak DESC, c.x DESC, c.y DESC) <= 2""",
)
def _(spark, d):
    return detection.candidates(views.bgr(spark, d), threshold=20, least=2, margin=0, width=4, height=4, most=2)


@query(
    "tiled_detection",
    f"""WITH {BGR}, t AS (SELECT f, i AS x0, j AS y0, x, y, r FROM bgr, range(2) a(i), range(2) b(j) WHERE x BETWEEN i AND i + 2 AND y BETWEEN j AND j + 2)
    SELECT f, x0 || '-' || y0 || '-0' AS det_id, count(*) FILTER (r > 150) / 9.0::DOUBLE AS s, min(x) FILTER (r > 150) AS x0, min(y) FILTER (r > 150) AS y0,
      max(x) FILTER (r > 150) + 1 AS x1, max(y) FILTER (r > 150) + 1 AS y1, (count(*) FILTER (r > 150))::INT AS n FROM t GROUP BY f, t.x0, t.y0 HAVING count(*) FILTER (r > 150) > 0""",
)
def _(spark, d):
    def bright(image):
        mask = image[..., 2] > 150
        return [(mask.mean(), mask)]

    found = detection.tiled(views.bgr(spark, d), bright, 4, 4, tile=3, overlap=0.34)
    return found.select("f", "det_id", "s", "x0", "y0", "x1", "y1", F.size("ys").alias("n"))


@query(
    "brightness_trim",
    f"""WITH RECURSIVE {PX}, m AS (SELECT f, y, x FROM px WHERE v > 130), {labels_sql("lab", "m")},
    b AS (SELECT f, label, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM lab GROUP BY f, label),
    g AS (SELECT *, ((y1 - y0) * 0.5 / 2)::DOUBLE AS ey, ((x1 - x0) * 0.5 / 2)::DOUBLE AS ex FROM b),
    sky AS (SELECT g.f, g.label, px.v FROM g JOIN px ON px.f = g.f AND px.y BETWEEN y0 - trunc(ey) AND y1 + trunc(ey) AND px.x BETWEEN x0 - trunc(ex) AND x1 + trunc(ex)
      LEFT JOIN lab l ON l.f = px.f AND l.y = px.y AND l.x = px.x WHERE l.label IS DISTINCT FROM g.label),
    med AS (SELECT f, label, median(v) AS base, count(*) AS n FROM sky GROUP BY f, label),
    mad AS (SELECT f, label, base, n, median(abs(v - base)) AS mad FROM sky JOIN med USING (f, label) GROUP BY ALL)
    SELECT lab.* FROM lab JOIN px USING (f, y, x) LEFT JOIN mad ON mad.f = lab.f AND mad.label = lab.label
    WHERE coalesce(n, 0) < 4 OR px.v > base + 2.0::DOUBLE * 1.4826::DOUBLE * mad""",
)
def _(spark, d):
    px = views.px(spark, d)
    limits = components.TRIM | {"sky": 4, "blob": 1, "keep": 1, "dilate": 0}
    return components.brightness_trim(components.labelled(pixels.mask(px, 130)), px, limits).select("f", "y", "x", "label")

import numpy as np
from pyspark.sql import functions as F

from framelark.operators import components
from framelark.plans import detection
from framelark.sources import sinks


def scene(spark, frames=6, h=40, w=60):
    """A bright dash that moves 8 to the right in every frame, under fixed stars."""
    rng, rows = np.random.default_rng(0), []
    stars = {(int(y), int(x)) for y, x in zip(rng.integers(0, h, 60), rng.integers(0, w, 60), strict=True) if y not in (19, 20, 21, 22)}
    for f in range(frames):
        for y in range(h):
            for x in range(w):
                on = y in (20, 21) and 5 + 8 * f <= x < 9 + 8 * f
                level = 220 if on else 180 if (y, x) in stars else 10
                rows.append((f, y, x, level, level, level))
    return spark.createDataFrame(rows, "f bigint, y int, x int, b int, g int, r int").cache()


def test_a_moving_dash_is_found_and_repaired(spark):
    bgr = scene(spark)
    spots = detection.candidates(bgr, 50, 2, 2, 60, 40)
    gray = spots.where("ch = 'gray'").orderBy("f").collect()
    assert [(r.f, r.y) for r in gray] == [(f, 20) for f in range(6)]
    obs = gray and spots.select("f", "x", "y", "ch").union(spots.select("f", "x", "y", F.lit("color").alias("ch")))
    found = detection.verified_motion(obs, 6, 4, 20, 4, 2, 1, 5, 3, 30, 1, 0, 20, 1.0)
    assert {r.f for r in found.collect()} == set(range(6))
    mask = bgr.where("b = 220").select("f", "y", "x")
    clean = detection.cleaned_frames(bgr, mask)
    assert clean.where("b > 180").count() == 0 and clean.count() == bgr.count()


def test_tiles_with_a_detector(spark):
    bgr = scene(spark, frames=2)

    def bright(image: np.ndarray):
        mask = image[..., 0] > 200
        return [(0.9, mask)] if mask.any() else []

    found = detection.tiled(bgr, bright, 60, 40, tile=32, overlap=0.25)
    assert found.count() >= 2
    got = {(r.f, r.y, r.x) for r in detection.detected_mask(found).collect()}
    assert got and got <= {(r.f, r.y, r.x) for r in bgr.where("b = 220").collect()}


def test_axis_extension_bridges_a_touching_blob(spark):
    part = [(0, y, x) for y in (10, 11, 12) for x in range(5, 30)]
    blob = [(0, 11, x) for x in range(31, 62)]
    df = lambda rows: spark.createDataFrame(rows, "f bigint, y int, x int")
    out = detection.axis_extended(components.labelled(df(part)), df(blob), 30, 80)
    assert out.agg(F.max("x")).first()[0] >= 61 and out.select("label").distinct().count() == 1


def test_continuous_line_in_two_frames(spark):
    px = spark.createDataFrame([(f, y, x, 200 if y == 15 else 0) for f in (0, 1) for y in range(30) for x in range(50)], "f bigint, y int, x int, v int")
    sky = px.select("y", "x").distinct().withColumn("v", F.lit(0))
    found = detection.continuous_trails(px, sky, 50, 40, -1, 5, 1.0, 3.0, 10, 2, 50, 30)
    assert {r.f for r in found.collect()} == {0, 1} and {r.y for r in found.collect()} <= {14, 15, 16}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("r1", "detect", 3.5)], "run_id string, phase string, elapsed_sec double")
    for _ in range(2):
        sinks.append_telemetry(rows, str(tmp_path / "log"))
    log = spark.read.option("header", "true").csv(str(tmp_path / "log"))
    assert log.columns == list(sinks.TELEMETRY) and log.count() == 2
    timing = spark.createDataFrame([(1.5, 100, "v1")], "sec_per_frame double, image_pixels int, app_version string")
    sinks.write_timing(timing, str(tmp_path / "timing"))
    assert spark.read.json(str(tmp_path / "timing")).first().sec_per_frame == 1.5
    mask = spark.createDataFrame([(0, 1, 2)], "f bigint, y int, x int")
    sinks.write_masks(mask, str(tmp_path / "masks"))
    assert sinks.replace_mask(mask, str(tmp_path / "fg")) and (tmp_path / "fg").exists()
    assert not sinks.replace_mask(mask.limit(0), str(tmp_path / "fg")) and not (tmp_path / "fg").exists()
    assert not sinks.replace_mask(mask.limit(0), str(tmp_path / "none"))
    built = []
    for _ in range(2):
        assert sinks.cached(spark, str(tmp_path / "map"), lambda: built.append(1) or mask).count() == 1
    assert len(built) == 1
    assert sinks.writable(spark, str(tmp_path)) and not sinks.writable(spark, "/proc/none")
    assert sinks.guarded(lambda: mask.write.parquet(str(tmp_path / "map")))[0] == sinks.FAILED
    assert sinks.guarded(lambda: mask.write.mode("append").parquet(str(tmp_path / "map"))) == (sinks.DONE, "")


def test_suppression_and_merging_of_one_set(spark):
    box = lambda x0, s: (0, f"d{x0}", s, x0, 0, x0 + 10, 4, [0], [x0])
    found = spark.createDataFrame([box(0, 0.9), box(4, 0.8), box(9, 0.7), box(40, 0.6)], "f bigint, det_id string, s double, x0 int, y0 int, x1 int, y1 int, ys array<int>, xs array<int>")
    kept, merged = detection.dual_masks(found)
    assert {r.x for r in kept.collect()} == {0, 9, 40} and {r.x for r in merged.collect()} == {0, 4, 9, 40}


def test_only_parts_at_seams_grow(spark):
    part = [(0, y, x) for y in (10, 11, 12) for x in range(5, 30)]
    blob = [(0, 11, x) for x in range(31, 62)]
    df = lambda rows: spark.createDataFrame(rows, "f bigint, y int, x int")
    parts = components.labelled(df(part)).cache()
    for tile, grown in ((30, True), (50, False)):
        seams = detection.at_seams(parts, 90, 30, tile, 0.0, 3)
        out = detection.axis_extended(parts, df(blob), 30, 80, truncated=seams)
        assert (out.agg(F.max("x")).first()[0] > 60) == grown

import numpy as np
from pyspark.sql import functions as F

from framelark.operators import components, geometry, kernels, motion, pixels, runlog, temporal


def tall(spark, stack, names=("v",)):
    stack = np.asarray(stack)
    stack = stack[..., None] if stack.ndim == 3 else stack
    rows = [
        (f, y, x, *map(int, stack[f, y, x])) for f in range(stack.shape[0]) for y in range(stack.shape[1]) for x in range(stack.shape[2])
    ]
    return spark.createDataFrame(rows, "f bigint, y int, x int, " + ", ".join(f"{n} int" for n in names))


def test_planted_defect_is_found_and_a_clean_stack_is_not(spark):
    rng = np.random.default_rng(42)
    stack = 15 + rng.integers(0, 3, (5, 24, 24, 3))
    stack[:, 10, 12] = (30, 30, 250)
    got = {(r.y, r.x) for r in temporal.coloured_hot_pixels(tall(spark, stack, ("b", "g", "r"))).collect()}
    assert got == {(10, 12)}
    clean = np.random.default_rng(7).integers(10, 25, (5, 16, 16))
    assert temporal.hot_pixels(tall(spark, clean)).count() < 5


def test_white_and_chromatic_defects(spark):
    stack = np.full((4, 40, 40, 3), 20)
    stack[:, 20, 20] = (200, 200, 200)
    stack[:, 19:22, 19:22] += 60
    px = tall(spark, stack, ("b", "g", "r"))
    assert (20, 20) in {(r.y, r.x) for r in temporal.white_defects(px).collect()}
    assert temporal.chromatic_defects(px).count() == 0


def test_edge_frames_compare_with_the_one_neighbour(spark):
    got = {r.f: r.d for r in temporal.neighbour_difference(tall(spark, [[[9]], [[5]], [[50]]])).collect()}
    assert got == {0: 4, 1: 0, 2: 45}
    assert temporal.neighbour_difference(tall(spark, [[[9]]])).first().d is None


def test_average_repair_truncates_and_copies(spark):
    px = tall(spark, [[[3]], [[99]], [[6]], [[7]]])
    got = {r.f: r.repaired for r in temporal.repaired_by_average(px, px.select("f", "y", "x")).collect()}
    assert got == {0: 99, 1: 4, 2: 53, 3: 6}


def test_sky_percentile_truncates(spark):
    assert temporal.clean_sky(tall(spark, [[[1]], [[2]]])).first().v == 1


def test_components_are_eight_connected(spark):
    mask = spark.createDataFrame([(0, 0, 0), (0, 1, 1), (0, 5, 5), (1, 0, 0), (0, 2, 0), (0, 2, 0)], "f bigint, y int, x int")
    got = components.labelled(mask)
    assert {(r.f, r.area) for r in components.stats(got).collect()} == {(0, 3), (0, 1), (1, 1)}
    assert components.small_filter(got, 2).count() == 3
    assert components.labelled(mask.limit(0)).count() == 0


def test_small_red_components_stay(spark):
    mask = components.labelled(spark.createDataFrame([(0, 0, 0), (0, 5, 5)], "f bigint, y int, x int"))
    colours = spark.createDataFrame([(0, 0, 0, 10, 10, 200), (0, 5, 5, 90, 90, 95)], "f bigint, y int, x int, b int, g int, r int")
    assert [(r.y, r.x) for r in components.small_filter(mask, 9, colours).collect()] == [(0, 0)]


def test_many_frames_in_small_tables_keep_their_borders(spark):
    rng = np.random.default_rng(3)
    rows = [(int(f), int(y), int(x)) for f, y, x in zip(rng.integers(0, 300, 4000), rng.integers(0, 9, 4000), rng.integers(0, 9, 4000), strict=True)]
    mask = spark.createDataFrame(rows, "f bigint, y int, x int").distinct()
    labels = components.labelled(mask).toPandas()
    for _, g in labels.groupby("f"):
        spots = {(r.y, r.x): r.label for r in g.itertuples()}
        for (y, x), label in spots.items():
            near = {spots[(y + i, x + j)] for i in (-1, 0, 1) for j in (-1, 0, 1) if (y + i, x + j) in spots}
            assert near == {label}


def test_dilation_and_resize(spark):
    one = spark.createDataFrame([(0, 0, 0)], "f bigint, y int, x int")
    assert pixels.dilated(one, pixels.square(5)).count() == 25
    assert pixels.dilated(one, pixels.ellipse(3), 4, 4).count() == 3
    assert pixels.resized(one, (2, 2), (4, 6)).count() == 6
    assert pixels.resized(spark.createDataFrame([(0, y, x) for y in range(4) for x in range(4)], "f bigint, y int, x int"), (4, 4), (2, 2)).count() == 4
    assert len(pixels.disk(1)) == 5
    stroke = spark.createDataFrame([(0, 0, 0, 9, 0)], "f bigint, x0 int, y0 int, x1 int, y1 int")
    assert pixels.brushed(stroke, 0).count() == 10


def line(a, b, wide=5):
    (x0, y0), (x1, y1) = a, b
    n = max(abs(x1 - x0), abs(y1 - y0))
    out = set()
    for k in range(n + 1):
        x, y = round(x0 + k * (x1 - x0) / n), round(y0 + k * (y1 - y0) / n)
        out |= {(x + i, y + j) for i in range(-wide, wide + 1) for j in range(-wide, wide + 1) if i * i + j * j <= wide * wide}
    return out


def test_pieces_of_one_trail_merge():
    # pieces of the sizes that the operator was described with: 10 pixels wide, overlapping ends
    a, b = line((200, 200), (550, 550)), line((500, 500), (800, 800))
    assert len(geometry.merge_pieces([a, b])) == 1
    parallel = [line((100, 100), (300, 300)), line((700, 100), (900, 300))]
    assert len(geometry.merge_pieces(parallel)) == 2
    blob = {(x, y) for x in range(400, 600, 2) for y in range(400, 600, 2)}
    assert len(geometry.merge_pieces([blob, line((600, 500), (900, 500))])) == 2
    assert geometry.merge_pieces([]) == [] and len(geometry.merge_pieces([a])) == 1


def test_merge_on_tables(spark):
    rows = [(0, m, y, x) for m, p in enumerate((line((20, 20), (90, 90), 3), line((80, 80), (150, 150), 3))) for x, y in p]
    out = geometry.merged_pieces(spark.createDataFrame(rows, "f bigint, mask_id int, y int, x int"))
    assert out.select("mask_id").distinct().count() == 1


def test_suppression_is_greedy(spark):
    boxes = [(0, 1, 0, 0, 10, 10, 3.0), (0, 2, 3, 0, 13, 10, 2.0), (0, 3, 6, 0, 16, 10, 1.0)]
    df = geometry.ranked(spark.createDataFrame(boxes, "f bigint, det_id int, x0 int, y0 int, x1 int, y1 int, s double"))
    assert [r.rk for r in geometry.suppressed(df, 0.5).orderBy("rk").collect()] == [1, 3]


def test_angle_groups():
    a = np.array([1.0, 2, 3, 60, 61, 62, 120])
    groups = geometry.angle_groups(a, np.arange(7.0))
    assert [g.tolist() for g in groups] == [[2, 1, 0], [5, 4, 3]]
    assert geometry.angle_groups(a[:4], np.ones(4)) == [] and geometry.angle_groups(a[:0], a[:0]) == []
    # the two largest decide, whatever a third group would say
    near = np.array([1.0, 2, 3, 4, 5, 20, 21, 22, 23, 60, 61, 62])
    assert geometry.angle_groups(near, np.ones(12)) == []


def test_crossing_trails_are_parted(spark):
    cross = line((20, 20), (220, 220), 8) | line((20, 220), (220, 20), 8)
    alone = line((300, 20), (330, 220), 12)
    rows = [(0, y, x) for x, y in cross | alone]
    lab = components.labelled(spark.createDataFrame(rows, "f bigint, y int, x int")).cache()
    out = geometry.crossings_split(lab, geometry.CROSSING | {"area": 2000}).toPandas()
    two = geometry.crossing_lines(lab, geometry.CROSSING | {"area": 2000}).collect()
    assert len(two) == 1 and sorted(round(v / 45) for v in (two[0].a0, two[0].a1)) == [1, 3]
    sides = out.groupby(["label", "side"]).size()
    assert len(sides) == 3 and sides.min() > 2000 and len(out) < len(rows)
    assert geometry.crossings_split(lab).count() == len(rows) or len(cross) >= 5000


def test_thinning_keeps_a_line():
    mask = np.zeros((30, 60), bool)
    mask[10:17, 5:55] = True
    bones = geometry.thinned(mask)
    assert bones.sum() < 60 and len(set(np.nonzero(bones)[1])) > 40
    assert not geometry.thinned(np.zeros((3, 3), bool)).any()
    assert len(geometry.line_runs(bones, 20, 30, 5)) == 1 and len(geometry.line_runs(np.zeros((4, 4), bool), 2, 1, 1)) == 0


def greedy(boxes, threshold):
    """Plain suppression of (rank, x0, y0, x1, y1) rows."""
    kept = []
    for k, *b in boxes:
        def share(c):
            w, h = min(b[2], c[2]) - max(b[0], c[0]), min(b[3], c[3]) - max(b[1], c[1])
            return max(w, 0) * max(h, 0) / min((b[2] - b[0]) * (b[3] - b[1]), (c[2] - c[0]) * (c[3] - c[1]))
        if all(share(c) < threshold for _, *c in kept):
            kept.append((k, *b))
    return [k for k, *_ in kept]


def test_suppression_equals_a_plain_loop(spark):
    rng = np.random.default_rng(1)
    rows = []
    for f in range(40):
        for k in range(int(rng.integers(1, 30))):
            x, y, w, h = (int(v) for v in rng.integers(1, 40, 4))
            rows.append((f, k + 1, x, y, x + w, y + h))
    df = spark.createDataFrame(rows, "f bigint, rk int, x0 int, y0 int, x1 int, y1 int")
    want = {(f, k) for f in range(40) for k in greedy([r[1:] for r in rows if r[0] == f], 0.5)}
    for together in (2000, 5):
        assert {(r.f, r.rk) for r in geometry.suppressed(df, 0.5, together).collect()} == want
    pairs = {(r.f, r.a, r.b) for r in geometry.overlapping(df, 0.5).collect()}
    assert pairs == {(r.f, r.a, r.b) for r in geometry.overlapping(df, 0.5, cell=7).collect()} and pairs


def test_brightness_trim(spark):
    rng = np.random.default_rng(0)
    plane = 20 + rng.integers(0, 5, (60, 90))
    mask = {(y, x) for y in range(20, 40) for x in range(15, 75)}
    plane[28:32, 15:75] = 200
    plane[22, 20] = 200  # a star of one pixel
    px = tall(spark, [plane])
    lab = components.labelled(spark.createDataFrame([(0, y, x) for y, x in mask], "f bigint, y int, x int"))
    got = {(r.y, r.x) for r in components.brightness_trim(lab, px).collect()}
    assert got <= mask and {(y, x) for y in range(28, 32) for x in range(15, 75)} <= got
    assert min(y for y, _ in got) == 25 and max(y for y, _ in got) == 34 and (22, 20) not in got
    faint = tall(spark, [np.full((60, 90), 20)])
    assert components.brightness_trim(lab, faint).count() == 0
    assert components.brightness_trim(lab, px.where("y between 20 and 39 and x between 15 and 74")).count() == len(mask)


def test_gaps_are_filled_to_the_fixpoint(spark):
    kept = spark.createDataFrame([(10, 0, f, 10 * f, 5) for f in (0, 1, 4, 5)], "dxp int, dyp int, f bigint, x int, y int")
    found = spark.createDataFrame([(10, 0, f, 0, 0) for f in range(6)], "dxp int, dyp int, f bigint, x int, y int")
    assert {r.f for r in motion.gap_filled(found, kept, 1, 3, passes=3).collect()} == set()
    far = spark.createDataFrame([(10, 0, f, 10 * f, 5) for f in (0, 2, 5)], "dxp int, dyp int, f bigint, x int, y int")
    one, more = (motion.gap_filled(found, far, 2, 3, passes=p).collect() for p in (1, 5))
    assert {(r.f, r.x) for r in one} == {(1, 10), (3, 30), (4, 40)} and {(r.f, r.x) for r in more} == {(1, 10), (3, 30), (4, 40)}


def test_directed_clusters_become_a_mask(spark):
    spots = [(0, 10 + 12 * k, 20) for k in range(5)] + [(0, 40, 90), (1, 5, 5)]
    df = spark.createDataFrame(spots, "f bigint, x int, y int")
    got = {(r.f, r.y, r.x) for r in motion.directed_mask(df, [0.0], 3, 100, 100, radius=30).collect()}
    assert {(0, 20, x) for x in range(10, 59)} <= got and all(f == 0 and 17 <= y <= 23 for f, y, _ in got)


def test_inpainting_on_tables(spark):
    px = tall(spark, [np.tile(np.arange(9), (9, 1)) * 10] * 2)
    hole = spark.createDataFrame([(0, y, x) for y in (3, 4) for x in (3, 4, 5)], "f bigint, y int, x int")
    got = {(r.f, r.y, r.x): r.v for r in kernels.inpainted(px, hole).collect()}
    assert all(abs(v - 10 * x) < 1 for (_, _, x), v in got.items()) and len(got) == 162


def test_frames_come_back_to_the_middle_one(spark):
    base = np.random.default_rng(4).integers(0, 255, (32, 32))
    stack = [np.roll(base, (k - 2, 2 * (k - 2)), (0, 1)) for k in range(5)]
    out = kernels.aligned_frames(tall(spark, stack)).toPandas()
    assert kernels.middle_frame(tall(spark, stack)) == 2
    for f, g in out.groupby("f"):
        a = np.zeros((32, 32))
        a[g.y, g.x] = g.v
        assert np.abs(a[8:24, 8:24] - base[8:24, 8:24]).mean() < 40, f


def test_jobs_are_cancelled_by_their_tag(spark):
    with runlog.cancellable(spark, "run-1"):
        assert spark.range(3).count() == 3 and "run-1" in spark.getTags()
    assert "run-1" not in spark.getTags() and runlog.cancel(spark, "run-1") == 0


def test_releases_of_a_landed_feed(spark):
    rows = [('{"tag_name": "v1", "body": "b", "assets": []}',), ("broken",), (None,), ('[{"tag_name": "v2"}, {"body": "no tag"}]',)]
    assert sorted(r.tag_name for r in runlog.releases(spark.createDataFrame(rows, "value string")).collect()) == ["v1", "v2"]


def test_motion_needs_two_confirmations(spark):
    obs = spark.createDataFrame([(f, 10 * f, 0, "gray") for f in range(5)] + [(9, 400, 400, "gray"), (10, 410, 400, "gray")], "f bigint, x int, y int, ch string")
    found = spark.createDataFrame([(10, 0, 2, 20, 0), (10, 0, 9, 400, 400)], "dxp int, dyp int, f bigint, x int, y int")
    kept = motion.chain_verified(found, obs, 5, 4, 20).collect()
    assert [(r.f, r.x) for r in kept] == [(2, 20)]


def shuffled(df):
    """Whether no side of an equi-join is broadcast, in the plan as it ran."""
    rows = df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    return rows, "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_dealt_observations_are_not_broadcast(spark):
    obs = spark.range(60).select(F.col("id").alias("f"), (10 * F.col("id")).cast("int").alias("x"), F.lit(0).alias("y"), F.lit("gray").alias("ch"))
    moves, good = shuffled(motion.pairs(obs, 5, 15))
    assert len(moves) == 59 and good
    found = obs.select(F.lit(10).alias("dxp"), F.lit(0).alias("dyp"), "f", "x", "y")
    kept, good = shuffled(motion.chain_verified(found, obs, 5, 4, 60))
    assert len(kept) == 60 and good


def test_dealt_gap_points_are_not_broadcast(spark):
    found = spark.range(60).select(F.lit(10).alias("dxp"), F.lit(0).alias("dyp"), F.col("id").alias("f"), (10 * F.col("id")).cast("int").alias("x"), F.lit(0).alias("y"))
    rows, good = shuffled(motion.gap_filled(found, found.where("f % 10 != 5"), 2, 3))
    assert {(r.f, r.x) for r in rows} == {(f, 10 * f) for f in range(5, 60, 10)} and good


def test_long_lines_do_not_overflow(spark):
    rows = [(f, 0, 10, 60_000, 10) for f in (0, 1)] + [(0, 90_000, 7, 0, 7), (3, 0, 10, 60_000, 10)]
    found = geometry.lines(spark.createDataFrame(rows, "f bigint, x1 int, y1 int, x2 int, y2 int"))
    assert sorted((r.f, r.angle, r.rho) for r in found.collect()) == [(0, 0, 7), (0, 0, 10), (1, 0, 10), (3, 0, 10)]
    assert sorted((r.f, r.x2) for r in geometry.matched_lines(found, 0.1, 2).collect()) == [(0, 60_000), (1, 60_000)]


def test_equal_lines_are_matched_once(spark):
    lines = spark.range(2000).select((F.col("id") % 2).alias("f"), F.lit(0.0).alias("angle"), F.lit(10.0).alias("rho"), "id")
    out = geometry.matched_lines(lines, 0.1, 10)
    assert out.count() == 2000
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan.split("Generate")[-1]  # equal lines are one before they are dealt to bands
    flat = spark.createDataFrame([(0, 5, 0, 2, 0), (0, 0, 9, 0, 3)], "f bigint, x1 int, y1 int, x2 int, y2 int")
    assert [str(r.rho) for r in geometry.lines(flat).collect()] == ["0.0", "0.0"]


def test_snap_keeps_points_without_target(spark):
    p = spark.createDataFrame([(0, 5, 5), (0, 50, 50)], "f bigint, y int, x int")
    t = spark.createDataFrame([(0, 4, 5), (0, 6, 5)], "f bigint, y int, x int")
    got = {(r.y, r.x): (r.ny, r.nx) for r in motion.snapped(p, t, 2).collect()}
    assert got == {(5, 5): (4, 5), (50, 50): (50, 50)}


def test_phase_shift_and_move():
    a = np.random.default_rng(0).random((32, 32))
    dx, dy, r = kernels.phase_shift(a, np.roll(a, (3, -2), (0, 1)), window=False)
    assert round(dx) == -2 and round(dy) == 3 and r > 0.3
    assert np.allclose(kernels.moved(a, 1, 0)[:, 1:], a[:, :-1])
    assert np.allclose(kernels.moved(a, 0, 0), a)


def test_repair_copies_a_single_neighbour_and_averages_two():
    here, mask = np.full((9, 9), 200), np.zeros((9, 9), bool)
    mask[4, 4] = True
    before, after = np.full((9, 9), 10), np.full((9, 9), 21)
    assert kernels.repaired_component(here, mask, before, None)[4, 4] == 10
    assert kernels.repaired_component(here, mask, None, None)[4, 4] == 200
    both = kernels.repaired_component(here, mask, before, after)
    assert both[4, 4] == 15 and both[0, 0] == 200


def test_bridge_repair_on_tables(spark):
    px = tall(spark, [np.full((6, 6), v) for v in (10, 200, 20)])
    mask = components.labelled(px.where("f = 1 and y = 2").select("f", "y", "x"))
    got = kernels.repaired_by_bridge(px, mask).collect()
    assert len(got) == 6 and {r.repaired for r in got} == {15}


def test_harmonic_fill_is_smooth():
    plane = np.tile(np.arange(9.0), (9, 1))
    hole = np.zeros((9, 9), bool)
    hole[3:6, 3:6] = True
    assert np.abs(kernels.harmonic_fill(np.where(hole, 99, plane), hole) - plane).max() < 0.1


def test_throttle_measures_from_the_last_kept(spark):
    rows = spark.createDataFrame([(0, t, t == 7) for t in (0, 3, 6, 7, 9, 12)], "run int, t bigint, must boolean")
    assert [r.t for r in runlog.throttled(rows, "run", "t", 5).orderBy("t").collect()] == [0, 6, 12]
    assert [r.t for r in runlog.throttled(rows, "run", "t", 5, "must").orderBy("t").collect()] == [0, 6, 7, 12]


def test_row_gain_is_bounded(spark):
    plane = spark.createDataFrame([(y, x, 10 if y < 8 else 250) for y in range(10) for x in range(4)], "y int, x int, v int")
    got = {r.y: r.gain for r in temporal.row_gain(plane).collect()}
    assert got[0] == 1.0 and got[9] == 3.0
    assert temporal.row_gain(plane, smooth=3).count() == 10


def test_hough_counts_a_line(spark):
    mask = spark.createDataFrame([(0, 5, x) for x in range(30)], "f bigint, y int, x int")
    best = geometry.hough(mask).orderBy(F.desc("votes"), "angle").first()
    assert best.votes == 30 and best.angle == 0.0

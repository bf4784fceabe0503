import pytest
from pyspark.errors import PySparkException

from framelark.operators import manifest


def files(spark, rows):
    return spark.createDataFrame(rows, "stem string, ext string, path string, w int, h int")


def test_tiff_beats_others_and_first_beats_equals(spark):
    rows = [("a", "jpg", "a.jpg", 1, 1), ("a", "TIF", "a.TIF", 1, 1), ("b", "png", "b.png", 1, 1), ("b", "jpg", "b.jpg", 1, 1)]
    got = {r.path for r in manifest.prefer_tiff(files(spark, rows)).collect()}
    assert got == {"a.TIF", "b.jpg"}


def test_dominant_size_tie_goes_to_the_first_seen(spark):
    rows = [("a", "jpg", "a", 2, 2), ("b", "jpg", "b", 1, 1), ("c", "jpg", "c", 1, 1), ("d", "jpg", "d", 2, 2)]
    assert [r.path for r in manifest.of_dominant_size(files(spark, rows)).orderBy("path").collect()] == ["a", "d"]


def test_index_is_by_sequence(spark):
    rows = spark.createDataFrame([("x", "b"), ("x", "a"), ("y", "c")], "folder string, path string")
    got = {(r.folder, r.path): r.frame_idx for r in manifest.indexed(rows, ["path"], ["folder"]).collect()}
    assert got == {("x", "a"): 0, ("x", "b"): 1, ("y", "c"): 0}


def test_batches_have_a_halo(spark):
    rows = spark.range(45).withColumnRenamed("id", "frame_idx")
    got = [(r.frame_idx, r.is_core) for r in manifest.batches(rows).where("batch = 1").orderBy("frame_idx").collect()]
    assert got[0] == (19, False) and got[-1] == (40, False) and len(got) == 22


def test_guards(spark):
    one = spark.createDataFrame([(1, 1, 8), (1, 1, 16)], "width int, height int, bit_depth int")
    with pytest.raises(PySparkException):
        manifest.homogeneous(one).collect()
    with pytest.raises(PySparkException):
        manifest.at_least(one, 3).collect()
    assert manifest.homogeneous(one.limit(1)).first().state == "ok"


def test_suffixes_of_any_case(spark):
    rows = spark.createDataFrame([("JPG",), (".tiff",), ("txt",), (None,)], "ext string")
    assert manifest.images(rows).count() == 2


def test_shared_metadata_and_edges(spark):
    rows = spark.createDataFrame([(0, "a"), (1, "b"), (2, None)], "frame_idx int, icc string")
    assert {r.icc for r in manifest.shared_metadata(rows, ["icc"]).collect()} == {"a"}
    assert [r.frame_idx for r in manifest.without_edges(rows, 1).collect()] == [1]


def test_index_without_a_sequence_is_by_ranges(spark):
    rows = [(f"p{i * 7919 % 1000:04d}", i) for i in range(1000)] + [(None, -1), ("p0500", -2)]
    df = spark.createDataFrame(rows, "path string, k int").repartition(7)
    got = {r.k: r.frame_idx for r in manifest.indexed(df, ["path", "k"]).collect()}
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    assert got == {k: i for i, (_, k) in enumerate(want)}
    assert manifest.indexed(df.limit(0), ["path"]).count() == 0


def test_policy_on_bad_files(spark):
    df = spark.createDataFrame([("a", True), ("b", False), ("c", None)], "path string, bad boolean")
    from pyspark.sql import functions as F

    bad = F.col("bad")
    assert [r.path for r in manifest.within_policy(df, bad).collect()] == ["b"]
    assert [r.path for r in manifest.within_policy(df, bad, "skip", 2).collect()] == ["b"]
    for policy in ({"on_bad": "stop"}, {"most": 1}):
        with pytest.raises(PySparkException, match="unreadable frames: 2"):
            manifest.within_policy(df, bad, **policy).collect()
    with pytest.raises(ValueError):
        manifest.within_policy(df, bad, "ask")

from pyspark.sql import functions as F

from framelark.functions import pixel, text


def one(spark, kind, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def test_versions(spark):
    assert one(spark, "string", ["v1.4-beta", "v10.0-beta", "", None, "not-a-tag"], text.app_version) == [1.4, 10.0, None, None, None]
    assert one(spark, "string", ["model-v2", " model-v2.5", "v1.0-beta", "model-"], text.model_version) == [2.0, 2.5, None, None]
    assert one(spark, "string", ["1.406", "  1.5  ", "", None, "abc"], text.local_version) == [1.406, 1.5, None, None, None]
    assert one(spark, "double", [1.5, 10.0, 2.0], text.display_name) == ["1.5", "10", "2"]


def test_durations(spark):
    assert one(spark, "int", [-1, 59, 61, 3723], text.hms) == ["0m 00s", "0m 59s", "1m 01s", "1h 02m 03s"]
    got = one(spark, "int", [1, 2, 3, 113, 180, 360, 405], text.time_saved)
    assert got == ["~20 seconds", "~40 seconds", "~15 minutes", "~45 minutes", "~1 hour", "~2 hours", "~2 hours 15 minutes"]


def test_release_notes_and_assets(spark):
    got = one(spark, "string", ["\n Faster. \nCREDITS: Ann\nCredits: Bob", "", None], text.release_notes)
    assert (got[0].summary, got[0].credits) == ("Faster.", "Ann") and got[1].summary is None
    kind = "array<struct<name:string,browser_download_url:string>>"
    rows = [[("a.txt", "u"), ("B.PT", ""), ("c.pt", "w"), ("d.pt", "z")], [], None]
    assert one(spark, kind, rows, text.first_asset) == ["w", None, None]


def test_progress_and_elision(spark):
    got = one(spark, "string", ["frame 3/20 of 1/2", "none"], text.progress)
    assert (got[0].done, got[0].total, got[1].done) == (3, 20, None)
    assert one(spark, "array<string>", [list("abcde"), list("abcd")], lambda c: text.elided(c, 2, "..")) == [["a", "b", "..", "d", "e"], list("abcd")]


def test_pixels(spark):
    assert one(spark, "int", [65535, 257, 256], pixel.narrow) == [255, 1, 1]
    assert one(spark, "int", [65535, 256], pixel.scaled_down) == [255, 0]
    assert one(spark, "int", [255], pixel.widen) == [65535]
    assert one(spark, "double", [179.0, 5.0], lambda c: pixel.angle_gap(c, F.lit(1.0))) == [2.0, 4.0]
    assert one(spark, "int", [1], lambda c: pixel.line_angle(c, -c)) == [135.0]

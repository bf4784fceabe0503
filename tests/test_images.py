import numpy as np
import pytest

from framelark.sources import images

RNG = np.random.default_rng(5)


@pytest.mark.parametrize("kind", [np.uint8, np.uint16])
@pytest.mark.parametrize("channels", [1, 3])
def test_round_trips(kind, channels):
    a = RNG.integers(0, np.iinfo(kind).max + 1, (13, 17, channels)).astype(kind)
    want = np.repeat(a, 3, axis=2) if channels == 1 else a
    assert (images.read_tiff(images.write_tiff(a)) == want).all()
    assert (images.read_png(images.write_png(a)) == want).all()


def test_sixteen_bit_output_is_exact_and_widens():
    a = np.zeros((32, 48, 3), np.uint16)
    a[:] = (0xFEDC, 0xABCD, 0x1234)
    assert (images.read_tiff(images.write_tiff(a, 16)) == a).all()
    assert (images.read_tiff(images.write_tiff(np.full((4, 4, 3), 255, np.uint8), 16)) == 65535).all()
    assert images.read_tiff(images.write_tiff(a, 8)).dtype == np.uint8


def test_metadata_is_written():
    data = images.write_tiff(np.zeros((4, 4, 3), np.uint8), icc=b"profile!", dpi=(300, 300), about="cleaned")
    _, tags = images._tiff_tags(data)
    assert tags[images.ICC][0] == b"profile!" and tags[images.X_RES] == (300, 1) and tags[images.DESCRIPTION][0] == b"cleaned\0"
    assert images.read_tiff(data).shape == (4, 4, 3)


def test_alpha_and_orientation():
    a = RNG.integers(0, 256, (5, 6, 4)).astype(np.uint8)
    assert (images.read_png(images.write_png(a)) == a[..., :3]).all()
    b = np.arange(6).reshape(2, 3)
    assert images.oriented(b, 6).tolist() == [[3, 0], [4, 1], [5, 2]] and images.oriented(b, 3).tolist() == [[5, 4, 3], [2, 1, 0]]


def test_headers_only():
    a = np.zeros((7, 9, 3), np.uint8)
    assert images.header(images.write_png(a)[:40]) == (9, 7)
    assert images.header(images.write_tiff(a)) == (9, 7)
    assert images.header(b"junk") is None and images.header(b"") is None


def test_scan_decodes_and_reports(spark, tmp_path):
    a = RNG.integers(0, 65536, (6, 5, 3)).astype(np.uint16)
    (tmp_path / "b.TIF").write_bytes(images.write_tiff(a))
    (tmp_path / "a.png").write_bytes(images.write_png(a))
    (tmp_path / "c.png").write_bytes(b"broken")
    (tmp_path / "d.txt").write_bytes(b"no image")
    got = {r.stem: r for r in images.frames(spark, str(tmp_path)).collect()}
    assert set(got) == {"a", "b", "c"}
    assert got["a"].image.bit_depth == 16 and bytes(got["a"].image.data) == a.tobytes() == bytes(got["b"].image.data)
    assert got["c"].image is None and [x.reader for x in got["c"].attempts] == ["png", "tiff"]
    sized = {r.path.split("/")[-1]: (r.width, r.height) for r in images.sizes(spark, str(tmp_path)).collect()}
    assert sized["a.png"] == (5, 6) and sized["c.png"] == (None, None)


def test_samples_and_sink(spark, tmp_path):
    a = RNG.integers(0, 256, (3, 4, 3)).astype(np.uint8)
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    (src / "x.png").write_bytes(images.write_png(a))
    found = images.frames(spark, str(src)).selectExpr("*", "0 as frame_idx")
    px = images.samples(found).toPandas().sort_values(["y", "x"])
    assert (px[["b", "g", "r"]].to_numpy().reshape(3, 4, 3) == a).all()
    images.write_frames(found, str(out), "tif16")
    file = bytes(spark.read.parquet(str(out)).first().file)
    assert (images.read_tiff(file) == a.astype(np.uint16) * 257).all()


def test_jpeg_is_read_back_by_the_jvm_and_turned(spark, tmp_path):
    y, x = np.mgrid[:45, :70]
    a = np.stack([y * 5, x * 3, 255 - y * 2], axis=2).clip(0, 255).astype(np.uint8)
    for name, orientation in (("plain.jpg", None), ("turned.JPEG", 6), ("gray.jpg", None)):
        image = a[..., :1] if name == "gray.jpg" else a
        (tmp_path / name).write_bytes(images.write_jpeg(image, 95, "made by a test", b"profile!" * 9000, (300, 300), orientation))
    (tmp_path / "broken.jpg").write_bytes(b"no image")
    assert images.header((tmp_path / "plain.jpg").read_bytes()[:120_000]) == (70, 45)
    got = {r.stem: r for r in images.frames(spark, str(tmp_path)).collect()}
    assert set(got) == {"plain", "turned", "gray", "broken"} and got["broken"].image is None and got["broken"].attempts[0].reader == "jvm"
    array = lambda im: np.frombuffer(im.data, np.uint8).reshape(im.height, im.width, 3).astype(int)
    assert np.abs(array(got["plain"].image) - a).max() <= 8 and np.abs(array(got["plain"].image) - a).mean() < 1.5
    assert np.abs(array(got["turned"].image) - images.oriented(a, 6)).max() <= 8
    assert np.abs(array(got["gray"].image) - a[..., :1]).max() <= 4


@pytest.mark.parametrize("quality", [10, 50, 100])
@pytest.mark.parametrize("size", [(1, 1), (8, 8), (17, 30)])
def test_jpeg_of_noise(spark, tmp_path, quality, size):
    a = RNG.integers(0, 65536, (*size, 3)).astype(np.uint16)
    (tmp_path / "n.jpg").write_bytes(images.write_jpeg(a, quality))
    (r,) = images.frames(spark, str(tmp_path)).collect()
    back = np.frombuffer(r.image.data, np.uint8).reshape(*size, 3).astype(int)
    assert r.image.bit_depth == 8 and np.abs(back - (a >> 8)).mean() < (2 if quality == 100 else 70)


def test_files_with_metadata(spark, tmp_path):
    a = RNG.integers(0, 256, (6, 5, 3)).astype(np.uint8)
    found = spark.createDataFrame([("ä b", (5, 6, 3, 8, bytearray(a.tobytes()))), ("none", None)], f"stem string, image {images.IMAGE}")
    for kind in ("jpeg", "png", "tif8", "tif16"):
        out = str(tmp_path / kind)
        rows = images.write_files(found, out, kind, icc=b"profile!", dpi=(300, 300), about="cleaned / by us").collect()
        assert [(r.stem, r.path.rsplit("/", 1)[1]) for r in rows] == [("ä b", f"ä b.{images.SUFFIX[kind]}")]
        data = open(rows[0].path, "rb").read()
        assert len(data) == rows[0].n_bytes and images.header(data) == (5, 6)
        if kind == "tif8":
            _, tags = images._tiff_tags(data)
            assert tags[images.SOFTWARE][0] == b"cleaned / by us\0" and tags[images.COMMENT][0] == "cleaned / by us\0".encode("utf-16-le")
            assert tags[images.ICC][0] == b"profile!" and tags[images.X_RES] == (300, 1)
        if kind == "tif16":
            assert images.DESCRIPTION not in images._tiff_tags(data)[1] and (images.read_tiff(data) == a.astype(np.uint16) * 257).all()
        (back,) = images.frames(spark, out).collect()
        assert back.image.width == 5


def test_mask_files(spark, tmp_path):
    a = np.zeros((4, 5, 3), np.uint8)
    a[1, 2] = 255
    (tmp_path / "m.png").write_bytes(images.write_png(a))
    assert [(r.y, r.x) for r in images.read_mask(spark, str(tmp_path / "m.png")).collect()] == [(1, 2)]
    (tmp_path / "bad.png").write_bytes(b"x")
    with pytest.raises(FileNotFoundError):
        images.read_mask(spark, str(tmp_path / "bad.png"))

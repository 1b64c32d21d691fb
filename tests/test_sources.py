"""Image files in and out, and files written by executors."""

import json

import numpy as np
from pyspark.sql import functions as F

from pixelweir.operators import documents
from pixelweir.sources import raster, sinks


def image(seed=0, h=6, w=9):
    rgba = np.random.default_rng(seed).integers(0, 256, (h, w, 4)).astype(np.uint8)
    rgba[..., 3] = np.where(rgba[..., 3] > 128, 255, 128)
    return rgba


def test_png_round_trip(spark, tmp_path):
    rgba = image()
    (tmp_path / "01_a.png").write_bytes(documents.png_bytes(rgba))
    (tmp_path / "02_b.png").write_bytes(b"\x89PNG\r\n\x1a\nbroken")
    (tmp_path / "03_c.gif").write_bytes(b"GIF89a")
    (tmp_path / "01_a.json").write_text(json.dumps({"width": 9}))
    got = {r.path.rsplit("/", 1)[-1]: r for r in raster.images(spark, str(tmp_path)).collect()}
    assert (got["01_a.png"].width, got["01_a.png"].height, got["01_a.png"].format, got["01_a.png"].error) == (9, 6, "PNG", None)
    assert got["02_b.png"].error == "invalid_image" and got["03_c.gif"].error == "unsupported_format"
    px = {(r.y, r.x): (r.r, r.g, r.b, r.a) for r in raster.image_pixels(spark, str(tmp_path)).collect()}
    assert all(px[y, x] == tuple(rgba[y, x].tolist()) for y in range(6) for x in range(9))
    samples = raster.list_samples(spark, str(tmp_path))
    assert [r.name for r in samples.collect()] == ["01_a"]
    assert raster.find_sample(samples, "1").count() == raster.find_sample(samples, "01_a.png").count() == 1 and raster.find_sample(samples, "9").count() == 0


def test_orientations(spark):
    want = {1: lambda a: a, 2: lambda a: a[:, ::-1], 3: lambda a: a[::-1, ::-1], 4: lambda a: a[::-1], 5: lambda a: a.T, 6: lambda a: np.rot90(a, -1), 7: lambda a: np.rot90(a, 2).T, 8: lambda a: np.rot90(a, 1)}
    a = np.arange(12).reshape(3, 4)
    df = spark.createDataFrame([(o, y, x, int(a[y, x])) for o in want for y in range(3) for x in range(4)], "o int, y int, x int, v int")
    ny, nx = raster.orient(F.col("y"), F.col("x"), F.lit(3), F.lit(4), F.col("o"))
    for r in df.select("o", ny.alias("ny"), nx.alias("nx"), "v").collect():
        assert want[r.o](a)[r.ny, r.nx] == r.v


def test_files_are_written_whole(spark, tmp_path):
    px = raster.derived(spark, "/root/testdata/sf0.001")
    png = sinks.previews(px).select(F.format_string("img_%d.png", "image_id").alias("name"), "png")
    out = str(tmp_path / "out")
    assert sorted(r.name for r in sinks.write_files(png, out, "name", "png").collect()) == ["img_0.png", "img_1.png"]
    back = raster.image_pixels(spark, out).groupBy("path").agg(F.sum(F.col("r") + 2 * F.col("g") + 3 * F.col("b") + F.col("a")).alias("s")).collect()
    want = px.groupBy("image_id").agg(F.sum(F.col("r") + 2 * F.col("g") + 3 * F.col("b") + F.col("a")).alias("s")).collect()
    assert sorted(r.s for r in back) == sorted(r.s for r in want)
    wanted = spark.createDataFrame([("img_0.png",), ("img_7.png",)], "name string")
    assert [r.name for r in sinks.missing_files(wanted, out).collect()] == ["img_7.png"]

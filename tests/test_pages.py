"""Page images: files, RGB rows, tiles with a halo and pixel tables, against whole images in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from registry_jobs.operators import images


def cleaned(rgb, pad=60):
    grey = images._tone(np.floor(rgb[..., 0] * 0.299 + rgb[..., 1] * 0.587 + rgb[..., 2] * 0.114 + 0.5), *images.TONES["binary"])
    return images._crop(images._despeckle(np.where(grey >= images._otsu(np.bincount(grey.ravel(), minlength=256)), 255, 0)), pad)


def page(h, w, seed):
    r = np.random.default_rng(seed)
    rgb = r.integers(120, 256, (h, w, 3), dtype=np.uint8)
    for _ in range(max(3, h * w // 2000)):
        y, x = r.integers(0, h), r.integers(0, w)
        rgb[y : y + r.integers(1, 6), x : x + r.integers(1, 9)] = r.integers(0, 80)
    rgb[r.random((h, w)) < 0.01] = 0
    return rgb


def test_tiles_joined_are_the_whole_page(spark):
    pages = {"a": page(3000, 2000, 1), "b": page(37, 1025, 2), "c": page(1, 1, 3), "d": np.full((70, 70, 3), 255, np.uint8)}
    rows = [(i, p.shape[1], p.shape[0], p.tobytes()) for i, p in pages.items()] + [("none", 3, 3, None), ("short", 3, 3, b"abc"), (None, 1, 1, b"abc")]
    df = spark.createDataFrame(rows, images.IMAGES).repartition(4)
    tiles = images.page_tiles(df)
    assert tiles.where("image_id = 'a'").count() == 24
    got = {r.image_id: np.frombuffer(bytes(r.gray), np.uint8).reshape(r.height, r.width) for r in images.clean_pages(df).collect()}
    assert set(got) == {*pages, None}  # a page without a name is a page
    for i, p in pages.items():
        assert np.array_equal(got[i], cleaned(p)), i


def test_files_are_read_and_broken_ones_told(spark, tmp_path):
    p = page(20, 30, 4)
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "rgb.ppm").write_bytes(b"P6\n# made by hand\n30 20\n255\n" + p.tobytes())
    (tmp_path / "x" / "grey.pgm").write_bytes(b"P5 30 20 255\n" + p[..., 0].tobytes())
    (tmp_path / "x" / "cut.ppm").write_bytes(b"P6 30 20 255\n" + p.tobytes()[:100])
    (tmp_path / "x" / "note.txt").write_bytes(b"no image")
    (tmp_path / "x" / "empty.ppm").write_bytes(b"")  # Spark has no row for it
    got = {r.image_id.rsplit("/", 1)[1]: r for r in images.read_images(spark, str(tmp_path / "x")).collect()}
    assert len(got) == 4 and bytes(got["rgb.ppm"].rgb) == p.tobytes() and (got["rgb.ppm"].width, got["rgb.ppm"].height) == (30, 20)
    assert bytes(got["grey.pgm"].rgb) == np.repeat(p[..., 0].ravel(), 3).tobytes()
    assert all(got[n].rgb is None and got[n].width is None for n in ("cut.ppm", "note.txt"))
    done = images.clean_pages(images.read_images(spark, str(tmp_path / "x")), pad=1).collect()
    assert sorted(r.image_id.rsplit("/", 1)[1] for r in done) == ["grey.pgm", "rgb.ppm"]


@pytest.mark.parametrize("shape", [(130, 70), (64, 64), (65, 129)])
def test_pixel_tables_across_tiles(spark, shape):
    p = page(*shape, 7)
    y, x = np.indices(shape)
    px = spark.createDataFrame([(1, int(a), int(b), *map(int, c)) for a, b, c in zip(y.ravel(), x.ravel(), p.reshape(-1, 3))], "image_id int, y int, x int, r int, g int, b int")
    grey = images.tone_map(px, *images.TONES["binary"]).cache()
    got = np.zeros(shape, np.uint8)
    for r in images.binarize_despeckle(grey, images.otsu_threshold(grey)).collect():
        got[r.y, r.x] = r.value
    assert np.array_equal(got, cleaned(p, pad=10_000))


def test_histograms_are_one_row_an_image_and_task(spark):
    px = spark.range(0, 200_000, 1, 4).select((F.col("id") % 3).cast("int").alias("image_id"), (F.col("id") * 7 % 256).cast("int").alias("grey"))
    sent = px.select(F.col("image_id").cast("long"), "grey").mapInArrow(images._counted, images.HISTOGRAM)
    assert sent.count() == 12 and sent.select(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b))).first()[0] == 200_000
    assert images.otsu_threshold(px.where("false")).count() == 0

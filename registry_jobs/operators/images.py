"""Page-image clean-up: on pixel tables by relational steps, on whole images by numpy inside tasks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Contrast and brightness of the presets.
TONES = {"grayscale": (1.12, 4), "light": (1.22, 8), "contrast": (1.5, 10), "binary": (1.9, 0)}


def tone(r: Column, g: Column, b: Column, contrast: float, brightness: float) -> Column:
    """Grey value of a pixel after contrast and brightness, 0 to 255."""
    grey = F.floor(r * 0.299 + g * 0.587 + b * 0.114 + 0.5)
    return F.least(F.lit(255), F.greatest(F.lit(0), F.floor((grey - 128) * F.lit(float(contrast)) + 128 + F.lit(float(brightness)) + 0.5))).cast("int")


def tone_map(pixels: DataFrame, contrast: float, brightness: float) -> DataFrame:
    """(image_id, y, x, grey) from (image_id, y, x, r, g, b)."""
    return pixels.select("image_id", "y", "x", tone(F.col("r"), F.col("g"), F.col("b"), contrast, brightness).alias("grey"))


HELD = 4096  # histograms that a task holds at once, 2 KiB each
HISTOGRAM = "image_id long, counts array<long>"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A histogram of 256 greys for each image of a task's pixels."""
    held: dict[int | None, np.ndarray] = {}

    def out() -> pa.RecordBatch:
        counts = pa.ListArray.from_arrays(pa.array(np.arange(len(held) + 1) * 256, pa.int32()), pa.array(np.concatenate(list(held.values()))))
        batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), counts], names=["image_id", "counts"])
        held.clear()
        return batch

    for batch in batches:
        batch = batch.filter(batch.column(1).is_valid())
        coded = batch.column(0).dictionary_encode("encode")
        at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * 256 + batch.column(1).to_numpy()
        counts = np.bincount(at, minlength=256 * len(coded.dictionary)).reshape(-1, 256)
        for image, n in zip(coded.dictionary.to_pylist(), counts, strict=True):
            held[image] = held[image] + n if image in held else n
        if len(held) > HELD:
            yield out()
    if held:
        yield out()


def _threshold(group: pa.Table) -> pa.Table:
    total = group["counts"].combine_chunks().flatten().to_numpy().reshape(-1, 256).sum(axis=0)
    return pa.table({"image_id": group["image_id"].slice(0, 1), "threshold": pa.array([_otsu(total)], pa.int32())})


def otsu_threshold(pixels: DataFrame) -> DataFrame:
    """(image_id, threshold): the grey that parts two classes with most variance between them, 70 to 210.

    Each task counts its pixels of an image in 256 slots, and slots are added: one exchange of one row an image
    and task (more where a task meets more than HELD images), whatever the image's size. Pixels without a grey don't count.
    """
    counts = pixels.select(F.col("image_id").cast("long").alias("image_id"), F.col("grey").cast("int").alias("grey")).mapInArrow(_counted, HISTOGRAM)
    return counts.groupBy("image_id").applyInArrow(_threshold, "image_id long, threshold int")


TILE = 64


def _despeckle_tile(group: pa.Table) -> pa.Table:
    """A tile's own pixels; those of its halo only tell their neighbours."""
    y, x, value, own, edge = (group[c].to_numpy() for c in ("y", "x", "value", "own", "edge"))
    dark = np.zeros((TILE + 2, TILE + 2), np.int8)
    oy, ox = group["tile_y"][0].as_py() * TILE - 1, group["tile_x"][0].as_py() * TILE - 1
    dark[y - oy, x - ox] = value == 0
    near = sum(dark[1 + dy : TILE + 1 + dy, 1 + dx : TILE + 1 + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx)
    y, x, value, edge = y[own], x[own], value[own], edge[own]
    lone = (value == 0) & ~edge & (near[y - oy - 1, x - ox - 1] <= 1)
    return pa.table({"image_id": pa.array([group["image_id"][0].as_py()] * len(y), pa.int64()), "y": pa.array(y, pa.int32()), "x": pa.array(x, pa.int32()), "value": pa.array(np.where(lone, 255, value), pa.int32())})


def binarize_despeckle(pixels: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(image_id, y, x, value): 0 or 255; a lone black pixel off the border, with one black neighbour at most, turns white.

    Pixels are dealt to tiles of TILE x TILE; those at a tile's edge go to the tiles beside it too, as a halo of one
    pixel, so a page of any size is worked on by many tasks after one exchange. A missing pixel is no black one.
    """
    size = pixels.groupBy("image_id").agg(F.max("y").alias("h"), F.max("x").alias("w"))
    known = thresholds.join(size, "image_id")
    bw = pixels.join(known, "image_id").select("image_id", "y", "x", F.when(F.col("grey") >= F.col("threshold"), 255).otherwise(0).alias("value"), "h", "w")
    edge = (F.col("y") == 0) | (F.col("x") == 0) | (F.col("y") == F.col("h")) | (F.col("x") == F.col("w"))

    def tiles(c: str) -> Column:
        t = lambda d: F.floor((F.col(c) + d) / TILE).cast("int")
        return F.array_distinct(F.array(t(0), t(-1), t(1)))

    own = lambda c: F.floor(F.col(c) / TILE).cast("int")
    dealt = bw.withColumn("edge", edge).withColumn("tile_y", F.explode(tiles("y"))).withColumn("tile_x", F.explode(tiles("x")))
    dealt = dealt.withColumn("own", (F.col("tile_y") == own("y")) & (F.col("tile_x") == own("x"))).where("tile_y >= 0 and tile_x >= 0")
    rows = dealt.select(F.col("image_id").cast("long").alias("image_id"), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), "value", "own", "edge", "tile_y", "tile_x")
    return rows.groupBy("image_id", "tile_y", "tile_x").applyInArrow(_despeckle_tile, "image_id long, y int, x int, value int")


def auto_crop(pixels: DataFrame, pad: int = 60) -> DataFrame:
    """(image_id, top, bottom, left, right, cropped): the ink's box with padding; not cropped below 75 % of a side."""
    ink = F.col("grey") < 245
    box = pixels.groupBy("image_id").agg(
        (F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"),
        *[f(F.when(ink, F.col(c))).alias(f"{n}_{c}") for c in "yx" for n, f in (("min", F.min), ("max", F.max))],
    )
    # a page without ink: the first edge runs to the end, the last stays
    low = lambda c, n: F.greatest(F.lit(0), F.least(F.col(n) - 1, F.coalesce(f"min_{c}", F.col(n)) - pad))
    high = lambda c, n: F.least(F.col(n) - 1, F.coalesce(f"max_{c}", F.col(n) - 1) + pad)
    edges = box.select("image_id", "h", "w", low("y", "h").alias("top"), high("y", "h").alias("bottom"), low("x", "w").alias("left"), high("x", "w").alias("right"))
    wide = (F.col("right") - F.col("left") + 1 >= F.col("w") * 0.75) & (F.col("bottom") - F.col("top") + 1 >= F.col("h") * 0.75)
    return edges.select("image_id", *[F.when(wide, F.col(c)).otherwise(o).cast("int").alias(c) for c, o in (("top", F.lit(0)), ("bottom", F.col("h") - 1), ("left", F.lit(0)), ("right", F.col("w") - 1))], wide.alias("cropped"))


def _tone(grey: np.ndarray, contrast: float, brightness: float) -> np.ndarray:
    return np.clip(np.floor((grey.astype(float) - 128) * contrast + 128 + brightness + 0.5), 0, 255).astype(np.uint8)


def _otsu(counts: np.ndarray) -> int:
    n = counts.astype(float)
    wb, sb = np.cumsum(n), np.cumsum(n * np.arange(256))
    wf = wb[-1] - wb
    ok = (wb > 0) & (wf > 0)
    v = np.zeros(256)
    gap = sb[ok] / wb[ok] - (sb[-1] - sb[ok]) / wf[ok]
    v[ok] = wb[ok] * wf[ok] * gap * gap
    return int(np.clip(v.argmax() if v.max() > 0 else 128, 70, 210))


def _despeckle(bw: np.ndarray) -> np.ndarray:
    black = np.pad((bw == 0).astype(np.int8), 1)
    near = sum(black[1 + dy : 1 + dy + bw.shape[0], 1 + dx : 1 + dx + bw.shape[1]] for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx)
    lone = (bw == 0) & (near <= 1)
    lone[[0, -1], :] = False
    lone[:, [0, -1]] = False
    return np.where(lone, 255, bw).astype(np.uint8)


def _crop(image: np.ndarray, pad: int) -> np.ndarray:
    ys, xs = np.flatnonzero((image < 245).any(1)), np.flatnonzero((image < 245).any(0))
    h, w = image.shape
    span = lambda at, n: (max(0, min(n - 1, (at[0] if len(at) else n) - pad)), min(n - 1, (at[-1] if len(at) else n - 1) + pad))
    (t, b), (le, r) = span(ys, h), span(xs, w)
    return image if r - le + 1 < w * 0.75 or b - t + 1 < h * 0.75 else image[t : b + 1, le : r + 1]


def clean_images(images: DataFrame, variant: str = "binary", pad: int = 60) -> DataFrame:
    """(image_id, variant, width, height, gray) from (image_id, width, height, gray binary), one image at a time.

    'binary' is toned, thresholded, despeckled and cropped; other variants are toned. A null or misfit
    image gives nulls.
    """
    contrast, brightness = TONES[variant]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, w, h, g in zip(*[batch.column(k) for k in range(4)], strict=True):
                w, h, g = w.as_py(), h.as_py(), g.as_py()
                image = None
                if g is not None and w and h and len(g) == w * h:
                    image = _tone(np.frombuffer(g, np.uint8).reshape(h, w), contrast, brightness)
                    if variant == "binary":
                        image = _crop(_despeckle(np.where(image >= _otsu(np.bincount(image.ravel(), minlength=256)), 255, 0)), pad)
                size = (None, None) if image is None else (image.shape[1], image.shape[0])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i.as_py()], pa.int64()), pa.array([variant]), pa.array([size[0]], pa.int32()), pa.array([size[1]], pa.int32()), pa.array([None if image is None else image.tobytes()], pa.binary())],
                    names=["image_id", "variant", "width", "height", "gray"],
                )

    return images.select(F.col("image_id").cast("long"), F.col("width").cast("int"), F.col("height").cast("int"), "gray").mapInArrow(run, "image_id long, variant string, width int, height int, gray binary")


IMAGES = "image_id string, width int, height int, rgb binary"
_HEADER = re.compile(rb"P([56])(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)\s")


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1), strict=True):
            data = content.as_py() or b""
            head = _HEADER.match(data)
            w, h, rgb = None, None, None
            if head and int(head[4]) == 255:
                channels, w, h = 3 if head[1] == b"6" else 1, int(head[2]), int(head[3])
                body = np.frombuffer(data, np.uint8, offset=head.end())
                if len(body) >= w * h * channels:
                    body = body[: w * h * channels]
                    rgb = (body if channels == 3 else np.repeat(body, 3)).tobytes()
                else:
                    w = h = None
            yield pa.RecordBatch.from_arrays([pa.array([path.as_py()]), pa.array([w], pa.int32()), pa.array([h], pa.int32()), pa.array([rgb], pa.binary())], names=["image_id", "width", "height", "rgb"])


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, width, height, rgb) of the Netpbm files (P5, P6, 8 bits a sample) under a folder, image_id being the file's path.

    A file of another kind, or cut off, has nulls, so that it can be told and rejected; an empty file has no row.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(_decoded, IMAGES)


#: Side of the tiles that whole pages are cut into.
SIDE = 512
TILES = "image_id string, width int, height int, top int, left int, tile_height int, tile_width int, halo binary, counts array<long>"


def _cut(contrast: float, brightness: float, side: int):
    """Toned tiles of a page with the pixel around them, white beyond the page, and their own histogram."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, w, h, rgb in zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True):
                if rgb is None or not w or not h or len(rgb) != w * h * 3:
                    continue
                r, g, b = np.moveaxis(np.frombuffer(rgb, np.uint8).reshape(h, w, 3).astype(float), 2, 0)
                page = np.pad(_tone(np.floor(r * 0.299 + g * 0.587 + b * 0.114 + 0.5), contrast, brightness), 1, constant_values=255)
                for top in range(0, h, side):
                    for left in range(0, w, side):
                        part = page[top : top + side + 2, left : left + side + 2]
                        th, tw = part.shape[0] - 2, part.shape[1] - 2
                        counts = np.bincount(part[1:-1, 1:-1].ravel(), minlength=256)
                        ints = [pa.array([x], pa.int32()) for x in (w, h, top, left, th, tw)]
                        yield pa.RecordBatch.from_arrays([pa.array([i], pa.string()), *ints, pa.array([part.tobytes()], pa.binary()), pa.array([counts], pa.list_(pa.int64()))], names=[c.split()[0] for c in TILES.split(", ")])

    return cut


def page_tiles(pages: DataFrame, variant: str = "binary", side: int = SIDE) -> DataFrame:
    """Tiles of toned grey, each with a halo of one pixel, from pages (image_id, width, height, rgb). Pages that are null or misfit have none."""
    named = pages.select(F.col("image_id").cast("string").alias("image_id"), F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), "rgb")
    return named.mapInArrow(_cut(*TONES[variant], side), TILES)


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            shape = (row["tile_height"] + 2, row["tile_width"] + 2)
            bw = np.where(np.frombuffer(row["halo"], np.uint8).reshape(shape) >= row["threshold"], 255, 0)
            black = (bw == 0).astype(np.int8)
            th, tw = row["tile_height"], row["tile_width"]
            near = sum(black[1 + dy : 1 + dy + th, 1 + dx : 1 + dx + tw] for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx)
            own = bw[1:-1, 1:-1]
            y, x = np.arange(row["top"], row["top"] + th)[:, None], np.arange(row["left"], row["left"] + tw)[None, :]
            inner = (y > 0) & (x > 0) & (y < row["height"] - 1) & (x < row["width"] - 1)
            out = np.where((own == 0) & inner & (near <= 1), 255, own).astype(np.uint8)
            ints = [pa.array([row[c]], pa.int32()) for c in ("width", "height", "top", "left", "tile_height", "tile_width")]
            yield pa.RecordBatch.from_arrays([pa.array([row["image_id"]], pa.string()), *ints, pa.array([out.tobytes()], pa.binary())], names=[c.split()[0] for c in CLEAN_TILES.split(", ")])


CLEAN_TILES = "image_id string, width int, height int, top int, left int, tile_height int, tile_width int, gray binary"


def clean_tiles(tiles: DataFrame) -> DataFrame:
    """Black and white tiles, despeckled, from page_tiles(): the histograms of a page's tiles are added to its threshold, then each tile is a task's own."""
    counts = tiles.select("image_id", F.posexplode("counts").alias("grey", "n")).groupBy("image_id", "grey").agg(F.sum("n").alias("n"))
    whole = counts.groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("grey", "n"))), lambda x: x["n"]).alias("counts"))  # 256 an image

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_otsu(np.array(c)) for c in batch.column(1).to_pylist()], pa.int32())], names=["image_id", "threshold"])

    thresholds = whole.mapInArrow(found, "image_id string, threshold int").withColumnRenamed("image_id", "of")
    return tiles.drop("counts").join(thresholds, F.col("image_id").eqNullSafe(F.col("of"))).drop("of").mapInArrow(_cleaned, CLEAN_TILES)


def _joined(pad: int):
    def joined(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        page = np.full((rows[0]["height"], rows[0]["width"]), 255, np.uint8)
        for r in rows:
            page[r["top"] : r["top"] + r["tile_height"], r["left"] : r["left"] + r["tile_width"]] = np.frombuffer(r["gray"], np.uint8).reshape(r["tile_height"], r["tile_width"])
        page = _crop(page, pad)
        return pa.table({"image_id": pa.array([rows[0]["image_id"]], pa.string()), "width": pa.array([page.shape[1]], pa.int32()), "height": pa.array([page.shape[0]], pa.int32()), "gray": pa.array([page.tobytes()], pa.binary())})

    return joined


def clean_pages(pages: DataFrame, variant: str = "binary", pad: int = 60, side: int = SIDE) -> DataFrame:
    """(image_id, width, height, gray) from pages (image_id, width, height, rgb): toned, thresholded, despeckled tile by tile, joined and cropped. A page is one row at last."""
    return clean_tiles(page_tiles(pages, variant, side)).groupBy("image_id").applyInArrow(_joined(pad), "image_id string, width int, height int, gray binary")

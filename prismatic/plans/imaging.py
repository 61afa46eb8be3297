"""Queries over picture files and marks on pictures. A picture is made from all bytes of a text, so work grows with the texts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import covers, marks, resampling, retouching, shapes
from ..operators.pixels import map_pictures
from ..session import checkpointed
from ..sources import pictures as files
from .registry import query, table
from .sequences import colour_pictures

#: Pixels of a row: regions narrower than forty have no marks.
SIDE = 60


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _masks(pictures: DataFrame, find) -> DataFrame:
    """image_id, pixels of the mask, how sure, and a digest of it, of find(picture, row) over pictures."""
    import hashlib

    import pandas as pd

    def work(frames):
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                mask, sure = find(np.frombuffer(r.pixels, np.uint8).reshape(r.height, r.width, 3), r)
                rows.append((r.image_id, int(mask.sum()), sure, hashlib.sha256(mask.tobytes()).hexdigest()))
            yield pd.DataFrame(rows, columns=["image_id", "masked", "sure", "sha"])

    return map_pictures(pictures, work, "image_id long, masked long, sure double, sha string")


@query("i21_candidate_masks")
def candidate_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strokes that look like a mark's, in the whole picture of each text."""
    return _masks(colour_pictures(_documents(spark, sf_dir), SIDE), lambda image, row: marks.candidate_mask(image))


def text_polygons(pictures: DataFrame) -> DataFrame:
    """image_id and points of polygons as a reader of text would give them: three slanting lines in each picture."""
    w, h = F.col("width").cast("double"), F.col("height").cast("double")
    corner = lambda x, y, k: F.array(w * x, h * (y + 0.02 * (k == 2)))
    quads = [F.array(corner(0.05, y, 1), corner(right, y, 2), corner(right, y + 0.1, 2), corner(0.05, y + 0.1, 1)) for y, right in ((0.2, 0.5), (0.5, 0.8), (0.8, 0.4))]
    return pictures.where(F.octet_length("pixels") > 0).select("image_id", F.explode(F.array(*quads)).alias("points"))


@query("i22_stroke_masks")
def stroke_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strokes within polygons, which are rows of their own and meet their picture in a join."""
    images = colour_pictures(_documents(spark, sf_dir), SIDE)
    polygons = text_polygons(images).groupBy("image_id").agg(F.array_sort(F.collect_list("points")).alias("text"))
    return _masks(images.join(polygons, "image_id"), lambda image, row: marks.stroke_mask(image, [np.array([list(p) for p in points]) for points in row.text]))


@query("i8_skew_from_pixels")
def skew_from_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By how much the lines of each picture agree that it is askew."""
    return shapes.skew_turns(colour_pictures(_documents(spark, sf_dir), SIDE)).select("image_id", F.round("turn", 6).alias("turn"))


@query("i17_turned")
def turned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each picture turned by up to four degrees, cut and brought back to its size."""
    out = retouching.each_picture(colour_pictures(_documents(spark, sf_dir), SIDE), lambda image, row: resampling.turned(image, (row.image_id or 0) % 17 * 0.5 - 4))
    return out.select("image_id", "width", "height", F.sha2("pixels", 256).alias("sha"))


@query("i16_enlarged")
def enlarged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each picture with a longer side of at least 128 pixels."""
    out = retouching.each_picture(colour_pictures(_documents(spark, sf_dir), SIDE), lambda image, row: resampling.at_least(image, 128))
    return out.select("image_id", "width", "height", F.sha2("pixels", 256).alias("sha"))


PLAN = marks.MarkPlan()


@query("i23_mark_plans")
def mark_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is to be done about a mark in the protected region of each picture, by content; no pixel is changed."""
    images = colour_pictures(_documents(spark, sf_dir), SIDE)
    found = marks.planned(images, PLAN, text_polygons(images))
    return found.select("sha", "image_id", "width", "height", "status", "method", F.round("sure", 6).alias("sure"), F.round("share", 6).alias("share"), F.sha2("mask", 256).alias("mask"))


@query("i23_marks_removed")
def marks_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored plans carried out: each picture without its mark, and how many pixels differ beyond the region, which is none."""
    images = colour_pictures(_documents(spark, sf_dir), SIDE)
    plans = checkpointed(marks.planned(images, PLAN, text_polygons(images)))
    return marks.carried_out(images, plans, PLAN).select("image_id", "status", "outside", F.sha2("pixels", 256).alias("sha"))


def picture_files(docs: DataFrame, side: int = SIDE) -> DataFrame:
    """image_id and content: each text's picture as a file; every eleventh is cut, every thirteenth PNG has a wrong bit, every seventeenth begins with something else."""
    n = F.col("image_id")
    whole = files.encoded(colour_pictures(docs, side).withColumn("kind", F.when(n % 2 == 0, "png").otherwise("bmp")))
    size, c = F.octet_length("content"), F.col("content")
    middle = F.lit(44)
    flipped = F.concat(F.substring(c, F.lit(1), middle), F.unhex(F.lpad(F.hex(F.pmod(F.conv(F.hex(F.substring(c, middle + 1, F.lit(1))), 16, 10).cast("int") + 1, F.lit(256))), 2, "0")), F.substring(c, middle + 2, size))
    changed = F.when(n % 17 == 0, F.concat(F.lit(b"XX"), F.substring(c, F.lit(3), size))).when(n % 11 == 0, F.substring(c, F.lit(1), size - 15)).when((n % 13 == 0) & (n % 2 == 0), flipped).otherwise(c)
    return whole.select("image_id", F.when(size > 0, changed).otherwise(c).alias("content"))


@query(
    "i1_ingested_files",
    f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, strlen(coalesce(text, '')) AS n FROM documents),
    f AS (SELECT *, CASE WHEN n = 0 OR doc_id % 17 = 0 OR doc_id % 11 = 0 OR doc_id % 26 = 0 THEN 'INVALID_IMAGE' END AS reject_code, ceil(n / {3 * SIDE}.0)::INTEGER AS h FROM d),
    g AS (SELECT *, CASE WHEN reject_code IS NULL THEN h END AS height, CASE WHEN reject_code IS NULL THEN {SIDE} END AS width FROM f)
    SELECT doc_id AS image_id, CASE WHEN n = 0 OR doc_id % 17 = 0 THEN NULL WHEN doc_id % 2 = 0 THEN 'image/png' ELSE 'image/bmp' END AS content_type, reject_code, width, height,
      round(width / height, 4) AS aspect_ratio, CASE WHEN reject_code IS NULL THEN sha256(text || repeat(chr(0), h * {3 * SIDE} - n)) END AS pixels_sha256
    FROM g""",
)
def ingested_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of pictures read back: size and digest of what they decode to, or why they are rejected."""
    found = files.ingested(picture_files(_documents(spark, sf_dir)))
    return found.select("image_id", "content_type", "reject_code", "width", "height", F.round("aspect_ratio", 4).alias("aspect_ratio"), "pixels_sha256")


@query("i2_thumbnails")
def thumbnails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small copy of each picture as a file of its own, and its hash."""
    found = files.ingested(picture_files(_documents(spark, sf_dir)), files.Limits(thumbnail=32)).where("reject_code IS NULL")
    return found.select("image_id", "working_width", "working_height", "phash", F.sha2("thumbnail", 256).alias("sha"))


def detected_boxes(pictures: DataFrame) -> DataFrame:
    """Boxes as a detector would give them: two in each picture, one of which may lie over its rim, with labels and confidences."""
    n, w, h = F.coalesce("image_id", F.lit(0)), F.col("width"), F.col("height")
    box = lambda x, y, a, b, label, sure: F.struct(x.cast("int").alias("x0"), y.cast("int").alias("y0"), (x + a).cast("int").alias("x1"), (y + b).cast("int").alias("y1"), label.alias("label"), sure.alias("confidence"))
    first = box(w * (n % 5) / 6, h * (n % 3) / 4, w / 4, h / 3, F.when(n % 4 == 0, "product").otherwise("logo"), (n % 10) / 10.0)
    second = box(w * 0.8, h * 0.7, w / 3, h / 2, F.lit("logo"), F.lit(0.9))
    return pictures.select("image_id", F.inline(F.array(first, second)))


@query("i25_covered_in_blocks")
def covered_in_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logos of each picture in blocks, with the audit."""
    images = colour_pictures(_documents(spark, sf_dir), SIDE)
    found = covers.covered(images, detected_boxes(images), covers.Cover(labels=("logo",)))
    return found.select("image_id", "status", "covered", F.round("share", 6).alias("share"), "outside", F.sha2("pixels", 256).alias("sha"))


@query("i24_stickers")
def stickers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sticker, pale at its rim, over the logos of each picture, with the audit."""
    y, x = np.mgrid[0:20, 0:30]
    rgba = np.stack([200 + 0 * x, 40 + 3 * x, 60 + 5 * y, np.clip(255 - 20 * np.hypot(x - 15, y - 10), 0, 255)], axis=2).astype(np.uint8)
    images = colour_pictures(_documents(spark, sf_dir), SIDE)
    found = covers.covered(images, detected_boxes(images), covers.Cover("sticker", ("logo",), expansion=0.0, sticker=rgba.tobytes(), sticker_shape=(20, 30)))
    return found.select("image_id", "status", "covered", F.round("share", 6).alias("share"), "outside", F.sha2("pixels", 256).alias("sha"))

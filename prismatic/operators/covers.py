"""Covers over detected boxes: a sticker laid on, or the box in blocks, with an audit of what has changed. Boxes are rows of their own and meet their picture in a join."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pixels, resampling

Box = tuple[int, int, int, int]
#: How much wider a cover is than its box, for the sake of long lines; where a sticker's own middle is; and the least side of a block.
WIDE, MIDDLE, LEAST_BLOCK = 1.05, 0.34, 4


@dataclass(frozen=True)
class Cover:
    """action: sticker or blocks. A box counts if its label is wanted (none: all are) and it is sure enough; it grows by `expansion` of its sides."""

    action: str = "blocks"
    labels: tuple[str, ...] = ()
    least_confidence: float = 0.5
    expansion: float = 0.12
    block_ratio: float = 0.08
    scale: float = 1.0
    sticker: bytes = b""
    sticker_shape: tuple[int, int] = field(default=(0, 0))


def grown(box: Box, width: int, height: int, expansion: float) -> Box | None:
    """The box with its corners in order, larger on each side, within the picture; None where nothing of it is in there."""
    x0, x1 = sorted((int(box[0]), int(box[2])))
    y0, y1 = sorted((int(box[1]), int(box[3])))
    if x1 <= 0 or y1 <= 0 or x0 >= width or y0 >= height or x0 == x1 or y0 == y1:
        return None
    dx, dy = round((x1 - x0) * expansion), round((y1 - y0) * expansion)
    return max(0, x0 - dx), max(0, y0 - dy), min(width, x1 + dx), min(height, y1 + dy)


def in_blocks(rgb: np.ndarray, boxes: list[Box], cover: Cover) -> tuple[np.ndarray, list[Box]]:
    """Each box, after those before it, as blocks of the mean of what they lie over."""
    out, done = rgb.copy(), []
    for box in boxes:
        target = grown(box, rgb.shape[1], rgb.shape[0], cover.expansion)
        if target is None:
            continue
        x0, y0, x1, y1 = target
        w, h = x1 - x0, y1 - y0
        block = max(LEAST_BLOCK, round(min(w, h) * cover.block_ratio))
        columns, rows = max(1, w // block), max(1, h // block)
        small = resampling.averaged(out[y0:y1, x0:x1], columns, rows)
        out[y0:y1, x0:x1] = small[np.arange(h) * rows // h][:, np.arange(w) * columns // w]
        done.append(target)
    return out, done


def sticker_of(cover: Cover) -> np.ndarray:
    """Its four channels, without the rim that can't be seen."""
    rgba = np.frombuffer(cover.sticker, np.uint8).reshape(*cover.sticker_shape, 4)
    y, x = np.nonzero(rgba[..., 3] > 8)
    if not len(y):
        raise ValueError("nothing of the sticker can be seen")
    return rgba[y.min() : y.max() + 1, x.min() : x.max() + 1]


def with_stickers(rgb: np.ndarray, boxes: list[Box], cover: Cover) -> tuple[np.ndarray, list[Box]]:
    """The sticker over each box: as high as the box by the scale, or as its width asks for, its own middle on the box's."""
    sticker, out, done = sticker_of(cover), rgb.copy(), []
    height, width = rgb.shape[:2]
    own_h, own_w = sticker.shape[:2]
    for box in boxes:
        target = grown(box, width, height, cover.expansion)
        if target is None:
            continue
        x0, y0, x1, y1 = target
        h = max(1, round((y1 - y0) * cover.scale), round((x1 - x0) * WIDE * own_h / own_w))
        w = max(1, round(own_w * h / own_h))
        drawn = (resampling.averaged if h < own_h else lambda i, a, b: resampling.resized(i, a, b, resampling.cubic))(sticker, w, h).astype(float)
        left, top = max(x0, (x0 + x1) // 2 - round(w * MIDDLE)), (y0 + y1) // 2 - h // 2
        a, b, c, d = max(0, left), max(0, top), min(width, left + w), min(height, top + h)
        if c <= a or d <= b:
            continue
        part = drawn[b - top : d - top, a - left : c - left]
        alpha = part[..., 3:] / 255
        out[b:d, a:c] = np.clip(part[..., :3] * alpha + out[b:d, a:c] * (1 - alpha), 0, 255).astype(np.uint8)
        done.append((a, b, c, d))
    return out, done


COVERED = "image_id long, width int, height int, pixels binary, status string, covered int, boxes array<array<int>>, share double, outside long, error string"


def covered(pictures: DataFrame, boxes: DataFrame, cover: Cover) -> DataFrame:
    """RGB pictures (image_id, width, height, pixels) with their boxes (image_id, x0, y0, x1, y1, label, confidence) covered, and the audit.

    status: applied; not_detected, where no box counts or lies in the picture; empty, for a picture without pixels; failed_safe, with
    the error, where covering fails: such a picture is as it was, and others aren't touched by it. share: of the
    picture that covers lie on, overlaps once; outside: changed pixels beyond them, which is 0. Boxes lie in the order of
    their corners. A picture's boxes are one list.
    """
    good = F.col("confidence") >= cover.least_confidence
    if cover.labels:
        good = good & F.col("label").isin(*cover.labels)
    lists = boxes.where(good).groupBy(F.col("image_id").alias("_of")).agg(F.array_sort(F.collect_list(F.array(*(F.col(c).cast("int") for c in ("x0", "y0", "x1", "y1"))))).alias("wanted"))
    joined = pictures.select("image_id", "width", "height", "pixels").join(lists, F.col("image_id") == F.col("_of"), "left").drop("_of")

    def work(frames):
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                head = (r.image_id, r.width, r.height)
                if not len(r.pixels):
                    rows.append((*head, r.pixels, "empty", 0, [], 0.0, 0, None))
                    continue
                rgb = np.frombuffer(r.pixels, np.uint8).reshape(r.height, r.width, 3)
                wanted = [tuple(int(v) for v in b) for b in r.wanted] if r.wanted is not None else []
                try:
                    out, done = (with_stickers if cover.action == "sticker" else in_blocks)(rgb, wanted, cover) if wanted else (rgb, [])
                except ValueError as wrong:
                    rows.append((*head, r.pixels, "failed_safe", 0, [], 0.0, 0, str(wrong)[:300]))
                    continue
                share = pixels.union_area(done, r.width, r.height) / (r.width * r.height)
                rows.append((*head, out.tobytes(), "applied" if done else "not_detected", len(done), [list(b) for b in done], share, pixels.changed_outside(rgb, out, done), None))
            yield pd.DataFrame(rows, columns=["image_id", "width", "height", "pixels", "status", "covered", "boxes", "share", "outside", "error"])

    return pixels.map_pictures(joined, work, COVERED)

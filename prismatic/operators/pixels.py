"""Pixel kernels on gray or colour arrays, a small numpy step per picture inside Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Bytes of pictures that a task is given, and works on, at a time; a larger picture is worked on by itself.
BATCH_BYTES, SLICE_BYTES = 8 << 20, 2 << 20


def in_slices(frames: Iterator[pd.DataFrame], column: str = "pixels") -> Iterator[pd.DataFrame]:
    """The rows of frames, in frames of about SLICE_BYTES of a column's bytes."""
    for frame in frames:
        before = np.cumsum([0] + [len(p) if p is not None else 0 for p in frame[column]])[:-1]
        cuts = np.flatnonzero(np.diff(before // SLICE_BYTES)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(frame)], strict=True):
            yield frame.iloc[a:b]


def map_pictures(pictures: DataFrame, work: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str, column: str = "pixels") -> DataFrame:
    """mapInPandas over a few megabytes of pictures at a time, however many rows that is."""
    pictures.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return pictures.mapInPandas(lambda frames: work(in_slices(frames, column)), schema)


def edge_variance(gray: np.ndarray) -> float:
    """Of eight times a pixel less its neighbours, clipped to a byte, without the rim."""
    g = gray.astype(np.int64)
    total = sum(np.roll(np.roll(g, dy, 0), dx, 1) for dy in (-1, 0, 1) for dx in (-1, 0, 1)) - g
    edges = np.clip(8 * g - total, 0, 255)
    inner = edges[1:-1, 1:-1] if min(edges.shape) > 2 else edges
    return float(inner.var())


def noise_residual(gray: np.ndarray, radius: float = 1.0) -> float:
    """The mean difference from a Gaussian blur."""
    x = np.arange(-3, 4)
    kernel = np.exp(-(x**2) / (2 * radius**2))
    kernel /= kernel.sum()
    g = gray.astype(float)
    for axis in (0, 1):
        padded = np.pad(g, [(3, 3) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        g = sum(k * np.take(padded, range(i, i + gray.shape[axis]), axis) for i, k in enumerate(kernel))
    return float(np.abs(gray - np.rint(g)).mean())


def quality(gray: np.ndarray) -> dict[str, float]:
    return {
        "brightness": float(gray.mean()),
        "deviation": float(gray.std()),
        "shadow": float((gray <= 16).mean()),
        "highlight": float((gray >= 245).mean()),
        "edges": edge_variance(gray),
        "noise": noise_residual(gray),
    }


def white_balanced(image: np.ndarray, strength: float) -> np.ndarray:
    """Channels moved towards their common mean, by six hundredths at most, and the picture by the strength towards that."""
    means = image.reshape(-1, image.shape[-1]).mean(axis=0)
    gains = np.clip(means.mean() / np.maximum(means, 1), 0.94, 1.06)
    balanced = np.minimum(255, np.rint(image * gains))
    return (image + strength * (balanced - image)).astype(np.uint8)


#: Fixed value: how far a full lift or recovery moves a byte.
TONE_RANGE = 55


def tone_curve(shadow_lift: float, highlight_recovery: float) -> np.ndarray:
    """256 values: dark ones lifted by the square of their darkness, bright ones held back by the cube of their brightness."""
    value = np.arange(256)
    x = value / 255
    moved = value + TONE_RANGE * (shadow_lift * (1 - x) ** 2 - highlight_recovery * x**3)
    return np.clip(np.rint(moved), 0, 255).astype(np.uint8)


def mosaic(image: np.ndarray, box: tuple[int, int, int, int], block: int) -> np.ndarray:
    """The box in blocks of their mean."""
    out = image.copy()
    x0, y0, x1, y1 = box
    for y in range(y0, y1, block):
        for x in range(x0, x1, block):
            part = out[y : min(y + block, y1), x : min(x + block, x1)]
            part[:] = np.rint(part.mean(axis=(0, 1)))
    return out


def unblended(image: np.ndarray, mark: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """What lay under a mark of known colour and opacity; opacities under 0.002 are none, those over 0.99 count as that."""
    held = np.clip(alpha, 0, 0.99)
    a = held[..., None] if image.ndim == 3 else held
    under = np.clip((image - a * mark) / (1 - a), 0, 255).astype(np.uint8)
    return np.where(a >= 0.002, under, image)


def changed_outside(before: np.ndarray, after: np.ndarray, boxes: list[tuple[int, int, int, int]]) -> int:
    """Pixels that differ outside all boxes."""
    differ = (before != after) if before.ndim == 2 else (before != after).any(axis=2)
    for x0, y0, x1, y1 in boxes:
        differ[y0:y1, x0:x1] = False
    return int(differ.sum())


def union_area(boxes: list[tuple[int, int, int, int]], width: int, height: int) -> int:
    covered = np.zeros((height, width), bool)
    for x0, y0, x1, y1 in boxes:
        covered[y0:y1, x0:x1] = True
    return int(covered.sum())


MEASURES = "image_id long, brightness double, deviation double, shadow double, highlight double, edges double, noise double"


def measured(pictures: DataFrame) -> DataFrame:
    """Quality measures of gray pictures: image_id, width, height, pixels (binary, row by row). Null for a picture without pixels."""
    names = ["brightness", "deviation", "shadow", "highlight", "edges", "noise"]

    def work(frames):
        for frame in frames:
            rows = [quality(np.frombuffer(p, np.uint8).reshape(h, w)) if len(p) else {} for p, w, h in zip(frame["pixels"], frame["width"], frame["height"], strict=True)]
            yield pd.DataFrame(rows, columns=names, dtype=float).assign(image_id=frame["image_id"].to_numpy())[["image_id", *names]] if rows else pd.DataFrame()

    return map_pictures(pictures, work, MEASURES)


def pixelated(pictures: DataFrame, block: int = 4) -> DataFrame:
    """The same pictures with their box (x0, y0, x1, y1) in blocks, and the pixels changed outside it, which is none.

    Pixels may hold any number of frames of width by height, one after the other; each has the box.
    """

    def work(frames):
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                before = np.frombuffer(row.pixels, np.uint8).reshape(len(row.pixels) // row.width, row.width)
                stack = before.reshape(len(before) // row.height, row.height, row.width).transpose(1, 2, 0)
                after = mosaic(stack, (row.x0, row.y0, row.x1, row.y1), block).transpose(2, 0, 1).reshape(before.shape)
                boxes = [(row.x0, y + row.y0, row.x1, y + row.y1) for y in range(0, len(before), row.height)]
                out.append((row.image_id, after.tobytes(), changed_outside(before, after, boxes), int((before != after).sum())))
            yield pd.DataFrame(out, columns=["image_id", "pixels", "outside", "inside"])

    return map_pictures(pictures, work, "image_id long, pixels binary, outside long, inside long")

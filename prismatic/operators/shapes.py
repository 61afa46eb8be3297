"""Shapes on small arrays: gray morphology, filled polygons, thin edges and straight lines. Each is a few numpy passes over one picture."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import evidence
from .pixels import map_pictures
from .resampling import triangle, within
from .retouching import gray, spots

#: Tangents of 22.5 and 67.5 degrees, between which a slope counts as diagonal.
FLAT, STEEP = np.sqrt(2) - 1, np.sqrt(2) + 1


def extreme(values: np.ndarray, size: int, axis: int, of: Callable = np.maximum) -> np.ndarray:
    """The largest (or of=np.minimum: smallest) of the `size` neighbours along an axis that begin size // 2 before each place; what is outside doesn't count."""
    edge = 0 if of is np.maximum else 255
    before = size // 2
    x = np.full([n + size - 1 if a == axis else n for a, n in enumerate(values.shape)], edge, values.dtype)
    x[tuple(slice(before, before + n) if a == axis else slice(None) for a, n in enumerate(values.shape))] = values
    part = lambda a, b: x[tuple(slice(a, b) if k == axis else slice(None) for k in range(values.ndim))]
    done, length = 1, values.shape[axis]
    while 2 * done <= size:
        x = of(part(0, x.shape[axis] - done), part(done, None))
        done *= 2
    return of(part(0, length), part(size - done, size - done + length)) if done < size else part(0, length)


def dilated(values: np.ndarray, width: int, height: int) -> np.ndarray:
    return extreme(extreme(values, width, 1), height, 0)


def eroded(values: np.ndarray, width: int, height: int) -> np.ndarray:
    return extreme(extreme(values, width, 1, np.minimum), height, 0, np.minimum)


def closed(values: np.ndarray, width: int, height: int) -> np.ndarray:
    return eroded(dilated(values, width, height), width, height)


def opened(values: np.ndarray, width: int, height: int) -> np.ndarray:
    return dilated(eroded(values, width, height), width, height)


def standing_out(gray: np.ndarray, size: int) -> np.ndarray:
    """How much a pixel is brighter than what is left when bright things narrower than size go, or darker than when dark ones do."""
    return np.maximum(gray - opened(gray, size, size), closed(gray, size, size) - gray)


def grown(mask: np.ndarray, radius: int) -> np.ndarray:
    """A mask with a disc of the radius around each of its pixels."""
    out = mask.copy()
    h = len(mask)
    for dy in range(-min(radius, h - 1), min(radius, h - 1) + 1):
        reach = int(np.rint(radius * np.sqrt((radius * radius - dy * dy) / (radius * radius))))
        row = extreme(mask.astype(np.uint8), 2 * reach + 1, 1).astype(bool)
        out[max(0, dy) : h + min(0, dy)] |= row[max(0, -dy) : h - max(0, dy)]
    return out


def area(points: np.ndarray) -> float:
    x, y = points.astype(float).T
    return abs(float(x @ np.roll(y, -1) - y @ np.roll(x, -1))) / 2


def filled(points: np.ndarray, height: int, width: int) -> np.ndarray:
    """The mask of a polygon of whole-number corners (x, y): what is inside by crossings, and its sides."""
    out = np.zeros((height, width), bool)
    y = np.arange(height)[:, None]
    x = np.arange(width)[None, :]
    for (xa, ya), (xb, yb) in zip(points.tolist(), np.roll(points, -1, axis=0).tolist(), strict=True):
        if ya != yb:
            at = xa + (y - ya) * (xb - xa) / (yb - ya)
            out ^= ((y >= min(ya, yb)) & (y < max(ya, yb))) & (x >= at)
    steps = [np.rint(np.linspace(a, b, int(max(abs(b - a))) + 1)).astype(int) for a, b in zip(points, np.roll(points, -1, axis=0), strict=True)]
    side = np.concatenate(steps)
    side = side[(side >= 0).all(axis=1) & (side[:, 0] < width) & (side[:, 1] < height)]
    out[side[:, 1], side[:, 0]] = True
    return out


def edges(gray: np.ndarray, low: float, high: float) -> np.ndarray:
    """Thin edges: pixels that are steeper than their two neighbours across the edge and than `low`, in parts with a pixel steeper than `high`."""
    h, w = gray.shape
    padded = np.empty((h + 2, w + 2))
    padded[1:-1, 1:-1] = gray
    padded[0], padded[-1] = padded[1], padded[-2]
    padded[:, 0], padded[:, -1] = padded[:, 1], padded[:, -2]
    right, down = padded[:, 2:] - padded[:, :-2], padded[2:] - padded[:-2]
    dx, dy = right[:-2] + 2 * right[1:-1] + right[2:], down[:, :-2] + 2 * down[:, 1:-1] + down[:, 2:]
    steep = np.zeros((h + 2, w + 2))
    steep[1:-1, 1:-1] = np.abs(dx) + np.abs(dy)
    shifted = lambda y, x: steep[1 + y : 1 + y + h, 1 + x : 1 + x + w]
    here = shifted(0, 0)
    flat, upright = np.abs(dy) < FLAT * np.abs(dx), np.abs(dy) > STEEP * np.abs(dx)
    falling = dx * dy < 0
    across = np.where(
        flat,
        (here > shifted(0, -1)) & (here >= shifted(0, 1)),
        np.where(upright, (here > shifted(-1, 0)) & (here >= shifted(1, 0)), np.where(falling, (here > shifted(-1, 1)) & (here > shifted(1, -1)), (here > shifted(-1, -1)) & (here > shifted(1, 1)))),
    )
    thin = across & (here > low)
    steepest = thin & (here > high)
    if not steepest.any():
        return steepest
    part = spots(thin)
    strong = np.zeros(int(part.max()) + 1, bool)
    strong[part[steepest]] = True
    return strong[part]  # 0, where nothing is thin, is never strong


@lru_cache(maxsize=4)
def _distances(turns: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """What each x and each y below a size adds to the distance of a line of each angle."""
    angle, at = np.arange(turns) * np.pi / turns, np.arange(size)
    return np.outer(at, np.cos(angle)), np.outer(at, np.sin(angle))


def lines(mask: np.ndarray, votes: int = 30, shortest: float = 0.0, gap: float = 8, turns: int = 360) -> list[tuple[int, int, int, int]]:
    """Straight lines (x0, y0, x1, y1) among the pixels of a mask, from left to right (or downwards), the ones with most pixels first.

    Each pixel votes for all lines through it, by their angle (half a degree apart) and distance (a pixel).
    The line with most votes is cut where a gap is longer than `gap`; parts of the
    least length are taken, and their pixels don't vote any more. It ends where no line has enough votes.
    """
    y, x = np.nonzero(mask)
    if len(x) < votes:
        return []
    angle = np.arange(turns) * np.pi / turns
    reach = int(np.ceil(np.hypot(*mask.shape))) + 1
    across, down = _distances(turns, 1 << (max(mask.shape) - 1).bit_length())
    cell = np.rint(across[x] + down[y]).astype(np.int64)
    cell += reach + np.arange(turns) * (2 * reach + 1)
    count = np.bincount(cell.ravel(), minlength=turns * (2 * reach + 1))
    left, found = np.ones(len(x), bool), []
    while len(x) and count.max() >= votes:
        best = int(count.argmax())
        on = np.flatnonzero(left & (cell[:, best // (2 * reach + 1)] == best))
        t = angle[best // (2 * reach + 1)]
        along = y[on] * np.cos(t) - x[on] * np.sin(t)
        on = on[np.argsort(along, kind="stable")]
        parts = np.split(on, np.flatnonzero(np.diff(np.sort(along)) > gap) + 1)
        taken = [p for p in parts if np.hypot(x[p[-1]] - x[p[0]], y[p[-1]] - y[p[0]]) >= max(shortest, 1)]
        count[best] = 0
        for p in taken:
            a, b = sorted((int(x[k]), int(y[k])) for k in (p[0], p[-1]))
            found.append((*a, *b))
            left[p] = False
            np.subtract.at(count, cell[p].ravel(), 1)
    return found


#: Fixed values of straightening: the longest side of what is looked at, slopes of edges, votes of a line, its least share of the longer side, and the gap that it may have.
PREVIEW, WEAK, STRONG, VOTES, SHARE, GAP = 320, 60, 180, 30, 0.22, 8


def edge_lines(rgb: np.ndarray) -> list[tuple[int, int, int, int]]:
    small = within(gray(rgb).astype(np.uint8), PREVIEW, triangle)
    return lines(edges(small, WEAK, STRONG), VOTES, max(small.shape) * SHARE, GAP)


def skew_turns(pictures: DataFrame, most_degrees: int = 5, small_degrees: int = 3) -> DataFrame:
    """image_id and turn (degrees counterclockwise) of RGB pictures (image_id, width, height, pixels) whose lines agree that they are askew.

    Lines that want a small turn are asked first; all up to the largest one only where those don't agree.
    Pictures without pixels or lines have no row. Lines are a row each, so pictures vote in Spark.
    """

    def work(frames):
        for frame in frames:
            rows = [(r.image_id, b[2] - b[0], b[3] - b[1]) for r in frame.itertuples(index=False) if len(r.pixels) for b in edge_lines(np.frombuffer(r.pixels, np.uint8).reshape(r.height, r.width, 3))]
            yield pd.DataFrame(rows, columns=["image_id", "dx", "dy"])

    found = map_pictures(pictures.select("image_id", "width", "height", "pixels"), work, "image_id long, dx int, dy int")
    return evidence.skew_votes(found, most_degrees, small_degrees=small_degrees)

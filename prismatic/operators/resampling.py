"""Pictures at other sizes and turned: separable kernels, as matrices from pixels to pixels of one axis."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def sinc3(x: np.ndarray) -> np.ndarray:
    """A sine over x, windowed to three pixels."""
    return np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)


def cubic(x: np.ndarray, a: float = -0.5) -> np.ndarray:
    x = np.abs(x)
    near = ((a + 2) * x - (a + 3)) * x * x + 1
    far = ((x - 5) * x + 8) * x * a - 4 * a
    return np.where(x < 1, near, np.where(x < 2, far, 0.0))


def triangle(x: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, 1 - np.abs(x))


def box(x: np.ndarray) -> np.ndarray:
    """Means of the pixels below a pixel."""
    return np.where((x > -0.5) & (x <= 0.5), 1.0, 0.0)


REACH: dict[Callable, float] = {sinc3: 3.0, cubic: 2.0, triangle: 1.0, box: 0.5}


def weights(before: int, after: int, kernel: Callable) -> np.ndarray:
    """after x before: what each new pixel takes of the old ones. Kernels widen where a picture shrinks; rows add up to 1."""
    scale = before / after
    widen = max(scale, 1.0)
    middle = (np.arange(after) + 0.5) * scale
    reach = REACH[kernel] * widen
    low, high = np.maximum(0, np.floor(middle - reach + 0.5)), np.minimum(before, np.floor(middle + reach + 0.5))
    at = np.arange(before)
    inside = (at >= low[:, None]) & (at < high[:, None])
    found = np.where(inside, kernel((at + 0.5 - middle[:, None]) / widen), 0.0)
    return found / found.sum(axis=1, keepdims=True)


def resized(image: np.ndarray, width: int, height: int, kernel: Callable = sinc3) -> np.ndarray:
    """At another size: columns first, then rows, bytes in between."""
    values = image.astype(float)
    if width != image.shape[1]:
        values = np.clip(np.rint(np.moveaxis(np.tensordot(weights(image.shape[1], width, kernel), values, (1, 1)), 0, 1)), 0, 255)
    if height != image.shape[0]:
        values = np.clip(np.rint(np.tensordot(weights(image.shape[0], height, kernel), values, (1, 0))), 0, 255)
    return values.astype(np.uint8)


def averaged(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """At a smaller size: each pixel the mean of the area that it takes the place of, parts of pixels by their part."""

    def parts(before: int, after: int) -> np.ndarray:
        edge = np.arange(after + 1) * before / after
        at = np.arange(before)
        return np.clip(np.minimum(edge[1:, None], at + 1) - np.maximum(edge[:-1, None], at), 0, None) * after / before

    values = np.moveaxis(np.tensordot(parts(image.shape[1], width), image.astype(float), (1, 1)), 0, 1)
    return np.clip(np.rint(np.tensordot(parts(image.shape[0], height), values, (1, 0))), 0, 255).astype(np.uint8)


def within(image: np.ndarray, longest: int, kernel: Callable = sinc3) -> np.ndarray:
    """No side longer than `longest`, in the same proportions; a smaller picture stays as it is."""
    h, w = image.shape[:2]
    if max(h, w) <= longest:
        return image
    scale = longest / max(h, w)
    return resized(image, max(1, round(w * scale)), max(1, round(h * scale)), kernel)


def at_least(image: np.ndarray, longest: int) -> np.ndarray:
    """The longer side at least so long, in the same proportions."""
    h, w = image.shape[:2]
    if max(h, w) >= longest:
        return image
    scale = longest / max(h, w)
    return resized(image, max(1, round(w * scale)), max(1, round(h * scale)))


def turned(image: np.ndarray, degrees: float) -> np.ndarray:
    """Turned counterclockwise about its middle between sixteen pixels, cut by what the turn leaves empty, and brought back to its size. As it is where nothing would be left."""
    h, w = image.shape[:2]
    angle = np.radians(degrees)
    c, s = np.cos(angle), np.sin(angle)
    corner_x, corner_y = (np.array([(x - w / 2) * c + (y - h / 2) * s for x, y in ((0, 0), (w, 0), (w, h), (0, h))]), np.array([(y - h / 2) * c - (x - w / 2) * s for x, y in ((0, 0), (w, 0), (w, h), (0, h))]))
    full_w, full_h = (int(np.ceil(np.round(v.max() - v.min(), 9))) for v in (corner_x, corner_y))
    inset = int(np.ceil(np.round(max(h, w) * np.sin(abs(angle)), 9))) + 2
    if min(full_w, full_h) <= 2 * inset:
        return image
    x = np.arange(inset, full_w - inset)[None, :] + 0.5 - full_w / 2
    y = np.arange(inset, full_h - inset)[:, None] + 0.5 - full_h / 2
    from_x, from_y = x * c - y * s + w / 2 - 0.5, x * s + y * c + h / 2 - 0.5
    first_x, first_y = np.floor(from_x).astype(int), np.floor(from_y).astype(int)
    values = image.astype(float).reshape(h, w, -1)
    out = np.zeros((*first_x.shape, values.shape[2]))
    for j in range(-1, 3):
        row = np.clip(first_y + j, 0, h - 1)
        by_row = cubic(from_y - (first_y + j))[..., None]
        for i in range(-1, 3):
            out += by_row * cubic(from_x - (first_x + i))[..., None] * values[row, np.clip(first_x + i, 0, w - 1)]
    kept = np.clip(np.rint(out), 0, 255).astype(np.uint8).reshape(*first_x.shape, *image.shape[2:])
    return resized(kept, w, h)

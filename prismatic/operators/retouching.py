"""The retouching chain on RGB pictures (height, width, 3 bytes): small numpy steps, each picture by itself inside Arrow batches."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import pixels, resampling

#: Fixed values of sRGB and its white point, for lightness and colour as Lab.
TO_XYZ = np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]])
WHITE = np.array([0.950456, 1.0, 1.088754])
#: Weights of gray.
GRAY = np.array([0.299, 0.587, 0.114])


@dataclass(frozen=True)
class Retouch:
    """How far each step goes, and how long the longer side is at least; the defaults change nothing."""

    white_balance: float = 0.0
    shadow_lift: float = 0.0
    highlight_recovery: float = 0.0
    glare: float = 0.0
    local_tone: float = 0.0
    clip: float = 2.0
    denoise: float = 0.0
    brightness: float = 1.0
    contrast: float = 1.0
    color: float = 1.0
    clarity: float = 0.0
    sharpness: float = 1.0
    longest: int = 0


def as_bytes(values: np.ndarray) -> np.ndarray:
    return np.clip(values, 0, 255).astype(np.uint8)


def gray(rgb: np.ndarray) -> np.ndarray:
    return np.rint(rgb @ GRAY)


def blended(before: np.ndarray, after: np.ndarray, strength: float | np.ndarray) -> np.ndarray:
    return as_bytes(before + strength * (after.astype(float) - before))


@lru_cache(maxsize=256)
def mirrored(size: int, reach: int) -> np.ndarray:
    """Places along an axis with `reach` more on either side, mirrored at the rim."""
    return np.pad(np.arange(size), reach, mode="reflect")


def filtered(values: np.ndarray, kernel: np.ndarray, axis: int) -> np.ndarray:
    """Along one axis, the rim mirrored."""
    size = values.shape[axis]
    padded = values.astype(float).take(mirrored(size, len(kernel) // 2), axis)
    part = (lambda i: padded[i : i + size]) if axis == 0 else (lambda i: padded[:, i : i + size])
    out = kernel[0] * part(0)
    for i, k in enumerate(kernel[1:], 1):
        out += k * part(i)
    return out


def smoothed(values: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian blur."""
    x = np.arange(-round(3 * sigma), round(3 * sigma) + 1)
    kernel = np.exp(-(x**2) / (2 * sigma**2))
    kernel /= kernel.sum()
    return filtered(filtered(values, kernel, 0), kernel, 1)


def lab(rgb: np.ndarray) -> np.ndarray:
    """Lightness of 0 to 255 and two colour channels."""
    c = rgb / 255
    linear = np.where(c <= 0.04045, c / 12.92, ((c + 0.055) / 1.055) ** 2.4)
    t = linear @ TO_XYZ.T / WHITE
    f = np.where(t > 216 / 24389, np.cbrt(t), t * 841 / 108 + 4 / 29)
    return np.stack([(116 * f[..., 1] - 16) * 2.55, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], axis=-1)


def from_lab(values: np.ndarray) -> np.ndarray:
    y = (values[..., 0] / 2.55 + 16) / 116
    f = np.stack([y + values[..., 1] / 500, y, y - values[..., 2] / 200], axis=-1)
    linear = np.where(f > 6 / 29, f**3, (f - 4 / 29) * 108 / 841) * WHITE @ np.linalg.inv(TO_XYZ).T
    linear = np.clip(linear, 0, 1)
    return as_bytes(np.rint(255 * np.where(linear <= 0.0031308, 12.92 * linear, 1.055 * linear ** (1 / 2.4) - 0.055)))


def with_lightness(rgb: np.ndarray, change) -> np.ndarray:
    """The picture with its lightness changed and its colours as they are."""
    values = lab(rgb)
    values[..., 0] = np.clip(change(values[..., 0]), 0, 255)
    return from_lab(values)


def equalized(light: np.ndarray, clip: float, tiles: int = 8) -> np.ndarray:
    """Local contrast: each tile's histogram, cut at clip times its mean, gives a curve; a pixel is between the curves of the four next tiles."""
    h, w = light.shape
    level = np.rint(light).astype(np.int64)
    rows, columns = (np.minimum(np.arange(n) * tiles // n, tiles - 1) for n in (h, w))
    tile = rows[:, None] * tiles + columns[None, :]
    counts = np.bincount((tile * 256 + level).ravel(), minlength=tiles * tiles * 256).reshape(-1, 256).astype(float)
    area = counts.sum(axis=1, keepdims=True)
    most = np.maximum(1, clip * area / 256)
    over = np.maximum(counts - most, 0).sum(axis=1, keepdims=True)
    curves = np.cumsum(np.minimum(counts, most) + over / 256, axis=1) * 255 / np.maximum(area, 1)

    def place(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = (np.arange(n) + 0.5) * tiles / n - 0.5
        low = np.floor(at).astype(np.int64)
        held = lambda i: np.minimum(np.maximum(i, 0), min(tiles, n) - 1)
        return held(low), held(low + 1), at - low

    if min(h, w) < tiles:
        return curves[tile, level]
    y0, y1, fy = place(h)
    x0, x1, fx = place(w)
    of = lambda y, x: curves[y[:, None] * tiles + x[None, :], level]
    upper = of(y0, x0) * (1 - fx) + of(y0, x1) * fx
    lower = of(y1, x0) * (1 - fx) + of(y1, x1) * fx
    return upper * (1 - fy[:, None]) + lower * fy[:, None]


def denoised(rgb: np.ndarray, near: float = 3, alike: float = 22) -> np.ndarray:
    """Means of the pixels up to two away, those of like colours counting more."""
    h, w, _ = rgb.shape
    padded = rgb.astype(float)[mirrored(h, 2)][:, mirrored(w, 2)]
    total, weights = np.zeros(rgb.shape), np.zeros((h, w, 1))
    squares = np.arange(3 * 255 + 1.0) ** 2 / (2 * alike**2)
    by_distance = {d: np.exp(-d / (2 * near**2) - squares) for d in (0, 1, 2, 4)}
    for dy in range(-2, 3):
        for dx in range(-2, 3):
            if dy * dy + dx * dx <= 4:
                other = padded[2 + dy : 2 + dy + h, 2 + dx : 2 + dx + w]
                apart = np.abs(other - rgb)
                weight = by_distance[dy * dy + dx * dx][(apart[..., 0] + apart[..., 1] + apart[..., 2]).astype(np.int64)][..., None]
                total += weight * other
                weights += weight
    return np.rint(total / weights)


def spots(mask: np.ndarray) -> np.ndarray:
    """Numbers (from 1) of the connected parts of a mask, corners counting as contact; 0 elsewhere."""
    h, w = mask.shape
    padded = np.zeros((h, w + 2), np.int8)
    padded[:, 1:-1] = mask
    edges = np.diff(padded, axis=1)
    row, start = np.nonzero(edges == 1)
    out = np.zeros((h, w), np.int64)
    if not len(row):
        return out
    end = np.nonzero(edges == -1)[1]
    # runs of the row above that touch a run stand next to each other
    above = (row - 1) * (w + 2)
    low = np.searchsorted(row * (w + 2) + end, above + start, "left")
    touching = np.maximum(np.searchsorted(row * (w + 2) + start, above + end, "right") - low, 0)
    here = np.repeat(np.arange(len(row)), touching)
    other = np.arange(len(here)) - np.repeat(np.cumsum(touching) - touching, touching) + np.repeat(low, touching)
    head = np.arange(len(row))
    while len(here):  # the greater of two heads is put below the smaller one, until all runs that touch have one head
        a, b = head[here], head[other]
        apart = a != b
        if not apart.any():
            break
        here, other, a, b = here[apart], other[apart], a[apart], b[apart]
        np.minimum.at(head, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(head, up := head[head]):
            head = up
    numbers = np.unique(head, return_inverse=True)[1] + 1
    out[mask.astype(bool)] = np.repeat(numbers, end - start)
    return out


def glare(rgb: np.ndarray) -> np.ndarray:
    """Bright, pale spots of middling size that don't touch the rim."""
    high, low = rgb.max(axis=2).astype(float), rgb.min(axis=2)
    if high.max() < 240:
        return np.zeros(high.shape, bool)
    pale = np.rint(255 * (high - low) / np.maximum(high, 1)) <= 75
    found = spots((high >= 240) & pale)
    areas = np.bincount(found.ravel())
    rim = np.unique(np.concatenate([found[0], found[-1], found[:, 0], found[:, -1]]))
    good = (areas >= max(30, int(found.size * 0.00015))) & (areas <= int(found.size * 0.03))
    good[0] = False
    good[rim] = False
    return good[found]


def without_glare(rgb: np.ndarray, strength: float) -> np.ndarray:
    mask = glare(rgb)
    if not mask.any():
        return rgb
    alpha = smoothed(255.0 * mask, 5) / 255 * strength
    return with_lightness(rgb, lambda light: light * (1 - alpha) + (215 + (light - 215) * 0.45) * alpha)


def clarified(rgb: np.ndarray, strength: float) -> np.ndarray:
    """Detail added where there are edges."""
    g = gray(rgb)
    slope, weight = np.array([-1, 0, 1]), np.array([1, 2, 1])
    steep = np.hypot(filtered(filtered(g, slope, 1), weight, 0), filtered(filtered(g, slope, 0), weight, 1))
    edges = smoothed(np.clip((steep - 28) / 90, 0, 1), 1.2)[..., None] * strength
    return blended(rgb, as_bytes(np.rint(1.35 * rgb - 0.35 * smoothed(rgb, 1.1))), edges)


def sharpened(rgb: np.ndarray, sharpness: float) -> np.ndarray:
    """Above 1, detail is added where it stands out; below, the picture is smoothed."""
    if abs(sharpness - 1) < 0.01:
        return rgb
    if sharpness < 1:
        around = np.array([1, 1, 1])
        soft = (filtered(filtered(rgb, around, 0), around, 1) + 4 * rgb.astype(float)) / 13
        soft[[0, -1]], soft[:, [0, -1]] = rgb[[0, -1]], rgb[:, [0, -1]]
        return blended(np.rint(soft), rgb, sharpness)
    detail = rgb - smoothed(rgb, 1.0)
    mask = smoothed((np.abs(detail).max(axis=2) >= 6).astype(float), 0.8)[..., None]
    return as_bytes(rgb + min(1.5, (sharpness - 1) * 1.5) * detail * mask)


def enhanced(rgb: np.ndarray, plan: Retouch) -> np.ndarray:
    """Brightness from black, contrast from the mean gray, colour from gray."""
    out = blended(np.zeros_like(rgb), rgb, plan.brightness)
    out = blended(np.full_like(out, int(gray(out).mean() + 0.5)), out, plan.contrast)
    return blended(np.repeat(gray(out)[..., None], 3, axis=2), out, plan.color)


def retouched(rgb: np.ndarray, plan: Retouch, turn: float | None = None) -> np.ndarray:
    """All steps in their fixed order, straightening first and size before sharpness; those of no strength are left out."""
    out = resampling.turned(rgb, turn) if turn else rgb
    if plan.white_balance:
        out = pixels.white_balanced(out, plan.white_balance)
    if plan.shadow_lift or plan.highlight_recovery:
        out = pixels.tone_curve(plan.shadow_lift, plan.highlight_recovery)[out]
    if plan.local_tone:
        out = with_lightness(out, lambda light: light + plan.local_tone * (equalized(light, plan.clip) - light))
    if plan.denoise:
        out = blended(out, denoised(out), plan.denoise)
    if plan.glare:
        out = without_glare(out, plan.glare)
    out = enhanced(out, plan)
    if plan.clarity:
        out = clarified(out, plan.clarity)
    return sharpened(resampling.at_least(out, plan.longest), plan.sharpness)


def upright(image: np.ndarray, orientation: int) -> np.ndarray:
    """As the orientation mark of a camera (1 to 8) says; other marks leave the picture as it is."""
    if orientation in (5, 6, 7, 8):
        image = image.swapaxes(0, 1)
    if orientation in (2, 3, 6, 7):
        image = image[:, ::-1]
    if orientation in (3, 4, 7, 8):
        image = image[::-1]
    return np.ascontiguousarray(image)


MEASURES = ("brightness", "shadow", "highlight", "saturation", "cast", "noise", "edges")


def measures(rgb: np.ndarray) -> dict[str, float]:
    """What a retouched picture is accepted by."""
    g = gray(rgb)
    high, low = rgb.max(axis=2).astype(float), rgb.min(axis=2)
    means = rgb.reshape(-1, 3).mean(axis=0)
    cross = filtered(g, np.array([1, 0, 1]), 0) + filtered(g, np.array([1, 0, 1]), 1) - 4 * g
    return {
        "brightness": round(float(g.mean()), 4),
        "shadow": round(float((g <= 5).mean()), 6),
        "highlight": round(float((g >= 250).mean()), 6),
        "saturation": round(float(np.rint(255 * (high - low) / np.maximum(high, 1)).mean()), 4),
        "cast": round(float(means.max() - means.min()), 4),
        "noise": round(float(np.abs(g - np.rint(smoothed(g, 1.0))).mean()), 4),
        "edges": round(float(cross.var()), 4),
    }


def alpha_of(clean: np.ndarray, marked: np.ndarray, color: tuple[float, float, float] = (255.0, 255.0, 255.0)) -> np.ndarray:
    """The opacity of a mark of one colour, from a picture with and one without it: the median of the channels that tell."""
    room = np.asarray(color) - clean.astype(float)
    tells = np.abs(room) >= 8
    each = np.where(tells, (marked.astype(float) - clean) / np.where(tells, room, 1), np.nan)
    out = np.zeros(clean.shape[:2])
    some = tells.any(axis=2)
    out[some] = np.nanmedian(each[some], axis=1)
    return np.clip(out, 0, 0.99)


def each_picture(pictures: DataFrame, step) -> DataFrame:
    """image_id, width, height, pixels of RGB pictures (and more columns) after step(picture, row); those without pixels stay as they are."""

    def work(frames):
        for frame in frames:
            rows = []
            for row in frame.itertuples(index=False):
                if not len(row.pixels):
                    rows.append((row.image_id, row.width, row.height, b""))
                    continue
                out = step(np.frombuffer(row.pixels, np.uint8).reshape(row.height, row.width, 3), row)
                rows.append((row.image_id, out.shape[1], out.shape[0], out.tobytes()))
            yield pd.DataFrame(rows, columns=["image_id", "width", "height", "pixels"])

    return pixels.map_pictures(pictures, work, "image_id long, width int, height int, pixels binary")


def retouch_all(pictures: DataFrame, plan: Retouch) -> DataFrame:
    """image_id, width, height, pixels and the measures before and after (x_before, x_after) of RGB pictures (image_id, width, height, pixels).

    A column turn, if there is one, has the degrees by which each picture is straightened, or null. A picture without pixels has empty pixels
    and no measures. All pictures of a batch are worked on by themselves, so memory follows the largest picture.
    """
    names = [f"{m}_{when}" for m in MEASURES for when in ("before", "after")]

    def work(frames):
        for frame in frames:
            rows = []
            for row in frame.itertuples(index=False):
                if not len(row.pixels):
                    rows.append({"image_id": row.image_id, "pixels": b""})
                    continue
                before = np.frombuffer(row.pixels, np.uint8).reshape(row.height, row.width, 3)
                turn = getattr(row, "turn", None)
                after = retouched(before, plan, None if turn is None or np.isnan(turn) else turn)
                told = {f"{m}_{when}": v for when, image in (("before", before), ("after", after)) for m, v in measures(image).items()}
                rows.append({"image_id": row.image_id, "width": after.shape[1], "height": after.shape[0], "pixels": after.tobytes(), **told})
            yield pd.DataFrame(rows, columns=["image_id", "width", "height", "pixels", *names]).fillna({"width": 0, "height": 0})

    return pixels.map_pictures(pictures, work, "image_id long, width int, height int, pixels binary, " + ", ".join(f"{n} double" for n in names))

"""Picture files as rows: PNG and BMP bytes read and written, checked, and made smaller. One row per file, whatever is wrong with it."""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..operators import resampling
from ..operators.pixels import map_pictures
from ..operators.retouching import gray

#: What files begin with.
PNG, BMP = b"\x89PNG\r\n\x1a\n", b"BM"
OTHERS = {b"\xff\xd8\xff": "image/jpeg", b"GIF8": "image/gif"}
#: Samples of a pixel by colour type.
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


class BadPicture(Exception):
    """code: INVALID_IMAGE, IMAGE_TOO_LARGE or UNSUPPORTED_IMAGE."""

    def __init__(self, reason: str, code: str = "INVALID_IMAGE"):
        super().__init__(reason)
        self.code = code


@dataclass(frozen=True)
class Limits:
    """Bytes of a file, pixels that it may decode to, pixels and sides of the working copy, and the longest side of a thumbnail."""

    file_bytes: int = 20 << 20
    decoded_pixels: int = 50_000_000
    pixels: int = 4_000_000
    width: int = 4096
    height: int = 4096
    thumbnail: int = 64


def chunks(data: bytes):
    """Kind and content of each part of a PNG file up to its end part; a part that is cut or damaged is an error."""
    at = len(PNG)
    while True:
        if at + 12 > len(data):
            raise BadPicture("cut")
        size, kind = struct.unpack_from(">I4s", data, at)
        if at + 12 + size > len(data):
            raise BadPicture("cut")
        content = data[at + 8 : at + 8 + size]
        if zlib.crc32(kind + content) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            raise BadPicture("damaged")
        yield kind, content
        if kind == b"IEND":
            return
        at += 12 + size


def unfiltered(raw: bytes, height: int, stride: int, step: int) -> np.ndarray:
    """Rows of bytes from rows that tell each byte's difference from its neighbours; step bytes to the left is the same sample of the pixel before."""
    lines = np.frombuffer(raw, np.uint8).reshape(height, stride + 1)
    out = np.zeros((height + 1, stride), np.uint8)
    for y, line in enumerate(lines, 1):
        kind, row, above = line[0], line[1:], out[y - 1]
        if kind == 0:
            out[y] = row
        elif kind == 1:
            filled = np.zeros(-(-stride // step) * step, np.uint8)
            filled[:stride] = row
            out[y] = np.cumsum(filled.reshape(-1, step), axis=0, dtype=np.uint8).ravel()[:stride]
        elif kind == 2:
            out[y] = row + above
        elif kind in (3, 4):
            here, up = [0] * step + [0] * stride, [0] * step + above.tolist()
            for k, v in enumerate(row.tolist(), step):
                a, b, c = here[k - step], up[k], up[k - step]
                guess = (a + b) // 2 if kind == 3 else min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
                here[k] = (v + guess) & 255
            out[y] = here[step:]
        else:
            raise BadPicture("damaged")
    return out[1:]


def from_png(data: bytes, limits: Limits) -> np.ndarray:
    head, palette, packed = None, None, []
    for kind, content in chunks(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", content) if len(content) == 13 else None
        elif kind == b"PLTE":
            palette = np.frombuffer(content, np.uint8)
        elif kind == b"IDAT":
            packed.append(content)
    if head is None or not head[0] or not head[1]:
        raise BadPicture("damaged")
    width, height, depth, color, *_, interlaced = head
    if width * height > limits.decoded_pixels:
        raise BadPicture("too many pixels", "IMAGE_TOO_LARGE")
    if depth not in (8, 16) or color not in SAMPLES or interlaced or color == 3 and (depth != 8 or palette is None):
        raise BadPicture("a kind that isn't read", "UNSUPPORTED_IMAGE")
    step = SAMPLES[color] * depth // 8
    unpack = zlib.decompressobj()
    try:  # no more than the picture has, whatever the file says
        raw = unpack.decompress(b"".join(packed), height * (width * step + 1))
    except zlib.error as wrong:
        raise BadPicture("damaged") from wrong
    if len(raw) != height * (width * step + 1):
        raise BadPicture("cut")
    samples = unfiltered(raw, height, width * step, step).reshape(height, width, SAMPLES[color], depth // 8)[..., 0]
    if color == 3:
        if samples.max() >= len(palette) // 3:
            raise BadPicture("damaged")
        return palette[: len(palette) // 3 * 3].reshape(-1, 3)[samples[..., 0]]
    rgb = samples[..., :3] if color in (2, 6) else np.repeat(samples[..., :1], 3, axis=2)
    if color in (4, 6):  # on white
        alpha = samples[..., -1:] / 255
        rgb = np.rint(rgb * alpha + 255 * (1 - alpha)).astype(np.uint8)
    return np.ascontiguousarray(rgb)


def to_png(rgb: np.ndarray) -> bytes:
    """Each row as it is, or as differences to the left or from above, whichever are smallest."""
    h, w = rgb.shape[:2]
    rows = rgb.reshape(h, 3 * w)
    left = rows.copy()
    left[:, 3:] -= rows[:, :-3]
    above = rows.copy()
    above[1:] -= rows[:-1]
    forms = np.stack([rows, left, above])
    best = np.abs(forms.view(np.int8).astype(np.int16)).sum(axis=2).argmin(axis=0).astype(np.uint8)
    lines = np.concatenate([best[:, None], forms[best, np.arange(h)]], axis=1)
    part = lambda kind, content: struct.pack(">I", len(content)) + kind + content + struct.pack(">I", zlib.crc32(kind + content))
    return PNG + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines.tobytes(), 6)) + part(b"IEND", b"")


def from_bmp(data: bytes, limits: Limits) -> np.ndarray:
    if len(data) < 54:
        raise BadPicture("cut")
    start, size, width, height, _, bits, packing = struct.unpack_from("<10xIIiiHHI", data)
    rows = abs(height)
    if size < 40 or width <= 0 or not rows:
        raise BadPicture("damaged")
    if width * rows > limits.decoded_pixels:
        raise BadPicture("too many pixels", "IMAGE_TOO_LARGE")
    if bits not in (24, 32) or packing:
        raise BadPicture("a kind that isn't read", "UNSUPPORTED_IMAGE")
    stride = -(-width * bits // 32) * 4
    if start + stride * rows > len(data):
        raise BadPicture("cut")
    lines = np.frombuffer(data, np.uint8, stride * rows, start).reshape(rows, stride)[:, : width * bits // 8]
    rgb = lines.reshape(rows, width, bits // 8)[..., 2::-1]
    return np.ascontiguousarray(rgb[::-1] if height > 0 else rgb)


def to_bmp(rgb: np.ndarray) -> bytes:
    h, w = rgb.shape[:2]
    lines = np.zeros((h, -(-3 * w // 4) * 4), np.uint8)
    lines[:, : 3 * w] = rgb[::-1, :, ::-1].reshape(h, 3 * w)
    return BMP + struct.pack("<IHHI", 54 + lines.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, lines.size, 0, 0, 0, 0) + lines.tobytes()


def kind_of(data: bytes) -> str | None:
    if data.startswith(PNG):
        return "image/png"
    if data.startswith(BMP):
        return "image/bmp"
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return "image/webp"
    return next((kind for magic, kind in OTHERS.items() if data.startswith(magic)), None)


def decoded(data: bytes, limits: Limits) -> np.ndarray:
    if not data:
        raise BadPicture("empty")
    if len(data) > limits.file_bytes:
        raise BadPicture("too many bytes", "IMAGE_TOO_LARGE")
    kind = kind_of(data)
    if kind is None:
        raise BadPicture("no picture")
    if kind not in ("image/png", "image/bmp"):
        raise BadPicture("a kind that isn't read", "UNSUPPORTED_IMAGE")
    return from_png(data, limits) if kind == "image/png" else from_bmp(data, limits)


def working_size(width: int, height: int, limits: Limits) -> tuple[int, int]:
    scale = min(1.0, (limits.pixels / (width * height)) ** 0.5, limits.width / width, limits.height / height)
    return (width, height) if scale >= 1 else (max(1, int(width * scale)), max(1, int(height * scale)))


def average_hash(rgb: np.ndarray) -> str:
    """64 signs: which eighths of the picture are as bright as its mean, or brighter."""
    small = resampling.resized(gray(rgb).astype(np.uint8), 8, 8)
    return "".join("1" if v else "0" for v in (small >= small.mean()).ravel())


FILES = (
    "image_id long, content_type string, file_size long, reject_code string, reason string, width int, height int, aspect_ratio double, sha256 string, "
    "pixels_sha256 string, phash string, working_width int, working_height int, thumbnail binary"
)


def ingested(files: DataFrame, limits: Limits | None = None) -> DataFrame:
    """A row per file (image_id, content): what kind it is, its size, digests, and a thumbnail as PNG; or why it is rejected (reject_code, reason). A null content is an empty one."""
    held = limits or Limits()
    names = [f.split()[0] for f in FILES.split(", ")]

    def row(image_id, data: bytes) -> tuple:
        kind, digest = kind_of(data), hashlib.sha256(data).hexdigest()
        try:
            rgb = decoded(data, held)
        except BadPicture as wrong:
            return (image_id, kind, len(data), wrong.code, str(wrong), None, None, None, digest, None, None, None, None, None)
        h, w = rgb.shape[:2]
        work_w, work_h = working_size(w, h, held)
        working = rgb if (work_w, work_h) == (w, h) else resampling.resized(rgb, work_w, work_h)
        small = resampling.within(working, held.thumbnail)
        return (image_id, kind, len(data), None, None, w, h, round(w / h, 4), digest, hashlib.sha256(rgb.tobytes()).hexdigest(), average_hash(small), work_w, work_h, to_png(small))

    def work(frames):
        for frame in frames:
            rows = [row(i, bytes(c) if c is not None else b"") for i, c in zip(frame["image_id"], frame["content"], strict=True)]
            out = pd.DataFrame(rows, columns=names)
            for c in ("width", "height", "working_width", "working_height"):
                out[c] = out[c].astype("Int32")
            yield out

    return map_pictures(files.select("image_id", "content"), work, FILES, "content")


def encoded(pictures: DataFrame) -> DataFrame:
    """image_id and content of RGB pictures (image_id, width, height, pixels, kind: png or bmp); a picture without pixels has empty content."""

    def work(frames):
        for frame in frames:
            content = [(to_png if r.kind == "png" else to_bmp)(np.frombuffer(r.pixels, np.uint8).reshape(r.height, r.width, 3)) if len(r.pixels) else b"" for r in frame.itertuples(index=False)]
            yield pd.DataFrame({"image_id": frame["image_id"].to_numpy(), "content": content})

    return map_pictures(pictures, work, "image_id long, content binary")

"""Picture files: round trips, files written by hand, and one row for whatever is wrong."""

import struct
import zlib

import numpy as np
import pytest

from prismatic.sources import pictures as files

LIMITS = files.Limits(file_bytes=100_000, decoded_pixels=10_000)


def some(h, w, seed=0):
    rng = np.random.default_rng(seed)
    return (np.cumsum(rng.integers(-3, 4, (h, w, 3)), axis=1) % 256).astype(np.uint8)


@pytest.mark.parametrize(("h", "w"), [(1, 1), (3, 5), (40, 17), (2, 4)])
def test_round_trips(h, w):
    rgb = some(h, w, h)
    assert (files.from_png(files.to_png(rgb), LIMITS) == rgb).all()
    assert (files.from_bmp(files.to_bmp(rgb), LIMITS) == rgb).all()


def png(width, height, depth, color, lines, palette=b"", interlaced=0):
    part = lambda kind, content: struct.pack(">I", len(content)) + kind + content + struct.pack(">I", zlib.crc32(kind + content))
    packed = zlib.compress(lines)
    middle = part(b"PLTE", palette) if palette else b""
    return files.PNG + part(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, color, 0, 0, interlaced)) + middle + part(b"tEXt", b"a note") + part(b"IDAT", packed[:5]) + part(b"IDAT", packed[5:]) + part(b"IEND", b"")


def test_all_row_filters():
    """Rows as the format's rules make them from the bytes before, above and before that."""
    rgb = some(10, 6, 3)
    rows, lines = rgb.reshape(10, 18).astype(int), []
    for y in range(10):
        kind = y % 5
        line = [kind]
        for x in range(18):
            a, b = rows[y, x - 3] if x >= 3 else 0, rows[y - 1, x] if y else 0
            c = rows[y - 1, x - 3] if y and x >= 3 else 0
            p = a + b - c
            nearest = min((a, b, c), key=lambda v: (abs(p - v), (a, b, c).index(v)))
            guess = (0, a, b, (a + b) // 2, nearest)[kind]
            line.append((rows[y, x] - guess) % 256)
        lines += line
    assert (files.from_png(png(6, 10, 8, 2, bytes(np.array(lines, np.uint8))), LIMITS) == rgb).all()


def test_kinds_of_colour():
    gray = files.from_png(png(2, 1, 8, 0, bytes([0, 10, 200])), LIMITS)
    assert gray.tolist() == [[[10] * 3, [200] * 3]]
    assert files.from_png(png(2, 1, 16, 0, bytes([0, 10, 99, 200, 1])), LIMITS).tolist() == gray.tolist()
    assert files.from_png(png(2, 1, 8, 3, bytes([0, 1, 0]), palette=bytes([1, 2, 3, 4, 5, 6])), LIMITS).tolist() == [[[4, 5, 6], [1, 2, 3]]]
    assert files.from_png(png(2, 1, 8, 6, bytes([0, 10, 20, 30, 255, 10, 20, 30, 0])), LIMITS).tolist() == [[[10, 20, 30], [255, 255, 255]]]
    assert files.from_png(png(1, 1, 8, 4, bytes([0, 100, 51])), LIMITS).tolist() == [[[224] * 3]]


def test_whatever_is_wrong_is_one_row(spark):
    good = files.to_png(some(30, 70))
    flipped = bytearray(good)
    flipped[60] ^= 1
    bomb = png(90, 90, 8, 2, bytes(10))
    cases = {
        1: (good, None), 2: (b"", "INVALID_IMAGE"), 3: (None, "INVALID_IMAGE"), 4: (good[:-20], "INVALID_IMAGE"), 5: (bytes(flipped), "INVALID_IMAGE"), 6: (b"text", "INVALID_IMAGE"),
        7: (b"\xff\xd8\xff\xe0", "UNSUPPORTED_IMAGE"), 8: (bytes(100_001), "IMAGE_TOO_LARGE"), 9: (files.to_bmp(some(101, 100)), "IMAGE_TOO_LARGE"), 10: (files.to_bmp(some(5, 5))[:-1], "INVALID_IMAGE"),
        11: (bomb, "INVALID_IMAGE"), 12: (png(4, 4, 8, 2, bytes(52), interlaced=1), "UNSUPPORTED_IMAGE"), 13: (png(1, 1, 8, 2, bytes([9, 0, 0, 0])), "INVALID_IMAGE"), 14: (files.PNG, "INVALID_IMAGE"),
        15: (b"RIFF1234WEBPxxxx", "UNSUPPORTED_IMAGE"), 16: (png(2, 1, 8, 3, bytes([0, 9, 0]), palette=bytes(6)), "INVALID_IMAGE"), 17: (b"BM", "INVALID_IMAGE"),
    }
    frame = spark.createDataFrame([(k, bytearray(c) if c is not None else None) for k, (c, _) in cases.items()], "image_id long, content binary")
    found = {r["image_id"]: r for r in files.ingested(frame, LIMITS).collect()}
    assert {k: r["reject_code"] for k, r in found.items()} == {k: code for k, (_, code) in cases.items()}
    r = found[1]
    assert (r["content_type"], r["width"], r["height"], r["aspect_ratio"], r["working_width"]) == ("image/png", 70, 30, 2.3333, 70)
    small = files.from_png(bytes(r["thumbnail"]), LIMITS)
    assert small.shape == (27, 64, 3) and len(r["phash"]) == 64


def test_working_size_and_hash():
    assert files.working_size(5000, 1000, files.Limits()) == (4096, 819) and files.working_size(4000, 2000, files.Limits()) == (2828, 1414) and files.working_size(9, 9, files.Limits()) == (9, 9)
    half = np.zeros((32, 32, 3), np.uint8)
    half[:, 16:] = 200
    assert files.average_hash(half) == "00001111" * 8 and files.average_hash(half[:, 16:]) == "1" * 64

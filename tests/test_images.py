from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from fieldmill.sources.images import read_image_manifest, read_images, resize_images, shrink


def png(pixels: np.ndarray) -> bytes:
    """A PNG file of a height x width x 3 byte array."""

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    height, width, _ = pixels.shape
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    rows = b"".join(b"\0" + row.tobytes() for row in pixels)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_manifest_and_resize(spark, tmp_path):
    rng = np.random.default_rng(2)
    shapes = {"a.png": (40, 60), "b.png": (5, 7), "c.png": (80, 20)}
    originals = {}
    for name, (h, w) in shapes.items():
        originals[name] = rng.integers(0, 256, (h, w, 3), dtype=np.uint8)
        (tmp_path / name).write_bytes(png(originals[name]))
    (tmp_path / "broken.png").write_bytes(b"not an image")
    manifest = read_image_manifest(spark, str(tmp_path)).collect()
    found = {r.image_ref.split("/")[-1]: (r.height, r.width) for r in manifest}
    assert found == {**shapes, "broken.png": (None, None)}
    assert [r.bad_reason for r in manifest if r.width is None] == ["not an image"]

    small = {r.image_ref.split("/")[-1]: r for r in resize_images(read_images(spark, str(tmp_path)), 600).collect()}
    for name, (h, w) in shapes.items():
        scale = min(1.0, (600 / (w * h)) ** 0.5)
        want = (h, w) if w * h <= 600 else (max(1, int(h * scale)), max(1, int(w * scale)))
        r = small[name]
        assert (r.height, r.width) == want and len(r.pixels) == 3 * r.height * r.width
        got = np.frombuffer(r.pixels, dtype=np.uint8).reshape(r.height, r.width, 3)
        bgr = originals[name][:, :, ::-1]
        if want == (h, w):
            assert (got == bgr).all()
        else:
            for y in range(r.height):
                for x in range(r.width):
                    assert (got[y, x] == bgr[y * h // r.height, x * w // r.width]).all()


def test_flat_images_stay_flat_and_grey_gets_three_channels(spark):
    assert (shrink(np.full((50, 30, 3), 77, dtype=np.uint8), 7, 9) == 77).all()
    df = spark.createDataFrame([("g", 2, 2, 1, bytearray([1, 2, 3, 4]))], "image_ref string, width int, height int, channels int, pixels binary")
    row = resize_images(df, None).first()
    assert (row.channels, bytes(row.pixels)) == (3, bytes([1, 1, 1, 2, 2, 2, 3, 3, 3, 4, 4, 4]))
    alpha = df.withColumns({"channels": F.lit(4), "width": F.lit(1), "height": F.lit(1)})
    assert bytes(resize_images(alpha, None).first().pixels) == bytes([1, 2, 3])

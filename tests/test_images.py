"""Image files: pixels, first bytes and audited pairs."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterforest.operators import datasets
from rasterforest.sources import image_header, read_images

RGBA = np.random.default_rng(5).integers(0, 256, (4, 6, 4), dtype=np.uint8)


def png(image):
    """A PNG file's bytes, of 8 or 16 bits; the sides and one to four channels of the array."""
    h, w = image.shape[:2]
    channels = 1 if image.ndim == 2 else image.shape[2]
    lines = b"".join(b"\0" + row.astype(image.dtype.newbyteorder(">")).tobytes() for row in image)

    def chunk(name, data):
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    head = struct.pack(">IIBBBBB", w, h, 8 * image.dtype.itemsize, {1: 0, 2: 4, 3: 2, 4: 6}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def encoded(spark, image, kind):
    """Bytes of an image of three channels in another format, by the JVM's writers."""
    jvm = spark._jvm
    h, w = image.shape[:2]
    b = jvm.java.awt.image.BufferedImage(w, h, 1)
    for r in range(h):
        for c in range(w):
            b.setRGB(c, r, int(image[r, c, 0]) << 16 | int(image[r, c, 1]) << 8 | int(image[r, c, 2]))
    out = jvm.java.io.ByteArrayOutputStream()
    assert jvm.javax.imageio.ImageIO.write(b, kind, out)
    return bytes(out.toByteArray())


def write(folder, **files):
    folder.mkdir(parents=True, exist_ok=True)
    for name, data in files.items():
        stem, ext = name.rsplit("_", 1)
        (folder / f"{stem}.{ext}").write_bytes(data)


def as_array(df, shape):
    out = np.full(shape, -1)
    for r in df.collect():
        out[r["row"], r["col"], r["channel"]] = r["value"]
        assert r["pixel_id"] == r["row"] * shape[1] + r["col"]
    return out


@pytest.mark.parametrize("channels", [1, 3, 4])
def test_pixels_of_files(spark, tmp_path, channels):
    image = RGBA[..., 0] if channels == 1 else RGBA[..., :channels]
    write(tmp_path / "a", x_png=png(image), notes_txt=b"no image")
    colour = np.repeat(image[..., None], 3, 2) if channels == 1 else image[..., :3]
    assert (as_array(read_images(spark, str(tmp_path / "a"), gray=False), (4, 6, 3)) == colour).all()
    gray = as_array(read_images(spark, str(tmp_path / "a")), (4, 6, 1))[..., 0]
    assert (gray == np.floor(colour @ np.array([0.299, 0.587, 0.114]) + 0.5 + 1e-9)).all()


def test_a_file_that_is_no_image_fails(spark, tmp_path):
    write(tmp_path / "bad", x_png=b"not a picture")
    with pytest.raises(Exception, match="not an image"):
        read_images(spark, str(tmp_path / "bad")).collect()


def test_headers(spark):
    files = {
        "gray": (png(RGBA[..., 0]), (4, 6, 1, "uint8")),
        "deep": (png(RGBA[..., 0].astype(np.uint16) * 200), (4, 6, 1, "uint16")),
        "rgba": (png(RGBA), (4, 6, 4, "uint8")),
        "jpg": (encoded(spark, RGBA[..., :3], "jpg"), (4, 6, 3, "uint8")),
        "bmp": (encoded(spark, RGBA[..., :3], "bmp"), (4, 6, 3, "uint8")),
        "gif": (encoded(spark, RGBA[..., :3], "gif"), (4, 6, 3, "uint8")),
        "text": (b"no image", (None,) * 4),
        "cut": (png(RGBA)[:20], (None,) * 4),
        "empty": (b"", (None,) * 4),
        "null": (None, (None,) * 4),
    }
    df = spark.createDataFrame([(k, bytearray(v[0]) if v[0] is not None else None) for k, v in files.items()], "name string, content binary")
    got = df.select("name", image_header(F.col("content")).alias("h")).select("name", "h.*").collect()
    assert {r[0]: tuple(r)[1:] for r in got} == {k: v[1] for k, v in files.items()}


def test_audited_pairs(spark, tmp_path):
    write(tmp_path / "in", a_png=png(RGBA), b_png=png(RGBA[..., :3]))
    write(tmp_path / "out", a_png=png(RGBA[..., 0]), b_png=png(RGBA[:3, :, 0]), c_png=b"text")
    root = f"file:{tmp_path}"

    def pairs(*names):
        rows = [(a, f"{root}/in/{a}.png", f"{root}/out/{b}.png") for a, b in names]
        return spark.createDataFrame(rows, "sample_id string, input_path string, target_path string")

    got = {r["role"]: r for r in datasets.audit_pairs(spark, pairs(("a", "a")), root).collect()}
    assert (got["input"]["n_channels"], got["target"]["n_channels"], got["target"]["dtype"]) == (4, 1, "uint8")
    assert got["input"]["length"] == len(png(RGBA))
    more = datasets.audit_pairs(spark, pairs(("a", "a")), root, lambda d: d.withColumn("area", F.col("n_rows") * F.col("n_cols")))
    assert {r["area"] for r in more.collect()} == {24}
    for names, message in ((("b", "b"), "different shapes"), (("a", "c"), "no images"), (("a", "z"), "missing")):
        with pytest.raises(ValueError, match=message):
            datasets.audit_pairs(spark, pairs(names), root)
    with pytest.raises(ValueError, match="outside"):
        datasets.audit_pairs(spark, pairs(("a", "../../x")), root)
    with pytest.raises(ValueError, match="outside"):
        datasets.audit_pairs(spark, pairs(("a", "a")), f"{root}/in")

"""Media types, image sizes and names."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def sniff_mime(data: Column) -> Column:
    """By the first bytes; png if they tell nothing."""
    head = F.hex(F.substring(data, 1, 12))
    return (
        F.when(head.startswith("8950"), "image/png").when(head.startswith("FFD8"), "image/jpeg").when(head.startswith("4749"), "image/gif")
        .when(F.substring(head, 17, 4) == "5745", "image/webp").otherwise("image/png")
    )


def be(data: Column, at: int, width: int) -> Column:
    """A big-endian integer of `width` bytes at offset `at`."""
    return F.conv(F.hex(F.substring(data, at + 1, width)), 16, 10).cast("long")


def le(data: Column, at: int, width: int) -> Column:
    """A little-endian integer of `width` bytes at offset `at`; null beyond the end."""
    held = F.concat(*[F.hex(F.substring(data, at + i, 1)) for i in range(width, 0, -1)])
    return F.when(F.octet_length(data) >= at + width, F.conv(held, 16, 10).cast("long"))


def png_width(data: Column) -> Column:
    return F.coalesce(F.nullif(be(data, 16, 4), F.lit(0)), F.lit(100))


def png_height(data: Column) -> Column:
    return F.coalesce(F.nullif(be(data, 20, 4), F.lit(0)), F.lit(100))


def _jpeg(b: bytes | None) -> tuple[int, int]:
    i = 2
    while b and i + 9 <= len(b):
        if b[i] != 0xFF:
            i += 1
        elif b[i + 1] in (0xC0, 0xC2):
            h, w = int.from_bytes(b[i + 5 : i + 7], "big"), int.from_bytes(b[i + 7 : i + 9], "big")
            return (w or 100, h or 100)
        else:
            i += 2 + int.from_bytes(b[i + 2 : i + 4], "big")
    return 100, 100


def _jpeg_sizes(data: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_jpeg(b) for b in data], columns=["w", "h"])


def measured(data: bytes) -> tuple[str, int, int]:
    """sniff_mime(), and width and height as png_width(), png_height() or jpeg_size() tell them, of one image."""
    kinds = {b"\xff\xd8": "image/jpeg", b"GI": "image/gif"}
    mime = "image/png" if data[:2] == b"\x89P" else kinds.get(data[:2]) or ("image/webp" if data[8:10] == b"WE" else "image/png")
    if mime != "image/png":
        return mime, *_jpeg(data)
    return mime, int.from_bytes(data[16:20], "big") or 100, int.from_bytes(data[20:24], "big") or 100


def jpeg_size(data: Column) -> Column:
    """struct<w, h> of the first frame header; 100 where there is none."""
    return F.pandas_udf(_jpeg_sizes, "struct<w:int,h:int>")(data)


def image_source(path: Column) -> Column:
    return F.when(path.startswith("data:"), "data").when(path.rlike("^https?://"), "http").otherwise("path")


def image_ext(path: Column) -> Column:
    """Extension by data type or suffix: jpeg is jpg, unknown ones too."""
    ext = F.lower(F.when(path.startswith("data:"), F.regexp_extract(path, r"^data:image/(\w+)", 1)).otherwise(F.regexp_extract(path, r"\.(\w+)$", 1)))
    return F.when(ext.isin("png", "gif", "bmp"), ext).otherwise("jpg")


def data_bytes(path: Column) -> Column:
    """The bytes of a data URI, else null."""
    return F.when(path.startswith("data:"), F.unbase64(F.regexp_extract(path, r"base64,(.*)$", 1)))


def bin_name(n: Column, ext: Column) -> Column:
    return F.concat(F.lit("BIN"), F.lpad(n.cast("string"), 4, "0"), F.lit("."), ext)


def drawing_kind(has_blip: Column, has_text: Column, has_chart: Column) -> Column:
    return F.when(has_blip, "picture").when(has_text, "text").when(has_chart, "chart")


def content_type(ext: Column) -> Column:
    return F.concat(F.lit("image/"), F.when(ext == "jpg", "jpeg").otherwise(ext))


def placement(drawing: dict[str, Column]) -> list[Column]:
    """Of a drawing (anchored, wrap, behind, x, y, w, h; lengths in EMU): flow, x, y, w, h in HWPUNIT."""
    unit = lambda c: F.floor(c.cast("double") * 7200 / 914400 + 0.5).cast("long")
    flow = (
        F.when(~drawing["anchored"], "INLINE").when(drawing["behind"], "BEHIND_TEXT").when(drawing["wrap"] == "square", "SQUARE")
        .when(drawing["wrap"] == "topAndBottom", "TOP_AND_BOTTOM").otherwise("IN_FRONT_OF_TEXT")
    )
    size = [F.coalesce(unit(drawing[k]), F.lit(d)).alias(k) for k, d in (("w", 27577), ("h", 19913))]
    at = [F.when(drawing["anchored"], F.coalesce(unit(drawing[k]), F.lit(0))).otherwise(0).alias(k) for k in ("x", "y")]
    return [flow.alias("flow"), *at, *size]

"""Text, fonts and markers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Name parts of font classes (fixed values); those of fixed width in any case.
MONO = ("Courier New", "Consolas", "Lucida Console", "Monaco", "Menlo", "monospace", "Ubuntu Mono", "Source Code Pro", "Fira Code", "JetBrains Mono", "D2Coding", "NanumGothicCoding")
GOTHIC = ("고딕", "Gothic", "Sans", "Arial", "Helvetica", "Verdana", "Tahoma", "돋움")
MYEONGJO = ("바탕", "명조", "Batang", "Times", "Serif", "Georgia")


def escape_xml(x: Column, drop_control: bool = False) -> Column:
    if drop_control:
        x = F.regexp_replace(x, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        x = F.replace(x, F.lit(old), F.lit(new))
    return x


def is_korean(face: Column) -> Column:
    return face.rlike("[가-힣]")


def is_monospace(face: Column) -> Column:
    return F.lower(face).rlike("|".join(MONO).lower())


def font_family(face: Column) -> Column:
    """The class of a face in font tables; fixed width first, then gothic."""
    has = lambda names: face.rlike("|".join(names))
    return F.when(is_monospace(face), "FCAT_FIXED").when(has(GOTHIC), "FCAT_GOTHIC").when(has(MYEONGJO), "FCAT_MYEONGJO").otherwise("FCAT_UNKNOWN")


def apply_markers(text: Column, mark: Column) -> Column:
    """The marks around a text, inside its outer spaces; a blank text gets none."""
    lead, trail = F.regexp_extract(text, r"^(\s*)", 1), F.regexp_extract(text, r"(\s*)$", 1)
    return F.when(text.rlike(r"^\s*$"), text).otherwise(F.concat(lead, mark, F.regexp_replace(text, r"^\s+|\s+$", ""), mark, trail))


def css_color_int(x: Column) -> Column:
    """`#RRGGBB` as r | g << 8 | b << 16; 0 for anything else."""
    part = lambda i: F.conv(F.substring(x, i, 2), 16, 10).cast("int")
    return F.when(x.rlike("^#[0-9A-Fa-f]{6}$"), part(2) + F.shiftleft(part(4), 8) + F.shiftleft(part(6), 16)).otherwise(0)


def color_from_int(x: Column) -> Column:
    """The inverse: `#rrggbb`."""
    byte = lambda shift: F.lpad(F.lower(F.hex(F.shiftright(x, shift).bitwiseAND(F.lit(255)))), 2, "0")
    return F.concat(F.lit("#"), byte(0), byte(8), byte(16))


def css_border(style: Column, side: str) -> Column:
    """`border-<side>`, else `border`: width in mm (two decimals) and colour as `0.26 #0000ff`; null if there is none."""
    own = F.nullif(F.regexp_extract(style, rf"border-{side}:\s*([^;]+)", 1), F.lit(""))
    value = F.coalesce(own, F.nullif(F.regexp_extract(style, r"(?:^|;\s*)border:\s*([^;]+)", 1), F.lit("")))
    px = F.regexp_extract(value, r"([0-9.]+)px", 1)
    width = F.floor(px.try_cast("double") * 25.4 / 96 * 100 + 0.5) / 100
    off = value.isNull() | value.rlike("none") | (F.coalesce(px.try_cast("double"), F.lit(0.0)) == 0)
    return F.when(~off, F.concat(F.format_string("%.2f", width), F.lit(" "), F.coalesce(F.nullif(F.regexp_extract(value, r"(#[0-9A-Fa-f]{6})", 1), F.lit("")), F.lit("#000000"))))


def list_label_pattern(text: Column, level: Column) -> Column:
    """The level's own `%n` as `^N`, others gone; `^N.` if nothing is left."""
    own = F.replace(text, F.concat(F.lit("%"), (level + 1).cast("string")), F.lit("^N"))
    return F.coalesce(F.nullif(F.regexp_replace(own, r"%\d+", ""), F.lit("")), F.lit("^N."))

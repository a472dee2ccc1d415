"""Units, rounding and fixed maps as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: HWPUNIT in one of each unit (fixed values).
PER_UNIT = {"pt": 100.0, "mm": 283.465, "cm": 2834.65, "inch": 7200.0, "px": 75.0, "char": 500.0, "twip": 5.0}

# Fixed maps.
ALIGN = {"left": "LEFT", "start": "LEFT", "right": "RIGHT", "end": "RIGHT", "center": "CENTER", "both": "JUSTIFY", "distribute": "DISTRIBUTE"}
HIGHLIGHT = {
    "yellow": "#FFFF00", "green": "#00FF00", "cyan": "#00FFFF", "magenta": "#FF00FF", "blue": "#0000FF", "red": "#FF0000", "darkBlue": "#000080",
    "darkCyan": "#008080", "darkGreen": "#008000", "darkMagenta": "#800080", "darkRed": "#800000", "darkYellow": "#808000", "darkGray": "#808080",
    "lightGray": "#C0C0C0", "black": "#000000", "white": "#FFFFFF",
}
BORDER = {"single": "SOLID", "thick": "SOLID", "double": "DOUBLE_SLIM", "dotted": "DOT", "dashed": "DASH", "dotDash": "DASH_DOT", "dotDotDash": "DASH_DOT_DOT", "none": "NONE", "nil": "NONE"}


def js_round(x: Column) -> Column:
    """Rounds halves up, negative ones too."""
    return F.floor(x + 0.5).cast("long")


def to_hwpunit(x: Column, unit: str) -> Column:
    return js_round(x * PER_UNIT[unit])


def from_hwpunit(x: Column, unit: str) -> Column:
    return x / PER_UNIT[unit]


def pt_to_twip(x: Column) -> Column:
    return js_round(x * 20)


def px_to_emu(x: Column) -> Column:
    return js_round(x * 9525)


def half_points(x: Column) -> Column:
    return js_round(x * 2)


def mapped(x: Column, table: dict[str, str], default: str | None = None) -> Column:
    """The table's value for x, else the default, by one literal map."""
    pairs = F.create_map(*[F.lit(v) for pair in table.items() for v in pair])
    return F.coalesce(pairs[x], F.lit(default))


def line_spacing(line: Column, rule: Column) -> Column:
    """Percent of a line for `auto`, else HWPUNIT of the given twips."""
    return F.when(rule.isin("exact", "atLeast"), line * 5).otherwise(js_round(line / 240 * 100))


def line_spacing_back(percent: Column) -> Column:
    return js_round(percent * 240 / 100)


def fit_height(w: Column, h: Column, most: float) -> Column:
    """The height of an image that is shrunk to the width `most`, if it is wider."""
    return F.when(w > most, js_round(h * most / w)).otherwise(h)


def fit_width(w: Column, most: float) -> Column:
    return F.least(w, F.lit(most).cast("long"))

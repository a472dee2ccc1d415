"""Tables: HTML cells, grids, merges, sizes, borders."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doclake.sources.scratch import stored

TOTAL_WIDTH = 41954
#: Line widths in mm that a border can have (fixed values).
WIDTHS_MM = (0.1, 0.12, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 1.0, 1.5, 2.0, 3.0, 4.0, 5.0)
CELL = r"(?is)<(t[dh])([^>]*)>(.*?)</t[dh]>"


def html_table_cells(docs: DataFrame) -> DataFrame:
    """doc_id, row, nth, tag, text, colspan, rowspan, style of the cells of one table's html."""
    rows = docs.select("doc_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("row", "tr"))
    cells = rows.select("doc_id", "row", F.posexplode(F.regexp_extract_all("tr", F.lit(CELL), F.lit(0))).alias("nth", "cell"))
    attrs = F.regexp_extract("cell", CELL, 2)
    number = lambda name: F.coalesce(F.nullif(F.regexp_extract(attrs, rf'(?i){name}="?(\d+)', 1), F.lit("")).cast("int"), F.lit(1))
    return cells.select(
        "doc_id", "row", "nth", F.lower(F.regexp_extract("cell", CELL, 1)).alias("tag"), F.trim(F.regexp_extract("cell", CELL, 3)).alias("text"),
        number("colspan").alias("colspan"), number("rowspan").alias("rowspan"), F.regexp_extract(attrs, r'(?i)style="([^"]*)"', 1).alias("style"),
    )


#: Levels of nested tables that one pass takes out.
LEVELS = 4
INNER = r"(?is)<table(?:(?!<table|</table>).)*</table>"


def _innermost(rest: DataFrame, level: int) -> DataFrame:
    """Moves the tables of `rest` that hold no table to `found`."""
    here = F.regexp_extract_all("rest", F.lit(INNER), F.lit(0))
    named = F.transform(here, lambda h, i: F.struct(F.lit(level).alias("level"), i.cast("int").alias("nth"), h.alias("html")))
    gap = lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit(f"[[table:{level}:"), (i - 1).cast("string"), F.lit("]]"), p))
    left = F.array_join(F.transform(F.split("rest", INNER, -1), gap), "")
    found = F.coalesce("found", F.array().cast("array<struct<level:int,nth:int,html:string>>"))
    return rest.select("doc_id", left.alias("rest"), F.concat(found, named).alias("found"))


def extract_tables(docs: DataFrame) -> DataFrame:
    """doc_id, level, nth, html: innermost tables first; what holds them keeps `[[table:level:nth]]` in their place.

    LEVELS levels are one expression over the row, without a shuffle. Documents that still hold a table then (they are
    written, and are few) go on, until none does.
    """
    none = F.lit(None).cast("array<struct<level:int,nth:int,html:string>>")
    rest, first, out = docs.select("doc_id", F.col("html").alias("rest"), none.alias("found")), 0, []
    while True:
        for level in range(first, first + LEVELS):
            rest = _innermost(rest, level)
        rest, first = stored(rest), first + LEVELS
        out.append(rest.select("doc_id", F.explode("found").alias("t")).select("doc_id", "t.level", "t.nth", "t.html"))
        rest = rest.where(F.col("rest").rlike(INNER)).withColumn("found", none)
        if rest.isEmpty():
            return reduce(DataFrame.unionByName, out)


def _addresses(rows: pd.Series, wide: pd.Series, high: pd.Series) -> pd.Series:
    """The first column of each cell of each table: the next one that no cell of this row or above takes."""

    def one(cells):
        taken: set[tuple[int, int]] = set()
        out, row, col = [], None, 0
        for r, w, h in cells:
            col = col if r == row else 0
            row = r
            while (r, col) in taken:
                col += 1
            taken.update((r + i, col + j) for i in range(max(1, h)) for j in range(w))
            out.append(col)
            col += w
        return out

    return pd.Series([one(zip(r.tolist(), w.tolist(), h.tolist(), strict=True)) for r, w, h in zip(rows, wide, high, strict=True)])


def place_cells(cells: DataFrame, *keys: str) -> DataFrame:
    """Cells (keys, row, nth, colspan, rowspan, ...) with col_addr: each takes the next free column of its row.

    Sequential within a table: its cells become one row, in order, and the tables of a batch are walked one by one. A
    table is small, and tables are many.
    """
    others = [c for c in cells.columns if c not in (*keys, "row", "nth")]
    held = cells.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("row", "nth", *others))).alias("held"))
    field = lambda name: F.transform("held", lambda c: c[name].cast("int"))
    address = F.pandas_udf(_addresses, "array<int>")(field("row"), field("colspan"), field("rowspan"))
    each = held.withColumn("address", address).select(*keys, F.explode(F.arrays_zip("held", "address")).alias("x"))
    return each.select(*[F.col(c) if c in keys else F.col(f"x.held.{c}").alias(c) for c in cells.columns], F.col("x.address").alias("col_addr"))


def normalise_widths(first_row: DataFrame, *keys: str) -> DataFrame:
    """keys, col, width from the first row's px widths (null or 0: none): shares of TOTAL_WIDTH, else equal ones; the
    last column takes the rest. first_row: keys, col, px."""
    own, order = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("col")
    told = F.min(F.coalesce("px", F.lit(0))).over(own) > 0
    many = F.count("*").over(own)
    width = F.when(told, F.floor(F.col("px") / F.sum("px").over(own) * TOTAL_WIDTH)).otherwise(F.floor(TOTAL_WIDTH / many)).cast("int")
    rows = first_row.withColumn("w", width).withColumn("last", F.row_number().over(order) == many)
    return rows.select(*keys, "col", (F.col("w") + F.when(F.col("last"), TOTAL_WIDTH - F.sum("w").over(own)).otherwise(0)).cast("int").alias("width"))


def grid_columns(cells: DataFrame, *keys: str) -> DataFrame:
    """Cells (keys, r, c, span, ...) with col: the sum of the spans before it in the row."""
    before = Window.partitionBy(*keys, "r").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    return cells.withColumn("col", F.coalesce(F.sum("span").over(before), F.lit(0)))


def row_spans(grid: DataFrame, *keys: str) -> DataFrame:
    """keys, r, col, row_span, merged of cells (keys, r, col, span, vm): down each grid column a cell takes the
    `continue` cells right below it; an orphan of these is a cell of its own, and a missing cell ends a span."""
    every = grid.select(*keys, "r", F.col("col").alias("head"), "vm", F.explode(F.sequence(F.col("col"), F.col("col") + F.col("span") - 1)).alias("col"))
    every = every.withColumn("mark", F.when(F.col("col") == F.col("head"), F.col("vm")))
    down = Window.partitionBy(*keys, "col").orderBy("r")
    goes_on = (F.coalesce("mark", F.lit("")) == "continue") & F.coalesce(F.lag("r").over(down) == F.col("r") - 1, F.lit(False))
    rows = every.withColumn("goes_on", goes_on).withColumn("island", F.sum((~F.col("goes_on")).cast("int")).over(down))
    island = Window.partitionBy(*keys, "col", "island")
    # an orphan `continue` starts no span
    span = F.when(F.col("goes_on"), 0).when(F.coalesce("mark", F.lit("")) == "continue", 1).otherwise(F.count("*").over(island))
    orphan = F.max((~F.col("goes_on") & (F.coalesce("mark", F.lit("")) == "continue")).cast("int")).over(island) == 1
    span = F.when(orphan, 1).otherwise(span)
    return rows.withColumn("row_span", span).where("col = head").select(*keys, "r", "col", F.col("row_span").cast("int").alias("row_span"), (F.col("row_span") == 0).alias("merged"))


def materialise_merges(cells: DataFrame, *keys: str, by_column: bool = False) -> DataFrame:
    """keys, row, col, col_span of the blank cells below cells of a row span over 1: one a row, or one a column too."""
    tall = cells.where("row_span > 1").select(*keys, "row", "col", "col_span", F.explode(F.sequence(F.lit(1), F.col("row_span") - 1)).alias("down"))
    if not by_column:
        return tall.select(*keys, (F.col("row") + F.col("down")).alias("row"), "col", "col_span")
    wide = tall.select(*keys, "row", "down", "col", F.explode(F.sequence(F.lit(0), F.col("col_span") - 1)).alias("right"))
    return wide.select(*keys, (F.col("row") + F.col("down")).alias("row"), (F.col("col") + F.col("right")).alias("col"), F.lit(1).alias("col_span"))


def pad_grid(cells: DataFrame, *keys: str) -> DataFrame:
    """keys, row, col of the places of the grid that no cell (keys, row, col, col_span) covers."""
    covered = cells.select(*keys, "row", F.explode(F.sequence(F.col("col"), F.col("col") + F.col("col_span") - 1)).alias("col"))
    size = covered.groupBy(*keys).agg(F.max("col").alias("last_col"), F.max("row").alias("last_row"))
    every = size.select(*keys, F.explode(F.sequence(F.lit(0), F.col("last_row"))).alias("row"), "last_col").select(*keys, "row", F.explode(F.sequence(F.lit(0), F.col("last_col"))).alias("col"))
    return every.join(covered, [*keys, "row", "col"], "left_anti")


def cell_borders(cells: DataFrame) -> DataFrame:
    """Cells with left, right, top, bottom: the cell's own side, else the table's outer side at an edge, else inside.

    cells: row, col, row_span, col_span, rows, cols, own_<side>, table_<side>, inside_h, inside_v.
    """
    edge = {
        "left": F.col("col") == 0, "right": F.col("col") + F.col("col_span") >= F.col("cols"),
        "top": F.col("row") == 0, "bottom": F.col("row") + F.col("row_span") >= F.col("rows"),
    }
    inside = {"left": "inside_v", "right": "inside_v", "top": "inside_h", "bottom": "inside_h"}
    side = lambda s: F.coalesce(F.col(f"own_{s}"), F.when(at, F.col(f"table_{s}")).otherwise(F.col(inside[s])))
    for s, at in edge.items():
        cells = cells.withColumn(s, side(s))
    return cells


def nearest_width_mm(eighths: Column) -> Column:
    """The preset nearest to a width in eighths of a point; the first of equally near ones, 5 for more."""
    mm = eighths / 8 * 0.3528
    presets = F.array(*[F.lit(w) for w in WIDTHS_MM])
    return F.when(mm > 5, 5.0).otherwise(F.array_min(F.transform(presets, lambda p, i: F.struct(F.abs(p - mm).alias("d"), i.alias("i"), p.alias("p"))))["p"])


def cell_widths(cells: DataFrame, widths: DataFrame, *keys: str) -> DataFrame:
    """keys, row, col, width: the sum of the columns that a cell spans. widths: keys, w_col, w."""
    spread = cells.select(*keys, "row", "col", F.explode(F.sequence(F.col("col"), F.col("col") + F.col("col_span") - 1)).alias("w_col"))
    return spread.join(widths, [*keys, "w_col"]).groupBy(*keys, "row", "col").agg(F.sum("w").alias("width"))


def _widths(columns: pd.Series, spans: pd.Series, widths: pd.Series) -> pd.Series:
    """The width of each column of each table."""

    def one(cells):
        many = max(c + span for c, span, _ in cells)
        known: dict[int, int] = {}
        for c, span, w in cells:
            if span == 1 and w and w > 0:
                known.setdefault(c, int(w))
        for c, span, w in cells:
            open_ = [i for i in range(c, c + span) if i not in known]
            rest = int(w or 0) - sum(known.get(i, 0) for i in range(c, c + span))
            if span > 1 and open_ and rest > 0:
                known.update({i: rest // len(open_) for i in open_})
        even = round(9000 / many)
        return [known.get(i, even) for i in range(many)]

    return pd.Series([one(list(zip(c.tolist(), s.tolist(), w.tolist(), strict=True))) for c, s, w in zip(columns, spans, widths, strict=True)])


def column_widths(cells: DataFrame, *keys: str) -> DataFrame:
    """keys, col, width: of each column the first width of a cell of span 1; then wider cells, in order, share what
    is left of theirs among their columns without a width; columns that none tells share the average.

    cells: keys, row, col, col_span, width; no width counts as 0. The second pass depends on order, so a table is one row.
    """
    held = cells.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("row", "col", "col_span", "width"))).alias("held"))
    field = lambda name: F.transform("held", lambda c: F.coalesce(c[name].cast("int"), F.lit(0)))
    widths = F.pandas_udf(_widths, "array<int>")(field("col"), field("col_span"), field("width"))
    return held.withColumn("widths", widths).select(*keys, F.posexplode("widths").alias("col", "width"))


def row_heights(cells: DataFrame, *keys: str) -> DataFrame:
    """keys, r, height: the largest of cells over one row, else the first cell's by its rows; null if none has one."""
    one = F.max(F.when(F.col("row_span") == 1, F.col("height")))
    first = F.min_by(F.floor(F.col("height") / F.col("row_span")), F.when(F.col("height").isNotNull(), F.col("col")))
    return cells.groupBy(*keys, "r").agg(F.coalesce(one, first).cast("long").alias("height"))


def table_heights(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum(F.coalesce("height", F.lit(1500))).cast("long").alias("height"))

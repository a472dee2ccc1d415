"""Styles: inheritance, headings, defaults, and what runs and paragraphs end up with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doclake.sources.scratch import stored



def style_chains(styles: DataFrame) -> DataFrame:
    """doc_id, style_id, anc (an ancestor or itself), depth, along whole chains; a cycle ends where it closes.

    styles: doc_id, style_id, based_on. An unknown parent ends a chain. Pointers double: a round joins every style's
    ancestor 2^k above with what that one reaches, so the longest chain of length n takes log2(n) rounds. Each round
    is written, and ends all when no style has an ancestor so far above that it has not met before.
    """
    keys = ["doc_id", "style_id"]
    known = styles.select("doc_id", F.col("style_id").alias("anc"))
    reach = stored(styles.select(*keys, F.col("style_id").alias("anc"), F.lit(0).cast("long").alias("depth")))
    hop = styles.where("based_on IS NOT NULL AND based_on <> style_id").select(*keys, F.col("based_on").alias("anc"))
    hop, step = stored(hop.join(known, ["doc_id", "anc"], "left_semi").select(*keys, "anc").distinct()), 1
    while not hop.isEmpty():  # reach covers depths below `step`, hop is the jump of `step`
        above = reach.select("doc_id", F.col("style_id").alias("anc"), F.col("anc").alias("far"), F.col("depth").alias("more"))
        jumped = hop.join(above, ["doc_id", "anc"]).select(*keys, F.col("far").alias("anc"), (F.col("more") + step).alias("depth"))
        jumped = stored(jumped.join(reach, [*keys, "anc"], "left_anti"))
        reach = reach.unionByName(jumped)
        twice = hop.join(hop.select("doc_id", F.col("style_id").alias("anc"), F.col("anc").alias("far")), ["doc_id", "anc"])
        hop = stored(twice.select(*keys, F.col("far").alias("anc")).join(reach, [*keys, "anc"], "left_anti"))
        step *= 2
    return reach


def style_inherit(styles: DataFrame, single: list[str], blocks: dict[str, list[str]]) -> DataFrame:
    """doc_id, style_id and every attribute's value from the nearest style that has one. A block of attributes comes
    whole from the first style that has any of it."""
    told = styles.drop("based_on").withColumnRenamed("style_id", "anc")
    rows = style_chains(styles).join(told, ["doc_id", "anc"])
    nearest = [F.min_by(a, F.when(F.col(a).isNotNull(), F.col("depth"))).alias(a) for a in single]
    for name, parts in blocks.items():
        has = F.coalesce(*[F.col(p).cast("string") for p in parts]).isNotNull()
        nearest.append(F.min_by(F.struct(*parts), F.when(has, F.col("depth"))).alias(name))
    return rows.groupBy("doc_id", "style_id").agg(*nearest)


def style_heading(styles: DataFrame) -> DataFrame:
    """doc_id, para_shape, level: by the style's name (`heading N`, `제목 N`) or its shape's own level, 6 at most; of
    several styles of one shape the last."""
    named = F.regexp_extract(F.lower("name"), r"^(?:heading|제목)\s*(\d)", 1).try_cast("int")
    told = F.coalesce(named, F.col("own_level"))
    level = F.when(told.isNotNull(), F.least(told, F.lit(6)))  # least() alone would pass over a null
    return styles.withColumn("level", level).where("level > 0").groupBy("doc_id", "para_shape").agg(F.max_by("level", "ord").alias("level"))


def alignment(direct: Column, style: Column) -> Column:
    """Direct, else the style's, else left; all ways of filling lines are justify."""
    own = F.coalesce(direct, style, F.lit("left"))
    return F.when(own.isin("both", "distribute", "justify"), "justify").when(own.isin("start", "left"), "left").when(own.isin("end", "right"), "right").otherwise(own)


def resolved_shapes(rows: DataFrame, shapes: DataFrame, key: str) -> DataFrame:
    """Rows with the attributes of their shape; a missing id leaves them null. The join is by document and id."""
    return rows.join(shapes, ["doc_id", key], "left")


#: Colours of highlights by name, fixed values.
HIGHLIGHTS = {
    "black": "000000", "blue": "0000FF", "cyan": "00FFFF", "green": "008000", "magenta": "FF00FF", "red": "FF0000", "yellow": "FFFF00", "white": "FFFFFF", "darkBlue": "00008B", "darkCyan": "008B8B",
    "darkGreen": "006400", "darkMagenta": "8B008B", "darkRed": "8B0000", "darkYellow": "808000", "darkGray": "A9A9A9", "lightGray": "D3D3D3",
}
#: Ids of border fills that all documents have: none, boxed text, black (fixed values).
NO_FILL, BOX_FILL, BLACK_FILL = "1", "5", "6"
#: HWPUNIT of a twip, and of half a point in the unit of text sizes.
TWIP, HALF_POINT = 5, 50


def _line(value: Column, rule: Column, of_type: bool) -> Column:
    """Kind or value of a line spacing: a share of 240 by rule auto, else a length."""
    auto = rule.isNull() | (rule == "auto")
    if of_type:
        return F.when(value.isNull() | auto, "PERCENT").when(rule == "exact", "FIXED").when(rule == "atLeast", "ATLEAST").otherwise("PERCENT")
    return F.when(value.isNull() | ~(auto | rule.isin("exact", "atLeast")), 115).when(auto, F.floor(value / 240 * 100 + 0.5)).otherwise(value * TWIP).cast("int")


def _of(inherited: DataFrame) -> str:
    return "sheet" if "sheet" in inherited.columns else "doc_id"


def resolved_paragraphs(paragraphs: DataFrame, inherited: DataFrame) -> DataFrame:
    """Paragraphs (doc_id, para, style_id, direct properties in twips, last) with what they end up with, in HWPUNIT.

    Indents and spacings are blocks: a paragraph that has any of one takes all of it, else the nearest style that has.
    A direct `after` becomes 0, and so does that of a document's last block. inherited: align, ind and spacing, by doc_id
    or by the sheet that paragraphs name.
    """
    own = lambda *names: F.coalesce(*[F.col(n).cast("string") for n in names]).isNotNull()
    of = _of(inherited)
    rows = paragraphs.join(inherited.select(of, "style_id", F.col("align").alias("s_align"), "ind", "spacing"), [of, "style_id"], "left")
    rows = rows.withColumns({"has_ind": own("ind_left", "ind_right", "first_line", "hanging"), "has_spacing": own("before", "after", "line")})
    ind = {c: F.when(F.col("has_ind"), F.col(c)).otherwise(F.col(f"ind.{c}")) for c in ("ind_left", "ind_right", "first_line", "hanging")}
    space = {c: F.when(F.col("has_spacing"), F.col(c)).otherwise(F.col(f"spacing.{c}")) for c in ("before", "after", "line", "line_rule")}
    zero = lambda c: F.coalesce(c * TWIP, F.lit(0)).cast("int")
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return rows.select(
        "doc_id", "para", alignment(F.col("align"), F.col("s_align")).alias("align"), zero(ind["ind_left"]).alias("left"), zero(ind["ind_right"]).alias("right"),
        F.coalesce(-ind["hanging"] * TWIP, ind["first_line"] * TWIP, F.lit(0)).cast("int").alias("indent"), zero(space["before"]).alias("before"),
        F.when(F.col("last") | F.col("has_spacing"), 0).otherwise(zero(space["after"])).alias("after"),
        _line(space["line"], space["line_rule"], True).alias("line_type"), _line(space["line"], space["line_rule"], False).alias("line_value"),
        F.coalesce("outline", F.lit(0)).alias("level"), flag("keep_next"), flag("keep_lines"), flag("break_before"),
    )


def resolved_runs(runs: DataFrame, inherited: DataFrame) -> DataFrame:
    """Runs (doc_id, para, pos, style_id of the paragraph, direct properties, link) with what they end up with.

    size in hundredths of a point, colours as rrggbb. Highlight and shade give the fill's colour, black shade turns black
    text white, boxed text has a fill of its own. A colour that is still black comes from the style, but not of links.
    """
    names = F.create_map(*[F.lit(x) for pair in HIGHLIGHTS.items() for x in pair])
    of = _of(inherited)
    rows = runs.join(inherited.select(of, "style_id", F.col("sz").alias("s_size"), F.nullif("color", F.lit("auto")).alias("s_color")), [of, "style_id"], "left")
    link, black = F.coalesce("link", F.lit(False)), F.coalesce(F.col("shade").isin("000000", "black"), F.lit(False))
    color = F.coalesce("color", F.when(link, "0000FF").otherwise("000000"))
    color = F.when(black & (color == "000000"), "FFFFFF").otherwise(color)
    color = F.when((color == "000000") & ~link, F.coalesce("s_color", F.lit("000000"))).otherwise(color)
    shade = F.coalesce(F.when(~black, F.col("shade")), F.try_element_at(names, F.col("highlight")), F.lit("none"))
    fill = F.when(F.coalesce("boxed", F.lit(False)), BOX_FILL).when(black, BLACK_FILL).when(shade != "none", shade).otherwise(NO_FILL)
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return rows.select(
        "doc_id", "para", "pos", "text", *[flag(c) for c in ("bold", "italic", "strike", "sup", "sub")], (F.coalesce("underline", F.lit(False)) | link).alias("underline"),
        F.coalesce((F.col("size_pt") * 2 * HALF_POINT).cast("int"), F.col("s_size") * HALF_POINT, F.lit(1000)).alias("size"), color.alias("color"), shade.alias("shade"), fill.alias("fill"), "font",
    )


def border_fill_lookup(rows: DataFrame, fills: DataFrame, by_position: bool = False) -> DataFrame:
    """Rows (doc_id, ..., fill) with left, right, top, bottom and face of the border fill that they name: by its id, or by
    its place from 1 in the order of ids. A fill that isn't there, and place 0, leave them null; white is no face."""
    key = F.row_number().over(Window.partitionBy("doc_id").orderBy("id")) if by_position else F.col("id")
    known = fills.select("doc_id", key.alias("fill"), "left", "right", "top", "bottom", F.nullif(F.upper("face"), F.lit("FFFFFF")).alias("face"))
    return rows.join(known, ["doc_id", "fill"], "left")


def effective_runs(runs: DataFrame, inherited: DataFrame) -> DataFrame:
    """Runs (doc_id, ..., style_id, size, color, link, shade, boxed) with size, color, underline and fill.

    Direct values first, then the style's, then 10 pt and black; links are underlined and blue unless they say
    otherwise; black shading turns black text white; boxed text has fill 5.
    """
    style = inherited.select("doc_id", "style_id", F.col("sz").alias("s_size"), F.col("color").alias("s_color"))
    rows = runs.join(style, ["doc_id", "style_id"], "left")
    color = F.coalesce("color", F.when(F.col("link"), "0000FF"), "s_color", F.lit("000000"))
    shown = F.when((F.col("shade") == "000000") & (color == "000000"), "FFFFFF").otherwise(color)
    fill = F.when(F.col("boxed"), "5").otherwise(F.col("shade"))
    return rows.withColumns({"size": F.coalesce("size", "s_size", F.lit(10)), "shown": shown, "underline": F.coalesce("underline", F.col("link")), "fill": fill}).drop("s_size", "s_color", "color")


def effective_paragraphs(paragraphs: DataFrame, inherited: DataFrame) -> DataFrame:
    """Paragraphs (doc_id, blk, style_id, align, ind_left, before, after, last) with what they end up with; a direct
    `after` becomes 0, and so does that of a document's last block."""
    style = inherited.select("doc_id", "style_id", F.col("align").alias("s_align"), F.col("ind.ind_left").alias("s_left"))
    rows = paragraphs.join(style, ["doc_id", "style_id"], "left")
    after = F.when(F.col("last") | F.col("after").isNotNull(), 0)
    return rows.select("doc_id", "blk", alignment(F.col("align"), F.col("s_align")).alias("align"), F.coalesce("ind_left", "s_left", F.lit(0)).alias("ind_left"), F.coalesce("before", F.lit(0)).alias("before"), F.coalesce(after, F.lit(160)).alias("after"))


def paragraph_font_size(runs: DataFrame) -> DataFrame:
    """doc_id, blk, size: the first run's, else the paragraph's own, else its style's, else 10."""
    first = F.min_by("size", F.when(F.col("size").isNotNull(), F.col("pos")))
    return runs.groupBy("doc_id", "blk").agg(F.coalesce(first, F.first("para_size", True), F.first("style_size", True), F.lit(10)).alias("size"))

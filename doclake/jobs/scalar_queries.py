"""Queries of the scalar functions, over columns of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from doclake.functions import media, text, units
from doclake.jobs.fixtures import built, duck, media_docs
from doclake.operators import markdown


def units_query(spark, sf_dir):
    x = (F.col("p_size") - 25) / 4
    rows = built(spark, sf_dir, "SELECT p_partkey, p_size FROM {part}")
    return rows.select("p_partkey", *[units.to_hwpunit(x, u).alias(u) for u in units.PER_UNIT], units.pt_to_twip(x).alias("twips"), units.px_to_emu(x).alias("emu"), units.half_points(x).alias("halves"))


def spacing_query(spark, sf_dir):
    rows = built(spark, sf_dir, "SELECT p_partkey, p_size * 7 AS line, CASE p_partkey % 3 WHEN 0 THEN 'auto' WHEN 1 THEN 'exact' ELSE 'atLeast' END AS rule FROM {part}")
    return rows.select("p_partkey", units.line_spacing(F.col("line"), F.col("rule")).alias("spacing"), units.line_spacing_back(F.col("line")).alias("back"))


def fit_query(spark, sf_dir):
    rows = built(spark, sf_dir, "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) * 40 AS w, CAST(l_quantity AS BIGINT) * 7 AS h FROM {lineitem}")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", units.fit_width(F.col("w"), 600).alias("w"), units.fit_height(F.col("w"), F.col("h"), 600).alias("h"))


def escape_query(spark, sf_dir):
    rows = built(spark, sf_dir, """SELECT doc_id, concat(text, '<a b="c">&''', chr(7)) AS text FROM {documents}""")
    return rows.select("doc_id", F.md5(text.escape_xml(F.col("text"), True)).alias("digest"), F.length(text.escape_xml(F.col("text"))).alias("n"))


FACES = (
    "맑은 고딕", "Courier New", "Times New Roman", "함초롬바탕", "Arial", "Consolas", "lucida console", "Monaco", "Menlo", "DejaVu monospace", "Ubuntu Mono", "Source Code Pro", "Fira Code", "JetBrains Mono", "D2Coding",
    "NanumGothicCoding", "Nanum Gothic", "Noto Sans", "Helvetica", "Verdana", "Tahoma", "돋움체", "나눔명조", "Batang", "Noto Serif", "Georgia", "Comic", "arial", "monoline",
)


def fonts_query(spark, sf_dir):
    names = ", ".join(f"'{f}'" for f in FACES)
    rows = built(spark, sf_dir, f"SELECT p_partkey, element_at(array({names}), CAST(1 + p_partkey % {len(FACES)} AS INT)) AS face FROM {{part}}")
    face = F.col("face")
    return rows.select("p_partkey", text.font_family(face).alias("family"), text.is_monospace(face).alias("mono"), text.is_korean(face).alias("korean"))


def maps_query(spark, sf_dir):
    rows = built(spark, sf_dir, "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'both' WHEN 1 THEN 'start' WHEN 2 THEN 'x' ELSE 'center' END AS a, CASE p_partkey % 3 WHEN 0 THEN 'thick' WHEN 1 THEN 'dotDash' ELSE '?' END AS b, CASE p_partkey % 2 WHEN 0 THEN 'darkRed' ELSE 'cyan' END AS h FROM {part}")
    return rows.select("p_partkey", units.mapped(F.col("a"), units.ALIGN, "LEFT").alias("align"), units.mapped(F.col("b"), units.BORDER, "SOLID").alias("border"), units.mapped(F.col("h"), units.HIGHLIGHT).alias("color"))


def markers_query(spark, sf_dir):
    rows = built(spark, sf_dir, "SELECT p_partkey, concat(repeat(' ', p_size % 3), CASE WHEN p_size % 7 > 0 THEN p_type ELSE '' END, repeat(' ', p_size % 2)) AS t, CASE WHEN p_size % 2 = 0 THEN '**' ELSE '~~' END AS mark FROM {part}")
    return rows.select("p_partkey", text.apply_markers(F.col("t"), F.col("mark")).alias("t"))


COLORS = "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'red' ELSE concat('#', lpad(lower(hex(p_partkey * 977 % 16777216)), 6, '0')) END AS c FROM {part}"


def colors_query(spark, sf_dir):
    rows = built(spark, sf_dir, COLORS).select("p_partkey", text.css_color_int(F.col("c")).alias("v"))
    return rows.select("p_partkey", "v", text.color_from_int(F.col("v")).alias("back"))


BORDERS = "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN concat('border:', p_size, 'px solid #0000ff') WHEN 1 THEN concat('border-left:none;border:', p_size % 9, 'px solid #00ff00') WHEN 2 THEN 'color:red' ELSE concat('color:red;border-left: ', p_size, 'px dotted') END AS style FROM {part}"


def borders_query(spark, sf_dir):
    return built(spark, sf_dir, BORDERS).select("p_partkey", text.css_border(F.col("style"), "left").alias("l"), text.css_border(F.col("style"), "top").alias("t"))


def sources_query(spark, sf_dir):
    rows, p = markdown.images(built(spark, sf_dir, media_docs)), F.col("path")
    return rows.select("doc_id", "nth", media.image_source(p).alias("source"), media.image_ext(p).alias("ext"), F.hex(media.data_bytes(p)).alias("bytes"), media.bin_name(F.col("nth") + 1, media.image_ext(p)).alias("name"))


MAGIC = """CASE p_partkey % 5 WHEN 0 THEN '89504E470D0A1A0A0000000D49484452' WHEN 1 THEN 'FFD8FFE0' WHEN 2 THEN '474946383961' WHEN 3 THEN '524946460000000057454250' ELSE '00' END"""


def mime_query(spark, sf_dir):
    rows = built(spark, sf_dir, f"SELECT p_partkey, unhex(concat({MAGIC}, lpad(hex(p_size), 8, '0'), lpad(hex(p_size * 3), 8, '0'))) AS b FROM {{part}}")
    png = F.col("mime") == "image/png"
    return rows.select("p_partkey", media.sniff_mime(F.col("b")).alias("mime"), "b").select(
        "p_partkey", "mime", F.when(png & (F.octet_length("b") > 20), media.png_width(F.col("b"))).alias("w"), F.when(png & (F.octet_length("b") > 20), media.png_height(F.col("b"))).alias("h")
    )


def drawing_query(spark, sf_dir):
    rows = built(spark, sf_dir, """SELECT p_partkey, p_size % 2 = 0 AS anchored, CASE p_size % 3 WHEN 0 THEN 'square' WHEN 1 THEN 'topAndBottom' ELSE 'none' END AS wrap, p_size % 5 = 0 AS behind,
      p_size * 1000 AS x, p_partkey * 10 AS y, CASE WHEN p_size % 7 > 0 THEN p_size * 12700 END AS w, CASE WHEN p_size % 11 > 0 THEN p_size * 9525 END AS h FROM {part}""")
    kind = media.drawing_kind(F.col("p_partkey") % 4 == 0, F.col("p_partkey") % 4 == 1, F.col("p_partkey") % 4 == 2)
    return rows.select("p_partkey", kind.alias("kind"), *media.placement({c: F.col(c) for c in rows.columns[1:]}))


def label_pattern_query(spark, sf_dir):
    rows = built(spark, sf_dir, "SELECT p_partkey, p_size % 3 AS lvl, CASE p_size % 4 WHEN 0 THEN '%1.' WHEN 1 THEN '%1-%2)' WHEN 2 THEN '(%3)' ELSE '' END AS t FROM {part}")
    return rows.select("p_partkey", text.list_label_pattern(F.col("t"), F.col("lvl")).alias("pattern"))


X = "((p_size - 25) / 4.0)"
QUERIES = {
    "fn_units": (units_query, "SELECT p_partkey, " + ", ".join(f"CAST(floor({X} * {v} + 0.5) AS BIGINT) AS {k}" for k, v in units.PER_UNIT.items())
        + f", CAST(floor({X} * 20 + 0.5) AS BIGINT) AS twips, CAST(floor({X} * 9525 + 0.5) AS BIGINT) AS emu, CAST(floor({X} * 2 + 0.5) AS BIGINT) AS halves FROM part"),
    "fn_line_spacing": (spacing_query, "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN CAST(floor(p_size * 7 / 240.0 * 100 + 0.5) AS BIGINT) ELSE p_size * 35 END AS spacing, CAST(floor(p_size * 7 * 240 / 100.0 + 0.5) AS BIGINT) AS back FROM part"),
    "fn_fit_image": (fit_query, "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, least(CAST(l_quantity AS BIGINT) * 40, 600) AS w, CASE WHEN l_quantity * 40 > 600 THEN CAST(floor(CAST(l_quantity AS BIGINT) * 7 * 600.0 / (CAST(l_quantity AS BIGINT) * 40) + 0.5) AS BIGINT) ELSE CAST(l_quantity AS BIGINT) * 7 END AS h FROM lineitem"),
    "fn_escape_xml": (escape_query, """SELECT doc_id, md5(replace(e, chr(7), '')) AS digest, length(e) AS n FROM (SELECT doc_id,
        replace(replace(replace(replace(replace(concat(text, '<a b="c">&''', chr(7)), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') AS e FROM documents WHERE text IS NOT NULL) q
        UNION ALL SELECT doc_id, md5('&lt;a b=&quot;c&quot;&gt;&amp;&apos;'), 40 FROM documents WHERE false"""),
    "fn_fonts": (fonts_query, """SELECT p_partkey, CASE WHEN i IN (1, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15) THEN 'FCAT_FIXED' WHEN i IN (0, 4, 16, 17, 18, 19, 20, 21) THEN 'FCAT_GOTHIC' WHEN i IN (2, 3, 22, 23, 24, 25) THEN 'FCAT_MYEONGJO' ELSE 'FCAT_UNKNOWN' END AS family,
  i IN (1, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15) AS mono, i IN (0, 3, 21, 22) AS korean FROM (SELECT p_partkey, p_partkey % 29 AS i FROM part) z"""),
    "fn_maps": (maps_query, "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'JUSTIFY' WHEN 3 THEN 'CENTER' ELSE 'LEFT' END AS align, CASE p_partkey % 3 WHEN 1 THEN 'DASH_DOT' ELSE 'SOLID' END AS border, CASE p_partkey % 2 WHEN 0 THEN '#800000' ELSE '#00FFFF' END AS color FROM part"),
    "fn_markers": (markers_query, "SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN repeat(' ', CAST(p_size % 3 + p_size % 2 AS INT)) ELSE concat(repeat(' ', CAST(p_size % 3 AS INT)), m, p_type, m, repeat(' ', CAST(p_size % 2 AS INT))) END AS t FROM (SELECT *, CASE WHEN p_size % 2 = 0 THEN '**' ELSE '~~' END AS m FROM part) q"),
    "fn_colors": (colors_query, """SELECT p_partkey, v, concat('#', lpad(lower(hex(v % 256)), 2, '0'), lpad(lower(hex(v // 256 % 256)), 2, '0'), lpad(lower(hex(v // 65536)), 2, '0')) AS back FROM (
        SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 0 ELSE x // 65536 + x // 256 % 256 * 256 + x % 256 * 65536 END AS v FROM (SELECT *, p_partkey * 977 % 16777216 AS x FROM part) q) q2"""),
    "fn_css_borders": (borders_query, """WITH p AS (SELECT *, printf('%.2f', floor(CAST(p_size AS DOUBLE) * CAST(25.4 AS DOUBLE) / 96 * 100 + 0.5) / 100) AS w, printf('%.2f', floor(CAST(p_size % 9 AS DOUBLE) * CAST(25.4 AS DOUBLE) / 96 * 100 + 0.5) / 100) AS w9 FROM part)
        SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN concat(w, ' #0000ff') WHEN p_partkey % 4 = 3 THEN concat(w, ' #000000') END AS l,
        CASE WHEN p_partkey % 4 = 0 THEN concat(w, ' #0000ff') WHEN p_partkey % 4 = 1 AND p_size % 9 > 0 THEN concat(w9, ' #00ff00') END AS t FROM p"""),
    "fn_image_sources": (sources_query, """SELECT p_partkey AS doc_id, 0 AS nth, 'path' AS source, CASE WHEN p_size % 3 = 1 THEN 'png' ELSE 'jpg' END AS ext, NULL AS bytes, concat('BIN0001.', CASE WHEN p_size % 3 = 1 THEN 'png' ELSE 'jpg' END) AS name FROM part
        UNION ALL SELECT p_partkey, 1, 'data', 'gif', '474946', 'BIN0002.gif' FROM part"""),
    "fn_sniff_mime": (mime_query, "SELECT p_partkey, CASE p_partkey % 5 WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'image/gif' WHEN 3 THEN 'image/webp' ELSE 'image/png' END AS mime, CASE WHEN p_partkey % 5 = 0 THEN p_size END AS w, CASE WHEN p_partkey % 5 = 0 THEN p_size * 3 END AS h FROM part"),
    "fn_drawings": (drawing_query, """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'picture' WHEN 1 THEN 'text' WHEN 2 THEN 'chart' END AS kind,
        CASE WHEN p_size % 2 = 1 THEN 'INLINE' WHEN p_size % 5 = 0 THEN 'BEHIND_TEXT' WHEN p_size % 3 = 0 THEN 'SQUARE' WHEN p_size % 3 = 1 THEN 'TOP_AND_BOTTOM' ELSE 'IN_FRONT_OF_TEXT' END AS flow,
        CASE WHEN p_size % 2 = 0 THEN CAST(floor(p_size * 1000 * 7200 / 914400.0 + 0.5) AS BIGINT) ELSE 0 END AS x, CASE WHEN p_size % 2 = 0 THEN CAST(floor(p_partkey * 10 * 7200 / 914400.0 + 0.5) AS BIGINT) ELSE 0 END AS y,
        CASE WHEN p_size % 7 > 0 THEN CAST(floor(p_size * 12700.0 * 7200 / 914400 + 0.5) AS BIGINT) ELSE 27577 END AS w, CASE WHEN p_size % 11 > 0 THEN CAST(floor(p_size * 9525.0 * 7200 / 914400 + 0.5) AS BIGINT) ELSE 19913 END AS h FROM part"""),
    "fn_label_pattern": (label_pattern_query, """SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN CASE p_size % 3 WHEN 0 THEN '^N.' ELSE '.' END WHEN 1 THEN CASE p_size % 3 WHEN 0 THEN '^N-)' WHEN 1 THEN '-^N)' ELSE '-)' END
        WHEN 2 THEN CASE p_size % 3 WHEN 2 THEN '(^N)' ELSE '()' END ELSE '^N.' END AS pattern FROM part"""),
}

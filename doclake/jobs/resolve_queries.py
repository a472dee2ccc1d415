"""Queries of styles, registries, references and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from doclake.jobs.fixtures import ORDER, built, duck, styles
from doclake.jobs.markdown_queries import KNOWN, blocks
from doclake.operators import quality, refs, registry
from doclake.operators import styles as st

NUMBERED = f"SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY {ORDER}) AS ord, * FROM {{lineitem}}"


def rows(spark, sf_dir, columns: str, table: str = NUMBERED, more: str = ""):
    """Columns over the numbered items of each order."""
    return built(spark, sf_dir, f"SELECT {columns} FROM ({table}) q {more}")


def sql(columns: str, more: str = "") -> str:
    return f"(SELECT {columns} FROM ({NUMBERED.replace('{lineitem}', 'lineitem')}) q {more})"


def style_inherit(spark, sf_dir):
    got = st.style_inherit(built(spark, sf_dir, styles), ["sz", "align"], {"ind": ["ind_left", "ind_right"]})
    return got.select("doc_id", "style_id", "sz", "align", "ind.ind_left", "ind.ind_right")


INHERIT_SQL = f"""
WITH RECURSIVE s AS MATERIALIZED (SELECT * FROM {duck(styles)}),
c AS (SELECT doc_id, style_id, style_id AS anc, 0 AS depth, based_on FROM s
  UNION ALL SELECT c.doc_id, c.style_id, p.style_id, depth + 1, p.based_on FROM c JOIN s p ON p.doc_id = c.doc_id AND p.style_id = c.based_on),
v AS (SELECT c.doc_id, c.style_id, depth, sz, align, ind_left, ind_right FROM c JOIN s ON s.doc_id = c.doc_id AND s.style_id = c.anc)
SELECT doc_id, style_id, arg_min(sz, depth) FILTER (WHERE sz IS NOT NULL) AS sz, arg_min(align, depth) FILTER (WHERE align IS NOT NULL) AS align,
  arg_min(coalesce(ind_left, -1), depth) FILTER (WHERE ind_left IS NOT NULL OR ind_right IS NOT NULL) AS l,
  arg_min(coalesce(ind_right, -1), depth) FILTER (WHERE ind_left IS NOT NULL OR ind_right IS NOT NULL) AS r FROM v GROUP BY ALL"""

HEADS = "SELECT p_partkey % 50 AS doc_id, p_partkey AS ord, p_size % 7 AS para_shape, CASE p_size % 4 WHEN 0 THEN concat('Heading ', p_partkey % 9) WHEN 1 THEN concat('제목', p_partkey % 5) ELSE 'Body' END AS name, CASE WHEN p_size % 4 = 2 THEN p_size % 8 END AS own_level FROM {part}"
RUNS = "doc_id, ord AS pos, ord % 2 AS blk, CASE WHEN l_suppkey % 3 = 0 THEN CAST(l_quantity AS INT) END AS size, l_returnflag AS face_flag, l_linestatus = 'F' AS bold, l_suppkey % 2 AS tone"


def style_heading(spark, sf_dir):
    return st.style_heading(built(spark, sf_dir, HEADS))


def defaults(spark, sf_dir):
    r = built(spark, sf_dir, "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'both' WHEN 1 THEN 'end' END AS direct, CASE p_size % 3 WHEN 0 THEN 'center' WHEN 1 THEN 'start' END AS style FROM {part}")
    return r.select("p_partkey", st.alignment(F.col("direct"), F.col("style")).alias("align"))


def char_shapes(spark, sf_dir):
    shapes = built(spark, sf_dir, "SELECT o_orderkey AS doc_id, o_custkey % 4 AS shape, o_orderpriority AS face FROM {orders}")
    return st.resolved_shapes(rows(spark, sf_dir, "doc_id, ord, l_partkey % 4 AS shape"), shapes, "shape")


def effective_runs(spark, sf_dir):
    runs = rows(spark, sf_dir, "doc_id, ord, l_suppkey % 9 AS style_id, CASE WHEN l_partkey % 3 = 0 THEN l_partkey % 30 END AS size, CASE WHEN l_partkey % 5 = 0 THEN 'AA0000' END AS color, l_partkey % 4 = 0 AS link, CAST(NULL AS BOOLEAN) AS underline, CASE WHEN l_suppkey % 4 = 0 THEN '000000' END AS shade, l_suppkey % 6 = 0 AS boxed")
    inherited = built(spark, sf_dir, "SELECT o_orderkey AS doc_id, o_custkey % 9 AS style_id, 12 AS sz, CASE WHEN o_custkey % 2 = 0 THEN '00BB00' END AS color FROM {orders}")
    return st.effective_runs(runs, inherited)


def effective_paragraphs(spark, sf_dir):
    paragraphs = rows(spark, sf_dir, "doc_id, ord AS blk, concat('S', l_partkey) AS style_id, CASE WHEN l_partkey % 4 = 0 THEN 'distribute' END AS align, CASE WHEN l_partkey % 3 = 0 THEN 7 END AS ind_left, CASE WHEN l_partkey % 5 = 0 THEN 9 END AS before, CASE WHEN l_partkey % 7 = 0 THEN 5 END AS after, ord = max(ord) OVER (PARTITION BY doc_id) AS last").withColumn("doc_id", F.expr("CAST(substring(style_id, 2) AS BIGINT) % 7")).withColumnRenamed("blk", "b").withColumn("blk", F.concat_ws("-", "doc_id", "style_id", "b"))
    got = st.style_inherit(built(spark, sf_dir, styles), ["align"], {"ind": ["ind_left", "ind_right"]})
    return st.effective_paragraphs(paragraphs, got)


def fill_lookup(spark, sf_dir):
    """Three fills for each order, by id and by place, of which ids begin at 5."""
    fills = built(spark, sf_dir, "SELECT o_orderkey AS doc_id, 5 + n AS id, concat('l', n) AS `left`, concat('r', n) AS `right`, 't' AS top, 'b' AS bottom, CASE WHEN n = 1 THEN 'ffffff' WHEN o_custkey % 2 = 0 THEN '00aa00' END AS face FROM {orders} LATERAL VIEW explode(array(0, 1, 2)) x AS n")
    by_id, by_place = (rows(spark, sf_dir, f"doc_id, ord, {key} AS fill") for key in ("5 + l_partkey % 4", "l_partkey % 5"))
    both = [st.border_fill_lookup(r, fills, place).withColumn("by_place", F.lit(place)) for r, place in ((by_id, False), (by_place, True))]
    return both[0].unionByName(both[1])


def font_sizes(spark, sf_dir):
    return st.paragraph_font_size(rows(spark, sf_dir, RUNS + ", CASE WHEN l_orderkey % 3 = 0 THEN 11 END AS para_size, CASE WHEN l_orderkey % 2 = 0 THEN 12 END AS style_size"))


def char_shape_ids(spark, sf_dir):
    return registry.dedup_shapes(rows(spark, sf_dir, RUNS), ["size", "face_flag", "bold", "tone"], "pos", 29).select("doc_id", "pos", "shape_id")


def para_shape_ids(spark, sf_dir):
    return registry.dedup_shapes(rows(spark, sf_dir, RUNS), ["size", "tone"], "pos", 30).select("doc_id", "pos", "shape_id")


def border_fill_ids(spark, sf_dir):
    return registry.dedup_shapes(rows(spark, sf_dir, RUNS), ["face_flag", "bold"], "pos", 7).select("doc_id", "pos", "shape_id")


def _ids(key: str, offset: int) -> str:
    return f"""WITH r AS {sql(RUNS)}, f AS (SELECT *, min(pos) OVER (PARTITION BY doc_id, {key}) AS first_ FROM r)
SELECT doc_id, pos, dense_rank() OVER (PARTITION BY doc_id ORDER BY first_) - 1 + {offset} AS shape_id FROM f"""


FACES = "doc_id, ord AS pos, CASE l_partkey % 4 WHEN 0 THEN '맑은 고딕' WHEN 1 THEN '함초롬바탕' WHEN 2 THEN 'Batang' ELSE ' ' END AS east_asia, CASE l_suppkey % 3 WHEN 0 THEN 'Arial' WHEN 1 THEN 'Times' ELSE '굴림' END AS latin"


def fonts(spark, sf_dir):
    return registry.font_registry(rows(spark, sf_dir, FACES))


def doc_fonts(spark, sf_dir):
    return registry.document_fonts(rows(spark, sf_dir, FACES).withColumnRenamed("east_asia", "face"))


def default_fonts(spark, sf_dir):
    return registry.default_fonts(doc_fonts(spark, sf_dir))


REFS = "doc_id, ord, CASE WHEN l_suppkey % 3 = 0 THEN 'image' ELSE 'link' END AS kind, concat('rId', l_partkey % 5) AS rel_id, CASE WHEN l_partkey % 2 = 0 THEN 'top' END AS anchor, CAST(l_quantity AS INT) % 6 AS n_runs"
RELS = "SELECT o_orderkey AS doc_id, concat('rId', o_custkey % 5) AS rel_id, CASE WHEN o_orderkey % 2 = 0 THEN 'image' ELSE 'hyperlink' END AS cls, concat('media/', o_orderkey) AS target FROM {orders}"


def rel_ids(spark, sf_dir):
    return registry.assign_rel_ids(rows(spark, sf_dir, REFS)).select("doc_id", "ord", "rel_id", "image_no")


def links(spark, sf_dir):
    return refs.resolve_links(rows(spark, sf_dir, REFS), built(spark, sf_dir, RELS))


def images(spark, sf_dir):
    parts = built(spark, sf_dir, "SELECT o_orderkey AS doc_id, concat('word/media/', o_orderkey) AS part, encode(o_orderpriority, 'UTF-8') AS bytes FROM {orders} WHERE o_custkey % 7 > 0")
    return refs.resolve_images(rows(spark, sf_dir, REFS, more="WHERE l_suppkey % 3 = 0"), built(spark, sf_dir, RELS), parts).select("doc_id", "ord", "part", F.hex("bytes").alias("bytes"))


def bindata(spark, sf_dir):
    own = rows(spark, sf_dir, "doc_id, ord, l_partkey % 3 AS bin_id, CASE WHEN l_suppkey % 2 = 0 THEN concat('f', l_suppkey % 4) END AS name")
    files = built(spark, sf_dir, "SELECT o_orderkey AS doc_id, CASE WHEN o_custkey % 2 = 0 THEN concat('BIN000', o_custkey % 3, '.png') ELSE concat('f', o_custkey % 4) END AS file, o_custkey AS size FROM {orders}")
    return refs.resolve_bindata(own, files)


def dangling(spark, sf_dir):
    own = rows(spark, sf_dir, REFS).select("doc_id", F.col("rel_id").alias("id")).distinct()
    return refs.dangling({"rel": (own, built(spark, sf_dir, RELS).select("doc_id", F.col("rel_id").alias("id")))})


def notes(spark, sf_dir):
    own = rows(spark, sf_dir, "doc_id, ord, CASE WHEN l_suppkey % 2 = 0 THEN 'foot' ELSE 'end' END AS kind, l_partkey % 3 AS note_id")
    bodies = built(spark, sf_dir, "SELECT o_orderkey AS doc_id, k AS kind, o_custkey % 3 AS note_id, o_orderpriority AS text FROM {orders} LATERAL VIEW explode(array('foot', 'end')) e AS k")
    return refs.attach_notes(own, bodies)


def segments(spark, sf_dir):
    texts = built(spark, sf_dir, "SELECT o_orderkey AS doc_id, 0 AS blk, repeat(o_orderpriority, 6) AS text FROM {orders}")
    points = rows(spark, sf_dir, "doc_id, 0 AS blk, (ord - 1) * 5 AS pos, l_partkey % 10 AS shape_id")
    return refs.char_shape_segments(texts, points)


def positions(spark, sf_dir):
    return refs.vertical_positions(rows(spark, sf_dir, "doc_id, ord, l_suppkey % 5 AS before, CAST(l_quantity AS INT) AS height, l_partkey % 3 AS after"))


PARTS = "doc_id, concat('Contents/', CASE WHEN ord % 3 = 0 THEN 'header' ELSE concat('section', ord * 5 % 13) END, '.xml') AS part"


def sections(spark, sf_dir):
    return refs.ordered_sections(rows(spark, sf_dir, PARTS))


def first_sections(spark, sf_dir):
    return refs.first_section(sections(spark, sf_dir))


def page_setup(spark, sf_dir):
    return refs.page_setup(built(spark, sf_dir, "SELECT o_orderkey AS doc_id, 0 AS sec, o_custkey % 3 * 6000 AS w, o_custkey % 4 * 4000 AS h, CASE WHEN o_custkey % 5 > 0 THEN 1000 END AS margin FROM {orders}"))


def page_breaks(spark, sf_dir):
    return refs.page_breaks(rows(spark, sf_dir, "doc_id, ord % 2 AS blk, ord, ord * 10 AS text_offset, l_partkey % 64 AS flags"))


def counts(spark, sf_dir):
    return quality.node_counts(blocks(spark, sf_dir))


def text_of(spark, sf_dir):
    pieces = blocks(spark, sf_dir).where("text IS NOT NULL").select("doc_id", F.col("blk").alias("ord"), F.col("text").alias("piece"))
    return quality.extract_text(pieces)


def text_of_chats(spark, sf_dir):
    return quality.extract_text(built(spark, sf_dir, "SELECT conv_id AS doc_id, turn AS ord, text AS piece FROM {conversations}"))


def rules(spark, sf_dir):
    r = rows(spark, sf_dir, "l_suppkey % 9 AS heading, l_linenumber - 2 AS span, CASE WHEN l_partkey % 3 = 0 THEN 'x' ELSE 'left' END AS align")
    return quality.validate(r, {"heading": F.col("heading").between(1, 6), "span": F.col("span") >= 0, "align": F.col("align").isin(*quality.ALIGNS)})


REQUESTS = "SELECT o_orderkey AS doc_id, CASE o_custkey % 4 WHEN 0 THEN 'md' WHEN 1 THEN 'docx' WHEN 2 THEN 'hwp' ELSE 'pdf' END AS from_, CASE o_orderkey % 3 WHEN 0 THEN 'md' WHEN 1 THEN 'docx' ELSE 'hwpx' END AS to_ FROM {orders}"
ALLOWED = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in quality.PAIRS) + ") p(a, b)"


def outcomes(spark, sf_dir):
    return quality.outcomes(built(spark, sf_dir, f"SELECT *, CASE WHEN doc_id % 7 = 0 THEN 'bad' END AS error, doc_id % 2 AS warnings FROM ({REQUESTS}) q"))


def diff(spark, sf_dir):
    before = rows(spark, sf_dir, "doc_id, l_partkey AS x")
    after = rows(spark, sf_dir, "doc_id, CASE WHEN l_suppkey % 5 = 0 THEN -l_partkey ELSE l_partkey END AS x", more="WHERE l_suppkey % 7 > 0")
    return quality.integrity_diff(before, after)


def media(spark, sf_dir):
    own = rows(spark, sf_dir, "doc_id, ord AS media_id, encode(concat('img', l_partkey % 40), 'UTF-8') AS bytes")
    new, keys = quality.distinct_media(own)
    return keys.groupBy("key").agg(F.count("*").alias("n")).join(new, "key").select("key", "n", F.octet_length("bytes").alias("size"))


def extensions(spark, sf_dir):
    return registry.used_extensions(built(spark, sf_dir, "SELECT CASE p_size % 4 WHEN 0 THEN 'PNG' WHEN 1 THEN 'jpg' WHEN 2 THEN 'JPEG' ELSE 'gif' END AS ext FROM {part}"))


RESOLVED_RUNS = f"""WITH r AS {sql("doc_id, ord, l_suppkey % 9 AS style_id, CASE WHEN l_partkey % 3 = 0 THEN l_partkey % 30 END AS size, CASE WHEN l_partkey % 5 = 0 THEN 'AA0000' END AS color, l_partkey % 4 = 0 AS link, CASE WHEN l_suppkey % 4 = 0 THEN '000000' END AS shade, l_suppkey % 6 = 0 AS boxed")},
j AS (SELECT r.*, o_orderkey IS NOT NULL AS has, CASE WHEN o_custkey % 2 = 0 THEN '00BB00' END AS sc FROM r LEFT JOIN orders ON o_orderkey = doc_id AND o_custkey % 9 = style_id),
c AS (SELECT *, coalesce(color, CASE WHEN link THEN '0000FF' END, sc, '000000') AS c0 FROM j)
SELECT doc_id, ord, style_id, coalesce(size, CASE WHEN has THEN 12 ELSE 10 END) AS size, link, link AS underline, shade, boxed, CASE WHEN shade = '000000' AND c0 = '000000' THEN 'FFFFFF' ELSE c0 END AS shown, CASE WHEN boxed THEN '5' ELSE shade END AS fill FROM c"""
QUERIES = {
    "style_inherit": (style_inherit, f"SELECT doc_id, style_id, sz, align, nullif(l, -1) AS ind_left, nullif(r, -1) AS ind_right FROM ({INHERIT_SQL}) z"),
    "style_heading": (style_heading, f"""WITH h AS ({HEADS.replace('{part}', 'part')}), l AS (SELECT *, coalesce(try_cast(nullif(regexp_extract(lower(name), '^(?:heading|제목)\\s*(\\d)', 1), '') AS INT), own_level) AS told, CASE WHEN told IS NOT NULL THEN least(told, 6) END AS lv FROM h)
SELECT doc_id, para_shape, arg_max(lv, ord) AS level FROM l WHERE lv > 0 GROUP BY ALL"""),
    "style_defaults": (defaults, "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'justify' WHEN p_size % 4 = 1 THEN 'right' WHEN p_size % 3 = 0 THEN 'center' ELSE 'left' END AS align FROM part"),
    "resolve_char_shapes": (char_shapes, f"SELECT doc_id, ord, shape, CASE WHEN o_custkey % 4 = shape THEN o_orderpriority END AS face FROM {sql('doc_id, ord, l_partkey % 4 AS shape')} a JOIN orders ON o_orderkey = doc_id"),
    "effective_runs": (effective_runs, RESOLVED_RUNS),
    "effective_paragraphs": (effective_paragraphs, f"""WITH s AS (SELECT doc_id AS sd, style_id AS ss, align AS sa, l FROM ({INHERIT_SQL}) z),
p AS {sql("l_partkey % 7 AS doc_id, concat(l_partkey % 7, '-S', l_partkey, '-', ord) AS blk, concat('S', l_partkey) AS style_id, l_partkey, ord = max(ord) OVER (PARTITION BY doc_id) AS last")}
SELECT doc_id, blk, CASE WHEN l_partkey % 4 = 0 THEN 'justify' ELSE coalesce(sa, 'left') END AS align, CASE WHEN l_partkey % 3 = 0 THEN 7 ELSE coalesce(nullif(l, -1), 0) END AS ind_left, CASE WHEN l_partkey % 5 = 0 THEN 9 ELSE 0 END AS before, CASE WHEN last OR l_partkey % 7 = 0 THEN 0 ELSE 160 END AS after
FROM p LEFT JOIN s ON sd = doc_id AND ss = style_id"""),
    "border_fill_lookup": (fill_lookup, f"""WITH q AS {sql('doc_id, ord, l_partkey')}, a AS (SELECT doc_id, ord, 5 + l_partkey % 4 AS fill, l_partkey % 4 AS n, false AS by_place FROM q UNION ALL SELECT doc_id, ord, l_partkey % 5, l_partkey % 5 - 1, true FROM q)
SELECT doc_id, ord, fill, by_place, CASE WHEN hit THEN concat('l', n) END AS "left", CASE WHEN hit THEN concat('r', n) END AS "right", CASE WHEN hit THEN 't' END AS top, CASE WHEN hit THEN 'b' END AS bottom, CASE WHEN hit AND n <> 1 AND o_custkey % 2 = 0 THEN '00AA00' END AS face
FROM (SELECT *, n BETWEEN 0 AND 2 AS hit FROM a) z JOIN orders ON o_orderkey = doc_id"""),
    "paragraph_font_size": (font_sizes, f"SELECT doc_id, blk, coalesce(arg_min(size, pos) FILTER (WHERE size IS NOT NULL), CASE WHEN doc_id % 3 = 0 THEN 11 END, CASE WHEN doc_id % 2 = 0 THEN 12 END, 10) AS size FROM {sql(RUNS)} a GROUP BY doc_id, blk"),
    "dedup_char_shapes": (char_shape_ids, _ids("size, face_flag, bold, tone", 29)),
    "dedup_para_shapes": (para_shape_ids, _ids("size, tone", 30)),
    "dedup_border_fills": (border_fill_ids, _ids("face_flag, bold", 7)),
    "assign_shape_ids": (lambda s, d: registry.every_shape(rows(s, d, "doc_id, ord"), "ord"), f"SELECT doc_id, ord, ord - 1 AS shape_id FROM {sql('doc_id, ord')} a"),
    "font_registry": (fonts, f"""WITH f AS {sql(FACES)}, e AS (SELECT doc_id, pos, unnest(['HANGUL', 'HANJA', 'JAPANESE', 'OTHER']) AS lane, east_asia AS face FROM f UNION ALL SELECT doc_id, pos, unnest(['LATIN', 'SYMBOL', 'USER']), latin FROM f),
m AS (SELECT doc_id, lane, face, min(pos) AS p FROM e WHERE face <> '함초롬바탕' GROUP BY ALL) SELECT doc_id, lane, face, row_number() OVER (PARTITION BY doc_id, lane ORDER BY p) AS font_id FROM m"""),
    "document_fonts": (doc_fonts, f"WITH m AS (SELECT doc_id, east_asia AS face, min(pos) AS p FROM {sql(FACES)} f WHERE trim(east_asia) <> '' GROUP BY ALL) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS nth, face, CASE WHEN face = 'Batang' THEN '00' ELSE '81' END AS charset FROM m"),
    "default_fonts": (default_fonts, f"""WITH m AS (SELECT doc_id, east_asia AS face, min(pos) AS p FROM {sql(FACES)} f WHERE trim(east_asia) <> '' GROUP BY ALL),
a AS (SELECT doc_id, coalesce(arg_min(face, p) FILTER (WHERE face <> 'Batang'), 'Malgun Gothic') AS east_asia, arg_min(face, p) FILTER (WHERE face = 'Batang') AS latin FROM m GROUP BY doc_id) SELECT doc_id, east_asia, coalesce(latin, east_asia) AS latin FROM a"""),
    "assign_rel_ids": (rel_ids, f"WITH r AS {sql(REFS)} SELECT a.doc_id, a.ord, concat('rId', a.ord) AS rel_id, CASE WHEN a.kind = 'image' THEN (SELECT count(*) FROM r b WHERE b.doc_id = a.doc_id AND b.ord <= a.ord AND b.kind = 'image') END AS image_no FROM r a"),
    "resolve_links": (links, f"SELECT doc_id, ord, url FROM (SELECT doc_id, ord, n_runs, coalesce(CASE WHEN o_orderkey % 2 = 1 AND concat('rId', o_custkey % 5) = rel_id THEN concat('media/', doc_id) END, '#' || anchor) AS url FROM {sql(REFS)} a JOIN orders ON o_orderkey = doc_id) y WHERE n_runs > 0 AND url IS NOT NULL"),
    "resolve_images": (images, f"SELECT doc_id, ord, concat('word/media/', doc_id) AS part, upper(hex(o_orderpriority)) AS bytes FROM {sql(REFS)} a JOIN orders ON o_orderkey = doc_id WHERE kind = 'image' AND o_orderkey % 2 = 0 AND concat('rId', o_custkey % 5) = rel_id AND o_custkey % 7 > 0"),
    "resolve_bindata": (bindata, f"""WITH r AS {sql("doc_id, ord, l_partkey % 3 AS bin_id, CASE WHEN l_suppkey % 2 = 0 THEN concat('f', l_suppkey % 4) END AS name")}, o AS (SELECT o_orderkey, o_custkey, CASE WHEN o_custkey % 2 = 0 THEN concat('BIN000', o_custkey % 3, '.png') ELSE concat('f', o_custkey % 4) END AS file FROM orders)
SELECT doc_id, ord, CASE WHEN file = name OR file = concat('BIN000', bin_id, '.png') THEN file END AS file, CASE WHEN file = name OR file = concat('BIN000', bin_id, '.png') THEN o_custkey END AS size FROM r JOIN o ON o_orderkey = doc_id"""),
    "dangling_refs": (dangling, f"SELECT DISTINCT 'rel' AS kind, doc_id, rel_id AS id FROM {sql(REFS)} a JOIN orders ON o_orderkey = doc_id WHERE concat('rId', o_custkey % 5) <> rel_id"),
    "number_notes": (notes, f"""SELECT doc_id, kind, ord, row_number() OVER (PARTITION BY doc_id, kind ORDER BY ord) AS number, o_orderpriority AS text FROM {sql("doc_id, ord, CASE WHEN l_suppkey % 2 = 0 THEN 'foot' ELSE 'end' END AS kind, l_partkey % 3 AS note_id")} a JOIN orders ON o_orderkey = doc_id AND o_custkey % 3 = note_id"""),
    "char_shape_segments": (segments, f"""WITH p AS {sql("doc_id, (ord - 1) * 5 AS pos, l_partkey % 10 AS shape_id, ord = max(ord) OVER (PARTITION BY doc_id) AS last")}
SELECT doc_id, 0 AS blk, pos AS start, shape_id, t AS text FROM (SELECT p.*, CASE WHEN last THEN substr(repeat(o_orderpriority, 6), pos + 1) ELSE substr(repeat(o_orderpriority, 6), pos + 1, 5) END AS t FROM p JOIN orders ON o_orderkey = doc_id) q WHERE t <> ''"""),
    "vertical_positions": (positions, f"""WITH r AS {sql("doc_id, ord, l_suppkey % 5 AS before, CAST(l_quantity AS INT) AS height, l_partkey % 3 AS after")}
SELECT a.doc_id, a.ord, a.before, a.height, a.after, CAST(a.before + coalesce(sum(b.before + b.height + b.after), 0) AS BIGINT) AS y, CAST(floor(a.height * 0.85 + 0.5) AS BIGINT) AS baseline FROM r a LEFT JOIN r b ON a.doc_id = b.doc_id AND b.ord < a.ord GROUP BY a.doc_id, a.ord, a.before, a.height, a.after"""),
    "order_sections": (sections, f"SELECT doc_id, concat('Contents/section', n, '.xml') AS part, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS sec FROM (SELECT doc_id, ord * 5 % 13 AS n FROM {sql('doc_id, ord')} a WHERE ord % 3 > 0) q"),
    "first_section_only": (first_sections, f"SELECT doc_id, concat('Contents/section', min(n), '.xml') AS part, 0 AS sec FROM (SELECT doc_id, ord * 5 % 13 AS n FROM {sql('doc_id, ord')} a WHERE ord % 3 > 0) q GROUP BY doc_id"),
    "page_setup": (page_setup, "SELECT doc_id, sec, w, h, margin, CASE WHEN w > h THEN 'landscape' ELSE 'portrait' END AS orientation FROM (SELECT o_orderkey AS doc_id, 0 AS sec, CAST(CASE WHEN o_custkey % 3 = 0 THEN 595.28 ELSE o_custkey % 3 * 300 END AS DOUBLE) AS w, CAST(CASE WHEN o_custkey % 4 = 0 THEN 841.89 ELSE o_custkey % 4 * 200 END AS DOUBLE) AS h, CAST(CASE WHEN o_custkey % 5 > 0 THEN 50 ELSE 70.87 END AS DOUBLE) AS margin FROM orders) q"),
    "page_breaks": (page_breaks, f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, blk ORDER BY ord) AS nth FROM {sql("doc_id, ord % 2 AS blk, ord, l_partkey % 64 AS flags")} a)
SELECT doc_id, blk, CASE WHEN nth = 1 THEN 'before' WHEN flags // 16 % 2 = 1 THEN 'page' ELSE 'column' END AS kind, CASE WHEN nth = 1 THEN 0 ELSE ord * 10 END AS at FROM r WHERE flags // 16 % 2 = 1 OR (nth > 1 AND flags // 32 % 2 = 1)"""),
    "node_counts": (counts, KNOWN + ' SELECT o_orderkey AS doc_id, 4 + k AS paragraph, 1 AS "table", 1 AS "pageBreak" FROM k'),
    "extract_text": (text_of, KNOWN + """, items AS (SELECT o_orderkey, string_agg(coalesce(concat('item ', CASE WHEN rn IS NOT NULL THEN l_partkey END), 'none'), '' ORDER BY rn) AS a, string_agg(concat('# code ', q), chr(10) ORDER BY rn) FILTER (WHERE rn IS NOT NULL) AS c, max(n) AS n FROM full_ GROUP BY o_orderkey)
SELECT k.o_orderkey AS doc_id, concat('Order ', k.o_orderkey, 'Status **', o_orderstatus, '** and *', o_orderpriority, '* see [order](http://x/', k.o_orderkey, ')', chr(10), 'second line', CASE WHEN k.n = 0 THEN 'none' ELSE a END, coalesce(c, '# none'), 'end ~~x~~ ', o_custkey) AS text FROM k JOIN items USING (o_orderkey)"""),
    "extract_text_chats": (text_of_chats, "SELECT conv_id AS doc_id, string_agg(text, '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id"),
    "validate_docs": (rules, "SELECT 'heading' AS rule, count(*) FILTER (WHERE l_suppkey % 9 NOT BETWEEN 1 AND 6) AS n FROM lineitem UNION ALL SELECT 'span', count(*) FILTER (WHERE l_linenumber < 2) FROM lineitem UNION ALL SELECT 'align', count(*) FILTER (WHERE l_partkey % 3 = 0) FROM lineitem"),
    "supported_pairs": (lambda s, d: quality.supported(built(s, d, REQUESTS)), f"SELECT * FROM ({REQUESTS.replace('{orders}', 'orders')}) r WHERE EXISTS (SELECT 1 FROM {ALLOWED} WHERE a = from_ AND b = to_)"),
    "unsupported_requests": (lambda s, d: quality.unsupported(built(s, d, REQUESTS)), f"SELECT * FROM ({REQUESTS.replace('{orders}', 'orders')}) r WHERE NOT EXISTS (SELECT 1 FROM {ALLOWED} WHERE a = from_ AND b = to_)"),
    "conversion_outcomes": (outcomes, f"SELECT from_, to_, CASE WHEN doc_id % 7 = 0 THEN 'error' WHEN doc_id % 2 = 1 THEN 'warnings' ELSE 'ok' END AS status, count(*) AS n FROM ({REQUESTS.replace('{orders}', 'orders')}) r GROUP BY ALL"),
    "integrity_diff": (diff, """WITH a AS (SELECT l_orderkey AS d, l_partkey AS x, 1 AS s FROM lineitem UNION ALL SELECT l_orderkey, CASE WHEN l_suppkey % 5 = 0 THEN -l_partkey ELSE l_partkey END, -1 FROM lineitem WHERE l_suppkey % 7 > 0),
n AS (SELECT d, x, sum(s) AS s FROM a GROUP BY ALL HAVING sum(s) <> 0) SELECT d AS doc_id, CASE WHEN s > 0 THEN 'lost' ELSE 'added' END AS side, CAST(sum(abs(s)) AS BIGINT) AS n FROM n GROUP BY ALL"""),
    "distinct_media": (media, "SELECT sha256(concat('img', l_partkey % 40)) AS key, count(*) AS n, length(concat('img', l_partkey % 40)) AS size FROM lineitem GROUP BY ALL"),
    "used_extensions": (extensions, "SELECT * FROM (VALUES ('png', 'image/png'), ('jpg', 'image/jpeg'), ('jpeg', 'image/jpeg'), ('gif', 'image/gif')) v(ext, content_type)"),
}

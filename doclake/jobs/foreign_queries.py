"""Queries over packages and record streams that other programs could have written: their own ids for styles, lists and shapes.

Each document is made of one customer. The expected results are plain SQL over the same table; no writer of this library
takes part in making the inputs, but for the zip container.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from doclake.jobs import convert as c
from doclake.jobs.fixtures import built, dealt
from doclake.jobs.resolved import resolve_docx
from doclake.operators import quality
from doclake.operators import records as rec
from doclake.sources import package

PICTURE = "concat(unhex('89504E47'), encode(CAST(c_custkey AS STRING), 'UTF-8'))"


def _held(parts: dict[str, str]):
    """An array of parts; each is a template with {k}, {name}, {level}, or SQL that begins with `=`."""

    def part(i, name, text):
        if text.startswith("="):
            data = F.expr(text[1:])
        else:
            filled = F.lit(text)
            for mark, value in (("{k}", "c_custkey"), ("{name}", "c_name"), ("{level}", "level")):
                filled = F.replace(filled, F.lit(mark), F.col(value).cast("string"))
            data = F.encode(filled, "UTF-8")
        return F.struct(F.lit(i).alias("ord"), F.lit(name).alias("part"), data.alias("bytes"))

    return F.array(*[part(i, name, text) for i, (name, text) in enumerate(parts.items())])


def _customers(spark, sf_dir):
    return dealt(built(spark, sf_dir, "SELECT c_custkey AS doc_id, c_custkey, c_name, c_custkey % 3 AS level FROM {customer}"))


def _parts(spark, sf_dir, parts: dict[str, str]):
    """Packages of parts, as _held() takes them."""
    return package.zip_parts(_customers(spark, sf_dir).select("doc_id", _held(parts).alias("parts")))


def _p(inner: str, pr: str = "") -> str:
    return f"<w:p><w:pPr>{pr}</w:pPr>{inner}</w:p>"


def _r(text: str, pr: str = "") -> str:
    return f"<w:r><w:rPr>{pr}</w:rPr><w:t>{text}</w:t></w:r>"


def _list(num: int, level: str, text: str) -> str:
    return _p(_r(text), f'<w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="{num}"/></w:numPr>')


def _tc(text: str, pr: str = "") -> str:
    return f"<w:tc><w:tcPr>{pr}</w:tcPr>{_p(_r(text) if text else '')}</w:tc>"


DOCX = {
    "word/document.xml": '<w:document xmlns:w="w" xmlns:r="r" xmlns:a="a"><w:body>' + "".join([
        _p(_r("Title {k}"), '<w:pStyle w:val="1"/>'),
        _p(_r("Body {name}"), '<w:pStyle w:val="Heading2"/>'),
        _list(5, "{level}", "item {k}"), _list(2, "0", "dot"), _list(0, "0", "no list"),
        "<w:tbl><w:tr>" + _tc("wide", '<w:gridSpan w:val="2"/>') + _tc("tall {k}", '<w:vMerge w:val="restart"/>') + "</w:tr><w:tr>" + _tc("a") + _tc("b") + _tc("", "<w:vMerge/>") + "</w:tr></w:tbl>",
        _p(_r("x") + _r("2", '<w:vertAlign w:val="superscript"/>') + _r(" off", '<w:b w:val="0"/><w:i w:val="false"/><w:u w:val="none"/>') + _r(" on", "<w:b/>")),
        _p(_r("see ") + '<w:r><w:drawing><a:blip r:embed="rId77"/></w:drawing></w:r><w:hyperlink r:id="rId9">' + _r("link") + '</w:hyperlink><w:hyperlink w:anchor="here">' + _r("anchor") + "</w:hyperlink>"),
    ]) + "</w:body></w:document>",
    "word/styles.xml": '<w:styles xmlns:w="w"><w:style w:styleId="1"><w:name w:val="heading 1"/></w:style><w:style w:styleId="Heading2"><w:name w:val="Body Text"/></w:style></w:styles>',
    "word/numbering.xml": '<w:numbering xmlns:w="w"><w:abstractNum w:abstractNumId="9">' + "".join(f'<w:lvl w:ilvl="{i}"><w:numFmt w:val="{f}"/></w:lvl>' for i, f in enumerate(("decimal", "lowerRoman", "upperLetter")))
    + '</w:abstractNum><w:abstractNum w:abstractNumId="4"><w:lvl w:ilvl="0"><w:numFmt w:val="bullet"/></w:lvl></w:abstractNum><w:num w:numId="5"><w:abstractNumId w:val="9"/></w:num><w:num w:numId="2"><w:abstractNumId w:val="4"/></w:num></w:numbering>',
    "word/_rels/document.xml.rels": '<Relationships><Relationship Id="rId77" Type="x/image" Target="media/p.png"/><Relationship Id="rId9" Type="x/hyperlink" Target="http://x/{k}"/></Relationships>',
    "word/media/p.png": f"={PICTURE}",
}


def foreign_docx(spark, sf_dir):
    return _parts(spark, sf_dir, DOCX)


def docx_to_md(spark, sf_dir):
    return c.convert(foreign_docx(spark, sf_dir), "docx", "md")


def docx_through_formats(spark, sf_dir):
    """DOCX to HWPX, back to DOCX, and then to Markdown: as if it had been converted at once."""
    return c.convert(c.convert(c.convert(foreign_docx(spark, sf_dir), "docx", "hwpx").select("doc_id", "bytes"), "hwpx", "docx").select("doc_id", "bytes"), "docx", "md")


def media_and_spans(spark, sf_dir):
    """What images and merged cells are there after DOCX, HWPX and DOCX again."""
    ir = c.read_docx(c.convert(c.convert(foreign_docx(spark, sf_dir), "docx", "hwpx").select("doc_id", "bytes"), "hwpx", "docx").select("doc_id", "bytes"))
    images = ir.runs.where("media_id IS NOT NULL").join(ir.media, ["doc_id", "media_id"]).groupBy("doc_id").agg(F.count("*").alias("n_images"), F.max(F.md5("bytes")).alias("picture"))
    spans = ir.cells.groupBy("doc_id").agg(F.count("*").alias("n_cells"), F.max("row_span").alias("tallest"), F.max("col_span").alias("widest"), F.count(F.when(F.col("row_span") == 0, 1)).alias("n_merged"))
    return images.join(spans, "doc_id")


def _style(name: str, based: str, inner: str) -> str:
    return f'<w:style w:styleId="{name}"><w:name w:val="{name}"/>' + (f'<w:basedOn w:val="{based}"/>' if based else "") + inner + "</w:style>"


STYLED = {
    "word/document.xml": '<w:document xmlns:w="w" xmlns:r="r"><w:body>' + "".join([
        _p(_r("plain") + _r("marked", '<w:highlight w:val="yellow"/>') + _r("dark", '<w:shd w:fill="000000"/>') + _r("boxed", "<w:bdr/>") + '<w:hyperlink r:id="a">' + _r("link") + "</w:hyperlink>" + _r("own", '<w:sz w:val="24"/><w:color w:val="AA0000"/>'), '<w:pStyle w:val="T"/>'),
        _p(_r("plain"), '<w:pStyle w:val="B"/><w:jc w:val="right"/><w:spacing w:after="99"/><w:ind w:left="{k}" w:hanging="10"/><w:keepNext/><w:keepLines w:val="0"/><w:pageBreakBefore/><w:outlineLvl w:val="{level}"/>'),
        _p(_r("plain"), '<w:pStyle w:val="B"/>'),
    ]) + "</w:body></w:document>",
    "word/styles.xml": '<w:styles xmlns:w="w">'
    + _style("B", "", '<w:pPr><w:ind w:left="100"/><w:spacing w:after="40" w:line="480" w:lineRule="auto"/></w:pPr><w:rPr><w:sz w:val="30"/><w:color w:val="112233"/></w:rPr>')
    + _style("M", "B", '<w:pPr><w:jc w:val="both"/><w:spacing w:before="20" w:line="200" w:lineRule="exact"/></w:pPr>') + _style("T", "M", "") + "</w:styles>",
}


def resolved_paragraphs(spark, sf_dir):
    return resolve_docx(_parts(spark, sf_dir, STYLED)).paragraphs


def resolved_runs(spark, sf_dir):
    return resolve_docx(_parts(spark, sf_dir, STYLED)).runs.select("doc_id", "para", "text", "size", "color", "shade", "fill", "underline", "shape_id")


def _hp(text: str, para: int, style: int, char: int = 1) -> str:
    return f'<hp:p paraPrIDRef="{para}" styleIDRef="{style}"><hp:run charPrIDRef="{char}"><hp:t>{text}</hp:t></hp:run></hp:p>'


def _hc(inner: str, row: int, col: int, rows: int = 1) -> str:
    return f'<hp:tc><hp:subList>{inner}</hp:subList><hp:cellAddr colAddr="{col}" rowAddr="{row}"/><hp:cellSpan colSpan="1" rowSpan="{rows}"/></hp:tc>'


_DEEP = "<hp:p><hp:run><hp:tbl><hp:tr>" + _hc(_hp("deep {k}", 3, 8), 0, 0) + "</hp:tr></hp:tbl></hp:run></hp:p>"
_SEC = lambda inner: f'<hs:sec xmlns:hs="s" xmlns:hp="p" xmlns:hc="c">{inner}</hs:sec>'
HWPX = {
    "mimetype": "application/hwp+zip",
    "Contents/header.xml": '<hh:head xmlns:hh="h"><hh:charPr id="1"/><hh:charPr id="5"><hh:bold value="true"/><hh:italic value="false"/><hh:underline type="NONE"/></hh:charPr>'
    '<hh:paraPr id="3"><hh:heading type="NONE" level="0"/></hh:paraPr><hh:paraPr id="20"><hh:heading type="NUMBER" idRef="4" level="1"/></hh:paraPr>'
    '<hh:style id="7" type="PARA" name="제목 2" paraPrIDRef="12"/><hh:style id="8" type="PARA" name="본문" paraPrIDRef="3"/><hh:style id="9" type="HEADING" level="3" name="머리" paraPrIDRef="14"/></hh:head>',
    "Contents/section10.xml": _SEC(_hp("last", 3, 8)),
    "Contents/section2.xml": _SEC('<hp:p paraPrIDRef="3" styleIDRef="8"><hp:run charPrIDRef="1"><hp:ctrl><hp:fieldBegin type="HYPERLINK" url="http://x/{k}"/></hp:ctrl><hp:t>link</hp:t><hp:ctrl><hp:fieldEnd/></hp:ctrl><hp:t> end<hp:lineBreak/>{name}</hp:t></hp:run></hp:p>'),
    "Contents/section0.xml": _SEC(
        _hp("Title {k}", 12, 8) + _hp("shape three", 3, 8) + _hp("head", 3, 9) + _hp("item", 20, 8)
        + '<hp:p paraPrIDRef="3" styleIDRef="8"><hp:run charPrIDRef="5"><hp:t>bold</hp:t></hp:run><hp:run charPrIDRef="1"><hp:t> plain</hp:t></hp:run></hp:p>'
        + "<hp:p><hp:run><hp:tbl><hp:tr>" + _hc(_hp("tall", 3, 8), 0, 0, 2) + _hc(_hp("one", 3, 8) + _hp("two", 3, 8), 0, 1) + "</hp:tr><hp:tr>" + _hc(_hp("B", 3, 8) + _DEEP, 1, 1) + "</hp:tr></hp:tbl></hp:run></hp:p>"
        + '<hp:p paraPrIDRef="3"><hp:run><hp:pic><hc:img binaryItemIDRef="image3"/></hp:pic></hp:run></hp:p>'
    ),
    "BinData/image3.png": f"={PICTURE}",
}


def hwpx_to_md(spark, sf_dir):
    return c.convert(_parts(spark, sf_dir, HWPX), "hwpx", "md")


def outcomes(spark, sf_dir):
    """Conversions of which some packages are cut off and some documents are no XML."""
    other = _held({"word/document.xml": "<w:document>"})
    held = F.when((F.col("doc_id") % 11 == 0) & (F.col("doc_id") % 7 != 0), other).otherwise(_held(DOCX))
    docs = package.zip_parts(_customers(spark, sf_dir).select("doc_id", held.alias("parts")))
    docs = docs.select("doc_id", F.expr("CASE WHEN doc_id % 7 = 0 THEN substring(bytes, 1, 40) ELSE bytes END").alias("bytes"))
    formats = ("md", "hwpx")
    done = [df.select("doc_id", F.lit("docx").alias("from_"), F.lit(to).alias("to_"), "error", F.lit(0).alias("warnings")) for to, df in zip(formats, c.conversions(docs, "docx", formats), strict=True)]
    return quality.outcomes(done[0].unionByName(done[1]))


def _le(value: str, width: int) -> str:
    """SQL for the hexadecimal digits of a little-endian integer."""
    return "concat(" + ", ".join(f"lpad(hex(shiftright(CAST({value} AS BIGINT), {8 * i}) & 255), 2, '0')" for i in range(width)) + ")"


def _payload(*fields: tuple[str, int]) -> str:
    return "unhex(concat(" + ", ".join(_le(v, n) for v, n in fields) + "))"


def _record(rows, tag: int, level: int, payload: str):
    return rec.encode_record(F.lit(tag), F.lit(level), F.expr(payload))


SHAPE_RECORD = _payload(*[("0", 4)] * 10, ("0", 2), ("100 * p_size", 4), ("p_size % 4", 4), ("0", 2), ("p_partkey % 16777216", 4))
PARA_RECORD = _payload(("4 * (p_size % 6)", 4), ("p_partkey", 4), ("4294967296 - p_size", 4), ("7", 4), ("8", 4), ("9", 4), ("p_size", 4), ("0", 4), ("p_size % 3", 2))
FILL_RECORD = _payload(("0", 2), *[("p_size", 2), ("3", 2), ("255", 4)] * 4, ("0", 8), ("p_size % 2", 4), ("65280", 4))
PAGE_RECORD = _payload(*[(f"p_partkey + {i}", 4) for i in range(8)])
CELL_RECORD = _payload(("1", 8), ("p_size % 5", 2), ("p_size % 7", 2), ("1", 2), ("p_size", 2), ("p_partkey", 4), ("50", 4), ("0", 8), ("p_size % 9", 2))


def record_fields(spark, sf_dir):
    """What the field readers find in records made of numbers of each part."""
    rows = built(spark, sf_dir, "SELECT p_partkey AS doc_id, p_partkey, CAST(p_size AS BIGINT) AS p_size FROM {part}")
    data = F.concat(*[_record(rows, tag, 0, payload) for tag, payload in ((rec.HEAD_TAGS["char_shape"], SHAPE_RECORD), (rec.HEAD_TAGS["para_shape"], PARA_RECORD), (rec.HEAD_TAGS["border_fill"], FILL_RECORD), (rec.PAGE, PAGE_RECORD), (rec.CELL, CELL_RECORD), (rec.CELL, "unhex('0100')"))])
    held = rec.decode_records(rows.select("doc_id", F.lit("s").alias("stream"), F.lit(False).alias("compressed"), data.alias("bytes")))
    chars = rec.char_shapes(held).select("doc_id", "size_pt", "bold", "italic", F.col("color").alias("text_color"))
    paras = rec.para_shapes(held).select("doc_id", "align", "left", "right", "indent", "before", "after", "line", F.col("fill").alias("para_fill"))
    fills = rec.border_fills(held).select("doc_id", F.col("top").alias("top_side"), "face")
    pages = rec.page_defs(held).select("doc_id", "w", "footer")
    cells = rec.cell_attributes(held).groupBy("doc_id").agg(*[F.sum(k).alias(k) for k in ("col", "row", "col_span", "row_span", "width", "height")], F.sum("fill").alias("cell_fill"))
    return chars.join(paras, "doc_id").join(fills, "doc_id").join(pages, "doc_id").join(cells, "doc_id")


def _text(sql: str) -> str:
    return f"encode({sql}, 'UTF-16LE')"


def hwp_to_md(spark, sf_dir):
    """Binary documents, a customer each: a paragraph that changes its shape, a table of two cells, a paragraph behind it."""
    rows = dealt(built(spark, sf_dir, "SELECT c_custkey AS doc_id, c_custkey, c_name FROM {customer}"))
    r = lambda tag, level, payload: _record(rows, tag, level, payload)
    plain, bold = (_payload(*[("0", 4)] * 10, ("0", 2), ("1000", 4), (flags, 4), ("0", 2), ("0", 4)) for flags in ("0", "2"))
    cell = lambda col: _payload(("1", 8), (col, 2), ("0", 2), ("1", 2), ("1", 2), ("10", 4), ("10", 4), ("0", 8), ("0", 2))
    info = F.concat(r(rec.HEAD_TAGS["char_shape"], 0, plain), r(rec.HEAD_TAGS["char_shape"], 0, bold))
    head = "unhex('00000000')"
    first = F.concat(r(rec.PARAGRAPH, 0, head), r(rec.TEXT, 1, _text("concat('plain ', c_name)")), r(rec.CHAR_SHAPE, 1, _payload(("0", 4), ("0", 4), ("6", 4), ("1", 4))))
    holder = F.concat(r(rec.PARAGRAPH, 0, head), r(rec.TEXT, 1, "concat(unhex('0B00'), unhex(repeat('0000', 6)), unhex('0B00'), unhex('0D00'))"), r(rec.CONTROL, 1, "unhex('206C6274')"), r(rec.TABLE, 2, "unhex('00')"))
    inside = lambda col, text: F.concat(r(rec.CELL, 2, cell(col)), r(rec.PARAGRAPH, 2, head), r(rec.TEXT, 3, _text(text)))
    second = F.concat(r(rec.PARAGRAPH, 0, head), r(rec.TEXT, 1, _text("concat('end ', c_custkey)")))
    body = F.concat(first, holder, inside("0", "'left'"), inside("1", "concat('right ', c_custkey)"), second)
    told = F.array(F.struct(F.lit("DocInfo").alias("stream"), info.alias("bytes")), F.struct(F.lit("BodyText/Section0").alias("stream"), body.alias("bytes")))
    streams = rows.select("doc_id", F.explode(told).alias("s")).select("doc_id", "s.stream", F.lit(False).alias("compressed"), "s.bytes")
    return c.convert(streams, "hwp", "md")


PICTURE_SQL = "to_base64(unhex('89504E47') || CAST(CAST(c_custkey AS VARCHAR) AS BLOB))"
MD = f"""concat('# Title ', c_custkey, chr(10), chr(10), 'Body ', c_name, chr(10), chr(10), repeat('  ', CAST(c_custkey % 3 AS INT)), c_custkey % 3 + 1, '. item ', c_custkey, chr(10), chr(10), '- dot', chr(10), chr(10), 'no list', chr(10), chr(10),
  '| wide | tall ', c_custkey, ' |', chr(10), '| --- | --- |', chr(10), '| a | b |  |', chr(10), chr(10), 'x<sup>2</sup> off** on**', chr(10), chr(10),
  'see ![image](data:image/png;base64,', {PICTURE_SQL}, ')[link](http://x/', c_custkey, ')[anchor](#here)')"""
QUERIES = {
    "foreign_docx_markdown": (docx_to_md, f"SELECT c_custkey AS doc_id, {MD} AS md, CAST(NULL AS VARCHAR) AS error FROM customer"),
    "docx_hwpx_docx_markdown": (docx_through_formats, f"SELECT c_custkey AS doc_id, {MD} AS md, CAST(NULL AS VARCHAR) AS error FROM customer"),
    "media_and_spans": (media_and_spans, "SELECT c_custkey AS doc_id, 1 AS n_images, md5(unhex('89504E47') || CAST(CAST(c_custkey AS VARCHAR) AS BLOB)) AS picture, 5 AS n_cells, 2 AS tallest, 2 AS widest, 1 AS n_merged FROM customer"),
    "resolved_docx_paragraphs": (resolved_paragraphs, """SELECT c_custkey AS doc_id, p.*, 30 + p.para AS shape_id FROM customer, LATERAL (
  SELECT 0 AS para, 'justify' AS align, 500 AS "left", 0 AS "right", 0 AS indent, 100 AS before, 0 AS after, 'FIXED' AS line_type, 1000 AS line_value, 0 AS level, false AS keep_next, false AS keep_lines, false AS break_before
  UNION ALL SELECT 1, 'right', CAST(5 * c_custkey AS INT), 0, -50, 0, 0, 'PERCENT', 115, CAST(c_custkey % 3 AS INT), true, false, true UNION ALL SELECT 2, 'left', 500, 0, 0, 0, 0, 'PERCENT', 200, 0, false, false, false) p"""),
    "resolved_docx_runs": (resolved_runs, """SELECT c_custkey AS doc_id, p.* FROM customer, (VALUES (0, 'plain', 1500, '112233', 'none', '1', false, 29), (0, 'marked', 1500, '112233', 'FFFF00', 'FFFF00', false, 30), (0, 'dark', 1500, 'FFFFFF', 'none', '6', false, 31),
  (0, 'boxed', 1500, '112233', 'none', '5', false, 32), (0, 'link', 1500, '0000FF', 'none', '1', true, 33), (0, 'own', 1200, 'AA0000', 'none', '1', false, 34), (1, 'plain', 1500, '112233', 'none', '1', false, 29), (2, 'plain', 1500, '112233', 'none', '1', false, 29)) p(para, text, size, color, shade, fill, underline, shape_id)"""),
    "foreign_hwpx_markdown": (hwpx_to_md, f"""SELECT c_custkey AS doc_id, concat('## Title ', c_custkey, chr(10), chr(10), 'shape three', chr(10), chr(10), '### head', chr(10), chr(10), '  2. item', chr(10), chr(10), '**bold** plain', chr(10), chr(10),
  '| tall | one<br>two |', chr(10), '| --- | --- |', chr(10), '| B |', chr(10), chr(10), '| deep ', c_custkey, ' |', chr(10), '| --- |', chr(10), chr(10), '![image](data:image/png;base64,', {PICTURE_SQL}, ')', chr(10), chr(10),
  '[link](http://x/', c_custkey, ') end', chr(10), c_name, chr(10), chr(10), 'last') AS md, CAST(NULL AS VARCHAR) AS error FROM customer"""),
    "broken_conversions": (outcomes, """SELECT 'docx' AS from_, t AS to_, CASE WHEN c_custkey % 7 = 0 OR c_custkey % 11 = 0 THEN 'error' ELSE 'ok' END AS status, count(*) AS n FROM customer, (VALUES ('md'), ('hwpx')) v(t) GROUP BY ALL"""),
    "record_fields": (record_fields, """SELECT p_partkey AS doc_id, CAST(p_size AS DOUBLE) AS size_pt, p_size % 4 >= 2 AS bold, p_size % 2 = 1 AS italic, p_partkey % 16777216 AS text_color, ['justify','left','right','center','distribute','divide'][p_size % 6 + 1] AS align,
  p_partkey AS "left", CASE WHEN p_size = 0 THEN 0 ELSE -p_size END AS "right", 7 AS indent, 8 AS before, 9 AS after, p_size AS line, p_size % 3 AS para_fill, concat(p_size, ' 3 FF0000') AS top_side, CASE WHEN p_size % 2 = 1 THEN '00FF00' END AS face, p_partkey AS w, p_partkey + 7 AS footer,
  p_size % 5 AS col, p_size % 7 AS row, 2 AS col_span, p_size + 1 AS row_span, p_partkey AS width, 50 AS height, p_size % 9 AS cell_fill FROM part"""),
    "hwp_markdown": (hwp_to_md, """SELECT c_custkey AS doc_id, concat('plain **', c_name, '**', chr(10), chr(10), '| left | right ', c_custkey, ' |', chr(10), '| --- | --- |', chr(10), chr(10), 'end ', c_custkey) AS md, CAST(NULL AS VARCHAR) AS error FROM customer"""),
}

"""Documents (content.DOCUMENT, a row each) to the parts of DOCX and HWPX packages and to flat XML: string expressions.

Runs of the body and those of cells are elements of arrays; one expression writes both. Tables are written from the
innermost ones outwards, a level an expression (below LEVELS a level a round). A document is one row, so nothing is joined
or shuffled on the way.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclake.functions.text import escape_xml, font_family
from doclake.operators.content import CELL_AT, ELEMENT_AT, RUN, rendered, struct_of
from doclake.operators.markdown import let
from doclake.operators.registry import FIRST_FACE, LANES
from doclake.sources.scratch import stored

HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
#: Namespaces and content types of the formats, fixed values.
W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PKG = "http://schemas.openxmlformats.org/package/2006"
DRAWING = "http://schemas.openxmlformats.org/drawingml/2006"
HP, HH, HC = (f"http://www.hancom.co.kr/hwpml/2011/{k}" for k in ("paragraph", "head", "core"))
OPF = "http://www.idpf.org/2007/opf/"
WORD_TYPE = "application/vnd.openxmlformats-officedocument.wordprocessingml.{}+xml"
#: Attributes of a run that make its shape.
SHAPE = ["bold", "italic", "underline", "strike", "sup", "sub", "font", "color", "size_pt"]
#: Paragraph shapes of HWPX: 0 is plain, 1 to 6 are headings, from LIST_SHAPE on there are two for each list level; then all
#: again for each alignment.
LIST_SHAPE, LIST_LEVELS = 7, 9
SHAPES = LIST_SHAPE + 2 * LIST_LEVELS
ALIGNS = ("left", "center", "right", "justify", "distribute")
EMU_PX = 9525
#: The page where a document tells none, in HWPUNIT: width, height, margins at top, bottom, left and right, of header, footer
#: and gutter.
A4_PAGE = (59530, 84190, 7200, 7200, 7200, 7200, 3600, 3600, 0)


def _text(x: Column) -> Column:
    return escape_xml(x, drop_control=True)


def _all(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _if(flag: Column, xml: str) -> Column:
    return F.when(F.coalesce(flag, F.lit(False)), xml).otherwise("")


def _some(value: Column, *parts: Column | str) -> Column:
    return F.when(value.isNotNull(), _all(*parts)).otherwise("")


def _part(name: str, ord_: int, xml: Column, when: Column | None = None) -> Column:
    part = F.struct(F.lit(ord_).alias("ord"), F.lit(name).alias("part"), F.encode(_all(HEAD, xml), "UTF-8").alias("bytes"))
    return part if when is None else F.when(when, part)


def _fields(x: Column) -> Callable[[str], Column]:
    return lambda name: x[name]


def _joined(xml: Column) -> Column:
    return F.array_join(xml, "")


def _lines(text: Column, between: str, wrap) -> Column:
    """The lines of a text, each wrapped, with what stands between them."""
    return F.array_join(F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), wrap), between)


# ---- what documents refer to


def _elements(keep: Callable[[Column], Column], made: Callable[[Column], Column]) -> Column:
    """made(run) of all runs that `keep` holds for, of the body and of cells, in the order of blocks."""
    of = lambda xs: F.transform(F.filter(xs, keep), made)
    return F.flatten(F.transform("blocks", lambda b: F.concat(of(b["runs"]), F.flatten(F.transform(b["cells"], lambda c: of(c["content"]))))))


def _images() -> Column:
    """no, med of all images that are there, by their number."""
    return F.sort_array(_elements(lambda x: x["med"].isNotNull(), lambda x: F.struct(x["no"].alias("no"), x["med"].alias("med"))))


def _of_media(med: Column, name: str) -> Column:
    return F.get(F.col("media"), med)[name]


def _ext(x: Column) -> Column:
    return F.substring_index(_of_media(x["med"], "mime"), "/", -1)


def _media_parts(folder: str) -> Column:
    """The image parts of a document."""
    name = lambda x: F.concat(F.lit(folder + "image"), x["no"].cast("string"), F.lit("."), _ext(x))
    return F.transform(_images(), lambda x: F.struct((x["no"] + 9).cast("int").alias("ord"), name(x).alias("part"), _of_media(x["med"], "bytes").alias("bytes")))


def _paged() -> dict[str, Column]:
    """begins, pages (a list of sections each, at least one) and margins with their number n from 1, of a document."""
    page = F.array(*[F.lit(x) for x in A4_PAGE])
    none, some = F.lit(-1).cast("long"), F.size("sections") > 0
    held = F.transform(F.sort_array("margins"), lambda x, i: F.struct(x["sec"].alias("sec"), x["kind"].alias("kind"), x["text"].alias("text"), (i + 1).alias("n")))
    return {"begins": F.when(some, F.transform("sections", lambda x: x["begin"])).otherwise(F.array(none)), "pages": F.when(some, F.transform("sections", lambda x: x["page"])).otherwise(F.array(page)), "margins": held}


def _each_margin(xml: Callable[[Column], Column], when: Callable[[Column], Column] = lambda x: F.lit(True), margins: Column | str = "margins") -> Column:
    return _joined(F.transform(F.filter(margins, when), xml))


# ---- tables and bodies


def _rows_of(cells: Column, cell: Callable[[Column], Column], opens: str, closes: str) -> Column:
    """The XML of cells in order, with what opens and closes each row around them."""
    before = lambda i: F.get(cells, i - 1)["row"]
    lead = lambda c, i: F.when(i == 0, opens).when(before(i) != c["row"], closes + opens).otherwise("")
    return F.concat(_joined(F.transform(cells, lambda c, i: F.concat(lead(c, i), cell(c)))), F.lit(closes))


#: Levels of tables within cells that one expression writes; the analyser of plans goes no deeper.
LEVELS = 2
TABLE = Callable[[Column, Callable[[Column], Column]], Column]


def _inner(x: Column) -> Column:
    return F.get("inner", x["no"])


def _at_level(level: int, table: TABLE, inner: Callable[[Column], Column]) -> Column:
    """The XML of the tables of a level, in order."""
    return F.transform(F.filter("blocks", lambda b: (b["kind"] == "table") & (b["level"] == level)), lambda b: table(b["cells"], inner))


def _with_inner(docs: DataFrame, deepest: int, tables: Callable[[int], Column]) -> tuple[DataFrame, int]:
    """Documents with `inner`, the XML of the tables below LEVELS, written a level a round; and the greatest level that is left."""
    docs = docs.withColumn("inner", F.lit(None).cast("array<string>"))
    while deepest > LEVELS:
        docs, deepest = stored(docs.withColumn("inner", tables(deepest))), deepest - 1
    return docs, deepest


def _flow(deepest: int, paragraph: Callable[[Column], Column], table: TABLE, held: Callable[[Column], Column] = lambda xml: xml) -> Column:
    """An array of blk, xml of the paragraphs, breaks and tables of a document. table(cells, inner) gives a table's XML, where
    inner(element) is a table within, and held() what stands around a table of the body."""

    def from_(level: int, inner: Callable[[Column], Column]) -> Column:
        if level:
            return let(_at_level(level, table, inner), lambda made: from_(level - 1, lambda x: F.get(made, x["no"])))
        body = F.filter("blocks", lambda b: (b["kind"] != "table") | (F.coalesce(b["level"], F.lit(0)) == 0))
        one = lambda b: F.struct(b["blk"].alias("blk"), F.when(b["kind"] == "table", held(table(b["cells"], inner))).otherwise(paragraph(b)).alias("xml"))
        return F.filter(F.transform(body, one), lambda x: x["xml"].isNotNull())

    return from_(deepest, _inner)


def _xml(flow: Column) -> Column:
    return _joined(F.transform(flow, lambda x: x["xml"]))


def _merged_below(cells: Column) -> Column:
    """Cells in order with the blank ones (row_span 0) below those of several rows, where they aren't there already."""
    blank = {"kind": F.lit("paragraph")}
    empty = F.array(F.struct(*[blank.get(k, F.lit(None)).cast(t).alias(k) for k, t in ELEMENT_AT.items()]))
    made = {"row_span": F.lit(0), "content": empty}
    below = lambda c: F.transform(F.sequence(F.lit(1), c["row_span"] - 1), lambda d: F.struct(*[made.get(k, c["row"] + d if k == "row" else c[k]).cast(t).alias(k) for k, t in CELL_AT.items()]))
    placed = lambda xs, nth: F.transform(xs, lambda c: F.struct(c["row"].alias("row"), c["col"].alias("col"), F.lit(nth).alias("nth"), c.alias("c")))
    tall = F.filter(cells, lambda c: c["row_span"] > 1)
    every = F.sort_array(F.concat(placed(cells, 0), placed(F.flatten(F.transform(tall, below)), 1)))
    first = lambda xs: F.filter(xs, lambda x, i: F.when(i == 0, F.lit(True)).otherwise((x["row"] != F.get(xs, i - 1)["row"]) | (x["col"] != F.get(xs, i - 1)["col"])))
    return F.when(F.exists(cells, lambda c: c["row_span"] > 1), F.transform(let(every, first), lambda x: x["c"])).otherwise(cells)


# ---- DOCX

_LEVELS = lambda fmt, text: "".join(f'<w:lvl w:ilvl="{i}"><w:start w:val="1"/><w:numFmt w:val="{fmt}"/><w:lvlText w:val="{text.format(i + 1)}"/></w:lvl>' for i in range(9))
#: Half-points of the headings, of this library's choice.
_HEADINGS = "".join(
    f'<w:style w:type="paragraph" w:styleId="Heading{n}"><w:name w:val="heading {n}"/><w:basedOn w:val="Normal"/><w:pPr><w:outlineLvl w:val="{n - 1}"/></w:pPr><w:rPr><w:b/><w:sz w:val="{size}"/></w:rPr></w:style>'
    for n, size in enumerate((32, 28, 26, 24, 22, 21), 1)
)
#: Parts that all packages of a kind share.
DOCX_FIXED = {part: HEAD + xml for part, xml in {
    "word/styles.xml": f'<w:styles xmlns:w="{W}"><w:style w:type="paragraph" w:default="1" w:styleId="Normal"><w:name w:val="Normal"/></w:style>{_HEADINGS}</w:styles>',
    "word/numbering.xml": f'<w:numbering xmlns:w="{W}"><w:abstractNum w:abstractNumId="0">{_LEVELS("bullet", "o")}</w:abstractNum><w:abstractNum w:abstractNumId="1">{_LEVELS("decimal", "%{}.")}</w:abstractNum>'
    '<w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num><w:num w:numId="2"><w:abstractNumId w:val="1"/></w:num></w:numbering>',
    "_rels/.rels": f'<Relationships xmlns="{PKG}/relationships"><Relationship Id="rId1" Type="{R}/officeDocument" Target="word/document.xml"/>'
    f'<Relationship Id="rId2" Type="{PKG}/relationships/metadata/core-properties" Target="docProps/core.xml"/></Relationships>',
}.items()}
_DEFAULTS = "".join(f'<Default Extension="{ext}" ContentType="{kind}"/>' for ext, kind in (("rels", "application/vnd.openxmlformats-package.relationships+xml"), ("xml", "application/xml"), *((e, f"image/{e}") for e in ("png", "jpeg", "gif", "webp"))))
_OVERRIDE = '<Override PartName="/{}" ContentType="{}"/>'
_OVERRIDES = "".join(_OVERRIDE.format(f"word/{name}.xml", WORD_TYPE.format(kind)) for name, kind in (("document", "document.main"), ("styles", "styles"), ("numbering", "numbering"))) + _OVERRIDE.format("docProps/core.xml", "application/vnd.openxmlformats-package.core-properties+xml")
NOTES = ("footnote", "endnote")


def _docx_run(c: Callable) -> Column:
    """A run's XML; c gives its columns."""
    as_text = lambda x: x.cast("string")
    pr = _all(
        "<w:rPr>", _some(c("font"), '<w:rFonts w:ascii="', _text(c("font")), '" w:hAnsi="', _text(c("font")), '" w:eastAsia="', _text(c("font")), '"/>'), _if(c("bold"), "<w:b/>"), _if(c("italic"), "<w:i/>"), _if(c("strike"), "<w:strike/>"),
        _some(c("color"), '<w:color w:val="', _text(c("color")), '"/>'), _some(c("size_pt"), '<w:sz w:val="', as_text(F.round(c("size_pt") * 2).cast("int")), '"/>'), _if(c("underline"), '<w:u w:val="single"/>'),
        _if(c("sup"), '<w:vertAlign w:val="superscript"/>'), _if(c("sub"), '<w:vertAlign w:val="subscript"/>'), "</w:rPr>",
    )
    run = _all("<w:r>", pr, _lines(c("text"), "<w:br/>", lambda t: F.when(t == "", "").otherwise(_all('<w:t xml:space="preserve">', _text(t), "</w:t>"))), "</w:r>")
    rel_id, number = _rel_id(c), F.when(c("med").isNotNull(), as_text(c("no")))
    size = [as_text(F.coalesce(_of_media(c("med"), k), F.lit(100)) * EMU_PX) for k in ("w", "h")]
    picture = _all(
        '<w:r><w:drawing><wp:inline><wp:extent cx="', size[0], '" cy="', size[1], '"/><wp:docPr id="', number, '" name="image', number, f'"/><a:graphic><a:graphicData uri="{DRAWING}/picture"><pic:pic><pic:nvPicPr><pic:cNvPr id="', number,
        '" name="image', number, '"/><pic:cNvPicPr/></pic:nvPicPr><pic:blipFill><a:blip r:embed="', rel_id, '"/><a:stretch><a:fillRect/></a:stretch></pic:blipFill><pic:spPr><a:xfrm><a:off x="0" y="0"/><a:ext cx="', size[0], '" cy="', size[1],
        '"/></a:xfrm><a:prstGeom prst="rect"><a:avLst/></a:prstGeom></pic:spPr></pic:pic></a:graphicData></a:graphic></wp:inline></w:drawing></w:r>',
    )
    note = F.when(c("no").isNotNull(), _all("<w:r><w:", c("note_kind"), 'Reference w:id="', as_text(c("no")), '"/></w:r>')).otherwise("")
    link = lambda xml: F.coalesce(_all('<w:hyperlink r:id="', rel_id, '">', xml, "</w:hyperlink>"), xml)
    plain = let(run, lambda xml: F.when(c("url").isNotNull(), link(xml)).otherwise(xml))
    return F.when(c("note_kind").isNotNull(), note).when(c("media_id").isNotNull(), F.coalesce(picture, F.lit(""))).otherwise(plain)


def _rel_id(c: Callable) -> Column:
    return F.concat(F.lit("rId"), (c("rel") + 1).cast("string"))


def _docx_opens(c: Callable) -> Column:
    style = _some(c("heading"), '<w:pStyle w:val="Heading', c("heading").cast("string"), '"/>')
    level = F.least(c("list_level"), F.lit(8)).cast("string")
    numbering = _some(c("list_level"), '<w:numPr><w:ilvl w:val="', level, '"/><w:numId w:val="', F.when(c("list_ordered"), "2").otherwise("1"), '"/></w:numPr>')
    align = _some(c("align"), '<w:jc w:val="', F.when(c("align") == "justify", "both").otherwise(c("align")), '"/>')
    return _all("<w:p><w:pPr>", style, numbering, align, "</w:pPr>")


def _docx_paragraphs(text: Column) -> Column:
    """A plain paragraph for each line."""
    return _lines(text, "", lambda t: _all('<w:p><w:r><w:t xml:space="preserve">', _text(t), "</w:t></w:r></w:p>"))


def _margin_name(x: Column) -> Column:
    return F.concat(x["kind"], x["n"].cast("string"))


def _sect_pr(page: Column, sec: Column) -> Column:
    """A page in HWPUNIT as section properties, in twips, with the headers and footers of the section `sec`."""
    named = _each_margin(lambda x: _all("<w:", x["kind"], 'Reference w:type="default" r:id="rId_', _margin_name(x), '"/>'), lambda x: x["sec"] == sec)
    size = lambda i: F.floor(F.get(page, F.lit(i)) / 5).cast("string")
    wide = F.when(F.get(page, F.lit(0)) > F.get(page, F.lit(1)), ' w:orient="landscape"').otherwise("")
    return _all(
        '<w:sectPr>', named, '<w:pgSz w:w="', size(0), '" w:h="', size(1), '"', wide, '/><w:pgMar w:top="', size(2), '" w:right="', size(5), '" w:bottom="', size(3), '" w:left="', size(4),
        '" w:header="', size(6), '" w:footer="', size(7), '" w:gutter="', size(8), '"/></w:sectPr>',
    )


def _docx_tables() -> TABLE:
    """A table's XML."""

    def cell(c: Column, inner) -> Column:
        span = F.when(c["col_span"] > 1, _all('<w:gridSpan w:val="', c["col_span"].cast("string"), '"/>')).otherwise("")
        merge = F.when(c["row_span"] > 1, '<w:vMerge w:val="restart"/>').when(c["row_span"] == 0, "<w:vMerge/>").otherwise("")
        inside = rendered(c["content"], _docx_opens, "</w:p>", _docx_run, inner, "<w:p/>")
        return _all("<w:tc><w:tcPr>", span, merge, "</w:tcPr>", inside, "</w:tc>")

    def grid(cells: Column) -> Column:
        """How many columns the widest row has."""
        start = F.struct(F.lit(-1).alias("row"), F.lit(0).alias("wide"), F.lit(0).alias("most"))
        wide = lambda a, c: F.when(a["row"] == c["row"], a["wide"]).otherwise(0) + c["col_span"]
        more = lambda a, c: F.struct(c["row"].alias("row"), wide(a, c).alias("wide"), F.greatest(a["most"], wide(a, c)).alias("most"))
        return F.aggregate(cells, start, more)["most"]

    def table(cells: Column, inner) -> Column:
        xml = lambda own: _all('<w:tbl><w:tblPr><w:tblW w:w="0" w:type="auto"/></w:tblPr><w:tblGrid>', F.repeat(F.lit("<w:gridCol/>"), grid(own)), "</w:tblGrid>", _rows_of(own, lambda c: cell(c, inner), "<w:tr>", "</w:tr>"), "</w:tbl>")
        return F.when(F.size(cells) > 0, let(_merged_below(cells), xml))

    return table


@functools.lru_cache(16)
def _docx(context: SparkContext, deepest: int) -> Column:
    """The parts of a document; kept, as it takes seconds to put together."""
    def paragraph(b: Column) -> Column:
        inline = _joined(F.transform(b["runs"], lambda r: _docx_run(_fields(r))))
        return F.when(b["kind"] == "pageBreak", '<w:p><w:r><w:br w:type="page"/></w:r></w:p>').otherwise(_all(_docx_opens(_fields(b)), inline, "</w:p>"))

    # a section's end stands behind its last block
    several = F.size("begins") > 1
    ends = F.transform(F.slice("pages", F.lit(1), F.size("pages") - 1), lambda page, i: F.struct((F.get("begins", i + 1) * 2 + 1).alias("blk"), _all("<w:p><w:pPr>", _sect_pr(page, i), "</w:pPr></w:p>").alias("xml")))
    twice = lambda f: F.transform(f, lambda x: F.struct((x["blk"] * 2).alias("blk"), x["xml"].alias("xml")))
    flow = let(_flow(deepest, paragraph, _docx_tables()), lambda f: F.when(several, F.sort_array(F.concat(twice(f), ends))).otherwise(f))
    name = lambda x: F.concat(F.lit("media/image"), x["no"].cast("string"), F.lit("."), _ext(x))
    target = lambda x: F.when(x["med"].isNull(), _all(f'" Type="{R}/hyperlink" Target="', _text(x["url"]), '" TargetMode="External"/>')).otherwise(_all(f'" Type="{R}/image" Target="', name(x), '"/>'))
    linked = F.sort_array(_elements(lambda x: x["rel"].isNotNull(), lambda x: F.struct(x["rel"].alias("rel"), _all('<Relationship Id="', _rel_id(_fields(x)), target(x)).alias("xml"))))
    # a note's paragraphs: a line each
    note = lambda k: lambda x: F.struct(x["no"].alias("no"), _all(f'<w:{k} w:id="', x["no"].cast("string"), '">', _docx_paragraphs(x["note"]), f"</w:{k}>").alias("xml"))
    has = lambda k: lambda x: (x["note_kind"] == k) & x["no"].isNotNull()
    told = {k: F.nullif(_xml(F.sort_array(_elements(has(k), note(k)))), F.lit("")) for k in NOTES}
    about = {k: F.coalesce(k, F.lit("")) for k in ("title", "author", "subject")}
    names = f'xmlns:w="{W}" xmlns:r="{R}" xmlns:a="{DRAWING}/main" xmlns:pic="{DRAWING}/picture" xmlns:wp="{DRAWING}/wordprocessingDrawing"'
    rel = lambda id_, kind, file: f'<Relationship Id="{id_}" Type="{R}/{kind}" Target="{file}.xml"/>'
    any_ = lambda is_: F.exists("blocks", lambda b: F.exists(b["runs"], is_) | F.exists(b["cells"], lambda c: F.exists(c["content"], is_)))
    noted = {k: any_(has(k)) for k in NOTES}
    own = lambda k, i: lambda xml: _part(f"word/{k}s.xml", i, _all(f'<w:{k}s xmlns:w="{W}">', xml, f"</w:{k}s>"), xml.isNotNull())
    parts = lambda f: [
        _part("word/document.xml", 1, _all(f"<w:document {names}><w:body>", _xml(f), _sect_pr(F.element_at("pages", -1), F.size("pages") - 1), "</w:body></w:document>")),
        _part("word/_rels/document.xml.rels", 2, _all(
            f'<Relationships xmlns="{PKG}/relationships">', rel("rId1", "styles", "styles"), rel("rIdLists", "numbering", "numbering"), *[_if(noted[k], rel(f"rId_{k}s", f"{k}s", f"{k}s")) for k in NOTES], _each_margin(lambda x: _all('<Relationship Id="rId_', _margin_name(x), f'" Type="{R}/', x["kind"], '" Target="', _margin_name(x), '.xml"/>')), _xml(linked), "</Relationships>")),
        _part("docProps/core.xml", 3, _all(f'<cp:coreProperties xmlns:cp="{PKG}/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>', _text(about["title"]), "</dc:title><dc:creator>", _text(about["author"]), "</dc:creator><dc:subject>", _text(about["subject"]), "</dc:subject></cp:coreProperties>")),
        _part("[Content_Types].xml", 0, _all(f'<Types xmlns="{PKG}/content-types">{_DEFAULTS}{_OVERRIDES}', *[_if(noted[k], _OVERRIDE.format(f"word/{k}s.xml", WORD_TYPE.format(f"{k}s"))) for k in NOTES], _each_margin(lambda x: _all('<Override PartName="/word/', _margin_name(x), '.xml" ContentType="', *[y for p in WORD_TYPE.split("{}") for y in (p, x["kind"])][:-1], '"/>')), "</Types>")),
        *[let(told[k], own(k, 4 + i)) for i, k in enumerate(NOTES)],
    ]
    tag = lambda x: F.when(x["kind"] == "header", "hdr").otherwise("ftr")
    more = F.transform("margins", lambda x: F.struct(
        (x["n"] + 99).cast("int").alias("ord"), F.concat(F.lit("word/"), _margin_name(x), F.lit(".xml")).alias("part"),
        F.encode(_all(HEAD, "<w:", tag(x), f' xmlns:w="{W}">', _docx_paragraphs(x["text"]), "</w:", tag(x), ">"), "UTF-8").alias("bytes")))
    whole = lambda f: F.concat(F.filter(F.array(*parts(f)), lambda p: p.isNotNull()), more, _media_parts("word/media/"))
    return let(flow, lambda f: F.when(F.size(f) > 0, whole(f)))


def docx_parts(docs: DataFrame, deepest: int = 0) -> DataFrame:
    """doc_id, parts of DOCX packages: what DOCX_FIXED doesn't have; error, warnings. A section's page stands in a paragraph of
    its own at its end, the last one's at the end of the body."""
    docs, deepest = _with_inner(docs, deepest, lambda level: _at_level(level, _docx_tables(), _inner))
    return docs.withColumns(_paged()).select("doc_id", _docx(docs.sparkSession.sparkContext, deepest).alias("parts"), "error", "warnings")


# ---- HWPX

_NO_LINE = "".join(f'<hh:{s}Border type="NONE" width="0.1 mm" color="#000000"/>' for s in ("left", "right", "top", "bottom"))
#: Border fill 1 has no lines, 2 is that of cells.
_FILLS = f'<hh:borderFills itemCnt="2"><hh:borderFill id="1">{_NO_LINE}</hh:borderFill><hh:borderFill id="2">{_NO_LINE.replace("NONE", "SOLID").replace("0.1 mm", "0.12 mm")}</hh:borderFill></hh:borderFills>'
_NUMBERS = '<hh:numberings itemCnt="1"><hh:numbering id="1" start="1">' + "".join(f'<hh:paraHead level="{n}" start="1" numFormat="DIGIT">^{n}.</hh:paraHead>' for n in range(1, 8)) + '</hh:numbering></hh:numberings><hh:bullets itemCnt="1"><hh:bullet id="1" char="●"/></hh:bullets>'


def _paragraph_shapes() -> str:
    out = []
    for align in (None, *ALIGNS):
        said = "" if align is None else f'<hh:align horizontal="{align.upper()}" vertical="BASELINE"/>'
        heads = [f'type="{"OUTLINE" if n else "NONE"}" level="{n}"' for n in range(LIST_SHAPE)] + [f'type="{k}" idRef="1" level="{n}"' for n in range(LIST_LEVELS) for k in ("BULLET", "NUMBER")]
        out += [f'{said}<hh:heading {x}/><hh:border borderFillIDRef="1"/>' for x in heads]
    return f'<hh:paraProperties itemCnt="{len(out)}">' + "".join(f'<hh:paraPr id="{n}">{x}</hh:paraPr>' for n, x in enumerate(out)) + "</hh:paraProperties>"


_STYLES = f'<hh:styles itemCnt="{LIST_SHAPE}">' + "".join(f'<hh:style id="{n}" type="PARA" name="{f"heading {n}" if n else "Normal"}" paraPrIDRef="{n}" charPrIDRef="0" nextStyleIDRef="0"/>' for n in range(LIST_SHAPE)) + "</hh:styles>"
HWPX_FIXED = {
    "version.xml": f'{HEAD}<hv:HCFVersion xmlns:hv="http://www.hancom.co.kr/hwpml/2011/version" tagetApplication="WORDPROCESSOR" major="5" minor="1" micro="0" buildNumber="1"/>',
    "settings.xml": f'{HEAD}<ha:HWPApplicationSetting xmlns:ha="http://www.hancom.co.kr/hwpml/2011/app"><ha:CaretPosition listIDRef="0" paraIDRef="0" pos="0"/></ha:HWPApplicationSetting>',
    "META-INF/container.xml": f'{HEAD}<ocf:container xmlns:ocf="urn:oasis:names:tc:opendocument:xmlns:container"><ocf:rootfiles><ocf:rootfile full-path="Contents/content.hpf" media-type="application/hwpml-package+xml"/></ocf:rootfiles></ocf:container>',
}


def _hwpx_paragraphs(text: Column) -> Column:
    """A plain paragraph for each line."""
    return _lines(text, "", lambda t: _all('<hp:p paraPrIDRef="0" styleIDRef="0"><hp:run charPrIDRef="0"><hp:t>', _text(t), "</hp:t></hp:run></hp:p>"))


def _sec_pr(page: Column, sec: Column, margins: Column) -> Column:
    """The paragraph that the section `sec` begins with, for its page, headers and footers."""
    told = _each_margin(lambda x: _all('<hp:run charPrIDRef="0"><hp:ctrl><hp:', x["kind"], ' id="', x["n"].cast("string"), '" applyPageType="BOTH"><hp:subList>', _hwpx_paragraphs(x["text"]), "</hp:subList></hp:", x["kind"], "></hp:ctrl></hp:run>"), lambda x: x["sec"] == sec, margins)
    size = lambda i: F.get(page, F.lit(i)).cast("string")
    return _all(
        '<hp:p paraPrIDRef="0" styleIDRef="0"><hp:run charPrIDRef="0"><hp:secPr><hp:pagePr landscape="WIDELY" width="', size(0), '" height="', size(1), '" gutterType="LEFT_ONLY"><hp:margin left="', size(4), '" right="', size(5),
        '" top="', size(2), '" bottom="', size(3), '" header="', size(6), '" footer="', size(7), '" gutter="', size(8), '"/></hp:pagePr></hp:secPr></hp:run>', told, "</hp:p>",
    )


def _shape_key(c: Callable) -> Column:
    return F.struct(*[c(k).alias(k) for k in SHAPE])


def _char_shapes() -> Column:
    """The distinct styles of runs, by first appearance."""
    is_text = lambda x: x["media_id"].isNull() & x["note_kind"].isNull()
    of = lambda xs: F.transform(F.filter(xs, is_text), lambda x: _shape_key(_fields(x)))
    in_cells = lambda b: F.flatten(F.transform(b["cells"], lambda c: of(F.filter(c["content"], lambda x: x["kind"] == "run"))))
    return F.array_distinct(F.flatten(F.transform("blocks", lambda b: F.concat(of(b["runs"]), in_cells(b)))))


def _char_xml(k: Column, id_: Column, fonts: Column) -> Column:
    font = F.coalesce(F.array_position(fonts, k["font"]), F.lit(0)).cast("string")
    lanes = [lane.lower() for names in LANES.values() for lane in names]
    return _all(
        '<hh:charPr id="', id_.cast("string"), '" height="', F.round(F.coalesce(k["size_pt"], F.lit(10.0)) * 100).cast("int").cast("string"), '" textColor="#', _text(F.coalesce(k["color"], F.lit("000000"))), '" borderFillIDRef="1"><hh:fontRef',
        *[x for lane in lanes for x in (f' {lane}="', font, '"')], "/>", _if(k["bold"], "<hh:bold/>"), _if(k["italic"], "<hh:italic/>"), _if(k["underline"], '<hh:underline type="BOTTOM" shape="SOLID" color="#000000"/>'),
        _if(k["strike"], '<hh:strikeout shape="SOLID" color="#000000"/>'), _if(k["sup"], "<hh:supscript/>"), _if(k["sub"], "<hh:subscript/>"), "</hh:charPr>",
    )


def _hwpx_run(c: Callable, keys: Column) -> Column:
    number = F.array_position(keys, _shape_key(c)).cast("string")
    opened = _all('<hp:run charPrIDRef="0"><hp:ctrl><hp:fieldBegin type="HYPERLINK" url="', _text(c("url")), '"/></hp:ctrl></hp:run>')
    run = _all('<hp:run charPrIDRef="', number, '"><hp:t>', _lines(c("text"), "<hp:lineBreak/>", _text), "</hp:t></hp:run>")
    picture = _all('<hp:run charPrIDRef="0"><hp:pic><hc:img binaryItemIDRef="image', F.when(c("med").isNotNull(), c("no").cast("string")), '"/></hp:pic></hp:run>')
    tag = F.when(c("note_kind") == "endnote", "hp:endNote").otherwise("hp:footNote")
    lines = _hwpx_paragraphs(c("note"))
    note = _all('<hp:run charPrIDRef="0"><hp:ctrl><', tag, ' number="', c("no").cast("string"), '"><hp:subList>', lines, "</hp:subList></", tag, "></hp:ctrl></hp:run>")
    link = _all(opened, run, '<hp:run charPrIDRef="0"><hp:ctrl><hp:fieldEnd/></hp:ctrl></hp:run>')
    return F.when(c("note_kind").isNotNull(), F.coalesce(note, F.lit(""))).when(c("media_id").isNotNull(), F.coalesce(picture, F.lit(""))).when(c("url").isNotNull(), link).otherwise(run)


def _hwpx_opens(c: Callable, more: Column | str = "") -> Column:
    listed = F.when(c("list_level").isNotNull(), LIST_SHAPE + 2 * F.least(c("list_level"), F.lit(LIST_LEVELS - 1)) + F.coalesce(c("list_ordered"), F.lit(False)).cast("int"))
    align = F.coalesce(F.array_position(F.array(*[F.lit(a) for a in ALIGNS]), c("align")), F.lit(0)) * SHAPES
    shape = F.coalesce(c("heading"), listed, F.lit(0)) + align
    return _all('<hp:p paraPrIDRef="', shape.cast("string"), '" styleIDRef="', F.coalesce(c("heading"), F.lit(0)).cast("string"), '"', more, ">")


_HOLDER = '<hp:p paraPrIDRef="0" styleIDRef="0"><hp:run charPrIDRef="0">'


def _hwpx_held(xml: Column) -> Column:
    return _all(_HOLDER, xml, "</hp:run></hp:p>")


def _hwpx_tables(keys: Column) -> TABLE:
    """A table's XML, with the styles of runs that `keys` lists."""

    def cell(c: Column, inner) -> Column:
        as_text = lambda n: c[n].cast("string")
        inside = rendered(c["content"], _hwpx_opens, "</hp:p>", lambda x: _hwpx_run(x, keys), lambda x: _hwpx_held(inner(x)), '<hp:p paraPrIDRef="0" styleIDRef="0"/>')
        return _all(
            '<hp:tc borderFillIDRef="2"><hp:subList>', inside, '</hp:subList><hp:cellAddr colAddr="', as_text("col"), '" rowAddr="', as_text("row"),
            '"/><hp:cellSpan colSpan="', as_text("col_span"), '" rowSpan="', as_text("row_span"), '"/></hp:tc>',
        )

    def table(cells: Column, inner) -> Column:
        most = lambda own, of: F.array_max(F.transform(own, of)).cast("string")
        xml = lambda own: _all('<hp:tbl rowCnt="', most(own, lambda c: c["row"] + 1), '" colCnt="', most(own, lambda c: c["col"] + c["col_span"]), '" borderFillIDRef="2">', _rows_of(own, lambda c: cell(c, inner), "<hp:tr>", "</hp:tr>"), "</hp:tbl>")
        return let(F.filter(cells, lambda c: c["row_span"] > 0), lambda own: F.when(F.size(own) > 0, xml(own)))

    return table


@functools.lru_cache(16)
def _hwpx(context: SparkContext, deepest: int) -> Column:
    """The parts of a document; kept, as it takes seconds to put together."""

    def flow(keys: Column) -> Column:
        def paragraph(b: Column) -> Column:
            breaks = F.when(b["kind"] == "pageBreak", ' pageBreak="1"').otherwise("")
            return _all(_hwpx_opens(_fields(b), breaks), _joined(F.transform(b["runs"], lambda r: _hwpx_run(_fields(r), keys))), "</hp:p>")

        return _flow(deepest, paragraph, _hwpx_tables(keys), _hwpx_held)

    # a block is in the last section that begins before it; a section without blocks has no part
    sec = lambda blk: F.greatest(F.size(F.filter("begins", lambda b: b < blk)) - 1, F.lit(0))
    one = lambda f: F.array(F.struct(F.lit(0).alias("sec"), _xml(f).alias("body")))
    numbered = lambda f: F.transform(f, lambda x: F.struct(sec(x["blk"]).alias("sec"), x["xml"].alias("xml")))
    each = lambda g: F.transform(F.array_distinct(F.transform(g, lambda x: x["sec"])), lambda s: F.struct(s.alias("sec"), _xml(F.filter(g, lambda x: x["sec"] == s)).alias("body")))
    in_sections = lambda f: F.when(F.size(f) == 0, F.array().cast("array<struct<sec:int,body:string>>")).when(F.size("begins") > 1, let(numbered(f), each)).otherwise(one(f))
    item = lambda x: _all('<opf:item id="image', x["no"].cast("string"), '" href="BinData/image', x["no"].cast("string"), ".", _ext(x), '" media-type="', _of_media(x["med"], "mime"), '" isEmbeded="1"/>')
    file = lambda x: _all('<odf:file-entry odf:full-path="BinData/image', x["no"].cast("string"), ".", _ext(x), '" odf:media-type="', _of_media(x["med"], "mime"), '"/>')
    images = lambda xml: let(_images(), lambda xs: _joined(F.transform(xs, xml)))
    said = lambda c: F.coalesce(c, F.lit(""))
    about = lambda name, c: F.when(said(c) != "", _all(f'<opf:meta name="{name}" content="text">', _text(F.col(c)), "</opf:meta>")).otherwise("")
    lanes = [lane for names in LANES.values() for lane in names]
    plain = F.struct(*[F.lit(None).cast(RUN[k]).alias(k) for k in SHAPE])

    def header(keys: Column, many: Column) -> Column:
        fonts = F.array_distinct(F.filter(F.transform(keys, lambda k: k["font"]), lambda f: f.isNotNull()))

        def xml(fonts: Column) -> Column:
            faces = _joined(F.transform(fonts, lambda f, i: _all('<hh:font id="', (i + 1).cast("string"), '" face="', _text(f), '" type="TTF" isEmbedded="0"><hh:typeInfo familyType="', font_family(f), '"/></hh:font>')))
            count = (F.size(fonts) + 1).cast("string")
            listed = lambda faces: _all(f'<hh:fontfaces itemCnt="{len(lanes)}">', *[x for lane in lanes for x in (f'<hh:fontface lang="{lane}" fontCnt="', count, f'"><hh:font id="0" face="{FIRST_FACE}" type="TTF" isEmbedded="0"/>', faces, "</hh:fontface>")], "</hh:fontfaces>")
            chars = _all('<hh:charProperties itemCnt="', (F.size(keys) + 1).cast("string"), '">', _char_xml(plain, F.lit(0), fonts), _joined(F.transform(keys, lambda k, i: _char_xml(k, i + 1, fonts))), "</hh:charProperties>")
            return _all(f'<hh:head xmlns:hh="{HH}" xmlns:hc="{HC}" version="1.4" secCnt="', many.cast("string"), '"><hh:refList>', let(faces, listed), _FILLS, chars, f"{_NUMBERS}{_paragraph_shapes()}{_STYLES}</hh:refList></hh:head>")

        return let(fonts, xml)

    entry = lambda name: f'<odf:file-entry odf:full-path="{name}" odf:media-type="application/xml"/>'
    fixed = "".join(map(entry, ("version.xml", "settings.xml", "Contents/header.xml", "Contents/content.hpf")))
    name = ("Contents/section", None, ".xml")
    open_ = f'{HEAD}<hs:sec xmlns:hs="http://www.hancom.co.kr/hwpml/2011/section" xmlns:hp="{HP}" xmlns:hc="{HC}">'

    def margins(bodies: Column) -> Column:
        """A section without a part: what it tells goes to the next one that doesn't tell the same."""
        heir = lambda x: F.coalesce(F.array_min(F.filter(F.transform(bodies, lambda b: b["sec"]), lambda s: s >= x["sec"])), F.lit(-1))
        last = lambda moved: lambda x, i: ~F.exists(F.slice(moved, i + 2, F.size(moved)), lambda y: (y["sec"] == x["sec"]) & (y["kind"] == x["kind"]))
        return let(F.transform("margins", lambda x: x.withField("sec", heir(x))), lambda moved: F.filter(moved, last(moved)))

    def parts(keys: Column, bodies: Column) -> Column:
        of_each = lambda xml: _joined(F.transform(bodies, lambda b, i: _all(*[i.cast("string") if x is None else x for x in xml])))
        listed, read = of_each(('<opf:item id="section', None, '" href="', *name, '" media-type="application/xml"/>')), of_each(('<opf:itemref idref="section', None, '"/>'))
        files = of_each(('<odf:file-entry odf:full-path="', *name, '" odf:media-type="application/xml"/>'))
        page = lambda sec: F.get("pages", sec)
        written = let(margins(bodies), lambda told: F.transform(bodies, lambda b, i: F.struct(
            (F.lit(100) + i).cast("int").alias("ord"), F.concat(F.lit("Contents/section"), i.cast("string"), F.lit(".xml")).alias("part"), F.encode(_all(open_, _sec_pr(page(b["sec"]), b["sec"], told), b["body"], "</hs:sec>"), "UTF-8").alias("bytes"))))
        own = [
            F.struct(F.lit(0).alias("ord"), F.lit("mimetype").alias("part"), F.encode(F.lit("application/hwp+zip"), "UTF-8").alias("bytes")),
            _part("Contents/header.xml", 1, header(keys, F.size(bodies))),
            _part("Contents/content.hpf", 3, _all(f'<opf:package xmlns:opf="{OPF}"><opf:metadata><opf:title>', _text(said("title")), "</opf:title>", about("creator", "author"), about("subject", "subject"),
                '</opf:metadata><opf:manifest><opf:item id="header" href="Contents/header.xml" media-type="application/xml"/><opf:item id="settings" href="settings.xml" media-type="application/xml"/>', listed, images(item),
                '</opf:manifest><opf:spine><opf:itemref idref="header"/>', read, "</opf:spine></opf:package>")),
            _part("META-INF/manifest.xml", 4, _all(f'<odf:manifest xmlns:odf="urn:oasis:names:tc:opendocument:xmlns:manifest:1.0">{fixed}', files, images(file), "</odf:manifest>")),
        ]
        return F.when(F.size(bodies) > 0, F.concat(F.array(*own), written, _media_parts("BinData/")))

    return let(_char_shapes(), lambda keys: let(let(flow(keys), in_sections), lambda bodies: parts(keys, bodies)))


def hwpx_parts(docs: DataFrame, deepest: int = 0) -> DataFrame:
    """doc_id, parts of HWPX packages but for HWPX_FIXED, a section a part; error, warnings. Equal run styles share a character
    shape, headings, list levels and alignments have a paragraph shape each, fonts are listed once for all scripts."""
    docs, deepest = _with_inner(docs, deepest, lambda level: let(_char_shapes(), lambda keys: _at_level(level, _hwpx_tables(keys), _inner)))
    return docs.withColumns(_paged()).select("doc_id", _hwpx(docs.sparkSession.sparkContext, deepest).alias("parts"), "error", "warnings")


# ---- flat XML


def hml(docs: DataFrame, deepest: int = 0) -> DataFrame:
    """doc_id, xml, error, warnings: one flat XML text for each document that has blocks."""
    char = lambda c: _all("<CHAR>", _text(F.coalesce(c("text"), F.lit(""))), "</CHAR>")
    opens = lambda c, more="": _all('<P ParaShape="', F.coalesce(c("heading"), F.lit(0)).cast("string"), '"', more, '><TEXT CharShape="0">')

    def paragraph(b: Column) -> Column:
        breaks = F.when(b["kind"] == "pageBreak", ' PageBreak="true"').otherwise("")
        return _all(opens(_fields(b), breaks), _joined(F.transform(b["runs"], lambda r: char(_fields(r)))), "</TEXT></P>")

    def cell(c: Column, inner) -> Column:
        number = {n: c[n].cast("string") for n in ("col", "row", "col_span", "row_span")}
        inside = rendered(c["content"], opens, "</TEXT></P>", char, lambda x: _held(inner(x)), "<P><TEXT><CHAR/></TEXT></P>")
        return _all('<CELL ColAddr="', number["col"], '" RowAddr="', number["row"], '" ColSpan="', number["col_span"], '" RowSpan="', number["row_span"], '"><PARALIST>', inside, "</PARALIST></CELL>")

    _held = lambda xml: _all("<P><TEXT>", xml, "</TEXT></P>")
    xml = lambda own, inner: _all("<TABLE>", _rows_of(own, lambda c: cell(c, inner), "<ROW>", "</ROW>"), "</TABLE>")
    table = lambda cells, inner: let(F.filter(cells, lambda c: c["row_span"] > 0), lambda own: F.when(F.size(own) > 0, xml(own, inner)))
    head = _all(HEAD, '<HWPML Version="2.91"><HEAD><DOCSUMMARY><TITLE>', _text(F.coalesce("title", F.lit(""))), "</TITLE></DOCSUMMARY></HEAD><BODY><SECTION>")
    docs, deepest = _with_inner(docs, deepest, lambda level: _at_level(level, table, _inner))
    whole = let(_flow(deepest, paragraph, table, _held), lambda f: F.when(F.size(f) > 0, _all(head, _xml(f), "</SECTION></BODY></HWPML>")))
    return docs.select("doc_id", whole.alias("xml"), "error", "warnings")

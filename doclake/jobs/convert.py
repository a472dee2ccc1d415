"""Conversions between formats: a reader to the flat tables, then a writer; own ones can be added."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from doclake.functions.media import sniff_mime
from doclake.operators import markdown as m
from doclake.operators import nested, packages, records, render, styles, tables
from doclake.operators.content import BLOCK, DOCUMENT, ELEMENT, ELEMENT_AT, PARAGRAPH, RUN, RUN_AT, complete, of_lines, tidy
from doclake.operators.markdown import let
from doclake.sources import package, xmlrows
from doclake.sources.documents import docx_documents, hwpx_documents
from doclake.sources.scratch import passing, stored


@dataclass
class Ir:
    """The flat tables that all readers give, or documents that they are made of; documents() gives writers the latter.

    blocks: doc_id, blk, kind, heading, list_level, list_ordered, align, level (of a table: how many are around it); runs of
    the body: doc_id, blk, pos and content.RUN; cells: doc_id, blk (their table), row, col, spans, content (content.ELEMENT).
    """

    blocks: DataFrame
    runs: DataFrame
    cells: DataFrame
    meta: DataFrame
    #: doc_id, error of documents that could not be read whole, and warnings: how many things in them no writer knows
    errors: DataFrame | None = None
    #: doc_id, media_id, mime, bytes of images; runs name them
    media: DataFrame | None = None
    #: the greatest level of a table
    deepest: int = 0
    #: doc_id, begin (a section's blocks have a greater blk, and those before the next one's), page (xmlrows.PAGE_OF)
    sections: DataFrame | None = None
    #: doc_id, sec (from 0), kind (header, footer), text: a line a paragraph; a section without has that of the one before
    margins: DataFrame | None = None
    #: the documents as one row each (content.DOCUMENT), written, if that is what the reader gives; the tables are made of it
    docs: DataFrame | None = None

    def written(self) -> Ir:
        """The tables written once, for who reads them several times; media are, as parts of a package."""
        if self.docs is not None:
            return self
        return replace(self, **{k: stored(v) for k in ("blocks", "runs", "cells", "meta", "errors", "sections", "margins") if (v := getattr(self, k)) is not None})


RUN_FLAGS = ("bold", "italic", "underline", "strike", "sup", "sub")


def _of_documents(docs: DataFrame, deepest: int, errors: bool = True) -> Ir:
    tables_ = nested.flat(docs)
    return Ir(**tables_ | ({} if errors else {"errors": None, "media": None, "margins": None}), deepest=deepest, docs=docs)


def documents(ir: Ir) -> DataFrame:
    """The documents of a reader, of flat tables if it gives no others."""
    return ir.docs if ir.docs is not None else nested.nest(ir)


def _md_block(b: Column) -> Column:
    """A block of Markdown with its runs or its cells."""
    none = lambda kind: F.array().cast(kind)
    run = lambda columns: _typed(dict(zip(MD_RUN, columns, strict=True)), RUN_AT)
    placed = lambda runs: F.transform(runs, lambda r, i: r.withField("pos", i.cast("long")))
    code = F.array(_typed({"pos": F.lit(0), "text": b["text"], "font": b["font"]}, RUN_AT))
    runs = F.when(b["kind"] != "paragraph", none(BLOCK["runs"])).when(b["font"].isNotNull(), code).otherwise(placed(m.inline_array(b["text"], run)))
    element_ = lambda columns: _typed({"kind": F.lit("run")} | dict(zip(MD_RUN, columns, strict=True)), ELEMENT_AT)
    content = lambda text: F.concat(F.array(_typed({"kind": F.lit("paragraph")}, ELEMENT_AT)), m.inline_array(F.trim(text), element_))
    cell = lambda row, col, text: F.struct(row.alias("row"), col.alias("col"), F.lit(1).alias("row_span"), F.lit(1).alias("col_span"), content(text).alias("content"))
    cells = F.flatten(F.transform(F.filter(b["rows"], lambda raw: ~raw.rlike(m.TABLE_SEP)), lambda raw, row: F.transform(m.row_cells(raw), lambda text, col: cell(row, col, text))))
    given = {k: b[k] for k in ("blk", "kind", "heading", "list_level", "list_ordered")}
    return _typed(given | {"runs": F.coalesce(runs, none(BLOCK["runs"])), "cells": F.when(b["kind"] == "table", cells).otherwise(none(BLOCK["cells"]))}, BLOCK)


def _typed(given: dict[str, Column], fields: dict[str, str]) -> Column:
    return F.struct(*[given.get(k, F.lit(None)).cast(t).alias(k) for k, t in fields.items()])


def _links_numbered(blocks: Column) -> Column:
    """The blocks of Markdown with the numbers of their links (rel), in order."""
    has = lambda x: x["url"].isNotNull()
    many = lambda xs: F.size(F.filter(xs, has))
    in_cells = lambda cells: F.aggregate(cells, F.lit(0), lambda n, c: n + many(c["content"]))
    sums = lambda counts: F.aggregate(counts, F.array(F.lit(0)), lambda a, n: F.array_append(a, F.element_at(a, -1) + n))
    numbered = lambda xs, before: F.when(many(xs) > 0, F.transform(xs, lambda x, i: F.when(has(x), x.withField("rel", before + many(F.slice(xs, F.lit(1), i + 1)))).otherwise(x))).otherwise(xs)

    def of_cells(cells: Column, before: Column) -> Column:
        return let(sums(F.transform(cells, lambda c: many(c["content"]))), lambda at: F.transform(cells, lambda c, i: c.withField("content", numbered(c["content"], before + F.get(at, i)))))

    def whole(b: Column, before: Column) -> Column:
        cells = F.when(in_cells(b["cells"]) > 0, of_cells(b["cells"], before)).otherwise(b["cells"])
        return F.when(many(b["runs"]) > 0, b.withField("runs", numbered(b["runs"], before))).otherwise(b.withField("cells", cells))

    every = lambda counts: let(sums(counts), lambda at: F.transform(blocks, lambda b, i: F.when(F.get(counts, i) > 0, whole(b, F.get(at, i))).otherwise(b)))
    counted = F.transform(blocks, lambda b: many(b["runs"]) + in_cells(b["cells"]))
    return let(counted, lambda counts: F.when(F.exists(counts, lambda n: n > 0), every(counts)).otherwise(blocks))


def read_md(docs: DataFrame) -> Ir:
    """From doc_id, md. A document is read and written as one row."""
    fronts = m.document_blocks(m.split_front_matter(docs))
    blocks = let(F.transform(F.coalesce("blocks", F.array().cast(m.BLOCKS)), _md_block), _links_numbered)
    front = {k: m.front_matter_value(F.col("front"), k) for k in ("title", "author", "subject")}
    keys = ["pageWidth", "pageHeight", "marginTop", "marginBottom", "marginLeft", "marginRight", "marginHeader", "marginFooter"]
    own, told = m.page_values(keys)
    page = F.array(F.struct(F.lit(-1).cast("long").alias("begin"), F.array(*[own[k] for k in keys], F.lit(0)).alias("page")))
    given = front | {"blocks": blocks, "sections": F.when(told, page), "told": F.lit(True), "deepest": F.lit(0), "warnings": F.lit(0), "size": F.lit(0)}
    none = lambda k, t: F.array().cast(t) if t.startswith("array") else F.lit(None).cast(t)
    columns = [F.coalesce(given[k].cast(t), none(k, t)).alias(k) if k in given else none(k, t).alias(k) for k, t in DOCUMENT.items()]
    return _of_documents(stored(fronts.select("doc_id", *columns)), 0, errors=False)


TABLE = ("doc_id", "sec", "tbl")
MD_RUN = ("text", "bold", "italic", "underline", "strike", "sup", "sub", "font", "color", "url")


def _with_spans(cells: DataFrame) -> DataFrame:
    """Cells with their grid column and row_span (0: merged away), from col_span and vm. Tables without merges stay as they are."""
    merged = cells.where("col_span > 1 OR vm IS NOT NULL").select(*TABLE).distinct()
    plain = cells.join(merged, list(TABLE), "left_anti").drop("vm")
    grid = tables.grid_columns(cells.join(merged, list(TABLE), "left_semi").withColumnsRenamed({"row": "r", "col": "c", "col_span": "span"}).drop("row_span"), *TABLE)
    spans = tables.row_spans(grid, *TABLE).select(*TABLE, "r", "col", "row_span")
    found = grid.join(spans, [*TABLE, "r", "col"]).withColumnsRenamed({"r": "row", "span": "col_span"}).withColumn("col", F.col("col").cast("int"))
    return plain.unionByName(found.select(*plain.columns))


def _pages(rows: DataFrame) -> DataFrame:
    """The sections that rows of DOCX tell, with ord from 1: a section's page is told where it ends."""
    begin = F.coalesce(F.lag("ord").over(Window.partitionBy("doc_id").orderBy("ord")), F.lit(0))
    return rows.where("row_type = 'section'").select("doc_id", begin.cast("long").alias("begin"), F.split("text", " ").cast("array<int>").alias("page"))


def docx_sections(docs: DataFrame) -> DataFrame:
    """The sections of read_docx(docs), for who wants nothing else of the packages: their other parts are left packed, and
    neither runs nor cells are written."""
    rows = xmlrows.docx_rows(package.unzip_parts(docs, ("word/document.xml",), ("word/document.xml",)), ("section",))
    return _pages(rows.where("error IS NULL").withColumn("ord", F.col("ord") + 1))


def _from_rows(rows: DataFrame, meta: DataFrame) -> Ir:
    """Rows of a DOCX document to the flat tables; blk is the place of a block's first row in the document.

    rows: those of xmlrows with heading, list_level, list_ordered of paragraphs, url of texts, media_id of images. A page
    break is a block of its own; what follows it, or a table, in the same paragraph is a paragraph of its own behind it.
    """
    order = F.col("ord") + 1
    beside = F.col("row_type").isin("section", "unsupported", *xmlrows.MARGINS)
    rows = rows.where("error IS NULL").withColumns({"ord": order, "body": (F.col("tbl").isNull() | (F.col("row_type") == "table")) & ~beside})
    own = Window.partitionBy("doc_id", "sec", "body").orderBy("ord")
    start = F.col("row_type").isin("paragraph", "pageBreak") | F.lag("row_type").over(own).isin("table", "pageBreak")
    opens = (F.col("row_type") == "paragraph") & F.coalesce(F.lead("row_type").over(own) == "pageBreak", F.lit(False))  # nothing is before the break
    like = tuple(PARAGRAPH)
    rows = rows.withColumns({"start": start, "opens": opens, "like": F.last(F.when(F.col("row_type") == "paragraph", F.struct(*like)), True).over(own)})
    # dealt by document once: what follows finds each row's block beside it
    rows = stored(complete(rows.withColumn("blk", F.last(F.when(F.col("start"), F.col("ord")), True).over(own)), RUN))
    body = rows.where("body AND tbl IS NULL")
    rows = rows.drop("blk", "like", "start", "opens", "body")
    is_break = F.col("row_type") == "pageBreak"
    paragraphs = body.where("start AND NOT opens").select("doc_id", "blk", F.when(is_break, "pageBreak").otherwise("paragraph").alias("kind"), *[F.when(~is_break, F.col(f"like.{c}")).alias(c) for c in like])
    at = rows.where("row_type = 'table'").select("doc_id", "sec", F.col("ord").alias("blk"), "tbl", "level", "host", "row", "col")
    blocks = paragraphs.unionByName(at.select("doc_id", "blk", F.lit("table").alias("kind"), "level"), allowMissingColumns=True)
    is_note = F.col("row_type").isin("footnote", "endnote")
    text = F.when(F.col("row_type") == "lineBreak", "\n").when(is_note, "").otherwise(F.coalesce("text", F.lit("")))
    rows_ = lambda df: df.withColumns({"note_kind": F.when(is_note, F.col("row_type")), "text": text})
    is_run = "row_type IN ('text', 'lineBreak', 'footnote', 'endnote') OR media_id IS NOT NULL"
    runs = rows_(body.where(is_run)).select("doc_id", "blk", F.col("ord").alias("pos"), *RUN)
    # the content of cells; a table within a cell stands in its host's
    host = F.when(F.col("row_type") == "table", F.col("host")).otherwise(F.col("tbl"))
    inside = rows.where(f"tbl IS NOT NULL AND ({is_run} OR row_type IN ('paragraph', 'cell') OR row_type = 'table' AND host IS NOT NULL)").withColumn("tbl", host)
    is_element = F.col("row_type").isin("paragraph", "table", "cell")
    inside = rows_(inside).withColumn("text", F.when(~is_element, F.col("text"))).withColumn("inner", F.when(F.col("row_type") == "table", F.col("ord")))
    kind = F.when(F.col("row_type").isin("paragraph", "table"), F.col("row_type")).otherwise("run")
    one = F.when(F.col("row_type") != "cell", F.struct(F.col("ord").cast("long").alias("o"), F.struct(kind.alias("kind"), *[F.col(c).cast(t).alias(c) for c, t in ELEMENT.items() if c != "kind"]).alias("x")))
    held = F.transform(F.array_sort(F.collect_list(one)), lambda e: e["x"])
    own = F.col("row_type") == "cell"
    inside = inside.groupBy(*TABLE, "row", "col").agg(tidy(held).alias("content"), *[F.max(F.when(own, F.col(c))).alias(c) for c in ("col_span", "row_span", "vm")])
    spans = {c: F.coalesce(c, F.lit(1)) for c in ("col_span", "row_span")}
    inside = inside.withColumns(spans)
    cells = _with_spans(stored(inside)).join(at.select(*TABLE, "blk"), list(TABLE)).select("doc_id", "blk", "row", "col", "row_span", "col_span", "content")
    deepest = at.agg(F.max("level")).first()[0] or 0
    sections = _pages(rows)
    # they stand before their section's row
    told = rows.where(F.col("row_type").isin("section", *xmlrows.MARGINS))
    before = F.count(F.when(F.col("row_type") == "section", 1)).over(Window.partitionBy("doc_id").orderBy("ord"))
    told = told.withColumn("sec", before.cast("int")).where("row_type <> 'section' AND note IS NOT NULL")
    margins = told.groupBy("doc_id", "sec", F.col("row_type").alias("kind")).agg(m.ordered_join("note", "ord", "\n").alias("text"))
    return Ir(blocks, runs, cells, meta, deepest=deepest, sections=sections, margins=margins)


def _errors(rows: DataFrame, *tables_: DataFrame) -> DataFrame:
    """doc_id, error of the packages, and of their parts, that could not be read; warnings of those with things that are
    not read: text boxes (but for their text), charts, other drawings, headers and footers of some pages alone, and notes,
    headers and footers that are not there."""
    told = reduce(DataFrame.unionByName, [t.select("doc_id", "error") for t in (rows, *tables_)]).where("error IS NOT NULL").withColumn("warned", F.lit(0))
    lost = F.col("row_type") == "unsupported"
    if "note" in rows.columns:
        lost = lost | F.col("row_type").isin("footnote", "endnote", *xmlrows.MARGINS) & F.col("note").isNull()
    warned = rows.where(lost).select("doc_id", F.lit(None).cast("string").alias("error"), F.lit(1).alias("warned"))
    return told.unionByName(warned).groupBy("doc_id").agg(F.min("error").alias("error"), F.sum("warned").cast("int").alias("warnings"))


def _media(parts: DataFrame, media_id: Column) -> DataFrame:
    return parts.select("doc_id", media_id.alias("media_id"), sniff_mime(F.col("bytes")).alias("mime"), "bytes").where("media_id IS NOT NULL")


#: Parts of DOCX beside the document whose errors are told.
SMALL_PARTS = ("word/styles.xml", "word/numbering.xml", "word/footnotes.xml", "word/endnotes.xml")


def _parts_of(docs: DataFrame, names: tuple[str, ...], folders: tuple[str, ...], prefixes: tuple[str, ...], required: tuple[str, ...]) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """The packages opened and written once, a row each with a column for each of `names` and `folders`; and a function that
    reads the parts of some of these alone."""
    every = stored(package.unzip_columns(docs, names, folders, prefixes, required))

    def of(*wanted: str) -> DataFrame:
        if len(wanted) == 1 and wanted[0] in names:
            own = F.col(f"p{names.index(wanted[0])}")
            return every.where(own.isNotNull()).select("doc_id", F.lit(wanted[0]).alias("part"), own.alias("bytes"))
        one = lambda n: F.array(F.struct(F.lit(n).alias("part"), F.col(f"p{names.index(n)}").alias("bytes")))
        held = F.concat(*[one(n) if n in names else F.col(f"f{folders.index(n)}") for n in wanted])
        return every.where("error IS NULL").select("doc_id", F.explode(held).alias("x")).select("doc_id", "x.part", "x.bytes").where("bytes IS NOT NULL")

    return every, of


def _styled(parts: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of a DOCX document whose paragraphs and texts have what their paragraph's style, or the nearest one that it is
    based on, tells and they don't: alignment, size, colour, bold, italic."""
    told = xmlrows.docx_styles(parts).dropDuplicates(["doc_id", "style_id"]).select("doc_id", "style_id", "based_on", *STYLED)
    inherited = styles.style_inherit(stored(told), list(STYLED), {}).withColumn("sz", F.col("sz") / 2)
    of = rows.where("row_type = 'paragraph'").select("doc_id", "para", "style_id").join(inherited, ["doc_id", "style_id"])
    rows = rows.join(of.select("doc_id", "para", *[F.col(s).alias(f"s_{s}") for s in STYLED]), ["doc_id", "para"], "left")
    kind = {c: "paragraph" if c == "align" else "text" for c in STYLED.values()}
    return rows.withColumns({c: F.coalesce(c, F.when(F.col("row_type") == kind[c], F.nullif(f"s_{s}", F.lit("auto")) if c == "color" else F.col(f"s_{s}"))) for s, c in STYLED.items()}).drop(*[f"s_{s}" for s in STYLED])


#: What styles tell of texts and paragraphs, and the columns of rows for it.
STYLED = {"align": "align", "sz": "size_pt", "color": "color", "bold": "bold", "italic": "italic"}


def _read(docs: DataFrame) -> Ir:
    """The tables of documents as they are read of packages."""
    held = stored(docs)
    return _of_documents(held, held.agg(F.max("deepest")).first()[0] or 0)


def read_docx(docs: DataFrame) -> Ir:
    """From doc_id, bytes. A heading is told by the name of the paragraph's style, a list by its numbering."""
    return _read(docx_documents(docs))


def read_hwpx(docs: DataFrame) -> Ir:
    """From doc_id, bytes. A heading is told by the paragraph's style or by the shape that a heading style names; emphasis by
    the character shape, a list by the paragraph shape."""
    return _read(hwpx_documents(docs))


def read_docx_styled(docs: DataFrame) -> Ir:
    """read_docx() with what style chains tell written to texts and paragraphs. The chains are followed by joins, so rows are
    tables here."""
    names = ("word/document.xml", "word/_rels/document.xml.rels", "word/styles.xml", "word/numbering.xml", "word/footnotes.xml", "word/endnotes.xml", "docProps/core.xml")
    folders = ("word/media/", "word/header", "word/footer")
    every, of = _parts_of(docs, names, folders, (*names, *folders), ("word/document.xml",))
    meta = xmlrows.core_meta(of("docProps/core.xml")).select("doc_id", "title", "author", "subject")
    column = {name: f"p{i}" for i, name in enumerate(names)} | {name: f"f{i}" for i, name in enumerate(folders)}
    opened = every.where("error IS NULL")
    rows = stored(xmlrows.docx_package_rows(opened, column["word/document.xml"], [column[n] for n in xmlrows.NAMING], [column[n] for n in folders[1:]]))
    rows = stored(_styled(of("word/styles.xml"), rows).select(*rows.columns))
    rows = rows.withColumns({c: F.when(F.col(c), F.lit(True)) for c in RUN_FLAGS})
    is_ = lambda *kinds: F.coalesce(F.col("row_type").isin(*kinds), F.lit(False))
    level = F.when(is_("paragraph") & (F.col("num_id") != "0"), F.coalesce("ilvl", F.lit(0)))
    side = F.when(F.col("align") == "both", "justify").when(F.col("align") == "start", "left").when(F.col("align") == "end", "right").when(F.col("align").isin(*packages.ALIGNS), F.col("align"))
    told = rows.withColumns({
        "align": F.when(is_("paragraph"), side), "heading": F.when(F.col("known"), F.col("named")).otherwise(F.col("heading")),
        "list_level": level, "list_ordered": F.when(level.isNotNull(), F.coalesce(~F.col("fmt").isin("bullet", "none"), F.lit(False))),
        "url": F.when(is_("text"), F.when(F.col("cls") == "hyperlink", F.col("target")).when(F.col("ref").startswith("#"), F.nullif("ref", F.lit("#")))),
        "media_id": F.when(is_("image") & (F.col("cls") == "image"), F.regexp_replace("target", "^/?(word/)?", "")),
    }).drop("named", "known", "fmt", "target", "cls")
    errors = _errors(told, every, xmlrows.part_errors(of(*SMALL_PARTS), *SMALL_PARTS))
    media = of("word/media/")
    return replace(_from_rows(told, meta), errors=errors, media=_media(media, F.substring("part", 6, 1 << 20)))


def read_hwp(streams: DataFrame) -> Ir:
    """From doc_id, stream, compressed, bytes: the streams `DocInfo` and `BodyText/Section<n>` of binary documents, taken
    out of their container before. Emphasis is told by the character shapes of each text."""
    held = stored(records.decode_records(streams))
    shapes = records.char_shapes(held.where("stream = 'DocInfo'"))
    number = F.regexp_extract("stream", r"^BodyText/Section(\d+)$", 1).try_cast("int")
    body = records.table_of_record(records.para_of_record(held.withColumn("sec", number).where("sec IS NOT NULL")))
    # a table's own record is no cell's; its paragraphs stand in cells
    letters = F.when(F.col("tag") == records.CONTROL, F.reverse(F.decode(F.substring("payload", 1, 4), "ISO-8859-1")))
    body = records.route_header_footer(body.withColumn("ctrl", letters)).drop("ctrl")
    body = stored(body.withColumn("blk", F.row_number().over(Window.partitionBy("doc_id").orderBy("sec", "rec"))))
    place = ["doc_id", "sec", "para"]
    openers = body.where(F.col("tag") == records.PARAGRAPH).select("doc_id", "sec", F.col("rec").alias("para"), "blk", "tbl", "cell", "place")
    points = body.where(F.col("tag") == records.CHAR_SHAPE).groupBy(*place).agg(F.min_by("payload", "rec").alias("points"))
    texts = body.where(F.col("tag") == records.TEXT).select(*place, F.col("rec").alias("at"), "payload").join(points, place, "left").join(openers, place)
    cut = texts.select("doc_id", "sec", "blk", "tbl", "cell", "place", "at", F.posexplode(records.shape_runs(F.col("payload"), F.col("points"))).alias("nth", "run"))
    every_piece = stored(cut.select("doc_id", "sec", "blk", "tbl", "cell", "place", "at", "nth", F.col("run.shape").alias("id"), F.col("run.text").alias("text")))
    pieces, body = every_piece.where("place = 'body'"), body.withColumn("tag", F.when(F.col("place") == "body", F.col("tag")))
    # sections by the number of their stream; a page that none tells is the usual one
    streams_ = Window.partitionBy("doc_id").orderBy("sec")
    numbered = stored(body.groupBy("doc_id", "sec").agg(F.min("blk").alias("first")).withColumn("nth_sec", F.row_number().over(streams_) - 1))
    page = F.array(*[F.col(k) if k != "gutter" else F.lit(0) for k in xmlrows.PAGE_OF])
    pages = records.page_defs(body).withColumn("sec", number).groupBy("doc_id", "sec").agg(F.min_by(page, "rec").alias("page"))
    usual = F.array(*[F.lit(x) for x in packages.A4_PAGE])
    sections = numbered.join(pages, ["doc_id", "sec"], "left").select("doc_id", (F.col("first") - 1).cast("long").alias("begin"), F.coalesce(F.col("page").cast("array<int>"), usual).alias("page"))
    margins = every_piece.where("place <> 'body'").groupBy("doc_id", "sec", "place", "blk").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "nth", "text"))), lambda p: p["text"]), "").alias("line"))
    margins = margins.withColumn("line", F.regexp_replace("line", "\n+$", "")).groupBy("doc_id", "sec", F.col("place").alias("kind")).agg(m.ordered_join("line", "blk", "\n").alias("text"))
    margins = margins.join(numbered, ["doc_id", "sec"]).select("doc_id", F.col("nth_sec").alias("sec"), "kind", "text")
    on = lambda c: F.when(F.col(c), F.lit(True)).alias(c)
    none = {k: F.lit(None).cast("boolean" if k in RUN_FLAGS else "string") for k in (*RUN_FLAGS, "color", "url", "font", "media_id") if k not in ("bold", "italic")}
    order = F.row_number().over(Window.partitionBy("doc_id", "blk").orderBy("at", "nth")) - 1
    runs = pieces.where("cell IS NULL").join(shapes.select("doc_id", "id", on("bold"), on("italic")), ["doc_id", "id"], "left")
    runs = runs.withColumns({"pos": order} | none).select("doc_id", "blk", "pos", "text", *RUN_FLAGS, "color", "url", "font", "media_id")
    paragraphs = runs.where(r"text rlike '\\S'").select("doc_id", "blk").distinct().withColumn("kind", F.lit("paragraph"))
    at = body.where(F.col("tag") == records.TABLE).select("doc_id", "sec", F.col("rec").alias("tbl"), "blk")
    blocks = paragraphs.unionByName(at.select("doc_id", "blk", F.lit("table").alias("kind")))
    blocks = blocks.withColumns({"heading": F.lit(None).cast("int"), "list_level": F.lit(None).cast("int"), "list_ordered": F.lit(None).cast("boolean")})
    lines = pieces.where("cell IS NOT NULL").groupBy("doc_id", "sec", "cell", "blk").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "nth", "text"))), lambda p: p["text"]), "").alias("line"))
    inside = lines.groupBy("doc_id", "sec", "cell").agg(m.ordered_join("line", "blk", "\n").alias("text"))
    own = records.cell_attributes(body).withColumn("sec", number).join(body.select("doc_id", "sec", "rec", "tbl"), ["doc_id", "sec", "rec"]).withColumnRenamed("rec", "cell").where("tbl IS NOT NULL")
    cells = own.join(at, ["doc_id", "sec", "tbl"]).join(inside, ["doc_id", "sec", "cell"], "left")
    cells = cells.select("doc_id", "blk", *[F.col(c).cast("int").alias(c) for c in ("row", "col", "row_span", "col_span")], of_lines(F.trim(F.coalesce("text", F.lit("")))).alias("content"))
    every = streams.select("doc_id").distinct()
    meta = every.withColumns({k: F.lit(None).cast("string") for k in ("title", "author", "subject")})
    errors = every.join(body.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", F.lit("no body text").alias("error"), F.lit(0).alias("warnings"))
    return Ir(blocks, runs, cells, meta, errors, sections=sections, margins=margins)


def _told(ir: Ir, written: DataFrame) -> DataFrame:
    """What is written, with error and warnings only of readers that tell any."""
    return written if ir.errors is not None else written.drop("error", "warnings")


def write_md(ir: Ir) -> DataFrame:
    return _told(ir, render.render_markdown(documents(ir)))


def write_docx(ir: Ir) -> DataFrame:
    return _told(ir, packages.docx_parts(documents(ir), ir.deepest))


def write_hwpx(ir: Ir) -> DataFrame:
    return _told(ir, packages.hwpx_parts(documents(ir), ir.deepest))


def write_hml(ir: Ir) -> DataFrame:
    return _told(ir, packages.hml(documents(ir), ir.deepest))


#: Readers and writers by format; own ones are added to these.
READERS: dict[str, Callable[[DataFrame], Ir]] = {"md": read_md, "docx": read_docx, "docx_styled": read_docx_styled, "hwpx": read_hwpx, "hwp": read_hwp}
WRITERS: dict[str, Callable[[Ir], DataFrame]] = {"md": write_md, "docx": write_docx, "hwpx": write_hwpx, "hml": write_hml}
#: Formats whose writers give the parts of packages (doc_id, parts), which are zipped when nothing is joined any more, and the
#: parts that all of their packages share.
PACKED = {"docx": packages.DOCX_FIXED, "hwpx": packages.HWPX_FIXED}
#: Formats whose writers take the documents that a reader gives.
OWN = set(WRITERS)
#: Formats whose readers give a row for each row, whatever its id may be.
BY_ROW = ("md", "docx", "hwpx")


#: The most documents of a written file, so that those which one task has made are read by several.
DOCUMENTS = 5000


def _by_row(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents under numbers of their own, written once, and doc_id by number: ids may repeat or be null."""
    held = stored(docs.withColumnRenamed("doc_id", "own_id").withColumn("doc_id", F.monotonically_increasing_id()), rows=DOCUMENTS)
    return held.drop("own_id"), held.select("doc_id", "own_id")


def convert(docs: DataFrame, from_: str, to: str, warnings: bool = False) -> DataFrame:
    """conversions() to one format."""
    return conversions(docs, from_, (to,), warnings)[0]


def conversions(docs: DataFrame, from_: str, to: tuple[str, ...], warnings: bool = False) -> list[DataFrame]:
    """The documents in each of some other formats, for which they are read once; from packages with error, which tells of a document that was not read whole, and with
    `warnings`, if wanted, how many things in it no writer knows.

    A row of `docs` gives a row, whatever its doc_id: a document that can't be read at all has the error alone. Of binary
    streams a doc_id's rows are one document; those without an id are left out. The result is written; all other tables
    that were written for it are removed.
    """
    for one in to:
        if from_ not in READERS or one not in WRITERS:
            raise ValueError(f"no conversion from {from_} to {one}")
    with passing(docs.sparkSession):
        ids = None
        if from_ == "hwp":
            docs = docs.where("doc_id IS NOT NULL")
        elif from_ not in BY_ROW or not OWN.issuperset(to):
            docs, ids = _by_row(docs)
        elif from_ == "md":  # texts that a query makes
            docs = stored(docs, rows=DOCUMENTS)
        ir = READERS[from_](docs)
        ir = replace(ir, docs=documents(ir)) if OWN.intersection(to) else ir.written()
        return [_converted(ir, ids, one, warnings) for one in to]


def _converted(ir: Ir, ids: DataFrame | None, to: str, warnings: bool) -> DataFrame:
    """The documents written in a format, a row for each of `ids` if there are any."""
    out = WRITERS[to](ir)
    columns = [c for c in out.columns if c not in ("error", "warnings")]
    if ids is not None:
        out = ids.join(out, "doc_id", "left")
    if ir.errors is not None:
        columns = [*columns, "error", *["warnings"] * warnings]
        if "error" not in out.columns:
            out = out.join(ir.errors, "doc_id", "full" if ids is None else "left")
        out = complete(out, {"warnings": "int"}).withColumn("warnings", F.coalesce("warnings", F.lit(0)))
    if ids is not None:
        out = out.drop("doc_id").withColumnRenamed("own_id", "doc_id")
    if to in PACKED:
        columns = ["bytes" if c == "parts" else c for c in columns]
        told = F.struct(*[c for c in out.columns if c != "parts"]).alias("doc_id")
        out = package.zip_parts(out.select(told, "parts"), PACKED[to]).select("doc_id.*", "bytes")
    return stored(out.select(*columns), lasting=True, rows=DOCUMENTS if to in PACKED else 0)


def visit(nodes: DataFrame, by_kind: dict[str, Column], default: Column, name: str = "out") -> DataFrame:
    """Nodes with a column that is one expression for each kind."""
    out = default
    for kind, value in by_kind.items():
        out = F.when(F.col("kind") == kind, value).otherwise(out)
    return nodes.withColumn(name, out)


def make_cell(text: Column, row_span: Column | None = None, col_span: Column | None = None) -> Column:
    """A cell struct; spans are 1 unless they are given."""
    one = F.lit(1)
    return F.struct(text.alias("text"), F.coalesce(row_span if row_span is not None else one, one).alias("row_span"), F.coalesce(col_span if col_span is not None else one, one).alias("col_span"))


def make_page(w: Column | None = None, h: Column | None = None) -> Column:
    """A page struct in points, A4 unless it is given."""
    none = F.lit(None).cast("double")
    return F.struct(F.coalesce(w if w is not None else none, F.lit(595.28)).alias("w"), F.coalesce(h if h is not None else none, F.lit(841.89)).alias("h"))


def make_run(text: Column, **style: Column) -> Column:
    """A run struct; what `style` doesn't give is null."""
    none = {k: F.lit(None).cast("boolean") for k in RUN_FLAGS} | {k: F.lit(None).cast("string") for k in ("font", "color", "url", "media_id")}
    return F.struct(text.alias("text"), *[style.get(k, v).alias(k) for k, v in none.items()])


def make_image(data: Column, alt: Column | None = None) -> Column:
    """An image struct, its type told by the first bytes."""
    return F.struct(sniff_mime(data).alias("mime"), data.alias("bytes"), F.coalesce(alt if alt is not None else F.lit(None).cast("string"), F.lit("image")).alias("alt"))


def make_paragraph(runs: Column, heading: Column | None = None, list_level: Column | None = None, list_ordered: Column | None = None) -> Column:
    """A paragraph struct of an array of runs; plain text unless a heading or a list level is given."""
    none = F.lit(None).cast("int")
    level = list_level if list_level is not None else none
    ordered = F.when(level.isNotNull(), F.coalesce(list_ordered if list_ordered is not None else F.lit(False), F.lit(False)))
    return F.struct(F.lit("paragraph").alias("kind"), (heading if heading is not None else none).alias("heading"), level.alias("list_level"), ordered.alias("list_ordered"), runs.alias("runs"))


def make_row(*cells: Column) -> Column:
    """A table row: an array of cells."""
    return F.array(*cells)


def make_table(*rows: Column) -> Column:
    """A table struct of rows."""
    return F.struct(F.lit("table").alias("kind"), F.array(*rows).alias("rows"))


def make_section(blocks: Column, page: Column | None = None) -> Column:
    """A section struct of blocks, on A4 unless a page is given."""
    return F.struct((page if page is not None else make_page()).alias("page"), blocks.alias("blocks"))


def make_document(sections: Column, **meta: Column) -> Column:
    """A document struct; title, author and subject are null unless they are given."""
    none = F.lit(None).cast("string")
    return F.struct(F.struct(*[meta.get(k, none).alias(k) for k in ("title", "author", "subject")]).alias("meta"), sections.alias("sections"))


def register_markdown_blocks(spark: SparkSession, name: str = "markdown_blocks") -> None:
    """A table function for ad-hoc SQL: name(md) gives ln, kind, raw of its lines that aren't blank. Jobs use markdown_blocks()."""
    from pyspark.sql.functions import udtf

    # one pattern for all kinds, of which the first that fits is told by its name
    rules = {"heading": r"#{1,6}\s+", "fence": "```", "hrule": r"[-*_]{3,}\s*$", "table": r"\s*\|.+\|", "bullet": r"\s*[-*+]\s+.", "ordered": r"\s*\d+[.)]\s+."}
    rule = "|".join(f"(?P<{kind}>{r})" for kind, r in rules.items())

    class Lines:
        def __init__(self):
            import re

            self.match = re.compile(rule).match

        def eval(self, md: str):
            match = self.match
            for ln, raw in enumerate((md or "").split("\n")):
                if raw and not raw.isspace():
                    found = match(raw)
                    yield ln, found.lastgroup if found else "text", raw

    spark.udtf.register(name, udtf(Lines, returnType="ln int, kind string, raw string"))

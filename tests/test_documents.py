"""Edge cases of the document operators, packages, records and the stream."""

import struct
import zlib

import pytest

from doclake.functions import media, text, units
from doclake.jobs import convert
from doclake.operators import markdown as m
from doclake.operators import quality, records, registry, tables
from doclake.operators import styles as st
from doclake.sources import package, xmlrows
from doclake.sources.scratch import scratch


def md(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, md string")


def blocks(spark, text_):
    rows = m.markdown_blocks(md(spark, text_)).orderBy("blk").collect()
    return [(r["kind"], r["heading"], r["list_level"], r["text"]) for r in rows]


def p(text_, heading=None, level=None):
    return ("paragraph", heading, level, text_)


@pytest.mark.parametrize(
    "text_,want",
    [
        ("```\na\nb", [p("a")]),  # an unclosed fence loses its last line
        ("---", [("pageBreak", None, None, None)]),
        ("- a\n- b", [p("a", level=0), p("b", level=0)]),
        ("* * *", [p("* *", level=0)]),
        ("#no heading", [p("#no heading")]),
        ("\xa0\ntext", [p("text")]),
        ("a\n\n\nb\nc", [p("a"), p("b\nc")]),
        ("", []),
        ("| a | b |", [("table", None, None, None)]),
        ("## h\n### i", [p("h", 2), p("i", 3)]),
        ("```\n# x\n```\ny", [p("# x"), p("y")]),
    ],
)
def test_blocks(spark, text_, want):
    assert blocks(spark, text_) == want


def test_front_matter(spark):
    docs = md(spark, '---\na: 1\na: "2"\n---\nbody', "x\n---\na: 1\n---\n", "---\n---\n")
    assert [tuple(r) for r in m.front_matter_entries(m.split_front_matter(docs)).collect()] == [(0, "a", "2")]


@pytest.mark.parametrize("text_,want", [("***a***", [("a", True, True)]), ("**a*b**", [("a*b", True, None)]), ("x", [("x", None, None)]), ("", []), ("*a* b", [("a", None, True), (" b", None, None)])])
def test_inline(spark, text_, want):
    df = spark.createDataFrame([(1, text_)], "doc_id long, text string")
    assert [(r["text"], r["bold"], r["italic"]) for r in m.inline_runs(df, "doc_id").orderBy("pos").collect()] == want


def test_inline_plain(spark):
    df = spark.createDataFrame([("__a__ _b_ * c * ***d*** `e`",)], "t string")
    assert df.select(m.inline_plain(df["t"])).first()[0] == "a b * c * d e"


def test_style_cycle_ends(spark):
    df = spark.createDataFrame([(1, "a", "b", None), (1, "b", "a", 7), (1, "c", "gone", None)], "doc_id long, style_id string, based_on string, sz int")
    assert {r["style_id"]: r["sz"] for r in st.style_inherit(df, ["sz"], {}).collect()} == {"a": 7, "b": 7, "c": None}


def test_js_rounding(spark):
    df = spark.createDataFrame([(-2.5,), (2.5,), (-0.4,)], "x double")
    assert [r[0] for r in df.select(units.js_round(df["x"])).collect()] == [-2, 3, 0]


def test_shapes_with_nulls(spark):
    df = spark.createDataFrame([(1, 0, None, "x"), (1, 1, None, "x"), (1, 2, 3, None), (2, 0, None, None)], "doc_id long, pos int, a int, b string")
    assert sorted((r["doc_id"], r["pos"], r["shape_id"]) for r in registry.dedup_shapes(df, ["a", "b"], "pos", 5).collect()) == [(1, 0, 5), (1, 1, 5), (1, 2, 6), (2, 0, 5)]


def record(tag, level, payload, big=False):
    size = len(payload)
    if size >= 0xFFF or big:
        return struct.pack("<II", tag | level << 10 | 0xFFF << 20, size) + payload
    return struct.pack("<I", tag | level << 10 | size << 20) + payload


def test_records(spark):
    data = record(66, 0, b"h") + record(67, 1, b"x" * 5000) + record(68, 1, b"")
    packed = zlib.compressobj(wbits=-15)
    rows = [(1, "s", False, data), (2, "s", True, packed.compress(data) + packed.flush()), (3, "s", True, b"not deflated"), (4, "s", False, data[:20]), (5, "s", False, None)]
    df = spark.createDataFrame(rows, "doc_id long, stream string, compressed boolean, bytes binary")
    got = {}
    for r in records.decode_records(df).collect():
        got.setdefault(r["doc_id"], []).append((r["rec"], r["tag"], r["level"], len(r["payload"])))
    full = [(0, 66, 0, 1), (1, 67, 1, 5000), (2, 68, 1, 0)]
    assert got[1] == got[2] == full and got[4] == full[:1] and 5 not in got


def test_record_text(spark):
    units_ = lambda *u: struct.pack(f"<{len(u)}H", *u)
    cases = [(units_(0x41, 13, 0x42), "A\nB"), (units_(0x41, 2, 0xD83D, 1, 1, 1, 1, 1, 1, 0x42), "AB"), (units_(0x41, 3), "A"), (units_(24, 0x41, 0), "A"), (b"", ""), ("é😀".encode("utf-16-le"), "é😀"), (b"\x41\x00\x42", "A")]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, payload binary")
    assert [r[1] for r in sorted(df.select("i", records.decode_text(df["payload"])).collect())] == [c[1] for c in cases]


def test_images(spark):
    jpeg = b"\xff\xd8\xff\xe0\x00\x04\x00\x00\xff\xc0\x00\x0b\x08" + struct.pack(">HH", 32, 64) + b"\0" * 8
    df = spark.createDataFrame([(jpeg,), (b"\xff\xd8",), (b"",)], "b binary")
    assert [tuple(r[0]) for r in df.select(media.jpeg_size(df["b"])).collect()] == [(64, 32), (100, 100), (100, 100)]


def test_escape(spark):
    df = spark.createDataFrame([("<&\x01\"'>",)], "t string")
    assert df.select(text.escape_xml(df["t"], True)).first()[0] == "&lt;&amp;&quot;&apos;&gt;"


SAMPLE = '---\ntitle: "T & <x>"\nauthor: "A"\n---\n# Head\n\ntext **b** *i* ~~s~~ and [link](http://x?a=1&b=2)\nline two\n\n| a | b |\n| --- | --- |\n| 1 | **x** |\n\n- one\n  1. two\n\n---\n\nend'


def test_packages(spark):
    docs = md(spark, SAMPLE, "only text", "| t |")
    packed = convert.convert(docs, "md", "docx")
    parts = package.unzip_parts(packed)
    parts.cache()
    assert {"word/document.xml", "word/styles.xml", "docProps/core.xml", "[Content_Types].xml"} <= {r["part"] for r in parts.collect()}
    assert {r["name"] for r in xmlrows.docx_styles(parts).where("doc_id = 0").collect()} == {"Normal", *(f"heading {n}" for n in range(1, 7))}
    assert xmlrows.num_levels(parts).where("doc_id = 0").count() == 18 and xmlrows.nums(parts).where("doc_id = 0").count() == 2
    assert [tuple(r) for r in xmlrows.relationships(parts).where("doc_id = 0 AND cls = 'hyperlink'").select("rel_id", "target").collect()] == [("rId2", "http://x?a=1&b=2")]
    back = {r["doc_id"]: r["md"] for r in convert.convert(packed, "docx", "md").collect()}
    assert back == {r["doc_id"]: r["md"] for r in convert.convert(docs, "md", "md").collect()}
    assert "T & <x>" in back[0] and "[link](http://x?a=1&b=2)" in back[0]
    hwpx = convert.convert(docs, "md", "hwpx")
    names = [r["part"] for r in package.unzip_parts(hwpx).where("doc_id = 0").collect()]
    assert names[0] == "mimetype" and "Contents/section0.xml" in names
    told = {r["doc_id"]: r["md"] for r in convert.convert(hwpx, "hwpx", "md").collect()}
    assert told == back


def hwpx(spark, *sections):
    para = lambda x: f'<hp:p paraPrIDRef="0"><hp:run charPrIDRef="0">{x}</hp:run></hp:p>'
    parts = [(1, i, f"Contents/section{i}.xml", f'<s xmlns:hp="p">{"".join(map(para, s))}</s>'.encode()) for i, s in enumerate(sections)]
    return package.zip_package(spark.createDataFrame(parts, "doc_id long, ord int, part string, bytes binary"))


def test_sections(spark):
    t = lambda x: f"<hp:t>{x}</hp:t>"
    table = lambda x: f"<hp:tbl><hp:tr><hp:tc><hp:subList><hp:p><hp:run>{t(x)}</hp:run></hp:p></hp:subList></hp:tc></hp:tr></hp:tbl>"
    docs = hwpx(spark, [t("one"), t("before") + table("A"), t("two")], [t("three"), t("four"), table("B") + t(""), t("five") + table("C") + t("after")])
    want = ["one", "before", "| A |\n| --- |", "two", "three", "four", "| B |\n| --- |", "five", "| C |\n| --- |", "after"]
    assert convert.convert(docs, "hwpx", "md").first()["md"] == "\n\n".join(want)
    assert convert.read_hwpx(docs).blocks.count() == len(want)


def test_breaks_cells_and_errors(spark):
    word = lambda *x: f'<w:document xmlns:w="w"><w:body>{"".join(x)}</w:body></w:document>'.encode()
    t, br = lambda x: f"<w:r><w:t>{x}</w:t></w:r>", '<w:r><w:br w:type="page"/></w:r>'
    para = lambda *x: f"<w:p>{''.join(x)}</w:p>"
    table = f"<w:tbl><w:tr><w:tc>{para(t('x'), '<w:r><w:br/></w:r>', t('y'))}{para(t('z'))}</w:tc></w:tr></w:tbl>"
    parts = [(1, 0, "word/document.xml", word(para(t("a"), br, t("b")), para(br), table)), (2, 0, "word/document.xml", b"<w")]
    docs = package.zip_package(spark.createDataFrame(parts, "doc_id long, ord int, part string, bytes binary")).unionByName(spark.createDataFrame([(3, b"no zip")], "doc_id long, bytes binary"))
    got = {r["doc_id"]: (r["md"], r["error"]) for r in convert.convert(docs, "docx", "md").collect()}
    assert got[1] == ("a\n\n---\n\nb\n\n---\n\n| x<br>y<br>z |\n| --- |", None)
    assert got[2][0] is None and got[2][1].startswith("ParseError") and got[3][0] is None and got[3][1].startswith("BadZipFile")
    broken = hwpx(spark, ["<hp:t>one</hp:t>"], ["<hp:t>"])
    told = convert.convert(broken, "hwpx", "md").collect()
    assert len(told) == 1 and told[0]["md"] == "one" and told[0]["error"].startswith("ParseError")


def test_bad_package_is_a_row(spark):
    df = spark.createDataFrame([(1, b"no zip"), (2, None)], "doc_id long, bytes binary")
    assert all(r["error"] and r["part"] is None for r in package.unzip_parts(df).collect())
    bad = spark.createDataFrame([(1, "word/document.xml", b"<x")], "doc_id long, part string, bytes binary")
    assert xmlrows.docx_rows(bad).first()["error"].startswith("ParseError")


def test_notes(spark):
    xml = b'<w:footnotes xmlns:w="w"><w:footnote w:id="2"><w:p><w:r><w:t>no</w:t><w:t>te</w:t></w:r></w:p></w:footnote></w:footnotes>'
    df = spark.createDataFrame([(1, "word/footnotes.xml", xml)], "doc_id long, part string, bytes binary")
    assert [tuple(r) for r in xmlrows.notes(df).select("kind", "note_id", "text").collect()] == [("footnote", "2", "note")]


def test_files_and_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"d{i}.md").write_text(f"# doc {i}\n\ntext")
    (tmp_path / "in" / "skip.txt").write_text("no")
    corpus = package.read_corpus(spark, str(tmp_path / "in"))
    assert corpus.count() == 3 and {r["format"] for r in corpus.collect()} == {"md"}
    assert package.read_markdown(spark, str(tmp_path / "in" / "*.md")).count() == 3
    from doclake.streaming.convert import stream_convert

    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    stream_convert(spark, str(tmp_path / "in"), out, "md", "docx", check).awaitTermination()
    (tmp_path / "in" / "late.md").write_text("late")
    stream_convert(spark, str(tmp_path / "in"), out, "md", "docx", check).awaitTermination()
    done = spark.read.parquet(out)
    assert done.groupBy("batch").count().count() == 2 and done.count() == 4
    package.write_packages(done.selectExpr("regexp_extract(doc_id, '([^/]+)[.]md', 1) AS doc_id", "bytes"), f"file://{tmp_path}/files", "docx")
    assert sorted(f.name for f in (tmp_path / "files").iterdir()) == ["d0.docx", "d1.docx", "d2.docx", "late.docx"]
    package.write_markdown(convert.convert(done, "docx", "md"), str(tmp_path / "md"))
    assert {r["md"] for r in spark.read.parquet(str(tmp_path / "md")).collect()} == {"late", *(f"# doc {i}\n\ntext" for i in range(3))}


def test_integrity_and_union(spark):
    one, two = spark.createDataFrame([(1, "a"), (1, "a")], "doc_id long, t string"), spark.createDataFrame([(1, "a"), (1, None)], "doc_id long, t string")
    assert sorted(tuple(r) for r in quality.integrity_diff(one, two).collect()) == [(1, "added", 1), (1, "lost", 1)]
    assert package.union_ir(one, two.withColumnRenamed("t", "u")).columns == ["doc_id", "t", "u"]
    assert scratch(spark) != scratch(spark)
    with pytest.raises(ValueError):
        convert.convert(one, "md", "hwp")  # nothing writes binary documents


def test_place_cells_and_widths(spark):
    """Against plain code on random tables: a grid that is filled cell by cell, and widths told column by column."""
    import random

    q, cells, grids, told = random.Random(4), [], {}, {}
    for t in range(40):
        grid = {}
        for row in range(q.randrange(1, 6)):
            col = 0
            for nth in range(q.randrange(1, 5)):
                wide, high = q.randrange(1, 4), q.randrange(0, 4)
                while (row, col) in grid:
                    col += 1
                for i in range(max(1, high)):
                    for j in range(wide):
                        grid[row + i, col + j] = nth
                cells.append((t, row, nth, wide, high, f"c{len(cells)}", q.choice([None, 0, 500, 900])))
                grids[t, row, nth] = col
                col += wide
    df = spark.createDataFrame(cells, "doc_id long, row int, nth int, colspan int, rowspan int, text string, width int").repartition(3)
    placed = tables.place_cells(df, "doc_id")
    assert placed.columns == [*df.columns, "col_addr"]
    assert {(r["doc_id"], r["row"], r["nth"]): r["col_addr"] for r in placed.collect()} == grids
    held = placed.selectExpr("doc_id", "row", "col_addr AS col", "colspan AS col_span", "width")
    for t in range(40):
        own = sorted((row, grids[t, row, nth], wide, w or 0) for d, row, nth, wide, _, _, w in cells if d == t)
        many = max(c + wide for _, c, wide, _ in own)
        out = [next((w for _, c, wide, w in own if c == i and wide == 1 and w), None) for i in range(many)]
        for _, c, wide, w in own:
            free = [i for i in range(c, c + wide) if out[i] is None]
            left = w - sum(out[i] or 0 for i in range(c, c + wide))
            for i in free if wide > 1 and left > 0 else []:
                out[i] = left // len(free)
        told |= {(t, i): round(9000 / many) if w is None else w for i, w in enumerate(out)}
    assert {(r["doc_id"], r["col"]): r["width"] for r in tables.column_widths(held, "doc_id").collect()} == told


def test_chains_of_any_length(spark):
    """A chain of 70 styles, and tables nested nine deep."""
    rows = [(1, f"s{i}", f"s{i - 1}" if i else None, 9 if i == 0 else None) for i in range(70)] + [(1, "x", "y", None), (1, "y", "z", None), (1, "z", "y", 3), (1, "own", "own", 4)]
    got = {r["style_id"]: r["sz"] for r in st.style_inherit(spark.createDataFrame(rows, "doc_id long, style_id string, based_on string, sz int"), ["sz"], {}).collect()}
    assert got == {f"s{i}": 9 for i in range(70)} | {"x": 3, "y": 3, "z": 3, "own": 4}
    html = spark.createDataFrame([(1, "<table>" * 9 + "in" + "</table>" * 9), (2, "no table")], "doc_id long, html string")
    assert sorted((r["level"], r["nth"]) for r in tables.extract_tables(html).collect()) == [(i, 0) for i in range(9)]


def test_page_and_registries(spark):
    page = b'<w:document xmlns:w="w"><w:body><w:p/><w:sectPr><w:pgSz w:w="16838" w:h="0"/><w:pgMar w:top="100"/><w:cols w:num="2"/></w:sectPr></w:body></w:document>'
    style = b'<w:styles xmlns:w="w"><w:style w:styleId="a"><w:name w:val="A"/><w:pPr><w:ind w:left="720" w:hanging="360"/><w:spacing w:after="120" w:line="240" w:lineRule="auto"/></w:pPr><w:tblPr><w:tblBorders><w:top w:val="single" w:sz="4" w:color="FF0000"/></w:tblBorders></w:tblPr><w:tcPr><w:shd w:fill="EEEEEE"/></w:tcPr></w:style></w:styles>'
    levels = b'<w:numbering xmlns:w="w"><w:abstractNum w:abstractNumId="3"><w:lvl w:ilvl="0"><w:start w:val="0"/><w:pPr><w:ind w:left="720" w:hanging="360"/></w:pPr></w:lvl></w:abstractNum></w:numbering>'
    header = '<hh:head xmlns:hh="h" xmlns:hc="c"><hh:fontface lang="HANGUL"><hh:font id="0" face="함초롬바탕"/></hh:fontface><hh:borderFill id="2"><hh:leftBorder type="SOLID" width="0.1 mm" color="#000000"/><hc:fillBrush><hc:winBrush faceColor="#FFEE00"/></hc:fillBrush></hh:borderFill><hh:paraPr id="4" keepLines="true"><hh:align value="CENTER"/><hh:margin left="10" prev="20"><hh:indent value="-5"/></hh:margin><hh:lineSpacing value="130"/><hh:border borderFillIDRef="2"/></hh:paraPr></hh:head>'.encode()
    section = b'<hs:sec xmlns:hs="s" xmlns:hp="p"><hp:p><hp:run><hp:secPr><hp:pagePr width="59528" height="84188"><hp:margin left="8504" header="4252"/></hp:pagePr></hp:secPr></hp:run></hp:p></hs:sec>'
    rows = [(1, "word/document.xml", page), (1, "word/styles.xml", style), (1, "word/numbering.xml", levels), (1, "Contents/header.xml", header), (1, "Contents/section0.xml", section), (2, "word/styles.xml", b"<w")]
    parts = spark.createDataFrame(rows, "doc_id long, part string, bytes binary")
    one = lambda df, *c: tuple(df.first()[k] for k in c)
    assert one(xmlrows.docx_page(parts), "sec", "w", "h", "top", "left", "columns", "gap") == (0, 16838, 16838, 100, 1800, 2, 720)
    assert one(xmlrows.docx_styles(parts), "ind_left", "hanging", "after", "line", "line_rule", "border_top", "border_left", "shade") == (720, 360, 120, 240, "auto", "single 4 FF0000", None, "EEEEEE")
    assert one(xmlrows.num_levels(parts), "start", "ind_left", "hanging") == (0, 720, 360)
    assert one(xmlrows.hwpx_fonts(parts), "lang", "id", "face") == ("HANGUL", "0", "함초롬바탕")
    assert one(xmlrows.hwpx_border_fills(parts), "id", "left", "right", "face") == ("2", "SOLID 0.1 mm #000000", None, "FFEE00")
    assert one(xmlrows.hwpx_para_shapes(parts), "align", "left", "before", "indent", "line", "fill", "keep_lines") == ("CENTER", 10, 20, -5, 130, "2", True)
    assert one(xmlrows.hwpx_page(parts), "sec", "w", "h", "left", "header", "right") == (0, 59528, 84188, 8504, 4252, 0)
    assert [r["doc_id"] for r in xmlrows.part_errors(parts, "word/styles.xml").collect()] == [2]


def test_builders(spark):
    from pyspark.sql import functions as F

    run = convert.make_run(F.lit("t"), bold=F.lit(True))
    para = convert.make_paragraph(F.array(run), list_level=F.lit(1))
    table = convert.make_table(convert.make_row(convert.make_cell(F.lit("c"), col_span=F.lit(2))))
    got = spark.range(1).select(convert.make_document(F.array(convert.make_section(F.array(para))), title=F.lit("T")).alias("d"), table.alias("t"), convert.make_image(F.unhex(F.lit("FFD8"))).alias("i")).first()
    section = got["d"]["sections"][0]
    assert got["d"]["meta"]["title"] == "T" and got["d"]["meta"]["author"] is None and section["page"]["w"] == 595.28
    assert section["blocks"][0]["list_ordered"] is False and section["blocks"][0]["runs"][0]["bold"] and section["blocks"][0]["runs"][0]["italic"] is None
    assert (got["t"]["rows"][0][0]["col_span"], got["t"]["rows"][0][0]["row_span"], got["i"]["mime"], got["i"]["alt"]) == (2, 1, "image/jpeg", "image")


def test_own_formats(spark, monkeypatch):
    """A reader and a writer of one's own, kept beside the others."""
    from pyspark.sql import functions as F

    monkeypatch.setitem(convert.READERS, "shout", lambda docs: convert.read_md(docs.select("doc_id", F.upper("text").alias("md"))))
    monkeypatch.setitem(convert.WRITERS, "kinds", lambda ir: ir.blocks.groupBy("doc_id").agg(F.count("*").alias("n")))
    docs = spark.createDataFrame([(1, "# a\n\nb"), (2, "c")], "doc_id long, text string")
    assert {r["doc_id"]: r["md"] for r in convert.convert(docs, "shout", "md").collect()} == {1: "# A\n\nB", 2: "C"}
    assert {r["doc_id"]: r["n"] for r in convert.convert(docs, "shout", "kinds").collect()} == {1: 2, 2: 1}
    with pytest.raises(ValueError):
        convert.convert(docs, "shout", "none")


def test_binary_streams(spark):
    """Sections in the order of their numbers, a row for a document without body, shapes that begin within a control's units."""
    plain = lambda t: t.encode("utf-16-le")
    shape = lambda flags: record(21, 0, bytes(46) + struct.pack("<I", flags))
    head = record(66, 0, b"\0" * 4)
    control = struct.pack("<8H", 11, 0, 0, 0, 0, 0, 0, 11)
    rows = [
        (1, "DocInfo", shape(0) + shape(2) + shape(1)), (1, "BodyText/Section10", head + record(67, 1, plain("last"))),
        (1, "BodyText/Section2", head + record(67, 1, plain("a") + control + plain("bc😀d")) + record(68, 1, struct.pack("<6I", 0, 0, 9, 1, 11, 2))),
        (2, "DocInfo", shape(0)), (3, "BodyText/Section0", b""),
    ]
    streams = spark.createDataFrame([(d, n, False, b) for d, n, b in rows], "doc_id long, stream string, compressed boolean, bytes binary")
    got = {r["doc_id"]: (r["md"], r["error"]) for r in convert.convert(streams, "hwp", "md").collect()}
    assert got == {1: ("a**bc***😀d*\n\nlast", None), 2: ("", "no body text"), 3: ("", "no body text")} or got == {1: ("a**bc***😀d*\n\nlast", None), 2: (None, "no body text"), 3: (None, "no body text")}

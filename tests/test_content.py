"""Content of cells, notes, sections and references of packages: cases beyond the queries."""

import os

import pytest

from doclake.jobs import convert
from doclake.operators import content as ct
from doclake.operators.integrity import missing_refs
from doclake.sources import package, scratch

W = '<w:document xmlns:w="w" xmlns:r="r" xmlns:a="a"><w:body>{}</w:body></w:document>'


def docx(spark, *bodies, **more):
    rows = [(i, 0, "word/document.xml", W.format(b).encode()) for i, b in enumerate(bodies)] + [(0, 1, k, v.encode()) for k, v in more.items()]
    return package.zip_package(spark.createDataFrame(rows, "doc_id long, ord int, part string, bytes binary"))


def p(*inner):
    return f"<w:p>{''.join(inner)}</w:p>"


def r(text, pr=""):
    return f"<w:r><w:rPr>{pr}</w:rPr><w:t>{text}</w:t></w:r>"


def table(*cells):
    return "<w:tbl><w:tr>" + "".join(f"<w:tc>{c}</w:tc>" for c in cells) + "</w:tr></w:tbl>"


def test_tidy_and_plain_text(spark):
    kinds = {"p": ct.element("paragraph"), "t": ct.element("table"), "r": ct.element("run", text=ct.F.lit("x"))}
    cases = {"ptp": "t", "pt": "t", "prtp": "prt", "pp": "pp", "p": "p", "prptprp": "prtprp", "ptpt": "tt", "ttp": "tt", "": ""}
    for given, want in cases.items():
        array = ct.F.array(*[kinds[k] for k in given]) if given else ct.F.array().cast(spark.range(1).select(ct.F.array(kinds["p"])).schema[0].dataType)
        row = spark.range(1).select(ct.tidy(array).alias("c")).select("c", ct.plain_text(ct.F.col("c")).alias("t")).first()
        assert "".join({"paragraph": "p", "table": "t", "run": "r"}[x["kind"]] for x in row["c"]) == want, given
        assert row["t"] == "\n".join("x" for _ in range(want.count("r")))


def test_deep_tables_and_odd_cells(spark):
    """Tables six deep; a cell without anything, images without bytes, a list and a heading in a cell, breaks in links."""
    deep = p(r("core"))
    for level in range(6):
        deep = p(r(f"level {level}")) + table(deep)
    gone = '<w:r><w:drawing><a:blip r:embed="none"/></w:drawing></w:r>'
    odd = table("", p(gone), p(gone, r("a | b")), '<w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr>' + r("head") + "</w:p>", p("<w:r><w:br/></w:r>", r("x"), "<w:r><w:br/></w:r>"))
    docs = docx(spark, deep, odd, "")
    ir = convert.read_docx(docs)
    assert ir.deepest == 5
    there = convert.convert(docs, "docx", "hwpx").select("doc_id", "bytes")
    back = convert.convert(there, "hwpx", "docx").select("doc_id", "bytes")
    want = {x["doc_id"]: x["md"] for x in convert.convert(docs, "docx", "md").collect()}
    assert {x["doc_id"]: x["md"] for x in convert.convert(back, "docx", "md").collect()} == want
    assert want[0].count("| --- |") == 6 and "| core |" in want[0] and not want[2]
    assert want[1].split("\n")[0] == "|   |   | a | b | ## head | <br>x<br> |"
    again = convert.read_docx(back)
    assert again.deepest == 5 and again.cells.count() == ir.cells.count()
    xml = {x["doc_id"]: x["xml"] for x in convert.convert(docs, "docx", "hml").collect()}
    assert xml[0].count("<TABLE>") == 6 and xml[0].index("level 0") > xml[0].index("level 5")


def test_notes_in_odd_places(spark):
    """A note called twice, one of several lines, one that is not there, and the separators that programs write."""
    ref = lambda i: f'<w:r><w:footnoteReference w:id="{i}"/></w:r>'
    notes = f'<w:footnotes xmlns:w="w"><w:footnote w:id="-1" w:type="separator">{p()}</w:footnote><w:footnote w:id="5">{p(r("a &lt; b"))}</w:footnote><w:footnote w:id="6"/></w:footnotes>'
    docs = docx(spark, p(r("x"), ref(5), ref(9), ref(5)) + table(p(ref(6))), **{"word/footnotes.xml": notes})
    out = convert.convert(docs, "docx", "md", warnings=True).first()
    assert out["md"] == "x[^1][^2]\n\n| [^3] |\n| --- |\n\n[^1]: a < b\n[^2]: a < b\n[^3]:" and out["warnings"] == 1 and out["error"] is None
    hwpx = convert.convert(docs, "docx", "hwpx").select("doc_id", "bytes")
    assert convert.convert(hwpx, "hwpx", "md").first()["md"] == out["md"]


def test_missing_references(spark):
    docs = docx(spark, p('<w:hyperlink r:id="rId5">' + r("t") + "</w:hyperlink>") + '<w:p><w:pPr><w:pStyle w:val="S"/><w:numPr><w:numId w:val="4"/></w:numPr></w:pPr></w:p>', **{"word/x.xml": "<no xml"})
    got = {(x["space"], x["id"]) for x in missing_refs(package.unzip_parts(docs), "docx").collect()}
    assert got == {("content type", "word/document.xml"), ("relationship", "document.xml rId5"), ("style", "S"), ("list", "4"), ("part", "word/x.xml as XML")}


def test_nothing_but_the_result_stays(spark):
    docs = spark.createDataFrame([(1, "# a"), (1, "b"), (None, "c"), (2, None)], "doc_id long, md string")
    base = os.path.dirname(scratch.scratch(spark))
    before = set(os.listdir(base))
    out = convert.convert(docs, "md", "docx")
    assert len(set(os.listdir(base)) - before) == 1
    got = sorted((str(x["doc_id"]), x["md"]) for x in convert.convert(out, "docx", "md").select("doc_id", "md").collect() if x["md"])
    assert got == [("1", "# a"), ("1", "b"), ("None", "c")]
    assert out.count() == 4
    with pytest.raises(ValueError):
        convert.convert(docs, "md", "none")


def test_headers_of_odd_parts(spark):
    """A header that is no XML, one without a part; an empty one stops that of the section before; a document without any."""
    sect = lambda *ids: "<w:p><w:pPr><w:sectPr>" + "".join(f'<w:headerReference r:id="{i}"/>' for i in ids) + "</w:sectPr></w:pPr></w:p>"
    body = p(r("a")) + sect("r1") + p(r("b")) + sect("r2") + p(r("c")) + sect("r3", "none") + p(r("d"))
    more = {f"word/header{i}.xml": x for i, x in ((1, f'<w:hdr xmlns:w="w">{p(r("one"))}</w:hdr>'), (2, '<w:hdr xmlns:w="w"><w:p/></w:hdr>'), (3, "<broken"))}
    rels = "<x>" + "".join(f'<Relationship Id="r{i}" Type="t/header" Target="header{i}.xml"/>' for i in (1, 2, 3)) + "</x>"
    docs = docx(spark, body, p(r("none")), **more, **{"word/_rels/document.xml.rels": rels})
    ir = convert.read_docx(docs)
    want = [(0, 0, "header", "one"), (0, 1, "header", "")]
    assert sorted(tuple(x) for x in ir.margins.collect()) == want
    assert [tuple(x) for x in ir.errors.where("warnings > 0").select("doc_id", "warnings").collect()] == [(0, 2)]
    again = convert.read_hwpx(convert.convert(docs, "docx", "hwpx").select("doc_id", "bytes"))
    assert sorted(tuple(x) for x in again.margins.collect()) == want

"""A document goes through readers and writers as one row: nothing of it is shuffled, and it is written once on the way."""

import contextlib
import io

from doclake.jobs import convert
from doclake.operators import packages
from doclake.sources import package

W = '<w:document xmlns:w="w" xmlns:r="r" xmlns:a="a"><w:body>{}</w:body></w:document>'
R = lambda t: f"<w:r><w:t>{t}</w:t></w:r>"
P = lambda *x: f"<w:p>{''.join(x)}</w:p>"
CELL = lambda x, pr="": f"<w:tc><w:tcPr>{pr}</w:tcPr>{P(R(x)) if x else P()}</w:tc>"
ROW = lambda *x: f"<w:tr>{''.join(x)}</w:tr>"


def docx(spark, body, **more):
    parts = [(0, "word/document.xml", W.format(body).encode())] + [(i, k, v.encode()) for i, (k, v) in enumerate(more.items(), 1)]
    return package.zip_parts(spark.createDataFrame([(1, parts), (1, parts), (None, parts)], "doc_id long, parts array<struct<ord:int,part:string,bytes:binary>>"))


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_two_writes_and_no_shuffle(spark, monkeypatch):
    written = []
    for module in (convert, packages):
        monkeypatch.setattr(module, "stored", lambda df, *a, of=module.stored, **k: written.append(plan(df)) or of(df, *a, **k))
    merged = "<w:tbl>" + ROW(CELL("a", '<w:gridSpan w:val="2"/>'), CELL("tall", '<w:vMerge w:val="restart"/>')) + ROW(CELL("b"), CELL("c"), CELL("", "<w:vMerge/>")) + "</w:tbl>"
    docs = docx(spark, P(R("one")) + merged + P(R("end"))).coalesce(1)
    there = convert.convert(docs, "docx", "hwpx").select("doc_id", "bytes")
    back = convert.convert(there, "hwpx", "docx").select("doc_id", "bytes")
    md = convert.convert(back, "docx", "md")
    assert len(written) == 6 and not any("Exchange" in x for x in written)
    rows = md.collect()
    assert sorted(str(r["doc_id"]) for r in rows) == ["1", "1", "None"]
    assert {r["md"] for r in rows} == {"one\n\n| a | tall |\n| --- | --- |\n| b | c |  |\n\nend"}
    spans = [(c["row"], c["col"], c["row_span"], c["col_span"]) for c in convert.read_docx(back).cells.where("doc_id IS NULL").orderBy("row", "col").collect()]
    assert spans == [(0, 0, 1, 2), (0, 2, 2, 1), (1, 0, 1, 1), (1, 1, 1, 1), (1, 2, 0, 1)]


def test_a_broken_part_for_the_title_fails_no_job(spark):
    rows = convert.convert(docx(spark, P(R("x")), **{"docProps/core.xml": "<broken"}), "docx", "md").collect()
    assert {(r["md"], r["error"]) for r in rows} == {("x", None)}


def test_links_of_markdown_are_numbered_in_order(spark):
    text = "[a](u1) x [b](u2)\n\n| [c](u3) | d |\n|---|---|\n| e | [f](u4) [g](u5) |\n\n[h](u6)"
    docs = spark.createDataFrame([(1, text), (2, "none")], "doc_id long, md string")
    ir = convert.read_md(docs)
    one = ir.docs.where("doc_id = 1").first()["blocks"]
    runs = [(x["url"], x["rel"]) for b in one for x in [*b["runs"], *[x for c in b["cells"] for x in c["content"]]] if x["url"]]
    assert runs == [(f"u{n}", n) for n in range(1, 7)]
    assert convert.convert(convert.convert(docs, "md", "docx"), "docx", "md").where("doc_id = 1").first()["md"] == text.replace("|---|---|", "| --- | --- |")


def test_blank_cells_below_tall_ones_come_once(spark):
    cells = [(0, 0, 3, 1), (0, 1, 1, 1), (1, 1, 1, 1), (2, 0, 0, 1), (2, 1, 1, 1)]
    flat = spark.createDataFrame([(1, 0, *c, "t") for c in cells], "doc_id long, blk long, row int, col int, row_span int, col_span int, text string")
    blocks = spark.createDataFrame([(1, 0, "table", None, None, None, 0)], "doc_id long, blk long, kind string, heading int, list_level int, list_ordered boolean, level int")
    runs = spark.createDataFrame([], "doc_id long, blk long, pos long, text string")
    meta = spark.createDataFrame([(1, None, None, None)], "doc_id long, title string, author string, subject string")
    parts = convert.write_docx(convert.Ir(blocks, runs, flat, meta)).first()["parts"]
    xml = next(p["bytes"] for p in parts if p["part"] == "word/document.xml").decode()
    assert xml.count("<w:tr>") == 3 and xml.count("<w:tc>") == 6 and xml.count("<w:vMerge/>") == 2 and xml.count("<w:gridCol/>") == 2


def test_missing_references_are_found_in_their_package(spark):
    from doclake.operators.integrity import missing_in_packages, missing_refs

    docs = docx(spark, P('<w:hyperlink r:id="rId5">' + R("t") + "</w:hyperlink>"), **{"word/x.xml": "<no xml", "word/m.png": "x", "[Content_Types].xml": '<t><Default Extension="png"/></t>'}).where("doc_id = 1").limit(1)
    docs = docs.unionByName(spark.createDataFrame([(2, b"no zip"), (3, None)], "doc_id long, bytes binary"))
    found = missing_in_packages(docs, "docx")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, missing_refs(package.unzip_parts(docs), "docx").collect())) and found.count() >= 3
    assert "Exchange" not in plan(missing_in_packages(docs.coalesce(1).where("doc_id > 1"), "docx").where("space <> ''")).split("MapInArrow")[0]

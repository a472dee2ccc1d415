"""Documents are read once for several formats; what a row names in its package is found as the package is read."""

from doclake.jobs import convert
from doclake.jobs.foreign_queries import DOCX
from doclake.sources import package, xmlrows


def packages(spark, *changes):
    rows = []
    for i, change in enumerate(changes):
        parts = {n: t.replace("{k}", str(i)).replace("{name}", "n").replace("{level}", "1") for n, t in DOCX.items() if not t.startswith("=")} | change
        rows.append((i, [(at, n, t.encode()) for at, (n, t) in enumerate(parts.items())]))
    return package.zip_parts(spark.createDataFrame(rows, "doc_id long, parts array<struct<ord:int,part:string,bytes:binary>>"))


def test_one_reading_for_two_formats(spark, monkeypatch):
    reads = []
    monkeypatch.setitem(convert.READERS, "docx", lambda docs, of=convert.read_docx: reads.append(1) or of(docs))
    md, docx = convert.conversions(packages(spark, {}, {"word/document.xml": "<w:document>"}), "docx", ("md", "docx"))
    assert reads == [1] and md.columns == ["doc_id", "md", "error"] and docx.columns == ["doc_id", "bytes", "error"]
    got = {r["doc_id"]: r for r in md.collect()}
    assert got[0]["md"].startswith("# Title 0\n\nBody n\n\n  2. item 0\n\n- dot\n\nno list") and got[0]["error"] is None
    assert got[1]["md"] is None and got[1]["error"].startswith("ParseError")
    assert {r["doc_id"] for r in docx.where("error IS NULL AND bytes IS NOT NULL").collect()} == {0}


def test_names_in_a_package(spark):
    names = ("word/document.xml", *xmlrows.NAMING)
    twice = '<w:numbering xmlns:w="w"><w:abstractNum w:abstractNumId="9"><w:lvl w:ilvl="1"><w:numFmt w:val="decimal"/></w:lvl><w:lvl w:ilvl="1"><w:numFmt w:val="bullet"/></w:lvl></w:abstractNum><w:num w:numId="5"><w:abstractNumId w:val="9"/></w:num></w:numbering>'
    opened = package.unzip_columns(packages(spark, {}, {"word/styles.xml": "no xml", "word/numbering.xml": twice}), names, ("word/header",))
    rows = xmlrows.docx_package_rows(opened, "p0", [f"p{i}" for i in range(1, 6)], ["f0"]).orderBy("doc_id", "ord").collect()
    lists = [[(r["named"], r["known"], r["fmt"]) for r in rows if r["doc_id"] == i and r["row_type"] == "paragraph"][:4] for i in (0, 1)]
    assert lists == [[(1, True, None), (None, True, None), (None, False, "lowerRoman"), (None, False, "bullet")], [(None, False, None), (None, False, None), (None, False, "bullet"), (None, False, None)]]
    linked = [(r["row_type"], r["cls"], r["target"]) for r in rows if r["doc_id"] == 0 and r["cls"]]
    assert linked == [("image", "image", "media/p.png"), ("text", "hyperlink", "http://x/0")]

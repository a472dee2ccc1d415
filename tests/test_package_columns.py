"""Packages are opened to a row each; what nobody asks for is not read or written."""

import io
import zipfile

from doclake.jobs import convert
from doclake.sources import package

MD = '---\npageWidth: 50000\nmarginTop: 100\n---\n# Head\n\nend'


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, md string")


def test_sections_alone(spark, monkeypatch):
    packed = convert.convert(docs(spark, MD, "plain\n\n***\n\nmore"), "md", "docx")
    broken = packed.select("doc_id", "bytes").unionByName(spark.createDataFrame([(7, b"PK"), (8, None)], "doc_id long, bytes binary"))
    told = lambda df: sorted((r["doc_id"], r["begin"], r["page"]) for r in df.collect())
    want = told(convert.read_docx(broken).sections)
    written = []
    monkeypatch.setattr(convert, "stored", lambda df, *a, **k: written.append(df) or df)
    assert told(convert.docx_sections(broken)) == want and len(want) == 2 and want[0][2][0] == 250000
    assert not written


def test_a_package_is_one_row(spark):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in (("word\\document.xml", b"<a/>"), ("word/media/1.png", b"1"), ("word/media/2.png", b"22"), ("other", b"3")):
            z.writestr(name, data)
    with_bad_part = bytearray(held.getvalue())
    at = with_bad_part.index(b"word/media/2.png") + len("word/media/2.png")
    with_bad_part[at] ^= 0xFF
    df = spark.createDataFrame([(1, held.getvalue()), (2, bytes(with_bad_part)), (3, b"no zip"), (4, None)], "doc_id long, bytes binary")
    rows = {r["doc_id"]: r for r in package.unzip_columns(df, ("word/document.xml", "gone"), ("word/media/",), (), ("word/document.xml",)).collect()}
    assert len(rows) == 4 and bytes(rows[1]["p0"]) == b"<a/>" and rows[1]["p1"] is None and rows[1]["error"] is None
    assert [(x["part"], bytes(x["bytes"])) for x in rows[1]["f0"]] == [("word/media/1.png", b"1"), ("word/media/2.png", b"22")]
    assert all(rows[i]["error"] and rows[i]["p0"] is None for i in (2, 3, 4))
    errors = {r["doc_id"]: r["error"] for r in package.unzip_parts(df, (), ("word/document.xml",)).where("error IS NOT NULL").collect()}
    assert errors == {i: rows[i]["error"] for i in (2, 3, 4)}


def test_zips_are_as_zipfile_reads_them(spark):
    rows = [(1, [(1, "a/ü.xml", b"x" * 70000), (0, "mimetype", b"kind")]), (2, []), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, parts array<struct<ord:int,part:string,bytes:binary>>")
    got = {r["doc_id"]: r["bytes"] for r in package.zip_parts(df, {"same": "shared"}).collect()}
    assert got[3] is None
    with zipfile.ZipFile(io.BytesIO(got[1])) as z:
        assert z.namelist() == ["mimetype", "a/ü.xml", "same"] and z.testzip() is None
        assert z.read("a/ü.xml") == b"x" * 70000 and z.getinfo("mimetype").compress_type == zipfile.ZIP_STORED
        assert z.infolist()[1].date_time == (1980, 1, 1, 0, 0, 0)
    assert zipfile.ZipFile(io.BytesIO(got[2])).namelist() == ["same"]


def test_a_document_without_blocks_has_a_row_and_no_package(spark):
    got = {r["doc_id"]: r["bytes"] for r in convert.convert(docs(spark, "text", ""), "md", "docx").collect()}
    assert set(got) == {0, 1} and got[0] is not None and got[1] is None


def test_shared_parts_are_packed_once():
    package._small_entry.cache_clear()
    shared = b"<h/>" * 5000
    for i in range(200):
        package._zipped([package._shared_entry("Contents/header.xml", shared), package._shared_entry("Contents/section0.xml", str(i).encode())])
    assert package._small_entry.cache_info().misses == 201

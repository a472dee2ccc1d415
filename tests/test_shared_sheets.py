"""Documents of one template have one style sheet, whose chains are followed once."""

from doclake.jobs import resolved
from doclake.jobs.foreign_queries import STYLED
from doclake.sources import package


def packages(spark, *sheets):
    text = STYLED["word/document.xml"].replace("{k}", "7").replace("{level}", "1")
    held = [(i, [(0, "word/document.xml", text.encode())] + ([(1, "word/styles.xml", s.encode())] if s else [])) for i, s in enumerate(sheets)]
    return package.zip_parts(spark.createDataFrame(held, "doc_id long, parts array<struct<ord:int,part:string,bytes:binary>>"))


def test_chains_are_followed_once_a_sheet(spark, monkeypatch):
    chained, own = [], STYLED["word/styles.xml"]
    inherit = resolved.st.style_inherit
    monkeypatch.setattr(resolved.st, "style_inherit", lambda styles, *a: chained.append(styles.count()) or inherit(styles, *a))
    found = resolved.resolve_docx(packages(spark, own, own, own.replace('w:val="30"', 'w:val="40"'), None, own)).runs
    assert chained == [6]  # three styles of each of two sheets
    sizes = {r["doc_id"]: r["size"] for r in found.where("text = 'plain' AND para = 0").collect()}
    assert sizes == {0: 1500, 1: 1500, 2: 2000, 3: 1000, 4: 1500}


def test_runs_that_nobody_asks_for_are_not_written(spark, monkeypatch):
    written = []
    monkeypatch.setattr(resolved, "stored", lambda df, of=resolved.stored: written.append(df.columns) or of(df))
    assert resolved.resolve_docx(packages(spark, STYLED["word/styles.xml"])).paragraphs.count() == 3
    assert not any("highlight" not in c and "color" in c and "para" in c for c in written)

"""Flat XML is written from tables that are read once: none of them is written on the way."""

import contextlib
import io

import pytest

from doclake.jobs import convert
from doclake.operators import markdown as m
from doclake.operators import packages


def md(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, md string")


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_only_documents_their_blocks_and_the_result_are_written(spark, monkeypatch):
    written = []
    for module in (convert, packages):
        monkeypatch.setattr(module, "stored", lambda df, *a, of=module.stored, **k: written.append(df.columns) or of(df, *a, **k))
    xml = [r["xml"] for r in convert.convert(md(spark, "# a *b*\n\n| x | **y** |\n|---|---|\n| w | z |\n\n***\n- i<", None), "md", "hml").orderBy("doc_id").collect()]
    assert len(written) == 3
    cell = '<CELL ColAddr="{}" RowAddr="{}" ColSpan="1" RowSpan="1"><PARALIST><P ParaShape="0"><TEXT CharShape="0">{}</TEXT></P></PARALIST></CELL>'
    table = "".join("<ROW>" + "".join(cell.format(c, r, f"<CHAR>{t}</CHAR>") for c, t in enumerate(row)) + "</ROW>" for r, row in enumerate((("x", "y"), ("w", "z"))))
    p = '<P ParaShape="{}"{}><TEXT CharShape="0">{}</TEXT></P>'
    body = p.format(1, "", "<CHAR>a </CHAR><CHAR>b</CHAR>") + f"<P><TEXT><TABLE>{table}</TABLE></TEXT></P>" + p.format(0, ' PageBreak="true"', "") + p.format(0, "", "<CHAR>i&lt;</CHAR>")
    assert xml[0].partition("<SECTION>")[2] == body + "</SECTION></BODY></HWPML>" and xml[1] is None


def test_runs_are_cut_once(spark):
    texts = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert "Filter ((size(" not in plan(m.inline_runs(texts, "doc_id"))


@pytest.mark.parametrize("text,want", [("a\x1f*b*\x1f", ["a\x1f", "b", "\x1f"]), ("\x1f", ["\x1f"]), ("*a**b*", ["a", "b"]), ("< x", ["< x"]), ("", []), (None, []), ("a *b*", ["a ", "b"])])
def test_texts_are_cut_at_constructs_alone(spark, text, want):
    texts = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [r["text"] for r in m.inline_runs(texts, "doc_id").orderBy("pos").collect()] == want
    array = texts.select(m.inline_array(texts["text"], lambda columns: columns[0]).alias("x")).first()["x"]
    assert (array or []) == want

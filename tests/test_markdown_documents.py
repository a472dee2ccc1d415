"""Markdown is read a document a row: no shuffle and no sort of its lines, whatever their number."""

import contextlib
import io

import pytest

from doclake.jobs import convert
from doclake.operators import markdown as m
from doclake.operators import quality


def md(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, md string")


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


@pytest.mark.parametrize("of", [m.markdown_blocks, lambda d: m.group_lines(m.split_front_matter(d)), lambda d: m.pipe_table_cells(m.exploded(m.document_blocks(m.split_front_matter(d))))])
def test_lines_are_neither_shuffled_nor_sorted(spark, of):
    shown = plan(of(md(spark, "# a\n\nb")))
    assert "Exchange" not in shown and "Sort" not in shown and "Window" not in shown


def test_kinds_are_counted_in_one_aggregation(spark):
    nodes = spark.createDataFrame([(1, "table"), (1, "paragraph"), (1, "table"), (2, "pageBreak"), (3, "odd")], "doc_id int, kind string")
    counts = quality.node_counts(nodes)
    assert plan(counts).count("HashAggregate") == 2  # a partial and a whole one
    assert sorted(tuple(r) for r in counts.collect()) == [(1, 1, 2, 0), (2, 0, 0, 1), (3, 0, 0, 0)]


@pytest.mark.parametrize(
    "text,want",
    [
        ("```\na\n```\n```\nb\n```", [("code", 0, 2), ("code", 3, 5)]),
        ("x\n```\n| a |\n# b\n```\n```", [("text", 0, 0), ("code", 1, 4), ("code", 5, 5)]),
        ("# a\n# b\n***\n***\n- c\n1. d\n\n- e", [("heading", 0, 0), ("heading", 1, 1), ("hrule", 2, 2), ("hrule", 3, 3), ("list", 4, 5), ("list", 7, 7)]),
        ("| a |\n|---|\n| b |\ntext\n| c |", [("table", 0, 2), ("text", 3, 3), ("table", 4, 4)]),
        ("```", [("code", 0, 0)]),
        ("\n\n", []),
        (None, []),
    ],
)
def test_groups(spark, text, want):
    rows = m.group_lines(m.split_front_matter(md(spark, text))).orderBy("grp").collect()
    assert [(r["gkind"], r["first_ln"], r["last_ln"]) for r in rows] == want


def test_a_long_document_is_one_row(spark):
    text = "\n".join(f"- item {i}" if i % 3 else f"```\n# {i}\n```" for i in range(30_000))
    got = m.markdown_blocks(md(spark, text)).groupBy("font").count().collect()
    assert {r["font"]: r["count"] for r in got} == {None: 20_000, m.CODE_FONT: 10_000}


def test_front_matter_has_the_last_of_equal_keys(spark):
    ir = convert.read_md(md(spark, '---\ntitle: "a"\ntitle: b\nauthor:\n---\nx', "no front"))
    assert [tuple(r) for r in ir.meta.orderBy("doc_id").collect()] == [(0, "b", "", None), (1, None, None, None)]

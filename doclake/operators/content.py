"""What stands in a table's cell: an ordered array of elements, so that cells need no rows of their own to keep their content.

An element begins a paragraph (with its heading, list and alignment), is a run of the paragraph that is open, or is a
table within the cell, named by its block. A run has a text and its style, or an image, or a note.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLAGS = ("bold", "italic", "underline", "strike", "sup", "sub")
PARAGRAPH = {"heading": "int", "list_level": "int", "list_ordered": "boolean", "align": "string"}
#: note: the text of a foot- or endnote that is called here; note_kind without note: one that is not there.
RUN = {"text": "string", **dict.fromkeys(FLAGS, "boolean"), "color": "string", "url": "string", "font": "string", "size_pt": "double", "media_id": "string", "note_kind": "string", "note": "string"}
ELEMENT = {"kind": "string", "ord": "long", **PARAGRAPH, **RUN, "inner": "long"}


def struct_of(fields: dict[str, str]) -> str:
    return "struct<" + ",".join(f"{k}:{t}" for k, t in fields.items()) + ">"


#: What a document that is one row tells of runs and elements besides. rel: the number of a link or of an image that is there,
#: in one count; no: of images that are there, of foot- or endnotes that are there, or the place of a table within a cell among
#: those of its level, from 0; med: the place of an image's bytes in the document's media, from 0.
NUMBERED = {"rel": "int", "no": "int", "med": "int"}
RUN_AT = {"pos": "bigint", **RUN, **NUMBERED}
ELEMENT_AT = {**ELEMENT, **NUMBERED}
CELL_AT = {"row": "int", "col": "int", "row_span": "int", "col_span": "int", "content": f"array<{struct_of(ELEMENT_AT)}>"}
BLOCK = {"blk": "bigint", "kind": "string", **PARAGRAPH, "level": "int", "runs": f"array<{struct_of(RUN_AT)}>", "cells": f"array<{struct_of(CELL_AT)}>"}
#: A document as one row: its blocks in order, with their runs or their cells (by row and column). told: whether there is a
#: part for title, author and subject; deepest: the greatest level of a table; size: the bytes that it was read from.
DOCUMENT = {
    "blocks": f"array<{struct_of(BLOCK)}>", "sections": "array<struct<begin:bigint,page:array<int>>>", "margins": "array<struct<sec:int,kind:string,text:string>>", "title": "string", "author": "string", "subject": "string",
    "told": "boolean", "media": "array<struct<media_id:string,mime:string,bytes:binary,w:bigint,h:bigint>>", "deepest": "int", "error": "string", "warnings": "int", "size": "bigint",
}


def complete(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """`df` with the columns that it lacks as nulls."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})


def element(kind: str, **told: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), *[told.get(c, F.lit(None)).cast(t).alias(c) for c, t in ELEMENT.items() if c != "kind"])


def of_lines(text: Column) -> Column:
    """The content of a plain text, a paragraph a line."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    return F.flatten(F.transform(lines, lambda line: F.when(line == "", F.array(element("paragraph"))).otherwise(F.array(element("paragraph"), element("run", text=line)))))


def with_content(cells: DataFrame) -> DataFrame:
    """Cells of a reader that gives texts alone."""
    return cells if "content" in cells.columns else cells.withColumn("content", of_lines(F.col("text")))


def tidy(content: Column) -> Column:
    """The content without paragraphs that are there for a table's sake: one that holds nothing but the table behind it, and
    an empty one between a cell's last table and its end."""

    def needed(x: Column, i: Column) -> Column:
        kind = lambda k: F.coalesce(F.get(content, i + k)["kind"], F.lit("end"))
        holds = (kind(1) == "table") & kind(2).isin("paragraph", "end")
        ends = (i > 0) & (kind(-1) == "table") & (kind(1) == "end")
        return (x["kind"] != "paragraph") | ~(holds | ends)

    return F.filter(content, needed)


def plain_text(content: Column) -> Column:
    """A line for each paragraph that has text."""
    marked = F.transform(content, lambda x: F.when(x["kind"] == "paragraph", F.lit("\x1e")).when(x["kind"] == "run", F.coalesce(x["text"], F.lit(""))).otherwise(""))
    return F.regexp_replace(F.trim(F.array_join(marked, ""), F.lit("\x1e")), "\x1e+", "\n")


def rendered(content: Column, opens, closes: str, run, table, blank: str) -> Column:
    """The content in a format: opens(column of an element) begins a paragraph that `closes` ends, run(column) and
    table(element) give what is in it and what stands between paragraphs; `blank` is an empty paragraph."""

    def one(x: Column, i: Column) -> Column:
        field = lambda name: x[name]
        before = F.coalesce(F.get(content, i - 1)["kind"], F.lit("start"))
        closing = F.when(before.isin("paragraph", "run"), closes).otherwise("")
        is_open = F.when(before.isin("paragraph", "run"), "").otherwise(opens(field))
        return (
            F.when(x["kind"] == "paragraph", F.concat(closing, opens(field)))
            .when(x["kind"] == "table", F.concat(closing, F.coalesce(table(x), F.lit(""))))
            .otherwise(F.concat(is_open, F.coalesce(run(field), F.lit(""))))
        )

    last = F.get(content, F.size(content) - 1)["kind"]
    ending = F.when(last == "table", blank).otherwise(closes)
    return F.when(F.coalesce(F.size(content), F.lit(0)) > 0, F.concat(F.array_join(F.transform(content, one), ""), ending)).otherwise(blank)

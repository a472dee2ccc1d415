"""DOCX documents with all styles resolved, and the shapes that a package of the other format would list."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from doclake.operators import styles as st
from doclake.operators.registry import dedup_shapes
from doclake.sources import package, xmlrows
from doclake.sources.scratch import stored

#: Attributes that make a character and a paragraph shape, and the ids that come before a document's own.
CHAR_KEY = ["bold", "italic", "underline", "strike", "sup", "sub", "size", "color", "shade", "fill", "font"]
PARA_KEY = ["align", "left", "right", "indent", "before", "after", "line_type", "line_value", "level", "keep_next", "keep_lines", "break_before"]
CHAR_FIRST, PARA_FIRST = 29, 30


class Resolved:
    """paragraphs: doc_id, para, PARA_KEY, shape_id; runs: doc_id, para, pos, text, CHAR_KEY, shape_id. Each is worked out
    when it is asked for."""

    def __init__(self, rows: DataFrame, inherited: DataFrame, sheet_of: DataFrame):
        paragraphs = rows.where("row_type = 'paragraph'").withColumn("last", F.col("para") == F.max("para").over(Window.partitionBy("doc_id")))
        self._rows, self._inherited = rows, inherited
        self._paragraphs = paragraphs.join(sheet_of, "doc_id", "left")

    @cached_property
    def paragraphs(self) -> DataFrame:
        return dedup_shapes(stored(st.resolved_paragraphs(self._paragraphs, self._inherited)), PARA_KEY, "para", PARA_FIRST)

    @cached_property
    def runs(self) -> DataFrame:
        of = self._paragraphs.select("doc_id", "para", "sheet", F.col("style_id").alias("of"))
        held = self._rows.where("row_type = 'text'").join(of, ["doc_id", "para"])
        held = held.drop("style_id").withColumnsRenamed({"of": "style_id", "ord": "pos"}).withColumn("link", F.col("ref").isNotNull())
        runs = stored(st.resolved_runs(held, self._inherited).withColumn("at", F.struct("para", "pos")))
        return dedup_shapes(runs, CHAR_KEY, "at", CHAR_FIRST).drop("at")


def resolve_docx(docs: DataFrame) -> Resolved:
    """From doc_id, bytes: style chains followed, direct values first, equal shapes of a document under one id."""
    parts = stored(package.unzip_parts(docs, ("word/document.xml", "word/styles.xml"), ("word/document.xml",))).where("error IS NULL")
    rows = stored(xmlrows.docx_direct_rows(parts)).where("error IS NULL")
    spacing, ind = ["before", "after", "line", "line_rule"], ["ind_left", "ind_right", "first_line", "hanging"]
    # chains are followed once for each distinct style sheet
    sheets, sheet_of = xmlrows.sheets(parts, "word/styles.xml")
    told = xmlrows.docx_styles(sheets).dropDuplicates(["doc_id", "style_id"]).select("doc_id", "style_id", "based_on", "align", "sz", "color", *ind, *spacing)
    # a line rule alone makes no spacing
    told = told.withColumn("line_rule", F.when(F.col("line").isNotNull(), F.col("line_rule")))
    inherited = stored(st.style_inherit(stored(told), ["align", "sz", "color"], {"ind": ind, "spacing": spacing}))
    return Resolved(rows, inherited.withColumnRenamed("doc_id", "sheet"), sheet_of)

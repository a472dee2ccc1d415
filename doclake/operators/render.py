"""Documents back to Markdown, by expressions over a document's row, and flat tables to HTML, by ordered aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclake.operators.markdown import let, ordered_join


def run_md(c=F.col) -> Column:
    """A run's Markdown from its columns, inner marks first. A link's own underline is not written again."""
    put = lambda t, flag, left, right: F.when(F.coalesce(flag, F.lit(False)), F.concat(F.lit(left), t, F.lit(right))).otherwise(t)
    t = put(c("text"), c("strike"), "~~", "~~")
    t = put(t, c("underline") & c("url").isNull(), "<u>", "</u>")
    stars = F.when(c("bold") & c("italic"), "***").when(c("bold"), "**").when(c("italic"), "*").otherwise("")
    t = F.concat(stars, t, stars)
    t = put(put(t, c("sup"), "<sup>", "</sup>"), c("sub"), "<sub>", "</sub>")
    return F.when(c("url").isNotNull(), F.concat(F.lit("["), t, F.lit("]("), c("url"), F.lit(")"))).otherwise(t)


def _trimmed(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def _lead(c) -> Column:
    """What a heading or a list item begins with."""
    mark = F.when(c("list_ordered"), F.concat((c("list_level") + 1).cast("string"), F.lit("."))).otherwise("-")
    return (
        F.when(c("heading").isNotNull(), F.concat(F.repeat(F.lit("#"), c("heading")), F.lit(" ")))
        .when(c("list_level").isNotNull(), F.concat(F.repeat(F.lit("  "), c("list_level")), mark, F.lit(" "))).otherwise("")
    )


def _note_name(c) -> Column:
    return F.concat(F.lit("[^"), F.when(c("note_kind") == "endnote", "e").otherwise(""), c("no").cast("string"), F.lit("]"))


def _piece(c) -> Column:
    """What a run, an image or the call of a note shows. An image without bytes, and a note that isn't there, show nothing."""
    held = F.get("media", c("med"))
    image = F.concat(F.lit("![image](data:"), held["mime"], F.lit(";base64,"), F.base64(held["bytes"]), F.lit(")"))
    special = F.when(c("note_kind").isNotNull(), F.coalesce(_note_name(c), F.lit(""))).when(c("media_id").isNotNull(), F.coalesce(image, F.lit("")))
    return F.when(c("note_kind").isNull() & c("media_id").isNull(), run_md(c)).otherwise(special)


def paragraph_md(inline: Column, c=F.col) -> Column:
    """A paragraph's Markdown from heading, list_level and list_ordered; an ordered item's number is its level's."""
    listed = lambda t: let(_trimmed(t), lambda bare: F.when(bare == "", "").otherwise(F.concat(_lead(c), bare)))
    return let(inline, lambda t: F.when(c("heading").isNotNull() | c("list_level").isNotNull(), listed(t)).when(t.rlike(r"\S"), t).otherwise(""))


def cell_md(content: Column) -> Column:
    """A cell's Markdown: its paragraphs that aren't blank, with breaks between; tables in it are blocks of their own."""
    begin, lead = "\x1e", "\x1f"  # no text from XML has these
    fields = lambda x: lambda n: x[n]
    shown = F.transform(content, lambda x: F.when(x["kind"] == "paragraph", F.concat(F.lit(begin), _lead(fields(x)), F.lit(lead))).when(x["kind"] == "run", F.coalesce(_piece(fields(x)), F.lit(""))).otherwise(F.lit(begin)))

    def whole(cut: Column) -> Column:
        inline = _trimmed(F.replace(F.get(cut, F.size(cut) - 1), F.lit("\n"), F.lit("<br>")))
        return let(inline, lambda t: F.when(t == "", "").otherwise(F.concat(F.when(F.size(cut) > 1, F.get(cut, F.lit(0))).otherwise(""), t)))

    lines = F.filter(F.transform(F.split(F.array_join(shown, ""), begin, -1), lambda line: let(F.split(line, lead, 2), whole)), lambda x: x != "")
    return F.array_join(lines, "<br>")


def table_md(cells: Column) -> Column:
    """A table's Markdown from its cells in order. The first row is the header; merged-away cells are '', empty ones a space."""
    shown = lambda c: F.when(c["row_span"] == 0, "").otherwise(let(cell_md(c["content"]), lambda t: F.when(t == "", " ").otherwise(F.replace(t, F.lit("\n"), F.lit("<br>")))))
    heads = F.size(F.filter(cells, lambda c: c["row"] == 0))
    rule = F.when(heads > 0, F.concat(F.lit(" |\n| "), F.array_join(F.array_repeat(F.lit("---"), heads), " | "), F.lit(" |"))).otherwise(" |")

    def whole(rule: Column) -> Column:
        before = lambda i: F.get(cells, i - 1)["row"]
        ends = lambda row: F.when(row == 0, rule).otherwise(" |")
        between = lambda c, i: F.when(i == 0, "| ").when(before(i) == c["row"], " | ").otherwise(F.concat(ends(before(i)), F.lit("\n| ")))
        return F.concat(F.array_join(F.transform(cells, lambda c, i: F.concat(between(c, i), shown(c))), ""), ends(F.get(cells, F.size(cells) - 1)["row"]))

    return F.when(F.size(cells) > 0, let(rule, whole))


def _notes_md() -> Column:
    """The texts of the notes, a line each, or null: those of the foot, then those of the end."""
    of = lambda xs: F.filter(xs, lambda x: x["note_kind"].isNotNull() & x["note"].isNotNull())
    line = lambda x: F.struct((x["note_kind"] == "endnote").alias("end"), x["no"].alias("no"), F.concat(_note_name(lambda n: x[n]), F.lit(": "), F.regexp_replace(x["note"], r"\s*\n\s*", " ")).alias("line"))
    own = lambda b: F.concat(F.transform(of(b["runs"]), line), F.flatten(F.transform(b["cells"], lambda c: F.transform(of(c["content"]), line))))
    return F.nullif(F.array_join(F.transform(F.sort_array(F.flatten(F.transform("blocks", own))), lambda x: x["line"]), "\n"), F.lit(""))


def render_markdown(docs: DataFrame) -> DataFrame:
    """doc_id, md, error, warnings of documents (content.DOCUMENT). Notes are called by `[^1]` (endnotes `[^e1]`) and told at the end.
    A document is one row, so nothing is shuffled."""
    inline = lambda b: F.array_join(F.transform(b["runs"], lambda r: _piece(lambda n: r[n])), "")
    block = lambda b: F.when(b["kind"] == "paragraph", paragraph_md(inline(b), lambda n: b[n])).when(b["kind"] == "pageBreak", "---").otherwise(table_md(b["cells"]))
    body = F.filter(F.transform("blocks", block), lambda md: md.rlike(r"\S"))
    line = lambda k: F.when(F.coalesce(k, F.lit("")) != "", F.concat(F.lit(f'{k}: "'), k, F.lit('"')))
    front = F.concat_ws("\n", F.lit("---"), line("title"), line("author"), line("subject"), F.lit("---"))
    has = F.coalesce(F.nullif("title", F.lit("")), F.nullif("author", F.lit(""))).isNotNull()
    whole = let(F.concat(body, F.array_compact(F.array(_notes_md()))), lambda b: F.when((F.size(b) > 0) | F.col("told"), F.concat_ws("\n\n", F.when(has, front), F.when(F.size(b) > 0, F.array_join(b, "\n\n")))))
    return docs.select("doc_id", _trimmed(F.regexp_replace(whole, r"\n{3,}", "\n\n")).alias("md"), "error", "warnings")


def table_html(cells: DataFrame, *keys: str) -> DataFrame:
    """keys, html. cells: keys, row, col, row_span, col_span, text, style; merged-away cells are left out."""
    attr = lambda c, name: F.when(F.col(c) > 1, F.concat(F.lit(f' {name}="'), F.col(c).cast("string"), F.lit('"'))).otherwise("")
    style = F.when(F.coalesce("style", F.lit("")) != "", F.concat(F.lit(' style="'), "style", F.lit('"'))).otherwise("")
    cell = F.concat(F.lit("<td"), attr("col_span", "colspan"), attr("row_span", "rowspan"), style, F.lit(">"), F.coalesce("text", F.lit("")), F.lit("</td>"))
    rows = cells.where("row_span > 0").withColumn("cell", cell).groupBy(*keys, "row").agg(ordered_join("cell", "col", "").alias("tds"))
    rows = rows.withColumn("tr", F.concat(F.lit("<tr>"), "tds", F.lit("</tr>")))
    return rows.groupBy(*keys).agg(F.concat(F.lit('<table style="border-collapse: collapse"><tbody>'), ordered_join("tr", "row", ""), F.lit("</tbody></table>")).alias("html"))

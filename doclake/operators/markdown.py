"""Markdown text to front matter, lines, groups, blocks, table cells and inline runs.

All steps are column expressions over one document's text. Its lines are an array until it is cut into blocks, so
nothing is shuffled or sorted for it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FRONT = r"(?s)^---\n(.*?)\n---\n(.*)$"
TABLE_SEP = r"^\s*\|[\s|:-]+\|"
#: Front-matter keys of the page, with their defaults in HWPUNIT (fixed values).
PAGE_DEFAULTS = {
    "pageWidth": 59528,
    "pageHeight": 84188,
    "marginLeft": 8504,
    "marginRight": 8504,
    "marginTop": 5668,
    "marginBottom": 4252,
    "marginHeader": 4252,
    "marginFooter": 4252,
}
#: Inline constructs, leftmost first; of two that begin together the earlier one here wins (fixed format).
INLINE = r"\*\*\*.+?\*\*\*|\*\*.+?\*\*|\*.+?\*|~~.+?~~|`.+?`|<u>.+?</u>|<sup>.+?</sup>|<sub>.+?</sub>|\[[^\]]+\]\([^)]+\)"
LINK_COLOR, CODE_FONT = "0563C1", "Courier New"


def split_front_matter(docs: DataFrame) -> DataFrame:
    """doc_id, front (null if there is none), body."""
    has = F.col("md").rlike(FRONT)
    return docs.select(
        "doc_id",
        F.when(has, F.regexp_extract("md", FRONT, 1)).alias("front"),
        F.when(has, F.regexp_extract("md", FRONT, 2)).otherwise(F.col("md")).alias("body"),
    )


def front_matter_entries(front: DataFrame) -> DataFrame:
    """doc_id, key, value; the last of equal keys wins."""
    line = r'^(\w+):\s*"?([^"]*)"?'
    rows = front.where("front IS NOT NULL").select("doc_id", F.posexplode(F.split("front", "\n", -1)).alias("ln", "raw")).where(F.col("raw").rlike(line))
    key, value = F.regexp_extract("raw", line, 1), F.trim(F.regexp_extract("raw", line, 2))
    return rows.select("doc_id", key.alias("key"), "ln", value.alias("value")).groupBy("doc_id", "key").agg(F.max_by("value", "ln").alias("value"))


def front_matter_map(front: DataFrame) -> DataFrame:
    """doc_id, meta map<string,string>."""
    entries = front_matter_entries(front).groupBy("doc_id").agg(F.collect_list(F.struct("key", "value")).alias("e"))
    return entries.select("doc_id", F.map_from_entries("e").alias("meta"))


def front_matter_value(front: Column, key: str) -> Column:
    """The value of one key, as front_matter_entries() gives it."""
    line = rf'^{key}:\s*"?([^"]*)"?'
    return F.trim(F.regexp_extract(F.try_element_at(F.filter(F.split(front, "\n", -1), lambda raw: raw.rlike(line)), F.lit(-1)), line, 1))


def _own_page() -> dict[str, Column]:
    return {k: F.expr(f"try_cast(nullif(regexp_extract(front, '(?m)^{k}: *([0-9]+)', 1), '') AS INT) * 5") for k in PAGE_DEFAULTS}


def page_values(keys: list[str]) -> tuple[dict[str, Column], Column]:
    """The page measures of `front` in HWPUNIT, with the defaults of those that it doesn't give, and whether it gives any."""
    own = _own_page()
    return {k: F.coalesce(own[k], F.lit(PAGE_DEFAULTS[k])) for k in keys}, reduce(lambda a, b: a | b, [c.isNotNull() for c in own.values()])


def front_matter_page(front: DataFrame) -> DataFrame:
    """The page measures in HWPUNIT of documents that give any of them; the others get their defaults."""
    own = _own_page()
    given = front.select("doc_id", *[c.alias(k) for k, c in own.items()])
    any_given = reduce(lambda a, b: a | b, [F.col(k).isNotNull() for k in PAGE_DEFAULTS])
    return given.where(any_given).select("doc_id", *[F.coalesce(F.col(k), F.lit(v)).alias(k) for k, v in PAGE_DEFAULTS.items()])


def explode_lines(bodies: DataFrame) -> DataFrame:
    """doc_id, ln (from 0), raw; empty lines too."""
    return bodies.select("doc_id", F.posexplode(F.split("body", "\n", -1)).alias("ln", "raw"))


def line_kind(raw: Column) -> Column:
    """Kind of one line by itself, by the first rule that fits."""
    rules = [
        ("blank", r"^[\s ]*$"),
        ("heading", r"^#{1,6}\s+.*"),
        ("fence", r"^```"),
        ("hrule", r"^[-*_]{3,}\s*$"),
        ("table_sep", TABLE_SEP),
        ("table_row", r"^\s*\|.+\|"),
        ("bullet", r"^\s*[-*+]\s+.+"),
        ("ordered", r"^\s*\d+[.)]\s+.+"),
    ]
    out = F.lit("text")
    for name, rule in reversed(rules):
        out = F.when(raw.rlike(rule), F.lit(name)).otherwise(out)
    return out


def classify_lines(lines: DataFrame) -> DataFrame:
    """Lines with kind and depth: number of # of a heading, half the indent of a list item, else null."""
    kind = line_kind(F.col("raw"))
    hashes = F.length(F.regexp_extract("raw", r"^(#{1,6})\s", 1))
    indent = F.floor(F.length(F.regexp_extract("raw", r"^(\s*)", 1)) / 2).cast("int")
    return lines.withColumn("kind", kind).withColumn("depth", F.when(F.col("kind") == "heading", hashes).when(F.col("kind").isin("bullet", "ordered"), indent))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _family(kind: Column) -> Column:
    """What a line outside code merges with."""
    return F.when(kind.isin("bullet", "ordered"), "list").when(kind.isin("table_row", "table_sep"), "table").otherwise(kind)


GROUPS = "array<struct<first:int,last:int,gkind:string>>"


def line_groups(kinds: Column) -> Column:
    """first and last line and gkind of each group of a document's lines, in order; blank lines are gone.

    Fences first: they cut the lines into stretches, every other of which is code with the fences around it. Then gaps
    and islands by what lines merge with. Every step is bounded by the number of lines.
    """
    single = ("heading", "hrule", "blank")

    def plain(family: Column, lo: Column, hi: Column) -> Column:
        opens = lambda i: (i == lo) | (F.get(family, i) != F.get(family, i - 1)) | F.get(family, i).isin(*single)
        group = lambda starts: lambda i, j: F.struct(i.alias("first"), F.coalesce(F.get(starts, j + 1) - 1, hi).alias("last"), F.get(family, i).alias("gkind"))
        return F.filter(let(F.filter(F.sequence(lo, hi), opens), lambda starts: F.transform(starts, group(starts))), lambda g: g["gkind"] != "blank")

    def stretch(family: Column, fences: Column, k: Column) -> Column:
        code, many = k % 2 == 1, F.size(fences)
        before, after = F.get(fences, k - 1), F.get(fences, k)
        lo = F.when(k == 0, 0).when(code, before).otherwise(before + 1)
        hi = F.when(k == many, F.size(family) - 1).when(code, after).otherwise(after - 1)
        whole = lambda at: F.array(F.struct(at["lo"].alias("first"), at["hi"].alias("last"), F.lit("code").alias("gkind")))
        return let(F.struct(lo.alias("lo"), hi.alias("hi")), lambda at: F.when(code, whole(at)).when(at["lo"] <= at["hi"], plain(family, at["lo"], at["hi"])).otherwise(F.array().cast(GROUPS)))

    def groups(family: Column) -> Column:
        fences = F.filter(F.transform(family, lambda f, i: F.when(f == "fence", i)), lambda i: i.isNotNull())
        return let(fences, lambda at: F.flatten(F.transform(F.sequence(F.lit(0), F.size(at)), lambda k: stretch(family, at, k))))

    return let(F.transform(kinds, _family), groups)


def _of_document(made: Callable[[Column, Column], Column]) -> Column:
    """made(raw lines, their groups) of a document's body."""
    return let(F.split("body", "\n", -1), lambda lines: let(line_groups(F.transform(lines, line_kind)), lambda groups: made(lines, groups)))


def group_lines(bodies: DataFrame) -> DataFrame:
    """doc_id, grp (its order), gkind, first_ln, last_ln of what belongs to a block."""
    rows = bodies.select("doc_id", F.posexplode_outer(_of_document(lambda lines, groups: groups)).alias("grp", "one")).where("one IS NOT NULL")
    return rows.select("doc_id", "grp", "one.gkind", F.col("one.first").alias("first_ln"), F.col("one.last").alias("last_ln"))


def ordered_join(value: str, order: str, sep: str = "\n") -> Column:
    """The values of a group joined in order: an aggregate."""
    held = F.array_sort(F.collect_list(F.struct(order, value)))
    return F.array_join(F.transform(held, lambda s: s[value]), sep)


BLOCKS = "array<struct<blk:int,kind:string,heading:int,list_level:int,list_ordered:boolean,font:string,text:string,rows:array<string>>>"


def blocks_of(lines: Column, groups: Column) -> Column:
    """The blocks of a document, in order: structs of blk (first line), kind, heading, list_level, list_ordered, font, text, rows.

    A list gives a paragraph for each item, a table one block without text but with its lines as rows, code its lines
    without the first and the last one, a rule a page break.
    """
    none = {"heading": "int", "list_level": "int", "list_ordered": "boolean", "font": "string", "text": "string", "rows": "array<string>"}
    block = lambda blk, kind, **told: F.struct(blk.alias("blk"), kind.alias("kind"), *[told.get(c, F.lit(None)).cast(t).alias(c) for c, t in none.items()])

    def item(i: Column) -> Column:
        raw = F.get(lines, i)
        level = F.floor(F.length(F.regexp_extract(raw, r"^(\s*)", 1)) / 2)
        return block(i, F.lit("paragraph"), list_level=level, list_ordered=~raw.rlike(r"^\s*[-*+]\s+.+"), text=F.regexp_extract(raw, r"^\s*(?:[-*+]|\d+[.)])\s+(.+)", 1))

    def whole(g: Column) -> Column:
        first, last, gkind = g["first"], g["last"], g["gkind"]
        raw = F.get(lines, first)
        held = F.slice(lines, first + 1, last - first + 1)
        inner = F.slice(lines, first + 2, F.greatest(last - first - 1, F.lit(0)))  # code without its fences
        text = F.when(gkind == "heading", F.regexp_extract(raw, r"^#{1,6}\s+(.*)", 1)).when(gkind == "code", F.array_join(inner, "\n")).when(gkind == "text", F.array_join(held, "\n"))
        kind = F.when(gkind == "hrule", "pageBreak").when(gkind == "table", "table").otherwise("paragraph")
        heading = F.when(gkind == "heading", F.length(F.regexp_extract(raw, r"^(#{1,6})\s", 1)))
        return block(first, kind, heading=heading, font=F.when(gkind == "code", CODE_FONT), text=text, rows=F.when(gkind == "table", held))

    return F.flatten(F.transform(groups, lambda g: F.when(g["gkind"] == "list", F.transform(F.sequence(g["first"], g["last"]), item)).otherwise(F.array(whole(g)))))


def document_blocks(bodies: DataFrame) -> DataFrame:
    """doc_id, front, blocks (those of blocks_of()): a document is read as one row, without a shuffle or a sort."""
    return bodies.select("doc_id", "front", _of_document(blocks_of).alias("blocks"))


def exploded(documents: DataFrame) -> DataFrame:
    """doc_id and the columns of blocks_of(), a row a block."""
    # an inner explode would have the optimiser work out the blocks once more, to leave documents without any out
    return documents.select("doc_id", F.explode_outer("blocks").alias("one")).where("one IS NOT NULL").select("doc_id", "one.*")


def markdown_blocks(docs: DataFrame) -> DataFrame:
    """The blocks of documents (doc_id, md)."""
    return exploded(document_blocks(split_front_matter(docs))).drop("rows")


def row_cells(raw: Column) -> Column:
    """The texts of the cells of a table's line."""
    return let(F.split(raw, r"\|", -1), lambda parts: F.slice(parts, F.lit(2), F.size(parts) - 2))


def pipe_table_cells(blocks: DataFrame) -> DataFrame:
    """doc_id, blk, row, col, text of tables (blocks with rows); separator lines are gone, rows are not padded."""
    rows = F.filter("rows", lambda raw: ~raw.rlike(TABLE_SEP))
    lines = blocks.where("kind = 'table'").select("doc_id", "blk", F.posexplode_outer(rows).alias("row", "raw")).where("raw IS NOT NULL")
    parts = F.split("raw", r"\|", -1)
    cells = lines.select("doc_id", "blk", "row", F.posexplode_outer(F.slice(parts, 2, F.size(parts) - 2)).alias("col", "text"))
    return cells.where("text IS NOT NULL").withColumn("text", F.trim("text"))


def pipe_table_cells_padded(blocks: DataFrame) -> DataFrame:
    """doc_id, blk, row, col, width, lines of the other dialect: the first line is the header and sets the number of
    columns, the second is skipped, others are padded with '' or cut; `<br>` parts a cell's lines."""
    cells_of = lambda raw: F.split(F.regexp_replace(F.trim(raw), r"^\||\|$", ""), r"\|", -1)
    rows = blocks.where("kind = 'table'").withColumn("many", F.size(cells_of(F.get("rows", F.lit(0)))))
    rows = rows.select("doc_id", "blk", "many", F.posexplode("rows").alias("nth", "raw")).where("nth <> 1")
    even = F.slice(F.concat(cells_of(F.col("raw")), F.array_repeat(F.lit(""), F.col("many"))), 1, F.col("many"))
    out = rows.select("doc_id", "blk", F.when(F.col("nth") == 0, 0).otherwise(F.col("nth") - 1).alias("row"), "many", F.posexplode(even).alias("col", "text"))
    return out.select("doc_id", "blk", "row", "col", F.floor(F.lit(41954) / F.col("many")).cast("int").alias("width"), F.split(F.trim("text"), "<br>", -1).alias("lines"))


#: What every inline construct begins with, and what stands for one while a text is cut.
MARKS, CUT = r"[*~`<\[]", "\x1f"


def _pieces(text: Column) -> Column:
    """The pieces of a text between, and of, its inline constructs: structs of t and form; empty ones are gone."""
    # split() compiles a pattern anew for each row, but not one of a single character
    cut = F.when(text.contains(CUT), F.split(text, INLINE, -1)).otherwise(F.split(F.regexp_replace(text, INLINE, CUT), CUT, -1))
    marked = F.regexp_extract_all(text, F.lit(INLINE), F.lit(0))
    piece = lambda t, m: F.struct(t.alias("t"), F.lit(m).alias("m"))
    woven = lambda plain: F.flatten(F.transform(plain, lambda p, i: F.array(piece(p, False), piece(F.get(marked, i), True))))
    return F.when(~text.rlike(MARKS) & (text != ""), F.array(piece(text, False))).otherwise(F.filter(woven(cut), lambda p: p["t"] != ""))


def _form(t: Column, m: Column) -> Column:
    held = lambda mark: t.startswith(mark) & t.endswith(mark) & (F.length(t) > 2 * len(mark))
    is_ = lambda lead: t.startswith(lead)
    return (
        F.when(~m, "plain").when(held("***"), "bi").when(held("**"), "b").when(is_("*"), "i").when(is_("~~"), "s").when(is_("`"), "code")
        .when(is_("<u>"), "u").when(is_("<sup>"), "sup").when(is_("<sub>"), "sub").otherwise("link")
    )


def _run_columns(t: Column, f: Column) -> list[Column]:
    cut = lambda a, b: F.substr(t, F.lit(a + 1), F.length(t) - (a + b))
    body = (
        F.when(f == "plain", t).when(f == "bi", cut(3, 3)).when(f.isin("b", "s"), cut(2, 2)).when(f.isin("i", "code"), cut(1, 1)).when(f == "u", cut(3, 4))
        .when(f.isin("sup", "sub"), cut(5, 6)).otherwise(F.regexp_extract(t, r"^\[([^\]]+)\]", 1))
    )
    flag = lambda *names: F.when(f.isin(*names), F.lit(True))
    return [
        body.alias("text"), flag("b", "bi").alias("bold"), flag("i", "bi").alias("italic"), flag("u", "link").alias("underline"),
        flag("s").alias("strike"), flag("sup").alias("sup"), flag("sub").alias("sub"), F.when(f == "code", CODE_FONT).alias("font"),
        F.when(f == "link", LINK_COLOR).alias("color"), F.when(f == "link", F.regexp_extract(t, r"\(([^)]+)\)$", 1)).alias("url"),
    ]


def inline_runs(texts: DataFrame, *keys: str) -> DataFrame:
    """keys, pos, text and style columns of every run of `text`; url of links."""
    # an outer one: see exploded()
    rows = texts.select(*keys, F.posexplode_outer(_pieces(F.col("text"))).alias("pos", "piece")).where("piece IS NOT NULL").select(*keys, "pos", F.col("piece.t").alias("t"), _form(F.col("piece.t"), F.col("piece.m")).alias("form"))
    return rows.select(*keys, "pos", *_run_columns(F.col("t"), F.col("form")))


def inline_array(text: Column, made) -> Column:
    """An array of made(columns of a run) for the runs of a text, in order, where rows are not to be parted."""
    marked = lambda t: let(_form(t, F.lit(True)), lambda form: made(_run_columns(t, form)))
    return F.transform(_pieces(text), lambda p: F.when(p["m"], marked(p["t"])).otherwise(made(_run_columns(p["t"], F.lit("plain")))))


def inline_plain(text: Column) -> Column:
    """The text without emphasis marks, in the dialect whose marks must touch a character that is no space."""
    for mark in (r"\*\*\*", "___", r"\*\*", "__", r"\*", "_", "~~"):
        text = F.regexp_replace(text, rf"(?s){mark}(?=\S)(.+?)(?<=\S){mark}", "$1")
    return F.regexp_replace(text, r"`([^`]+)`", "$1")


def links(docs: DataFrame) -> DataFrame:
    """doc_id, nth, label, url of every `[label](url)` of md; images not counted."""
    rule = r"(?<!!)\[([^\]]+)\]\(([^)]+)\)"
    both = F.arrays_zip(F.regexp_extract_all("md", F.lit(rule), F.lit(1)).alias("label"), F.regexp_extract_all("md", F.lit(rule), F.lit(2)).alias("url"))
    return docs.select("doc_id", F.posexplode(both).alias("nth", "l")).select("doc_id", "nth", "l.label", "l.url")


def images(docs: DataFrame) -> DataFrame:
    """doc_id, nth, alt, path of every `![alt](path)`."""
    rule = r"!\[(.*?)\]\((.*?)\)"
    both = F.arrays_zip(F.regexp_extract_all("md", F.lit(rule), F.lit(1)).alias("alt"), F.regexp_extract_all("md", F.lit(rule), F.lit(2)).alias("path"))
    return docs.select("doc_id", F.posexplode(both).alias("nth", "l")).select("doc_id", "nth", "l.alt", "l.path")


def md_to_text(md: Column) -> Column:
    """Plain text rewrites: links as `t (u)`, task boxes, quote marks and carriage returns gone."""
    md = F.regexp_replace(md, r"\r", "")
    md = F.regexp_replace(md, r"\[([^\]]+)\]\(([^)]+)\)", "$1 ($2)")
    md = F.replace(F.replace(md, F.lit("[ ]"), F.lit("☐")), F.lit("[x]"), F.lit("☑"))
    return F.regexp_replace(md, r"(?m)^> ?", "")


def list_shape(lines: DataFrame) -> DataFrame:
    """doc_id, ln, depth (four spaces each), shape: paragraph shape 21 + depth, 25 for top ordered items."""
    depth = F.floor(F.length(F.regexp_extract("raw", r"^( *)", 1)) / 4).cast("int")
    items = lines.where("kind IN ('bullet', 'ordered')").select("doc_id", "ln", "kind", depth.alias("depth"))
    return items.select("doc_id", "ln", "depth", F.when((F.col("kind") == "ordered") & (F.col("depth") == 0), 25).otherwise(21 + F.col("depth")).alias("shape"))

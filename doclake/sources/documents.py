"""Packages to one row a document (content.DOCUMENT): what follows needs no rows, joins or shuffles of its own."""

from __future__ import annotations

import functools
import re
import xml.etree.ElementTree as ET
from collections import Counter

from pyspark.sql import DataFrame

from doclake.functions.media import measured
from doclake.operators.content import DOCUMENT, FLAGS, RUN
from doclake.operators.registry import FIRST_FACE
from doclake.sources import package
from doclake.sources.arrow import SMALL, mapped_rows
from doclake.sources.xmlrows import MARGINS, NAMING, _attr, _bare, _char_shape, _docx, _faces, _hwpx, _hwpx_style, _number, _Package, _paragraph_marks

COLUMNS = ", ".join(f"{name} {kind}" for name, kind in DOCUMENT.items())
NOTES = ("footnote", "endnote")
BESIDE = ("section", "unsupported", *MARGINS)
NO_RUN = (None,) * (len(RUN) + 3)
NO_MARKS = (None, None, None, None)
DC = "{http://purl.org/dc/elements/1.1/}"


def _needed(content: list[tuple]) -> list[tuple]:
    """content.tidy() of one cell."""
    kinds = [e[0] for e in content]
    if "table" not in kinds:
        return content
    kind = lambda i: kinds[i] if 0 <= i < len(kinds) else "end"
    holds = lambda i: kind(i + 1) == "table" and kind(i + 2) in ("paragraph", "end")
    ends = lambda i: i > 0 and kind(i - 1) == "table" and kind(i + 1) == "end"
    return [e for i, e in enumerate(content) if kinds[i] != "paragraph" or not (holds(i) or ends(i))]


def _spanned(cells: list[list]) -> None:
    """Sets col and row_span of one table's cells (row, col, row_span, col_span, content, vm), whose col counts the cells of a row,
    as tables.grid_columns() and tables.row_spans() do."""
    grid: dict[int, list] = {}  # down each column: row, mark, cell
    row = col = None
    for c in cells:
        col = col if c[0] == row else 0
        row, c[1] = c[0], col
        for i in range(col, col + max(c[3], 1)):
            grid.setdefault(i, []).append((row, c[5] if i == col else None, c if i == col else None))
        col += c[3]
    for down in grid.values():
        islands: list[list] = []
        for k, (r, mark, _) in enumerate(down):
            if not (mark == "continue" and k and down[k - 1][0] == r - 1):
                islands.append([])
            islands[-1].append(down[k])
        for island in islands:
            orphan = island[0][1] == "continue"  # starts no span
            for k, (_, _, c) in enumerate(island):
                if c is not None:
                    c[2] = 1 if orphan else 0 if k else len(island)


class _Document:
    """The blocks of one document from its rows in order."""

    def __init__(self, by_cell: bool, media: dict):
        """by_cell: whether columns count the cells of a row, and cells merged into the one above say so; else they are places."""
        self.by_cell, self.media = by_cell, media
        self.blocks: list[list] = []
        self.sections, self.margins, self.told, self.warnings = [], {}, 0, 0
        self.rel, self.numbers, self.nested = 0, Counter(), Counter()
        self.tables: dict = {}

    def numbered(self, row: dict) -> tuple:
        """rel, no, med of a run."""
        kind = row["row_type"]
        if kind in NOTES:
            if row.get("note") is None:
                return None, None, None
            self.numbers[kind] += 1
            return None, self.numbers[kind], None
        if row.get("media_id") is not None:
            med = self.media.get(row["media_id"])
            if med is None:
                return None, None, None
            self.rel += 1
            self.numbers["image"] += 1
            return self.rel, self.numbers["image"], med
        if row.get("url") is not None:
            self.rel += 1
            return self.rel, None, None
        return None, None, None

    def run(self, row: dict) -> tuple:
        """RUN and NUMBERED of a row."""
        kind, get = row["row_type"], row.get
        note = kind if kind in NOTES else None
        text = "\n" if kind == "lineBreak" else "" if note else get("text") or ""
        flags = [get(f) or None for f in FLAGS]
        return text, *flags, get("color"), get("url"), get("font"), get("size_pt"), get("media_id"), note, get("note"), *self.numbered(row)

    def cell(self, sec: int, tbl: int, row: dict) -> list:
        """Of a table: [row, col, row_span, col_span, content, vm]."""
        at = (row["row"], row["col"])
        cells = self.tables.setdefault((sec, tbl), [None, {}])[1]
        if at not in cells:
            cells[at] = [*at, None, None, [], None]
        return cells[at]

    def read(self, rows: list[dict]) -> None:
        sec, prev, like, block = None, None, NO_MARKS, None
        for at, row in enumerate(rows, 1):
            if row["sec"] != sec:
                sec, prev, like, block = row["sec"], None, NO_MARKS, None
            kind, tbl = row["row_type"], row.get("tbl")
            if kind in BESIDE:
                self.beside(at, kind, row)
                continue
            is_run = kind in ("text", "lineBreak", *NOTES) or row.get("media_id") is not None
            if tbl is None or kind == "table":
                if kind == "pageBreak" and prev == "paragraph":
                    self.blocks.pop()  # nothing is before the break
                if kind == "paragraph":
                    like = (row.get("heading"), row.get("list_level"), row.get("list_ordered"), row.get("align"))
                if tbl is None and (kind in ("paragraph", "pageBreak") or prev in ("table", "pageBreak")):
                    block = [at, "pageBreak", *NO_MARKS, None, [], []] if kind == "pageBreak" else [at, "paragraph", *like, None, [], []]
                    self.blocks.append(block)
                prev = kind
                if tbl is None:
                    if is_run and block is not None:
                        block[7].append((at, *self.run(row)))
                    continue
            if kind == "table":
                level = row["level"]
                table = [at, "table", *NO_MARKS, level, [], []]
                self.blocks.append(table)
                self.tables.setdefault((sec, tbl), [None, {}])[0] = table
                if row.get("host") is not None:
                    self.cell(sec, row["host"], row)[4].append(("table", at, *NO_MARKS, *(None,) * len(RUN), at, None, self.nested[level], None))
                    self.nested[level] += 1
            elif kind == "cell":
                held = self.cell(sec, tbl, row)
                for i, k in ((2, "row_span"), (3, "col_span"), (5, "vm")):
                    v = row.get(k)
                    if v is not None and (held[i] is None or v > held[i]):
                        held[i] = v
            elif kind == "paragraph":
                self.cell(sec, tbl, row)[4].append(("paragraph", at, row.get("heading"), row.get("list_level"), row.get("list_ordered"), row.get("align"), *NO_RUN[:-3], None, None, None, None))
            elif is_run:
                held = self.cell(sec, tbl, row)
                run = self.run(row)
                held[4].append(("run", at, *NO_MARKS, *run[:-3], None, *run[-3:]))

    def beside(self, at: int, kind: str, row: dict) -> None:
        if kind == "section":
            # a section's page is told where it ends, as in DOCX, or where it begins, as in HWPX
            self.sections.append((self.told if self.by_cell else at - 1, [int(x) for x in row["text"].split(" ")]))
            self.told = at
        elif kind in MARGINS and row.get("note") is not None:
            sec = max(len(self.sections) - (0 if self.by_cell else 1), 0)
            self.margins.setdefault((sec, kind), []).append(row["note"])

    def done(self) -> tuple:
        """blocks, sections, margins."""
        for table, cells in self.tables.values():
            if table is None:
                continue
            own = sorted(cells.values(), key=lambda c: (c[0], c[1]))
            merged = self.by_cell and any((c[3] or 1) > 1 or c[5] is not None for c in own)
            for c in own:
                c[2], c[3] = 1 if c[2] is None else c[2], 1 if c[3] is None else c[3]
            if merged:
                _spanned(own)
            table[8] = [(*c[:4], _needed(c[4])) for c in own]
        margins = [(sec, kind, "\n".join(texts)) for (sec, kind), texts in self.margins.items()]
        return [tuple(b) for b in self.blocks], self.sections, margins


def _failed(error: str) -> list[tuple]:
    return [([], [], [], None, None, None, False, [], 0, error, 0, 0)]


def _part_error(name: str, data: bytes) -> str | None:
    try:
        ET.fromstring(data)
    except ET.ParseError as e:
        return f"ParseError: {name}: {e}"
    return None


_part_error_small = functools.lru_cache(64)(_part_error)


def _part_errors(parts: dict[str, bytes], names: tuple[str, ...]) -> list[str]:
    found = [(_part_error_small if len(parts[n]) <= SMALL else _part_error)(n, parts[n]) for n in names if n in parts]
    return [e for e in found if e]


def _said(data: bytes | None, told: tuple) -> tuple:
    """The texts of the first elements for which each of `told` holds; null where there is none or an empty one."""
    try:
        every = list(ET.fromstring(data).iter()) if data is not None else []
    except ET.ParseError:
        every = []
    first = [next((x for x in every if is_(x)), None) for is_ in told]
    return tuple(None if x is None else "".join(x.itertext()) or None for x in first)


def _media(parts: dict[str, bytes], media_id) -> tuple[list[tuple], dict]:
    """The images of a package, the first of each name, and their places."""
    out: dict = {}
    for name, data in parts.items():
        own = media_id(name)
        if own is not None and own not in out:
            mime, w, h = measured(data)
            out[own] = (own, mime, data, w, h)
    return list(out.values()), {k: i for i, k in enumerate(out)}


def _row(rows: list[dict], by_cell: bool, media: tuple, said: tuple, told: bool, errors: list[str], warnings: int, parts: dict[str, bytes]) -> list[tuple]:
    out = _Document(by_cell, media[1])
    out.read(rows)
    blocks, sections, margins = out.done()
    deepest = max((b[6] for b in blocks if b[1] == "table"), default=0)
    return [(blocks, sections, margins, *said, told, media[0], deepest, min(errors, default=None), warnings, sum(map(len, parts.values())))]


# ---- DOCX

DOCX_PARTS = ("word/document.xml", *NAMING, "docProps/core.xml")
DOCX_FOLDERS = ("word/media/", "word/header", "word/footer")
DOCX_CHECKED = ("word/styles.xml", "word/numbering.xml", "word/footnotes.xml", "word/endnotes.xml")
SIDES = {"both": "justify", "start": "left", "end": "right"} | {a: a for a in ("left", "center", "right", "justify", "distribute")}
_CORE = tuple((lambda x, n=n: x.tag == DC + n) for n in ("title", "creator", "subject"))


def _docx_told(row: dict, held: _Package) -> None:
    """What a row says with what it names in its package: heading and list of paragraphs, links, images, notes."""
    named, known, fmt, target, cls, note = held.told(row)
    kind, ref = row["row_type"], row.get("ref")
    row["note"] = note
    if kind == "paragraph":
        level = (row.get("ilvl") or 0) if row.get("num_id") not in (None, "0") else None
        row["align"] = SIDES.get(row.get("align"))
        row["heading"] = named if known else row.get("heading")
        row["list_level"], row["list_ordered"] = level, None if level is None else fmt is not None and fmt not in ("bullet", "none")
    elif kind == "text":
        row["url"] = target if cls == "hyperlink" else (ref if ref != "#" else None) if ref is not None and ref.startswith("#") else None
    elif kind == "image" and cls == "image":
        row["media_id"] = re.sub(r"^/?(word/)?", "", target, count=1)


def docx_documents(docs: DataFrame) -> DataFrame:
    """doc_id and DOCUMENT of packages (doc_id, bytes), a row each, whatever can be read of them."""

    def read(data):
        try:
            parts = package._parts(data, (*DOCX_PARTS, *DOCX_FOLDERS), DOCX_PARTS[:1])
        except Exception as e:  # one bad file never fails the job
            return _failed(f"{type(e).__name__}: {e}")
        errors, rows = _part_errors(parts, DOCX_CHECKED), []
        try:
            held = _Package(*map(parts.get, NAMING), *[[{"part": k, "bytes": v} for k, v in parts.items() if k.startswith(f)] for f in DOCX_FOLDERS[1:]])
            rows = _docx(ET.fromstring(parts["word/document.xml"]))
            for row in rows:
                _docx_told(row, held)
        except Exception as e:
            errors, rows = [*errors, f"{type(e).__name__}: {e}"], []
        warnings = sum(r["row_type"] == "unsupported" or r["row_type"] in (*NOTES, *MARGINS) and r["note"] is None for r in rows)
        media = _media(parts, lambda name: name[5:] if name.startswith("word/media/") else None)
        core = parts.get("docProps/core.xml")
        return _row(rows, True, media, _said(core, _CORE), core is not None, errors, warnings, parts)

    return mapped_rows(docs, ["bytes"], COLUMNS, read, size="size")


# ---- HWPX

_HEADING = re.compile(r"(?:heading|제목)\s*(\d)", re.ASCII)
_PACKAGE = (lambda x: _bare(x.tag) == "title", *((lambda x, n=n: _bare(x.tag) == "meta" and x.get("name") == n) for n in ("creator", "subject")))


class _Header:
    """What a header names: headings by style and by shape, marks of paragraph shapes, styles of character shapes."""

    def __init__(self, data: bytes | None):
        self.by_style, self.by_shape, self.marks, self.shapes, self.error = {}, {}, {}, {}, None
        if data is None:
            return
        self.error = _part_error("Contents/header.xml", data)
        if self.error is None:
            self.read(ET.fromstring(data))

    def read(self, root) -> None:
        every: dict = {}
        for x in root.iter():
            every.setdefault(_bare(x.tag), []).append(x)
        last: dict = {}  # of several styles of one shape the last counts
        for id_, name, kind, level, shape, _ in map(_hwpx_style, every.get("style", ())):
            said = _HEADING.match((name or "").lower())
            own, ord_ = int(said[1]) if said else level if kind == "HEADING" and level > 0 else None, _number(id_)
            if not own or ord_ is None:
                continue
            self.by_style[id_] = min(own, 6)
            if shape is not None and ord_ >= last.get(shape, ord_):
                last[shape], self.by_shape[shape] = ord_, min(own, 6)
        self.marks = {ref: told for ref, *told in _paragraph_marks(root)}
        faces: dict = {}
        for lang, id_, face in (f for e in every.get("fontface", ()) for f in _faces(e)):
            if face is not None and face != FIRST_FACE and lang in ("HANGUL", "LATIN"):
                faces[lang, id_] = min(face, faces.get((lang, id_), face))
        for id_, size, *flags, color, _, _, hangul, latin in map(_char_shape, every.get("charPr", ())):
            if id_ is not None and id_ not in self.shapes:
                font = faces.get(("LATIN", latin)) if latin is not None else None
                font = font if font is not None else faces.get(("HANGUL", hangul)) if hangul is not None else None
                self.shapes[id_] = dict(zip(FLAGS, flags, strict=True)) | {"color": None if color == "000000" else color, "size_pt": None if size == 10.0 else size, "font": font}


@functools.lru_cache(64)
def _header_small(data: bytes) -> _Header:
    """Programs put like headers into many packages."""
    return _Header(data)


def _hwpx_told(row: dict, header: _Header) -> None:
    kind, ref = row["row_type"], row.get("ref")
    if kind == "paragraph":
        list_kind, level, side = header.marks.get(ref, (None, None, None))
        heading = header.by_style.get(row.get("style_id"))
        row["align"] = side if side in SIDES.values() else None
        row["heading"] = heading if heading is not None else header.by_shape.get(ref)
        row["list_level"], row["list_ordered"] = level, None if list_kind is None else list_kind == "NUMBER"
        return
    row.update(header.shapes.get(ref, ()))
    if kind in NOTES or kind in MARGINS:
        row["note"] = row.get("text")
    elif kind == "image" and ref is not None:
        row["media_id"] = f"BIN{ref[:4].rjust(4, '0')}" if re.fullmatch(r"[0-9]+", ref) else re.sub(r"\.\w+$", "", ref, flags=re.ASCII)


def _without_holders(rows: list[dict]) -> list[dict]:
    """Rows of a section without the paragraphs of the body that hold tables and nothing else, which are no blocks."""
    at, holds, more = None, set(), set()
    for row in rows:
        kind = row["row_type"]
        if kind == "paragraph" and row.get("tbl") is None:
            at = id(row)
        elif kind == "table":
            holds.add(at)
        elif row.get("tbl") is None and kind not in ("section", *MARGINS):
            more.add(at)
    gone = holds - more
    return [r for r in rows if id(r) not in gone] if gone else rows


def hwpx_documents(docs: DataFrame) -> DataFrame:
    """doc_id and DOCUMENT of packages (doc_id, bytes), a row each, whatever can be read of them."""

    def read(data):
        try:
            parts = package._parts(data, ("Contents/", "BinData/"), ("Contents/section0.xml",))
        except Exception as e:  # one bad file never fails the job
            return _failed(f"{type(e).__name__}: {e}")
        head = parts.get("Contents/header.xml")
        header = _header_small(head) if head is not None and len(head) <= SMALL else _Header(head)
        errors, rows, warnings = [header.error] if header.error else [], [], 0
        named = ((int(re.search(r"section(\d+)", n)[1]), n) for n in parts if n.startswith("Contents/section") and re.search(r"section\d+\.xml$", n))
        for sec, name in sorted(named):
            try:
                own = _hwpx(ET.fromstring(parts[name]))
            except Exception as e:  # the other sections are read
                errors.append(f"{type(e).__name__}: {e}")
                continue
            warnings += sum(r["row_type"] == "unsupported" for r in own)
            own = [r for r in own if not (r["row_type"] == "text" and r.get("text") == "")]
            for row in own:
                row["sec"] = sec
                _hwpx_told(row, header)
            rows += _without_holders(own)
        media = _media(parts, lambda name: (m := re.search(r"BinData/([^/]+?)(?:\.\w+)?$", name, re.ASCII)) and m[1])
        about = parts.get("Contents/content.hpf")
        return _row(rows, False, media, _said(about, _PACKAGE), about is not None, errors, warnings, parts)

    return mapped_rows(docs, ["bytes"], COLUMNS, read, size="size")

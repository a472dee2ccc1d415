"""Binary record streams: decoding, text, fields, and what paragraph, table and part a record belongs to.

A header is 32 bits, little-endian: tag (10), level (10), size (12); a size of 4095 means that 32 more bits tell it.
"""

from __future__ import annotations

import struct
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doclake.functions.media import le

#: Tags of body records (fixed values); those of the document's head differ by dialect.
PARAGRAPH, TEXT, CHAR_SHAPE, CONTROL, CELL, TABLE = 66, 67, 68, 71, 72, 77
HEAD_TAGS = {"face": 17, "border_fill": 20, "char_shape": 21, "para_shape": 25}
BIG = 0xFFF


def _walk(data: bytes):
    """(tag, level, payload) of each record; stops where a record is cut off."""
    at = 0
    while at + 4 <= len(data):
        (head,) = struct.unpack_from("<I", data, at)
        at += 4
        size = head >> 20
        if size == BIG:
            if at + 4 > len(data):
                return
            (size,) = struct.unpack_from("<I", data, at)
            at += 4
        if at + size > len(data):
            return
        yield head & 0x3FF, head >> 10 & 0x3FF, data[at : at + size]
        at += size


def decode_records(streams: DataFrame) -> DataFrame:
    """doc_id, stream, rec, tag, level, payload of streams (doc_id, stream, compressed, bytes). What can't be inflated is
    read as it is."""
    kind = streams.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            out = []
            for doc, stream, packed, data in zip(pdf["doc_id"], pdf["stream"], pdf["compressed"], pdf["bytes"], strict=True):
                data = bytes(data or b"")
                if packed:
                    try:
                        data = zlib.decompress(data, -15)
                    except zlib.error:
                        pass
                out += [(doc, stream, i, tag, level, payload) for i, (tag, level, payload) in enumerate(_walk(data))]
            yield pd.DataFrame(out, columns=["doc_id", "stream", "rec", "tag", "level", "payload"])

    return streams.select("doc_id", "stream", "compressed", "bytes").mapInPandas(run, f"doc_id {kind}, stream string, rec long, tag int, level int, payload binary")


def encode_record(tag: Column, level: Column, payload: Column) -> Column:
    """The bytes of one record."""
    size = F.octet_length(payload).cast("long")
    four = lambda x: F.unhex(F.concat(*[F.lpad(F.hex(F.shiftright(x, s).bitwiseAND(F.lit(255))), 2, "0") for s in (0, 8, 16, 24)]))
    head = tag.cast("long") + F.shiftleft(level.cast("long"), 10) + F.shiftleft(F.least(size, F.lit(BIG)), 20)
    return F.concat(four(head), F.when(size >= BIG, F.concat(four(size), payload)).otherwise(payload))


def _texts(payloads: pd.Series) -> pd.Series:
    def one(data: bytes) -> str:
        units = memoryview(bytes(data[: len(data) // 2 * 2])).cast("H") if data else []
        out, i = bytearray(), 0
        while i < len(units):
            u = units[i]
            if u in (10, 13):
                out += b"\n\0"
            elif u > 31:
                out += struct.pack("<H", u)
            i += 1 if u > 31 or u in (0, 10, 13) or u >= 24 else 8  # other controls are eight units long
        return out.decode("utf-16-le", "replace").strip()

    return payloads.map(one)


def decode_text(payload: Column) -> Column:
    """The text of a text record: units, not characters, since a control's payload may hold any unit."""
    return F.pandas_udf(_texts, "string")(payload)


def field(name: str, at: int, width: int, default: int = 0) -> Column:
    """A little-endian field of `payload`; records that are too short have the default."""
    return F.coalesce(le(F.col("payload"), at, width), F.lit(default)).alias(name)


def char_shapes(records: DataFrame, tags: dict[str, int] = HEAD_TAGS) -> DataFrame:
    """doc_id, id, size_pt, bold, italic, color of the character shapes, whose ids count them."""
    own = records.where(F.col("tag") == tags["char_shape"])
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("rec")) - 1
    bit = lambda b: F.coalesce(le(F.col("payload"), 46, 4), F.lit(0)).bitwiseAND(F.lit(b)) != 0
    return own.select("doc_id", nth.alias("id"), (F.coalesce(le(F.col("payload"), 42, 4), F.lit(1000)) / 100).alias("size_pt"), bit(2).alias("bold"), bit(1).alias("italic"), field("color", 52, 4))


def _signed(at: int) -> Column:
    """A signed 32-bit field."""
    value = F.coalesce(le(F.col("payload"), at, 4), F.lit(0))
    return F.when(value >= 1 << 31, value - (1 << 32)).otherwise(value)


def _numbered(records: DataFrame, tag: int) -> DataFrame:
    """Records of one tag of the head, with id: they are referred to by their number."""
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("rec")) - 1
    return records.where(F.col("tag") == tag).withColumn("id", nth)


#: Signed lengths of a paragraph shape, by offset, and the alignments that bits 2 to 4 of its first field tell (fixed values).
PARA_LENGTHS = {"left": 4, "right": 8, "indent": 12, "before": 16, "after": 20}
ALIGNMENTS = ("justify", "left", "right", "center", "distribute", "divide")


def para_shapes(records: DataFrame, tags: dict[str, int] = HEAD_TAGS) -> DataFrame:
    """doc_id, id, align, lengths, line (its newer field first), fill of the paragraph shapes."""
    own, first = _numbered(records, tags["para_shape"]), F.coalesce(le(F.col("payload"), 0, 4), F.lit(0))
    align = F.get(F.array(*map(F.lit, ALIGNMENTS)), F.shiftright(first, 2).bitwiseAND(F.lit(7)).cast("int"))
    line = F.coalesce(F.nullif(F.coalesce(le(F.col("payload"), 50, 4), F.lit(0)), F.lit(0)), _signed(24))
    return own.select("doc_id", "id", align.alias("align"), *[_signed(at).alias(k) for k, at in PARA_LENGTHS.items()], line.alias("line"), field("fill", 32, 2))


def colour(value: Column) -> Column:
    """rrggbb of a colour whose lowest byte is red."""
    byte = lambda s: F.lpad(F.hex(F.shiftright(value, s).bitwiseAND(F.lit(255))), 2, "0")
    return F.concat(byte(0), byte(8), byte(16))


#: Where the sides of a border fill begin: kind (2 bytes), width (2), colour (4).
SIDES_AT = {"left": 2, "right": 10, "top": 18, "bottom": 26}
FILL_KIND, FILL_COLOUR, NO_COLOUR = 42, 46, 0xFFFFFFFF


def border_fills(records: DataFrame, tags: dict[str, int] = HEAD_TAGS) -> DataFrame:
    """doc_id, id, each side as `kind width colour`, face (null: none) of the border fills."""
    own, get = _numbered(records, tags["border_fill"]), lambda at, n: F.coalesce(le(F.col("payload"), at, n), F.lit(0))
    side = lambda at: F.concat_ws(" ", get(at, 2).cast("string"), get(at + 2, 2).cast("string"), colour(get(at + 4, 4)))
    filled = (get(FILL_KIND, 4).bitwiseAND(F.lit(1)) != 0) & (F.octet_length("payload") >= 50) & (get(FILL_COLOUR, 4) != NO_COLOUR)
    return own.select("doc_id", "id", *[side(at).alias(k) for k, at in SIDES_AT.items()], F.when(filled, colour(get(FILL_COLOUR, 4))).alias("face"))


#: A page's lengths, 4 bytes each from offset 0.
PAGE_FIELDS, PAGE = ("w", "h", "left", "right", "top", "bottom", "header", "footer"), 73


def page_defs(records: DataFrame) -> DataFrame:
    """doc_id, stream, rec and the page's lengths in HWPUNIT; records that are too short have none."""
    own = records.where((F.col("tag") == PAGE) & (F.octet_length("payload") >= 32))
    return own.select("doc_id", "stream", "rec", *[field(k, 4 * i, 4) for i, k in enumerate(PAGE_FIELDS)])


#: A cell's fields: offset, width, and the value of records that are too short.
CELL_FIELDS = {"col": (8, 2, 0), "row": (10, 2, 0), "col_span": (12, 2, 1), "row_span": (14, 2, 1), "width": (16, 4, 0), "height": (20, 4, 0), "fill": (32, 2, 0)}


def cell_attributes(records: DataFrame) -> DataFrame:
    """doc_id, stream, rec and the place, spans, size and fill of cells."""
    return records.where(F.col("tag") == CELL).select("doc_id", "stream", "rec", *[field(k, at, n, d) for k, (at, n, d) in CELL_FIELDS.items()])


def _cut(payloads: pd.Series, points: pd.Series) -> pd.Series:
    """Texts cut where the shape changes; places count the units of the payload, controls too."""

    def one(data, changes):
        units = memoryview(bytes(data[: len(data) // 2 * 2])).cast("H") if data else []
        changes = memoryview(bytes(changes[: len(changes) // 8 * 8])).cast("I").tolist() if changes else [0, 0]
        starts, shapes = changes[::2], changes[1::2]
        out, i, k = [[shapes[0], bytearray()]], 0, 0
        while i < len(units):
            while k + 1 < len(starts) and starts[k + 1] <= i:
                k += 1
                out.append([shapes[k], bytearray()])
            u = units[i]
            out[-1][1] += b"\n\0" if u in (10, 13) else struct.pack("<H", u) if u > 31 else b""
            i += 1 if u > 31 or u in (0, 10, 13) or u >= 24 else 8
        texts = [(shape, text.decode("utf-16-le", "replace")) for shape, text in out]
        return [{"shape": shape, "text": text} for shape, text in texts if text]

    return pd.Series([one(d, c) for d, c in zip(payloads, points, strict=True)])


def shape_runs(payload: Column, points: Column) -> Column:
    """array<struct<shape, text>> of a text record and its shape changes (places and shapes, 4 bytes each)."""
    return F.pandas_udf(_cut, "array<struct<shape:long,text:string>>")(payload, points)


def para_of_record(records: DataFrame) -> DataFrame:
    """Records with para, the number of the last paragraph header up to them; null before the first."""
    w = Window.partitionBy("doc_id", "stream").orderBy("rec")
    return records.withColumn("para", F.last(F.when(F.col("tag") == PARAGRAPH, F.col("rec")), True).over(w))


def _span_of(records: DataFrame, opens: Column, level: Column, name: str, *told: str) -> DataFrame:
    """Records with `name`: the record that opens their span, and `told`, columns of that record. A span ends before the
    first later record of a level below its own (level), or where another opens. All windows have one order."""
    w = Window.partitionBy("doc_id", "stream").orderBy("rec")
    out = records.withColumn("span_", F.last(F.when(opens, F.struct("rec", level.alias("level_"), *told)), True).over(w))
    out = out.withColumn("end_", F.max(F.when((F.col("rec") > F.col("span_.rec")) & (level < F.col("span_.level_")), F.col("span_.rec"))).over(w))
    inside = F.col("span_.rec").isNotNull() & (F.col("end_").isNull() | (F.col("end_") < F.col("span_.rec")))
    return out.withColumn(name, F.when(inside, F.struct(F.col("span_.rec"), *[F.col(f"span_.{c}") for c in told]))).drop("span_", "end_")


def table_of_record(records: DataFrame) -> DataFrame:
    """Records with tbl and cell, the openers of their table and their cell within it."""
    w = Window.partitionBy("doc_id", "stream").orderBy("rec")
    out = _span_of(records, F.col("tag") == TABLE, F.col("level"), "tbl").withColumn("tbl", F.col("tbl.rec"))
    cell = F.last(F.when((F.col("tag") == CELL) & F.col("tbl").isNotNull(), F.struct("rec", "tbl")), True).over(w)
    return out.withColumn("cell", F.when(cell["tbl"] == F.col("tbl"), cell["rec"]))


def route_header_footer(records: DataFrame) -> DataFrame:
    """Records (with ctrl, a control's four letters) with place: body, header or footer."""
    opens = (F.col("tag") == CONTROL) & F.col("ctrl").isin("head", "foot")
    level = F.col("level") + F.when(opens, 1).otherwise(0)
    out = _span_of(records, opens, level, "part_", "ctrl")
    place = F.when(F.col("part_").isNull(), "body").when(F.col("part_.ctrl") == "head", "header").otherwise("footer")
    return out.withColumn("place", place).drop("part_")

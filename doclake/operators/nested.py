"""Flat tables to documents as one row each (content.DOCUMENT), for readers that give flat tables, and back to flat tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doclake.functions.media import jpeg_size, png_height, png_width
from doclake.operators.content import BLOCK, CELL_AT, DOCUMENT, ELEMENT_AT, NUMBERED, RUN, RUN_AT, complete, with_content
from doclake.operators.registry import assign_rel_ids
from doclake.sources.scratch import stored

CELL = ["doc_id", "blk", "row", "col"]


def _sized(media: DataFrame) -> DataFrame:
    """doc_id, media_id, mime, bytes, w, h of each image once, and med, its place among those of its document."""
    png = F.col("mime") == "image/png"
    sized = media.withColumns({"j": jpeg_size(F.col("bytes")), "pw": png_width(F.col("bytes")), "ph": png_height(F.col("bytes"))})
    held = sized.select("doc_id", "media_id", "mime", "bytes", *[F.when(png, F.col(f"p{k}")).otherwise(F.col(f"j.{k}")).cast("long").alias(k) for k in ("w", "h")]).dropDuplicates(["doc_id", "media_id"])
    return stored(held.withColumn("med", F.row_number().over(Window.partitionBy("doc_id").orderBy("media_id")) - 1))


def _references(runs: DataFrame, cells: DataFrame, media: DataFrame | None) -> DataFrame:
    """CELL, at and NUMBERED of what runs of the body (row and col -1, at their pos) and of cells (at their place in the content)
    refer to, numbered in order.

    An image without bytes is left out; a note that isn't there has no number.
    """
    fields = ["url", "media_id", "note_kind", "note"]
    needs = lambda c: c("url").isNotNull() | c("media_id").isNotNull() | c("note_kind").isNotNull()
    own = runs.where(needs(F.col)).select("doc_id", "blk", F.lit(-1).alias("row"), F.lit(-1).alias("col"), F.col("pos").cast("long").alias("at"), F.col("blk").cast("long").alias("begin"), *fields)
    held = cells.where(F.exists("content", lambda x: needs(lambda n: x[n]))).select(*CELL, F.posexplode("content").alias("at", "x"))
    held = held.where(needs(lambda n: F.col(f"x.{n}"))).select(*CELL, F.col("at").cast("long").alias("at"), F.coalesce("x.ord", F.col("blk").cast("long")).alias("begin"), *[f"x.{f}" for f in fields])
    every = own.unionByName(held).withColumn("ord", F.struct("begin", "row", "col", "at")).drop("begin")
    kind = F.when(F.col("note_kind").isNotNull(), "note").when(F.col("media_id").isNotNull(), "image").otherwise("link")
    every = every.withColumn("kind", kind)
    found = complete(every.where("kind = 'link'"), {"med": "int"})
    if media is not None:
        found = found.unionByName(every.where("kind = 'image'").join(media.select("doc_id", "media_id", "med"), ["doc_id", "media_id"]).select(*found.columns))
    found = assign_rel_ids(found).withColumn("rel", F.substring("rel_id", 4, 20).cast("int")).withColumn("no", F.col("image_no").cast("int"))
    notes = every.where("kind = 'note' AND note IS NOT NULL")
    notes = notes.withColumn("no", F.row_number().over(Window.partitionBy("doc_id", "note_kind").orderBy("ord")))
    columns = [*CELL, "at", *NUMBERED]
    return stored(complete(found, NUMBERED).select(*columns).unionByName(complete(notes, NUMBERED).select(*columns)))


def _typed(given: dict[str, Column], fields: dict[str, str]) -> Column:
    return F.struct(*[given.get(k, F.lit(None)).cast(t).alias(k) for k, t in fields.items()])


def _with_inner_places(docs: DataFrame) -> DataFrame:
    """Documents whose tables within cells tell their place among those of their level."""
    at = lambda level: F.transform(F.filter("blocks", lambda t: (t["kind"] == "table") & (t["level"] == level)), lambda t: t["blk"])
    placed = lambda level: lambda x: F.when(x["kind"] == "table", x.withField("no", (F.array_position(at(level), x["inner"]) - 1).cast("int"))).otherwise(x)
    cells = lambda b: F.transform(b["cells"], lambda c: c.withField("content", F.transform(c["content"], placed(b["level"] + 1))))
    return docs.withColumn("blocks", F.transform("blocks", lambda b: b.withField("cells", cells(b))))


def nest(ir) -> DataFrame:
    """The flat tables of a convert.Ir as documents, written. The rows of a document are dealt to it once for each table."""
    runs, cells = complete(ir.runs, RUN), with_content(ir.cells)
    media = _sized(ir.media) if ir.media is not None else None
    refs = _references(runs, cells, media)
    told = F.struct(*NUMBERED)
    runs = runs.join(refs.where("row = -1").select("doc_id", "blk", F.col("at").alias("pos"), *NUMBERED), ["doc_id", "blk", "pos"], "left")
    runs = runs.groupBy("doc_id", "blk").agg(F.sort_array(F.collect_list(_typed({k: F.col(k) for k in RUN_AT}, RUN_AT))).alias("runs"))
    by_place = refs.where("row >= 0").groupBy(*CELL).agg(F.map_from_entries(F.collect_list(F.struct(F.col("at").cast("int"), told))).alias("refs"))
    has = F.exists("content", lambda x: x["url"].isNotNull() | x["media_id"].isNotNull() | x["note_kind"].isNotNull())
    kind = by_place.schema["refs"].dataType
    cells = cells.where(~has).withColumn("refs", F.lit(None).cast(kind)).unionByName(cells.where(has).join(by_place, CELL, "left"))
    known = cells.schema["content"].dataType.elementType.fieldNames()
    one = lambda x, i: _typed({k: x[k] for k in known if k not in NUMBERED} | {k: F.try_element_at(F.col("refs"), i)[k] for k in NUMBERED}, ELEMENT_AT)
    cells = cells.withColumn("content", F.transform("content", one)).groupBy("doc_id", "blk").agg(F.sort_array(F.collect_list(_typed({k: F.col(k) for k in CELL_AT}, CELL_AT))).alias("cells"))
    blocks = complete(ir.blocks, BLOCK | {"align": "string"}).drop("runs", "cells")
    held = blocks.join(runs, ["doc_id", "blk"], "left").join(cells, ["doc_id", "blk"], "left")
    held = held.withColumns({"runs": F.coalesce("runs", F.array().cast(BLOCK["runs"])), "cells": F.coalesce("cells", F.array().cast(BLOCK["cells"]))})
    docs = held.groupBy("doc_id").agg(F.sort_array(F.collect_list(_typed({k: F.col(k) for k in BLOCK}, BLOCK))).alias("blocks"))
    docs = docs.join(ir.meta.select("doc_id", "title", "author", "subject", F.lit(True).alias("told")), "doc_id", "full")
    if ir.errors is not None:
        docs = docs.join(ir.errors.select("doc_id", "error", "warnings"), "doc_id", "full")
    for table, name, fields in ((ir.sections, "sections", ("begin", "page")), (ir.margins, "margins", ("sec", "kind", "text"))):
        if table is not None:
            docs = docs.join(table.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name)), "doc_id", "left")
    if media is not None:
        docs = docs.join(media.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("media_id", "mime", "bytes", "w", "h"))).alias("media")), "doc_id", "left")
    docs = complete(docs, DOCUMENT).select("doc_id", *[F.col(k).cast(t).alias(k) for k, t in DOCUMENT.items()])
    none = {k: F.coalesce(k, F.array().cast(t)) for k, t in DOCUMENT.items() if t.startswith("array")}
    docs = docs.withColumns(none | {"told": F.coalesce("told", F.lit(False)), "warnings": F.coalesce("warnings", F.lit(0)), "deepest": F.lit(ir.deepest), "size": F.lit(0).cast("long")})
    return stored(_with_inner_places(docs) if ir.deepest else docs)


# ---- and back


def flat(docs: DataFrame) -> dict[str, DataFrame]:
    """The tables of convert.Ir of written documents; each is read by itself."""
    # an outer explode: an inner one would have the optimiser look at each array once more
    rows = lambda df, name, *more: df.select("doc_id", *more, F.explode_outer(name).alias("x")).where("x IS NOT NULL")
    of = lambda names: [f"x.{n}" for n in names]
    inside = lambda name: rows(rows(docs, "blocks").select("doc_id", "x.blk", F.col(f"x.{name}").alias("held")), "held", "blk")
    return {
        "blocks": rows(docs, "blocks").select("doc_id", *of(k for k in BLOCK if k not in ("runs", "cells"))),
        "runs": inside("runs").select("doc_id", "blk", *of(("pos", *RUN))),
        "cells": inside("cells").select("doc_id", "blk", *of(CELL_AT)),
        "meta": docs.where("told").select("doc_id", "title", "author", "subject"),
        "errors": docs.where("error IS NOT NULL OR warnings > 0").select("doc_id", "error", "warnings"),
        "media": rows(docs, "media").select("doc_id", *of(("media_id", "mime", "bytes"))),
        "sections": rows(docs, "sections").select("doc_id", "x.begin", "x.page"),
        "margins": rows(docs, "margins").select("doc_id", "x.sec", "x.kind", "x.text"),
    }

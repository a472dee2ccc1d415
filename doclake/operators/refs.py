"""References by id: relationships, media, notes, header and footer, text positions; and references without a target."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def resolve_links(links: DataFrame, rels: DataFrame) -> DataFrame:
    """doc_id, ord, url of links (doc_id, ord, rel_id, anchor, n_runs): the target, else the anchor; without either, or
    without runs, there is no link."""
    out = links.join(rels.where("cls = 'hyperlink'").select("doc_id", "rel_id", "target"), ["doc_id", "rel_id"], "left")
    return out.where("n_runs > 0").select("doc_id", "ord", F.coalesce("target", F.concat(F.lit("#"), "anchor")).alias("url")).where("url IS NOT NULL")


def resolve_images(refs: DataFrame, rels: DataFrame, parts: DataFrame) -> DataFrame:
    """refs (doc_id, ord, rel_id) to bytes: relationship of class image, then the part word/<target>. The bytes join last."""
    told = refs.join(rels.where("cls = 'image'").select("doc_id", "rel_id", "target"), ["doc_id", "rel_id"])
    return told.select("doc_id", "ord", F.concat(F.lit("word/"), "target").alias("part")).join(parts.select("doc_id", "part", "bytes"), ["doc_id", "part"])


def resolve_bindata(refs: DataFrame, files: DataFrame) -> DataFrame:
    """refs (doc_id, ord, bin_id, name): the file of that name, else BIN<id with 4 digits>.png."""
    keyed = refs.withColumns({"k1": F.col("name"), "k2": F.concat(F.lit("BIN"), F.lpad(F.col("bin_id").cast("string"), 4, "0"), F.lit(".png"))})
    one = files.select("doc_id", F.col("file").alias("k1"), F.col("size").alias("s1"))
    two = files.select("doc_id", F.col("file").alias("k2"), F.col("size").alias("s2"))
    out = keyed.join(one, ["doc_id", "k1"], "left").join(two, ["doc_id", "k2"], "left")
    return out.select("doc_id", "ord", F.coalesce(F.when(F.col("s1").isNotNull(), F.col("k1")), F.when(F.col("s2").isNotNull(), F.col("k2"))).alias("file"), F.coalesce("s1", "s2").alias("size"))


def attach_notes(refs: DataFrame, notes: DataFrame) -> DataFrame:
    """doc_id, kind, ord, number, text: note bodies numbered by kind in the order of references; unknown ids take none."""
    out = refs.join(notes, ["doc_id", "kind", "note_id"])
    return out.select("doc_id", "kind", "ord", F.row_number().over(Window.partitionBy("doc_id", "kind").orderBy("ord")).alias("number"), "text")


def dangling(checks: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """kind, doc_id, id of references without a target. checks: kind to (refs, targets), both of doc_id, id."""
    found = [refs.join(targets, ["doc_id", "id"], "left_anti").select(F.lit(kind).alias("kind"), "doc_id", "id") for kind, (refs, targets) in checks.items()]
    return reduce(DataFrame.unionByName, found)


def char_shape_segments(texts: DataFrame, points: DataFrame) -> DataFrame:
    """doc_id, blk, start, shape_id, text: a text cut at its shape changes. points: doc_id, blk, pos, shape_id."""
    after = F.lead("pos").over(Window.partitionBy("doc_id", "blk").orderBy("pos"))
    out = points.withColumn("stop", after).join(texts, ["doc_id", "blk"])
    piece = F.expr("substring(text, pos + 1, coalesce(stop, char_length(text)) - pos)")
    return out.select("doc_id", "blk", F.col("pos").alias("start"), "shape_id", piece.alias("text")).where("text <> ''")


def vertical_positions(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, ord, before, height, after) with y, the top, and baseline at 0.85 of the height."""
    w = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.coalesce(F.sum(F.col("before") + F.col("height") + F.col("after")).over(w), F.lit(0))
    out = rows.withColumn("y", earlier + F.col("before"))
    return out.withColumn("baseline", F.floor(F.col("height") * 0.85 + 0.5).cast("long"))


def first_section(sections: DataFrame) -> DataFrame:
    """The first section of each document."""
    return sections.withColumn("nth_", F.row_number().over(Window.partitionBy("doc_id").orderBy("sec"))).where("nth_ = 1").drop("nth_")


def ordered_sections(parts: DataFrame) -> DataFrame:
    """doc_id, part, sec: section parts in the order of their numbers, not of their text."""
    number = F.regexp_extract("part", r"section(\d+)", 1).try_cast("int")
    rows = parts.withColumn("number", number).where("number IS NOT NULL")
    return rows.select("doc_id", "part", (F.row_number().over(Window.partitionBy("doc_id").orderBy("number")) - 1).alias("sec"))


def page_setup(sections: DataFrame) -> DataFrame:
    """doc_id, sec, w, h, margin in points from twips; 0 and missing mean the default; landscape if wider than high."""
    pt = lambda c, d: F.coalesce(F.nullif(F.col(c), F.lit(0)) / 20, F.lit(d))
    out = sections.select("doc_id", "sec", pt("w", 595.28).alias("w"), pt("h", 841.89).alias("h"), pt("margin", 70.87).alias("margin"))
    return out.withColumn("orientation", F.when(F.col("w") > F.col("h"), "landscape").otherwise("portrait"))


def page_breaks(segments: DataFrame) -> DataFrame:
    """doc_id, blk, kind, at. segments: doc_id, blk, ord, text_offset, flags. Bit 16 of the first segment is a break before
    the paragraph; later ones break page (16) or column (32) at their offset."""
    nth = F.row_number().over(Window.partitionBy("doc_id", "blk").orderBy("ord"))
    bit = lambda b: F.col("flags").bitwiseAND(F.lit(b)) != 0
    kind = F.when((F.col("nth") == 1) & bit(16), "before").when((F.col("nth") > 1) & bit(16), "page").when((F.col("nth") > 1) & bit(32), "column")
    return segments.withColumn("nth", nth).withColumn("kind", kind).where("kind IS NOT NULL").select("doc_id", "blk", "kind", F.when(F.col("nth") > 1, F.col("text_offset")).otherwise(0).alias("at"))

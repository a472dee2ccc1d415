"""Registries: ids by first appearance, without a scan of all earlier entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The face that every font table begins with, and each attribute's script lanes (fixed values).
FIRST_FACE = "함초롬바탕"
LANES = {"east_asia": ("HANGUL", "HANJA", "JAPANESE", "OTHER"), "latin": ("LATIN", "SYMBOL", "USER")}


def _first_seen(rows: DataFrame, scope: list[str], key: list[str], order: str) -> DataFrame:
    """scope, key, first: where each key of a scope appears first. A partial minimum, so a plain key is no hot spot."""
    return rows.groupBy(*scope, *key).agg(F.min(order).alias("first"))


def dedup_shapes(rows: DataFrame, key: list[str], order: str, offset: int) -> DataFrame:
    """Rows with shape_id: equal keys of a document share it; ids follow first appearance, from `offset`. Nulls in a key
    are values of their own."""
    seen = _first_seen(rows, ["doc_id"], key, order)
    ids = seen.withColumn("shape_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("first")) - 1 + offset).drop("first")
    own = ids.select(F.col("doc_id").alias("k_doc"), *[F.col(k).alias(f"k_{k}") for k in key], "shape_id")
    same = F.col("doc_id") == F.col("k_doc")
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"k_{k}"))
    return rows.join(own, same).drop("k_doc", *[f"k_{k}" for k in key])


def every_shape(rows: DataFrame, order: str) -> DataFrame:
    """Rows with shape_id from 0 in order, none shared."""
    return rows.withColumn("shape_id", F.row_number().over(Window.partitionBy("doc_id").orderBy(order)) - 1)


def font_registry(runs: DataFrame) -> DataFrame:
    """doc_id, lane, face, font_id. runs: doc_id, pos, east_asia, latin; an attribute feeds its lanes, id 0 is FIRST_FACE."""
    lanes = [F.struct(F.lit(lane).alias("lane"), F.col(a).alias("face")) for a, names in LANES.items() for lane in names]
    rows = runs.select("doc_id", "pos", F.explode(F.array(*lanes)).alias("l")).select("doc_id", "pos", "l.lane", "l.face").where(F.col("face") != FIRST_FACE)
    seen = _first_seen(rows, ["doc_id", "lane"], ["face"], "pos")
    return seen.select("doc_id", "lane", "face", F.row_number().over(Window.partitionBy("doc_id", "lane").orderBy("first")).alias("font_id"))


def document_fonts(runs: DataFrame) -> DataFrame:
    """doc_id, nth, face, charset (81 if Korean, else 00) of the distinct faces that aren't blank, in order."""
    seen = _first_seen(runs.where("trim(face) <> ''"), ["doc_id"], ["face"], "pos")
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("first"))
    return seen.select("doc_id", nth.alias("nth"), "face", F.when(F.col("face").rlike("[가-힣]"), "81").otherwise("00").alias("charset"))


def default_fonts(fonts: DataFrame) -> DataFrame:
    """doc_id, east_asia, latin: the first Korean face, else Malgun Gothic; the first other one that begins with a Latin
    letter, else the same."""
    korean = F.col("face").rlike("[가-힣]")
    latin = ~korean & F.col("face").rlike("^[A-Za-z]")
    out = fonts.groupBy("doc_id").agg(
        F.coalesce(F.min_by("face", F.when(korean, F.col("nth"))), F.lit("Malgun Gothic")).alias("east_asia"), F.min_by("face", F.when(latin, F.col("nth"))).alias("latin")
    )
    return out.select("doc_id", "east_asia", F.coalesce("latin", "east_asia").alias("latin"))


def assign_rel_ids(refs: DataFrame, first: int = 1) -> DataFrame:
    """Refs (doc_id, ord, kind image or link) with rel_id, one counter for both, and image_no."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    image = F.sum((F.col("kind") == "image").cast("int")).over(w)
    return refs.withColumn("rel_id", F.concat(F.lit("rId"), (F.row_number().over(w) + first - 1).cast("string"))).withColumn("image_no", F.when(F.col("kind") == "image", image))


def used_extensions(media: DataFrame) -> DataFrame:
    ext = F.lower("ext")
    return media.select(ext.alias("ext")).distinct().select("ext", F.when(F.col("ext").isin("jpg", "jpeg"), "image/jpeg").otherwise(F.concat(F.lit("image/"), "ext")).alias("content_type"))


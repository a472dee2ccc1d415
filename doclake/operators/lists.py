"""List numbering: counters that shallower items reset, and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = 9
#: Symbols of bullets by level, and of two private texts (fixed values).
BULLETS = ("●", "○", "■", "◆", "▪", "▸", "‣", "⁃", "⦿")
BULLET_TEXTS = {"o": "○", "§": "■"}
#: First letters of the two Korean numberings.
GANADA, CHOSUNG = 0xAC00, 0x3131


def roman(n: Column) -> Column:
    """Lower-case Roman numeral: the repeated thousands, then each digit of the rest by lookup."""
    digit = lambda d, one, five, ten: F.element_at(F.array(*[F.lit(s) for s in ("", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten)]), (d + 1).cast("int"))
    place = lambda p: F.floor(n / p) % 10
    return F.concat(F.repeat(F.lit("m"), F.floor(n / 1000).cast("int")), digit(place(100), "c", "d", "m"), digit(place(10), "x", "l", "c"), digit(place(1), "i", "v", "x"))


def numeral(n: Column, fmt: Column) -> Column:
    letter = F.char(F.least(n, F.lit(26)) + 96)
    korean = lambda first: F.decode(F.unhex(F.lpad(F.hex(n + first - 1), 4, "0")), "UTF-16BE")
    return (
        F.when(fmt == "lowerLetter", letter).when(fmt == "upperLetter", F.upper(letter)).when(fmt == "lowerRoman", roman(n)).when(fmt == "upperRoman", F.upper(roman(n)))
        .when(fmt == "ganada", korean(GANADA)).when(fmt == "chosung", korean(CHOSUNG)).otherwise(n.cast("string"))
    )


def list_counters(items: DataFrame) -> DataFrame:
    """Items with counter (null for bullets) and n0..n8: how many items each level has had since it was last reset.

    items: doc_id, blk, num_id, ilvl, fmt, start. A non-bullet item resets all deeper levels of its list; bullets
    neither count nor reset. All is told by running sums and maxima in the order of the list, which is sorted once.
    """
    w = Window.partitionBy("doc_id", "num_id").orderBy("blk")
    counts = F.col("fmt") != "bullet"
    so_far = {f"n{k}": F.sum(F.when(F.col("ilvl") == k, 1).otherwise(0)).over(w) for k in range(LEVELS)}
    at_reset = {f"n{k}": F.col(f"n{k}") - F.coalesce(F.max(F.when(counts & (F.col("ilvl") < k), F.col(f"n{k}"))).over(w), F.lit(0)) for k in range(LEVELS)}
    out = items.withColumns(so_far).withColumns(at_reset)
    n = F.element_at(F.array(*[f"n{k}" for k in range(LEVELS)]), (F.col("ilvl") + 1).cast("int")).cast("int")
    return out.withColumn("counter", F.when(counts, n + F.coalesce("start", F.lit(1)) - 1))


def list_labels(items: DataFrame, levels: DataFrame) -> DataFrame:
    """doc_id, blk, num_id, ilvl, label. levels: num_id, ilvl, fmt, text, start (one row each; of a checked, small size
    or joined by shuffle: left to the optimiser). Items without a level have label ''."""
    own = items.select("doc_id", "blk", "num_id", "ilvl").join(levels.select("num_id", "ilvl", "fmt", "start"), ["num_id", "ilvl"], "left")
    lists = levels.groupBy("num_id").agg(F.map_from_entries(F.collect_list(F.struct("ilvl", F.struct("fmt", "text", "start")))).alias("levels"))
    rows = list_counters(own).drop("start", "counter").join(lists, "num_id", "left")
    rows = rows.withColumn("text", F.col("levels")[F.col("ilvl")]["text"])
    # a level that has no item since it was reset, or whose items are bullets, shows 1
    level = lambda k: F.col("levels")[F.lit(k).cast(levels.schema["ilvl"].dataType)]
    for k in range(LEVELS):
        seen = (F.col(f"n{k}") > 0) & (level(k)["fmt"] != "bullet")
        rows = rows.withColumn(f"v{k}", F.when(seen, F.coalesce(level(k)["start"], F.lit(1)) + F.col(f"n{k}").cast("int") - 1))
    values = F.array(*[F.struct(F.lit(k).cast(levels.schema["ilvl"].dataType).alias("k"), F.coalesce(f"v{k}", F.lit(1)).alias("v")) for k in range(LEVELS)])
    fill = lambda t, x: F.replace(t, F.concat(F.lit("%"), (x["k"] + 1).cast("string")), numeral(x["v"], F.col("levels")[x["k"]]["fmt"]))
    filled = F.aggregate(F.slice(values, 1, (F.col("ilvl") + 1).cast("int")), F.col("text"), fill)
    symbol = F.element_at(F.array(*[F.lit(b) for b in BULLETS]), F.least(F.col("ilvl") + 1, F.lit(len(BULLETS))).cast("int"))
    for given, shown in BULLET_TEXTS.items():
        symbol = F.when(F.col("text") == given, shown).otherwise(symbol)
    label = F.when(F.col("fmt") == "bullet", F.concat(symbol, F.lit(" "))).when(F.col("fmt").isNotNull(), F.concat(filled, F.lit(" "))).otherwise("")
    return rows.select("doc_id", "blk", "num_id", "ilvl", label.alias("label"))


def list_levels(paragraphs: DataFrame, nums: DataFrame, num_levels: DataFrame) -> DataFrame:
    """Indents of list paragraphs: num -> abstract -> level; without one 4000 a level and -2000; num_id '0' is no list."""
    listed = paragraphs.where("num_id <> '0'").join(nums, ["doc_id", "num_id"], "left").join(num_levels, ["doc_id", "abstract_id", "ilvl"], "left")
    return listed.select("doc_id", "blk", F.coalesce("left", (F.col("ilvl") + 1) * 800 * 5).alias("left"), F.coalesce(-F.col("hanging"), F.lit(-400 * 5)).alias("first"))

"""Mixing sources to target weights by hash-threshold histograms.

Every document has a fixed place in [0, 2^60) by a hash of its id and text. A source takes each of its documents `full`
times and once more where the place is below the source's threshold. Thresholds come from histograms of words by
source and hash bucket: the running sum over at most 4096 buckets shows in which bucket the budget ends, and only
that bucket is split again by the next 12 bits. Nothing is sorted but those bucket sums, and a document is kept
or dropped by its own row and its source's threshold.

Defined results: a null text has size 0; a null source is a source of its own, the last one; rows of one doc_id
and text share their place and are taken alike; a source without words has target 0; an empty table gives
no rows; mix() leaves all columns of the input as they are, whatever their names, and mix_report() ignores those it
doesn't need; very long texts only have larger sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doclake.llm.common import columns, scratch, slices, stored, unused

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
LEVEL_BITS, LEVELS = 12, 5
PLACE_BITS = LEVEL_BITS * LEVELS
#: One row for each source comes to the driver, for the weights' order and the resharing; more raise an error.
MAX_SOURCES = 1_000_000


def place() -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit("mix"), F.col("doc_id").cast("string"), F.col("text")), 64 - PLACE_BITS)


def _word_counts(batches):
    import pyarrow as pa

    for batch in batches:
        for part, texts in slices(batch):
            sizes = pa.array([len(t.encode("utf-8", "surrogatepass").split()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("doc_id", "source", "place")], sizes], ["doc_id", "source", "place", "size"])


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, place, size: the number of words; whole texts, one pass, no shuffle."""
    kinds = dict(docs.dtypes)
    held = docs.select("doc_id", "source", place().alias("place"), "text")
    return held.mapInArrow(_word_counts, f"doc_id {kinds['doc_id']}, source {kinds['source']}, place long, size long")


def targets(totals: dict[str | None, int], weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> dict[str | None, float]:
    """Words wanted of each source: shares by weight, stopped at `most` times the source, the excess shared again."""
    names = sorted((n for n in totals if n is not None)) + [None] * (None in totals)
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    out, budget, open_ = {}, share * sum(totals.values()), set(names)
    while open_:
        unit = budget / sum(weight[n] for n in open_)
        full = {n for n in open_ if unit * weight[n] >= most * totals[n]}
        if not full:
            return out | {n: unit * weight[n] for n in open_}
        out |= {n: most * totals[n] for n in full}
        budget = max(0.0, budget - sum(most * totals[n] for n in full))
        open_ -= full
    return out


def thresholds(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target, full, below: the mix's rule, one row for each source.

    sized: source, place, size. It is read once for the totals and once for each level that is still open.
    """
    spark = sized.sparkSession
    rows = sized.groupBy("source").agg(F.sum("size")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    totals = {r[0]: r[1] or 0 for r in rows}
    wanted = targets(totals, weights, share, most)
    full = {n: int(wanted[n] // totals[n]) if totals[n] else 0 for n in totals}
    below = dict.fromkeys(totals, 0)
    # of each open source: the bits found so far, and the words still wanted within them
    open_ = {n: (0, wanted[n] - full[n] * totals[n]) for n in totals if wanted[n] - full[n] * totals[n] > 0}
    kind = sized.schema["source"].dataType.simpleString()
    for level in range(1, LEVELS + 1):
        if not open_:
            break
        shift = PLACE_BITS - LEVEL_BITS * level
        state = spark.createDataFrame([(n, *s) for n, s in open_.items()], f"o_source {kind}, prefix long, rest double")
        within = sized.join(F.broadcast(state), F.col("source").eqNullSafe(F.col("o_source"))).where(
            F.shiftright("place", shift + LEVEL_BITS) == F.col("prefix")
        )
        sums = within.groupBy("source", "rest", F.shiftright("place", shift).alias("bucket")).agg(
            F.sum("size").alias("words"), F.count("*").alias("rows")
        )
        run = sums.withColumn("upto", F.sum("words").over(Window.partitionBy("source").orderBy("bucket")))
        first = F.min(F.when(F.col("upto") > F.col("rest"), F.struct("bucket", "upto", "words", "rows")))
        found = run.groupBy("source", "rest").agg(first.alias("b")).select("source", "rest", "b.*").collect()
        after = {}
        for source, rest, bucket, upto, words, rows_ in found:
            if bucket is None:  # rounding alone: the whole source is wanted
                below[source] = 1 << PLACE_BITS
            elif rows_ == 1 or level == LEVELS:  # the bucket can't be split: whichever end is nearer
                below[source] = (bucket + (2 * (rest - (upto - words)) >= words)) << shift
            else:
                after[source] = (bucket, rest - (upto - words))
        open_ = after
    rule = [(n, totals[n], float(wanted[n]), full[n], below[n]) for n in totals]
    return spark.createDataFrame(rule, f"source {kind}, source_size long, target double, full long, below long")


def _ruled(df: DataFrame, rule: DataFrame, place_: Column) -> DataFrame:
    """`df` with the rule of its source (a table of MAX_SOURCES rows at most) and copies, how often a row is taken."""
    held = rule.withColumnRenamed("source", "r_source")
    out = df.join(F.broadcast(held), F.col("source").eqNullSafe(F.col("r_source")))
    return out.withColumn("copies", F.col("full") + (place_ < F.col("below")).cast("long"))


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken (size times copies) of every document."""
    sized = stored(sizes(docs), scratch(docs.sparkSession))
    out = _ruled(sized, thresholds(sized), F.col("place"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """The documents of the mix with all their columns, each as often as it is taken. Texts stay where they are: no shuffle of them."""
    sized = stored(sizes(docs).select("source", "place", "size"), scratch(docs.sparkSession))
    of, full, below, copy = unused(docs, "of_source", "full", "below", "copy")
    rule = thresholds(sized).select(F.col("source").alias(of), F.col("full").alias(full), F.col("below").alias(below))
    ruled = docs.join(F.broadcast(rule), F.col("source").eqNullSafe(F.col(of)))
    often = F.col(full) + (place() < F.col(below)).cast("long")
    return ruled.select(*columns(docs), F.explode(F.array_repeat(F.lit(0), often.cast("int"))).alias(copy)).select(*columns(docs))

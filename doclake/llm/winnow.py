"""Document fingerprints by winnowing.

All grams of GRAM code points are hashed; of each window of WINDOW grams the least hash is chosen, the rightmost of
equal ones, with its position. Two texts that share GRAM + WINDOW - 1 code points in a row share a chosen hash
there. A text of fewer grams than a window is one window; a text shorter than a gram is one gram.

Defined results: a null text counts as empty and has no hashes; two empty fingerprints are alike (1.0), an empty
and another are not (0.0); ids of any type that has an order are taken; rows with one doc_id follow each other by
descending hash of the text (64 bits, null as empty), then by text; null ids come after all others; an empty table
gives no rows; extra columns are ignored. A stretch below may begin within one doc_id; only rows that are the same in
doc_id and text share one.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclake.llm.common import appended, named_back, plain_named, slices, typed, without

#: Powers of two: hashes and minima are built by doubling.
GRAM, WINDOW = 16, 32
#: Code points of a text that are hashed at once.
PIECE = 1 << 20
#: Stretches of the descending order for each shuffle partition.
STRETCHES = 4


def _mixed(h):
    """The bits of 64-bit values spread over all others (in place)."""
    import numpy as np

    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return h


def _grams(points):
    """A 32-bit hash, in 64-bit integers, of every gram; of the whole if it is shorter than a gram."""
    import numpy as np

    h = _mixed(points.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0x632BE59BD9B4E019))
    base = np.uint64(0x2545F4914F6CDD1D)
    if len(h) < GRAM:
        for i in range(1, len(h)):
            h[0] = h[0] * base + h[i]
        h = h[:1] + np.uint64(len(points))
    else:
        size = 1
        while size < GRAM:
            h = h[:-size] * base + h[size:]
            base *= base
            size *= 2
    return _mixed(h) >> np.uint64(32)


def winnow(points):
    """(hashes uint32, positions int64) of an array of code points, in order of position."""
    import numpy as np

    last = np.uint64(0xFFFFFFFF)
    out = []
    with np.errstate(over="ignore"):
        for start in range(0, max(1, len(points)), PIECE):
            piece = points[start : start + PIECE + GRAM + WINDOW - 2]  # every window that begins in the piece, whole
            if not len(piece) or start and len(piece) < GRAM + WINDOW - 1:
                continue  # no window begins here: all that end here began before
            h = _grams(piece)
            # least hash first, then the rightmost place
            key = (h << np.uint64(32)) | (last - (np.arange(len(h), dtype=np.uint64)))
            if len(key) <= WINDOW:
                key = key.min(keepdims=True)
            else:
                size = 1
                while size < WINDOW:
                    key = np.minimum(key[:-size], key[size:])
                    size *= 2
            key = key[np.flatnonzero(np.append(True, key[1:] != key[:-1]))]
            out.append(((key >> np.uint64(32)).astype(np.uint32), (last - (key & last)).astype(np.int64) + start))
    if not out:
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    hashes, places = (np.concatenate(x) for x in zip(*out, strict=True))
    fresh = np.append(True, places[1:] > np.maximum.accumulate(places)[:-1])  # windows of two pieces may choose one place
    return hashes[fresh], places[fresh]


def points_of(text: str):
    import numpy as np

    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def likeness(a, b) -> float:
    """Shared share of all distinct hashes of two fingerprints."""
    import numpy as np

    a, b = np.unique(a), np.unique(b)
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def as_text(hashes) -> str:
    """Eight hexadecimal digits for each hash, in order of position."""
    return hashes.astype(">u4").tobytes().hex()


def fingerprints(docs: DataFrame) -> DataFrame:
    """The documents with hashes array<long> and positions array<long>."""
    held, back = plain_named(without(docs, "hashes", "positions"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for part, texts in slices(batch):
                both = [winnow(points_of(t)) for t in texts]
                lists = [pa.array([np.asarray(x[i], np.int64) for x in both], pa.list_(pa.int64())) for i in (0, 1)]
                yield appended(part, hashes=lists[0], positions=lists[1])

    return named_back(held.mapInArrow(run, f"{typed(held)}, hashes array<long>, positions array<long>"), back)


def _heads(docs: DataFrame) -> list[str]:
    """The first key of each stretch as JSON, in descending order: keys are dealt into ranges, without their texts."""
    n = STRETCHES * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = docs.select("doc_id", "mark").distinct()
    ranges = keys.repartitionByRange(n, F.col("doc_id").desc_nulls_last(), F.col("mark").desc()).withColumn("range", F.spark_partition_id())
    heads = ranges.groupBy("range").agg(F.max(F.struct("doc_id", "mark")).alias("head"))
    in_all = F.sort_array(F.collect_list("head"), asc=False)
    return heads.agg(F.transform(in_all, lambda h: F.to_json(h)).alias("heads")).first()["heads"]


def _place(key: Column, heads: list[str], kind: str, step: int = 100) -> tuple[Column, Column]:
    """The number of the stretch that a key is in, found in two steps, and whether the key is its head.

    The heads are one literal each time, which Spark makes an array once, however many partitions there are.
    """
    type_ = f"array<struct<doc_id: {kind}, mark: bigint>>"
    all_, coarse = (F.from_json(F.lit(f"[{','.join(h)}]"), type_) for h in (heads, heads[::step]))
    hop = F.greatest(F.size(F.filter(coarse, lambda h: h >= key)) - 1, F.lit(0)) * step
    own = hop + F.size(F.filter(F.slice(all_, hop + 1, F.lit(step)), lambda h: h >= key)) - 1
    return own, F.get(all_, own).eqNullSafe(key)


def in_order(docs: DataFrame) -> DataFrame:
    """Partitions of rows (stretch, lent, doc_id, mark, text) sorted by these; doc_id and mark, a hash of the text, descend.

    A stretch is a range of the descending order and ends with the first row of the next stretch, lent to it; the
    last one is lent the very first row. A stretch may begin within the rows of one doc_id; only the first key of each
    is known to the driver.
    """
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    heads = _heads(rows)
    order = ["stretch", "lent", F.col("doc_id").desc_nulls_last(), F.col("mark").desc(), F.col("text").asc_nulls_first()]
    own, first = _place(F.struct("doc_id", "mark"), heads, kind)
    placed = rows.withColumn("own", own).withColumn("first", first)
    once = F.struct(F.col("own").alias("stretch"), F.lit(False).alias("lent"))
    before = F.when(F.col("own") > 0, F.col("own") - 1).otherwise(F.lit(max(len(heads) - 1, 0)))
    twice = F.array(once, F.struct(before.alias("stretch"), F.lit(True).alias("lent")))
    goes = F.explode(F.when(F.col("first"), twice).otherwise(F.array(once))).alias("g")
    held = placed.select("doc_id", "mark", "text", goes).select("g.stretch", "g.lent", "doc_id", "mark", "text")
    return held.repartition("stretch").sortWithinPartitions(*order)


def with_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document.

    The edited text has its last floor(n_chars / 2) code points replaced by as many first ones of the next document
    in descending doc_id, or by all of it if it is shorter.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        types = [None, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        before = None  # (stretch, id, text, fingerprint) of a row that waits for the next one
        for batch in batches:
            types[0] = batch.schema.field("doc_id").type
            for part, texts in slices(batch):
                rows, columns = [], (part.column(c).to_pylist() for c in ("stretch", "lent", "doc_id"))
                for stretch, lent, id_, text in zip(*columns, texts, strict=True):
                    own = winnow(points_of(text))[0]
                    if before and before[0] == stretch:
                        _, b_id, b_text, b_own = before
                        half = len(b_text) // 2
                        edited = b_text[: len(b_text) - half] + text[:half]
                        marks = winnow(points_of(edited))[0]
                        sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                        rows.append((b_id, len(b_text), sha, as_text(b_own), as_text(marks), likeness(b_own, marks), likeness(b_own, own)))
                    before = None if lent else (stretch, id_, text, own)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return in_order(docs.select("doc_id", "text")).mapInArrow(
        run,
        f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )

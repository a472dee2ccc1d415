"""Exact dedup by deterministic block naming.

A text is cut into blocks of fixed size. Equal blocks get one integer name, different blocks different names, in
sorted order. Then names of adjacent blocks are paired and each distinct pair gets a name, again and again, until
each document has one name. Two texts of the same number of blocks have the same last name exactly if they are
equal: names stand for contents, never for hashes of them.

Defined results: a null text counts as empty, and empty texts equal each other; of rows with equal texts the one
with the smallest doc_id stays (null ids last; of repeated rows exactly one stays); keep_id is null only if no row
of the group has an id; an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclake.llm.common import scratch, stored, text_or_empty

BLOCK_BYTES = 4096


def normalised(text: Column) -> Column:
    """Each run of white space becomes one space. A lone space is no match, so most texts pass with few copies."""
    return F.regexp_replace(text, r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def _blocks(docs: DataFrame, block_bytes: int, *keep: Column) -> DataFrame:
    """Columns `keep`, data (the normalised text's bytes), n (its number of blocks, 1 at least)."""
    data = normalised(text_or_empty()).cast("binary")
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("data") / block_bytes)).cast("int")
    return docs.select(*keep, data.alias("data")).withColumn("n", n)


def _cut(block_bytes: int, made) -> Column:
    return F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: made(F.substr("data", i * block_bytes + 1, F.lit(block_bytes))))


def _named(distinct: DataFrame, by: list[str]) -> DataFrame:
    """Gives each row an integer: its place in the sorted partition, above the partition's number."""
    return distinct.sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id())


def block_names(docs: DataFrame, path: str, block_bytes: int, block_hash) -> tuple[DataFrame, DataFrame]:
    """The documents (uid, doc_id, sha, n) and the first names of their blocks (uid, n, idx, name).

    Contents move once, when they are made distinct and sorted. Names find their blocks by hash; a hash that
    two contents share is found after the naming, and its blocks find their names by content instead.
    """
    rows = _blocks(docs, block_bytes, F.col("doc_id"))
    seen = stored(
        rows.select("doc_id", F.sha2("data", 256).alias("sha"), "n", _cut(block_bytes, block_hash).alias("hashes")).withColumn(
            "uid", F.monotonically_increasing_id()
        ),
        f"{path}/seen",
    )
    blocks = rows.select(F.explode(_cut(block_bytes, lambda b: b)).alias("block")).select(block_hash(F.col("block")).alias("h"), "block")
    names = stored(_named(blocks.groupBy("h", "block").agg(F.lit(1).alias("one")), ["h", "block"]).select("h", "name"), f"{path}/names")
    by_hash = names.groupBy("h").agg(F.min("name").alias("name"), F.count("*").alias("c"))
    occurs = seen.select("uid", "n", F.posexplode("hashes").alias("idx", "h"))
    shared = stored(by_hash.where("c > 1").select("h"), f"{path}/shared")
    if shared.isEmpty():
        return seen, occurs.join(names, "h").select("uid", "n", "idx", "name")
    # uid is not known to the contents, so blocks of shared hashes carry doc_id and sha; equal rows share their names
    apart = (
        rows.withColumn("sha", F.sha2("data", 256))
        .select("doc_id", "sha", F.posexplode(_cut(block_bytes, lambda b: b)).alias("idx", "block"))
        .withColumn("h", block_hash(F.col("block")))
        .join(shared, "h", "left_semi")
    )
    whole = stored(_named(apart.select("h", "block").distinct(), ["h", "block"]).withColumn("name", -1 - F.col("name")), f"{path}/whole")
    found = apart.join(whole, ["h", "block"]).select("doc_id", "sha", "idx", "name").distinct()
    told = seen.select("uid", "doc_id", "sha", "n").alias("s").join(
        found.alias("f"), F.expr("s.sha = f.sha AND s.doc_id <=> f.doc_id")
    ).select("uid", "n", "idx", "name")
    alone = by_hash.where("c = 1").select("h", "name")
    return seen, occurs.join(alone, "h").select("uid", "n", "idx", "name").unionByName(told)


def identities(docs: DataFrame, block_bytes: int = BLOCK_BYTES, block_hash=F.xxhash64) -> DataFrame:
    """uid, doc_id, sha (SHA-256 of the normalised text), n, name; (n, name) is the text's identity."""
    path = scratch(docs.sparkSession)
    seen, names = block_names(docs, path, block_bytes, block_hash)
    names = stored(names, f"{path}/level0")
    left = seen.agg(F.max("n")).first()[0] or 1
    done, level = names.where("n = 1").select("uid", "name"), 0
    open_ = names.where("n > 1").withColumn("m", F.col("n"))
    while left > 1:  # as many rounds as the longest text needs, halving each time
        level, left = level + 1, (left + 1) // 2
        even = F.col("idx") % 2 == 0
        pairs = open_.groupBy("uid", "n", "m", F.floor(F.col("idx") / 2).cast("int").alias("half")).agg(
            F.max(F.when(even, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-(2**63))).alias("b")
        )
        pairs = stored(pairs, f"{path}/pairs{level}")
        named = stored(_named(pairs.select("a", "b").distinct(), ["a", "b"]), f"{path}/pair_names{level}")
        after = pairs.join(named, ["a", "b"]).select(
            "uid", "n", F.ceil(F.col("m") / 2).cast("int").alias("m"), F.col("half").alias("idx"), "name"
        )
        after = stored(after, f"{path}/level{level}")
        done = done.unionByName(after.where("m = 1").select("uid", "name"))
        open_ = after.where("m > 1")
    return seen.select("uid", "doc_id", "sha", "n").join(done, "uid")


def exact_dedup(docs: DataFrame, block_bytes: int = BLOCK_BYTES, block_hash=F.xxhash64) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text)."""
    ids = identities(docs, block_bytes, block_hash)
    path = scratch(docs.sparkSession)
    ids = stored(ids, f"{path}/ids")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "uid"))
    groups = stored(
        ids.groupBy("n", "name").agg(first.alias("first"), F.count("*").alias("group_size")), f"{path}/groups"
    )  # written, so that the join below deals both sides anew and Spark can split a large group
    return ids.join(groups, ["n", "name"]).select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("uid") == F.col("first.uid")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


ORACLE = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM t
"""

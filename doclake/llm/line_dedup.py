"""Line dedup over levelled sorted runs of line hashes.

How many documents hold a line is kept in runs: tables dealt into buckets by the line's 128-bit hash and sorted by it,
once, when they are written. Documents come in batches. A batch's counts are dealt alike and merge-anti-join the lines
that the runs already know to be frequent, bucket by bucket as they lie; what is left becomes a run of level 0. When a
level has FANOUT runs, they are compacted into one run of the next level. So a line's count is summed over less than
FANOUT runs a level, and of a later batch only its own counts are shuffled; runs are read, not dealt again. A run's folder
names the batches it holds, so a batch that is sent again is known, and runs are found again by a later session.

Defined results: a row is a document; a line counts once a document; a null text counts as one empty line; an
empty key is never dropped; a document that loses all its lines has an empty text; repeated rows are documents of
their own and lose the same lines; an empty table gives no rows; columns of the input with the names of results
(counts, null for none) are replaced, all others stay as they are; very long lines and texts are read whole.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doclake.llm.common import columns, named_back, plain_named, quoted, removed, scratch, slices, stored, trimmed, typed_each, unused, without

MIN_DOCS = 10
MIN_CHARS = 1
BATCHES, FANOUT = 4, 2
#: A task's counts are given on when it holds so many lines.
HELD_LINES = 200_000
#: Bytes of text that are split at once.
SLICE = 1 << 20
STRIP = b" \t\n\v\f\r"


def line_keys(text: str, min_chars: int = MIN_CHARS) -> list[bytes]:
    """16 bytes for each line of the text, or b"" where its key is shorter than `min_chars` code points."""
    import xxhash

    out = []
    for line in text.encode("utf-8", "surrogatepass").split(b"\n"):
        key = line.strip(STRIP).lower()  # of bytes: A-Z only
        long = len(key) >= min_chars and (min_chars < 2 or len(key.decode("utf-8", "replace")) >= min_chars)
        out.append(xxhash.xxh3_128_digest(key) if long else b"")
    return out


def _pair(keys: list[bytes]):
    """Two 64-bit columns that hold the 16-byte keys."""
    import numpy as np
    import pyarrow as pa

    both = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
    return pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())


def _counted(min_chars: int):
    def run(batches):
        import pyarrow as pa

        held: dict[int, dict[bytes, int]] = {}

        def given():
            for b, counts in held.items():
                h1, h2 = _pair(list(counts))
                yield pa.RecordBatch.from_arrays([pa.array([b] * len(counts), pa.int32()), h1, h2, pa.array(list(counts.values()), pa.int64())], ["batch", "h1", "h2", "n"])
            held.clear()

        for batch in batches:
            for part, texts in slices(batch, SLICE):
                for b, text in zip(part.column("batch").to_pylist(), texts, strict=True):
                    counts = held.setdefault(b, {})
                    for key in set(line_keys(text, min_chars)):
                        if key:
                            counts[key] = counts.get(key, 0) + 1
                if sum(map(len, held.values())) > HELD_LINES:
                    yield from given()
        yield from given()

    return run


class Runs:
    """The levelled runs below `path`; each is a table of h1, h2, n in `buckets` files sorted by (h1, h2)."""

    def __init__(self, path: str, min_docs: int = MIN_DOCS, fanout: int = FANOUT, buckets: int | None = None):
        self.path, self.min_docs, self.fanout = path, min_docs, fanout
        self.spark = SparkSession.getActiveSession()
        #: (first batch, last batch) of each run, the oldest first
        self.runs, self.buckets = self._found()
        self.buckets = self.buckets or buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def _found(self) -> tuple[list[tuple[int, int]], int | None]:
        """The committed runs, without those that a larger one holds, and their number of buckets."""
        jvm, sc = self.spark.sparkContext._jvm, self.spark.sparkContext
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/run_*/_SUCCESS")
        names = [x.getPath().getParent().getName() for x in where.getFileSystem(sc._jsc.hadoopConfiguration()).globStatus(where) or []]
        told = sorted(tuple(map(int, n.split("_")[1:])) for n in names)
        spans = [t[:2] for t in told]
        return [s for s in spans if not any(o != s and o[0] <= s[0] and s[1] <= o[1] for o in spans)], told[0][2] if told else None

    @property
    def levels(self) -> list[list[tuple[int, int]]]:
        """The runs by level: one of level k holds fanout^k batches."""
        out: list[list[tuple[int, int]]] = []
        for first, last in self.runs:
            level = round(math.log(last - first + 1, self.fanout))
            out += [[] for _ in range(level + 1 - len(out))]
            out[level].append((first, last))
        return out

    def _place(self, run: tuple[int, int]) -> tuple[str, str]:
        """A run's folder, and the name of its table in the session's catalog."""
        folder = f"{self.path}/run_{run[0]}_{run[1]}_{self.buckets}"
        return folder, "line_run_" + hashlib.md5(folder.encode()).hexdigest()

    def _read(self, run: tuple[int, int]) -> DataFrame:
        folder, name = self._place(run)
        if not self.spark.catalog.tableExists(name):
            columns_ = "h1 BIGINT, h2 BIGINT, n BIGINT"
            self.spark.sql(f"CREATE TABLE {name} ({columns_}) USING parquet CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {self.buckets} BUCKETS LOCATION '{folder}'")
        return self.spark.table(name)

    def _write(self, counts: DataFrame, run: tuple[int, int]) -> None:
        folder, name = self._place(run)
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        counts.write.mode("overwrite").bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", folder).saveAsTable(name)

    def counts(self) -> DataFrame | None:
        """h1, h2, n summed over all runs."""
        return self._sums(self.runs)

    def _sums(self, runs: list[tuple[int, int]]) -> DataFrame | None:
        """Runs merged by full joins, which read two of them bucket by bucket. (A union of bucketed tables would not do:
        Spark 4.1 may stop to read them by buckets after it has left out the shuffle.)"""
        both = lambda x, y: x.join(y.withColumnRenamed("n", "m"), ["h1", "h2"], "full").select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))
        return reduce(both, map(self._read, runs)) if runs else None

    def frequent(self) -> DataFrame | None:
        """h1, h2 of the lines found in min_docs documents at least."""
        known = self.counts()
        return None if known is None else known.where(F.col("n") >= self.min_docs).select("h1", "h2")

    def add(self, counts: DataFrame, batch: int | None = None) -> bool:
        """A batch's counts (h1, h2, n), partial ones too, become a run; full levels are compacted.

        batch: its number, the next one if it is not given; False if it is held already.
        """
        after = self.runs[-1][1] + 1 if self.runs else 0
        if batch is not None and batch != after:
            if batch < after:
                return False
            raise ValueError(f"batch {batch} comes before batch {after}")
        # dealt and summed by one shuffle, into the buckets that the runs have
        new = counts.repartition(self.buckets, "h1", "h2").groupBy("h1", "h2").agg(F.sum("n").alias("n"))
        self._write(self.unsettled(new), (after, after))
        self.runs.append((after, after))
        while full := self._full():
            merged = (full[0][0], full[-1][1])
            self._write(self._sums(full), merged)
            self.runs = [r for r in self.runs if r not in full] + [merged]
            self.runs.sort()
            for run in full:
                self._forget(run)
        return True

    def unsettled(self, new: DataFrame) -> DataFrame:
        """Of h1, h2, n those that the runs don't know to be frequent: an anti-join with the merged runs, a run at a time."""
        known = F.lit(0)
        for i, run in enumerate(self.runs):
            new = new.join(self._read(run).withColumnRenamed("n", f"n{i}").hint("merge"), ["h1", "h2"], "left")
            known = known + F.coalesce(f"n{i}", F.lit(0))
        return new.where(known < self.min_docs).select("h1", "h2", "n")

    def _full(self) -> list[tuple[int, int]]:
        """The runs of the lowest level that has as many as are compacted."""
        return next((level for level in self.levels if len(level) >= self.fanout), [])

    def _forget(self, run: tuple[int, int]) -> None:
        folder, name = self._place(run)
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        removed(self.spark, folder)

    def remove(self) -> None:
        """Drops all runs, for whoever needs them no more."""
        for run in self.runs:
            self._forget(run)
        self.runs = []


def _row_key(docs: DataFrame) -> tuple[Column, Column]:
    """128 bits that tell rows apart by id and text; equal rows have equal lines, so they may share them."""
    own = [F.col("doc_id").cast("string"), F.col("text")]
    return F.xxhash64(*own).alias("k1"), F.xxhash64(F.lit("line"), *own).alias("k2")


def _held_lines(min_chars: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for part, texts in slices(batch, SLICE):
                keys = [[k for k in dict.fromkeys(line_keys(t, min_chars)) if k] for t in texts]
                at = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
                h1, h2 = _pair([k for ks in keys for k in ks])
                yield pa.RecordBatch.from_arrays([part.column("k1").take(pa.array(at)), part.column("k2").take(pa.array(at)), h1, h2], ["k1", "k2", "h1", "h2"])

    return run


def _rebuilt(min_chars: int, drop_: str, counts: tuple[str, ...]):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for part, texts in slices(batch, SLICE):
                out, lines, dropped = [], [], []
                for text, drop in zip(texts, part.column(drop_).to_pylist(), strict=True):
                    own = text.split("\n")
                    kept = own
                    if drop:
                        gone = {np.array([d["h1"], d["h2"]], "<i8").tobytes() for d in drop}
                        kept = [x for x, k in zip(own, line_keys(text, min_chars), strict=True) if k not in gone]
                    out.append("\n".join(kept))
                    lines.append(len(own))
                    dropped.append(len(own) - len(kept))
                names = [n for n in part.schema.names if n not in (drop_, "text")]
                told = [pa.array(x, pa.int64()) for x in (lines, dropped)][: len(counts)]
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], pa.array(out, pa.string()), *told], [*names, "text", *counts])
        trimmed()

    return run


def line_runs(docs: DataFrame, path: str, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, batches: int = BATCHES) -> Runs:
    """The runs over all documents, added batch by batch."""
    batch = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(batches)).cast("int")
    counted = docs.select(batch.alias("batch"), "text").mapInArrow(_counted(min_chars), "batch int, h1 long, h2 long, n long")
    counted.write.partitionBy("batch").parquet(f"{path}/counted")
    held = docs.sparkSession.read.schema("h1 long, h2 long, n long, batch int").parquet(f"{path}/counted")
    runs = Runs(f"{path}/runs", min_docs)
    for b in range(batches):
        runs.add(held.where(F.col("batch") == b).select("h1", "h2", "n"))
    removed(docs.sparkSession, f"{path}/counted")
    return runs


def line_dedup(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, counts: tuple[str, ...] = ("n_lines", "n_dropped")) -> DataFrame:
    """The documents with the lines that min_docs documents share taken out, and `counts`: the lines before, those dropped."""
    path = scratch(docs.sparkSession)
    runs = line_runs(docs, path, min_docs, min_chars)
    frequent = stored(runs.frequent(), f"{path}/frequent")
    runs.remove()
    k1, k2 = _row_key(docs)
    lines = docs.select(k1, k2, "text").mapInArrow(_held_lines(min_chars), "k1 long, k2 long, h1 long, h2 long")
    held, back = plain_named(without(docs, *counts))
    one, two, drop_ = unused(held, "k1", "k2", "drop_")
    drop = (
        lines.join(frequent, ["h1", "h2"], "left_semi").groupBy(F.col("k1").alias(one), F.col("k2").alias(two)).agg(F.collect_set(F.struct("h1", "h2")).alias(drop_))
    )
    joined = held.withColumns({one: k1, two: k2}).join(drop, [one, two], "left").drop(one, two)
    others = [x for x, name in zip(typed_each(held), held.columns, strict=True) if name != "text"]
    out = joined.mapInArrow(_rebuilt(min_chars, drop_, counts), ", ".join([*others, "text string", *[f"{quoted(c)} long" for c in counts]]))
    return named_back(out.select(*columns(held), *[F.col(quoted(c)) for c in counts]), back)


def digest(deduped: DataFrame) -> DataFrame:
    return deduped.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k,
         unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
keyed AS (
  SELECT doc_id, k, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
frequent AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
told AS (SELECT doc_id, k, line, key IN (SELECT key FROM frequent) AS gone FROM keyed)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM told GROUP BY doc_id
"""

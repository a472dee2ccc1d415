"""Token counts as delta-maintained rollups.

Changes come in batches: a document's count is inserted (+), deleted (-), or revised, which is a deletion of the
old and an insertion of the new count. A batch becomes one small table of signed sums by source, language and
tokenizer version. A batch is committed under its own number: its folder is written by Spark's committer, and a
batch whose folder has been committed is never applied again. compact() folds the batches up to a number into a
snapshot; totals are the newest snapshot and the batches after it, so reading them doesn't grow with history.

Defined results: null sources, languages and versions are groups of their own; a null count counts as 0 tokens; a
null text has 0 tokens; repeated rows of a batch all count; groups whose documents and tokens come to 0 have no
row; an empty batch is committed as such; extra columns of the changes are ignored, whatever their names, but `sign`
is a result of inserted() and deleted() and replaces a column of that name; very long texts only make larger numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doclake.llm.common import WHITE, scratch, text_or_empty

KEYS = ("source", "lang", "version")
SCHEMA = "source string, lang string, version string, n_docs long, n_tokens long"


class Rollup:
    """Additive totals below the folder `path` of a shared file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _folder(self, kind: str, number: int) -> str:
        return f"{self.path}/{kind}={int(number)}"

    def _done(self, kind: str) -> list[int]:
        """The numbers of the committed folders of a kind, in order; one listing."""
        jvm, sc = self.spark.sparkContext._jvm, self.spark.sparkContext
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}=*/_SUCCESS")
        found = where.getFileSystem(sc._jsc.hadoopConfiguration()).globStatus(where) or []
        return sorted(int(x.getPath().getParent().getName().partition("=")[2]) for x in found)

    def batches(self) -> list[int]:
        """Committed batches, those within a snapshot too."""
        return self._done("batch_id")

    def committed(self, batch: int) -> bool:
        return batch in self.batches()

    def apply(self, batch: int, changes: DataFrame) -> bool:
        """Commits changes (source, lang, version, sign, n_tokens) as batch `batch`; False if it was committed before.

        An attempt that was broken off has left no _SUCCESS, and the next one overwrites it. A batch can't be added
        below a snapshot, which has folded everything up to its number.
        """
        if self.committed(batch):
            return False
        if any(batch <= s for s in self._done("snapshot")):
            raise ValueError(f"batch {batch} is below a snapshot that does not hold it")
        sums = changes.groupBy(*KEYS).agg(
            F.sum(F.col("sign").cast("long")).alias("n_docs"), F.sum(F.col("sign") * F.coalesce("n_tokens", F.lit(0))).cast("long").alias("n_tokens")
        )
        sums.write.mode("overwrite").parquet(self._folder("batch_id", batch))
        return True

    def compact(self, upto: int) -> bool:
        """Folds the committed batches up to `upto` into one snapshot; False if that snapshot is committed already.

        A snapshot that was broken off has left no _SUCCESS: totals() goes on with the one before it and its batches.
        """
        if upto in self._done("snapshot"):
            return False
        self._sums(upto).write.mode("overwrite").parquet(self._folder("snapshot", upto))
        return True

    def _sums(self, upto: int | None) -> DataFrame:
        within = lambda n: upto is None or n <= upto
        last = max(filter(within, self._done("snapshot")), default=None)
        paths = [self._folder("batch_id", b) for b in self.batches() if within(b) and (last is None or b > last)]
        paths += [] if last is None else [self._folder("snapshot", last)]
        if not paths:
            return self.spark.createDataFrame([], SCHEMA)
        held = self.spark.read.schema(SCHEMA).parquet(*paths)
        return held.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))

    def totals(self, upto: int | None = None) -> DataFrame:
        """source, lang, version, n_docs, n_tokens over the committed batches, or over those up to a number."""
        return self._sums(upto).where("n_docs <> 0 OR n_tokens <> 0")


def inserted(counts: DataFrame) -> DataFrame:
    return counts.withColumn("sign", F.lit(1))


def deleted(counts: DataFrame) -> DataFrame:
    return counts.withColumn("sign", F.lit(-1))


def revised(old: DataFrame, new: DataFrame) -> DataFrame:
    return deleted(old).unionByName(inserted(new))


def words(text: Column) -> Column:
    """The number of words: white space runs are made one space, and spaces counted."""
    bare = F.trim(F.regexp_replace(text, f"[{WHITE}]+", " "))
    return F.when(bare == "", 0).otherwise(F.length(bare) - F.length(F.replace(bare, F.lit(" "), F.lit(""))) + 1).cast("long")


def letters(text: Column) -> Column:
    """The number of runs of ASCII letters."""
    bare = F.trim(F.regexp_replace(text, "[^A-Za-z]+", " "))
    return F.when(bare == "", 0).otherwise(F.length(bare) - F.length(F.replace(bare, F.lit(" "), F.lit(""))) + 1).cast("long")


def history(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Totals after four batches over all documents, of which one is sent twice and two are folded into a snapshot.

    1: each document's words. 2: each document's runs of letters, as another version. 3: words are revised to
    leave out the first line of documents labelled toxic. 4: documents labelled bad are deleted, as they are now.
    """
    spark = docs.sparkSession
    told = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    text = text_or_empty()
    # texts become numbers where they are read, so that labels join three numbers a document
    counts = docs.select("doc_id", "source", "lang", words(text).alias("words"), letters(text).alias("letters"), words(F.substring_index(text, "\n", 1)).alias("first"))
    counts.write.parquet(counted := f"{scratch(spark)}/counted")
    counts = spark.read.schema(counts.schema).parquet(counted).join(told, "doc_id", "left")
    counts = counts.select("source", "lang", "toxic", "quality", "words", "letters", (F.col("words") - F.col("first")).alias("rest"))
    counts.write.parquet(path := f"{scratch(spark)}/counts")
    counts = spark.read.schema(counts.schema).parquet(path)
    of = lambda version, n: counts.select("source", "lang", "toxic", "quality", F.lit(version).alias("version"), F.col(n).alias("n_tokens"))
    toxic, bad = F.col("toxic") == 1, F.col("quality") == 0
    roll = Rollup(spark, scratch(spark))
    roll.apply(1, inserted(of("words-1", "words")))
    roll.apply(2, inserted(of("letters-2", "letters")))
    roll.compact(2)
    third = revised(of("words-1", "words").where(toxic), of("words-1", "rest").where(toxic))
    roll.apply(3, third)
    now = of("words-1", "words").where(bad & ~F.coalesce(toxic, F.lit(False))).unionByName(of("words-1", "rest").where(bad & toxic))
    roll.apply(4, deleted(now.unionByName(of("letters-2", "letters").where(bad))))
    roll.apply(3, third)
    return roll.totals()


ORACLE = r"""
WITH told AS (SELECT doc_id, max(toxic) AS toxic, min(quality) AS quality FROM labels GROUP BY doc_id),
counted AS (
  SELECT source, lang, toxic, quality,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words,
         len(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+')) AS letters,
         len(regexp_extract_all(regexp_replace(coalesce(text, ''), '^[^\n]*', ''), '[^\x20\x09-\x0D]+')) AS rest
  FROM documents LEFT JOIN told USING (doc_id))
SELECT source, lang, 'words-1' AS version, count(*) AS n_docs, CAST(sum(CASE WHEN toxic = 1 THEN rest ELSE words END) AS BIGINT) AS n_tokens
FROM counted WHERE coalesce(quality, 1) <> 0 GROUP BY source, lang
UNION ALL
SELECT source, lang, 'letters-2', count(*), CAST(sum(letters) AS BIGINT)
FROM counted WHERE coalesce(quality, 1) <> 0 GROUP BY source, lang
"""

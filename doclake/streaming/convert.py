"""New files converted as they arrive. A document needs no other one, so each micro-batch is a whole batch run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from doclake.jobs.convert import convert

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def stream_convert(spark: SparkSession, in_dir: str, out_dir: str, from_: str, to: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Converts files of the format `from_` below in_dir into a folder of out_dir for each micro-batch.

    A batch that is repeated after a failure overwrites its own folder, so no file counts twice.
    """
    files = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", f"*.{from_}").load(in_dir)

    def run(batch: DataFrame, number: int) -> None:
        docs = batch.select(F.col("path").alias("doc_id"), *([F.col("content").cast("string").alias("md")] if from_ == "md" else [F.col("content").alias("bytes")]))
        convert(docs, from_, to).write.mode("overwrite").parquet(f"{out_dir}/batch={number}")

    return files.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

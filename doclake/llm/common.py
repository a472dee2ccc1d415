"""Small helpers that the operators of this package share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space, tab, newline, vertical tab, form feed, carriage return.
WHITE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` of the folder `sf_dir`."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def public_vocabulary(name: str) -> str:
    """Where the driver finds a public tokenizer's file, which is no part of this repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder of the session, for written intermediate tables.

    The folder comes from spark.checkpoint.dir, else from the context's checkpoint folder. Only where neither
    is set (local tests) a temporary folder of this machine is made and set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-doclake-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/doclake-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str) -> DataFrame:
    """`df` written to the shared folder and read again: cuts the lineage, and every reader sees the same rows."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Removes a folder of intermediate tables, which nothing may read any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def quoted(name: str) -> str:
    """A column's name as SQL takes it, whatever signs are in it."""
    return "`" + name.replace("`", "``") + "`"


def columns(df: DataFrame) -> list[Column]:
    """All columns of `df`, by quoted names."""
    return [F.col(quoted(c)) for c in df.columns]


def typed_each(df: DataFrame) -> list[str]:
    """Each column of `df` as DDL."""
    return [f"{quoted(f.name)} {f.dataType.simpleString()}" for f in df.schema.fields]


def typed(df: DataFrame) -> str:
    """The columns of `df` as DDL."""
    return ", ".join(typed_each(df))


def plain_named(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """`df` with plain names where columns have dots or other signs, which mapInArrow() doesn't take; and what they were."""
    plain = [c if re.fullmatch(r"\w+", c) else unused(df, f"plain_{i}")[0] for i, c in enumerate(df.columns)]
    return df.toDF(*plain), dict(zip(plain, df.columns, strict=True))


def named_back(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(quoted(c)).alias(names.get(c, c)) for c in df.columns])


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores as it takes to be no column of `df`: for what an operator adds for itself."""
    held, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in held:
            name += "_"
        out.append(name)
    return out


def without(df: DataFrame, *names: str) -> DataFrame:
    """`df` without columns that an operator is going to add: its results replace columns of the same name."""
    held = {n.lower() for n in names}
    return df.select(*[F.col(quoted(c)) for c in df.columns if c.lower() not in held])


def slices(batch, limit: int = 4 << 20):
    """(slice of the Arrow batch, its texts): whole rows, and about `limit` bytes of text at most if a row allows it.

    Null texts come as empty ones. This bounds what a Python worker holds beside the batch itself. Arrow's unused memory
    is given back before each batch, since workers live on and serve later stages too.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    pa.default_memory_pool().release_unused()

    sizes = pc.fill_null(pc.binary_length(batch.column("text").cast(pa.large_binary())), 0).to_pylist()
    start = held = 0
    for i, n in enumerate([*sizes, limit + 1]):
        if i > start and held + n > limit:
            part = batch.slice(start, i - start)
            yield part, [t or "" for t in part.column("text").to_pylist()]
            start, held = i, 0
        held += n


def trimmed() -> None:
    """Gives unused memory of a Python worker back to the system at the end of a task: it lives on and serves later stages."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
    if trim:
        trim(0)


def appended(batch, **arrays):
    """The Arrow batch with more columns."""
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([*batch.columns, *arrays.values()], [*batch.schema.names, *arrays])

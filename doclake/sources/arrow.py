"""Rows of documents to several rows each, by plain Python over Arrow batches, in batches of bounded size."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

#: An output batch ends with the row that makes it larger than this many bytes or rows.
BYTES, ROWS = 8 << 20, 20_000
TYPES = {"long": "int64", "int": "int32", "string": "string", "boolean": "bool_", "double": "float64", "binary": "binary"}
#: The parts of a package, as one value.
PARTS = "array<struct<part:string,bytes:binary>>"


#: Inputs of a row up to SMALL bytes, whose rows a task may take again, and how many it keeps.
SMALL, KEPT = 1 << 16, 64


def mapped_rows(df: DataFrame, inputs: list[str], columns: str, each: Callable[..., list[tuple]], repeats: bool = False, size: str | None = None) -> DataFrame:
    """doc_id and `columns` (DDL): each(*inputs of a row) lists the rows that it becomes. repeats: many rows have equal inputs,
    as parts that a program puts into all its packages; a task works on each once. size: the column that tells how many bytes
    a row stands for, where these are not in columns of bytes."""
    kind = df.schema["doc_id"].dataType.simpleString()
    names, ddl = zip(*(c.split() for c in columns.split(", ")), strict=True)
    nested = {t: to_arrow_type(DataType.fromDDL(t)) for t in ddl if t not in TYPES and t != PARTS}

    def run(batches):
        import pyarrow as pa

        binary, lists = ([i for i, t in enumerate(ddl) if t == kind] for kind in ("binary", PARTS))
        types = [nested[t] if t in nested else pa.list_(pa.struct([("part", pa.string()), ("bytes", pa.binary())])) if t == PARTS else getattr(pa, TYPES[t])() for t in ddl]
        weight = [names.index(size)] if size else []

        def batch_of(ids, at, rows):
            values = zip(*rows, strict=True) if rows else [[]] * len(names)
            return pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), *[pa.array(list(v), t) for v, t in zip(values, types, strict=True)]], ["doc_id", *names])

        known: dict[tuple, list[tuple]] = {}

        def found_of(own: list) -> list[tuple]:
            if not repeats or sum(len(x) for x in own if x is not None) > SMALL:
                return each(*own)
            key = tuple(own)
            if key not in known:
                if len(known) >= KEPT:
                    known.clear()
                known[key] = each(*own)
            return known[key]

        for batch in batches:
            ids, given = batch.column("doc_id"), [batch.column(c) for c in inputs]
            at, rows, held = [], [], 0
            for i in range(batch.num_rows):
                found = found_of([c[i].as_py() for c in given])
                rows += found
                at += [i] * len(found)
                held += sum(len(row[j]) for j in binary for row in found if row[j] is not None)
                held += sum(len(data) for j in lists for row in found for _, data in row[j] or ())
                held += sum(row[j] or 0 for j in weight for row in found)
                if held > BYTES or len(rows) > ROWS:
                    yield batch_of(ids, at, rows)
                    at, rows, held = [], [], 0
            if rows:
                yield batch_of(ids, at, rows)

    return df.select("doc_id", *inputs).mapInArrow(run, f"doc_id {kind}, {columns}")

"""Corpora of files: whole files as rows, packages as rows of parts, and back."""

from __future__ import annotations

import functools
import io
import struct
import zipfile
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclake.sources.arrow import PARTS, SMALL, mapped_rows

FORMATS = ("hwpx", "hwp", "docx", "md")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """path, format, bytes: a row for each file of a known format."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    ext = F.lower(F.regexp_extract("path", r"\.(\w+)$", 1))
    return files.select("path", ext.alias("format"), F.col("content").alias("bytes")).where(ext.isin(*FORMATS))


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """path, md: whole files as text."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("md"))


def write_markdown(df: DataFrame, path: str, buckets: int = 16) -> None:
    """doc_id and md as parquet, in folders by a hash of the id."""
    df.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets))).write.mode("overwrite").partitionBy("bucket").parquet(path)


def _content(z: zipfile.ZipFile, data: bytes, info: zipfile.ZipInfo) -> bytes:
    """What z.read(info) gives, without its reader of streams, which is most of the work for a small part. Whatever is not as
    it should be is left to it, so it tells the error."""
    at = info.header_offset
    if data[at : at + 4] == b"PK\3\4" and not info.flag_bits & 1 and info.compress_type in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        name, more = struct.unpack_from("<HH", data, at + 26)
        begin = at + 30 + name + more
        out = data[begin : begin + info.compress_size]
        try:
            out = out if info.compress_type == zipfile.ZIP_STORED else zlib.decompress(out, -15)
        except zlib.error:
            return z.read(info)
        if len(out) == info.file_size and zlib.crc32(out) == info.CRC:
            return out
    return z.read(info)


def _parts(data: bytes | None, prefixes: tuple[str, ...], required: tuple[str, ...]) -> dict[str, bytes]:
    """The parts of a package by their path."""
    data = data or b""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        infos = {i.filename.replace("\\", "/").lstrip("/"): i for i in z.infolist()}
        lacks = [r for r in required if r not in infos]
        if lacks:
            raise ValueError(f"no part {lacks[0]}")
        return {k: _content(z, data, i) for k, i in infos.items() if not prefixes or k.startswith(prefixes)}


def unzip_parts(docs: DataFrame, prefixes: tuple[str, ...] = (), required: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, part, bytes, error of packages (doc_id, bytes). Paths have / and no leading one; `prefixes` choose parts.

    A package that can't be opened, or lacks a required part, gives a row with an error and no part.
    """

    def parts(data):
        try:
            return [(k, v, None) for k, v in _parts(data, prefixes, required).items()]
        except Exception as e:  # one bad file never fails the job
            return [(None, None, f"{type(e).__name__}: {e}")]

    return mapped_rows(docs, ["bytes"], "part string, bytes binary, error string", parts)


def unzip_columns(docs: DataFrame, names: tuple[str, ...], folders: tuple[str, ...] = (), prefixes: tuple[str, ...] = (), required: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, p0, p1 and so on with the bytes of each of `names`, f0 and so on with the parts whose paths begin with each of
    `folders`, and error: a row a package, as of unzip_parts(). Written, each column is read by itself, and nothing is sorted
    or dealt for it."""

    def parts(data):
        try:
            held = _parts(data, prefixes, required)
        except Exception as e:  # one bad file never fails the job
            return [(*[None] * (len(names) + len(folders)), f"{type(e).__name__}: {e}")]
        return [(*map(held.get, names), *[[(k, v) for k, v in held.items() if k.startswith(f)] for f in folders], None)]

    columns = [*(f"p{i} binary" for i in range(len(names))), *(f"f{i} {PARTS}" for i in range(len(folders)))]
    return mapped_rows(docs, ["bytes"], ", ".join([*columns, "error string"]), parts)


def _entry(part: str, data: bytes) -> tuple[bytes, bytes, bytes]:
    """A part's header without its place, its name, and its packed bytes; the same at any time."""
    name, stored = part.encode(), part == "mimetype"
    if not stored:
        deflate = zlib.compressobj(wbits=-15)
        packed = deflate.compress(data) + deflate.flush()
    head = struct.pack("<5H3L2H", 20, 0 if part.isascii() else 0x800, 0 if stored else 8, 0, 33, zlib.crc32(data), len(data if stored else packed), len(data), len(name), 0)
    return head, name, data if stored else packed


#: Small parts that many packages share are packed once.
_small_entry = functools.lru_cache(64)(_entry)


def _shared_entry(part: str, data: bytes) -> tuple[bytes, bytes, bytes]:
    return (_small_entry if len(data) <= SMALL else _entry)(part, data)


def _zipped(entries: list[tuple[bytes, bytes, bytes]]) -> bytes:
    """A package of parts, which the writer of zipfile takes several times as long for. It is as small as a row, so no part
    needs large numbers."""
    out, listed, at = [], [], 0
    for head, name, packed in entries:
        listed += [b"PK\1\2\x14\0", head, struct.pack("<3H2L", 0, 0, 0, 0o600 << 16, at), name]
        out += [b"PK\3\4", head, name, packed]
        at += 4 + len(head) + len(name) + len(packed)
    tail = b"".join(listed)
    return b"".join([*out, tail, struct.pack("<4s4H2LH", b"PK\5\6", 0, 0, len(entries), len(entries), len(tail), at, 0)])


def zip_parts(packed: DataFrame, fixed: dict[str, str] | None = None) -> DataFrame:
    """doc_id, bytes of packages from rows (doc_id, parts array<struct<ord, part, bytes>>), a package each; no bytes without parts.

    Parts go in order, `mimetype` first and not packed. `fixed` parts, the same in all packages, are packed
    once a task, and so are small parts that packages share by chance.
    """
    texts = {part: xml.encode() for part, xml in (fixed or {}).items()}
    same: list[tuple[bytes, bytes, bytes]] = []

    def zipped(parts):
        if parts is None:
            return [(None,)]
        if len(same) < len(texts):
            same[:] = [_entry(*x) for x in texts.items()]
        own = sorted((p for p in parts if p), key=lambda p: (p["part"] != "mimetype", p["ord"]))
        if len(own) + len(same) >= 0xFFFF:
            raise ValueError("too many parts for a package")
        return [(_zipped([*(_shared_entry(p["part"], p["bytes"] or b"") for p in own), *same]),)]

    return mapped_rows(packed, ["parts"], "bytes binary", zipped)


def zip_package(parts: DataFrame) -> DataFrame:
    """doc_id, bytes of packages made of parts (doc_id, ord, part, bytes)."""
    return zip_parts(parts.groupBy("doc_id").agg(F.collect_list(F.struct("ord", "part", "bytes")).alias("parts")))


def write_packages(df: DataFrame, folder: str, ext: str) -> None:
    """One file for each row (doc_id, bytes), named by its id, in a folder that all executors reach."""

    def write(rows):
        import pyarrow.fs as fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        for row in rows:
            with store.open_output_stream(f"{base}/{row['doc_id']}.{ext}") as f:
                f.write(bytes(row["bytes"]))

    df.where("bytes IS NOT NULL").select("doc_id", "bytes").foreachPartition(write)


def union_ir(*tables: DataFrame) -> DataFrame:
    """Tables of one kind from several readers; columns that one lacks are null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out

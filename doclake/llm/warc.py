"""WARC archives: written by Spark tasks, read back by a sequential reader.

Every record is a gzip member of its own. The reader goes through an archive from its first byte: members are inflated
piece by piece, a record's header ends at an empty line, its block is as long as Content-Length says, and its digests are
computed while the bytes pass, so a worker holds a few pieces and, only where they are asked for, one payload.

Archives are a data source of Spark. A write task makes archives of names of its own, rolled at `archive_bytes`; they
count only when the job's commit has listed them, so tasks that fail, run twice or are lost leave nothing that a reader
sees, and what they left is deleted. A reading task gets one archive.

A record is a `response` (an HTTP head and the payload) or a `revisit` (the head alone, which tells the payload's length;
digest and record id of the response are in the record's header).

Defined results: a null payload counts as empty; equal payloads of MIN_REVISIT bytes or more are told by SHA-256; the rows
of the smallest page_id are responses, all of them if rows repeat, so that no record refers to itself; rows without an id
revisit a response with one, and are responses where there is none; equal rows have equal record ids; a null url has no
target line; a url with control signs or outer spaces goes escaped, with its bytes in a line of their own; an empty table
gives an empty folder of archives, which reads as no rows; other columns are left out. A damaged record is a row with an
`error`, and reading goes on at the next member that begins a record.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from doclake.llm.common import removed, scratch, stored

#: Payloads of so many bytes may be revisits.
MIN_REVISIT = 100
#: Where an archive is closed and the next one begun.
ARCHIVE_BYTES = 64 << 20
#: Bytes that are read, inflated or kept at once.
PIECE = 1 << 16
#: The longest header of a record or of HTTP.
HEADER = 1 << 20
#: Digests of payloads that occur more than once are broadcast up to so many.
FEW_DIGESTS = 200_000
#: Pages have no date.
DATE = "1970-01-01T00:00:00Z"
LISTING = "_archives"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 4122

READ = (
    "archive string, offset long, record_type string, record_id string, target_uri string, page_id string, payload_bytes long, "
    "payload_digest string, refers_to_record string, payload binary, error string"
)


class Damaged(ValueError):
    pass


def record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'page:{page_id}:{digest}')}>"


def _target(url: str | None) -> list[tuple[str, str]]:
    if url is None:
        return []
    plain = re.sub(r"[\x00-\x1f\x7f]|^ | $", lambda m: f"%{ord(m[0]):02X}", url)
    out = [("WARC-Target-URI", plain)]
    if plain != url or not url:
        out.append(("X-Target-URI-Base64", base64.b64encode(url.encode("utf-8", "surrogatepass")).decode()))
    return out


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to: str | None = None) -> bytes:
    """One WARC record, not packed. refers_to: the record id of the response that holds the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to else head + payload
    lines = [("WARC-Type", "revisit" if refers_to else "response"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", DATE), *_target(url)]
    if page_id is not None:
        lines.append(("X-Page-ID", str(page_id)))
    if refers_to:
        lines += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", refers_to)]
    lines += [
        ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


class Members:
    """The gzip members of a stream, one after the other, each inflated as it is asked for."""

    def __init__(self, stream, piece: int = PIECE):
        self.stream, self.piece = stream, piece
        self.rest, self.at = b"", 0  # bytes read and not yet used, and where they begin
        self.inflater = None

    def _more(self) -> bool:
        data = self.stream.read(self.piece)
        self.rest += data
        return bool(data)

    def begin(self) -> bool:
        """At the start of a member; False at the end of the stream."""
        if not self.rest and not self._more():
            return False
        self.inflater = zlib.decompressobj(wbits=31)
        return True

    def inflated(self) -> bytes:
        """The next bytes of the member, `piece` at most; none at its end."""
        while not self.inflater.eof:
            held = len(self.rest)
            try:
                out = self.inflater.decompress(self.rest, self.piece)
            except zlib.error as e:
                raise Damaged(str(e)) from None
            self.rest = self.inflater.unused_data if self.inflater.eof else self.inflater.unconsumed_tail
            self.at += held - len(self.rest)
            if out:  # also of an input that was used up before, so this comes before any more is read
                return out
            if not self.inflater.eof and not self.rest and not self._more():
                raise Damaged("archive ends inside a member")
        return b""

    def resume(self, start: int) -> bool:
        """After damage: at the next place behind `start` where a member begins that holds a record."""
        self.stream.seek(start + 1)
        self.rest, self.at = b"", start + 1
        while True:
            found = self.rest.find(b"\x1f\x8b\x08")
            if found < 0:
                cut = max(0, len(self.rest) - 2)
                self.rest, self.at = self.rest[cut:], self.at + cut
                if not self._more():
                    return False
                continue
            self.rest, self.at = self.rest[found:], self.at + found
            while len(self.rest) < 512 and self._more():
                pass
            try:
                if zlib.decompressobj(wbits=31).decompress(self.rest, 5) == b"WARC/":
                    return True
            except zlib.error:
                pass
            self.rest, self.at = self.rest[1:], self.at + 1


class Framed:
    """The bytes of one member: lines up to an empty one, then as many as are asked for."""

    def __init__(self, members: Members):
        self.members, self.held = members, b""

    def header(self, most: int | None = None) -> bytes:
        """The bytes up to an empty line, which is used too; of `most` bytes at most."""
        most = HEADER if most is None else min(most, HEADER)
        while (end := self.held.find(b"\r\n\r\n")) < 0:
            if len(self.held) >= most or not (more := self.members.inflated()):
                raise Damaged("header without end")
            self.held += more
        if end + 4 > most:
            raise Damaged("header without end")
        out, self.held = self.held[:end], self.held[end + 4 :]
        return out

    def take(self, n: int):
        """Pieces of the next n bytes."""
        while n:
            if not self.held:
                self.held = self.members.inflated()
                if not self.held:
                    raise Damaged(f"block ends {n} bytes early")
            out, self.held = self.held[:n], self.held[n:]
            n -= len(out)
            yield out

    def end(self) -> None:
        """The two line ends behind a block, and nothing more."""
        if b"".join(self.take(4)) != b"\r\n\r\n" or self.held or self.members.inflated():
            raise Damaged("block is longer than Content-Length")


def _fields(header: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip(" \t") for k, _, v in (line.partition(":") for line in header.decode("utf-8", "surrogatepass").split("\r\n")[1:])}


def _length(fields: dict[str, str]) -> int:
    told = fields.get("content-length", "")
    if not re.fullmatch(r"[0-9]{1,18}", told):
        raise Damaged("no Content-Length")
    return int(told)


def _read_record(members: Members, payload: bool) -> dict:
    framed = Framed(members)
    header = framed.header()
    if not header.startswith(b"WARC/"):
        raise Damaged("no WARC record")
    own = _fields(header)
    left, whole, kept, size = _length(own), hashlib.sha256(), [], 0
    kind = own.get("warc-type")
    out = {"record_type": kind, "record_id": own.get("warc-record-id"), "page_id": own.get("x-page-id"), "target_uri": own.get("warc-target-uri")}
    if "x-target-uri-base64" in own:
        out["target_uri"] = base64.b64decode(own["x-target-uri-base64"]).decode("utf-8", "surrogatepass")
    http = {}
    if own.get("content-type", "").startswith("application/http"):
        head = framed.header(left)
        whole.update(head + b"\r\n\r\n")
        left -= len(head) + 4
        http = _fields(head)
    body = hashlib.sha256()
    for piece in framed.take(left):
        whole.update(piece)
        body.update(piece)
        size += len(piece)
        if payload:
            kept.append(piece)
    framed.end()
    told = {k: own.get(f"warc-{k}-digest", "").removeprefix("sha256:") for k in ("block", "payload")}
    if told["block"] and told["block"] != whole.hexdigest():
        raise Damaged("block differs from its digest")
    if kind == "revisit":
        return out | {"payload_bytes": _length(http), "payload_digest": told["payload"] or None, "refers_to_record": own.get("warc-refers-to")}
    if told["payload"] and told["payload"] != body.hexdigest():
        raise Damaged("payload differs from its digest")
    if http and size != _length(http):
        raise Damaged("payload is not as long as HTTP says")
    return out | {"payload_bytes": size, "payload_digest": body.hexdigest(), "payload": b"".join(kept) if payload else None}


def read_records(stream, payload: bool = True):
    """(offset, fields) of each record of an archive; a damaged one has the field `error` and no others."""
    members = Members(stream)
    while members.begin():
        start = members.at
        try:
            yield start, _read_record(members, payload)
        except (Damaged, UnicodeDecodeError, ValueError) as e:
            yield start, {"error": f"{type(e).__name__}: {e}"}
            if not members.resume(start):
                return


def _store(path: str):
    import pyarrow.fs as fs

    return fs.FileSystem.from_uri(path)


class Archive(InputPartition):
    pass


class Reader(DataSourceReader):
    def __init__(self, path: str, payload: bool):
        self.path, self.payload = path, payload

    def partitions(self) -> list[Archive]:
        store, base = _store(self.path)
        with store.open_input_stream(f"{base}/{LISTING}") as f:
            return [Archive(x) for x in f.read().decode().split("\n") if x]

    def read(self, partition: Archive):
        import pyarrow as pa

        if partition is None or not partition.value:  # Spark asks so where there is no archive
            return
        store, base = _store(self.path)
        types = {"offset": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}
        names = [c.split()[0] for c in READ.split(", ")]
        schema = pa.schema([(n, types.get(n, pa.string())) for n in names])
        held, size = [], 0
        with store.open_input_file(f"{base}/{partition.value}") as f:
            for offset, own in read_records(f, self.payload):
                held.append({"archive": partition.value, "offset": offset} | own)
                size += 500 + len(own.get("payload") or b"")
                if size > 4 << 20:
                    yield pa.RecordBatch.from_pylist(held, schema)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)


class Written(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class Writer(DataSourceArrowWriter):
    """Rows (page_id string, url string, payload binary, digest string, first string) as archives."""

    def __init__(self, path: str, archive_bytes: int):
        self.path, self.archive_bytes = path, archive_bytes

    def write(self, iterator) -> Written:
        store, base = _store(self.path)
        store.create_dir(base, recursive=True)
        mine, names, out, size = uuid.uuid4().hex, [], None, 0
        try:
            for batch in iterator:
                for i in range(batch.num_rows):  # one payload at a time as a Python value
                    page, url, payload, digest, first = (batch.column(c)[i].as_py() for c in ("page_id", "url", "payload", "digest", "first"))
                    if out is None:
                        names.append(f"{mine}-{len(names):05d}.warc.gz")
                        out, size = store.open_output_stream(f"{base}/{names[-1]}", compression=None), 0
                    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                    data = packer.compress(record(page, url, payload or b"", digest, first and record_id(first, digest))) + packer.flush()
                    out.write(data)
                    size += len(data)
                    if size >= self.archive_bytes:
                        out.close()
                        out = None
        except BaseException:
            if out is not None:
                out.close()
            for name in names:
                store.delete_file(f"{base}/{name}")
            raise
        if out is not None:
            out.close()
        return Written(names)

    def _only(self, names: set[str]) -> None:
        """Deletes the archives that are not among `names`."""
        import pyarrow.fs as fs

        store, base = _store(self.path)
        for found in store.get_file_info(fs.FileSelector(base, allow_not_found=True)):
            if found.base_name.endswith(".warc.gz") and found.base_name not in names:
                store.delete_file(found.path)

    def commit(self, messages: list[Written | None]) -> None:
        names = sorted(n for m in messages if m for n in m.names)
        store, base = _store(self.path)
        store.create_dir(base, recursive=True)
        with store.open_output_stream(f"{base}/{LISTING}", compression=None) as f:
            f.write("".join(f"{n}\n" for n in names).encode())
        self._only(set(names))

    def abort(self, messages: list[Written | None]) -> None:
        self._only(set())


class Warc(DataSource):
    """format("doclake_warc"), of a folder `path`; options archive_bytes (writing) and payload (reading, default true)."""

    @classmethod
    def name(cls) -> str:
        return "doclake_warc"

    def schema(self) -> str:
        return READ

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], self.options.get("payload", "true").lower() == "true")

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"], int(self.options.get("archive_bytes", ARCHIVE_BYTES)))


def marked(pages: DataFrame, path: str, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, payload, digest, and first: the page_id of the response that a row revisits, else null.

    Payloads are not shuffled: digests and ids are, and only digests that occur with two ids find their rows again.
    """
    own = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha2("payload", 256))
    groups = own.where(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"), F.count("*").alias("rows"), F.count("page_id").alias("ids"))
    shared = stored(groups.where("first <> last OR ids BETWEEN 1 AND rows - 1").select("digest", "first"), f"{path}/shared")
    if shared.count() <= FEW_DIGESTS:
        shared = F.broadcast(shared)  # of a checked size
    revisits = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return own.join(shared, "digest", "left").select("page_id", "url", "payload", "digest", revisits.alias("first"))


def write_warc(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Pages (page_id, url, html) as archives in `folder`, which all executors reach."""
    spark, path = pages.sparkSession, scratch(pages.sparkSession)
    spark.dataSource.register(Warc)
    text = lambda c: F.col(c).cast("string").alias(c)
    rows = marked(pages, path).select(text("page_id"), text("url"), "payload", "digest", text("first"))
    rows.write.format("doclake_warc").option("archive_bytes", str(archive_bytes)).mode("append").save(folder)
    removed(spark, path)


def read_warc(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    """READ's columns of every record in a folder of archives; without payloads if they are not asked for."""
    spark.dataSource.register(Warc)
    return spark.read.format("doclake_warc").option("payload", str(payload).lower()).load(folder)


def pages_of(records: DataFrame, id_type: str = "bigint") -> DataFrame:
    """page_id, target_uri, payload_bytes, payload_digest, record_type, refers_to (the response's page_id) of records, a written table.

    A revisit finds its response by the record id, and has to agree with it in length and digest: else its row has no
    refers_to but an error, as have damaged records.
    """
    own = records.select("page_id", "target_uri", "payload_bytes", "payload_digest", "record_type", "record_id", "refers_to_record", "error")
    held = own.where("record_type = 'response' AND page_id IS NOT NULL").groupBy(F.col("record_id").alias("refers_to_record")).agg(
        F.min("page_id").alias("refers_to"), F.min("payload_bytes").alias("held_bytes"), F.min("payload_digest").alias("held_digest"))
    wanted = own.where("refers_to_record IS NOT NULL").select("refers_to_record").distinct()
    out = own.join(held.join(wanted, "refers_to_record", "left_semi"), "refers_to_record", "left")
    agree = F.expr("payload_bytes = held_bytes AND payload_digest = held_digest")
    wrong = F.when(F.col("record_type") == "revisit", F.when(~F.coalesce(agree, F.lit(False)), F.lit("no response of this payload")))
    return out.select(
        F.col("page_id").cast(id_type).alias("page_id"), "target_uri", "payload_bytes", "payload_digest", "record_type",
        F.when(agree, F.col("refers_to").cast(id_type)).alias("refers_to"), F.coalesce("error", wrong).alias("error"),
    )


def round_trip(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """What the archives of all pages tell when they are read back; the archives themselves are deleted."""
    spark, path = pages.sparkSession, scratch(pages.sparkSession)
    write_warc(pages, f"{path}/archives", archive_bytes)
    records = stored(read_warc(spark, f"{path}/archives", payload=False), f"{path}/records")
    out = pages_of(records, pages.schema["page_id"].dataType.simpleString())
    out = stored(out, f"{path}/pages")
    removed(spark, f"{path}/archives")
    return out


ORACLE = """
WITH own AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
told AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM own)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first AND first IS NOT NULL THEN first END AS refers_to
FROM told
"""

"""WARC archives as a Spark data source.

``spark.read.format("warc").load(folder)`` plans one partition per file and takes equality and IN predicates on the
record type and the header columns.  A task reads the header block of a record first; only a record that passes the
predicates has its payload decoded, any other is inflated past (or, in an archive that isn't compressed, jumped over).
Archives of other writers are read as well: the payload of an HTTP response or request is its body, that of a revisit
is null, and that of any other record its whole block; an archive that ends inside a record is an error.
``df.write.format("warc").save(folder)`` writes one archive per task, each record a gzip member of its own; archives
get their final names when the job commits, so tasks that are tried again leave nothing behind.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, In, InputPartition, WriterCommitMessage

from boardsift.llm.common import arrow_batches, numbered, scratch_path, staged, with_groups

#: What a revisit record claims to be.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

#: Bytes read, and inflated, at once.
READ, INFLATED = 1 << 18, 1 << 20

_COLUMNS = [("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("refers_to_record", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())]
SCHEMA = "record_id string, record_type string, target_uri string, page_id long, refers_to long, refers_to_record string, payload_digest string, payload_bytes long, payload binary"
_SCHEMA = pa.schema(_COLUMNS)
_PUSHED = {"record_id", "record_type", "target_uri", "page_id", "refers_to", "refers_to_record", "payload_digest"}


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _safe(value: str) -> str:
    """A header value without characters that would end it: controls and % as %XX."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 or c == "%" else c for c in value)


def _unsafe(value: str) -> str:
    parts = value.split("%")
    return parts[0] + "".join(chr(int(p[:2], 16)) + p[2:] for p in parts[1:])


def record_urn(archive: str, row: int) -> str:
    """The record id of a row of one archiving, the same wherever it is asked for."""
    return f"<urn:uuid:{uuid.uuid5(uuid.UUID(archive), str(row))}>"


def record(record_id: str, page_id: int | None, url: str | None, payload: bytes, revisits: tuple[str, int | None] | None = None) -> bytes:
    """One WARC/1.1 record; a revisit (of a record id and its page) has the headers of its payload but not the payload."""
    body = HTTP_HEAD + (b"" if revisits else payload)
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisits else 'response'}", f"WARC-Record-ID: {record_id}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_safe(url)}")
        if _safe(url) != url:
            lines.append("X-Target-URI-Escaped: percent")
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if revisits:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {revisits[0]}"]
        if revisits[1] is not None:
            lines.append(f"X-Refers-To-Page: {revisits[1]}")
    lines += [f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def info_record() -> bytes:
    """What an archive starts with."""
    body = b"format: WARC File Format 1.1\r\n"
    lines = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", "WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: application/warc-fields", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class _Bytes:
    """Reads of an archive, inflated if it is compressed, a bounded piece at a time."""

    def __init__(self, source, compressed: bool):
        self.source, self.compressed = source, compressed
        self.buffer, self.inflate, self.waiting = bytearray(), zlib.decompressobj(31) if compressed else None, b""
        self.ended = self.inside = False  # of the archive; of a compressed member

    def _more(self) -> bool:
        if self.ended:
            return False
        data = self.waiting or self.source.read(READ)
        if not data:
            if self.inside:
                raise ValueError("an archive ends inside a compressed member")
            self.ended = True
            return False
        if not self.compressed:
            self.buffer += data
            return True
        self.buffer += self.inflate.decompress(data, INFLATED)
        self.waiting, self.inside = self.inflate.unconsumed_tail, True
        if self.inflate.eof:
            self.waiting, self.inflate, self.inside = self.inflate.unused_data, zlib.decompressobj(31), False
        return True

    def until(self, mark: bytes) -> bytes | None:
        """What stands before the mark, without line ends before it; None at the end of the archive."""
        at = -1
        while at < 0:
            start = len(self.buffer) - len(self.buffer.lstrip(b"\r\n"))
            del self.buffer[:start]
            if (at := self.buffer.find(mark)) < 0 and not self._more():
                if self.buffer:
                    raise ValueError("an archive ends inside a header")
                return None
        found = bytes(self.buffer[:at])
        del self.buffer[: at + len(mark)]
        return found

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n and self._more():
            pass
        found = bytes(self.buffer[:n])
        del self.buffer[:n]
        if len(found) < n:
            raise ValueError("an archive ends inside a record")
        return found

    def skip(self, n: int) -> None:
        if not self.compressed and n > len(self.buffer):
            # the last byte is read, as one may seek beyond the end
            self.source.seek(n - len(self.buffer) - 1, 1)
            self.buffer.clear()
            n = 1
        while n:
            if not self.buffer and not self._more():
                raise ValueError("an archive ends inside a record")
            step = min(n, len(self.buffer))
            del self.buffer[:step]
            n -= step


def _number(value: str | None) -> int | None:
    try:
        return int(value) if value is not None else None
    except ValueError:  # another writer's header of this name
        return None


def _headers(head: bytes) -> dict[str, str]:
    """Header values by lower-cased name; a line that starts with white space goes on with the one before."""
    try:
        text = head.decode()
    except UnicodeDecodeError:
        text = head.decode("latin-1")
    lines: list[str] = []
    for line in text.split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and lines:
            lines[-1] += " " + line.strip()
        else:
            lines.append(line)
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def read_records(source, compressed: bool, wanted: dict[str, set], with_payload: bool, verify: bool) -> Iterator[dict]:
    """The records whose headers have the wanted values.  ``verify`` checks payloads against SHA-1 digests and the
    length that the writer here puts down."""
    stream = _Bytes(source, compressed)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        header = _headers(head)
        size, kind, uri, digest = int(header["content-length"]), header.get("warc-type"), header.get("warc-target-uri"), header.get("warc-payload-digest")
        out = {
            "record_id": header.get("warc-record-id"),
            "record_type": kind,
            "target_uri": _unsafe(uri) if uri is not None and "x-target-uri-escaped" in header else uri,
            "page_id": _number(header.get("x-page-id")),
            "refers_to": _number(header.get("x-refers-to-page")),
            "refers_to_record": header.get("warc-refers-to"),
            "payload_digest": digest.removeprefix("sha1:") if digest else None,
            "payload_bytes": _number(header.get("x-payload-length")),
            "payload": None,
        }
        if any(out[k] not in values for k, values in wanted.items()):
            stream.skip(size + 4)
            continue
        http = header.get("content-type", "").replace(" ", "").lower().startswith("application/http")
        if kind != "revisit" and out["payload_bytes"] is None and not http:
            out["payload_bytes"] = size
        if kind != "revisit" and (with_payload or verify):
            payload = stream.take(size)
            if http:
                payload = payload.partition(b"\r\n\r\n")[2]
            stream.skip(4)
            if verify and ((digest or "").startswith("sha1:") and base32_sha1(payload) != out["payload_digest"].upper() or out["payload_bytes"] not in (None, len(payload))):
                raise ValueError(f"record {out['record_id']} doesn't hold the payload of its digest")
            out["payload_bytes"] = len(payload)
            if with_payload:
                out["payload"] = payload
        else:
            stream.skip(size + 4)
        yield out


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.with_payload = options.get("payload", "true") == "true"
        self.verify = options.get("verify", "false") == "true"
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo | EqualNullSafe | In) and len(f.attribute) == 1 and f.attribute[0] in _PUSHED:
                values = set(f.value) if isinstance(f, In) else {f.value}
                if not isinstance(f, EqualNullSafe):
                    values -= {None}
                name = f.attribute[0]
                self.wanted[name] = values & self.wanted.get(name, values)
            else:
                yield f

    def partitions(self):
        files, path = _open(self.path)
        found = sorted(x.path for x in files.get_file_info(fs.FileSelector(path)) if x.path.endswith((".warc", ".warc.gz")))
        return [InputPartition(x) for x in found]

    def read(self, partition):
        if partition is None or partition.value is None:  # no archive at all
            return
        files, _ = _open(self.path)
        with files.open_input_file(partition.value) as source:
            rows, size = [], 0
            for row in read_records(source, partition.value.endswith(".gz"), self.wanted, self.with_payload, self.verify):
                rows.append(row)
                size += len(row["payload"] or b"")
                if len(rows) >= 4000 or size > 16 << 20:
                    yield pa.RecordBatch.from_pylist(rows, _SCHEMA)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _SCHEMA)


_WRITTEN = ["row", "page_id", "url", "html", "refers_to", "refers_row"]


class WarcWriter(DataSourceArrowWriter):
    """Rows of :func:`with_revisits`."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.archive = str(uuid.uuid4())  # of all tasks of one job
        self.level = int(options.get("level", "6"))
        self.suffix = ".warc" if options.get("compression") == "none" else ".warc.gz"

    def write(self, iterator):
        files, path = _open(self.path)
        files.create_dir(f"{path}/_writing", recursive=True)
        name = f"part-{uuid.uuid4().hex}{self.suffix}"
        empty = True

        def packed(data: bytes) -> bytes:
            if self.suffix == ".warc":
                return data
            press = zlib.compressobj(self.level, zlib.DEFLATED, 31)
            return press.compress(data) + press.flush()

        with files.open_output_stream(f"{path}/_writing/{name}", compression=None) as out:
            for batch in iterator:
                for row in batch.select(_WRITTEN).to_pylist():
                    if empty:
                        out.write(packed(info_record()))
                    empty = False
                    revisits = None if row["refers_row"] is None else (record_urn(self.archive, row["refers_row"]), row["refers_to"])
                    out.write(packed(record(record_urn(self.archive, row["row"]), row["page_id"], row["url"], (row["html"] or "").encode(), revisits)))
        message = WriterCommitMessage()
        message.name = None if empty else name
        return message

    def commit(self, messages):
        files, path = _open(self.path)
        files.create_dir(path, recursive=True)
        for message in messages:
            if message is not None and message.name:
                files.move(f"{path}/_writing/{message.name}", f"{path}/{message.name}")
        self._clear()

    def abort(self, messages):
        self._clear()

    def _clear(self):
        files, path = _open(self.path)
        if files.get_file_info(f"{path}/_writing").type != fs.FileType.NotFound:
            files.delete_dir(f"{path}/_writing")


class WarcDataSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """row (a row number), page_id, url, html, refers_to, refers_row: of pages whose payloads are equal and at least
    ``min_bytes`` long, the one with the largest page_id (null smallest; of repeated rows the first) keeps its payload,
    the rest refer to its page_id and row, which are null for all others."""
    source, _ = numbered(pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html")))
    payload = F.coalesce("html", F.lit(""))
    keys = source.select("row", F.col("page_id").alias("id"), F.sha1(payload.cast("binary")).alias("sha"), F.octet_length(payload).alias("size")).where(F.col("size") >= min_bytes)
    best = keys.groupBy("sha").agg(F.max(F.struct(F.col("id"), (-F.col("row")).alias("back"))).alias("best"), F.count("*").alias("n")).where("n > 1")
    best = staged(best.select("sha", F.col("best.id").alias("refers_to"), (-F.col("best.back")).alias("refers_row"), "n"), "payloads")
    revisits = staged(with_groups(keys.select("row", "sha"), best, "sha", "n").where("row <> refers_row").select("row", "refers_to", "refers_row"), "revisits")
    return source.join(revisits, "row", "left").select(*_WRITTEN)


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, level: int = 6) -> None:
    """Write every row of ``pages`` (page_id, url, html, ...) as a WARC record.  A null html is an empty payload, a
    null url or page_id leaves out its header, repeated rows are records of their own, other columns are ignored, an
    empty table writes no archive."""
    register(pages.sparkSession)
    arrow_batches(pages)
    with_revisits(pages, min_bytes).write.format("warc").mode("append").option("level", level).save(path)


def read_archives(spark: SparkSession, path: str, payload: bool = True, verify: bool = False) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).option("verify", str(verify).lower()).load(path)


def archive_round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write all pages and read their records back, each payload checked against its digest: page_id, payload_bytes,
    payload_digest, record_type, refers_to.  The record types are pushed to the reader, which skips the archives' own
    records.  Null, repeated and long pages are handled as by :func:`write_archives`; an empty table gives an empty
    result."""
    path = scratch_path(pages.sparkSession, "warc")
    write_archives(pages, path, min_bytes)
    found = read_archives(pages.sparkSession, path, payload=False, verify=True).where(F.col("record_type").isin("response", "revisit"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

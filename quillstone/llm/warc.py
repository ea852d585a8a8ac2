"""WARC as a PySpark data source.

Reading plans a partition for each archive, takes record-type and header predicates into the scan, parses headers first, and steps
over payloads that the predicates or the columns do not want without decoding them. Writing is a sink of the same format: each task
writes one archive under a temporary name, and only committed ones are renamed. Paths go through pyarrow's file systems, or the
machine's own for plain paths.
"""

from __future__ import annotations

import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from ._scratch import new_path

#: Column, header and type. What has no header comes from the payload.
HEADERS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To", "full_length": "X-Full-Payload-Length"}
SCHEMA = "record_id string, record_type string, target_uri string, date string, payload_digest string, refers_to string, full_length long, content_length long, payload binary"
WRITTEN = "record_id string, record_type string, target_uri string, date string, payload_digest string, refers_to string, full_length long, payload binary"


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        if path.startswith("file:"):
            return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def _header(value: object) -> str:
    """A header's value on one line: controls and % are escaped."""
    return "".join(c if c >= " " and c not in "%\x7f\x85  " else "".join(f"%{b:02X}" for b in c.encode()) for c in str(value))


def _unheader(value: str) -> str:
    """What ``_header`` escaped; only called for records that say so."""
    if "%" not in value:
        return value
    raw, out, i = value.encode(), bytearray(), 0
    while i < len(raw):
        if raw[i] == 37:
            out.append(int(raw[i + 1 : i + 3], 16))
            i += 3
        else:
            out.append(raw[i])
            i += 1
    return out.decode()


#: Marks records whose header values are escaped; others are read as they stand.
ESCAPED = "X-Escaped-Headers"


def record(fields: dict, payload: bytes) -> bytes:
    """A record's bytes. Values that would not stand on a line are escaped, and the record says so."""
    lines, escaped = [b"WARC/1.1"], False
    for column, header in HEADERS.items():
        if fields.get(column) is not None:
            escaped |= _header(fields[column]) != str(fields[column])
    if escaped:
        lines.append(f"{ESCAPED}: 1".encode())
    for column, header in HEADERS.items():
        if fields.get(column) is not None:
            lines.append(f"{header}: {_header(fields[column]) if escaped else fields[column]}".encode())
    lines.append(f"Content-Length: {len(payload)}".encode())
    return b"\r\n".join(lines) + b"\r\n\r\n" + payload + b"\r\n\r\n"


def records(f, wanted, payload: bool) -> Iterator[tuple[dict, bytes | None]]:
    """(headers, payload) of the records of a file that ``wanted`` accepts; other payloads are stepped over."""
    while line := f.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {f.tell() - len(line)}")
        headers = {}
        while (line := f.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        if ESCAPED.lower() in headers:
            headers = {k: _unheader(v) for k, v in headers.items()}
        size = int(headers["content-length"])
        if not wanted(headers):
            f.seek(size, 1)
        elif payload:
            body = f.read(size)
            if len(body) != size:
                raise ValueError("the archive ends within a record")
            yield headers, body
        else:
            f.seek(size, 1)
            yield headers, None


@dataclass
class _Archive(InputPartition):
    path: str


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names, self.options, self.tests = schema.names, options, []

    def pushFilters(self, filters: list[Filter]):
        """Takes equality, membership, prefix and presence tests of header columns; the rest stays with Spark."""
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In, StringStartsWith, IsNotNull)) and len(f.attribute) == 1 else None
            header = HEADERS.get(column)
            if header is None or column == "full_length":
                yield f
            elif isinstance(f, IsNotNull):
                self.tests.append((header.lower(), "there", None))
            elif isinstance(f, StringStartsWith):
                self.tests.append((header.lower(), "starts", f.value))
            else:
                self.tests.append((header.lower(), "in", {f.value} if isinstance(f, EqualTo) else set(f.value)))

    def partitions(self):
        fs, path = filesystem(self.options["path"])
        if fs.get_file_info(path).type == pafs.FileType.File:
            return [_Archive(path)]
        found = [x.path for x in fs.get_file_info(pafs.FileSelector(path, recursive=True)) if x.path.endswith((".warc", ".warc.gz"))]
        return [_Archive(x) for x in sorted(found)] or [_Archive("")]

    def _wanted(self, headers: dict) -> bool:
        for name, kind, value in self.tests:
            have = headers.get(name)
            if have is None or kind == "in" and have not in value or kind == "starts" and not have.startswith(value):
                return False
        return True

    def read(self, partition):
        if not partition.path:
            return
        fs, _ = filesystem(self.options["path"])
        names, payload = self.names, self.options.get("payload", "true").lower() == "true"
        schema = pa.schema([(n, pa.binary() if n == "payload" else pa.int64() if n.endswith("length") else pa.string()) for n in names])

        def value(n: str, h: dict, body: bytes | None):
            if n == "payload":
                return body
            x = h.get("content-length") if n == "content_length" else h.get(HEADERS[n].lower())
            return int(x) if x is not None and n.endswith("length") else x

        rows, size = [], 0
        with fs.open_input_file(partition.path) as raw:
            for headers, body in records(_Inflated(raw) if partition.path.endswith(".gz") else _Buffered(raw), self._wanted, payload and "payload" in names):
                rows.append(tuple(value(n, headers, body) for n in names))
                size += 500 + len(body or b"")
                if size > 8 << 20:
                    yield _batch(rows, schema)
                    rows, size = [], 0
        if rows:
            yield _batch(rows, schema)


class _Buffered:
    """Lines and runs of bytes from a random-access file; seeking past the buffer reads nothing."""

    def __init__(self, f, chunk: int = 1 << 20):
        self.f, self.chunk, self.held, self.at, self.base = f, chunk, b"", 0, 0

    def _read(self, place: int) -> bytes:
        self.f.seek(place)
        return self.f.read(self.chunk)

    def _more(self) -> bool:
        self.base += self.at
        self.held, self.at = self.held[self.at :], 0
        got = self._read(self.base + len(self.held))
        self.held += got
        return bool(got)

    def readline(self) -> bytes:
        while (end := self.held.find(b"\n", self.at)) < 0:
            if not self._more():
                end = len(self.held) - 1
                break
        out, self.at = self.held[self.at : end + 1], end + 1
        return out

    def read(self, n: int) -> bytes:
        while len(self.held) - self.at < n and self._more():
            pass
        out = self.held[self.at : self.at + n]
        self.at += len(out)
        return out

    def seek(self, n: int, whence: int) -> None:
        if self.at + n <= len(self.held):
            self.at += n
        else:
            self.base, self.held, self.at = self.base + self.at + n, b"", 0

    def tell(self) -> int:
        return self.base + self.at


class _Inflated(_Buffered):
    """The same over gzip members one after another. What is stepped over is inflated, but not kept."""

    def __init__(self, f, chunk: int = 1 << 20):
        super().__init__(f, chunk)
        self.raw, self.inflate, self.rest = 0, zlib.decompressobj(31), b""

    def _read(self, place: int) -> bytes:
        while True:
            if not self.rest:
                self.f.seek(self.raw)
                self.rest = self.f.read(self.chunk)
                self.raw += len(self.rest)
                if not self.rest:
                    return self.inflate.decompress(b"", self.chunk)
            got = self.inflate.decompress(self.rest, self.chunk)
            self.rest = self.inflate.unconsumed_tail
            if self.inflate.eof:
                self.rest, self.inflate = self.inflate.unused_data, zlib.decompressobj(31)
            if got:
                return got

    def seek(self, n: int, whence: int) -> None:
        while self.at + n > len(self.held):
            n -= len(self.held) - self.at
            self.at = len(self.held)
            if not self._more():
                return
        self.at += n


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), schema)], schema=schema)


@dataclass
class _Written(WriterCommitMessage):
    path: str | None


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.options = options

    def write(self, iterator):
        fs, path = filesystem(self.options["path"])
        fs.create_dir(path, recursive=True)
        name, out = posixpath.join(path, f"_{uuid.uuid4().hex}.tmp"), None
        packed = self.options.get("packed", "false").lower() == "true"
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if out is None:
                        out = fs.open_output_stream(name)
                    payload = row["payload"] or b""
                    out.write(record(row, zstandard.decompress(payload) if packed and payload else payload))
        finally:
            if out is not None:
                out.close()
        return _Written(name if out is not None else None)

    def commit(self, messages):
        fs, path = filesystem(self.options["path"])
        for m in messages:
            if m is not None and m.path:
                fs.move(m.path, posixpath.join(path, posixpath.basename(m.path)[1:-4] + ".warc"))

    def abort(self, messages):
        fs, _ = filesystem(self.options["path"])
        for m in messages:
            if m is not None and m.path:
                fs.delete_file(m.path)


class WarcDataSource(DataSource):
    """format("warc"): options path, payload=false to leave payloads null and unread, packed=true where those to write are zstandard
    frames."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=3).compress
    for big in batches:
        for i in range(0, big.num_rows, 256):
            b = big.slice(i, 256)
            raw = b.column(2).to_pylist()
            own, size = [hashlib.sha256(x).hexdigest() for x in raw], [len(x) for x in raw]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(own), pa.array(size, pa.int64()), pa.array([squeeze(x) for x in raw], pa.binary())], ["id", "url", "own", "full_length", "payload"])


def archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 100) -> None:
    """Writes each page as a record. Of pages with equal payloads of at least ``least`` bytes, the one with the smallest id is a
    response; the others revisit it and carry no payload. Null html is an empty payload; rows with a null id are responses with an
    empty id. Equal payloads are found by digest and least id, combined before the shuffle; payloads are compressed before they are shuffled, once."""
    register(pages.sparkSession)
    html = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    data = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), html.alias("payload"))
    slim = data.select("id", F.length("payload").alias("n"), F.sha2("payload", 256).alias("digest"))
    firsts = slim.filter(F.col("n") >= least).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("k")).filter("k > 1").select("digest", "first")
    packed = data.mapInArrow(_packed, "id long, url string, own string, full_length long, payload binary")
    joined = packed.join(firsts, (F.col("full_length") >= least) & (F.col("own") == F.col("digest")), "left")
    revisit = F.col("id") > F.col("first")
    joined.select(
        F.coalesce(F.col("id").cast("string"), F.lit("")).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.lit("2024-01-01T00:00:00Z").alias("date"),
        F.col("own").alias("payload_digest"),
        F.when(revisit, F.col("first").cast("string")).alias("refers_to"),
        "full_length",
        F.when(~F.coalesce(revisit, F.lit(False)), F.col("payload")).alias("payload"),
    ).write.format("warc").option("path", path).option("packed", "true").mode("append").save()


def archived(spark: SparkSession, path: str) -> DataFrame:
    """The archives' records: (page_id, payload_bytes, payload_digest, record_type, refers_to). For responses, size and digest are of
    the payload as read back, and a digest other than the header's raises an error; a revisit has both from its headers, which name
    those of the record it refers to. Digests may have the algorithm before them; only SHA-256 in hexadecimal is checked. An id that is
    no number reads as null; an archive without records gives no rows."""
    register(spark)
    r = spark.read.format("warc").option("path", path).load()
    own = F.col("record_type") == "response"
    said = F.lower(F.regexp_replace("payload_digest", "(?i)^sha-?256:", ""))
    digest = F.sha2("payload", 256)
    broken = F.rlike(said, F.lit("^[0-9a-f]{64}$")) & (said != digest)
    checked = F.when(broken, F.raise_error(F.concat(F.lit("payload of another digest: "), F.col("record_id"))).cast("string")).otherwise(digest)
    return r.select(
        F.expr("try_cast(record_id as long)").alias("page_id"),
        F.when(own, F.length("payload").cast("long")).otherwise(F.col("full_length")).alias("payload_bytes"),
        F.when(own, checked).otherwise(said).alias("payload_digest"),
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


def round_trip(pages: DataFrame, **names: str) -> DataFrame:
    """Writes the pages to archives in the shared folder and reads them back, a row for each page.

    Null html is an empty payload, and payloads of fewer than 100 bytes are all responses. Of repeated rows of a page whose payload another
    page with a smaller id has, all revisit that one; repeated rows of the page with the smallest id are all responses. A null id is
    a response, and reads back as null. An empty table gives no rows; other columns are not read."""
    path = new_path(pages.sparkSession, "warc")
    archive(pages, path, **names)
    return archived(pages.sparkSession, path)

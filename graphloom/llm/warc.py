"""WARC archives: writing, a normaliser for archives that are one gzip stream, and reading through an offset index.

Archives are files in a folder that driver and executors share.  A task writes or reads one archive at a time, as a stream,
under a name of its own, and returns a row for it: only archives with a row count, so files that a lost or repeated task left
behind are never read.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import slices, text_or_empty, written

CHUNK = 1 << 18
#: Window bits of zlib for gzip streams.
GZIP = 31
EMPTY_LINE = re.compile(rb"\r?\n\r?\n")
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


# --- records


def record_id(page: object, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(RECORDS, f'{page}:{digest}')}>"


def header_bytes(first: str, fields: list[tuple[str, str | None]]) -> bytes:
    """A header block; fields without a value are left out.  Values hold no line breaks: see ``uri``."""
    return "".join([first, "\r\n", *[f"{k}: {v}\r\n" for k, v in fields if v is not None], "\r\n"]).encode()


def uri(text: str | None) -> str:
    """A URL as header value: what isn't printable ASCII is escaped."""
    return quote(text, safe="".join(map(chr, range(33, 127)))) if text else "urn:none"


def page_record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """A response record, or a revisit record without the payload if ``refers_to`` is given."""
    # The header of the answer tells the payload's length in either kind.
    http = header_bytes("HTTP/1.1 200 OK", [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))])
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = header_bytes("WARC/1.1", [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page, digest)), ("WARC-Date", date), ("WARC-Target-URI", uri(url)),
        ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Profile", SAME_PAYLOAD if revisit else None), ("WARC-Refers-To", record_id(refers_to, digest) if revisit else None),
        ("Page-ID", None if page is None else str(page)), ("Refers-To-Page-ID", str(refers_to) if revisit else None),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ])
    return head + block + b"\r\n\r\n"


def fields_of(head: bytes) -> dict[str, str]:
    """The fields of a header block by lower-case name; folded lines are joined, of repeated fields the first counts."""
    out: dict[str, str] = {}
    for line in re.sub(rb"\r?\n[ \t]+", b" ", head).split(b"\n")[1:]:
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if colon:
            out.setdefault(name.strip().lower(), value.strip())
    return out


# --- streams


class Inflated:
    """The inflated bytes of a gzip file, read once from front to back: one stream or several after each other.

    At most a chunk of either side is held.  Zero bytes after a stream are padding; a stream that is cut raises EOFError, and
    other bytes between streams raise ValueError.
    """

    def __init__(self, source: BinaryIO):
        self.source, self.engine, self.input, self.buffer, self.ended = source, None, b"", bytearray(), False

    def _fill(self) -> bool:
        while not self.ended:
            if not self.input:
                self.input = self.source.read(CHUNK)
                if not self.input:
                    if self.engine:
                        raise EOFError("the archive ends within a gzip stream")
                    self.ended = True
                    return False
            if self.engine is None:
                self.input = self.input.lstrip(b"\0")
                if not self.input:
                    continue
                if self.input[0] != 0x1F:
                    raise ValueError("bytes between gzip streams")
                self.engine = zlib.decompressobj(GZIP)
            out = self.engine.decompress(self.input, CHUNK)
            if self.engine.eof:
                self.input, self.engine = self.engine.unused_data, None
            else:
                self.input = self.engine.unconsumed_tail
            if out:
                self.buffer += out
                return True
        return False

    def read(self, n: int) -> bytes:
        """Up to n bytes; fewer only if few are held, none at the end."""
        if not self.buffer and not self._fill():
            return b""
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out

    def head(self) -> bytes:
        """The bytes up to the empty line that ends a header, without line breaks before it; none at the end."""
        while True:
            while self.buffer[:1] in (b"\r", b"\n"):
                del self.buffer[:1]
            if self.buffer or not self._fill():
                break
        seen = 0
        while True:
            if found := EMPTY_LINE.search(self.buffer, max(0, seen - 3)):
                out = bytes(self.buffer[: found.end()])
                del self.buffer[: found.end()]
                return out
            seen = len(self.buffer)
            if not self._fill():
                if self.buffer:
                    raise EOFError("the archive ends within a header")
                return b""


class _Counted:
    def __init__(self, sink: BinaryIO):
        self.sink, self.place = sink, 0

    def write(self, data: bytes) -> None:
        self.sink.write(data)
        self.place += len(data)


def normalise_stream(source: BinaryIO, sink: BinaryIO, level: int = 6) -> Iterator[dict]:
    """Rewrite every record of a gzip archive as a gzip member of its own; yields the place and the named fields of each.

    The source is inflated once and a record passes through in chunks, so memory follows neither.  Line breaks between
    records are made the two that the format asks for.  A record without a valid Content-Length raises ValueError.
    """
    inflated, out = Inflated(source), _Counted(sink)
    while head := inflated.head():
        if not head.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {head[:40]!r}")
        fields = fields_of(head)
        if not fields.get("content-length", "").isdigit():
            raise ValueError("a record has no length")
        begin, left = out.place, int(fields["content-length"])
        member = zlib.compressobj(level, zlib.DEFLATED, GZIP)
        out.write(member.compress(head))
        while left:
            data = inflated.read(min(left, CHUNK))
            if not data:
                raise EOFError("the archive ends within a record")
            out.write(member.compress(data))
            left -= len(data)
        out.write(member.compress(b"\r\n\r\n") + member.flush())
        yield {"offset": begin, "length": out.place - begin, "type": fields.get("warc-type"), "id": fields.get("warc-record-id"), "uri": fields.get("warc-target-uri"), "date": fields.get("warc-date"), "digest": fields.get("warc-payload-digest")}


# --- Spark jobs


def page_decisions(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 100) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): of equal payloads of ``least_bytes`` or more, those with another than the
    smallest id refer to it; ``refers_to`` is null for responses."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), text_or_empty(html_col).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    groups = rows.where(F.octet_length("payload") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("_least"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select("digest", "_least")
    joined = rows.join(groups, "digest", "left")
    return joined.select("page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("_least")), F.col("_least")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", archive_bytes: int = 256 << 20, level: int = 6, **columns: str) -> DataFrame:
    """Write a record per row of ``pages`` into archives in ``folder``, each one gzip stream of up to about ``archive_bytes``
    before compression; a row (archive, records, bytes) for each.

    Null html is an empty payload, null URLs are ``urn:none``.  Of equal payloads of 100 bytes or more, rows with the smallest
    id are responses, the others revisit it; a null id is larger than any other.  Rows may repeat: each has its record.  An
    empty table writes no archive.  Other columns are not read.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _at(folder)
        system.create_dir(root, recursive=True)
        done: list[tuple[str, int, int]] = []
        sink = engine = None
        name, n, size, out = "", 0, 0, 0

        def close() -> None:
            nonlocal sink
            tail = engine.flush()
            sink.write(tail)
            sink.close()
            done.append((name, n, out + len(tail)))
            sink = None

        for batch in batches:
            for part in slices(batch):
                for page, payload, url, digest, refers_to in zip(*(c.to_pylist() for c in part.columns)):
                    if sink is None:
                        name, n, size, out = f"{uuid.uuid4().hex}.warc.gz", 0, 0, 0
                        sink, engine = system.open_output_stream(f"{root}/{name}", compression=None), zlib.compressobj(level, zlib.DEFLATED, GZIP)
                    record = page_record(page, url, payload, digest, refers_to, date)
                    data = engine.compress(record)
                    sink.write(data)
                    n, size, out = n + 1, size + len(record), out + len(data)
                    if size >= archive_bytes:
                        close()
        if sink is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64()))], ["archive", "records", "bytes"])

    rows = page_decisions(pages, **columns).select("page_id", "payload", "url", "digest", "refers_to")
    return written(rows.mapInArrow(write, "archive string, records long, bytes long"), "archives")


def normalise(archives: DataFrame, source: str, folder: str, level: int = 6) -> DataFrame:
    """Rewrite each of ``archives`` from folder ``source`` into ``folder``, a gzip member per record, with a sidecar index
    beside it: a line of JSON per record with offset, length, type, id, uri, date and digest.

    A row (source, archive, sidecar, records, bytes) for each.  An archive is one task's work, a stream in and a stream out.
    """

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (system, root), (target, out) = _at(source), _at(folder)
        target.create_dir(out, recursive=True)
        for batch in batches:
            for old in batch.column(0).to_pylist():
                name = f"{uuid.uuid4().hex}.warc.gz"
                n = 0
                with system.open_input_stream(f"{root}/{old}", compression=None) as stream, target.open_output_stream(f"{out}/{name}", compression=None) as sink, target.open_output_stream(f"{out}/{name}.index", compression=None) as index:
                    for n, entry in enumerate(normalise_stream(stream, sink, level), 1):
                        index.write(json.dumps(entry).encode() + b"\n")
                size = target.get_file_info(f"{out}/{name}").size
                yield pa.RecordBatch.from_pydict({"source": [old], "archive": [name], "sidecar": [f"{name}.index"], "records": pa.array([n], pa.int64()), "bytes": pa.array([size], pa.int64())})

    # Ranges of a given number are left as they are dealt, about an archive each; few rows would else be put into one task.
    dealt = archives.select("archive").repartitionByRange(max(1, archives.count()), "archive")
    return written(dealt.mapInArrow(rewrite, "source string, archive string, sidecar string, records long, bytes long"), "normalised")


INDEX = "offset long, length long, type string, id string, uri string, date string, digest string"


def read_index(spark: SparkSession, archives: DataFrame, folder: str) -> DataFrame:
    """The sidecars of ``archives`` in ``folder``, a row per record with its ``archive``."""
    if archives.isEmpty():
        return spark.createDataFrame([], f"archive string, {INDEX}")
    lines = spark.read.schema(INDEX).json(f"{folder}/*.index").withColumn("_file", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.index$", 1))
    return lines.withColumnRenamed("_file", "archive").join(archives.select("archive"), "archive", "left_semi")


def read_records(index: DataFrame, folder: str, stretch: int = 64 << 20) -> DataFrame:
    """Read the records of ``index`` from their places in the archives in ``folder``, each as a gzip member of its own.

    Columns: archive, offset, page_id, record_type, digest and payload_bytes as the record states them, refers_to, and
    payload (null for revisits).  Places are dealt out by range, at most about ``stretch`` compressed bytes to a task.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _at(folder)
        name, file = None, None
        whole = lambda x: int(x) if x is not None else None
        kinds = {"archive": pa.string(), "offset": pa.int64(), "page_id": pa.int64(), "record_type": pa.string(), "digest": pa.string(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}
        rows: list[tuple] = []
        size = 0

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds.values())], list(kinds))

        for batch in batches:
            for archive, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if archive != name:
                    if file:
                        file.close()
                    name, file = archive, system.open_input_file(f"{root}/{archive}")
                file.seek(offset)
                data = zlib.decompress(file.read(length), GZIP)
                head, _, rest = data.partition(b"\r\n\r\n")
                fields = fields_of(head)
                http, _, payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")
                revisit = fields["warc-type"] == "revisit"
                rows.append((archive, offset, whole(fields.get("page-id")), fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha256:"), int(fields_of(http)["content-length"]), whole(fields.get("refers-to-page-id")), None if revisit else payload))
                size += len(data)
                if size >= 8 << 20:
                    yield batch_of()
                    rows, size = [], 0
        if file:
            file.close()
        yield batch_of()

    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // stretch))
    dealt = index.select("archive", "offset", "length").repartitionByRange(tasks, "archive", "offset").sortWithinPartitions("archive", "offset")
    return dealt.mapInArrow(read, "archive string, offset long, page_id long, record_type string, digest string, payload_bytes long, refers_to long, payload binary")

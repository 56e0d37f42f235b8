"""WARC files: written from a table with their index, indexed where others wrote them, and read by coalesced byte ranges.

Files are series of gzip members, one per record. The index has offset, length,
URL and digest of every record; a writer knows them and gives them as it writes.
Reading takes any rows of an index: those of a file are sorted, and ranges that
lie close together are fetched in one read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexaxis.llm.common import column, numbered, scratch, settled

#: A file is closed when it has this many bytes; a read joins ranges at most GAP_BYTES apart, up to READ_BYTES.
FILE_BYTES = 1 << 30
GAP_BYTES = 64 << 10
READ_BYTES = 8 << 20
#: Part of a file that one task reads.
TASK_BYTES = 64 << 20

INDEX = "file string, offset long, length long, url string, digest string, page_id long"


def open_path(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def digest_of(body: bytes) -> str:
    return "sha256:" + hashlib.sha256(body).hexdigest()


def record(page_id: int | None, url: str | None, body: str | None, raw: bytes, digest: str) -> bytes:
    """One resource record of `body`, whose bytes are `raw`. A URL's control characters, spaces, % and non-ASCII bytes are escaped."""
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id} {url} {digest}")
    head = ["WARC/1.1", "WARC-Type: resource", f"WARC-Record-ID: <urn:uuid:{name}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: {digest}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(raw)}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="!#$&'()*+,/:;=?@[]~"))
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if body is None:
        head.append("X-Null-Payload: 1")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + raw + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(headers by lower-case name, block) of an uncompressed record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return headers, rest[: int(headers["content-length"])]


def payload(headers: dict[str, str], block: bytes) -> tuple[bytes, str]:
    """(body, its text) of a record's block; of an HTTP message, what follows its head. Bytes that the stated charset doesn't have become U+FFFD."""
    kind = headers.get("content-type", "")
    if kind.replace(" ", "").lower().startswith("application/http"):
        head, _, block = block.partition(b"\r\n\r\n")
        lines = (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])
        kind = {k.strip().lower(): v.strip() for k, _, v in lines}.get("content-type", "")
    named = re.search(r"charset=[\"']?([\w.:-]+)", kind, re.IGNORECASE)
    try:
        return block, block.decode(named[1] if named else "utf-8", "replace")
    except LookupError:  # a charset that isn't known
        return block, block.decode("utf-8", "replace")


def verified(digest: str | None, body: bytes) -> str:
    """The digest, after a check of it against `body`, in hexadecimal or base32; none gives that of the body, and an unknown kind goes unchecked."""
    kind, _, said = (digest or "").partition(":")
    if not said:
        return digest_of(body)
    if (kind := kind.lower().replace("-", "")) in hashlib.algorithms_guaranteed and not kind.startswith("shake"):
        real = hashlib.new(kind, body)
        if said.lower() != real.hexdigest() and said.upper().rstrip("=") != base64.b32encode(real.digest()).decode().rstrip("="):
            raise ValueError(f"digest mismatch: {digest}")
    return digest


_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
_NAMES = ["file", "offset", "length", "url", "digest", "page_id"]


def _index_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)


def _write_batches(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_path(folder)
        system.create_dir(path, recursive=True)
        out, size, name = None, 0, ""
        for batch in batches:
            rows = []
            for page_id, url, body in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                if out is None:
                    name, size = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = system.open_output_stream(f"{path}/{name}", compression=None)
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                raw = (body or "").encode()
                digest = digest_of(raw)
                member = packer.compress(record(page_id, url, body, raw, digest)) + packer.flush()
                out.write(member)
                rows.append((f"{folder}/{name}", size, len(member), url, digest, page_id))
                size += len(member)
                if size >= FILE_BYTES:
                    out.close()
                    out = None
            if rows:
                yield _index_rows(rows)
        if out is not None:
            out.close()

    return run


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """Writes `pages` as WARC files in `folder` and returns their index: (file, offset, length, url, digest, page_id).

    Only files of tasks that ended count: what a lost task wrote is in no result.

    * null id, url or body: the record goes without that header, a null body as one of no bytes that is marked;
    * empty, very long and repeated bodies, and repeated URLs: a record each;
    * empty table: no file and an empty index; other columns, of any name, aren't written.
    """
    table, rid = numbered(pages)
    work = table.select(column(table, rid).alias("rid"), column(table, id_col).cast("long").alias("page_id"), column(table, url_col).cast("string").alias("url"), column(table, body_col).cast("string").alias("body"))
    return settled(work.mapInArrow(_write_batches(folder), INDEX))


def members(stream) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, uncompressed record) of each gzip member of a stream, read in pieces."""
    held, base = b"", 0
    more = True
    while True:
        unpacker, parts, taken = zlib.decompressobj(31), [], 0
        while not unpacker.eof:
            if not held:
                held = stream.read(1 << 20) if more else b""
                more = bool(held)
                if not held:
                    if taken:
                        raise ValueError(f"the record at {base} is cut off")
                    return
            parts.append(unpacker.decompress(held))
            taken += len(held) - len(unpacker.unused_data)
            held = unpacker.unused_data
        yield base, taken, b"".join(parts)
        base += taken


def _described(file: str, offset: int, length: int, raw: bytes) -> tuple:
    headers, _ = parse(raw)
    url, page = headers.get("warc-target-uri"), headers.get("x-page-id")
    return file, offset, length, None if url is None else unquote(url.strip("<>")), headers.get("warc-payload-digest"), None if page is None else int(page)


def _index_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file in batch.column(0).to_pylist():
            system, path = open_path(file)
            rows = []
            with system.open_input_stream(path, compression=None) as stream:
                for member in members(stream):
                    rows.append(_described(file, *member))
                    if len(rows) == 10_000:
                        yield _index_rows(rows)
                        rows = []
            if rows:
                yield _index_rows(rows)


def index_warc(files: DataFrame) -> DataFrame:
    """The index (file, offset, length, url, digest, page_id) of the .warc.gz files named in column `file`, whoever wrote them.

    * a record without URL, payload digest or page id has null there; records of any type have a row;
    * empty files: no row; a file that is cut off, or no series of gzip members of a record each: an error;
    * a file named twice is indexed twice; a null name is an error; an empty table gives an empty index.
    """
    # a row stands for a file: the number of tasks is said, lest adaptive execution judge it by the rows' bytes
    return files.select("file").repartition(max(1, files.count()), "file").mapInArrow(_index_batches, INDEX)


def coalesced(ranges: list[tuple[int, int]]) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """(offset, length, ranges in it) of the reads for ascending (offset, length) ranges; a longer record is a read by itself."""
    held: list[tuple[int, int]] = []
    start = stop = 0
    for offset, length in ranges:
        if held and (offset - stop > GAP_BYTES or max(stop, offset + length) - start > READ_BYTES):
            yield start, stop - start, held
            held = []
        if not held:
            start = stop = offset
        held.append((offset, length))
        stop = max(stop, offset + length)
    if held:
        yield start, stop - start, held


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    opened, at = None, None
    types = [pa.int64(), pa.string(), pa.string(), pa.string()]
    for batch in batches:
        files = batch.column(0).to_pylist()
        spans = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
        i = 0
        while i < len(files):
            j = i
            while j < len(files) and files[j] == files[i]:
                j += 1
            if at != files[i]:
                if opened is not None:
                    opened.close()
                system, path = open_path(files[i])
                opened, at = system.open_input_file(path), files[i]
            for start, length, inside in coalesced(spans[i:j]):
                block = opened.read_at(length, start)
                rows = []
                for offset, n in inside:
                    headers, inner = parse(zlib.decompress(block[offset - start : offset - start + n], 31))
                    body, text = payload(headers, inner)
                    try:
                        digest = verified(headers.get("warc-payload-digest"), body)
                    except ValueError as error:
                        raise ValueError(f"at {offset} of {at}: {error}") from error
                    url, page = headers.get("warc-target-uri"), headers.get("x-page-id")
                    rows.append((None if page is None else int(page), None if url is None else unquote(url.strip("<>")), None if "x-null-payload" in headers else text, digest))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["page_id", "url", "html", "digest"])
            i = j
    if opened is not None:
        opened.close()


def read_records(selected: DataFrame) -> DataFrame:
    """(page_id, url, html, digest) of the records in `selected`, rows of an index; digests are verified.

    * records of other writers: HTTP heads are left out, digests may be SHA-1 in base32, or missing; then it is that of the body;
    * a null html, page id or URL comes back null; other charsets are decoded as stated;
    * a row that is selected twice gives its record twice; other columns of `selected`, of any name, are not read;
    * a record longer than READ_BYTES is a read by itself; an empty selection gives an empty result.
    """
    part = selected.select("file", "offset", "length", F.floor(F.col("offset") / TASK_BYTES).alias("part"))
    tasks = part.agg(F.approx_count_distinct(F.struct("file", "part"))).first()[0]  # said, as in index_warc()
    return part.repartition(max(1, tasks), "file", "part").sortWithinPartitions("file", "offset").drop("part").mapInArrow(_read_batches, "page_id long, url string, html string, digest string")


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """`pages` written as WARC files in the shared folder with their index, and all records read back by it.

    * null page_id, url or html: come back null (a null html has the digest of no bytes);
    * empty and very long html: as they are; a record longer than a read is a read by itself;
    * repeated rows and URLs: a record and a result row each;
    * empty table: an empty result; other columns, of any name, aren't written.
    """
    return read_records(write_warc(pages, scratch(spark, "warc")))

"""WARC archives: written with revisit records, read in byte ranges.

An archive is a set of gzip files in which every record is a member of its own.
A reading task takes a byte range: it looks for gzip magic, takes a place for a
member only if what it decodes to begins with a WARC header and the member ends
where the file or the next member does, and owns the records that start inside
its range, the last of which it reads beyond the end.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recall_engine.llm.stage import NULL_ID, discard, join_hot, public_id, written

MAGIC = b"\x1f\x8b\x08"
#: Bytes that are decoded, or read beyond a range, at a time.
CHUNK = 256 << 10
#: Payload bytes of a batch of records.
BATCH_BYTES = 4 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "file string, bytes long, records long"
RECORD = "file string, offset long, record_type string, record_id string, date string, target_uri string, refers_to_id string, payload_digest string, intact boolean, payload_bytes long, payload binary, page_id long, refers_to long"


def _opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path in it, in tasks and in the driver."""
    return pafs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri))


def _record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *fields, ("Content-Length", str(len(block)))])
    return f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def _member(record: bytes) -> bytes:
    packer = zlib.compressobj(wbits=31)
    return packer.compress(record) + packer.flush()


def _urn(*parts) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(repr(parts).encode()).digest(), version=4)}>"


def _uri(url: str | None) -> str:
    """A URL as a header's value: white space and control characters are escaped."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m[0]), url or "")


def revisits(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, html, size, sha1, first_id, first_url, led): html and no first_id
    for responses, no html for the revisits of another page's payload; led: a
    response that has revisits.

    Of pages of equal payloads of ``least_bytes`` or more the smallest (id, url)
    is the response; of several such rows one is.  A null html is an empty
    payload, a null id comes first; other columns are not read.  Payloads are
    equal by sha256.
    """
    rows = pages.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumns({"digest": F.sha2("html", 256), "size": F.octet_length("html").cast("long"), "sha1": F.sha1("html")})
    keys = written(rows.where(F.col("size") >= least_bytes).groupBy("digest", "id", "url").agg(F.count(F.lit(1)).alias("copies")), "payload-keys")
    place = F.struct("id", "url")
    first = keys.groupBy("digest").agg(F.min(place).alias("first"), F.min_by("copies", place).alias("copies"), F.sum("copies").alias("n")).where("n > 1")
    first = written(first.select("digest", F.col("first.id").alias("first_id"), F.col("first.url").alias("first_url"), "copies", "n"), "payload-firsts")
    total = keys.agg(F.sum("copies")).first()[0] or 0
    discard(keys)
    found = join_hot(rows, first.drop("n"), ["digest"], first.select("digest", "n"), total, "left")
    own = F.col("copies").isNull() | ((F.col("id") == F.col("first_id")) & F.col("url").eqNullSafe(F.col("first_url")))
    several = own & (F.coalesce("copies", F.lit(1)) > 1)
    out = ["id", "url", "html", "size", "sha1", "first_id", "first_url", "led"]

    def decided(rows: DataFrame, response) -> DataFrame:
        return rows.withColumns({"html": F.when(response, F.col("html")), "first_id": F.when(~response, F.col("first_id")), "first_url": F.when(~response, F.col("first_url")), "led": response & F.col("first_id").isNotNull()}).select(out)

    if first.where("copies > 1").isEmpty():
        return decided(found, own)
    # rows that are alike in everything: one of them is the response
    alike = found.where(several).groupBy("id", "url", "size", "sha1", "first_id", "first_url").agg(F.first("html").alias("html"), F.count(F.lit(1)).alias("n"))
    alike = alike.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
    return decided(found.where(~several), own).unionByName(decided(alike, F.col("copy") == 1))


def write_warc(pages: DataFrame, path: str, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", file_bytes: int = 1 << 30, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes a record of each page below ``path`` and returns the manifest (file,
    bytes, records) as a table in the shared folder.

    Each task writes files of its own name, from ``file_bytes`` on the next one.
    Only files of the manifest belong to the archive: what a lost task left
    behind is in none.  Which pages are revisits, and how odd rows count, is as
    ``revisits`` says.  An empty table gives no files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, records = TaskContext.get().partitionId(), 0, 0
        files, folder = _opened(path)
        out = name = None

        def closed() -> pa.RecordBatch:
            size = out.tell()
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([f"{path}/{name}"]), pa.array([size]), pa.array([records])], ["file", "bytes", "records"])

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
                if out is None:
                    files.create_dir(folder, recursive=True)
                    name = f"{part:06d}-{made:04d}-{uuid.uuid4().hex}.warc.gz"
                    out = files.open_output_stream(f"{folder}/{name}", compression=None)
                    out.write(_member(_record("warcinfo", [("WARC-Record-ID", _urn(name)), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")))
                    made, records = made + 1, 0
                out.write(_member(_page_record(row, date, f"{part}:{made}:{records}")))
                records += 1
                if out.tell() >= file_bytes:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return written(revisits(pages, least_bytes, id_col, url_col, html_col).mapInArrow(run, MANIFEST), "warc-manifest")


def _page_record(row: tuple, date: str, place: str) -> bytes:
    page_id, url, html, size, sha1, first_id, first_url, led = row
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    fields = [("WARC-Date", date), ("WARC-Target-URI", _uri(url)), ("WARC-Payload-Digest", f"sha1:{base64.b32encode(bytes.fromhex(sha1)).decode()}"), ("Content-Type", "application/http; msgtype=response")]
    if page_id != NULL_ID:
        fields.append(("X-Page-Id", str(page_id)))
    if html is not None:
        return _record("response", [("WARC-Record-ID", _urn(page_id, url, sha1 if led else place)), *fields], http + html.encode())
    fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _urn(first_id, first_url, sha1)), ("WARC-Refers-To-Target-URI", _uri(first_url))]
    if first_id != NULL_ID:
        fields.append(("X-Refers-To-Page-Id", str(first_id)))
    return _record("revisit", [("WARC-Record-ID", _urn(page_id, url, place)), *fields], http)


class _Bytes:
    """Bytes of a file from a place on; more are read as they are asked for."""

    def __init__(self, source, start: int, end: int, size: int):
        self.source, self.base, self.size = source, start, size
        self.data = bytearray(source.read_at(min(end, size) - start, start))

    def upto(self, end: int) -> None:
        have = self.base + len(self.data)
        if end > have:
            self.data += self.source.read_at(min(max(end - have, CHUNK), self.size - have), have) if have < self.size else b""

    def at(self, place: int, n: int) -> bytes:
        self.upto(place + n)
        return bytes(self.data[place - self.base : place - self.base + n])

    def magic(self, place: int, end: int) -> int | None:
        """The first gzip magic that begins in [place, end)."""
        self.upto(min(end + 2, self.size))
        found = self.data.find(MAGIC, place - self.base, end + 2 - self.base)
        return None if found < 0 else found + self.base


def _decoded(data: _Bytes, place: int) -> tuple[bytes, int] | None:
    """(content, next place) of the member at a place; None where there is none
    that holds a WARC record and is followed by another or by the file's end."""
    unpack, out, at = zlib.decompressobj(31), bytearray(), place
    try:
        while not unpack.eof:
            chunk = data.at(at, CHUNK)
            if not chunk:
                return None
            out += unpack.decompress(chunk)
            at += len(chunk)
            if not b"WARC/1.".startswith(out[:7]) and not out.startswith(b"WARC/1."):
                return None
    except zlib.error:
        return None
    at -= len(unpack.unused_data)
    return (bytes(out), at) if out and (at == data.size or data.at(at, 3) == MAGIC) else None


def _records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of the records of a member, one as a rule."""
    at = 0
    while content[at : at + 5] == b"WARC/":
        end = content.find(b"\r\n\r\n", at)
        if end < 0:
            raise ValueError("a WARC header doesn't end")
        lines = re.sub(r"\r\n[ \t]+", " ", content[at:end].decode("utf-8", "replace")).split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(fields.get("content-length", "0"))
        if len(content) < end + 4 + size:
            raise ValueError("a WARC block is shorter than its length says")
        yield fields, content[end + 4 : end + 4 + size]
        at = end + 8 + size


def members(source, start: int, end: int, size: int, skip_damaged: bool = False) -> Iterator[tuple[int, bytes]]:
    """(place, content) of the members that begin in [start, end).

    What is before the first member of a range belongs to the range before; a
    place right after a member must hold the next one.  Where it doesn't, or a
    file doesn't begin with one, ValueError is raised; with ``skip_damaged`` the
    range is searched on instead.
    """
    data = _Bytes(source, start, end, size)
    at, follows = start, start == 0
    while at is not None and at < min(end, size):
        found = _decoded(data, at) if follows else None
        if follows and found is None and not skip_damaged:
            raise ValueError(f"no WARC member at byte {at}")
        if found is None:
            at = data.magic(at + follows, end)
            while at is not None and (found := _decoded(data, at)) is None:
                at = data.magic(at + 1, end)
            if at is None:
                return
        yield at, found[0]
        at, follows = found[1], True


def _row(file: str, place: int, fields: dict[str, str], block: bytes) -> tuple:
    kind = fields.get("warc-type", "")
    length, payload = len(block), block
    if fields.get("content-type", "").startswith("application/http"):
        head, _, payload = block.partition(b"\r\n\r\n")
        length = len(payload)
        if kind == "revisit":
            told = re.search(rb"(?im)^content-length:\s*(\d+)", head)
            length = int(told[1]) if told else None
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    intact = base64.b32encode(hashlib.sha1(payload).digest()).decode() == digest if kind == "response" and digest else None
    number = lambda k: int(fields[k]) if re.fullmatch(r"-?\d+", fields.get(k, "")) else None
    return file, place, kind, fields.get("warc-record-id"), fields.get("warc-date"), fields.get("warc-target-uri"), fields.get("warc-refers-to"), digest, intact, length, None if kind == "revisit" else payload, number("x-page-id"), number("x-refers-to-page-id")


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes) of the .warc.gz files below a path; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.warc.gz").load(path)
    return found.select(F.col("path").alias("file"), F.col("length").alias("bytes"))


def read_warc(files: DataFrame, split_bytes: int = 16 << 20, skip_damaged: bool = False) -> DataFrame:
    """The records of files (file, bytes), RECORD, from byte ranges of ``split_bytes``.

    payload is the HTTP body where a block is an HTTP response, none for a
    revisit, else the block; payload_bytes is the full payload's, for a revisit
    as its HTTP header says; payload_digest is the header's, and ``intact``
    whether a response's payload has it.  Records longer than a range are read
    by the task in whose range they start.  A file cut short or damaged raises,
    or with ``skip_damaged`` loses the damaged member alone.  Empty files have no
    records.  Memory holds a range and one record.  An archive that lies
    uncompressed in a record and is longer than a range would be taken for
    members.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORD.split(", ")]
        types = [{"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}[x.split()[1]] for x in RECORD.split(", ")]
        packed = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
        for batch in batches:
            for split in batch.to_pylist():
                fs, name = _opened(split["file"])
                rows, held = [], 0
                with fs.open_input_file(name) as source:
                    for place, content in members(source, split["start"], split["start"] + split_bytes, split["bytes"], skip_damaged):
                        for fields, block in _records(content):
                            rows.append(_row(split["file"], place, fields, block))
                            held += len(block)
                        if held >= BATCH_BYTES:
                            yield packed(rows)
                            rows, held = [], 0
                if rows:
                    yield packed(rows)

    starts = F.sequence(F.lit(0).cast("long"), F.floor((F.col("bytes") - 1) / split_bytes))
    splits = files.where("bytes > 0").select("file", "bytes", F.explode(starts).alias("i")).select("file", "bytes", (F.col("i") * split_bytes).alias("start"))
    n = splits.count()
    return splits.repartition(max(n, 1)).mapInArrow(run, RECORD)

"""WARC archives of web pages, and a two-level capture index over them.

Writing: records with equal payloads are grouped by digest; the one of the
largest page id is a response, the others are revisits that name it.  Each record
is a gzip member of its own in a ``.warc.gz`` file.

Index: captures are range-sorted by reversed-host URL key; each range becomes one
index file of compressed blocks of lines, with a sparse block directory (first
key, place, size) at its end.  The table of index files is the second level: a
row per file with its first key.

Reading: wanted keys are dealt to the index files by binary search over the first
keys, sorted, looked up by binary search in each file's directory (a block is read
and unpacked once for a run of keys in it), and the found captures are read from
the archives by byte range, neighbouring ranges in one read.

Null html is an empty payload, a null url an empty key; every row is a record,
repeated page ids included: rows that share a payload's largest page id are all responses (a capture is told apart by its page id and place); an
empty table gives no archives and no rows.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import struct
import zlib
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import fresh_path, materialize, read_file, write_file

ARCHIVE_BYTES = 64_000_000
BLOCK_LINES = 300
READ_BYTES = 4_000_000
GAP_BYTES = 65_536
#: Copies of one payload are spread over this many tasks when they are joined to their response.
SALTS = 16
_DATE = "1970-01-01T00:00:00Z"


def url_key(url: str | None) -> str:
    """Sort key of a URL: host labels reversed, then the rest, in lower case, without ``www.`` or fragment.

    ``https://www.Example.org:8080/A?b`` gives ``org,example:8080)/a?b``.
    """
    try:
        parts = urlsplit(url or "")
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        return (url or "").lower()
    if not host:
        return (url or "").lower()
    where = ",".join(reversed(host.split("."))) + (f":{port}" if port and (parts.scheme, port) not in (("http", 80), ("https", 443)) else "")
    return f"{where}){parts.path or '/'}{'?' + parts.query if parts.query else ''}".lower()


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, refers_url: str | None) -> bytes:
    """One WARC/1.1 record: a response with the payload, or a revisit with its HTTP head only."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>", f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes, int]:
    """(head fields in lower case, payload, HTTP content length) of one unpacked record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return fields, payload, size


_CAPTURE = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("at", pa.int64()), ("size", pa.int64())])
_CAPTURE_SQL = "key string, page_id long, file string, at long, size long"


def _archiver(folder: str, archive_bytes: int):
    def write(batches):
        from pyspark import TaskContext

        part, number, held, size, rows = TaskContext.get().partitionId(), 0, [], 0, []

        def flush():
            nonlocal number, held, size, rows
            uri = write_file(folder, f"part-{part:06d}-{number:05d}", ".warc.gz", b"".join(held))
            out = [(key, page, uri.rpartition("/")[2], at, n) for key, page, at, n in rows]
            number, held, size, rows = number + 1, [], 0, []
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), _CAPTURE.types)], schema=_CAPTURE)

        for batch in batches:
            for row in batch.to_pylist():
                payload = (row["html"] or "").encode()
                digest = base64.b32encode(bytes.fromhex(row["digest"])).decode()
                member = _gzip(record(row["page_id"], row["url"], payload, digest, row["refers_to"], None))
                rows.append((url_key(row["url"]), row["page_id"], size, len(member)))
                held.append(member)
                size += len(member)
                if size >= archive_bytes:
                    yield flush()
        if held:
            yield flush()

    return write


def write_archives(pages: DataFrame, least_bytes: int = 0, folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> tuple[str, DataFrame]:
    """Write a record per row of ``pages`` (page_id, url, html); the folder and the captures.

    Of equal payloads of ``least_bytes`` or more, the largest page id becomes the
    response and the others revisits.
    """
    folder = folder or fresh_path(pages.sparkSession, "warc")
    rows = pages.select("page_id", "url", "html", F.sha1(F.coalesce("html", F.lit(""))).alias("digest"), F.octet_length(F.coalesce("html", F.lit(""))).alias("bytes"))
    # Only payloads that occur more than once have anything to refer to.
    shared = rows.where(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first")
    spread = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    joined = salted.join(spread, ["digest", "salt"], "left")
    refers = F.when((F.col("bytes") >= least_bytes) & (F.col("first") != F.col("page_id")), F.col("first"))
    out = joined.select("page_id", "url", "html", "digest", refers.alias("refers_to"))
    return folder, materialize(out.mapInArrow(_archiver(folder, archive_bytes), _CAPTURE_SQL), "captures")


class IndexFile:
    """One range of the index: compressed blocks of sorted lines and, at the end, their directory."""

    def __init__(self, uri: str):
        self.uri = uri
        where, path = _open(uri)
        with where.open_input_file(path) as src:
            size = src.size()
            (length,) = struct.unpack("<Q", src.read_at(8, size - 8))
            directory = json.loads(zlib.decompress(src.read_at(length, size - 8 - length)))
        self.firsts = [tuple(d[:2]) for d in directory]
        self.places = [tuple(d[2:]) for d in directory]
        self._cached: tuple[int, list] | None = None

    @staticmethod
    def build(captures: list[tuple], lines: int) -> bytes:
        out, directory, at = [], [], 0
        for k in range(0, len(captures), lines):
            some = captures[k : k + lines]
            block = zlib.compress("\n".join(json.dumps(c) for c in some).encode(), 6)
            directory.append((some[0][0], _order(some[0][1]), at, len(block)))
            out.append(block)
            at += len(block)
        tail = zlib.compress(json.dumps(directory).encode())
        return b"".join(out) + tail + struct.pack("<Q", len(tail))

    def block(self, k: int) -> list[tuple]:
        if not self._cached or self._cached[0] != k:
            at, n = self.places[k]
            lines = zlib.decompress(read_file(self.uri, at, n)).decode().split("\n")
            self._cached = k, [tuple(json.loads(x)) for x in lines]
        return self._cached[1]

    def find(self, key: str, page_id: int | None = None, any_page: bool = False) -> list[tuple]:
        """Captures of a key (of one page id, unless ``any_page``): search the directory, then the blocks."""
        low = (key, -(2**63)) if any_page else (key, _order(page_id))
        k, out = max(0, bisect.bisect_left(self.firsts, low) - 1), []
        while k < len(self.firsts) and self.firsts[k][0] <= key:
            block = self.block(k)
            i = bisect.bisect_left(block, low, key=lambda c: (c[0], _order(c[1])))
            while i < len(block) and block[i][0] == key and (any_page or _order(block[i][1]) == low[1]):
                out.append(block[i])
                i += 1
            if i < len(block):
                break
            k += 1
        return out


def _order(page_id: int | None) -> int:
    return -(2**63) if page_id is None else page_id


def _open(uri: str):
    from ._shared import filesystem

    return filesystem(uri)


def _index_writer(folder: str, lines: int, limit: int):
    schema = pa.schema([("first_key", pa.string()), ("first_page", pa.int64()), ("path", pa.string()), ("n", pa.int64())])

    def write(batches):
        held: list[tuple] = []

        def flush():
            uri = write_file(folder, "index", ".cdx", IndexFile.build(held, lines))
            out = pa.record_batch([[held[0][0]], [_order(held[0][1])], [uri], [len(held)]], schema=schema)
            held.clear()
            return out

        for batch in batches:
            held += list(zip(*(batch.column(c).to_pylist() for c in ("key", "page_id", "file", "at", "size"))))
            if len(held) >= limit:
                yield flush()
        if held:
            yield flush()

    return write


def build_index(captures: DataFrame, folder: str | None = None, lines: int = BLOCK_LINES, limit: int = 2_000_000) -> DataFrame:
    """Write the index files of ``captures``; a row per file: first_key, first_page, path, n."""
    folder = folder or fresh_path(captures.sparkSession, "cdx")
    keys = ["key", "page_id", "file", "at"]
    dealt = captures.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return materialize(dealt.mapInArrow(_index_writer(folder, lines, limit), "first_key string, first_page long, path string, n long"), "cdx-files")


def _looker(table, any_page: bool):
    def look(batches):
        opened: tuple[int, IndexFile] | None = None
        files = table.value
        for batch in batches:
            out = []
            for number, key, page in zip(*(batch.column(c).to_pylist() for c in ("number", "key", "page_id"))):
                # A key's captures may go on in the files after the one that holds its first.
                while number < len(files):
                    if not opened or opened[0] != number:
                        opened = number, IndexFile(files[number][2])
                    out += opened[1].find(key, page, any_page)
                    number += 1
                    if number >= len(files) or files[number][0] > key or (not any_page and (files[number][0], files[number][1]) > (key, _order(page))):
                        break
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), _CAPTURE.types)], schema=_CAPTURE)

    return look


def lookup(index: DataFrame, wanted: DataFrame, any_page: bool = False) -> DataFrame:
    """Captures of the wanted keys (key, page_id; with ``any_page`` all pages of a key).

    The table of index files has one row for some millions of captures, so it is
    read to the driver and broadcast; keys are dealt to files by binary search in it.
    """
    spark = index.sparkSession
    files = sorted(tuple(r) for r in index.select("first_key", "first_page", "path").collect())
    shared = spark.sparkContext.broadcast(files)

    def number(batches):
        firsts = [f[:2] for f in shared.value]
        for batch in batches:
            keys, pages = batch.column("key").to_pylist(), batch.column("page_id").to_pylist()
            low = [bisect.bisect_left(firsts, (k, -(2**63)) if any_page else (k, _order(p))) for k, p in zip(keys, pages)]
            # The file before may hold the key too, unless this one starts with it.
            at = [n if n < len(firsts) and firsts[n] == (k, _order(p)) and not any_page else max(0, n - 1) for n, k, p in zip(low, keys, pages)]
            yield pa.record_batch([pa.array(at, pa.int32()), batch.column("key"), batch.column("page_id")], names=["number", "key", "page_id"])

    if not files:
        return spark.createDataFrame([], _CAPTURE_SQL)
    numbered = wanted.select("key", "page_id").mapInArrow(number, "number int, key string, page_id long")
    dealt = numbered.repartitionByRange("number", "key", "page_id").sortWithinPartitions("number", "key", "page_id")
    return dealt.mapInArrow(_looker(shared, any_page), _CAPTURE_SQL)


_ROW = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("html", pa.string())])
_ROW_SQL = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, html string"


def _reader(folder: str, payload: bool):
    def row(data: bytes) -> tuple:
        fields, body, size = parse(zlib.decompress(data, 31))
        kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
        if kind == "response" and base64.b32encode(hashlib.sha1(body).digest()).decode() != digest:
            raise ValueError(f"payload of {fields['warc-record-id']} does not match its digest")
        number = lambda x: None if x is None or x == "<urn:page:null>" else int(x[len("<urn:page:") : -1])
        return number(fields["warc-record-id"]), size, digest, kind, number(fields.get("warc-refers-to")), fields["warc-target-uri"], body.decode() if payload and kind == "response" else None

    def read(batches):
        for batch in batches:
            places = list(zip(*(batch.column(c).to_pylist() for c in ("file", "at", "size"))))
            k, out = 0, []
            while k < len(places):
                file, low, n = places[k]
                high, stop = low + n, k + 1
                while stop < len(places) and places[stop][0] == file and 0 <= places[stop][1] - high <= GAP_BYTES and places[stop][1] + places[stop][2] - low <= READ_BYTES:
                    high, stop = places[stop][1] + places[stop][2], stop + 1
                data = read_file(f"{folder}/{file}", low, high - low)
                out += [row(data[a - low : a - low + m]) for _, a, m in places[k:stop]]
                k = stop
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), _ROW.types)], schema=_ROW)

    return read


def fetch(folder: str, captures: DataFrame, payload: bool = False) -> DataFrame:
    """Read captures from the archives, by ranges in file order: a row per record, with its digest checked."""
    dealt = captures.repartitionByRange("file", "at").sortWithinPartitions("file", "at")
    return dealt.mapInArrow(_reader(folder, payload), _ROW_SQL)


def wanted_keys(pages: DataFrame) -> DataFrame:
    """(key, page_id) of every row of ``pages``, to look up."""

    def keys(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([url_key(u) for u in batch.column("url").to_pylist()], pa.string()), batch.column("page_id")], names=["key", "page_id"])

    return pages.select("page_id", "url").mapInArrow(keys, "key string, page_id long").distinct()

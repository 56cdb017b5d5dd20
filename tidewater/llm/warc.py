"""WARC archives with a two-level capture index.

Archives are one gzip member per record. The index is sorted by reversed-host key
(SURT) and page into files of compressed blocks of captures; each file ends with its sparse
directory, the first and last entry, place and size of each of its blocks, and a table
has one row for each file. A look-up finds the file among these rows by bisection, reads its
directory by range, finds the block (or the few that hold the key) in it by bisection, reads that by
range, finds the captures in it by bisection, and reads their records by range. Files are
the partitions of the sort, so what all tasks and the driver hold does not grow with the captures.

Defined cases: a null html is an empty payload; payloads below ``MIN_REVISIT`` bytes
are always responses; of larger equal payloads the one with the smallest page_id is
the response, and rows that repeat this page_id with this payload are responses too; a
null page_id is only ever a response if all rows with its payload have none; a null
url has the key ``-``; an empty table gives no files; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, table, written
from .files import open_in, open_out

MIN_REVISIT = 100
#: Bytes after which an archive is closed, and captures in an index block.
ARCHIVE_BYTES = 64 << 20
BLOCK_CAPTURES = 512


def surt(url: str | None) -> str:
    """``http://www.a.example.org:80/x?y#z`` -> ``org,example,a)/x?y``."""
    if not url:
        return "-"
    rest = url.split("://", 1)[-1].split("#", 1)[0]
    host, slash, path = rest.partition("/")
    if "?" in host:
        host, _, query = host.partition("?")
        slash, path = "/", "?" + query
    host = host.rpartition("@")[2].split(":", 1)[0].lower()
    host = host[4:] if host.startswith("www.") else host
    return ",".join(reversed(host.split("."))) + ")/" + path


def _member(headers: list[tuple[str, str]], body: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(body)}\r\n\r\n"
    pack = zlib.compressobj(3, zlib.DEFLATED, 31)
    return pack.compress(head.encode()) + pack.compress(body) + pack.compress(b"\r\n\r\n") + pack.flush()


def _headers(kind: str, page: int | None, url: str | None, digest: str, size: int, refers: int | None = None) -> list[tuple[str, str]]:
    out = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page} {url} {digest}')}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", json.dumps(url)[1:-1] if url else "urn:none"),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Page-ID", "-" if page is None else str(page)),
        ("Payload-Bytes", str(size)),
    ]
    if refers is not None:
        out += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("Refers-To-Page", str(refers))]
    return out


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    n = int(fields["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("record is cut")
    return fields, rest[:n]


def _responses(batches):
    """Pages to response records; the digest is all that later steps need of the payload."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("size", pa.int64()), ("member", pa.binary())])
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            rows = []
            some = batch.slice(at, 512)
            for page, url, html in zip(*(some.column(k).to_pylist() for k in range(3))):
                body = (html or "").encode()
                digest = hashlib.sha256(body).hexdigest()
                rows.append((page, url, digest, len(body), _member(_headers("response", page, url, digest, len(body)), body)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


_CAPTURE = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("place", pa.int64()), ("size", pa.int64())])


def _archiver(folder: str, limit: int):
    def run(batches):
        out, path, at = None, None, 0
        for batch in batches:
            rows = []
            for page, url, digest, size, member, first in zip(*(batch.column(k).to_pylist() for k in range(6))):
                if size >= MIN_REVISIT and first is not None and first != page:
                    member = _member(_headers("revisit", page, url, digest, size, first), b"")
                if out is None or at > limit:
                    if out is not None:
                        out.close()
                    path, at = f"{folder}/pages-{uuid.uuid4().hex}.warc.gz", 0
                    out = open_out(path)
                out.write(member)
                rows.append((surt(url), page, path, at, len(member)))
                at += len(member)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _CAPTURE.types)], schema=_CAPTURE)
        if out is not None:
            out.close()

    return run


def write_archives(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes one record per page; returns the captures (key, page_id, file, place, size).

    Equal payloads are found by a partial minimum over digests. Records meet the first
    page of their digest in an equi-join that adaptive execution may split at a digest
    that very many pages share; what is shuffled is the compressed record.
    """
    spark = pages.sparkSession
    folder = scratch(spark, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    body = F.coalesce("html", F.lit(""))
    first = rows.where(F.octet_length(body) >= MIN_REVISIT).groupBy(F.sha2(body, 256).alias("d")).agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    records = rows.mapInArrow(_responses, "page_id long, url string, digest string, size long, member binary")
    joined = records.join(first, F.col("digest") == F.col("d"), "left").drop("d")
    return written(joined.mapInArrow(_archiver(folder, archive_bytes), "key string, page_id long, file string, place long, size long"), "captures")


_FILE = pa.schema([("first", pa.string()), ("last", pa.string()), ("file", pa.string()), ("place", pa.int64()), ("size", pa.int64()), ("n", pa.int64())])
_FILE_SQL = "first string, last string, file string, place long, size long, n long"


def _entry(key: str, page: int | None) -> tuple:
    """What captures are sorted by, as Spark sorts them: no page before all pages."""
    return key, page is not None, page or 0


def _indexer(folder: str, block: int):
    def run(batches):
        out, path, at, held, blocks = None, f"{folder}/index-{uuid.uuid4().hex}.cdx", 0, [], []

        def put(lines) -> tuple[int, int]:
            nonlocal out, at
            out = out or open_out(path)
            raw = zlib.compress("".join(json.dumps(r) + "\n" for r in lines).encode())
            out.write(raw)
            at += len(raw)
            return at - len(raw), len(raw)

        def flush():
            place, size = put(held)
            blocks.append((_entry(*held[0][:2]), _entry(*held[-1][:2]), place, size, len(held)))
            held.clear()

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(5))):
                held.append(row)
                if len(held) >= block:
                    flush()
        if held:
            flush()
        if blocks:
            place, size = put(blocks)
            out.close()
            row = (json.dumps(blocks[0][0]), json.dumps(blocks[-1][1]), path, place, size, sum(b[4] for b in blocks))
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _FILE.types)], schema=_FILE)

    return run


def write_index(captures: DataFrame, block: int = BLOCK_CAPTURES) -> DataFrame:
    """Sorts captures by key into files of compressed blocks; returns the table of files."""
    folder = scratch(captures.sparkSession, "cdx")
    order = ["key", "page_id", "file", "place"]
    rows = captures.select("key", "page_id", "file", "place", "size").repartitionByRange(*order).sortWithinPartitions(*order)
    return written(rows.mapInArrow(_indexer(folder, block), _FILE_SQL), "directory")


def _range(file: str, place: int, size: int) -> bytes:
    with open_in(file) as f:
        return f.read_at(size, place)


def read_lines(file: str, place: int, size: int) -> list[list]:
    """A block of captures, or the directory of a file."""
    return [json.loads(x) for x in zlib.decompress(_range(file, place, size)).splitlines()]


class Captures:
    """Look-up by bisection; holds one row for each index file and the directory read last."""

    def __init__(self, files: list[tuple]):
        self.files = sorted((tuple(json.loads(first)), tuple(json.loads(last)), *rest) for first, last, *rest in files)
        self.last = [f[1] for f in self.files]
        self.held: tuple = (None, [], [])

    @classmethod
    def of(cls, directory: DataFrame) -> Captures:
        return cls([tuple(r) for r in directory.collect()])

    def blocks(self, low: tuple, high: tuple) -> list[tuple[str, int, int]]:
        """(file, place, size) of the blocks that may hold entries from ``low`` to ``high``."""
        found = []
        for first, _, file, place, size, _ in self.files[bisect.bisect_left(self.last, low) :]:
            if first > high:
                break
            if self.held[0] != file:
                own = [(tuple(a), tuple(b), p, n) for a, b, p, n, _ in read_lines(file, place, size)]
                self.held = (file, own, [b[1] for b in own])
            _, own, last = self.held
            for a, _, p, n in own[bisect.bisect_left(last, low) :]:
                if a > high:
                    break
                found.append((file, p, n))
        return found

    def find(self, url: str) -> list[tuple[dict[str, str], bytes]]:
        """Headers and payloads of all captures of ``url``."""
        low, high, found = (surt(url), False, 0), (surt(url), True, 1 << 63), []
        for file, place, size in self.blocks(low, high):
            for _, _, f, p, n in between(read_lines(file, place, size), low, high):
                found.append(parse(_range(f, p, n)))
        return found


def between(rows: list[list], low: tuple, high: tuple) -> list[list]:
    """The captures of a block from ``low`` to ``high``."""
    entry = lambda r: _entry(r[0], r[1])
    return rows[bisect.bisect_left(rows, low, key=entry) : bisect.bisect_right(rows, high, key=entry)]


def _keys(batches):
    schema = pa.schema([("key", pa.string()), ("page_id", pa.int64())])
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([surt(u) for u in batch.column(1).to_pylist()], pa.string()), batch.column(0)], schema=schema)


_WANTED = pa.schema([("file", pa.string()), ("place", pa.int64()), ("size", pa.int64()), ("key", pa.string()), ("page_id", pa.int64())])


def _blocks(files):
    def run(batches):
        captures = Captures(files.value)
        for batch in batches:
            rows = []
            for key, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                entry = _entry(key, page)
                rows += [(*b, key, page) for b in captures.blocks(entry, entry)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _WANTED.types)], schema=_WANTED)

    return run


def _captures(batches):
    """Captures of the wanted entries; each block is read once, as its rows come together."""
    now, lines = None, []
    for batch in batches:
        rows = []
        for file, place, size, key, page in zip(*(c.to_pylist() for c in batch.columns)):
            if (file, place) != now:
                now, lines = (file, place), read_lines(file, place, size)
            entry = _entry(key, page)
            rows += between(lines, entry, entry)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _CAPTURE.types)], schema=_CAPTURE)


def look_up(directory: DataFrame, pages: DataFrame) -> DataFrame:
    """The captures (key, page_id, file, place, size) of the urls and ids of ``pages``, through the index.

    Entries are looked up once each, in order, so that a task reads each directory once; then
    blocks are dealt, and read once. An entry that fills many blocks is spread over those."""
    spark = pages.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    keys = rows.mapInArrow(_keys, "key string, page_id long").distinct().repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id")
    files = spark.sparkContext.broadcast([tuple(r) for r in directory.collect()])  # one row for each partition of the sort
    wanted = keys.mapInArrow(_blocks(files), "file string, place long, size long, key string, page_id long")
    wanted = wanted.repartition(n, "file", "place").sortWithinPartitions("file", "place", "key", "page_id")
    return wanted.mapInArrow(_captures, "key string, page_id long, file string, place long, size long")


_ROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def _records(batches):
    name, f = None, None
    for batch in batches:
        rows = []
        for file, place, size in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if file != name:
                if f is not None:
                    f.close()
                name, f = file, open_in(file)
            head, body = parse(f.read_at(size, place))
            digest, kind = head["WARC-Payload-Digest"].removeprefix("sha256:"), head["WARC-Type"]
            if kind == "response" and hashlib.sha256(body).hexdigest() != digest:
                raise ValueError(f"{file} at {place}: payload does not have its digest")
            page, refers, uri = head["Page-ID"], head.get("Refers-To-Page"), head["WARC-Target-URI"]
            rows.append((None if page == "-" else int(page), None if uri == "urn:none" else json.loads(f'"{uri}"'), len(body) if kind == "response" else int(head["Payload-Bytes"]), digest, kind, None if refers is None else int(refers)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ROW.types)], schema=_ROW)
    if f is not None:
        f.close()


def read_archives(captures: DataFrame) -> DataFrame:
    """The records of ``captures``, read by range in the order of the archives."""
    n = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    megabytes = F.floor(F.col("place") / F.lit(8 << 20))
    found = captures.repartition(n, "file", megabytes).sortWithinPartitions("file", "place")
    return found.select("file", "place", "size").mapInArrow(_records, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the archives and their index, looks every page up in it, and reads the records found."""
    pages = table(spark, sf_dir, "pages")
    directory = write_index(write_archives(pages))
    return read_archives(look_up(directory, pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

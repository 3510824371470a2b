"""WARC archives with a two-level capture index (operator 9).

Writing: pages with equal payloads of at least MIN_REVISIT_BYTES are grouped by SHA-256; the smallest
page_id stays the response, the others become revisit records without a body. Tasks write whole
archives (one gzip member per record) below a shared folder and hand back one capture row per record:
reversed-host URL key, archive, offset, length. A task that is run again writes a new archive, and only
the rows of the attempt that succeeded name one.

Index: capture rows are range-sorted by key and packed into files of compressed blocks of BLOCK_LINES
lines; at a file's end stands its sparse directory, each block's first and last key and place. A
lookup bisects the files, the directory of a file and the lines of a block, and then reads just the byte
range of the capture. Only a row a file (so one a task of the writing stage) is held by the driver.
``read_back`` does that for the keys of a whole table: keys in order meet the directories, the blocks they
point at are dealt to tasks and read once (a key with very many captures has many blocks), and captures
are read archive by archive in offset order, so that neighbours share a read.

Only slim rows (digest, page_id) are aggregated to find the groups, with partial aggregation before the
shuffle, and the join back to the pages is one that Spark can split when a single payload is very
frequent. Archives are written with pyarrow's file systems, so any store with a URI will do. Payloads
of any length are held one at a time; other columns of the pages are ignored.

Defined results: null html is an empty payload; a null url has the empty key; a page whose page_id is
null can only be the response if no other page shares its payload; rows that repeat the smallest
page_id with the same payload are all responses; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuegrid.llm.text import as_bytes
from cuegrid.scratch import materialise, scratch_path

#: Equal payloads below this size are stored again and again.
MIN_REVISIT_BYTES = 100
#: Captures in one compressed block of the index.
BLOCK_LINES = 512
#: Directories of index files that a task holds.
HELD_DIRECTORIES = 16
#: Bytes of an archive that are fetched at once when captures lie next to each other.
READ_AHEAD = 1 << 20

_GZIP_LEVEL = 1


def url_key(url: str | None) -> str:
    """``http://www.b.example/x?q`` -> ``example,b)/x?q``: host labels reversed, scheme, port, user,
    a leading www and the fragment dropped, the host in lower case, tabs and line breaks escaped."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").lower()
    except ValueError:
        host = ""
    if not host:
        return _clean(url)
    labels = host.removeprefix("www.").split(".")
    return _clean(",".join(reversed(labels)) + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else ""))


def _clean(key: str) -> str:
    return key.replace("\t", "%09").replace("\n", "%0A")


def _record(kind: str, url: str, page_id: int | None, digest: str, size: int, refers_to: int | None, body: bytes) -> bytes:
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url}')}>",
        "WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"),
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
        f"X-Payload-Length: {size}",
    ]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {refers_to}"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(lines).encode() + body + b"\r\n\r\n"


def parse_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and body of one gzip member."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    size = int(headers["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("damaged WARC record")
    return headers, rest[:size]


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else f"file:{uri}")


def classify_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, record_type, refers_to for every page."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.octet_length(html).cast("long").alias("payload_bytes"), F.sha2(F.encode(html, "UTF-8"), 256).alias("payload_digest"))
    large = rows.filter(F.col("payload_bytes") >= MIN_REVISIT_BYTES)
    groups = large.groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").drop("n")
    joined = rows.join(groups, "payload_digest", "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select(
        "page_id", "url", "html", "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first_id")).alias("refers_to"),
    )


_CAPTURE = "url_key string, page_id long, archive string, offset long, length long"


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write the pages into archives below ``folder``; one capture row per record, materialised."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = out = None
        offset, name = 0, ""
        for batch in batches:
            if out is None and batch.num_rows:
                store, root = _store(folder)
                store.create_dir(root, recursive=True)
                name = f"pages-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                out = store.open_output_stream(f"{root}/{name}", compression=None)
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            fields = [column[n].to_pylist() for n in ("page_id", "url", "payload_digest", "payload_bytes", "record_type", "refers_to")]
            keys, offsets, lengths = [], [], []
            for i, (page_id, url, digest, size, kind, refers_to) in enumerate(zip(*fields, strict=True)):
                # A payload at a time; the batch is the only copy of all of them.
                body = as_bytes(column["html"].slice(i, 1))[0] if kind == "response" else b""
                raw = _record(kind, url or "", page_id, digest, size, refers_to, body)
                member = gzip.compress(raw, _GZIP_LEVEL, mtime=0)
                out.write(member)
                keys.append(url_key(url))
                offsets.append(offset)
                lengths.append(len(member))
                offset += len(member)
            n = len(keys)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), column["page_id"].cast(pa.int64()), pa.array([name] * n, pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], names=["url_key", "page_id", "archive", "offset", "length"])
        if out is not None:
            out.close()

    return materialise(classify_pages(pages).mapInArrow(write, _CAPTURE), "warc-captures")


_FILE = "first_key string, last_key string, file string, offset long, length long"


def build_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Pack capture rows into index files below ``folder``; a row a file (its first and last key, and
    the place of its directory), materialised."""
    order = ["url_key", "page_id", "archive", "offset"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = out = None
        offset, name, lines, directory = 0, "", [], []

        def flush():
            nonlocal offset, lines
            block = zlib.compress("\n".join("\t".join(x) for x in lines).encode(), 6)
            out.write(block)
            directory.append((lines[0][0], lines[-1][0], str(offset), str(len(block))))
            offset += len(block)
            lines = []

        for batch in batches:
            if out is None and batch.num_rows:
                store, root = _store(folder)
                store.create_dir(root, recursive=True)
                name = f"index-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.cdxz"
                out = store.open_output_stream(f"{root}/{name}", compression=None)
            for key, page_id, archive, at, length in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                lines.append((key, "" if page_id is None else str(page_id), archive, str(at), str(length)))
                if len(lines) == block_lines:
                    flush()
        if out is None:
            return
        if lines:
            flush()
        end = zlib.compress("\n".join("\t".join(x) for x in directory).encode(), 6)
        out.write(end)
        out.close()
        row = [directory[0][0], directory[-1][1], name, offset, len(end)]
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=[f.split()[0] for f in _FILE.split(", ")])

    ranged = captures.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialise(ranged.mapInArrow(pack, _FILE), "warc-directory")


def _lines(block: bytes) -> list[list[str]]:
    return [line.split("\t") for line in zlib.decompress(block).decode().split("\n")]


class CaptureIndex:
    """Lookups: bisection in the list of files, in a file's directory, and in a block."""

    def __init__(self, folder: str, files: list[tuple]):
        self._folder, self._files = folder, sorted(tuple(f) for f in files)
        self._last = [f[1] for f in self._files]
        self._opened = None
        self._held: dict[str, list[tuple[str, str, int, int]]] = {}

    def __getstate__(self):
        return self._folder, self._files

    def __setstate__(self, state):
        self.__init__(*state)

    def range(self, name: str, offset: int, length: int) -> bytes:
        if self._opened is None:
            self._opened = _store(self._folder)
        store, root = self._opened
        with store.open_input_file(f"{root}/{name}") as f:
            return f.read_at(length, offset)

    def _directory(self, name: str, offset: int, length: int) -> list[tuple[str, str, int, int]]:
        if name not in self._held:
            while len(self._held) >= HELD_DIRECTORIES:
                del self._held[next(iter(self._held))]
            self._held[name] = [(a, b, int(at), int(n)) for a, b, at, n in _lines(self.range(name, offset, length))]
        return self._held[name]

    def blocks(self, key: str) -> Iterator[tuple[str, int, int]]:
        """(file, offset, length) of the blocks that may hold the key, in order."""
        for first, _, name, offset, length in self._files[bisect.bisect_left(self._last, key) :]:
            if first > key:
                return
            directory = self._directory(name, offset, length)
            for low, _, at, n in directory[bisect.bisect_left(directory, key, key=lambda e: e[1]) :]:
                if low > key:
                    return
                yield name, at, n

    def captures(self, url: str) -> list[tuple[str, int, int]]:
        """(archive, offset, length) of every capture of the URL."""
        key = url_key(url)
        return [place for block in self.blocks(key) for place in places_of(_lines(self.range(*block)), key)]

    def read(self, url: str) -> list[tuple[dict[str, str], bytes]]:
        return [parse_record(self.range(*place)) for place in self.captures(url)]


def places_of(lines: list[list[str]], key: str) -> Iterator[tuple[str, int, int]]:
    """Captures of the key among a block's lines."""
    for line in lines[bisect.bisect_left(lines, key, key=lambda x: x[0]) :]:
        if line[0] != key:
            return
        yield line[2], int(line[3]), int(line[4])


def look_up(urls: DataFrame, index: CaptureIndex) -> DataFrame:
    """(archive, offset, length) of every capture of the URLs in the table (url), each once."""
    shared = urls.sparkSession.sparkContext.broadcast(index)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([url_key(u) for u in batch.column(0).to_pylist()], pa.string())], names=["key"])

    def directed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for key in batch.column(0).to_pylist():
                for block in shared.value.blocks(key):
                    rows.append((key, *block))
                    if len(rows) == 10_000:
                        yield _block_rows(rows)
                        rows = []
            yield _block_rows(rows)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, lines = None, []
        for batch in batches:
            rows = []
            for key, *block in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if block != held:
                    held, lines = block, _lines(shared.value.range(*block))
                rows += places_of(lines, key)
            columns = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["archive", "offset", "length"])

    keys = urls.select("url").mapInArrow(keyed, "key string").distinct().repartitionByRange("key").sortWithinPartitions("key")
    blocks = keys.mapInArrow(directed, "key string, file string, offset long, length long")
    dealt = blocks.repartition("file", "offset").sortWithinPartitions("file", "offset", "key")
    return dealt.mapInArrow(found, "archive string, offset long, length long")


def _block_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["key", "file", "offset", "length"])


def read_back(urls: DataFrame, files: DataFrame, folder: str) -> DataFrame:
    """The records of every capture of the URLs (url), found through the index: page_id, payload_bytes,
    payload_digest, record_type, refers_to. Payloads of responses are hashed again and checked."""
    index = CaptureIndex(folder, [tuple(r) for r in files.select(*[f.split()[0] for f in _FILE.split(", ")]).collect()])
    places = look_up(urls, index).withColumn("stretch", F.floor(F.col("offset") / (16 * READ_AHEAD)))
    near = places.repartition("archive", "stretch").sortWithinPartitions("archive", "offset").drop("stretch")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        name, source, start, ahead = None, None, 0, b""
        for batch in batches:
            rows = []
            for archive, offset, length in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if archive != name:
                    if source is not None:
                        source.close()
                    name, source, start, ahead = archive, store.open_input_file(f"{root}/{archive}"), 0, b""
                if not start <= offset <= offset + length <= start + len(ahead):
                    start, ahead = offset, source.read_at(max(length, READ_AHEAD), offset)
                headers, body = parse_record(ahead[offset - start : offset - start + length])
                digest, size = headers["WARC-Payload-Digest"].removeprefix("sha256:"), int(headers["X-Payload-Length"])
                kind = headers["WARC-Type"]
                if kind == "response" and (size != len(body) or digest != hashlib.sha256(body).hexdigest()):
                    raise ValueError(f"payload of {archive} at {offset} does not fit its digest")
                page, refers = headers.get("X-Page-ID", ""), headers.get("X-Refers-To-Page-ID", "")
                rows.append((int(page) if page else None, size, digest, kind, int(refers) if refers else None))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
        if source is not None:
            source.close()

    return near.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op9_warc(spark, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    captures = write_archives(pages, folder)
    return read_back(pages, build_index(captures, folder), folder)


OP9_SQL = r"""
WITH rows AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
firsts AS (SELECT payload_digest, min(page_id) AS first_id FROM rows WHERE payload_bytes >= 100 GROUP BY payload_digest HAVING count(*) > 1)
SELECT r.page_id, r.payload_bytes, r.payload_digest,
  CASE WHEN f.first_id IS NOT NULL AND r.page_id IS DISTINCT FROM f.first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.first_id IS NOT NULL AND r.page_id IS DISTINCT FROM f.first_id THEN f.first_id END AS refers_to
FROM rows r LEFT JOIN firsts f USING (payload_digest)
"""

"""WARC archives: write, normalise a monolithic gzip stream to one member per record, index, and read back by offset.

A writer task streams its records into one whole-file gzip stream. The normaliser inflates such a stream once, cuts it at
record boundaries, writes every record as its own gzip member and a sidecar index (one JSON line per record: offset and
length of the member, record id, type, target and digests). Both hold one record and one buffer in memory at a time.
Files go to the shared folder through pyarrow's file systems; a task writes under a name of its own and renames at the
end, so a task that runs twice leaves one whole file.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import drop_at_exit, materialize, new_path

#: Payloads shorter than this are never revisits.
LEAST_REVISIT = 100
BUFFER = 1 << 20
GZIP = 31  # zlib's window setting for gzip framing
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
#: Records of one task go on to a further archive after so many payload bytes.
ARCHIVE_BYTES = 1 << 28


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _record(page_id, url: str, payload: bytes, digest: str, kind: str, refers_to) -> tuple[bytes, bytes]:
    """Header block and body of one record, without the two line ends that close it."""
    body = payload if kind == "response" else b""
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:skein:page:{'null' if page_id is None else page_id}>",
        f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~-._' + chr(39))}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-X-Payload-Length: {len(payload)}",
    ]
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:skein:page:{refers_to}>"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(lines).encode(), body


class _Out:
    """A file written under a name of its own and renamed when whole."""

    def __init__(self, uri: str):
        self.fs, self.path = _fs(uri)
        self.tmp = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.file = self.fs.open_output_stream(self.tmp, compression=None, buffer_size=BUFFER)

    def done(self) -> None:
        self.file.close()
        self.fs.move(self.tmp, self.path)


def _write(folder: str):
    """Rows (page_id, url, payload, digest, kind, refers_to) -> monolithic archives; one row (uri, records) for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, out, z, n, size = TaskContext.get().partitionId(), 0, None, None, 0, 0

        def close() -> pa.RecordBatch:
            out.file.write(z.flush())
            out.done()
            return pa.RecordBatch.from_pydict({"uri": [uri], "records": [n]})

        for b in batches:
            for page_id, url, payload, digest, kind, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    uri = f"{folder}/whole-{part:05d}-{seq:03d}.warc.gz"
                    out, z, n, size = _Out(uri), zlib.compressobj(1, zlib.DEFLATED, GZIP), 0, 0
                head, body = _record(page_id, url or "", payload, digest, kind, refers_to)
                out.file.write(z.compress(head + body + b"\r\n\r\n"))
                n, size = n + 1, size + len(body)
                if size >= ARCHIVE_BYTES:
                    yield close()
                    out, seq = None, seq + 1
        if out is not None:
            yield close()

    return run


def inflate(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The plain bytes of a gzip stream of any number of members, in bounded pieces."""
    z = zlib.decompressobj(GZIP)
    for data in chunks:
        while data:
            if z.eof:
                z = zlib.decompressobj(GZIP)
            piece = z.decompress(data, BUFFER)
            if piece:
                yield piece
            data = z.unused_data if z.eof else z.unconsumed_tail
    tail = z.flush()
    if tail:
        yield tail
    if not z.eof:
        raise ValueError("the gzip stream ends early")


def records(plain: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, whole record bytes without the closing line ends) of a WARC byte stream."""
    held = bytearray()

    def fill(n: int) -> bool:
        while len(held) < n:
            piece = next(plain, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    plain = iter(plain)
    while True:
        while held[:2] == b"\r\n" or (len(held) < 2 and fill(2) and held[:2] == b"\r\n"):
            del held[:2]
        if not held and not fill(1):
            return
        at = held.find(b"\r\n\r\n")
        while at < 0:
            seen = len(held)
            if not fill(seen + 1):
                raise ValueError("a record's header ends early")
            at = held.find(b"\r\n\r\n", max(0, seen - 3))
        head = bytes(held[: at + 4])
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:] if x)}
        length = int(fields["content-length"])
        if not fill(at + 4 + length):
            raise ValueError("a record's body ends early")
        whole = bytes(held[: at + 4 + length])
        del held[: at + 4 + length]
        yield fields, whole


def _read(uri: str, offset: int = 0, length: int | None = None) -> Iterator[bytes]:
    fs, path = _fs(uri)
    with fs.open_input_file(path) as f:
        f.seek(offset)
        left = length if length is not None else 1 << 62
        while left > 0 and (data := f.read(min(BUFFER, left))):
            left -= len(data)
            yield data


def normalise(uri: str, target: str) -> int:
    """Rewrite the archive at uri as target, one gzip member a record, with the index target + '.idx'; returns the count.

    Works on any WARC gzip file, monolithic or not.
    """
    out, index, at, n = _Out(target), _Out(target + ".idx"), 0, 0
    for fields, whole in records(inflate(_read(uri))):
        z = zlib.compressobj(6 if len(whole) < 4096 else 3, zlib.DEFLATED, GZIP)
        member = z.compress(whole + b"\r\n\r\n") + z.flush()
        out.file.write(member)
        line = {"offset": at, "length": len(member), "id": fields.get("warc-record-id"), "type": fields.get("warc-type"), "uri": fields.get("warc-target-uri"), "digest": fields.get("warc-payload-digest")}
        index.file.write(json.dumps(line).encode() + b"\n")
        at, n = at + len(member), n + 1
    out.done()
    index.done()
    return n


def _normalise(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column(0).to_pylist():
                target = f"{folder}/{uri.rpartition('/')[2].replace('whole-', 'records-')}"
                n = normalise(uri, target)
                yield pa.RecordBatch.from_pydict({"uri": [target], "records": [n]})

    return run


def _page_of(urn: str | None) -> int | None:
    x = (urn or "").strip("<>").rpartition(":")[2]
    return int(x) if x.lstrip("-").isdigit() else None


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Archives -> their records, each fetched by the offset and length of the index and checked against it."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    for b in batches:
        for uri in b.column(0).to_pylist():
            fs, path = _fs(uri)
            held: list[tuple] = []
            with fs.open_input_stream(path + ".idx", buffer_size=BUFFER) as idx, fs.open_input_file(path) as f:
                import io

                for line in io.TextIOWrapper(idx, encoding="utf-8"):
                    entry = json.loads(line)
                    f.seek(entry["offset"])
                    fields, whole = next(records(iter([zlib.decompress(f.read(entry["length"]), GZIP)])))
                    body = whole[len(whole) - int(fields["content-length"]) :]
                    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha256:")
                    if fields["warc-record-id"] != entry["id"] or (kind == "response" and hashlib.sha256(body).hexdigest() != digest):
                        raise ValueError(f"{uri} doesn't hold the record its index names at {entry['offset']}")
                    held.append((_page_of(fields["warc-record-id"]), int(fields["warc-x-payload-length"]), digest, kind, _page_of(fields.get("warc-refers-to"))))
                    if len(held) >= 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), types, strict=True)], names=names)
                        held = []
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), types, strict=True)], names=names)


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """Write a record for every row and normalise the archives; returns (uri, records) of the normalised archives.

    Of equal payloads of at least `least` bytes, the row with the smallest id is the response and the others revisit it.
    """
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    if folder.startswith("/"):
        folder = "file://" + folder
    fs, path = _fs(folder)
    fs.create_dir(path, recursive=True)
    drop_at_exit(spark, folder)
    html = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    large = F.octet_length("payload") >= least
    # the classes of equal payloads: counted on digests alone, with map-side combine
    twice = rows.where(large).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    twice = materialize(twice.select(F.col("digest").alias("d"), "first"), "twice")
    first = F.col("first")
    revisit = F.coalesce(first.isNotNull() & large & (F.col("page_id") != first), F.lit(False))
    null_copy = F.col("page_id").isNull() & large & first.isNotNull()
    joined = rows.join(twice, (rows["digest"] == twice["d"]) & large, "left")
    kind = F.when(revisit | null_copy, "revisit").otherwise("response")
    ready = joined.select("page_id", "url", "payload", "digest", kind.alias("kind"), F.when(kind == "revisit", first).alias("refers_to"))
    whole = materialize(ready.mapInArrow(_write(folder), "uri string, records long"), "wholes")
    # an archive is a unit of work, so their list is dealt out one by one
    n = max(1, whole.count())
    listed = whole.select("uri").repartition(n)
    return materialize(listed.mapInArrow(_normalise(folder), "uri string, records long"), "archives")


def read_archives(archives: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record of the archives at `uri`."""
    n = max(1, archives.count())
    return archives.select("uri").repartition(n).mapInArrow(_read_back, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def warc_roundtrip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write every page as a WARC record, normalise, read all back: one row per row of pages.

    Defined cases: null or empty html is an empty payload and a response; payloads under 100 bytes are all responses; a
    null url is empty; of rows that repeat with the same smallest id all are responses; a row with a null id revisits
    where its payload has an id elsewhere and is a response otherwise; an empty table gives an empty result.
    """
    return read_archives(write_archives(pages, id_col, url_col, html_col))


def op10_warc(spark, sf_dir: str) -> DataFrame:
    from skein.session import table

    return warc_roundtrip(table(spark, sf_dir, "pages"))


OP10_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), q AS (
  SELECT page_id, octet_length(payload) AS n, sha256(payload) AS d FROM p
), f AS (
  SELECT d, min(page_id) AS first FROM q WHERE n >= 100 GROUP BY d HAVING count(*) > 1
)
SELECT q.page_id, CAST(q.n AS BIGINT) AS payload_bytes, q.d AS payload_digest,
  CASE WHEN q.n >= 100 AND f.first IS NOT NULL AND q.page_id <> f.first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN q.n >= 100 AND f.first IS NOT NULL AND q.page_id <> f.first THEN f.first END AS refers_to
FROM q LEFT JOIN f ON q.d = f.d
"""

"""Operator 10: WARC archives, and a normaliser for archives that are one gzip stream.

- `write_archives` writes pages as WARC files that are one gzip member from end to end, a file a task.
- `normalise` inflates each such file once, as a stream, writes every record as a gzip member of its own, and a sidecar
  index of where each begins. Memory is bounded by a block, not by a record or a file.
- `read_records` reads records by the index, each by its own offset.

Payloads that repeat are stored once: of records with equal payloads of at least REVISIT_BYTES bytes, that with the
largest page_id is the response and the others are `revisit` records that name it.

Files are written under a name of the attempt and renamed, so a task that runs twice leaves one file.

Edge cases: a null html is an empty payload; a null url is left out of the record; a null page_id is never the largest
(if all are null, all are responses); rows that repeat the largest page_id are all responses; no pages give no files and
an empty result; a file that ends inside a record or is no gzip is an error that names it. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Tables, join_checked, new_path

REVISIT_BYTES = 1000
DATE = "2024-01-01T00:00:00Z"
BLOCK = 1 << 20
INDEX = "file string, offset long, length long, record_type string, page_id long, refers_to long, uri string"


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if re.match(r"\w+:/", uri) else f"file://{uri}")


def _urn(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def _base32(digest: str) -> str:
    return base64.b32encode(bytes.fromhex(digest)).decode()


def _record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record. The block is an HTTP response; a revisit's has the header only."""
    first = refers_to is None
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + (payload if first else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if first else 'revisit'}", f"WARC-Record-ID: {_urn(page_id, digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha1:{_base32(digest)}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if not first:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


class _Output:
    """A file that appears under its name only when it is whole."""

    def __init__(self, uri: str):
        self.fs, self.goal = _open(uri)
        self.fs.create_dir(self.goal.rpartition("/")[0], recursive=True)
        self.attempt = f"{self.goal}.{uuid.uuid4().hex}.tmp"
        self.out, self.at = self.fs.open_output_stream(self.attempt, compression=None), 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def done(self) -> None:
        self.out.close()
        self.fs.move(self.attempt, self.goal)


def with_revisits(pages: DataFrame, t: Tables) -> DataFrame:
    """page_id, url, html -> page_id, url, payload, digest, refers_to."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    long = F.octet_length("payload") >= REVISIT_BYTES
    again = t.put(rows.where(long).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("largest")).where("n > 1 AND largest IS NOT NULL").select("digest", "largest"), "again")
    return join_checked(rows, again, ["digest"], "left").withColumn("refers_to", F.when(long & ~F.col("page_id").eqNullSafe(F.col("largest")), F.col("largest"))).drop("largest")


def write_archives(rows: DataFrame, folder: str) -> list[str]:
    """page_id, url, payload, digest, refers_to -> the files' names. Each is one gzip member over all its records."""

    def write(batches):
        out, name = None, f"{folder}/{uuid.uuid4().hex}.warc.gz"
        deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
                out = out or _Output(name)
                out.write(deflate.compress(_record(*r)))
        if out:
            out.write(deflate.flush())
            out.done()
            yield pa.RecordBatch.from_arrays([pa.array([name])], ["file"])

    made = rows.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(write, "file string")
    return [r["file"] for r in made.collect()]  # one name a task; files of attempts that failed are not among them


def _inflated(uri: str) -> Iterator[bytes]:
    """A gzip file's bytes in blocks; members may follow one another."""
    fs, path = _open(uri)
    inflate, fresh = zlib.decompressobj(31), True
    with fs.open_input_stream(path, compression=None) as f:
        while data := f.read(BLOCK):
            while data:
                fresh = False
                try:
                    if part := inflate.decompress(data, BLOCK):
                        yield part
                except zlib.error as e:
                    raise ValueError(f"{uri} is not a gzip file of WARC records: {e}") from e
                data = inflate.unconsumed_tail
                if inflate.eof:
                    data, inflate, fresh = inflate.unused_data, zlib.decompressobj(31), True
    while not fresh and (part := inflate.decompress(b"", BLOCK)):  # what the limit held back
        yield part
    if not fresh and not inflate.eof:
        raise ValueError(f"{uri} ends inside a gzip member")


def _headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def _rewrite(source: str, goal: str) -> list[tuple]:
    """Writes every record of `source` as a member of `goal` and beside it `goal`.idx; returns the index rows."""
    out, rows, have, blocks = _Output(goal), [], bytearray(), _inflated(source)

    def more() -> None:
        part = next(blocks, None)
        if part is None:
            raise ValueError(f"{source} ends inside a record")
        have.extend(part)

    for part in blocks:
        have.extend(part)
        while have:
            while (end := have.find(b"\r\n\r\n")) < 0:
                more()
            if not have.startswith(b"WARC/"):
                raise ValueError(f"{source} has bytes that are no WARC record: {bytes(have[:20])!r}")
            head = _headers(bytes(have[:end]))
            left, begin = end + 4 + int(head["content-length"]) + 4, out.at
            deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
            while left:
                if not have:
                    more()
                out.write(deflate.compress(bytes(have[:left])))
                taken = min(left, len(have))
                del have[:taken]
                left -= taken
            out.write(deflate.flush())
            page, refers = head.get("x-page-id"), head.get("x-refers-to-page-id")
            rows.append((goal, begin, out.at - begin, head["warc-type"], int(page) if page else None, int(refers) if refers else None, head.get("warc-target-uri")))
    out.done()
    index = _Output(f"{goal}.idx")
    index.write("".join("\t".join("" if x is None else str(x) for x in r[1:]) + "\n" for r in rows).encode())
    index.done()
    return rows


def _index_batches(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    names = [x.split()[0] for x in INDEX.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), types, strict=True)], names)


def normalise(spark: SparkSession, files: list[str], folder: str) -> DataFrame:
    """One-stream archives -> archives of a member a record in `folder`, with sidecars; returns the index. The work is
    done as the index is written; a task's file is named after its source, so a second attempt replaces it."""

    def rewrite(batches):
        for batch in batches:
            for f in batch.column("file").to_pylist():
                rows = _rewrite(f, f"{folder}/{f.rsplit('/', 1)[1]}")
                for i in range(0, len(rows), 10_000):
                    yield _index_batches(rows[i : i + 10_000])

    listed = spark.createDataFrame([(f,) for f in files], "file string")
    return Tables(spark, "warc").put(listed.repartition(max(1, len(files))).mapInArrow(rewrite, INDEX), "index")


def read_records(index: DataFrame) -> DataFrame:
    """Index rows -> page_id, payload, payload_bytes, payload_digest, record_type, refers_to; each from its own member.
    A revisit's payload is null; its size and digest are those of the payload that it refers to."""

    def read(batches):
        file, name = None, None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["file"] != name:
                    if file:
                        file.close()
                    fs, path = _open(r["file"])
                    file, name = fs.open_input_file(path), r["file"]
                file.seek(r["offset"])
                raw = zlib.decompress(file.read(r["length"]), 31)
                head, _, block = raw.partition(b"\r\n\r\n")
                http, _, payload = block[:-4].partition(b"\r\n\r\n")
                fields, size = _headers(head), int(_headers(http)["content-length"])
                told = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                if fields["warc-type"] == "revisit":
                    payload = None
                elif len(payload) != size or hashlib.sha1(payload).hexdigest() != told:
                    raise ValueError(f"the record at {r['offset']} of {name} does not have the payload that it tells")
                out.append((r["page_id"], payload, size, told, fields["warc-type"], r["refers_to"]))
            if out:
                types = [pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), types, strict=True)], ["page_id", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"])
        if file:
            file.close()

    return index.select("file", "offset", "length", "page_id", "refers_to").mapInArrow(read, "page_id long, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op10(spark, sf_dir: str) -> DataFrame:
    t, folder = Tables(spark, "warc"), new_path(spark, "archives")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    files = write_archives(with_revisits(pages, t), f"{folder}/whole")
    return read_records(normalise(spark, files, f"{folder}/records")).drop("payload")


OP10_SQL = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, CASE WHEN payload_bytes >= {REVISIT_BYTES} THEN max(page_id) OVER (PARTITION BY payload_digest) END AS largest FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN largest IS DISTINCT FROM page_id AND largest IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN largest IS DISTINCT FROM page_id THEN largest END AS refers_to
FROM m
"""

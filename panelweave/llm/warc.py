"""WARC archives: a writer with revisit records and a splittable reader.

Every record is a gzip member of its own. Readers get byte ranges; a task looks
for gzip's magic in its range, takes a candidate for a record only if it
inflates to a whole WARC record with a valid header, and owns the records that
start inside, reading past its range's end to finish the last one. Archives lie
in the shared folder; a task writes under a name of its own, and only files
that a finished task reported are read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.shared import column, materialize, pieces, shared_dir, ship

MIN_REVISIT, LEVEL, ARCHIVE_BYTES, RANGE_BYTES, READ = 1000, 3, 64 << 20, 4 << 20, 1 << 18
#: Tasks over which the pages of one digest are dealt; ranges that a reading task gets where there are very many.
SALT, RANGES = 16, 16
MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, bytes long, records long"
RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One gzip member. A revisit has no payload, only its digest and length."""
    head = {"WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>", "WARC-Target-URI": (url or "").replace("\r", "%0D").replace("\n", "%0A"), "WARC-Date": "1970-01-01T00:00:00Z", "WARC-Payload-Digest": f"sha1:{digest}", "X-Payload-Length": str(len(payload))}
    if refers_to is None:
        head["WARC-Type"] = "response"
    else:
        head |= {"WARC-Type": "revisit", "WARC-Profile": PROFILE, "WARC-Refers-To": f"<urn:page:{refers_to}>"}
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (payload if refers_to is None else b"")
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    lines = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    packed = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packed.compress(lines.encode() + block + b"\r\n\r\n") + packed.flush()


def parse(data: bytes) -> tuple[dict[str, str], bytes] | None:
    """Headers and block of one record, or None if ``data`` isn't exactly that."""
    head, found, rest = data.partition(b"\r\n\r\n")
    if not found or not head.startswith(b"WARC/1."):
        return None
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in x)
    size = fields.get("Content-Length", "")
    if not size.isdigit() or "WARC-Type" not in fields or rest[int(size) :] != b"\r\n\r\n":
        return None
    return fields, rest[: int(size)]


def member_at(data: bytearray, at: int, more) -> tuple[tuple[dict[str, str], bytes], int] | None:
    """The record whose member starts at ``at``, and where it ends; ``more()`` appends what follows to ``data``."""
    inflate, out, pos = zlib.decompressobj(31), [], at
    try:
        while not inflate.eof:
            if pos == len(data) and not more():
                return None
            part = bytes(data[pos : pos + READ])
            out.append(inflate.decompress(part))
            pos += len(part)
            if len(out) == 1 and not out[0].startswith(b"WARC/1."[: len(out[0])]):
                return None
    except zlib.error:
        return None
    found = parse(b"".join(out))
    return found and (found, pos - len(inflate.unused_data))


def scan(read, lo: int, hi: int, size: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records that start in ``[lo, hi)``; ``read(n, at)`` gives bytes of the archive."""
    data = bytearray(read(min(hi + len(MAGIC) - 1, size) - lo, lo))

    def more() -> int:
        new = read(min(READ, size - lo - len(data)), lo + len(data)) if lo + len(data) < size else b""
        data.extend(new)
        return len(new)

    at = data.find(MAGIC)
    while 0 <= at < hi - lo:
        found = member_at(data, at, more)
        if found:
            yield found[0]
        at = data.find(MAGIC, found[1] if found else at + 1)


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    out, name, size, n = None, "", 0, 0

    def done() -> pa.RecordBatch:
        out.close()
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size]), pa.array([n])], names=["path", "bytes", "records"])

    for batch in pieces(batches, "html"):
        for page_id, url, html, digest, refers_to in zip(*(column(batch, x) for x in ("page_id", "url", "html", "digest", "refers_to"))):
            if out is None:
                name, size, n = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                out = store.open_output_stream(f"{root}/{name.rsplit("/", 1)[1]}", compression=None)
            made = record(page_id, url, (html or "").encode(), digest, refers_to)
            out.write(made)
            size, n = size + len(made), n + 1
            if size >= ARCHIVE_BYTES:
                yield done()
                out = None
    if out is not None:
        yield done()


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = lambda x: int(x) if (x := x.removeprefix("<urn:page:").rstrip(">")) else None
    for batch in batches:
        for path, lo, hi, size in zip(*(column(batch, x) for x in ("path", "lo", "hi", "bytes"))):
            store, name = fs.FileSystem.from_uri(path)
            rows = []
            with store.open_input_file(name) as f:
                for head, block in scan(f.read_at, lo, hi, size):
                    payload = block.partition(b"\r\n\r\n")[2]
                    own = head["WARC-Type"] == "response"
                    digest = hashlib.sha1(payload).hexdigest() if own else head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if head["WARC-Payload-Digest"] != f"sha1:{digest}":
                        raise ValueError(f"{path}: payload and digest differ in {head['WARC-Record-ID']}")
                    refers = None if own else number(head["WARC-Refers-To"])
                    rows.append((number(head["WARC-Record-ID"]), len(payload) if own else int(head["X-Payload-Length"]), digest, head["WARC-Type"], refers, head["WARC-Target-URI"]))
            if rows:
                types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=[x.split()[0] for x in RESULT.split(", ")])


def write_archives(pages: DataFrame) -> DataFrame:
    """Writes a record per row and returns the manifest: path, bytes, records.

    Of rows with equal payloads of at least ``MIN_REVISIT`` bytes the largest
    page_id gets the response and the others revisit it; if that page_id is
    repeated, each of its rows is a response. Null html is an empty payload;
    a row with a null page_id revisits like any other and is never referred to.
    """
    spark = pages.sparkSession
    ship(spark)
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), html.alias("html"), F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).alias("size"))
    same = rows.where(F.col("size") >= MIN_REVISIT).groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").drop("n")
    refers = F.when((F.col("size") >= MIN_REVISIT) & ~F.col("page_id").eqNullSafe(F.col("last")), F.col("last"))
    # only payloads that may be revisited are shuffled, those of one digest over SALT tasks
    salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALT)).cast("int")
    same = same.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    columns = ["page_id", "url", "html", "digest"]
    large = rows.where(F.col("size") >= MIN_REVISIT).withColumn("salt", salt).join(same, ["digest", "salt"], "left")
    small = rows.where(F.col("size") < MIN_REVISIT).select(*columns, F.lit(None).cast("long").alias("refers_to"))
    dealt = large.select(*columns, refers.alias("refers_to")).unionByName(small)
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    return materialize(dealt.mapInArrow(partial(_write, folder=folder), MANIFEST), "warc-manifest")


def read_archives(manifest: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and url of every record, read range by range."""
    ship(manifest.sparkSession)
    ranges = manifest.withColumn("lo", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long"))))
    ranges = ranges.select("path", "lo", F.least(F.col("lo") + range_bytes, "bytes").alias("hi"), "bytes")
    # a number of tasks by the archives' bytes: the ranges themselves are a few bytes, which would all be joined to one task
    n = manifest.agg(F.sum(F.ceil(F.col("bytes") / range_bytes))).first()[0] or 1
    ranges = ranges.repartition(max(1, min(int(n), max(int(n) // RANGES, 4 * manifest.sparkSession.sparkContext.defaultParallelism))), "path", "lo")
    return ranges.mapInArrow(_read, RESULT)

"""WARC archives with an index (operator 5).

Each task writes its records to an archive of its own, one gzip member for each
record, and gives the index rows: file, offset, length, URL, digest. A repeated
task writes a new file, and only rows of finished tasks are in the index, so
files of lost attempts are never read. Reading begins with the index: the rows
asked for are range-partitioned and sorted by file and offset, neighbouring
ranges are read at once, and each record is checked against its digest.

Archives go through pyarrow's file systems (local and shared folders, HDFS,
object stores), by the address of the shared folder.

Edge cases: null html counts as empty; a null URL is left out of the record;
rows equal in page_id and payload are all responses if that page_id is the
smallest of its payload; a null page_id is smallest only if there is no other.
Identifiers and URLs of any characters are escaped. An empty table gives an
empty index; only page_id, url and html are read, so further columns may have
any name.
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
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import new_path, stored

_INDEX = "file string, offset long, length long, url string, digest string"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def plan_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload and refers_to (null for responses) of every page.

    Payloads of ``least_bytes`` or more that equal that of a page with a smaller page_id are revisits. Equal means equal
    in length and SHA-256. Payloads that over a thousandth of all repeated pages have, fewer than a thousand of them, are
    broadcast, so that no task takes all pages of one payload; the others are joined by digest."""
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    size = F.octet_length("payload")
    pages = pages.withColumn("sha", F.concat_ws("-", F.sha2(F.col("payload").cast("binary"), 256), size.cast("string")))
    first = stored(pages.groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 AND first IS NOT NULL"), "warc-copies")
    rows = first.agg(F.sum("n")).first()[0] or 0
    often = first.filter(F.col("n") > rows / 1000).select("sha", F.col("first").alias("often"))
    rest = first.filter(F.col("n") <= rows / 1000).select("sha", "first")
    met = pages.join(F.broadcast(often), "sha", "left")
    again = lambda of: F.when(~F.col("page_id").eqNullSafe(of) & (F.octet_length("payload") >= least_bytes), of)
    hot = met.filter("often IS NOT NULL").select("page_id", "url", "payload", again(F.col("often")).alias("refers_to"))
    others = met.filter("often IS NULL").join(rest, "sha", "left")
    return hot.unionByName(others.select("page_id", "url", "payload", F.when(F.col("first").isNotNull(), again(F.col("first"))).alias("refers_to")))


def urn(page_id: object) -> str:
    """A record's name; all but letters, digits and some signs are escaped, so that any identifier keeps to its line."""
    return "<urn:no-page>" if page_id is None else f"<urn:page:{quote(str(page_id), safe='')}>"


def record(page_id: object, url: str | None, payload: bytes, refers_to: object, date: str) -> tuple[bytes, str]:
    """A record's bytes, not compressed, and its payload's digest."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {urn(page_id)}", f"WARC-Date: {date}",
        *([] if url is None else ["WARC-Target-URI: " + _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url)]), f"WARC-Payload-Digest: sha1:{digest}",
        *([] if refers_to is None else [f"WARC-Refers-To: {urn(refers_to)}", f"WARC-Profile: {_PROFILE}"]),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", digest


def write_archives(planned: DataFrame, folder: str, date: str = "2020-01-01T00:00:00Z", most_bytes: int = 1 << 30, level: int = 3) -> DataFrame:
    """Write the records below ``folder``; the index: page_id, file, offset, length, url, digest."""
    kind = planned.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        out, name, at, number = None, "", 0, 0
        try:
            for batch in batches:
                rows: list[tuple] = []
                for page_id, url, payload, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to")), strict=True):
                    if out is None or at >= most_bytes:
                        if out is not None:
                            out.close()
                        name = f"part-{TaskContext.get().partitionId():05d}-{number:03d}-{uuid.uuid4().hex}.warc.gz"
                        out, at, number = store.open_output_stream(f"{root}/{name}", compression=None), 0, number + 1
                    raw, digest = record(page_id, url, payload.encode(), refers_to, date)
                    packer = zlib.compressobj(level, wbits=31)
                    raw = packer.compress(raw) + packer.flush()
                    out.write(raw)
                    rows.append((name, at, len(raw), url, digest))
                    at += len(raw)
                names = ["file", "offset", "length", "url", "digest"]
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                cols = zip(*rows, strict=True) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), *(pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True))], names=["page_id", *names])
        finally:
            if out is not None:
                out.close()

    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    return stored(planned.mapInArrow(run, f"page_id {kind}, {_INDEX}"), "warc-index")


def parse(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Header fields, HTTP header and payload of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in head.decode().split("\r\n")[1:])}
    http, _, payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")
    return fields, http, payload


def read_records(index: DataFrame, folder: str, most_gap: int = 64 << 10, most_read: int = 8 << 20, partitions: int | None = None, with_payload: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (and payload) of the records of ``index``."""
    id_type = index.schema["page_id"].dataType
    whole = index.agg(F.sum("length")).first()[0] or 0
    n = partitions or max(1, int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-whole // (64 << 20)))
    rows = index.select("page_id", "file", "offset", "length", "digest").repartitionByRange(n, "file", "offset").sortWithinPartitions("file", "offset")
    schema = T.StructType([
        T.StructField("page_id", id_type), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()),
        T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.StringType()), *([T.StructField("payload", T.BinaryType())] * with_payload),
    ])

    def ranges(batch: pa.RecordBatch) -> Iterator[tuple[str, int, list[tuple[int, int, str]]]]:
        """Neighbouring records of a file, to be read at once."""
        name, begin, end, own = "", 0, 0, []
        for f, o, n, d in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length", "digest")), strict=True):
            if own and (f != name or o > end + most_gap or o + n - begin > most_read):
                yield name, begin, own
                own = []
            if not own:
                name, begin = f, o
            own.append((o, n, d))
            end = o + n
        if own:
            yield name, begin, own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            done = 0
            for name, begin, own in ranges(batch):
                with store.open_input_file(f"{root}/{name}") as f:
                    data = f.read_at(own[-1][0] + own[-1][1] - begin, begin)
                cols: list[list] = [[] for _ in range(5)]
                for offset, length, digest in own:
                    fields, http, payload = parse(zlib.decompress(data[offset - begin : offset - begin + length], wbits=31))
                    kind = fields["warc-type"]
                    given = fields["warc-payload-digest"].removeprefix("sha1:")
                    if given != digest or kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"{name}: the record at {offset} doesn't match its digest")
                    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                    refers = fields.get("warc-refers-to")
                    for c, v in zip(cols, (size, given, kind, refers and unquote(refers.removeprefix("<urn:page:").removesuffix(">")), payload), strict=True):
                        c.append(v)
                kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
                arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)][: 4 + with_payload]
                yield pa.RecordBatch.from_arrays([batch.column("page_id").slice(done, len(own)), *arrays], names=schema.names)
                done += len(own)

    return rows.mapInArrow(run, schema).withColumn("refers_to", F.col("refers_to").cast(id_type))


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write every page to archives in the shared folder and read all of them back."""
    folder = new_path(pages.sparkSession, "warc")
    return read_records(write_archives(plan_records(pages, least_bytes), folder), folder)

"""WARC archives with an index: write, then read selected records by coalesced byte ranges.

Each task writes the records of its partition to an archive of its own in the shared folder, one gzip member a record, and
returns a line of the index for each: archive, offset, length, URL, digest. Archives that no saved index names (of a lost or
repeated task) are never read. Payloads are written where they are read; only where more than ``MAX_BROADCAST`` payloads repeat, those that may be among them are shuffled to learn who holds
them.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.llm.common import bound_batches, fresh_path, join_few, materialise, shuffle_width

#: Payloads from this many bytes on are stored once.
LEAST_SHARED = 1000
#: Gaps up to this are read through, and up to so many bytes at a time.
GAP, SPAN = 1 << 16, 1 << 23
#: Repeated payloads up to this many are broadcast.
MAX_BROADCAST = 100_000

INDEX = "archive string, offset long, length long, page_id long, url string, payload_digest string, record_type string, refers_to long, payload_bytes long"


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    if re.match(r"file:/|/", uri):
        return pafs.LocalFileSystem(), re.sub(r"^file:/+", "/", uri)
    return pafs.FileSystem.from_uri(uri)


def record_urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. A revisit keeps the HTTP header, with the length of the payload that it leaves out."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if kind == "response":
        block += payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_urn(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.insert(3, "WARC-Target-URI: " + re.sub(r"[\r\n]+", " ", url))
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_urn(refers_to)}"]
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Header fields by lower-cased name, and the payload (of a revisit: empty) with the HTTP length it was announced with."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no WARC record here: {lines[0][:40]!r}")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("the record does not end where it should")
    http, _, payload = block.partition(b"\r\n\r\n")
    announced = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    return {"fields": fields, "payload": payload, "announced": announced}


def page_of(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:x-page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def write_archives(pages: DataFrame, folder: str, least_shared: int = LEAST_SHARED, most_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """Writes archives below ``folder`` and the index to ``folder/index``; returns the index.

    pages: page_id (integral), url, html; other columns are ignored. A null html is an empty payload. Of records with equal payloads of at least
    ``least_shared`` bytes, those with the largest page_id hold the payload and the others refer to it; rows that repeat that page_id and
    payload each hold it. Where all of them have a null page_id, all hold it.
    """
    spark = pages.sparkSession
    bound_batches(spark)
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    shared = rows.where(F.octet_length("payload") >= least_shared).groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("holder")).where("n > 1 and holder is not null")
    shared = shared.select(F.col("digest").alias("__digest"), "holder")
    shared = materialise(shared, "shared-payloads")
    rows = join_few(rows, shared, "digest", "__digest", most_broadcast).select("page_id", "url", "payload", "digest", "holder")
    fs, path = file_system(folder)
    fs.create_dir(path, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = file_system(folder)
        name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        out, at = None, 0
        names = [c.split()[0] for c in INDEX.split(", ")]
        for b in batches:
            lines = []
            for page, url, payload, digest, holder in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "holder")), strict=True):
                kind = "response" if holder is None or page == holder else "revisit"
                refers = holder if kind == "revisit" else None
                squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = squeeze.compress(record(page, url, payload, digest, kind, refers)) + squeeze.flush()
                out = out or fs.open_output_stream(f"{path}/{name}", compression=None)
                out.write(member)
                lines.append((name, at, len(member), page, url, digest, kind, refers, len(payload)))
                at += len(member)
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in lines], t) for i, t in enumerate(kinds)], names)
        if out:
            out.close()

    rows.mapInArrow(write, INDEX).write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def coalesced(ranges: list[tuple[int, int]], gap: int = GAP, span: int = SPAN) -> list[tuple[int, int, int, int]]:
    """(start, end, first, last) reads over sorted (offset, length) ranges, first..last being those a read serves."""
    out: list[list[int]] = []
    for i, (at, n) in enumerate(ranges):
        if out and at - out[-1][1] <= gap and max(at + n, out[-1][1]) - out[-1][0] <= span:
            out[-1][1], out[-1][3] = max(at + n, out[-1][1]), i
        else:
            out.append([at, at + n, i, i])
    return [tuple(x) for x in out]


def read_records(spark: SparkSession, folder: str, index: DataFrame) -> DataFrame:
    """page_id, url, record_type, refers_to, payload, payload_bytes, payload_digest of the records that ``index`` selects.

    Sorted by archive and offset, so each task reads whole stretches. A response's bytes are hashed and counted anew and must agree with its
    header; a revisit's are those its header announces.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = file_system(folder)
        for b in batches:
            archives, at, size = (b.column(c).to_pylist() for c in ("archive", "offset", "length"))
            i = 0
            while i < len(archives):
                j = i
                while j < len(archives) and archives[j] == archives[i]:
                    j += 1
                with fs.open_input_file(f"{path}/{archives[i]}") as file:
                    for start, end, first, last in coalesced(list(zip(at[i:j], size[i:j], strict=True))):
                        data, out = file.read_at(end - start, start), []
                        for x in range(i + first, i + last + 1):
                            found = parse(zlib.decompress(data[at[x] - start : at[x] - start + size[x]], 31))
                            f, kind = found["fields"], found["fields"]["warc-type"]
                            digest = f["warc-payload-digest"].removeprefix("sha1:")
                            if kind == "response" and (hashlib.sha1(found["payload"]).hexdigest() != digest or len(found["payload"]) != found["announced"]):
                                raise ValueError(f"{archives[x]} at {at[x]}: the payload does not match its digest")
                            out.append((page_of(f["warc-record-id"]), f.get("warc-target-uri"), kind, page_of(f.get("warc-refers-to")), found["payload"], found["announced"], digest))
                        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string()]
                        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], t) for n, t in enumerate(kinds)], ["page_id", "url", "record_type", "refers_to", "payload", "payload_bytes", "payload_digest"])
                i = j

    order = index.select("archive", "offset", "length").repartitionByRange(shuffle_width(spark), "archive", "offset").sortWithinPartitions("archive", "offset")
    return order.mapInArrow(read, "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string")


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes the pages to archives and reads every record back."""
    spark = pages.sparkSession
    folder = folder or fresh_path(spark, "warc")
    return read_records(spark, folder, write_archives(pages, folder))

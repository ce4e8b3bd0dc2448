"""WARC archives: written by tasks, indexed first, and read back by coalesced byte ranges.

Every record is a gzip member of its own. The index (file, offset, size, URL, digest and more) is a table of the records that
committed tasks wrote; a reader sorts what it selects by file and offset, joins neighbouring ranges into one read and never
looks at the rest of a file.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder
from .common import open_shared, slices, stored

#: Payloads of fewer bytes are never replaced by a revisit record.
LEAST_REVISIT = 100
#: A file is closed beyond this size; ranges are read together over gaps up to GAP and up to READ bytes.
FILE_BYTES, GAP, READ = 1 << 30, 64 << 10, 8 << 20
DATE = "1970-01-01T00:00:00Z"  # the pages carry no time of capture

_INDEX = ("file string, offset long, size long, url string, page_id long, payload_digest string, payload_bytes long, record_type string, "
          "refers_to long")


def plan_revisits(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """key, url, body, payload_digest, payload_bytes, refers_to.

    Of rows with equal payloads of LEAST_REVISIT bytes or more, those with the smallest key are responses and the others refer
    to it. A null payload is empty. Null keys are never referred to.
    """
    payload = F.coalesce(F.col(body), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).cast("bigint").alias("page_id"), F.col(url).alias("url"), F.col(body).alias("body"),
                        F.sha2(payload, 256).alias("payload_digest"), F.octet_length(payload).cast("bigint").alias("payload_bytes"))
    groups = rows.where(F.col("payload_bytes") >= LEAST_REVISIT).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("_n"))
    groups = stored(groups.where("_n > 1").select("payload_digest", "first"), "warc-revisits")
    joined = rows.join(groups, "payload_digest", "left")  # a hot digest is split by AQE, as both sides are shuffled for the join
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return joined.select("page_id", "url", "body", "payload_digest", "payload_bytes", refers.alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """One record: WARC headers and, for a response, the payload."""
    clean = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    block = b"" if refers_to is not None else payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}", f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}",
        "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head[4:4] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record here")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    size = int(fields["Content-Length"])
    if rest[size : size + 4] != b"\r\n\r\n":
        raise ValueError("a WARC record is cut short")
    return fields, rest[:size]


def _page(name: str) -> int | None:
    inner = name.removeprefix("<urn:page:").removesuffix(">")
    return int(inner) if inner else None


def write_archives(planned: DataFrame) -> DataFrame:
    """Write the rows of plan_revisits as archives in the shared folder; returns the index.

    Task attempts write files of their own names, and only committed tasks' records are in the index.
    """
    folder = shared_folder(planned.sparkSession, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sink, name, offset = None, "", 0
        try:
            for batch in batches:
                for part in slices(batch, "body", 1 << 22):
                    out = []
                    for r in part.to_pylist():
                        payload = (r["body"] or "").encode()
                        data = gzip.compress(record(r["page_id"], r["url"], payload, r["payload_digest"], r["payload_bytes"], r["refers_to"]), 5, mtime=0)
                        if sink is None or offset + len(data) > FILE_BYTES:
                            if sink is not None:
                                sink.close()
                            name, offset = f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0
                            sink = open_shared(name, write=True)
                        sink.write(data)
                        kind = "response" if r["refers_to"] is None else "revisit"
                        out.append((name, offset, len(data), r["url"], r["page_id"], r["payload_digest"], r["payload_bytes"], kind, r["refers_to"]))
                        offset += len(data)
                    columns = list(zip(*out))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)
        finally:
            if sink is not None:
                sink.close()

    names = [x.split()[0] for x in _INDEX.split(", ")]
    kinds = [pa.string() if x.endswith("string") else pa.int64() for x in _INDEX.split(", ")]
    return stored(planned.mapInArrow(write, _INDEX), "warc-index")


def _ranges(rows: list[dict]) -> Iterator[list[dict]]:
    """Runs of rows of one file, near enough to be read together."""
    run: list[dict] = []
    for r in rows:
        if run and (r["file"] != run[0]["file"] or r["offset"] - (run[-1]["offset"] + run[-1]["size"]) > GAP
                    or r["offset"] + r["size"] - run[0]["offset"] > READ):
            yield run
            run = []
        run.append(r)
    if run:
        yield run


def read_records(selected: DataFrame, bodies: bool = False) -> DataFrame:
    """Read the index rows of ``selected`` back, and check every payload against its digest.

    Returns page_id, url, payload_bytes, payload_digest, record_type, refers_to (and the response payloads if ``bodies``), all
    as the records have them.
    """
    spark = selected.sparkSession
    rows = selected.select("file", "offset", "size").repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "file", "offset")
    rows = rows.sortWithinPartitions("file", "offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, name = None, None
        for batch in batches:
            for run in _ranges(batch.to_pylist()):
                if run[0]["file"] != name:
                    if source is not None:
                        source.close()
                    name = run[0]["file"]
                    source = open_shared(name)
                start = run[0]["offset"]
                data = source.read_at(run[-1]["offset"] + run[-1]["size"] - start, start)
                out = []
                for r in run:
                    at = r["offset"] - start
                    fields, block = parse(zlib.decompress(data[at : at + r["size"]], wbits=31))
                    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"]
                    if kind == "response" and hashlib.sha256(block).hexdigest() != digest:
                        raise ValueError(f"damaged payload in {name} at {r['offset']}")
                    refers = _page(fields["WARC-Refers-To"]) if kind == "revisit" else None
                    out.append((_page(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], int(fields["X-Payload-Length"]), digest, kind, refers,
                                *([block.decode() if kind == "response" else None] if bodies else [])))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)
        if source is not None:
            source.close()

    shape = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", body string" * bodies
    names = [x.split()[0] for x in shape.split(", ")]
    kinds = [pa.string() if x.endswith("string") else pa.int64() for x in shape.split(", ")]
    return rows.mapInArrow(read, shape)


def archive(pages: DataFrame) -> DataFrame:
    """Write all pages and return the index. An empty table gives an empty index; repeated keys are records of their own."""
    return write_archives(plan_revisits(pages))

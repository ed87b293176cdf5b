"""WARC archives: a deterministic sharded writer, and a reader.

1. Payload digests decide what is written whole. Of equal payloads of at least
   ``REVISIT_BYTES`` bytes the one of the smallest page id is a response, the others are
   revisit records that refer to it. Digests alone are grouped, never payloads; a
   group of copies is one row of the aggregate, whatever its size.
2. Records are range-sorted by (page id, input order). Decisions travel as rows of
   their own and meet their page in the sorted partition, so payloads are
   exchanged once.
3. Each partition rolls files by compressed size. Every record is a gzip member
   with regenerated headers: lengths, block and payload digests, record ids derived
   from the page, and a fixed date, so equal input gives equal files. Files get their
   name only when complete, and are listed in a manifest table that is
   committed after them; files that no manifest lists are not part of an archive.

Defined cases: null html is the empty payload; a null url leaves out the target URI, and
bytes that a header can't hold are percent-encoded; a null page id is larger than any
other, so it is a response only if its copies have null ids too; repeated rows
are records of their own: the first in the input's order is the response, and
rows that repeat its page id revisit it as well; an empty table writes no file;
other columns are left out.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

REVISIT_BYTES = 100
#: Compressed bytes after which a new file is begun, and input bytes of a partition.
ROLL_BYTES, PARTITION_BYTES = 64 << 20, 32 << 20
#: Bytes that are decompressed at once.
WINDOW = 16 << 10
#: Every record's date, so that archives depend on their input alone.
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:keyloom:warc")
_UNSAFE = re.compile(r"[^\x21-\x7e]")


def record_id(page_id: int | None, row: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}/{row}')}>"


def _uri(url: str) -> str:
    return _UNSAFE.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode("utf-8")), url)


def _member(head: list[tuple[str, str]], block: bytes) -> bytes:
    """A record as a gzip member without a time stamp."""
    lines = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + f"Content-Length: {len(block)}\r\n\r\n"
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(lines.encode("utf-8") + block + b"\r\n\r\n") + c.flush()


def _http(n: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()


def record(page_id: int | None, row: int, url: str | None, payload: bytes, refers: tuple | None) -> bytes:
    """A response, or a revisit of ``refers`` (page id, row, url)."""
    digest = hashlib.sha256(payload).hexdigest()
    block = _http(len(payload)) + (b"" if refers else payload)
    head = [("WARC-Type", "revisit" if refers else "response"), ("WARC-Record-ID", record_id(page_id, row)), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", _uri(url)))
    if page_id is not None:
        head.append(("X-Page-ID", str(page_id)))
    if refers:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers[0], refers[1])), ("WARC-Refers-To-Date", DATE)]
        if refers[2] is not None:
            head.append(("WARC-Refers-To-Target-URI", _uri(refers[2])))
        if refers[0] is not None:
            head.append(("X-Refers-To-Page-ID", str(refers[0])))
    head += [("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Type", "application/http; msgtype=response")]
    return _member(head, block)


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of the gzip members of a file; lengths and block digests are verified."""
    view, at = memoryview(data), 0
    while at < len(view):
        d, parts = zlib.decompressobj(31), []
        while not d.eof:
            # a window at a time: what lies behind the member is handed back as a copy
            window = view[at : at + WINDOW]
            if not window:
                raise ValueError("the last record is cut off")
            parts.append(d.decompress(window))
            at += len(window) - len(d.unused_data)
        raw = b"".join(parts)
        top, _, rest = raw.partition(b"\r\n\r\n")
        lines = top.decode("utf-8").split("\r\n")
        head = dict(x.split(": ", 1) for x in lines[1:])
        block = rest[: int(head["Content-Length"])]
        if lines[0] != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n" or head["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
            raise ValueError(f"broken record {head.get('WARC-Record-ID')}")
        yield head, block


def decisions(pages: DataFrame) -> DataFrame:
    """(page_id, row, ref_id, ref_row, ref_url) of the rows that revisit another; pages: page_id, row, url, payload."""
    keys = pages.select("page_id", "row", "url", F.octet_length("payload").alias("n"), F.sha2("payload", 256).alias("sha")).where(F.col("n") >= REVISIT_BYTES)
    keys = common.materialize(keys)
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row", "url")).alias("first")
    groups = keys.groupBy("n", "sha").agg(first, F.count("*").alias("copies")).where("copies > 1").select("n", "sha", "first", "copies")
    return common.join_spread(keys, common.materialize(groups), ["n", "sha"], "copies").where("row <> first.row").select(
        "page_id", "row", F.col("first.page_id").alias("ref_id"), F.col("first.row").alias("ref_row"), F.col("first.url").alias("ref_url")
    )


_MANIFEST = pa.schema([("name", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])


def write_warc(pages: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write the archive of ``pages`` to ``folder`` and return its manifest: name, records, bytes, sha256."""
    common.tune(pages.sparkSession)
    got = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.monotonically_increasing_id().alias("row"),
        F.col(url_col).cast("string").alias("url"), common.text_of(html_col).cast("binary").alias("payload"),
    )
    seen = common.materialize(decisions(got))
    none = lambda kind: F.lit(None).cast(kind)
    told = seen.select("page_id", "row", F.lit(0).alias("kind"), F.col("ref_url").alias("url"), none("binary").alias("payload"), "ref_id", "ref_row")
    rows = got.select("page_id", "row", F.lit(1).alias("kind"), "url", "payload", none("long").alias("ref_id"), none("long").alias("ref_row"))
    parts = common.partitions_for(pages, PARTITION_BYTES)
    ordered = told.union(rows).repartitionByRange(parts, "page_id", "row").sortWithinPartitions("page_id", "row", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pa.RecordBatch:
            data = b"".join(held)
            name = f"part-{part:06d}-{seq:05d}.warc.gz"
            common.put_file(folder, name, data)
            return pa.RecordBatch.from_pydict({"name": [name], "records": [len(held)], "bytes": [len(data)], "sha256": [hashlib.sha256(data).hexdigest()]}, _MANIFEST)

        refers = None
        for b in batches:
            for page_id, row, kind, url, payload, ref_id, ref_row in zip(*(c.to_pylist() for c in b.columns)):
                if not kind:
                    refers = (ref_id, ref_row, url)
                    continue
                held.append(record(page_id, row, url, payload, refers))
                refers = None
                size += len(held[-1])
                if size >= roll_bytes:
                    yield flush()
                    held, size, seq = [], 0, seq + 1
        if held:
            yield flush()

    return common.materialize(ordered.mapInArrow(run, "name string, records bigint, bytes bigint, sha256 string"), f"{folder}/manifest")


def read_warc(manifest: DataFrame, folder: str) -> DataFrame:
    """(page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload) of every record that the manifest lists.

    The payload of a revisit is null: it stands in the record it refers to. Digests are
    recomputed where there is a payload, and files are held against the manifest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]
        )
        for b in batches:
            for name, sha in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                data = common.get_file(folder, name)
                if hashlib.sha256(data).hexdigest() != sha:
                    raise ValueError(f"{name} isn't the file that the manifest lists")
                out, size = [], 0
                for head, block in records(data):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    n = int(re.search(rb"Content-Length: (\d+)", http)[1])
                    digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                    whole = head["WARC-Type"] == "response"
                    if whole and (len(payload) != n or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"broken payload of {head['WARC-Record-ID']}")
                    as_id = lambda k: int(head[k]) if k in head else None  # noqa: E731,B023
                    out.append((as_id("X-Page-ID"), head.get("WARC-Target-URI"), head["WARC-Type"], n, digest, as_id("X-Refers-To-Page-ID"), payload if whole else None))
                    size += len(payload)
                    if size >= 16 << 20 or len(out) >= common.BATCH_ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    count = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("name", "sha256").repartition(count, "name").mapInArrow(
        run, "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary"
    )


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.shared_dir(spark)
    manifest = write_warc(common.load(spark, sf_dir, "pages"), folder)
    return read_warc(manifest, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op6_warc": op6_warc}
ORACLES = {
    "op6_warc": """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body FROM pages
), d AS (
  SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest FROM p
), f AS (
  SELECT *, row_number() OVER w AS place, first_value(page_id) OVER w AS first
  FROM d WINDOW w AS (PARTITION BY payload_digest ORDER BY page_id NULLS LAST)
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND place > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND place > 1 THEN first END AS refers_to
FROM f
"""
}

"""WARC archives as seekable Zstandard bundles.

Records are grouped into frames of about ``frame_bytes``; every frame is compressed on its
own, and a bundle of about ``bundle_bytes`` ends with the seek table of the Zstandard
seekable format (a skippable frame with the sizes of all frames). An index maps each
record id to bundle, frame and the record's offset in the unpacked frame, so that one
record costs one range read and one frame (``fetch``).

Payloads are deduplicated by SHA-1: of records with equal payloads of at least
``min_revisit_bytes`` bytes the one with the smallest page_id is a response, the others
are revisits that refer to it and carry no payload. The digests meet in a partial
aggregate (one row per digest and map task); a payload that a third of all pages share is
one hot join key over three narrow columns, which AQE splits. The html itself is moved
once, by page_id.

Rows: null html is an empty payload. Repeated rows of the smallest page_id are all
responses. A null page_id counts as larger than any other; a payload of only null ids has
responses only. An empty table writes no bundle and gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from payflow.llm.common import shared_folder
from payflow.llm.files import read_range, write_file

FRAME_BYTES = 256 * 1024
BUNDLE_BYTES = 32 * 1024 * 1024
MIN_REVISIT_BYTES = 0
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"       # pages carry no crawl time

#: Fixed values of the Zstandard seekable format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1

INDEX_SCHEMA = "page_id long, record_id string, bundle string, frame int, offset_in_frame int, record_bytes long"
RECORD_SCHEMA = ("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
                 "url string, bundle string, frame int, offset_in_frame int, payload binary")


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The skippable frame that lists (packed, unpacked) sizes and ends in the footer."""
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def frame_spans(bundle: bytes) -> list[tuple[int, int, int]]:
    """(start, packed size, unpacked size) of every frame, from the footer alone."""
    count, flags, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE_MAGIC or flags:
        raise ValueError("not a seekable bundle without checksums")
    at, out = 0, []
    for packed, size in struct.iter_unpack("<II", bundle[-9 - 8 * count:-9]):
        out.append((at, packed, size))
        at += packed
    return out


def record(page_id, url, payload: bytes, digest: str, refers_to) -> tuple[str, bytes]:
    """(record id, WARC/1.1 record). A revisit's block is empty; its payload length is a header."""
    record_id = f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}"
    revisit = refers_to is not None
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{record_id}>",
            f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if url is not None:
        head.append("WARC-Target-URI: " + " ".join(url.split()))
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"X-Refers-To-Page-ID: {refers_to}"]
    block = b"" if revisit else payload
    head.append(f"Content-Length: {len(block)}")
    return record_id, "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def records(frame: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of the records in an unpacked frame."""
    at = 0
    while at < len(frame):
        stop = frame.index(b"\r\n\r\n", at)
        lines = frame[at:stop].decode("utf-8", "surrogatepass").split("\r\n")
        head = dict(x.split(": ", 1) for x in lines[1:])
        n = int(head["Content-Length"])
        yield at, head, frame[stop + 4:stop + 4 + n]
        at = stop + 8 + n


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def roles(pages: DataFrame, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(page_id, digest, first_id): the revisits among the pages and the response each refers to."""
    html = F.coalesce("html", F.lit(""))
    seen = (pages.select("page_id", F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).alias("n"))
            .where(F.col("n") >= min_revisit_bytes))
    first = (seen.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
             .where("copies > 1").select("digest", "first_id"))
    return (seen.join(first, "digest").where("page_id IS NULL OR page_id > first_id").where("first_id IS NOT NULL")
            .select(F.col("page_id").alias("id"), "digest", "first_id").distinct())


def write_archives(pages: DataFrame, folder: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES,
                   min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write every page as a record below ``folder``/bundles and the index to ``folder``/index; returns the index."""
    job = uuid.uuid4().hex[:8]

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, packer = TaskContext.get().partitionId(), zstandard.ZstdCompressor(level=LEVEL)
        bundle = 0
        frame, packed, sizes, index = [], [], [], []
        held = stored_bytes = 0

        def end_frame() -> None:
            nonlocal held, stored_bytes
            data = b"".join(frame)
            packed.append(packer.compress(data))
            sizes.append((len(packed[-1]), len(data)))
            stored_bytes += len(packed[-1])
            frame.clear()
            held = 0

        def end_bundle() -> pd.DataFrame:
            nonlocal bundle, stored_bytes
            name = f"{job}-{task:06d}-{bundle:04d}.warc.zst"
            write_file(f"{folder}/bundles/{name}", b"".join(packed) + seek_table(sizes))
            out = pd.DataFrame(index, columns=["page_id", "record_id", "frame", "offset_in_frame", "record_bytes"])
            out["page_id"] = out["page_id"].astype("Int64")
            out.insert(2, "bundle", name)
            bundle += 1
            stored_bytes = 0
            for x in (packed, sizes, index):
                x.clear()
            return out

        for batch in batches:
            for page_id, url, html, first in zip(batch["page_id"], batch["url"], batch["html"], batch["first_id"]):
                page_id = None if pd.isna(page_id) else int(page_id)
                payload = (html or "").encode("utf-8", "surrogatepass")
                record_id, data = record(page_id, url, payload, sha1_base32(payload),
                                         None if pd.isna(first) else int(first))
                if held and held + len(data) > frame_bytes:
                    end_frame()
                    if stored_bytes >= bundle_bytes:
                        yield end_bundle()
                index.append((page_id, record_id, len(sizes), held, len(data)))
                frame.append(data)
                held += len(data)
        if frame:
            end_frame()
        if index:
            yield end_bundle()

    who = roles(pages, min_revisit_bytes)
    own = pages.select("page_id", "url", "html")
    plain = F.sha1(F.coalesce("html", F.lit("")).cast("binary")) == F.col("digest")
    rows = (own.join(who, F.col("page_id").eqNullSafe(F.col("id")) & plain, "left")
            .select("page_id", "url", "html", "first_id").sortWithinPartitions("page_id", "url", "html"))
    rows.mapInPandas(write, INDEX_SCHEMA).write.parquet(f"{folder}/index")
    return pages.sparkSession.read.schema(INDEX_SCHEMA).parquet(f"{folder}/index")


def read_archives(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """One row per record of all bundles below ``folder`` (``payloads`` adds the blocks). The
    digest of every response is computed anew and must be the one in its header."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                for k, (at, packed, size) in enumerate(frame_spans(content)):
                    data = unpack.decompress(content[at:at + packed], max_output_size=size)
                    yield pd.DataFrame([row(path, k, *r) for r in records(data)], columns=names).astype(
                        {"page_id": "Int64", "refers_to": "Int64"})

    def row(path: str, frame: int, at: int, head: dict[str, str], block: bytes) -> tuple:
        digest, n = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["X-Payload-Length"])
        if head["WARC-Type"] == "response" and (sha1_base32(block) != digest or len(block) != n):
            raise ValueError(f"payload of {head['WARC-Record-ID']} in {path} is damaged")
        page, refers = head.get("X-Page-ID"), head.get("X-Refers-To-Page-ID")
        return (None if page is None else int(page), n, digest, head["WARC-Type"], None if refers is None else int(refers),
                head.get("WARC-Target-URI"), path.rpartition("/")[2], frame, at, block if payloads else None)

    names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst")
             .schema("path string, modificationTime timestamp, length long, content binary").load(f"{folder}/bundles"))
    out = files.select("path", "content").mapInPandas(read, RECORD_SCHEMA)
    return out if payloads else out.drop("payload")


def fetch(index: DataFrame, folder: str) -> DataFrame:
    """(page_id, payload) of the rows of ``index``: per record one range read of its frame."""
    def get(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for name, own in batch.groupby("bundle"):
                uri = f"{folder}/bundles/{name}"
                foot = spans_of(uri)
                for frame, rows in own.groupby("frame"):
                    at, packed, size = foot[frame]
                    data = unpack.decompress(read_range(uri, at, packed), max_output_size=size)
                    for page, offset, n in zip(rows["page_id"], rows["offset_in_frame"], rows["record_bytes"]):
                        out += [(page, block) for _, _, block in records(data[offset:offset + n])]
            yield pd.DataFrame(out, columns=["page_id", "payload"]).astype({"page_id": "Int64"})

    return index.mapInPandas(get, "page_id long, payload binary")


def spans_of(uri: str) -> list[tuple[int, int, int]]:
    """``frame_spans`` of a bundle file, reading its footer and seek table only."""
    from payflow.llm.files import open_fs
    system, path = open_fs(uri)
    size = system.get_file_info(path).size
    count = struct.unpack("<I", read_range(uri, size - 9, 4))[0]
    return frame_spans(read_range(uri, size - 9 - 8 * count, 9 + 8 * count))


CONTRACT = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages to the shared folder and read the archives back (``CONTRACT`` columns)."""
    folder = shared_folder(pages.sparkSession, "warc")
    if write_archives(pages, folder).limit(1).count():
        return read_archives(pages.sparkSession, folder).select(CONTRACT)
    return pages.sparkSession.createDataFrame([], RECORD_SCHEMA).select(CONTRACT)


def oracle_sql() -> str:
    """The round trip's rows in DuckDB SQL (base 32 from the hex digest, 20 bits at a time)."""
    return """
WITH d AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS hex FROM pages),
b AS (
  SELECT *, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 +
    ((('0x' || substr(hex, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT, 1) FOR i IN range(32)], '') AS digest,
    min(page_id) OVER (PARTITION BY hex) AS first_id FROM d)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id > first_id OR (page_id IS NULL AND first_id IS NOT NULL) THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first_id OR (page_id IS NULL AND first_id IS NOT NULL) THEN first_id END AS refers_to
FROM b
"""

"""WARC archives as seekable Zstandard bundles.

A bundle is a run of independent Zstandard frames, each holding some whole WARC records, then a seek
table: a skippable frame with the sizes of all frames.  An index maps each record to its bundle, frame
and offset in the frame, so one record is read by one frame.  Bundles live in a Parquet table with one
binary row each, so that any storage that Spark can reach holds them.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import join_by_count
from tessera.operators.lineage import checkpointed

#: Uncompressed bytes after which a frame, and a bundle, is closed.
FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 1 << 23
#: Magic numbers of the seekable format: a skippable frame's header and the seek table's footer.
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_type_columns(pages: DataFrame, id_column: str, payload_column: str, url_column: str = "url", least: int = 100) -> DataFrame:
    """``pages`` as (page_id, url, payload, payload_digest, payload_bytes, refers_to).

    Equal payloads of at least ``least`` bytes refer to the smallest id among them (null for that id's
    own rows); a digest's smallest id comes from a partial aggregate.  Shorter payloads stay where they
    are read, and digests that very many pages have are broadcast (``join_by_count``).
    """
    payload = F.coalesce(F.col(payload_column).cast("binary"), F.lit(b""))
    url = F.col(url_column).cast("string") if url_column in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.col(id_column).cast("bigint").alias("page_id"), url.alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("payload_digest"), F.length(payload).cast("bigint").alias("payload_bytes"))
    long = rows.where(f"payload_bytes >= {int(least)}")
    first = checkpointed(long.groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1"))
    joined = join_by_count(long, first, "payload_digest", "left")
    short = rows.where(f"payload_bytes < {int(least)}").withColumn("first_id", F.lit(None).cast("bigint"))
    return joined.unionByName(short).select("page_id", "url", "payload", "payload_digest", "payload_bytes", F.when(F.col("page_id") > F.col("first_id"), F.col("first_id")).alias("refers_to"))


def write_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, place: str = "") -> bytes:
    """One WARC/1.1 record; a revisit has no block and names the page that has it.

    ``place`` (bundle and number in it) makes record ids unique, also of repeated rows and of rows
    without an id.  A URL that a header can't hold as it is stands in a header of its own as JSON.
    """
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {place}')}>"), ("WARC-Date", "1970-01-01T00:00:00Z")]
    if page_id is not None:
        head.append(("X-Page-ID", str(page_id)))
    if url is not None:
        if url:
            head.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
        if not url or "\r" in url or "\n" in url:
            head.append(("X-Page-URL", json.dumps(url)))
    head.append(("WARC-Payload-Digest", f"sha256:{digest}"))
    if refers_to is not None:
        head += [("WARC-Profile", PROFILE), ("X-Refers-To-Page-ID", str(refers_to)), ("X-Payload-Length", str(len(payload)))]
    block = payload if refers_to is None else b""
    head += [("Content-Type", "text/html"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def read_record(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """(headers, block, end) of the record at an offset."""
    stop = data.index(b"\r\n\r\n", at)
    version, *lines = data[at:stop].decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines)
    begin = stop + 4
    end = begin + int(headers["Content-Length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError("a WARC record of a wrong length")
    return headers, data[begin:end], end + 4


def seal(frames: list[tuple[bytes, int]]) -> bytes:
    """Frames (compressed bytes, size of their content) and their seek table."""
    entries = b"".join(struct.pack("<II", len(data), size) for data, size in frames)
    footer = struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return b"".join(data for data, _ in frames) + struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer


def seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed size, content size) of each frame, from the footer."""
    count, flags, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE:
        raise ValueError("not a seekable bundle")
    width = 12 if flags & 0x80 else 8
    begin = len(bundle) - 9 - width * count
    if struct.unpack_from("<II", bundle, begin - 8) != (SKIPPABLE, width * count + 9):
        raise ValueError("a damaged seek table")
    out, at = [], 0
    for k in range(count):
        packed, size = struct.unpack_from("<II", bundle, begin + width * k)
        out.append((at, packed, size))
        at += packed
    return out


def read_frame(bundle: bytes, frame: int) -> bytes:
    """The content of one frame."""
    at, packed, size = seek_table(bundle)[frame]
    data = zstandard.ZstdDecompressor().decompress(bundle[at : at + packed], max_output_size=size) if size else b""
    if len(data) != size:
        raise ValueError("a frame of a wrong size")
    return data


def bundles(records: DataFrame, level: int = 3) -> DataFrame:
    """(bundle_id, bundle, index) of record_type_columns() rows; index: (page_id, frame, offset, length) of each record.

    Each task fills bundles of about BUNDLE_BYTES with the rows it has, in the order it has them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, part, number = zstandard.ZstdCompressor(level=level), TaskContext.get().partitionId(), 0
        frames: list[tuple[bytes, int]] = []
        frame: list[bytes] = []
        index: list[dict] = []
        held = total = 0
        kind = pa.list_(pa.struct([("page_id", pa.int64()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]))

        def close_frame() -> None:
            nonlocal held
            if frame:
                frames.append((packer.compress(b"".join(frame)), held))
                frame.clear()
                held = 0

        def close_bundle() -> Iterator[pa.RecordBatch]:
            nonlocal total, number
            close_frame()
            if frames:
                yield pa.RecordBatch.from_arrays([pa.array([(part << 32) + number]), pa.array([seal(frames)], pa.binary()), pa.array([index], kind)], ["bundle_id", "bundle", "index"])
                number += 1
            frames.clear()
            index.clear()
            total = 0

        for batch in batches:
            columns = [batch.column(k) for k in ("page_id", "url", "payload", "payload_digest", "refers_to")]
            for row in range(batch.num_rows):
                record = write_record(*(c[row].as_py() for c in columns), f"{part} {number} {len(index)}")
                index.append({"page_id": columns[0][row].as_py(), "frame": len(frames), "offset": held, "length": len(record)})
                frame.append(record)
                held += len(record)
                total += len(record)
                if held >= FRAME_BYTES:
                    close_frame()
                if total >= BUNDLE_BYTES:
                    yield from close_bundle()
        yield from close_bundle()

    return records.mapInArrow(run, "bundle_id long, bundle binary, index array<struct<page_id: bigint, frame: int, offset: bigint, length: bigint>>")


def write_archives(pages: DataFrame, folder: str, id_column: str = "page_id", payload_column: str = "html", url_column: str = "url") -> str:
    """Write the bundles of all pages as a Parquet table in a new folder below ``folder``, which all executors share; returns its path.

    A null payload counts as empty and a null url, or a table without one, is left out; URLs come back as
    they are.  Payloads of any length are one record each.  Rows that repeat the smallest id of equal
    payloads are responses all of them; rows without an id are responses; other columns are ignored; an
    empty table gives an empty archive.  The archive is the caller's to keep or to remove.
    """
    path = f"{folder}/warc-{uuid.uuid4().hex}"
    bundles(record_type_columns(pages, id_column, payload_column, url_column)).write.parquet(path)
    return path


def read_archives(archives: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url, bundle_id, frame, offset) of every record, read by the index and checked against its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "bundle_id", "frame", "offset"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int64()]
        for batch in batches:
            for row in range(batch.num_rows):
                bundle_id, bundle, index = (batch.column(k)[row].as_py() for k in ("bundle_id", "bundle", "index"))
                rows, loaded, data = [], -1, b""
                for entry in index:
                    if entry["frame"] != loaded:
                        loaded, data = entry["frame"], read_frame(bundle, entry["frame"])
                    headers, block, end = read_record(data, entry["offset"])
                    if end - entry["offset"] != entry["length"]:
                        raise ValueError("the index is wrong")
                    digest, revisit = headers["WARC-Payload-Digest"].removeprefix("sha256:"), headers["WARC-Type"] == "revisit"
                    if not revisit and hashlib.sha256(block).hexdigest() != digest:
                        raise ValueError("a damaged payload")
                    number, other = headers.get("X-Page-ID"), headers.get("X-Refers-To-Page-ID")
                    url = json.loads(headers["X-Page-URL"]) if "X-Page-URL" in headers else headers.get("WARC-Target-URI")
                    rows.append((int(number) if number else None, int(headers["X-Payload-Length"]) if revisit else len(block), digest, headers["WARC-Type"], int(other) if other else None, url, bundle_id, entry["frame"], entry["offset"]))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return archives.select("bundle_id", "bundle", "index").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, bundle_id long, frame int, offset long")


def lookup(archives: DataFrame, page_ids: DataFrame) -> DataFrame:
    """(page_id, record) of the wanted ids, decompressing each frame that holds some of them once.

    The index is searched without the bundles; then each bundle with wanted records is read once.
    """
    entries = archives.select("bundle_id", F.explode("index").alias("entry")).join(page_ids.select(F.col("page_id").alias("wanted")).distinct(), F.col("entry.page_id") == F.col("wanted"))
    wanted = archives.select("bundle_id", "bundle").join(entries.groupBy("bundle_id").agg(F.sort_array(F.collect_list(F.struct("entry.frame", "entry.offset", "entry.length", "wanted"))).alias("entries")), "bundle_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                bundle, found, loaded, data = batch.column("bundle")[row].as_py(), [], -1, b""
                entries = batch.column("entries")[row].as_py()
                for entry in entries:
                    if entry["frame"] != loaded:
                        loaded, data = entry["frame"], read_frame(bundle, entry["frame"])
                    found.append(data[entry["offset"] : entry["offset"] + entry["length"]])
                yield pa.RecordBatch.from_arrays([pa.array([e["wanted"] for e in entries], pa.int64()), pa.array(found, pa.binary())], ["page_id", "record"])

    return wanted.mapInArrow(run, "page_id long, record binary")


def oracle(least: int = 100) -> str:
    """DuckDB SQL for the columns that the query returns."""
    return f"""
with p as (select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
f as (select payload_digest, min(page_id) as first_id from p where payload_bytes >= {least} group by payload_digest)
select page_id, payload_bytes, payload_digest, case when page_id > first_id then 'revisit' else 'response' end as record_type,
  case when page_id > first_id then first_id end as refers_to
from p left join f using (payload_digest)"""

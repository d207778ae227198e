"""WARC: one gzip member per record, written and read sequentially.

Executors build archives of bounded size and keep them as rows (archive, content) of a
Parquet table, which any store that Spark reaches can hold. ``export`` writes the same
bytes as .warc.gz files to a mounted folder; ``read_files`` reads such files.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SALTS, arrow_rows

#: Fixed parts of the format.
VERSION, PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A fixed capture date keeps archives equal from run to run.
DATE = "2024-01-01T00:00:00Z"
ARCHIVE_BYTES = 2 << 20
FEED = 1 << 16


def sha1_base32(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def plan_records(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """Add digest, bytes and ``refers`` (page_id of the response that a row revisits)."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"), F.sha1(payload).alias("digest"), F.length(payload).cast("long").alias("bytes"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    groups = (
        rows.filter(F.col("bytes") >= min_bytes)
        .groupBy("digest", "salt")
        .agg(F.max("page_id").alias("m"), F.count(F.lit(1)).alias("n"))
        .groupBy("digest")
        .agg(F.max("m").alias("keeper"), F.sum("n").alias("n"), F.collect_set("salt").alias("salts"))
        .filter("n > 1")
        .select("digest", "keeper", F.explode("salts").alias("salt"))
    )
    return rows.join(groups, ["digest", "salt"], "left").select("page_id", "url", "html", "digest", "bytes", F.when(~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper")).alias("refers"))


def record(page_id: int | None, url: str, payload: bytes, refers: int | None) -> bytes:
    """One record, uncompressed. A revisit's block is the HTTP head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers is not None else head + payload
    lines = [
        VERSION,
        "WARC-Type: " + ("revisit" if refers is not None else "response"),
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"),
        f"WARC-Payload-Digest: {sha1_base32(payload)}",
        f"WARC-Block-Digest: {sha1_base32(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts, size = [], 0
    for batch in batches:
        cols = [batch.column(c) for c in ("page_id", "url", "html", "refers")]
        for i in range(batch.num_rows):
            page, url, html, refers = (c[i].as_py() for c in cols)
            parts.append(member(record(page, url, html.encode(), refers)))
            size += len(parts[-1])
            if size >= ARCHIVE_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], ["content"])
                parts, size = [], 0
    if parts:
        yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], ["content"])


def write_archives(pages: DataFrame, path: str, min_bytes: int = 1000) -> None:
    """Write all pages as archives of about ARCHIVE_BYTES to a Parquet table at ``path``.

    Of rows with equal payloads of at least ``min_bytes`` bytes, the one with the largest
    page_id is a response and others are revisits; rows repeated with that page_id are
    responses too. Null html: empty payload. Null url: empty URI. Null page_id: an empty
    record id; such a row revisits a non-null page_id where there is one. Page ids are
    whole numbers. A url's line ends are stored as %0D and %0A, spaces around it are lost.
    Empty table: an empty table. Other columns are not stored.
    """
    arrow_rows(pages.sparkSession)
    plan_records(pages, min_bytes).mapInArrow(_write, "content binary").write.mode("overwrite").option("compression", "uncompressed").parquet(path)


def records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Sequential reader: inflates member by member and frames by Content-Length.

    Raises ValueError for a broken frame, a member that is cut off or a wrong digest.
    """
    inflate, data, fed, whole = zlib.decompressobj(31), bytearray(), False, None
    for chunk in chunks:
        while chunk:
            data += inflate.decompress(chunk)
            fed = True
            if whole is None and (end := data.find(b"\r\n\r\n")) >= 0:
                whole = end + 8 + int(_fields(bytes(data[:end])).get("content-length", "-1"))
            if whole is not None and len(data) > whole:
                raise ValueError("Content-Length doesn't frame the block")
            if not inflate.eof:
                break
            chunk = inflate.unused_data
            yield _parse(bytes(data))
            inflate, data, fed, whole = zlib.decompressobj(31), bytearray(), False, None
    if fed:
        raise ValueError("the last gzip member is cut off")


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def _digest(said: str | None) -> bytes | None:
    """The bytes of a SHA-1 digest in base 32 or hex; None for none or for another kind."""
    kind, _, value = (said or "").partition(":")
    if kind.lower() != "sha1" or len(value) not in (32, 40):
        return None
    try:
        return base64.b32decode(value.upper()) if len(value) == 32 else bytes.fromhex(value)
    except ValueError:
        return None


def _parse(data: bytes) -> tuple[dict[str, str], bytes]:
    end = data.find(b"\r\n\r\n")
    if end < 0:
        raise ValueError("not a WARC record")
    fields = _fields(data[:end])
    size = int(fields.get("content-length", "-1"))
    block = data[end + 4 : end + 4 + size]
    if size < 0 or len(block) != size or data[end + 4 + size :] != b"\r\n\r\n":
        raise ValueError("Content-Length doesn't frame the block")
    said = _digest(fields.get("warc-block-digest"))
    if said is not None and said != hashlib.sha1(block).digest():
        raise ValueError("wrong block digest")
    return fields, block


def _row(fields: dict[str, str], block: bytes) -> tuple:
    """A record as a row. Records of any kind and origin are read: those that are no HTTP
    message have their block as payload, ids that name no page are null."""
    kind, end = fields.get("warc-type", ""), block.find(b"\r\n\r\n")
    http = block.startswith(b"HTTP/") and end >= 0
    heads = dict(x.partition(":")[::2] for x in block[:end].decode("latin-1").lower().split("\r\n")[1:]) if http else {}
    payload, revisit, said = block[end + 4 :] if http else block, kind == "revisit", _digest(fields.get("warc-payload-digest"))
    if not revisit and said is not None and said != hashlib.sha1(payload).digest():
        raise ValueError("wrong payload digest")
    if not revisit and said is None:
        said = hashlib.sha1(payload).digest()
    size = heads.get("content-length", "").strip() if revisit else str(len(payload))
    page = lambda v: int(v[10:-1]) if v.startswith("<urn:page:") and v[10:-1].lstrip("-").isdigit() else None
    refers = page(fields.get("warc-refers-to", "")) if revisit else None
    return page(fields.get("warc-record-id", "")), fields.get("warc-target-uri"), int(size) if size.isdigit() else None, said.hex() if said else None, kind, refers, None if revisit else payload


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column("content"):
            view = content.as_buffer()
            out: list[list] = [[] for _ in range(7)]
            for fields, block in records(view[i : i + FEED].to_pybytes() for i in range(0, view.size, FEED)):
                row = _row(fields, block)
                for col, v in zip(out, row, strict=True):
                    col.append(v)
                if len(out[0]) >= 200:
                    yield _rows(out)
                    out = [[] for _ in range(7)]
            yield _rows(out)


_TYPES = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}
SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _rows(cols: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES.values(), strict=True)], list(_TYPES))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of a table of archives; revisits have a null payload.

    payload_bytes and payload_digest are those of the full payload, for revisits as their
    records state them. An empty table gives no rows; a damaged archive fails the read.
    """
    arrow_rows(spark, 8)
    return spark.read.schema("content binary").parquet(path).mapInArrow(_read, SCHEMA)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """As ``read_archives``, from .warc.gz files that Spark can list."""
    arrow_rows(spark, 8)
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select("content").mapInArrow(_read, SCHEMA)


def export(spark: SparkSession, path: str, folder: str) -> None:
    """Write the archives of a table as files to a folder that all executors have mounted."""

    def put(rows) -> None:
        import os

        for row in rows:
            name = f"{folder}/{hashlib.sha1(row.content).hexdigest()}.warc.gz"
            with open(f"{name}.part", "wb") as f:
                f.write(row.content)
            os.replace(f"{name}.part", name)

    spark.read.schema("content binary").parquet(path).foreachPartition(put)

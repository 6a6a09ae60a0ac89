"""WARC archives as a chunked record table.

Writing: a payload leaves the JVM as (record, chunk number, bytes) rows of at most
`chunk_bytes`, in order, and a task appends them to one gzip member per record, so that no
worker holds a whole oversized payload. Length, digest and record type are columns of the
table and stand in the header before the first chunk arrives. Records with equal payloads of
at least `min_bytes` are written once: the smallest page_id is the response, the others are
revisit records without a block that name it.

Reading: a task streams an archive and yields rows of (record, chunk number, bytes), each
with the length and SHA-256 of the payload up to there; the last chunk of a record carries
those of the whole payload.

Archives are written under temporary names and renamed when complete, each named after its
partition; a retried task writes the same records again.

Edge cases: a null html is an empty payload; empty payloads are responses; rows that repeat a
page_id are one record each and of the same type (equal payloads with the smallest page_id
are all responses); a null page_id is written as such and never referred to while another
exists; an empty table gives no archive. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import shared_folder, small_batches, stored

CHUNK_BYTES = 1 << 20
MIN_BYTES = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Archives carry a fixed date, so that a task that runs again writes the same bytes.
DATE = datetime(2026, 1, 1, tzinfo=timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def typed_records(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """page_id, url, payload (binary), payload_bytes, payload_digest, record_type, refers_to."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    long = pages.select("page_id", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")).where(F.octet_length("payload") >= min_bytes)
    firsts = long.groupBy(F.sha2("payload", 256).alias("payload_digest")).agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    rows = rows.join(firsts.select("payload_digest", "_first"), "payload_digest", "left")
    again = F.col("_first").isNotNull() & (F.col("payload_bytes") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return rows.select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("_first")).alias("refers_to"),
    )


def _header(kind: str, page_id, url: str | None, size: int, digest: str, refers_to) -> bytes:
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}", "WARC-Target-URI: " + re.sub(r"[\r\n]+", " ", url or "about:blank")]
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers_to)}"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {size}", "Content-Type: text/html", f"Content-Length: {0 if kind == 'revisit' else size}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n"


def write_archives(pages: DataFrame, folder: str, chunk_bytes: int = CHUNK_BYTES, min_bytes: int = MIN_BYTES, level: int = 1) -> DataFrame:
    """Writes the archives into `folder` (any file system that pyarrow knows) and returns their manifest: path, records, bytes."""
    small_batches(pages.sparkSession)
    rows = typed_records(pages, min_bytes)
    chunks = F.greatest(F.lit(1), F.ceil(F.when(F.col("record_type") == "response", F.col("payload_bytes")).otherwise(0) / chunk_bytes).cast("int"))
    cut = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1)))
    cut = cut.withColumn("payload", F.when(F.col("record_type") == "response", F.expr(f"substring(payload, chunk * {chunk_bytes} + 1, {chunk_bytes})")))

    def write(batches):
        fs, base = pafs.FileSystem.from_uri(folder)
        part, out, total, records = TaskContext.get().partitionId(), None, 0, 0
        temporary, final = f"{base}/_part-{part:06d}-{uuid.uuid4().hex}", f"{base}/part-{part:06d}.warc.gz"
        member = None
        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(temporary, compression=None)
                if r["chunk"] == 0:
                    if member is not None:
                        total += out.write(member.compress(b"\r\n\r\n") + member.flush())
                    member = zlib.compressobj(level, zlib.DEFLATED, 31)
                    records += 1
                    total += out.write(member.compress(_header(r["record_type"], r["page_id"], r["url"], r["payload_bytes"], r["payload_digest"], r["refers_to"])))
                if r["payload"]:
                    total += out.write(member.compress(r["payload"]))
        if out is not None:
            total += out.write(member.compress(b"\r\n\r\n") + member.flush())
            out.close()
            fs.move(temporary, final)
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/part-{part:06d}.warc.gz"], "records": [records], "bytes": [total]})

    return stored(cut.select("page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to", "chunk").mapInArrow(write, "path string, records long, bytes long"), "warc-manifest")


class _Members:
    """The bytes of a file of gzip members, read in blocks."""

    def __init__(self, stream, block: int):
        self.stream, self.block, self.kept, self.open = stream, block, b"", zlib.decompressobj(31)
        self.packed = b""

    def _more(self) -> bool:
        while True:
            if self.open.eof:
                self.packed = self.open.unused_data or self.packed
                self.open = zlib.decompressobj(31)
            if not self.packed:
                self.packed = self.stream.read(self.block)
                if not self.packed:
                    return False
            new = self.open.decompress(self.packed, self.block)
            self.packed = b"" if self.open.eof else self.open.unconsumed_tail
            if new:
                self.kept += new
                return True

    def until(self, mark: bytes) -> bytes | None:
        while (k := self.kept.find(mark)) < 0:
            if not self._more():
                return None
        found, self.kept = self.kept[:k], self.kept[k + len(mark) :]
        return found

    def take(self, n: int) -> bytes:
        while len(self.kept) < n and self._more():
            pass
        found, self.kept = self.kept[:n], self.kept[n:]
        return found


CHUNKS = "path string, record_no long, page_id long, url string, record_type string, refers_to long, stated_digest string, stated_bytes long, chunk long, data binary, bytes_so_far long, digest_so_far string, last boolean"


def _records(stream, path: str, chunk_bytes: int):
    reader, number = _Members(stream, min(chunk_bytes, 1 << 18)), 0
    number_in = lambda s: int(m[1]) if (m := re.search(r"urn:page:(-?\d+)", s or "")) else None
    while (head := reader.until(b"\r\n\r\n")) is not None:
        fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
        left, digest, chunk, seen = int(fields["Content-Length"]), hashlib.sha256(), 0, 0
        same = {"path": path, "record_no": number, "page_id": number_in(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"], "refers_to": number_in(fields.get("WARC-Refers-To")), "stated_digest": fields["WARC-Payload-Digest"].removeprefix("sha256:"), "stated_bytes": int(fields["WARC-Payload-Length"])}
        while True:
            data = reader.take(min(left, chunk_bytes))
            if len(data) < min(left, chunk_bytes):
                raise EOFError(f"{path}: record {number} is cut off")
            left, seen = left - len(data), seen + len(data)
            digest.update(data)
            yield same | {"chunk": chunk, "data": data, "bytes_so_far": seen, "digest_so_far": digest.copy().hexdigest(), "last": not left}
            chunk += 1
            if not left:
                break
        if reader.take(4) != b"\r\n\r\n":
            raise ValueError(f"{path}: record {number} doesn't end where it says")
        number += 1


def read_archives(manifest: DataFrame, chunk_bytes: int = CHUNK_BYTES, payloads: bool = True) -> DataFrame:
    """The chunked record table of the archives named in manifest.path; without payloads, data is null."""

    def read(batches):
        schema = pa.schema([("path", pa.string()), ("record_no", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("stated_digest", pa.string()), ("stated_bytes", pa.int64()), ("chunk", pa.int64()), ("data", pa.binary()), ("bytes_so_far", pa.int64()), ("digest_so_far", pa.string()), ("last", pa.bool_())])
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, inner = pafs.FileSystem.from_uri(path)
                with fs.open_input_stream(inner, compression=None) as stream:
                    rows, held = [], 0
                    for r in _records(stream, path, chunk_bytes):
                        held += len(r["data"]) + 200
                        rows.append(r if payloads else r | {"data": None})
                        if held >= chunk_bytes:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema)

    spark = manifest.sparkSession
    spread = manifest.select("path").repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "path")
    return spread.mapInArrow(read, CHUNKS)


def records(chunks: DataFrame) -> DataFrame:
    """One row per record: its length, digest, type and reference, and whether what was read agrees with the header."""
    response = F.col("record_type") == "response"
    return chunks.where("last").select(
        "page_id", "url",
        F.when(response, F.col("bytes_so_far")).otherwise(F.col("stated_bytes")).alias("payload_bytes"),
        F.when(response, F.col("digest_so_far")).otherwise(F.col("stated_digest")).alias("payload_digest"),
        "record_type", "refers_to",
        (~response | ((F.col("bytes_so_far") == F.col("stated_bytes")) & (F.col("digest_so_far") == F.col("stated_digest")))).alias("intact"),
    )


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes the archives and reads them back: one row per page."""
    folder = folder or f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    if "://" not in folder and not folder.startswith("/"):
        folder = folder.replace("file:", "", 1)
    return records(read_archives(write_archives(pages, folder), payloads=False))

"""WARC archives: deduplicating writer, and a splittable reader of gzip members by byte range.

Tasks open archive files themselves, through ``pyarrow.fs``: the folder must be one that it reaches (local or
shared file systems, HDFS, S3, GCS), as well as Spark.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import text_bytes
from tallyframe.session import cut_lineage, ensure_checkpoint_dir

MAGIC = b"\x1f\x8b\x08"
FILE_BYTES = 256_000_000  # an archive file is closed beyond this size
SPLIT_BYTES = 16_000_000  # a task's byte range
READ_BYTES = 1 << 20
LAG = len(MAGIC) - 1


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _folder(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


# ---- writer


def roles(pages: DataFrame, key: str, payload: str, least: int) -> DataFrame:
    """Adds ``__first`` and ``__nth``: of the rows with this payload the smallest key, and the number of
    this row among those that share key and payload.

    Keys and digests are grouped first and joined to the smallest key of each digest; only then do payloads
    move, once, by (digest, key), so a payload of a third of all pages is spread by their keys.
    """
    keyed = pages.withColumn("__sha", F.unhex(F.sha2(payload, 256))).withColumn(
        "__named", F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))
    )
    eligible = keyed.filter(F.octet_length(payload) >= least).groupBy("__sha", "__named").agg(F.first(key).alias(key))
    firsts = eligible.groupBy("__sha").agg(F.min(key).alias("__first"))
    pairs = eligible.select("__sha", "__named").join(firsts, "__sha").withColumn("__eligible", F.lit(True))
    joined = keyed.join(pairs, ["__sha", "__named"], "left")
    # The window stands on the join's partitioning: payloads are shuffled once.
    nth = F.row_number().over(Window.partitionBy("__sha", "__named").orderBy(F.col("__url").asc_nulls_last()))
    return joined.withColumn("__eligible", F.coalesce("__eligible", F.lit(False))).withColumn("__nth", nth)


def record(key, url: str | None, payload: bytes, refers_to, is_revisit: bool, date: str) -> bytes:
    """One WARC record as a gzip member of its own."""
    target = url or f"urn:page:{'' if key is None else key}"
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    body = head if is_revisit else head + payload
    fields = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if is_revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target.translate({10: '%0A', 13: '%0D'})}",
        f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}",
        f"X-Payload-Length: {len(payload)}",
        f"X-Page-Id: {'' if key is None else key}",
    ]
    if is_revisit:
        fields += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"X-Refers-To-Page-Id: {'' if refers_to is None else refers_to}",
        ]
    fields += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    plain = "\r\n".join(fields).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(plain) + packer.flush()


def write_warc(
    pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0
) -> DataFrame:
    """Writes a record per page below ``folder`` and returns the files: path, bytes, n_records.

    Payload: the text in UTF-8, none if it is missing. Of pages with equal payloads of ``least`` bytes or more
    the one with the smallest key becomes a response and the others revisits that refer to it; smaller
    payloads are all responses. Rows that repeat key and payload share that rule: the first by URL
    is the response. Missing keys come last. Each attempt of a task writes files under names of
    its own, and only those of the attempts that Spark commits are in the result: use that list, not
    the folder's. No pages, no files.
    """
    rows = pages.select(
        F.col(f"`{key}`").alias("__key"),
        F.col(f"`{url}`").cast("string").alias("__url"),
        F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")).cast("binary").alias("__payload"),
    )
    placed = roles(rows, "__key", "__payload", least)
    is_first = F.col("__key").eqNullSafe(F.col("__first")) & (F.col("__nth") == 1)
    placed = placed.select(
        F.col("__key").cast("string"),
        "__url",
        "__payload",
        F.col("__first").cast("string"),
        (F.col("__eligible") & ~is_first).alias("__revisit"),
    )
    date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _folder(folder)
        out, path, size, n, done = None, "", 0, 0, []
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in (0, 1, 3, 4)]
            for k, u, first, revisit, payload in zip(*columns, text_bytes(batch.column(2))):
                if out is None:
                    path, size, n = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(path, compression=None)
                data = record(k, u, payload, first, revisit, date)
                out.write(data)
                size, n = size + len(data), n + 1
                if size > FILE_BYTES:
                    out.close()
                    out = done.append((path, size, n))
        if out is not None:
            out.close()
            done.append((path, size, n))
        names = ["path", "bytes", "n_records"]
        yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*done)))) if done else {c: [] for c in names}, schema=files)

    files = pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("n_records", pa.int64())])
    store, base = _folder(folder)
    store.create_dir(base, recursive=True)
    return cut_lineage(placed.mapInArrow(run, "path string, bytes bigint, n_records bigint"))


# ---- reader


def _header(plain: bytes) -> tuple[dict[str, str], int] | None:
    """Fields of a WARC header and where its block begins; nothing if ``plain`` does not start with one."""
    if not plain.startswith(b"WARC/"):
        return None
    end = plain.find(b"\r\n\r\n")
    if end < 0:
        return None
    lines = plain[:end].decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    return (fields, end + 4) if fields.get("content-length", "").isdigit() and "warc-type" in fields else None


class _Source:
    """Bytes of one file from any place, read in pieces of READ_BYTES."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.data = file, size, 0, b""

    def piece(self, at: int) -> bytes:
        """What is held from ``at`` on: never empty before the end of the file."""
        if not self.at <= at < self.at + len(self.data):
            self.file.seek(at)
            self.at, self.data = at, self.file.read(READ_BYTES)
        return self.data[at - self.at :]


def _valid(source: _Source, at: int) -> bool:
    """Whether a gzip member begins at ``at`` that decodes to a WARC header, however long."""
    unpacker, plain, looked = zlib.decompressobj(31), bytearray(), 0
    try:
        while at < source.size and not unpacker.eof:
            piece = source.piece(at)[:4096]
            plain += unpacker.decompress(piece, 1 << 16)
            at += len(piece) - len(unpacker.unconsumed_tail)
            if len(plain) >= 5 and not plain.startswith(b"WARC/"):
                return False
            if plain.find(b"\r\n\r\n", looked) >= 0:
                return _header(bytes(plain)) is not None
            looked = max(0, len(plain) - 3)
    except zlib.error:
        return False
    return False


def _member(source: _Source, at: int) -> tuple[bytes, int]:
    """Content of the member at ``at``, checked against its CRC and length, and where the next one may begin."""
    unpacker, parts = zlib.decompressobj(31), []
    while not unpacker.eof:
        if at >= source.size:
            raise EOFError("the archive ends inside a record")
        piece = source.piece(at)
        parts.append(unpacker.decompress(piece))
        at += len(piece) - len(unpacker.unused_data)
    return b"".join(parts), at


def _find(source: _Source, at: int, end: int) -> int | None:
    """The first place from ``at`` on and before ``end`` where a record begins."""
    while at < end:
        piece = source.piece(at)
        if len(piece) < len(MAGIC) and at + len(piece) < source.size:
            source.data = b""  # magic may lie across two pieces: read on from here
            piece = source.piece(at)
        i = piece.find(MAGIC)
        if i < 0:
            at += max(1, len(piece) - LAG)
            continue
        at += i
        if at >= end:
            return None
        if _valid(source, at):
            return at
        at += 1
    return None


def records(file, size: int, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header fields, block) of the records that begin at ``start`` or later and before ``end``."""
    source, at = _Source(file, size), start
    while (found := _find(source, at, min(end, size))) is not None:
        plain, at = _member(source, found)
        parsed = _header(plain)
        if parsed:
            fields, block = parsed
            yield found, fields, plain[block : block + int(fields["content-length"])]


def read_warc(spark: SparkSession, files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Records of the archives in ``files`` (path, bytes): path, offset, fields, block.

    A task takes a byte range. It looks for the gzip magic, takes a place as the start of a record if a
    member there decodes to a WARC header, owns the records that begin inside its range, and reads the last
    one to its end beyond. Every member is checked by its CRC; a damaged or cut record fails the job. Members without a
    WARC header are passed over. Empty files give nothing.
    """
    ranges = files.select(
        "path", "bytes", F.explode(F.expr(f"sequence(0L, greatest(bytes - 1, 0L), {split_bytes}L)")).alias("start")
    )
    schema = "path string, offset bigint, fields map<string, string>, block binary"
    arrow = pa.schema(
        [("path", pa.string()), ("offset", pa.int64()), ("fields", pa.map_(pa.string(), pa.string())), ("block", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, path = _folder(row["path"])
                held, size = [], 0
                with store.open_input_file(path) as file:
                    for offset, fields, block in records(file, row["bytes"], row["start"], row["start"] + split_bytes):
                        held.append((row["path"], offset, list(fields.items()), block))
                        size += len(block)
                        if size > READ_BYTES * 8:
                            yield pa.RecordBatch.from_pydict(dict(zip(arrow.names, zip(*held))), schema=arrow)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pydict(dict(zip(arrow.names, zip(*held))), schema=arrow)

    tasks = files.agg(F.sum(F.expr(f"greatest(bytes - 1, 0L) div {split_bytes}L + 1"))).first()[0] or 1
    return ranges.repartition(int(tasks)).mapInArrow(run, schema)


def page_table(read: DataFrame, key_type: str = "bigint") -> DataFrame:
    """Per record of this writer: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A response's payload is measured and hashed anew, and a digest that differs from the header's fails the
    job; a revisit has no payload and is described by its header.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for fields, block in zip(batch.column("fields").to_pylist(), batch.column("block").to_pylist()):
                f = dict(fields)
                digest, size = f["warc-payload-digest"].removeprefix("sha1:"), int(f["x-payload-length"])
                if f["warc-type"] == "response":
                    payload = block[block.index(b"\r\n\r\n") + 4 :]
                    if (len(payload), sha1_base32(payload)) != (size, digest):
                        raise ValueError(f"payload of page {f['x-page-id']} differs from its digest")
                out.append((f["x-page-id"] or None, size, digest, f["warc-type"], f.get("x-refers-to-page-id") or None))
            names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
            columns = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    rows = read.select("fields", "block").mapInArrow(
        run, "page_id string, payload_bytes bigint, payload_digest string, record_type string, refers_to string"
    )
    return rows.withColumn("page_id", F.col("page_id").cast(key_type)).withColumn(
        "refers_to", F.col("refers_to").cast(key_type)
    )


def archive_round_trip(pages: DataFrame, least: int = 0, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Writes ``pages`` as WARC below the checkpoint folder and reads the archives back as ``page_table``. Fails if
    there are not as many records as were written."""
    spark = pages.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    files = write_warc(pages, folder, least=least)
    out = cut_lineage(page_table(read_warc(spark, files, split_bytes), pages.schema["page_id"].dataType.simpleString()))
    read, written = out.count(), files.agg(F.sum("n_records")).first()[0] or 0
    if read != written:
        raise ValueError(f"{read} records read of {written} written")
    return out

"""WARC files: records written as they are derived, and read back as a stream, whatever holds them."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .token_files import _located
from .warc import CRLF

READ = 1 << 18
BATCH = 4 << 20
#: Columns of records read, by the name of their header field.
FIELDS = {"warc_type": "warc-type", "record_id": "warc-record-id", "refers_to": "warc-refers-to", "target_uri": "warc-target-uri", "date": "warc-date", "payload_digest": "warc-payload-digest"}
SCHEMA = pa.schema([("path", pa.string()), ("at", pa.int64()), *[(n, pa.string()) for n in FIELDS], ("header", pa.string()), ("block", pa.binary()), ("http_headers", pa.string()), ("payload", pa.string())])


def write_records(records: DataFrame, path: str, per_file: int = 100_000, compression: str = "none") -> None:
    """Rows with ``header`` and ``block``, such as those of ``derive``, as WARC files under ``path``, each of at most ``per_file``
    records.  Null headers or blocks are not allowed.  No shuffle."""
    # the writer ends each row with the last line feed of the record
    text = F.concat("header", F.lit(CRLF), "block", F.lit(CRLF + "\r"))
    row = F.when(text.isNull(), F.raise_error(F.lit("a record without header or block"))).otherwise(text)
    records.select(row.alias("value")).write.option("lineSep", "\n").option("compression", compression).option("maxRecordsPerFile", per_file).text(path)


def _bytes(path: str) -> Iterator[bytes]:
    """Runs of a file's bytes; of one that is compressed (one member or one for each record), of what it holds."""
    fs, place = _located(path)
    with fs.open_input_stream(place, compression=None) as f:
        data = f.read(READ)
        if data[:2] != b"\x1f\x8b":
            while data:
                yield data
                data = f.read(READ)
            return
        member = zlib.decompressobj(31)
        while data:
            yield member.decompress(data)
            data = member.unused_data
            if member.eof:
                member = zlib.decompressobj(31)
                data = data.lstrip(b"\0")
            data = data or f.read(READ)


def records_of(path: str, runs: Iterator[bytes]) -> Iterator[tuple[int, str, bytes]]:
    """(offset, header, block) of each record.  A block is as long as its header says, whatever it holds."""
    held, at = bytearray(), 0

    def more() -> bool:
        run = next(runs, None)
        held.extend(run or b"")
        return run is not None

    while True:
        while not held.strip(b"\r\n") and more():
            pass
        blank = len(held) - len(held.lstrip(b"\r\n"))
        del held[:blank]
        at += blank
        if not held:
            return
        end, seen = -1, 0
        while end < 0:
            end = held.find(b"\r\n\r\n", seen)
            seen = max(0, len(held) - 3)
            if end < 0 and not more():
                raise ValueError(f"{path}: a header without end at {at}")
        header = bytes(held[: end + 2]).decode("utf-8", "replace")
        size = re.search(r"(?im)^content-length:[ \t]*(\d+)[ \t]*\r$", header)
        if not header.startswith("WARC/") or not size:
            raise ValueError(f"{path}: no record at {at}")
        stop = end + 4 + int(size[1])
        while len(held) < stop:
            if not more():
                raise ValueError(f"{path}: the record at {at} is cut off")
        yield at, header, bytes(held[end + 4 : stop])
        del held[:stop]
        at += stop


def _row(path: str, at: int, header: str, block: bytes) -> tuple:
    field = {n.strip().lower(): v.strip() for n, _, v in (line.partition(":") for line in header.split(CRLF)[1:])}
    head = payload = None
    if field.get("content-type", "").lower().startswith("application/http"):
        top, _, body = block.partition(b"\r\n\r\n")
        head = top.decode("utf-8", "replace") + CRLF
        charset = re.search(r"(?im)^content-type:[^\r\n]*charset=[\"']?([\w.:-]+)", head)
        try:
            payload = body.decode(charset[1] if charset else "utf-8", "replace")
        except LookupError:
            payload = body.decode("utf-8", "replace")
        field.setdefault("warc-payload-digest", "sha256:" + hashlib.sha256(body).hexdigest())
    return (path, at, *(field.get(n) for n in FIELDS.values()), header, block, head, payload)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """path, at (offset), warc_type, record_id, refers_to, target_uri, date, payload_digest, header, block (bytes), and of HTTP
    messages http_headers and payload (text) of each record of the files under ``path``.

    Each file is read by one task (small ones share it, as Spark deals them), as a stream: a task holds a record and some MB.  No shuffle.  Files may be compressed, as a whole or
    record by record.  Missing fields are null; empty files have no records; a file that is cut off, or isn't WARC, is an error.
    A payload is decoded by its declared charset, else as UTF-8, with marks for what isn't; transfer encodings stay.
    The records of type ``response`` are a source for ``derive`` (``keep=()``).
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for file in batch.column("path").to_pylist():
                for at, header, block in records_of(file, _bytes(file)):
                    rows.append(_row(file, at, header, block))
                    size += len(header) + 2 * len(block)
                    if size > BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), SCHEMA)], schema=SCHEMA)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), SCHEMA)], schema=SCHEMA)

    kinds = {"int64": "bigint"}
    return files.mapInArrow(run, ", ".join(f"{f.name} {kinds.get(str(f.type), f.type)}" for f in SCHEMA))


def responses_read(records: DataFrame) -> DataFrame:
    """Of ``read_records`` the responses, as ``derive`` takes them."""
    return records.filter("warc_type = 'response' and payload is not null").select("path", "record_id", "target_uri", "date", "http_headers", "payload", "payload_digest")

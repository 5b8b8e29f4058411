"""WARC: archives of gzip members, one a record, and a reader that splits them by byte ranges.

Reading: each task gets a range of a file, scans it for the gzip magic, and validates a candidate by
decoding its header and finding a WARC version line. A record belongs to the range in which its
member starts, so each is read once, also one that runs on beyond the range's end; inside a valid
member nothing is scanned.

Writing: one archive a task, under a name that no other attempt uses; only archives that the
finished stage reports are read, so a retried or speculative task does no harm. Archives stand in
the shared folder.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import file_system, materialize, shared_path

MAGIC = b"\x1f\x8b\x08"
DEDUP_BYTES = 1000  # smaller payloads are stored anew each time
SPLIT_BYTES = 8 << 20
#: What is read at once, and decoded at once.
READ_BYTES, PIECE_BYTES = 1 << 20, 1 << 14
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def records(pages: DataFrame) -> DataFrame:
    """Adds payload_bytes, payload_digest (hex SHA-1), record_type and refers_to to (page_id, url, html).

    Of records with equal payloads of at least DEDUP_BYTES the one with the largest page_id is the response, the others
    revisit it. Equal means equal size, SHA-1 and SHA-256.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    keyed = pages.select("page_id", "url", payload.alias("payload")).withColumns(
        {"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload"), "strong": F.sha2("payload", 256)}
    )
    same = ["payload_bytes", "payload_digest", "strong"]
    light = keyed.where(F.col("payload_bytes") >= DEDUP_BYTES).select("page_id", *same)
    groups = light.groupBy(*same).agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    # A written table: the rows of a payload with very many copies can then be split over tasks in the join.
    revisits = (
        light.join(materialize(groups, "payloads"), same)
        .where("page_id <> first")
        .select(F.col("page_id").alias("revisit_id"), F.col("strong").alias("revisit_of"), F.col("first").alias("refers_to"))
        .distinct()
    )
    # Only copies are in revisits; the payloads themselves are dealt by page_id, which is even.
    return keyed.join(revisits, (keyed["page_id"] == revisits["revisit_id"]) & (keyed["strong"] == revisits["revisit_of"]), "left").select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest",
        F.when(F.col("refers_to").isNull(), F.lit("response")).otherwise(F.lit("revisit")).alias("record_type"), "refers_to",
    )


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One WARC 1.1 record. A revisit has the HTTP header alone, whose Content-Length is the payload's."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    name = "urn:page:" + ("null" if page_id is None else str(page_id))
    uri = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "about:blank")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", f"WARC-Target-URI: {uri}", "WARC-Date: 1970-01-01T00:00:00Z",
        "WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(), "Content-Type: application/http; msgtype=response",
    ]
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(rows: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """Writes the records of rows as .warc.gz below folder; (name, size) of the archives, as a written table.

    A null page_id is written as null, a null url as about:blank. Repeated rows are records each. Columns besides those of
    records() are not read. An empty table gives no archive.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(folder)
        path, out, size = f"{base}/part-{uuid.uuid4().hex}.warc.gz", None, 0
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(path, compression=None)
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = packer.compress(record_bytes(*row)) + packer.flush()
                out.write(member)
                size += len(member)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path.removeprefix(base + "/")]), pa.array([size])], ["name", "size"])

    columns = rows.select("page_id", "url", "payload", "payload_digest", "record_type", "refers_to")
    return materialize(columns.mapInArrow(run, "name string, size long"), "archives")


class RangeReader:
    """The records of one file whose members start in [start, end)."""

    def __init__(self, file, start: int, end: int, size: int):
        self.file, self.end, self.size = file, end, size
        self.data, self.at = bytearray(), start  # bytes read, and the file's place of the first of them

    def _more(self, n: int = READ_BYTES) -> bool:
        """Reads on; False at the end of the file."""
        at = self.at + len(self.data)
        if at >= self.size:
            return False
        self.file.seek(at)
        got = self.file.read(min(n, self.size - at))
        self.data += got
        return bool(got)

    def _drop(self, n: int) -> None:
        del self.data[:n]
        self.at += n

    def _unpacked(self, at: int, most: int = 0) -> tuple[bytes, int] | None:
        """The content of the member at data[at], or its first `most` bytes, and where what was read of it ends; None if it
        breaks off or is damaged. Reads on as far as the member goes, piece by piece."""
        unpacker, out, size = zlib.decompressobj(31), [], 0
        while not unpacker.eof and not (most and size >= most):
            if at == len(self.data) and not self._more():
                return None
            piece = bytes(self.data[at : at + PIECE_BYTES])
            try:
                out.append(unpacker.decompress(piece, most))
            except zlib.error:
                return None
            size += len(out[-1])
            at += len(piece) - len(unpacker.unused_data)
        return b"".join(out), at

    def _is_record(self, at: int) -> bool:
        """Whether a member whose header and first bytes decode to a WARC version line starts at data[at]."""
        got = self._unpacked(at, 5)
        return got is not None and got[0][:5] == b"WARC/"

    def _member(self) -> bytes | None:
        """The content of the member at data[0], which is taken off; None if it breaks off or is damaged."""
        got = self._unpacked(0)
        if got is None:
            return None
        self._drop(got[1])
        return got[0]

    def __iter__(self) -> Iterator[tuple[int, bytes]]:
        while self.at < self.end:
            while len(self.data) < 3 and self._more():
                pass
            k = self.data.find(MAGIC)
            if k < 0:
                if not self._more():
                    return
                if self.data.find(MAGIC) < 0:
                    self._drop(max(0, len(self.data) - 2))  # the magic may go on in what comes next
                continue
            if self.at + k >= self.end:
                return
            if not self._is_record(k):
                self._drop(k + 1)
                continue
            self._drop(k)
            place = self.at
            content = self._member()
            if content is None:
                self._drop(1)
            else:
                yield place, content


def parsed(content: bytes) -> tuple[dict[str, str], bytes, dict[str, str]]:
    """A record's named fields (lower case), its HTTP payload, and the HTTP header's fields."""

    def fields(lines: list[bytes]) -> dict[str, str]:
        return {k.strip().lower().decode("latin-1"): v.strip().decode("utf-8", "replace") for k, _, v in (x.partition(b":") for x in lines[1:])}

    head, _, rest = content.partition(b"\r\n\r\n")
    own = fields(head.split(b"\r\n"))
    block = rest[: int(own.get("content-length", 0))]
    http, _, payload = block.partition(b"\r\n\r\n")
    return own, payload, fields(http.split(b"\r\n"))


READ_SCHEMA = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean"


def read_archives(archives: DataFrame, folder: str, split_bytes: int = SPLIT_BYTES, payloads: bool = True) -> DataFrame:
    """The records of the archives (name, size) below folder: READ_SCHEMA. Each file is dealt out in ranges of
    split_bytes. A damaged member is skipped; records that other programs wrote have nulls where they don't name a page.
    Archives given twice are read twice; empty ones, and an empty table of archives, give no rows. Other columns are not read. intact: a response's payload has the size and digest of its header."""
    ranges = archives.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))))
    total = archives.agg(F.sum(F.ceil(F.col("size") / split_bytes))).first()[0] or 1
    ranges = ranges.repartition(int(min(max(total, 1), 100_000)), "name", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(folder)
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("intact", pa.bool_())])
        rows, held = [], 0
        for b in batches:
            for name, size, start in zip(*(c.to_pylist() for c in b.columns), strict=True):
                with fs.open_input_file(f"{base}/{name}") as file:
                    for _, content in RangeReader(file, start, min(start + split_bytes, size), size):
                        row = _row(content, payloads)
                        rows.append(row)
                        held += len(content) if payloads else 200
                        if held > 1 << 23:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    return ranges.select("name", "size", "start").mapInArrow(run, READ_SCHEMA)


def _row(content: bytes, payloads: bool) -> dict:
    own, payload, http = parsed(content)
    number = lambda x: int(v) if (v := x.strip("<>").removeprefix("urn:page:")).lstrip("-").isdigit() else None
    digest = base64.b32decode(own.get("warc-payload-digest", "sha1:").removeprefix("sha1:")).hex()
    size = int(http.get("content-length", len(payload)))
    kind = own.get("warc-type", "")
    return {
        "page_id": number(own.get("warc-record-id", "")), "url": own.get("warc-target-uri"), "payload": payload if payloads and kind == "response" else None, "payload_bytes": size, "payload_digest": digest,
        "record_type": kind, "refers_to": number(own.get("warc-refers-to", "")), "intact": kind == "revisit" or (len(payload) == size and hashlib.sha1(payload).hexdigest() == digest),
    }


def round_trip(pages: DataFrame, payloads: bool = True) -> DataFrame:
    """Writes pages (page_id, url, html) as archives in the shared folder and reads these back: READ_SCHEMA.

    A null or empty html is a response with an empty payload; a null url is about:blank; a null page_id is kept, as a
    response. Pages repeated in full are all responses if theirs is the largest page_id of the payload. Further
    columns aren't read. An empty table gives an empty result.
    """
    folder = shared_path(pages.sparkSession, "warc")
    return read_archives(write_archives(records(pages), folder), folder, payloads=payloads)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"), payloads=False)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


OP10_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
  FROM pages
), g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN first END AS refers_to,
  true AS intact
FROM g
"""

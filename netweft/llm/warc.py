"""Dictionary-compressed web archives: writer and reader.

The writer builds a Zstandard dictionary from archived records, embeds it in a skippable frame at
the head of every archive and compresses each record as a frame of its own, so that single records
stay addressable by offset. Payloads that occur more than once are stored once, as the response
record of the largest page id; the others become revisit records that refer to it.

Archives are rows of a binary column (``archive_id``, ``data``), written by Spark to any store that
Spark reaches; ``export`` writes them out as .warc.zst files. The dictionary is trained on a bounded
sample: the ``SAMPLE`` pages with the smallest id hashes, at most ``SAMPLE_BYTES`` bytes of each.
The sample decides on size only, not on content: any record is read back byte for byte.

Defined cases: a null html is an empty payload; a null page id is the smallest, written as an empty
id; rows with equal page id and payload are archived each, and all but one of them revisit it; an empty
table gives no archive. Extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import arrow_schema, cut

DICTIONARY_BYTES, SAMPLE, SAMPLE_BYTES, LEVEL = 64 << 10, 512, 32 << 10, 6
#: Compressed bytes after which an archive is closed.
ARCHIVE_BYTES = 4 << 20
# Magic numbers of the skippable frame that holds a dictionary, and of a frame.
DICTIONARY_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
_CRLF = b"\r\n"
_NAMESPACE = uuid.UUID("6f0f1c9e-6a57-4a43-9a4e-0a4f6cbb2c11")


def digest(payload: bytes) -> str:
    """Bare base32 SHA-1, upper case."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, '' if page_id is None else str(page_id))}>"


def record(page_id: int | None, url: str | None, payload: bytes, payload_digest: str, kind: str, refers_to: int | None) -> bytes:
    """One archive record; a revisit has HTTP headers only, but names the full payload's digest and length."""
    uri = "".join(c if 32 < ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id)}", "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{payload_digest}", f"X-Page-Id: {'' if page_id is None else page_id}",
        f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {'' if refers_to is None else refers_to}"]
        body = http
    else:
        body = http + payload
    head.append(f"Content-Length: {len(body)}")
    return _CRLF.join(x.encode() for x in head) + _CRLF * 2 + body + _CRLF * 2


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a record; its block follows its stated length."""
    head, _, rest = data.partition(_CRLF * 2)
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    if rest[len(block) :] != _CRLF * 2:
        raise ValueError("the record's block doesn't end where its header says")
    return headers, block.partition(_CRLF * 2)[2]


def train(samples: list[bytes]) -> bytes:
    """A Zstandard dictionary; from few or tiny samples their bytes themselves, which decoders take as raw content."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


class Archive:
    """Bytes of an archive that grows by records."""

    def __init__(self, dictionary: bytes) -> None:
        import zstandard

        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True) if dictionary else zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        self.head = struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary
        self.parts, self.size = [self.head], len(self.head)

    def add(self, data: bytes) -> None:
        self.parts.append(self.compressor.compress(data))
        self.size += len(self.parts[-1])

    def close(self) -> bytes:
        data = b"".join(self.parts)
        self.parts, self.size = [self.head], len(self.head)
        return data


def read(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Offset, compressed length, headers and payload of each record of an archive."""
    import zstandard

    magic, n = struct.unpack_from("<II", data)
    if magic != DICTIONARY_MAGIC:
        raise ValueError("an archive begins with the frame that holds its dictionary")
    dictionary = data[8 : 8 + n]
    own = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if n else zstandard.ZstdDecompressor()
    at = 8 + n
    while at < len(data):
        frame = own.decompressobj()
        raw = frame.decompress(memoryview(data)[at:])
        if not frame.eof:
            raise ValueError(f"the frame at {at} is cut short")
        used = len(data) - at - len(frame.unused_data)
        yield at, used, *parse(raw)
        at += used


def sample(pages: DataFrame) -> list[bytes]:
    """Payloads to train on: of the pages whose ids have the smallest hashes, as many as SAMPLE and no more of each than SAMPLE_BYTES."""
    ids = pages.where("page_id IS NOT NULL").select("page_id", F.xxhash64("page_id").alias("h")).distinct().orderBy("h", "page_id").limit(SAMPLE).select("page_id")
    rows = pages.join(F.broadcast(ids), "page_id", "left_semi").select("page_id", F.substring("html", 1, SAMPLE_BYTES).alias("html")).where("html IS NOT NULL").dropDuplicates(["page_id"]).limit(SAMPLE).collect()
    return [record(r["page_id"], None, r["html"].encode(), digest(r["html"].encode()), "response", None) for r in sorted(rows, key=lambda r: r["page_id"])]


def write(pages: DataFrame) -> DataFrame:
    """Archives of all pages: ``archive_id string, records long, data binary``, stored in the shared folder."""
    spark = pages.sparkSession
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    dictionary = train(sample(pages))
    keyed = pages.withColumn("key", F.unhex(F.sha1(F.coalesce("html", F.lit("")).cast("binary"))))
    # Digests found more than once, from ids and digests alone. Stored, so that its size decides how it is joined; if it is small, no html moves.
    pairs = keyed.groupBy("key", "page_id").agg(F.count("*").alias("n"))
    copies = cut(pairs.groupBy("key").agg(F.max("page_id").alias("last"), F.sum("n").alias("rows"), F.max("n").alias("most")).where("rows > 1"), "archive-digests")
    joined = keyed.join(copies.select(F.col("key").alias("k"), "last"), F.col("key") == F.col("k"), "left").drop("k").withColumn("last", F.coalesce("last", "page_id"))
    schema = "archive_id string, records long, data binary"
    target = arrow_schema(spark, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, records, ids = Archive(dictionary), 0, hashlib.sha1()

        def close() -> pa.RecordBatch:
            data = archive.close()
            return pa.RecordBatch.from_arrays([pa.array([hashlib.sha1(data).hexdigest()]), pa.array([records], pa.int64()), pa.array([data], pa.binary())], schema=target)

        for batch in batches:
            for page_id, url, html, last_id, first in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "last", "first")), strict=True):
                payload = (html or "").encode()
                response = page_id == last_id and first
                archive.add(record(page_id, url, payload, digest(payload), "response" if response else "revisit", None if response else last_id))
                records += 1
                if archive.size >= ARCHIVE_BYTES:
                    yield close()
                    records = 0
        if records:
            yield close()

    out = joined.withColumn("first", F.lit(True))
    if not copies.where("most > 1").isEmpty():  # rows that repeat both id and payload: number them, so that one alone is the response
        twice = pairs.where("n > 1").select(F.col("key").alias("k"), F.col("page_id").alias("p"), F.lit(True).alias("again"))
        marked = out.join(twice, (F.col("key") == F.col("k")) & F.col("page_id").eqNullSafe(F.col("p")), "left").drop("k", "p")
        number = Window.partitionBy("key", "page_id").orderBy("url")
        out = marked.where("again IS NULL").unionByName(marked.where("again").withColumn("first", F.row_number().over(number) == 1)).drop("again")
    return cut(out.select("page_id", "url", "html", "last", "first").mapInArrow(run, schema), "archives")


RECORDS = "archive_id string, offset long, length long, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def records(archives: DataFrame, payload: bool = True) -> DataFrame:
    """A row per archived record, digests and lengths of stored payloads being those of the bytes read."""
    target = arrow_schema(archives.sparkSession, RECORDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive_id, data in zip(batch.column("archive_id").to_pylist(), batch.column("data").to_pylist(), strict=True):
                out: list[tuple] = []
                held = 0
                for at, n, h, body in read(data):
                    stored = h["WARC-Type"] == "response"
                    named = h["WARC-Payload-Digest"].removeprefix("sha1:")
                    if stored and (digest(body) != named or len(body) != int(h["X-Payload-Length"])):
                        raise ValueError(f"record at {at} of {archive_id} has another payload than its header says")
                    refers = h.get("X-Refers-To-Page", "")
                    out.append((archive_id, at, n, int(h["X-Page-Id"]) if h["X-Page-Id"] else None, h["WARC-Target-URI"], int(h["X-Payload-Length"]), digest(body) if stored else named, h["WARC-Type"], int(refers) if refers else None, body if stored and payload else None))
                    held += len(body)
                    if len(out) >= 1000 or held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], f.type) for k, f in enumerate(target)], schema=target)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], f.type) for k, f in enumerate(target)], schema=target)

    return archives.select("archive_id", "data").mapInArrow(run, RECORDS)


def export(archives: DataFrame, folder: str) -> list[str]:
    """Archives as .warc.zst files of a local folder, one after the other."""
    os.makedirs(folder, exist_ok=True)
    names = []
    for r in archives.select("archive_id", "data").toLocalIterator():
        names.append(f"{folder}/{r['archive_id']}.warc.zst")
        with open(names[-1], "wb") as f:
            f.write(r["data"])
    return names


def _sql() -> str:
    letter = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(v >> {} & 31 AS BIGINT) + 1, 1)"
    four = " || ".join(letter.format(k) for k in (15, 10, 5, 0))
    digits = " || ".join(f"({four.replace('v >>', f"CAST('0x' || substr(h, {5 * k + 1}, 5) AS BIGINT) >>")})" for k in range(8))
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, {digits} AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to
FROM p
"""


#: What the query of this operator returns, of pages with distinct ids.
SQL = _sql()

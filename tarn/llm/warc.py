"""WARC archives compressed record by record with a Zstandard dictionary that leads each file in a skippable frame."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, keyed, parted, partitions, shared_dir, small
from .shared_files import create, new_file, open_input

#: Magic number of the skippable frame that holds the dictionary (fixed value of the .warc.zst format).
DICT_MAGIC = 0x184D2A5D
#: Bounds of what the dictionary is built from: pages, and bytes of a sample.
SAMPLE, PIECE = 400, 16_384
DICT_BYTES, LEVEL = 65_536, 3
#: The fixed date of records: archives of the same pages are the same.
DATE = "2024-01-01T00:00:00Z"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL namespace (fixed value)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # (fixed value)


def record_id(page_id: int | None, url: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id} {url}')}>"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def http_head(size: int) -> bytes:
    """The head of the HTTP response that a page's body is archived as."""
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()


def encode_record(kind: str, page_id: int | None, url: str | None, payload: bytes | None, refers_to: int | None, refers_url: str | None, size: int = 0, digest: str = "") -> bytes:
    """One WARC/1.1 record of an HTTP response. A revisit has the length and digest of its payload in its head, and no payload."""
    if payload is not None:
        size, digest = len(payload), payload_digest(payload)
    block = http_head(size) + (b"" if kind == "revisit" else payload)
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, url)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Page-ID: {'' if page_id is None else page_id}", f"X-Payload-Length: {size}"]
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, refers_url)}", f"X-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def decode_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """The head's fields, and the payload: what follows the HTTP head in the block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8").split("\r\n")
    if first != "WARC/1.1":
        raise ValueError("not a WARC/1.1 record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    length = int(fields["Content-Length"])
    if rest[length:] != b"\r\n\r\n":
        raise ValueError("a record's length does not match its block")
    return fields, rest[:length].partition(b"\r\n\r\n")[2]


def dictionary_frame(dictionary: bytes) -> bytes:
    """The leading skippable frame; the dictionary in it is itself a Zstandard frame."""
    packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
    return struct.pack("<II", DICT_MAGIC, len(packed)) + packed


def read_dictionary(stream) -> bytes | None:
    """The dictionary of an archive, or None, with the stream at its first record."""
    head = stream.read(8)
    magic, size = struct.unpack("<II", head) if len(head) == 8 else (0, 0)
    if magic != DICT_MAGIC:
        stream.seek(0)
        return None
    return zstandard.ZstdDecompressor().decompress(stream.read(size))


def train(samples: list[bytes]) -> bytes | None:
    """A dictionary of archived records; None (records are then compressed without) where they are too few for one."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return None


def plan_records(pages: DataFrame, least: int, id_col: str, url_col: str, body_col: str) -> DataFrame:
    """page_id, url, payload (null: a revisit), size, sha1, and for revisits refers_to and refers_url.

    Rows of equal payloads meet by SHA-256, as ids and digests: first combined, before they are shuffled, to the largest of
    each payload, then to tell the revisits. Payloads stay where they are read, but for rows whose id may be a revisit's;
    those meet the revisits by id, address and digest, so a payload that a third of all pages share is no hot group.
    """
    rows = keyed(pages, page_id=id_col, url=url_col, payload=body_col)
    rows = rows.withColumn("payload", F.coalesce("payload", F.lit("")).cast("binary"))
    rows = rows.withColumn("key", F.sha2("payload", 256)).withColumn("size", F.length("payload").cast("long"))
    slim = rows.select("page_id", "url", "key", "size", F.sha1("payload").alias("sha1"))
    heads = slim.filter(F.col("size") >= least).groupBy("key").agg(
        F.max(F.struct("page_id", "url")).alias("first"), F.count(F.lit(1)).alias("n")
    )
    heads = cut(heads.filter("n > 1").select("key", "first"), "warc-heads")
    later = slim.join(heads, "key").filter(~F.struct("page_id", "url").eqNullSafe(F.col("first")))
    revisits = cut(later.select("page_id", "url", "key", "size", "sha1", F.col("first.page_id").alias("refers_to"), F.col("first.url").alias("refers_url")), "warc-revisits")
    maybe, rest = parted(rows, "page_id", revisits.select("page_id"))
    told = revisits.select(F.col("page_id").alias("_id"), F.col("url").alias("_url"), F.col("key").alias("_key")).distinct()
    same = F.col("page_id").eqNullSafe(F.col("_id")) & F.col("url").eqNullSafe(F.col("_url")) & (F.col("key") == F.col("_key"))
    first = rest.unionByName(maybe.join(told, same, "left_anti"))
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    kind = rows.schema["page_id"].dataType
    first = first.select("page_id", "url", "payload", "size", none("sha1", "string"), none("refers_to", kind), none("refers_url", "string"))
    return first.unionByName(revisits.select("page_id", "url", none("payload", "binary"), "size", "sha1", "refers_to", "refers_url"))


def write_archives(
    pages: DataFrame, folder: str | None = None, least: int = 0,
    id_col: str = "page_id", url_col: str = "url", body_col: str = "html", sample: int = SAMPLE,
) -> DataFrame:
    """Write one record for each row of pages, one archive for each task; returns the manifest.

    Of the rows whose payloads are equal and at least ``least`` bytes long, that with the largest page_id (then url) is a
    response, the others revisit it. A null body is an empty payload. A null page_id is smaller than any other; rows
    that repeat the response's id and url are responses too. The dictionary is trained once, from the records of at most
    ``sample`` pages (those whose id's hash is lowest) in pieces of PIECE bytes, and leads each archive.

    The manifest, a table in the shared folder, has for each archive: path, records, bytes, offsets (each record's
    place). An empty table writes no archives. Other columns are ignored.
    """
    spark = pages.sparkSession
    folder = folder or shared_dir(spark, "warc")
    some = keyed(pages, page_id=id_col, url=url_col, payload=body_col)
    few = [r[0] for r in some.select("page_id").filter("page_id is not null").orderBy(F.xxhash64("page_id"), "page_id").limit(sample).collect()]
    taken: list[bytes] = []
    for r in some.filter(F.col("page_id").isin(few)).toLocalIterator():
        data = (r["payload"] or "").encode("utf-8", "surrogatepass")
        record = encode_record("response", r["page_id"], r["url"], data, None, None)
        taken += [record[i : i + PIECE] for i in range(0, len(record), PIECE)]
    dictionary = train(sorted(taken))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        if d:
            d.precompute_compress(level=LEVEL)
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=True)
        out, path, at, offsets = None, "", 0, []
        for batch in small(batches):
            for i in range(batch.num_rows):
                if out is None:
                    path = new_file(folder, "pages", ".warc.zst")
                    out = create(path)
                    lead = dictionary_frame(dictionary) if dictionary else b""
                    out.write(lead)
                    at = len(lead)
                page, url, body, length, sha1, refers, refers_url = (c[i].as_py() for c in batch.columns)
                digest = base64.b32encode(bytes.fromhex(sha1 or "")).decode()
                data = packer.compress(encode_record("response" if sha1 is None else "revisit", page, url, body, refers, refers_url, length, digest))
                out.write(data)
                offsets.append(at)
                at += len(data)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([path]), pa.array([len(offsets)], pa.int64()), pa.array([at], pa.int64()), pa.array([offsets], pa.list_(pa.int64()))],
                names=["path", "records", "bytes", "offsets"],
            )

    records = plan_records(pages, least, id_col, url_col, body_col)
    return cut(records.mapInArrow(write, "path string, records long, bytes long, offsets array<long>"), "warc-manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """The records of the archives that a manifest names: type, id, url, digest, length and body (null for revisits).

    Each record is read by its offset and unpacked alone, with the dictionary that leads its own file.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            for path, size, offsets in zip(batch.column("path").to_pylist(), batch.column("bytes").to_pylist(), batch.column("offsets").to_pylist(), strict=True):
                with open_input(path) as f:
                    d = read_dictionary(f)
                    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(d) if d else None)
                    ends = [*offsets[1:], size]
                    for k in range(0, len(offsets), 64):
                        rows = []
                        for a, b in zip(offsets[k : k + 64], ends[k : k + 64], strict=True):
                            head, body = decode_record(unpack.decompress(f.read_at(b - a, a)))
                            page, refers = head["X-Page-ID"], head.get("X-Refers-To-Page-ID")
                            rows.append({
                                "page_id": int(page) if page else None, "url": head.get("WARC-Target-URI"), "record_type": head["WARC-Type"],
                                "payload_bytes": int(head["X-Payload-Length"]), "payload_digest": head["WARC-Payload-Digest"].removeprefix("sha1:"),
                                "refers_to": int(refers) if refers and refers != "None" else None, "body": None if head["WARC-Type"] == "revisit" else body,
                            })
                        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([
                            ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()),
                            ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("body", pa.binary()),
                        ]))

    spark = manifest.sparkSession
    n = max(1, min(partitions(spark), manifest.count()))
    spread = manifest.repartition(n)
    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, body binary"
    return spread.mapInArrow(read, schema)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = read_archives(write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Where the digests' bytes go: base32 of a SHA-1 as text, five bits at a time.
OP5_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body FROM pages
), d AS (
  SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha1(body) AS hex,
         max(page_id) OVER (PARTITION BY body) AS head
  FROM p
), b AS (
  SELECT *, list_transform(generate_series(0, 39), lambda i: instr('0123456789abcdef', substr(hex, (i + 1)::INT, 1)) - 1) AS nibbles FROM d
), w AS (
  SELECT *, list_transform(generate_series(0, 31), lambda k:
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((
      (nibbles[(k * 5 // 4 + 1)::BIGINT] * 16 + coalesce(nibbles[(k * 5 // 4 + 2)::BIGINT], 0)) // (1 << (3 - k * 5 % 4)::INT)) % 32 + 1)::BIGINT]) AS letters
  FROM b
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, array_to_string(letters, '') AS payload_digest,
       CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = head THEN NULL ELSE head END AS refers_to
FROM w
"""

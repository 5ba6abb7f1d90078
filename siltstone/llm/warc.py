"""WARC archives: records written in segments with chunked framing, read back, reassembled and checked."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, map_arrow, written

#: A record larger than this goes on in continuation records.
SEGMENT_BYTES = 16 << 10
CHUNK_BYTES = 8 << 10
#: Records in a file, and so at most 8 MB of them.
FILE_RECORDS = 500
#: Copies of one payload are dealt over so many parts of a join.
SALTS = 8
END = b"\r\n\r\n"
#: First bytes of a gzip file.
GZIP = b"\x1f\x8b"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(part), part) for at in range(0, len(payload), size) if (part := payload[at : at + size])]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload of chunked transfer framing; chunk extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        at = end + 2
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk does not end where its size says")
        out.append(body[at : at + size])
        at += size + 2


def _head(kind: str, fields: list[tuple[str, object]], length: int) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *[f"{k}: {v}" for k, v in fields if v is not None], f"Content-Length: {length}"]
    return "\r\n".join(lines).encode() + END


def _line(text: str | None) -> str | None:
    """text as it can stand in a header line."""
    return None if text is None else re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def records(page_id, url: str | None, payload: bytes, refers_to, name: str, segment: int = SEGMENT_BYTES) -> list[bytes]:
    """The records of one page, without the blank lines that end each: one, or one a segment."""
    digest = base32_sha1(payload)
    fields = [("WARC-Record-ID", f"<{name}>"), ("WARC-Date", "2000-01-01T00:00:00Z"), ("WARC-Target-URI", _line(url)), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Page-Id", page_id)]
    if refers_to is not None:
        more = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("Refers-To-Page-Id", refers_to)]
        return [_head("revisit", fields + more, 0)]
    fields.append(("Content-Type", "application/http; msgtype=response"))
    block = HTTP + chunked(payload)
    if len(block) <= segment:
        return [_head("response", fields, len(block)) + block]
    parts = [block[at : at + segment] for at in range(0, len(block), segment)]
    out = [_head("response", [*fields, ("WARC-Segment-Number", 1)], len(parts[0])) + parts[0]]
    for i, part in enumerate(parts[1:], 2):
        more = [("WARC-Record-ID", f"<{name}:{i}>"), ("WARC-Date", "2000-01-01T00:00:00Z"), ("WARC-Segment-Origin-ID", f"<{name}>"), ("WARC-Segment-Number", i)]
        if i == len(parts):
            more.append(("WARC-Segment-Total-Length", len(block)))
        out.append(_head("continuation", more, len(part)) + part)
    return out


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case; the type as warc-type) and block of each record of an archive."""
    at = 0
    while at < len(data):
        end = data.index(END, at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:])}
        start = end + 4
        at = start + int(fields["content-length"])
        if data[at : at + 4] != END:
            raise ValueError("a record does not end where its length says")
        yield fields, data[start:at]
        at += 4


def _to_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, row = TaskContext.get().partitionId() if TaskContext.get() else 0, 0
    for batch in batches:
        out, held = [], 0
        for page_id, url, payload, refers_to in zip(*[c.to_pylist() for c in batch.columns]):
            made = records(page_id, url, payload or b"", refers_to, f"urn:page:{page_id}:{part}:{row}")
            row += 1
            out += made
            held += sum(map(len, made))
            if held > 8 << 20:
                yield pa.record_batch([pa.array(out, pa.binary())], ["record"])
                out, held = [], 0
        if out:
            yield pa.record_batch([pa.array(out, pa.binary())], ["record"])


def write_archives(pages: DataFrame, path: str, minimum: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write pages as WARC files into the folder path.

    Of rows with equal payloads of at least ``minimum`` bytes, that with the largest id is a response and the others
    revisit it; rows with smaller payloads are all responses. The text writer's line separator is the two blank lines
    that end a record, so the files are archives, compressed whole by gzip, written and committed by Spark in any store it knows.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.select("*", F.sha1("payload").alias("digest"))
    same = rows.where(F.length("payload") >= minimum).groupBy("digest").agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null")
    same = same.select(F.col("digest").alias("s_digest"), "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s_salt"))
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")
    met = rows.withColumn("salt", salt).join(same, (F.col("digest") == F.col("s_digest")) & (F.col("salt") == F.col("s_salt")), "left")
    refers = F.when((F.col("id").isNull() & F.col("first").isNotNull()) | (F.col("id") < F.col("first")), F.col("first"))
    made = map_arrow(met.select("id", "url", "payload", refers.alias("refers_to")), _to_records, "record binary")
    made.select(F.col("record").cast("string").alias("value")).write.option("lineSep", END.decode()).option("maxRecordsPerFile", FILE_RECORDS).option("compression", "gzip").text(path)


def _from_archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["origin", "segment", "total", "id", "kind", "url", "digest", "refers_to", "block"]
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    number = lambda x: int(x) if x not in (None, "None") else None

    def ready(rows):
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    for batch in batches:
        for content in batch.column(0):
            rows, held = [], 0
            data = content.as_py()
            for f, block in parse(gzip.decompress(data) if data[:2] == GZIP else data):
                whole = f["warc-type"] == "response" and "warc-segment-number" not in f
                origin = None if whole or f["warc-type"] == "revisit" else f.get("warc-segment-origin-id", f["warc-record-id"])
                rows.append((origin, number(f.get("warc-segment-number")), number(f.get("warc-segment-total-length")), number(f.get("page-id")), f["warc-type"], f.get("warc-target-uri"), f.get("warc-payload-digest", "").removeprefix("sha1:") or None, number(f.get("refers-to-page-id")), block))
                held += len(block)
                if held > 8 << 20:
                    yield ready(rows)
                    rows, held = [], 0
            if rows:
                yield ready(rows)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", "record_type", "url", "payload", "payload_digest", "refers_to"]
    for batch in batches:
        payloads, digests = [], []
        for kind, digest, block in zip(batch.column("kind").to_pylist(), batch.column("digest").to_pylist(), batch.column("block")):
            if kind == "revisit":
                payloads.append(None)
                digests.append(digest)
                continue
            head, _, body = block.as_py().partition(END)
            payload = unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body
            if base32_sha1(payload) != digest:
                raise ValueError("a payload does not have its digest")
            payloads.append(payload)
            digests.append(digest)
        yield pa.record_batch([batch.column("id"), batch.column("kind"), batch.column("url"), pa.array(payloads, pa.binary()), pa.array(digests, pa.string()), batch.column("refers_to")], names)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Pages of the WARC files in the folder path, plain or gzip (whole or by record): id, record_type, url, payload, payload_digest, refers_to.

    Continuation records are grouped by their origin's id, ordered by segment number and joined; a gap in the
    numbers or a sum of lengths other than WARC-Segment-Total-Length is an error. Chunked framing is then decoded
    and the digest checked. A group is one record's segments, no more. payload is null for revisits.
    """
    seen = map_arrow(spark.read.format("binaryFile").load(path).select("content"), _from_archives, "origin string, segment int, total long, id long, kind string, url string, digest string, refers_to long, block binary")
    fields = ["id", "kind", "url", "digest", "refers_to"]
    single = seen.where("origin is null").select(*fields, "block")
    parts = F.sort_array(F.collect_list(F.struct("segment", "block")))
    split = seen.where("origin is not null").groupBy("origin").agg(parts.alias("parts"), F.max("total").alias("total"), *[F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c) for c in fields])
    block = F.expr("aggregate(parts, cast('' as binary), (a, x) -> concat(a, x.block))")
    split = split.withColumn("block", block)
    sound = (F.col("total") == F.length("block")) & (F.element_at("parts", -1)["segment"] == F.size("parts")) & F.col("kind").isNotNull()
    split = split.withColumn("block", F.when(F.coalesce(sound, F.lit(False)), F.col("block")).otherwise(F.raise_error(F.concat(F.lit("segments missing of "), F.col("origin"))).cast("binary")))
    return map_arrow(single.union(split.select(*fields, "block")).select("id", "kind", "url", "digest", "refers_to", "block"), _decode, "id long, record_type string, url string, payload binary, payload_digest string, refers_to long")


def resolved(pages: DataFrame) -> DataFrame:
    """pages with payload_bytes, a revisit's taken from the response that it refers to."""
    out = pages.select("id", "url", "payload_digest", "record_type", "refers_to", F.length("payload").cast("long").alias("n"))
    out = written(out, "warc-read")
    revisits = out.where("record_type = 'revisit'").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).drop("n")
    wanted = out.where("record_type = 'response'").groupBy(F.col("id").alias("w_id"), F.col("payload_digest").alias("w_digest")).agg(F.max("n").alias("n"))
    wanted = wanted.join(revisits.select(F.col("refers_to").alias("w_id")).distinct(), "w_id", "left_semi")
    wanted = wanted.withColumn("w_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = revisits.join(wanted, (F.col("refers_to") == F.col("w_id")) & (F.col("payload_digest") == F.col("w_digest")) & (F.col("salt") == F.col("w_salt")), "left")
    names = ["id", "url", "n", "payload_digest", "record_type", "refers_to"]
    return out.where("record_type <> 'revisit'").select(names).union(met.select(names)).withColumnRenamed("n", "payload_bytes")


def archive_round_trip(pages: DataFrame, path: str | None = None, **columns) -> DataFrame:
    """Write pages as archives (in the shared folder unless path is given) and read these back: see the two above.

    Null html: an empty payload. Null url: no target URI. Null ids: written as such; they never are the response of
    a group that has an id. Rows with the same id and payload: each is a record, all of the largest id responses.
    No rows: no rows.
    """
    spark = pages.sparkSession
    path = path or fresh_path(spark, "warc")
    write_archives(pages, path, **columns)
    return resolved(read_archives(spark, path))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = archive_round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return back.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")

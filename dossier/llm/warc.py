"""WARC archives: a writer with deduplicated payloads, and a splittable reader.

Each record is a gzip member of its own. The reader's tasks each take a range of bytes, look for the magic bytes of a gzip
member, accept a place only if what it decompresses to begins with a WARC header, and own the records that start in their
range, reading past its end for the last one. So one large file is read by many tasks, each holding a block of bytes and
one record. A member with a WARC header that is cut short or damaged, or of which a record is, is passed over and can be asked for
(``with_damaged``); the reader goes on at the next magic bytes.

Which records are revisits follows from ids and digests alone; payloads move only where more digests repeat than a
broadcast may hold. A revisit names the response's record id, which follows from page_id and digest.

A task writes to a file with a name that no other attempt uses, and the names that count come from the manifest, a table
that only holds what successful attempts returned. Files are opened by URI (local paths, hdfs, s3, gs), as Spark has no
writer for binary files.

Defined results: a null html is an empty payload; a null url leaves the target out; ids of any type that text can show;
records of equal payloads of ``min_revisit_bytes`` or more refer to the one of largest page_id, and rows that repeat that
page_id with the payload are responses each (with one record id); a null page_id is never the largest while there are
others, and such a record is a response only if all of its equals lack one too; payloads of any length are one record; an
empty table gives no file; columns besides page_id, url and html are not looked at, so their names can't clash.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import few, materialise, scratch_dir

MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "file string, records bigint, bytes bigint"
RECORD = "page_id string, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to string, record_id string"


def decide(pages: DataFrame, min_revisit_bytes: int = 1000) -> DataFrame:
    """page_id, url, payload (null for revisits), payload_bytes, payload_digest, record_type, refers_to."""
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha1("payload"))
    # short payloads never meet: a key of its own for each keeps them from one place
    rows = rows.withColumn("__key", F.when(F.col("payload_bytes") >= min_revisit_bytes, F.col("payload_digest")).otherwise(F.concat(F.lit("-"), F.coalesce(F.col("page_id").cast("string"), "payload_digest"))))
    same = rows.where(F.col("payload_bytes") >= min_revisit_bytes).groupBy("__key").agg(F.max("page_id").alias("__first"), F.count("*").alias("__n"))
    out = rows.join(few(same.where("__n > 1").select("__key", "__first")), "__key", "left")
    out = out.withColumn("refers_to", F.expr("CASE WHEN NOT page_id <=> __first THEN __first END"))
    revisit = F.col("refers_to").isNotNull()
    return out.select(
        "page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), "refers_to",
    )


def record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{digest}')}>"


def _escaped(x: str) -> str:
    return x.replace("\\", "\\\\").replace("\r", "\\r").replace("\n", "\\n")


def _plain(x: str | None) -> str | None:
    return x if x is None or "\\" not in x else "".join({"\\r": "\r", "\\n": "\n", "\\\\": "\\"}.get(y, y) for y in re.findall(r"\\.|[^\\]+", x))


def encode_record(row: dict) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    revisit = row["record_type"] == "revisit"
    block = http if revisit else http + row["payload"]
    head = [
        "WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {record_id(row['page_id'], row['payload_digest'])}", "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{row['payload_digest']}", f"X-Payload-Length: {row['payload_bytes']}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if row["page_id"] is not None:
        head.append("X-Page-ID: " + _escaped(str(row["page_id"])))
    if row["url"] is not None:
        head.append("WARC-Target-URI: " + _escaped(row["url"]))
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(row['refers_to'], row['payload_digest'])}", "X-Refers-To-Page: " + _escaped(str(row["refers_to"]))]
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def _fields(head: bytes) -> dict[str, str]:
    """Header fields by their names in small letters; a line that starts with white space goes on with the one before."""
    lines = re.sub(r"\r?\n[ \t]+", " ", head.decode("utf-8", "replace")).split("\r\n")[1:]
    return {k.strip().lower(): v.strip(" \t") for k, _, v in (x.partition(":") for x in lines)}


def _hex_digest(said: str | None) -> str | None:
    """The hex digits of a SHA-1 that is given in them or, as is usual, in base 32; other digests as they stand."""
    name, _, value = (said or "").partition(":")
    if name.lower() != "sha1":
        return said
    return base64.b32decode(value.upper()).hex() if len(value) == 32 else value.lower()


def decode_records(raw: bytes) -> list[dict]:
    """The records of a gzip member, which are one unless the whole file is a member; ValueError if one is cut short.

    Only blocks of HTTP messages have headers of their own before the payload; of all others the block is the payload.
    """
    out, at = [], 0
    while raw.startswith(b"WARC/", at):
        end = raw.find(b"\r\n\r\n", at)
        fields = _fields(raw[at : max(end, at)])
        start, size = end + 4, int(fields.get("content-length", -1))
        block = raw[start : start + size]
        if end < 0 or size < 0 or len(block) < size:
            raise ValueError("a record is cut short")
        kind = fields.get("warc-type", "").lower()
        row = {"page_id": _plain(fields.get("x-page-id")), "url": _plain(fields.get("warc-target-uri")), "record_type": kind, "record_id": fields.get("warc-record-id"), "refers_to": _plain(fields.get("x-refers-to-page", fields.get("warc-refers-to")))}
        if kind == "revisit":
            length = fields.get("x-payload-length", "")
            out.append(row | {"payload": None, "payload_bytes": int(length) if length.isdigit() else None, "payload_digest": _hex_digest(fields.get("warc-payload-digest"))})
        else:
            payload = block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").lower().startswith("application/http") else block
            out.append(row | {"payload": payload, "payload_bytes": len(payload), "payload_digest": hashlib.sha1(payload).hexdigest()})
        at = start + size
        while raw.startswith(b"\r\n", at):
            at += 2
    if not out or at < len(raw):
        raise ValueError("what follows is no record")
    return out


def write(records: DataFrame, path: str) -> DataFrame:
    """Writes records (as from decide) under path; returns the manifest, a row for each file, as written to the scratch folder."""

    def run(batches):
        fs, root = pyarrow.fs.FileSystem.from_uri(path)
        name = f"part-{uuid.uuid4().hex}.warc.gz"
        n, size, out = 0, 0, None
        for b in batches:
            for at in range(0, b.num_rows, 64):
                for row in b.slice(at, 64).to_pylist():
                    if out is None:
                        fs.create_dir(root, recursive=True)
                        out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    raw = encode_record(row)
                    out.write(raw)
                    n, size = n + 1, size + len(raw)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [f"{path}/{name}"], "records": [n], "bytes": [size]})

    return materialise(records.mapInArrow(run, MANIFEST))


def scan_range(data, start: int, end: int, size: int, block: int = 1 << 20, feed: int = 1 << 15):
    """(place, record) of the members that start in the bytes start to end of an open file of the given size.

    The record is decompressed, or None if the member has a WARC header but is cut short or damaged. Bytes are read by the
    block and given to the decompressor in smaller parts, so that little is copied behind a record's end.
    """
    buffer, base, at = b"", start, 0  # the bytes of the file from base on, and the place in them

    def more() -> bool:
        nonlocal buffer, base, at
        beyond = base + len(buffer)
        if beyond >= size:
            return False
        data.seek(beyond)
        buffer, base, at = buffer[at:] + data.read(min(block, size - beyond)), base + at, 0
        return True

    while True:
        found = buffer.find(MAGIC, at)
        while found < 0:
            at = max(at, len(buffer) - 2)
            if base + at >= end or not more():
                return
            found = buffer.find(MAGIC, at)
        at = found
        if base + at >= end:
            return
        unpack, parts, fed, valid = zlib.decompressobj(31), [], at, None
        try:
            while not unpack.eof:
                if fed == len(buffer):
                    fed -= at  # reading on drops what lies before the member
                    if not more():
                        break
                chunk = buffer[fed : fed + (64 if valid is None else feed)]  # little until the header is seen
                parts.append(unpack.decompress(chunk))
                fed += len(chunk)
                if valid is None and sum(map(len, parts)) >= 5:
                    parts = [b"".join(parts)]
                    valid = parts[0].startswith(b"WARC/")
                    if not valid:
                        break
        except zlib.error:
            pass
        whole = unpack.eof and valid
        if valid:
            yield base + at, b"".join(parts) if whole else None
        # else magic bytes by chance
        at = fed - len(unpack.unused_data) if whole else at + 1


def files(spark: SparkSession, path: str) -> DataFrame:
    """file, bytes of the archives at a path (a folder or a pattern), as read wants them; none is opened."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("bytes"))


def read(spark: SparkSession, manifest: DataFrame, *, split_bytes: int = 8 << 20, with_damaged: bool = False) -> DataFrame:
    """The records of the manifest's files (file, bytes; those of files() will do), each file read in ranges of split_bytes.

    Archives of other writers have records of further types (warcinfo, request, metadata, ...), revisits that name a record
    in place of a page, and no page_id.

    with_damaged adds a row for each damaged member, of record_type damaged, with its place in payload_bytes.
    """
    ranges = manifest.where("bytes > 0").select("file", "bytes", F.explode(F.sequence(F.lit(0), F.col("bytes") - 1, F.lit(split_bytes))).alias("start"))
    # a fixed number of partitions: the rows are tiny, so adaptive execution would put all ranges into one task
    n = manifest.agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0] or 1
    ranges = ranges.repartition(min(int(n), 20_000), F.col("file"), F.col("start"))
    names = [x.split()[0] for x in RECORD.split(", ")]
    kinds = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
    batch = lambda held: pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in held], k) for c, k in zip(names, kinds, strict=True)], names)

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                fs, path = pyarrow.fs.FileSystem.from_uri(row["file"])
                with fs.open_input_file(path) as data:
                    held, size = [], 0
                    for place, raw in scan_range(data, row["start"], row["start"] + split_bytes, row["bytes"]):
                        try:
                            if raw is None:
                                raise ValueError("a member is damaged")
                            held += decode_records(raw)
                            size += len(raw)
                        except ValueError:
                            held += [{"record_type": "damaged", "payload_bytes": place}] * with_damaged
                        if size > 4 << 20:
                            yield batch(held)
                            held, size = [], 0
                    if held:
                        yield batch(held)

    return ranges.mapInArrow(run, RECORD)


def round_trip(pages: DataFrame, *, path: str | None = None, min_revisit_bytes: int = 1000, split_bytes: int = 8 << 20) -> DataFrame:
    """Writes pages as WARC (to path, else the scratch folder) and reads the records back, ids in the type of page_id."""
    manifest = write(decide(pages, min_revisit_bytes), path or scratch_dir(pages.sparkSession))
    kind = pages.schema["page_id"].dataType
    return read(pages.sparkSession, manifest, split_bytes=split_bytes).drop("record_id").withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")})

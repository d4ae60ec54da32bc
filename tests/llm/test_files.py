"""Shards as written, and WARC archives with damaged members, magic bytes in payloads and long records."""

from __future__ import annotations

import hashlib
import io
import os
import random
import zlib
from collections import Counter, defaultdict

from dossier.llm import sharding, warc

PAGES = "page_id bigint, url string, html string"


def test_written_shards_hold_every_record_once_in_slot_order(spark, odd, tmp_path):
    rows = [(f"id{i % 40}", f"text {i % 7} {'y' * 300}", "l", 5) for i in range(300)] + [(None, None, "l", 5), ("id0", "", "l", 5)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, lang string, slot bigint")
    path = f"{tmp_path}/shards"
    sharding.write_shards(docs, path, 5, bucket_bytes=2000)
    back = spark.read.parquet(path)
    assert Counter((r["doc_id"], r["text"], r["lang"]) for r in back.collect()) == Counter(r[:3] for r in rows)
    slots = defaultdict(list)
    for r in back.collect():
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and back.agg({"bucket": "max"}).first()[0] > 3
    for shard in slots:
        folder = f"{path}/shard={shard}"
        for file in os.listdir(folder):
            if file.endswith(".parquet"):
                own = [(r["bucket"], r["slot"]) for r in spark.read.parquet(f"{folder}/{file}").collect()]
                assert own == sorted(own)


def test_slots_dont_depend_on_the_layout(spark):
    docs = spark.createDataFrame([(i, f"t{i} " * 50) for i in range(400)], "doc_id bigint, text string")
    take = lambda df: sorted((r["doc_id"], r["shard"], r["slot"]) for r in sharding.with_slots(sharding.shuffled(df, 4, bucket_bytes=5000)).collect())
    assert take(docs.repartition(3)) == take(docs.repartition(11))


def test_a_record_repeated_very_often_is_spread(spark):
    docs = spark.range(600).selectExpr("IF(id < 400, 1, id) AS doc_id", "IF(id < 400, repeat('z', 100), concat('u', id)) AS text")
    rows = sharding.shuffled(docs, 3, bucket_bytes=4000).collect()
    hot = Counter(r["bucket"] for r in rows if r["doc_id"] == 1)
    assert len(rows) == 600 and len({r["shard"] for r in rows if r["doc_id"] == 1}) == 1 and max(hot.values()) < 100


def test_damaged_members_are_told_and_the_rest_is_read(spark, tmp_path):
    record = lambda i, text: warc.encode_record({"page_id": i, "url": "u", "payload": text, "payload_bytes": len(text), "payload_digest": hashlib.sha1(text).hexdigest(), "record_type": "response", "refers_to": None})
    rng = random.Random(1)
    noise = lambda n: bytes(rng.randrange(256) for _ in range(n))
    texts = [b"<p>one", noise(5000), warc.MAGIC + noise(40) + warc.MAGIC, zlib.compress(b"x" * 999) + b"\x1f\x8b\x08", record(9, b"inner")]
    members = [record(i, t) for i, t in enumerate(texts)]
    cut_short, broken = record(7, noise(3000))[:1500], bytearray(record(8, noise(3000)))
    broken[2000:2010] = b"\0" * 10
    data = b"".join([members[0], cut_short, members[1], b"junk", members[2], bytes(broken), members[3], members[4], record(6, noise(900))[:-30]])
    path = f"{tmp_path}/a.warc.gz"
    with open(path, "wb") as f:
        f.write(data)
    for split in (1 << 20, 701, 64):
        manifest = spark.createDataFrame([(f"file://{path}", 5, len(data))], warc.MANIFEST)
        rows = warc.read(spark, manifest, split_bytes=split, with_damaged=True).collect()
        whole = {r["page_id"]: bytes(r["payload"]) for r in rows if r["record_type"] == "response"}
        assert whole == {str(i): t for i, t in enumerate(texts)} and sum(r["record_type"] == "damaged" for r in rows) == 3
        assert warc.read(spark, manifest, split_bytes=split).count() == 5
    # small blocks and feeds find the same members
    found = [raw for _, raw in warc.scan_range(io.BytesIO(data), 0, len(data), len(data), block=100, feed=7) if raw]
    assert [row["payload"] for r in found for row in warc.decode_records(r)] == texts


def test_revisits_name_the_record_of_the_response(spark, tmp_path):
    big = "<p>" + "long " * 400
    pages = spark.createDataFrame([(1, "http://a", big), (2, None, big), (3, "u", "short"), (4, "u", "short")], PAGES)
    manifest = warc.write(warc.decide(pages), f"file://{tmp_path}/w")
    heads = []
    for r in manifest.collect():
        with open(r["file"][7:], "rb") as f:
            heads += [dict(x.partition(": ")[::2] for x in raw.split(b"\r\n\r\n")[0].decode().split("\r\n")) for _, raw in warc.scan_range(f, 0, r["bytes"], r["bytes"])]
    by_id = {h["WARC-Record-ID"]: h for h in heads}
    revisits = [h for h in heads if h["WARC-Type"] == "revisit"]
    assert len(by_id) == 4 and [by_id[h["WARC-Refers-To"]]["X-Page-ID"] for h in revisits] == ["2"] and revisits[0]["X-Page-ID"] == "1"


def test_odd_pages(spark):
    """String ids, very long payloads, clashing columns, repeated rows, an empty table."""
    long = "".join(chr(97 + i * i % 26) for i in range(3000)) * 1000
    rows = [("b\n1", "u", long, "x"), ("a", "u", long, "y"), ("a", "u", long, "y"), (None, "u", long, "y"), ("c", None, None, "z")]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string, payload string")
    got = sorted((str(r["page_id"]), r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.round_trip(pages, split_bytes=1 << 12).collect())
    assert got == [("None", "revisit", "b\n1", len(long)), ("a", "revisit", "b\n1", len(long)), ("a", "revisit", "b\n1", len(long)), ("b\n1", "response", None, len(long)), ("c", "response", None, 0)]
    assert warc.round_trip(pages.limit(0)).count() == 0
    same = spark.createDataFrame([(None, "u", "s" * 2000), (None, "v", "s" * 2000)], PAGES)
    assert {r["record_type"] for r in warc.round_trip(same).collect()} == {"response"}


def test_archives_of_other_writers(spark, tmp_path):
    """Records of all types, headers in any case and folded, base-32 digests, several records a member."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"

    def record(kind, block, *more, version="WARC/1.0"):
        head = [version, f"WARC-Type: {kind}", f"warc-record-id: <urn:x:{kind}>", *more, f"content-length:{len(block)}"]
        return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    zipped = lambda raw: (z := zlib.compressobj(6, zlib.DEFLATED, 31)).compress(raw) + z.flush()
    digest = "sha1:" + __import__("base64").b32encode(hashlib.sha1(b"<p>x").digest()).decode()
    members = [
        record("warcinfo", b"software: other/1.0\r\nformat: WARC File Format 1.0\r\n", "Content-Type: application/warc-fields"),
        record("request", b"GET / HTTP/1.1\r\nHost: a.example\r\n\r\n", "Content-Type: application/http; msgtype=request", "WARC-Target-URI: http://a.example/"),
        record("response", http + b"<p>x", "CONTENT-TYPE: application/http;msgtype=response", "WARC-Target-URI:\r\n http://a.example/", version="WARC/1.1"),
        record("revisit", http, "Content-Type: application/http", "WARC-Refers-To: <urn:x:response>", f"WARC-Payload-Digest: {digest}"),
        record("metadata", b"via: http://b.example/\r\n\r\nrest") + record("resource", b"plain\r\n\r\ntext") + record("response", b"HTTP/1.1 204 None", "Content-Type: application/http"),
        record("conversion", b""), record("response", http + b"<p>", "Content-Type: application/http")[:-20],
    ]
    (tmp_path / "other.warc.gz").write_bytes(b"".join(map(zipped, members)))
    rows = warc.read(spark, warc.files(spark, f"file://{tmp_path}/*.warc.gz"), split_bytes=100, with_damaged=True).collect()
    got = [(r["record_type"], r["url"], r["payload"] and bytes(r["payload"]), r["payload_bytes"]) for r in rows]
    assert Counter(got) == Counter([
        ("warcinfo", None, b"software: other/1.0\r\nformat: WARC File Format 1.0\r\n", 51), ("request", "http://a.example/", b"", 0), ("response", "http://a.example/", b"<p>x", 4), ("revisit", None, None, None),
        ("metadata", None, b"via: http://b.example/\r\n\r\nrest", 30), ("resource", None, b"plain\r\n\r\ntext", 13), ("response", None, b"", 0), ("conversion", None, b"", 0),
        ("damaged", None, None, next(r["payload_bytes"] for r in rows if r["record_type"] == "damaged")),
    ])
    revisit = next(r for r in rows if r["record_type"] == "revisit")
    assert revisit["refers_to"] == "<urn:x:response>" and revisit["payload_digest"] == hashlib.sha1(b"<p>x").hexdigest()

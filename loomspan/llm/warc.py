"""WARC archives with a two-level capture index.

Records are written in the order of their reversed-host URL keys, each a gzip member of its own. Their captures, in the
same order, are cut into blocks of ``BLOCK`` lines, each compressed; a sparse directory keeps the first and last key,
place and length of every block. A lookup finds the shards of a key in the shards' key ranges, its blocks by binary
search in the shard's directory, its lines by binary search in the block, and then reads only the records' byte ranges.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.llm.files import open_new, open_range
from loomspan.operators.tables import new_path, written

#: Captures of a compressed index block; payload bytes from which equal payloads are stored once; bytes of a closed file.
BLOCK, REVISIT_BYTES, FILE_BYTES, LEVEL = 512, 100, 64 << 20, 4
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: Column) -> Column:
    """Host labels from the top domain down, then port, path and query; white space and controls as %20; null is empty."""
    clean = F.regexp_replace(F.coalesce(url, F.lit("")), r"[\x00-\x20\x7f]", "%20")
    parts = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]*)(.*)$"
    host = F.array_join(F.reverse(F.split(F.lower(F.regexp_extract(clean, parts, 1)), r"\.")), ",")
    return F.when(clean.rlike(parts), F.concat(host, F.lit(")"), F.regexp_extract(clean, parts, 2))).otherwise(clean)


def _record(row: dict) -> bytes:
    response = row["refers_to"] is None
    payload = row["payload"] if response else b""
    body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode() + payload
    url = "".join(c if c > " " and c != "\x7f" else "%20" for c in row["url"] or "")
    name = "none-" + uuid.uuid4().hex if row["page_id"] is None else row["page_id"]
    head = [f"WARC/1.1\r\nWARC-Type: {'response' if response else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha256:{row['digest']}"]
    if not response:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{row['refers_to']}>"]
    head += [f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(body)}\r\n\r\n"]
    return "\r\n".join(head).encode() + body + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """The page id, url, type, reference, payload (None for revisits), its length and digest, of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    number = lambda x: None if x.startswith("<urn:page:none-") else int(x[len("<urn:page:") : -1])
    response = fields["WARC-Type"] == "response"
    said = int(next(line.split(b": ")[1] for line in http.split(b"\r\n") if line.startswith(b"Content-Length: ")))
    return {
        "page_id": number(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"],
        "refers_to": None if response else number(fields["WARC-Refers-To"]), "payload": payload if response else None,
        "payload_bytes": len(payload) if response else said,
        "payload_digest": hashlib.sha256(payload).hexdigest() if response else fields["WARC-Payload-Digest"].removeprefix("sha256:"),
    }


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes archives and index, and returns the directory ``(shard, block, first_key, last_key, uri, offset, length)``.

    Of records with equal payloads of ``REVISIT_BYTES`` or more, that with the smallest id is the response and the
    others revisit it. Null html is an empty payload, a null url an empty key; rows of one id repeat as they come; a
    null id keeps its record. Files are named by attempt and listed only by the task that ended.
    """
    folder = new_path(pages.sparkSession, "warc")
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    some = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    some = some.select("*", url_key(F.col("url")).alias("key"), F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    copies = some.where(f"payload_bytes >= {REVISIT_BYTES}").groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    copies = written(copies.drop("n"), "copies")
    marked = some.join(copies, "digest", "left").withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))
    columns = ["key", "page_id", "url", "payload", "digest", "payload_bytes", "refers_to"]

    def write(batches):
        shard, seq, held = TaskContext.get().partitionId(), 0, []
        out, at, uri = None, 0, ""
        index, index_at = bytearray(), 0
        index_uri = f"{folder}/index-{shard:06d}-{uuid.uuid4().hex}.cdx.gz"
        found = []

        def close_block():
            nonlocal index_at, held
            packed = zlib.compress("\n".join(line for _, line in held).encode(), 6)
            index.extend(packed)
            found.append((shard, len(found), held[0][0], held[-1][0], index_uri, index_at, len(packed)))
            index_at += len(packed)
            held = []

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    uri, at = f"{folder}/pages-{shard:06d}-{seq:06d}-{uuid.uuid4().hex}.warc.gz", 0
                    out = open_new(uri)
                packed = gzip.compress(_record(row), LEVEL, mtime=0)
                out.write(packed)
                held.append((row["key"], f"{row['key']} {DATE} " + json.dumps({"uri": uri, "offset": at, "length": len(packed)})))
                at += len(packed)
                if len(held) == BLOCK:
                    close_block()
                if at >= FILE_BYTES:
                    out.close()
                    out, seq = None, seq + 1
        if out is not None:
            out.close()
        if held:
            close_block()
        if found:
            with open_new(index_uri) as f:
                f.write(bytes(index))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], names=["shard", "block", "first_key", "last_key", "uri", "offset", "length"])

    schema = "shard long, block long, first_key string, last_key string, uri string, offset long, length long"
    ordered = marked.select(*columns).repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id")
    return written(ordered.mapInArrow(write, schema), "directory")


def lookup(directory: DataFrame, keys: DataFrame, key_col: str = "key", payload: bool = True) -> DataFrame:
    """The records ``(key, page_id, url, record_type, refers_to, payload_bytes, payload_digest[, payload])`` of all captures of ``keys``.

    Keys may repeat and be null (no capture); keys that are not in the index give nothing.
    """
    spark = directory.sparkSession
    bounds = [tuple(r) for r in directory.groupBy("shard").agg(F.min("first_key"), F.max("last_key")).orderBy("shard").collect()]  # one a shard
    last = [b[2] for b in bounds]

    def to_shards(batches):
        for batch in batches:
            found = []
            for k in batch.column(0).to_pylist():
                i = bisect.bisect_left(last, k)
                while i < len(bounds) and bounds[i][1] <= k:
                    found.append((bounds[i][0], k))
                    i += 1
            shards, own = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int64()), pa.array(own, pa.string())], names=["shard", "key"])

    def to_blocks(left: pa.Table, right: pa.Table) -> pa.Table:
        blocks = sorted(right.to_pylist(), key=lambda b: b["block"])
        last_keys = [b["last_key"] for b in blocks]
        wanted: dict[int, list[str]] = {}
        for k in sorted(set(left.column("key").to_pylist())):
            i = bisect.bisect_left(last_keys, k)
            while i < len(blocks) and blocks[i]["first_key"] <= k:
                wanted.setdefault(i, []).append(k)
                i += 1
        rows = [(blocks[i]["uri"], blocks[i]["offset"], blocks[i]["length"], w) for i, w in wanted.items()]
        cols = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string())), strict=True)], names=["uri", "offset", "length", "wanted"])

    names = {"key": pa.string(), "page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string()} | ({"payload": pa.binary()} if payload else {})

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                with open_range(row["uri"]) as f:
                    f.seek(row["offset"])
                    lines = zlib.decompress(f.read(row["length"])).decode().split("\n")
                keys_ = [line.split(" ", 1)[0] for line in lines]
                out = {n: [] for n in names}
                size, open_uri, f = 0, None, None
                for k in row["wanted"]:
                    for i in range(bisect.bisect_left(keys_, k), bisect.bisect_right(keys_, k)):
                        at = json.loads(lines[i].split(" ", 2)[2])
                        if at["uri"] != open_uri:
                            if f is not None:
                                f.close()
                            open_uri, f = at["uri"], open_range(at["uri"])
                        f.seek(at["offset"])
                        got = parse_record(gzip.decompress(f.read(at["length"]))) | {"key": k}
                        for n, column in out.items():
                            column.append(got[n])
                        size += got["payload_bytes"]
                        if payload and size > 16 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(out[n], t) for n, t in names.items()], names=list(names))
                            out, size = {n: [] for n in names}, 0
                if f is not None:
                    f.close()
                yield pa.RecordBatch.from_arrays([pa.array(out[n], t) for n, t in names.items()], names=list(names))

    distinct = keys.select(F.col(key_col).cast("string").alias("key")).where("key is not null").distinct()
    by_shard = distinct.mapInArrow(to_shards, "shard long, key string").groupBy("shard")
    plan = by_shard.cogroup(directory.groupBy("shard")).applyInArrow(to_blocks, "uri string, offset long, length long, wanted array<string>")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = "key string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string" + ", payload binary" * payload
    return plan.repartition(n, "uri", "offset").mapInArrow(read, schema)

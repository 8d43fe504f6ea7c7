"""Operator 3: WARC archives of pages with a two-level capture index, written and read back.

Pages are ordered by reversed-host URL key and page_id into shards. A task writes a shard: a WARC file (one gzip member
for a record), an index file of sorted capture lines in compressed blocks of BLOCK lines, and a sparse directory with
the first key, offset and length of each block. A lookup finds the shard among the shards' first keys and the block in
the shard's directory by binary search, inflates that one block by a range read, finds its lines by binary search, and
reads the records by range. Only the shards' first keys (at most MOST_SHARDS) are sent to the tasks.

Of pages with equal payloads of at least `min_bytes` bytes that with the largest page_id is stored (response), the
others point at it (revisit); payloads below that are all stored. Files lie in the folder that Spark's executors
share, under names of their own for each attempt; only those of attempts that ended are in the manifest.

Defined results: a null html is an empty payload, a null url an empty key. Pages without page_id never get referred to:
they are revisits of a page with an equal payload and an id, else responses. Repeated rows give a record each, of the same type.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm.common import broadcast_if_small, new_folder, staged, table
from engram.llm.textvec import slices

BLOCK, PER_SHARD, MOST_SHARDS = 128, 500, 20_000
DATE = "2024-01-01T00:00:00Z"
NO_ID = -(1 << 63)


def urlkey(url: Column) -> Column:
    """com,example,www)/path?query: the host reversed and lower-cased, without user, port and fragment."""
    url = F.regexp_replace(F.coalesce(url, F.lit("")), r"\s", "%20")
    pattern = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::\d*)?([^#]*)"
    host, rest = F.lower(F.regexp_extract(url, pattern, 1)), F.regexp_extract(url, pattern, 2)
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(rest == "", F.lit("/")).otherwise(rest))
    return F.when(host == "", url).otherwise(key)


def b32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _id(page) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}')}>"


def record(page: int | None, url: str, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One gzip member with one WARC record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_id(page)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~-._')}", f"WARC-Payload-Digest: sha1:{b32_sha1(payload)}"]
    if page is not None:
        head.append(f"WARC-X-Page-Id: {page}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_id(refers_to)}", f"WARC-X-Refers-To-Page-Id: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}", "", ""]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + body + b"\r\n\r\n") + pack.flush()


def parse(member: bytes) -> dict:
    """The fields of one record; the payload and its own digest for a response."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    got = dict(x.split(": ", 1) for x in lines[1:])
    body = rest[: int(got["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = got["WARC-Payload-Digest"].removeprefix("sha1:")
    stored = got["WARC-Type"] == "response"
    if stored and (len(payload) != length or b32_sha1(payload) != digest):
        raise ValueError(f"payload of {got['WARC-Record-ID']} differs from its digest")
    number = lambda name: int(got[name]) if name in got else None
    return {"page_id": number("WARC-X-Page-Id"), "url": got["WARC-Target-URI"], "payload": payload if stored else None, "payload_bytes": length, "payload_digest": digest, "record_type": got["WARC-Type"], "refers_to": number("WARC-X-Refers-To-Page-Id")}


def planned(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, key, capture, refers_to (null for a response). Only ids and digests are grouped and joined; payloads stay where they are while the counted revisits are few."""
    payload = F.coalesce("html", F.lit(""))
    p = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload"), F.sha1(payload.cast("binary")).alias("digest"))
    ids = p.filter(F.octet_length("payload") >= min_bytes).select("page_id", "digest")
    owners = ids.groupBy("digest").agg(F.max("page_id").alias("owner"))
    revisits = ids.join(owners, "digest").filter(F.col("owner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("owner")))
    revisits = staged(revisits.select(F.col("page_id").alias("id"), F.col("digest").alias("same"), "owner").distinct(), "revisits")
    few = broadcast_if_small(revisits, revisits.count())
    both = p.join(few, p["page_id"].eqNullSafe(few["id"]) & (p["digest"] == few["same"]), "left")
    return both.select("page_id", "url", "payload", urlkey(F.col("url")).alias("key"), F.coalesce("page_id", F.lit(NO_ID)).alias("capture"), F.col("owner").alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Writes the shards; a row for each: first_key, first_capture, name, records, blocks."""
    plan = planned(pages, min_bytes)
    shards = max(1, min(MOST_SHARDS, -(-pages.count() // PER_SHARD)))
    schema = "first_key string, first_capture long, name string, records long, blocks long"

    def write(batches):
        fs, path = pafs.FileSystem.from_uri(folder)
        fs.create_dir(path)
        name = f"{path}/{uuid.uuid4().hex}"
        at = done = 0
        first, lines, directory, index_at = None, [], [], 0
        warc = index = None

        def block():
            nonlocal index_at
            data = zlib.compress("\n".join(x[2] for x in lines).encode(), 6)
            directory.append([lines[0][0], lines[0][1], index_at, len(data)])
            index.write(data)
            index_at += len(data)
            lines.clear()

        for b in slices(batches, "payload"):
            for r in b.to_pylist():
                if warc is None:
                    warc, index = fs.open_output_stream(f"{name}.warc.gz", compression=None), fs.open_output_stream(f"{name}.cdx", compression=None)
                    first = (r["key"], r["capture"])
                member = record(r["page_id"], r["url"], r["payload"].encode(), r["refers_to"], r["refers_to"] is not None)
                warc.write(member)
                lines.append((r["key"], r["capture"], f"{r['key']} {r['capture']} {json.dumps({'offset': at, 'length': len(member)})}"))
                at, done = at + len(member), done + 1
                if len(lines) == BLOCK:
                    block()
        if warc is None:
            return
        if lines:
            block()
        warc.close()
        index.close()
        with fs.open_output_stream(f"{name}.dir", compression=None) as f:
            f.write(json.dumps(directory).encode())
        yield pa.RecordBatch.from_pylist([{"first_key": first[0], "first_capture": first[1], "name": name, "records": done, "blocks": len(directory)}])

    ordered = plan.repartitionByRange(shards, "key", "capture").sortWithinPartitions("key", "capture")
    return staged(ordered.mapInArrow(write, schema), "manifest")


class Shard:
    """One shard's files, read by range."""

    def __init__(self, fs, name: str):
        with fs.open_input_file(f"{name}.dir") as f:
            self.directory = [tuple(x) for x in json.loads(f.read())]
        self.index, self.warc = fs.open_input_file(f"{name}.cdx"), fs.open_input_file(f"{name}.warc.gz")
        self.block, self.keys, self.places = -1, [], []

    def _load(self, i: int) -> None:
        if i != self.block:
            _, _, offset, length = self.directory[i]
            self.index.seek(offset)
            cut = [x.split(" ", 2) for x in zlib.decompress(self.index.read(length)).decode().split("\n")]
            self.block, self.keys, self.places = i, [(k, int(c)) for k, c, _ in cut], [json.loads(x) for _, _, x in cut]

    def find(self, key: tuple[str, int]) -> Iterator[bytes]:
        """The members of all captures under a key."""
        i = max(0, bisect.bisect_left(self.directory, key, key=lambda x: (x[0], x[1])) - 1)
        while i < len(self.directory) and (self.directory[i][0], self.directory[i][1]) <= key:
            self._load(i)
            for place in self.places[bisect.bisect_left(self.keys, key) : bisect.bisect_right(self.keys, key)]:
                self.warc.seek(place["offset"])
                yield self.warc.read(place["length"])
            i += 1

    def close(self) -> None:
        self.index.close()
        self.warc.close()


def look_up(keys: DataFrame, manifest: DataFrame, folder: str, contents: bool = False) -> DataFrame:
    """The captures of (key, capture) pairs, each pair once: key and the fields of their records."""
    shards = sorted((r["first_key"], r["first_capture"], r["name"]) for r in manifest.select("first_key", "first_capture", "name").collect())
    firsts = [x[:2] for x in shards]

    def assign(batches):
        for b in batches:
            pairs = list(zip(b.column("key").to_pylist(), b.column("capture").to_pylist(), strict=True))
            # equal keys may run over a boundary: every shard from the one before the first that begins with the key
            rows = [(s, *p) for p in pairs for s in range(max(0, bisect.bisect_left(firsts, p) - 1), max(1, bisect.bisect_right(firsts, p)))] if firsts else []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64()), strict=True)], ["shard", "key", "capture"])

    fields = [("key", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())] + ([("payload", pa.binary())] if contents else [])
    schema = "key string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + (", payload binary" if contents else "")

    def read(batches):
        fs, _ = pafs.FileSystem.from_uri(folder)
        now, shard = None, None
        for b in batches:
            out = []
            for s, key, capture in zip(b.column("shard").to_pylist(), b.column("key").to_pylist(), b.column("capture").to_pylist(), strict=True):
                if s != now:
                    if shard:
                        shard.close()
                    now, shard = s, Shard(fs, shards[s][2])
                for member in shard.find((key, capture)):
                    got = parse(member)
                    out.append({"key": key, **{k: got[k] for k, _ in fields[1:]}})
            if out:
                yield pa.RecordBatch.from_pylist(out, pa.schema(fields))
        if shard:
            shard.close()

    found = keys.select("key", "capture").distinct().mapInArrow(assign, "shard long, key string, capture long")
    return found.repartition("shard").sortWithinPartitions("shard", "key", "capture").mapInArrow(read, schema)


def op3_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    folder = new_folder(spark, "warc")
    manifest = write_archives(pages, folder)
    keys = pages.select(urlkey(F.col("url")).alias("key"), F.coalesce("page_id", F.lit(NO_ID)).alias("capture"))
    return look_up(keys, manifest, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, html, sha1(html) AS hex, max(page_id) OVER (PARTITION BY html) AS owner FROM p),
b AS (SELECT *, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(hex, CAST(1 + 5 * (i // 4) AS INTEGER), 5))::BIGINT >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31)::INTEGER, 1)), '') AS b32 FROM d)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, b32 AS payload_digest,
    CASE WHEN owner IS NULL OR page_id IS NOT DISTINCT FROM owner THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN owner IS NULL OR page_id IS NOT DISTINCT FROM owner THEN NULL ELSE owner END AS refers_to
FROM b
"""

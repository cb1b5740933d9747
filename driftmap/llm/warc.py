"""WARC records in ZIP packages: written with stored members, read by ranges without extraction.

Of records with equal payloads of at least ``min_bytes`` bytes the one with the smallest page id is a response, the
others are revisits that name it. A package holds ``archive/data.warc.gz`` (one gzip member per record, stored, not
compressed again) and ``indexes/index.cdxj`` (a line per record: id, offset and length within that member). The reader
finds the central directory from the package's end, or through the ZIP64 locator, takes the places of the stored
members from it, reads the index and then each record by its range.

Edge cases: null html is an empty payload; rows that repeat the smallest id of a payload are all responses; null ids
come after others; a null url comes back as null, line ends in a url come back percent-encoded (%0D, %0A), as headers cannot
hold them; an empty table gives no packages and an empty result; columns besides id, url and html are not stored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import zipfile
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, written
from .storage import opened, store

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def id_of(text: str) -> int | None:
    x = text.rpartition(":")[2].rstrip(">")
    return int(x) if x else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record as a gzip member."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (b"" if revisit else payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {urn(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest_of(payload)}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {urn(refers_to)}"]
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


def parsed(member: bytes) -> tuple[dict[str, str], bytes]:
    """A record's headers and payload."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def members(f, size: int) -> dict[str, tuple[int, int]]:
    """Offset and length of each stored member of a ZIP file, from its central directory (ZIP64 included)."""
    f.seek(max(0, size - 65_557))
    tail = f.read(65_557)
    at = tail.rfind(b"PK\x05\x06")
    if at < 0:
        raise ValueError("no end of a central directory")
    count, length, begin = struct.unpack_from("<HII", tail, at + 10)
    if 0xFFFF == count or 0xFFFFFFFF in (length, begin):
        _, where = struct.unpack_from("<IQ", tail[tail.rindex(b"PK\x06\x07", 0, at) :], 4)
        f.seek(where)
        count, length, begin = struct.unpack_from("<QQQ", f.read(56), 32)
    f.seek(begin)
    directory, at, out = f.read(length), 0, {}
    for _ in range(count):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError("a damaged central directory")
        method, packed, full, n, extra, note, local = struct.unpack_from("<H8xIIHHH8xI", directory, at + 10)
        name = directory[at + 46 : at + 46 + n].decode()
        x, end = at + 46 + n, at + 46 + n + extra
        while x + 4 <= end:
            kind, own = struct.unpack_from("<HH", directory, x)
            if kind == 1:  # ZIP64: only the fields that are full in the entry, in this order
                wide = list(struct.unpack_from(f"<{own // 8}Q", directory, x + 4))
                full = wide.pop(0) if full == 0xFFFFFFFF else full
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                local = wide.pop(0) if local == 0xFFFFFFFF else local
            x += 4 + own
        at = end + note
        f.seek(local)
        own_name, own_extra = struct.unpack("<HH", f.read(30)[26:])
        if method == 0:
            out[name] = (local + 30 + own_name + own_extra, packed)
    return out


def write_packages(pages: DataFrame, folder: str, min_bytes: int = 0, package_bytes: int = 128 << 20) -> DataFrame:
    """Writes pages (page_id, url, html) to packages below folder; returns a written table of path and size."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("__sha", F.sha1("html"))
    pages = pages.withColumn("__sha", F.when(F.octet_length("html") >= min_bytes, F.col("__sha")))
    first = pages.where(F.col("__sha").isNotNull()).groupBy("__sha").agg(F.min("page_id").alias("__first"), F.count("*").alias("__n"))
    first = written(first.where("__n > 1").select("__sha", "__first"), "repeated")
    df = pages.join(first, "__sha", "left").select("page_id", "url", "html", "__first")

    def run(batches):
        rows = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns], strict=True))
        held = next(rows, None)
        while held is not None:

            def fill(f):
                nonlocal held
                index, at = [], 0
                with zipfile.ZipFile(f, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
                    with z.open(zipfile.ZipInfo(DATA), "w", force_zip64=True) as m:
                        while held is not None and at < package_bytes:
                            page_id, url, html, first = held
                            x = record(page_id, url, html.encode(), first, first is not None and page_id != first)
                            m.write(x)
                            index.append(f"{urn(page_id)} {json.dumps({'offset': at, 'length': len(x)})}\n")
                            at += len(x)
                            held = next(rows, None)
                    z.writestr(zipfile.ZipInfo(INDEX), "".join(index))

            path = store(f"{folder}/pages.wacz", fill)
            with opened(path) as f:
                size = f.seek(0, 2)
            yield pa.RecordBatch.from_pydict({"path": [path], "size": [size]})

    return written(df.mapInArrow(run, "path string, size long"), "packages")


def read_packages(packages: DataFrame) -> DataFrame:
    """Every record of the packages: page_id, record_type, refers_to, payload_digest, payload_bytes, url, payload (null for revisits)."""
    schema = "page_id long, record_type string, refers_to long, payload_digest string, payload_bytes long, url string, payload binary"
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def run(batches):
        for path, size in ((p.as_py(), s.as_py()) for b in batches for p, s in zip(*b.columns, strict=True)):
            with opened(path) as f:
                places = members(f, size)
                begin, _ = places[DATA]
                f.seek(places[INDEX][0])
                lines = f.read(places[INDEX][1]).decode().splitlines()
                rows = []
                for line in lines:
                    where = json.loads(line.partition(" ")[2])
                    f.seek(begin + where["offset"])
                    fields, payload = parsed(f.read(where["length"]))
                    revisit = fields["WARC-Type"] == "revisit"
                    digest = fields["WARC-Payload-Digest"].partition(":")[2]
                    if not revisit and digest != digest_of(payload):
                        raise ValueError(f"a payload in {path} differs from its digest")
                    rows.append((id_of(fields["WARC-Record-ID"]), fields["WARC-Type"], id_of(fields["WARC-Refers-To"]) if revisit else None, digest, int(fields["X-Payload-Length"]) if revisit else len(payload), fields.get("WARC-Target-URI"), None if revisit else payload))
                    if len(rows) == 500:
                        yield batch(rows)
                        rows = []
                if rows:
                    yield batch(rows)

    return packages.select("path", "size").mapInArrow(run, schema)


def packed(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes pages to packages in the shared folder and reads them back."""
    packages = write_packages(pages, shared_dir(pages.sparkSession, "warc"), min_bytes)
    n = pages.sparkSession.sparkContext.defaultParallelism
    return read_packages(packages.repartition(max(n, packages.rdd.getNumPartitions())))

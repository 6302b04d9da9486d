"""WARC records in ZIP archives: written by tasks, read back by range without extraction.

Writing: a payload's digest decides between a response and a revisit of the smallest id with the same
payload. Every task appends its records to archives of at most `ARCHIVE_BYTES`: `archive/data.warc.gz`
(one gzip member a record) and `indexes/index.jsonl` (place of each record), both stored, not
deflated. The manifest holds the archives of the attempts that succeeded, so a task that ran twice
leaves a file that nobody reads. Reading: the end-of-central-directory record, or its ZIP64 form,
leads to the central directory, that to the stored members, the index to byte ranges.

Defined results: null html counts as empty, payloads under `min_bytes` are always responses; a null
id is larger than any other, so such a row revisits a row with an id, and rows that share the
smallest id are responses all; null urls are written as an empty target; an empty table gives no
archive and an empty result; columns besides id, url and html are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetrail.llm.bloom import joined_few, probed
from pagetrail.llm.shared import fresh_path, table, written

ARCHIVE_BYTES, MIN_BYTES = 32 << 20, 100
DATA, INDEX = "archive/data.warc.gz", "indexes/index.jsonl"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def decided(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = MIN_BYTES) -> DataFrame:
    """page_id, url, html (null for revisits), bytes, digest, first: the id that a revisit refers to, else null."""
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumns({"bytes": F.octet_length("html").cast("long"), "digest": F.sha2(F.col("html").cast("binary"), 256)})
    light = written(rows.drop("html"), "digests")
    same = light.filter(F.col("bytes") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    same = written(same.filter("n > 1 AND first IS NOT NULL").select("digest", "first"), "payloads")
    revisits = written(light.join(same, "digest").filter(~F.col("page_id").eqNullSafe(F.col("first"))), "revisits")
    # payloads stay where they are read: a row that is surely no revisit needs no join, and of the others
    # only those that the filter took for one by mistake move
    name, keys = F.xxhash64("page_id", "digest"), ["page_id", "digest"]
    taken = revisits.select(*keys).distinct()
    named = written(taken.select(name.alias("name")), "names")
    responses = probed(rows.withColumn("name", name), "name", named, "name").filter("NOT maybe")
    doubtful = probed(light.withColumn("name", name), "name", named, "name").filter("maybe").select(*keys).distinct()
    mistaken = written(joined_null_safe(doubtful, taken, keys), "mistaken")
    columns = ["page_id", "url", "html", "bytes", "digest", "first"]
    out = responses.unionByName(joined_few(rows, mistaken, keys, "inner"), allowMissingColumns=True).withColumn("first", F.lit(None).cast("long")).select(*columns)
    return out.unionByName(revisits.withColumn("html", F.lit(None).cast("string")).select(*columns))


def joined_null_safe(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """rows without those of gone; null keys are equal."""
    other = gone.select(*[F.col(k).alias(f"__{k}") for k in keys])
    same = F.lit(True)
    for k in keys:
        same = same & rows[k].eqNullSafe(other[f"__{k}"])
    return rows.join(other, same, "left_anti")


def record(page_id: int | None, url: str | None, html: str | None, size: int, digest: str, first: int | None) -> bytes:
    """A WARC record; html is not used for a revisit."""
    block = HTTP + (html or "").encode() if first is None else HTTP
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {size}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if first is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{first}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def opened(uri: str):
    """(file system, path) of a shared folder's address."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


def write_archives(rows: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes what decided() gives; the manifest: uri, records, bytes of each archive."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        data, index = io.BytesIO(), []

        def flush():
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
                z.writestr(zipfile.ZipInfo(DATA), data.getvalue())
                z.writestr(zipfile.ZipInfo(INDEX), "\n".join(index))
            uri = f"{folder}/{uuid.uuid4().hex}.wacz"
            fs, path = opened(uri)
            fs.create_dir(path.rpartition("/")[0], recursive=True)
            with fs.open_output_stream(path) as f:
                f.write(out.getbuffer())
            row = pa.RecordBatch.from_pydict({"uri": [uri], "records": pa.array([len(index)], pa.int64()), "bytes": pa.array([out.tell()], pa.int64())})
            data.seek(0), data.truncate(), index.clear()
            return row

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                packed = gzip.compress(record(*row), 1, mtime=0)
                index.append(json.dumps({"id": row[0], "offset": data.tell(), "length": len(packed)}))
                data.write(packed)
                if data.tell() >= archive_bytes:
                    yield flush()
        if index:
            yield flush()

    return rows.select("page_id", "url", "html", "bytes", "digest", "first").mapInArrow(run, "uri string, records long, bytes long")


def members(f, size: int) -> dict[str, tuple[int, int, int]]:
    """name -> (method, local header's place, stored size), from the central directory alone."""
    at = max(0, size - 65_557)
    tail = f.read_at(size - at, at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory")
    n, length, start = struct.unpack_from("<H", tail, end + 10)[0], *struct.unpack_from("<II", tail, end + 12)
    if n == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
        if tail[end - 20 : end - 16] != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        place = struct.unpack_from("<Q", tail, end - 12)[0]
        n, length, start = struct.unpack_from("<QQQ", f.read_at(56, place), 32)
    directory, at, found = f.read_at(length, start), 0, {}
    for _ in range(n):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method = struct.unpack_from("<H", directory, at + 10)[0]
        packed, plain = struct.unpack_from("<II", directory, at + 20)
        name_len, extra_len, note_len = struct.unpack_from("<HHH", directory, at + 28)
        local = struct.unpack_from("<I", directory, at + 42)[0]
        name = directory[at + 46 : at + 46 + name_len].decode()
        extra, k = directory[at + 46 + name_len : at + 46 + name_len + extra_len], 0
        while k + 4 <= len(extra):
            kind, size_ = struct.unpack_from("<HH", extra, k)
            if kind == 1:  # ZIP64: only the fields that did not fit, in this order
                wide = list(struct.unpack_from(f"<{size_ // 8}Q", extra, k + 4))
                plain = wide.pop(0) if plain == 0xFFFFFFFF else plain
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                local = wide.pop(0) if local == 0xFFFFFFFF else local
            k += 4 + size_
        found[name] = (method, local, packed)
        at += 46 + name_len + extra_len + note_len
    return found


def stored_range(f, member: tuple[int, int, int]) -> tuple[int, int]:
    """(first byte, length) of a stored member's data."""
    method, local, size = member
    if method:
        raise ValueError("the member is not stored")
    head = f.read_at(30, local)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("broken local header")
    return local + 30 + sum(struct.unpack_from("<HH", head, 26)), size


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and payload of one record; checks its length."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = dict((k.lower(), v.strip()) for k, _, v in (line.partition(":") for line in lines[1:]))
    block = rest[: int(headers["content-length"])]
    if not lines[0].startswith("WARC/") or len(block) != int(headers["content-length"]):
        raise ValueError("broken record")
    return headers, block.partition(b"\r\n\r\n")[2]


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest and payload of every record.

    A response's size and digest are those of the payload read; a wrong digest is an error. A
    revisit's are those of its headers. payloads=False leaves the payload itself null.
    """

    def number(urn: str | None) -> int | None:
        text = (urn or "").removeprefix("<urn:page:").removesuffix(">")
        return int(text) if text else None

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "payload": pa.binary()}
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                fs, path = opened(uri)
                with fs.open_input_file(path) as f:
                    found = members(f, f.size())
                    at, size = stored_range(f, found[INDEX])
                    places = [json.loads(x) for x in f.read_at(size, at).splitlines()]
                    data, size = stored_range(f, found[DATA])
                    for k in range(0, len(places), 256):
                        part = places[k : k + 256]  # neighbours are read as one range
                        low, high = part[0]["offset"], part[-1]["offset"] + part[-1]["length"]
                        if high > size:
                            raise ValueError("the index points beyond its member")
                        raw, rows = f.read_at(high - low, data + low), []
                        for p in part:
                            headers, payload = parsed(zlib.decompress(raw[p["offset"] - low : p["offset"] - low + p["length"]], 31))
                            kind, said = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha256:")
                            if kind == "response" and hashlib.sha256(payload).hexdigest() != said:
                                raise ValueError("a payload does not match its digest")
                            size_ = len(payload) if kind == "response" else int(headers["x-payload-length"])
                            rows.append((number(headers["warc-record-id"]), headers["warc-target-uri"], kind, number(headers.get("warc-refers-to")), size_, said, payload if payloads and kind == "response" else None))
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], list(kinds))

    spread = manifest.select("uri").repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "uri")
    return spread.mapInArrow(run, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")


def op8_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "archives")
    manifest = written(write_archives(decided(table(spark, sf_dir, "pages")), folder), "manifest")
    return read_archives(manifest, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
       CASE WHEN octet_length(encode(coalesce(html, ''))) >= 100 AND page_id IS DISTINCT FROM min(page_id) OVER g AND min(page_id) OVER g IS NOT NULL
            THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN octet_length(encode(coalesce(html, ''))) >= 100 AND page_id IS DISTINCT FROM min(page_id) OVER g THEN min(page_id) OVER g END AS refers_to
FROM pages WINDOW g AS (PARTITION BY coalesce(html, ''))
"""

QUERIES = {"op8_warc_zip": op8_warc_zip}
ORACLES = {"op8_warc_zip": SQL}

"""WARC in ZIP packages: writer, and a reader that range-reads stored members without extraction.

A package holds archive/data.warc.gz (one gzip member a record), indexes/index.cdxj (a line a record with its
offset and length inside the archive) and datapackage.json, all stored, so that a record's bytes lie in the
package as they are: offset of the member's data plus offset of the record. The reader finds the end of
central directory, its ZIP64 form where the fields are full, the central directory, and each wanted
member's local header; it reads the index and then only the ranges of records.

Packages of other writers are read too: any number of WARC members, compressed by record or not, located in the
directory by their names; CDXJ indexes, plain or compressed; without an index the record starts are found by walking
through the member. Record types other than response and revisit are given as they are; what a record doesn't say is null.

Pages with equal payloads of at least ``least`` bytes: the one with the largest page_id is the response, the
others revisit it. A null html is an empty payload; rows whose id equals the largest (repeated rows) are all
responses; rows without page_id revisit where the group has an id, else they are responses.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from itertools import islice
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windloom.llm.common import ROWS_PER_BATCH, map_batches, shared_dir, stored

DATA, INDEX, PACKAGE = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"
#: Bytes of records after which a task begins another package.
ROLL = 32 << 20
#: Rows of winners that are broadcast, at most.
FEW = 200_000
#: Kept as they are in an index line's key, which holds no blanks.
SAFE = "/:?&=%,()@!$'*+;~"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record, not compressed. A revisit has the HTTP header with the payload's length, but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url}')}>", "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{sha1}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(url.splitlines()))
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To-Page-ID: {refers_to}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def package(records: list[bytes], index: list[str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        for name, data in ((DATA, b"".join(records)), (INDEX, "".join(index).encode()), (PACKAGE, json.dumps({"profile": "data-package", "resources": [{"path": DATA}, {"path": INDEX}]}).encode())):
            with z.open(zipfile.ZipInfo(name, (2024, 1, 1, 0, 0, 0)), "w", force_zip64=True) as f:
                f.write(data)
    return out.getvalue()


def winners(pages: DataFrame, least: int) -> DataFrame:
    """sha1, first_id: the largest id of each payload of at least ``least`` bytes that several rows have."""
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("html", F.lit("")).alias("html"))
    return keyed.where(F.octet_length("html") >= least).groupBy(F.sha1("html").alias("sha1")).agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1 and first_id is not null").select("sha1", "first_id")


def write_archives(pages: DataFrame, to: str, least: int = 1000, roll: int = ROLL, few: int = FEW, salts: int = 16) -> DataFrame:
    """Write the packages below the URI ``to``; returns their path, bytes and records. Runs at once.

    Winners are broadcast up to ``few`` rows; beyond that both sides are shuffled, with the pages of a payload under several keys.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("sha1", F.sha1("html"))
    won = stored(winners(pages, least))
    if won.count() <= few:
        typed = rows.join(F.broadcast(won), "sha1", "left")
    else:
        salted = won.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        typed = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int")).join(salted, ["sha1", "salt"], "left").drop("salt")
    typed = typed.select("page_id", "url", "html", "sha1", "first_id")
    pages.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))

    def run(batches: Iterator[pa.RecordBatch]):
        system, base = filesystem(to)
        system.create_dir(base, recursive=True)
        task = TaskContext.get()
        seq, at, records, index = 0, 0, [], []

        def flush():
            nonlocal seq, at, records, index
            # by attempt: one that was given up never writes over another's package; only the names returned are read
            name = f"part-{task.partitionId():06d}-{seq:04d}-{task.taskAttemptId()}.wacz"
            path = f"{base}/{name}"
            data = package(records, index)
            with system.open_output_stream(path) as f:
                f.write(data)
            out = (f"{to.rstrip('/')}/{name}", len(data), len(records))
            seq, at, records, index = seq + 1, 0, [], []
            return out

        def tell(*made):
            return pa.RecordBatch.from_pydict({"path": pa.array([m[0] for m in made], pa.string()), "bytes": pa.array([m[1] for m in made], pa.int64()), "records": pa.array([m[2] for m in made], pa.int64())})

        for batch in batches:
            for page_id, url, html, sha1, first in zip(*(c.to_pylist() for c in batch.columns)):
                revisit = first is not None and page_id != first
                packed = gzip.compress(record(page_id, url, html.encode("utf-8", "surrogatepass"), sha1, first, revisit), 1, mtime=0)
                kind = "revisit" if revisit else "response"
                index.append(f"{quote(url or '', safe=SAFE)} 20240101000000 {json.dumps({'url': url, 'filename': DATA.rpartition('/')[2], 'offset': str(at), 'length': str(len(packed)), 'type': kind, 'page': page_id, 'digest': f'sha1:{sha1}'})}\n")
                records.append(packed)
                at += len(packed)
                if at >= roll:
                    yield tell(flush())
        if records:
            yield tell(flush())

    return stored(typed.mapInArrow(run, "path string, bytes long, records long"))


class ZipReader:
    """Central directory of a ZIP seen through ranges of a random-access file."""

    def __init__(self, f: pa.NativeFile):
        self.f, self.size = f, f.size()
        self.members = self._directory()

    def read(self, offset: int, length: int) -> bytes:
        self.f.seek(offset)
        data = self.f.read(length)
        if len(data) != length:
            raise ValueError(f"range {offset}+{length} ends beyond the file")
        return data

    def _directory(self) -> dict[str, tuple[int, int, int, int]]:
        """name: method, packed size, size, offset of the local header."""
        tail = min(self.size, 65557)
        end = self.read(self.size - tail, tail)
        at = end.rfind(b"PK\x05\x06")
        if at < 0:
            raise ValueError("no end of central directory")
        count, length, start = struct.unpack("<HII", end[at + 10 : at + 20])
        place = self.size - tail + at
        if (count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF) and place >= 20:
            locator = self.read(place - 20, 20)
            if locator[:4] == b"PK\x06\x07":
                z64 = self.read(struct.unpack("<Q", locator[8:16])[0], 56)
                if z64[:4] != b"PK\x06\x06":
                    raise ValueError("bad ZIP64 end of central directory")
                count, length, start = struct.unpack("<QQQ", z64[32:56])
        raw, out, p = self.read(start, length), {}, 0
        for _ in range(count):
            if raw[p : p + 4] != b"PK\x01\x02":
                raise ValueError("bad central directory entry")
            flags, method = struct.unpack("<HH", raw[p + 8 : p + 12])
            packed, size, n, e, c = struct.unpack("<IIHHH", raw[p + 20 : p + 34])
            header = struct.unpack("<I", raw[p + 42 : p + 46])[0]
            name = raw[p + 46 : p + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
            extra, q = raw[p + 46 + n : p + 46 + n + e], 0
            while q + 4 <= len(extra):
                kind, k = struct.unpack("<HH", extra[q : q + 4])
                if kind == 1:
                    wide = extra[q + 4 : q + 4 + k]
                    values = [struct.unpack("<Q", wide[i : i + 8])[0] for i in range(0, len(wide) - 7, 8)]
                    if size == 0xFFFFFFFF:
                        size = values.pop(0)
                    if packed == 0xFFFFFFFF:
                        packed = values.pop(0)
                    if header == 0xFFFFFFFF:
                        header = values.pop(0)
                q += 4 + k
            out[name] = (method, packed, size, header)
            p += 46 + n + e + c
        return out

    def data_offset(self, name: str, any_method: bool = False) -> int:
        """Where a member's data begin; records can be read in place from stored ones only."""
        method, _, _, header = self.members[name]
        if method != 0 and not any_method:
            raise ValueError(f"{name} is not stored")
        local = self.read(header, 30)
        if local[:4] != b"PK\x03\x04":
            raise ValueError("bad local header")
        n, e = struct.unpack("<HH", local[26:30])
        return header + 30 + n + e


def is_data(name: str) -> bool:
    return name.lower().endswith((".warc", ".warc.gz"))


def is_index(name: str) -> bool:
    return name.lower().endswith((".cdxj", ".cdx", ".cdxj.gz", ".cdx.gz"))


def member_lines(z: ZipReader, name: str, part: int = 1 << 20) -> Iterator[bytes]:
    """The lines of a text member, stored or deflated in the package, and gzipped or not in itself."""
    method, packed, _, _ = z.members[name]
    at = z.data_offset(name, any_method=True)
    layers = ([zlib.decompressobj(-15)] if method == 8 else []) + ([zlib.decompressobj(31)] if name.endswith(".gz") else [])
    rest, done = b"", 0
    while done < packed:
        data = z.read(at + done, min(part, packed - done))
        done += len(data)
        for k, layer in enumerate(layers):
            out = layer.decompress(data)
            while layer.eof and layer.unused_data and layer.unused_data.strip(b"\0"):  # the next gzip member
                left, layer = layer.unused_data, zlib.decompressobj(31)
                layers[k] = layer
                out += layer.decompress(left)
            data = out
        *lines, rest = (rest + data).split(b"\n")
        yield from lines
    if rest:
        yield rest


def walk(z: ZipReader, name: str, part: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Offset and length in the package of every record of a WARC member without an index."""
    _, size, _, _ = z.members[name]
    base, at = z.data_offset(name), 0
    while at < size:
        start, done = at, False
        if z.read(base + at, min(2, size - at)) == b"\x1f\x8b":
            unpack = zlib.decompressobj(31)
            while not done and at < size:
                data = z.read(base + at, min(part, size - at))
                unpack.decompress(data)
                at += len(data) - len(unpack.unused_data)
                done = unpack.eof
        else:
            head = b""
            while b"\r\n\r\n" not in head and at + len(head) < size:
                head += z.read(base + at + len(head), min(4096, size - at - len(head)))
            above, _, _ = head.partition(b"\r\n\r\n")
            at = min(size, at + len(above) + 4 + int(_fields(above.decode("utf-8", "replace"))["content-length"]) + 4)
        yield base + start, at - start


def records_of(z: ZipReader) -> Iterator[tuple[int, int]]:
    """Offset and length in the package of every record: from the indexes, for members that none names by walking."""
    data = {n.rpartition("/")[2]: n for n in z.members if is_data(n)}
    begins = {n: z.data_offset(n) for n in data.values()}
    named = set()
    for index in sorted(n for n in z.members if is_index(n)):
        for line in member_lines(z, index):
            at = line.find(b"{")
            if at < 0:
                continue
            told = json.loads(line[at:])
            member = data.get(str(told.get("filename", "")).rpartition("/")[2]) or (next(iter(data.values())) if len(data) == 1 else None)
            if member is None or "offset" not in told or "length" not in told:
                continue
            named.add(member)
            yield begins[member] + int(told["offset"]), int(told["length"])
    for member in sorted(set(data.values()) - named):
        yield from walk(z, member)


def index_of(archives: DataFrame) -> DataFrame:
    """path, offset (in the package), length, of every record of archives(path)."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, at = filesystem(path)
                with system.open_input_file(at) as f:
                    found = records_of(ZipReader(f))
                    while some := list(islice(found, 4096)):
                        yield pa.RecordBatch.from_pydict({"path": pa.array([path] * len(some), pa.string()), "offset": pa.array([a for a, _ in some], pa.int64()), "length": pa.array([n for _, n in some], pa.int64())})

    return archives.select("path").repartition(max(1, archives.sparkSession.sparkContext.defaultParallelism * 2)).mapInArrow(run, "path string, offset long, length long")


def _fields(head: str) -> dict[str, str]:
    """Header lines by lower-case name; lines that begin with a blank go on the one before."""
    out, name = {}, None
    for line in head.split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str] | None, bytes]:
    """WARC header, HTTP header (None where the block has none), payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    fields = _fields(head.decode("utf-8", "surrogatepass"))
    block = rest[: int(fields["content-length"])]
    if not block.startswith(b"HTTP/"):
        return fields, None, block
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, _fields(http.decode("latin-1")), payload


def sha1_of(field: str | None) -> str | None:
    """Bare lower-case hex of a sha1 digest field, which may be in base 32."""
    name, _, value = (field or "").partition(":")
    if name.lower() != "sha1":
        return None
    return base64.b32decode(value.upper()).hex() if len(value) == 32 else value.lower()


def number(text: str | None) -> int | None:
    return int(text) if text and text.strip().lstrip("-").isdecimal() else None


def read_records(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (and url, payload) of every record of archives(path).

    A response's digest is computed from its payload and must equal the one in its header, if there is one; a revisit's
    is the header's, its length that of the HTTP header.
    """

    def make():
        opened: dict[str, pa.NativeFile] = {}

        def run(cols):
            out = {k: [] for k in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload")}
            for path, offset, length in zip(cols["path"], cols["offset"], cols["length"]):
                if path not in opened:
                    for f in opened.values():
                        f.close()
                    opened.clear()
                    system, at = filesystem(path)
                    opened[path] = system.open_input_file(at)
                f = opened[path]
                f.seek(offset)
                raw = f.read(length)
                fields, http, payload = parse(zlib.decompress(raw, 31) if raw[:2] == b"\x1f\x8b" else raw)
                kind = fields.get("warc-type")
                told, own = sha1_of(fields.get("warc-payload-digest")), hashlib.sha1(payload).hexdigest()
                if kind == "response" and told not in (None, own):
                    raise ValueError(f"digest of record at {path}:{offset} differs")
                out["page_id"].append(number(fields.get("warc-page-id")))
                out["payload_bytes"].append(number((http or {}).get("content-length")) if kind == "revisit" else len(payload))
                out["payload_digest"].append(told if kind == "revisit" else own)
                out["record_type"].append(kind)
                out["refers_to"].append(number(fields.get("warc-refers-to-page-id")))
                out["url"].append(fields.get("warc-target-uri"))
                out["payload"].append(payload if with_payload and kind != "revisit" else None)
            return out

        return run

    at = index_of(archives)
    spark = archives.sparkSession
    at = at.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), F.col("path"), (F.col("offset") / (8 << 20)).cast("long")).sortWithinPartitions("path", "offset")
    names = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"
    got = map_batches(at, make, names)
    return got if with_payload else got.drop("payload")


def round_trip(pages: DataFrame, to: str | None = None, least: int = 1000) -> DataFrame:
    to = to or f"{shared_dir(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    return read_records(write_archives(pages, to, least)).drop("url")


def archives_at(spark: SparkSession, uri: str) -> DataFrame:
    """The packages below a URI, for reading what was written elsewhere."""
    system, base = filesystem(uri)
    found = [f.path for f in system.get_file_info(pafs.FileSelector(base, recursive=True)) if f.path.endswith((".wacz", ".zip"))]
    return spark.createDataFrame([(p,) for p in sorted(found)], "path string")

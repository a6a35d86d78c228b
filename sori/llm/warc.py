"""WARC records in ZIP archives: writing, and reading by ranges without extraction."""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import uuid
import zipfile
from datetime import UTC, datetime
from urllib.parse import quote

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sori.llm.store import cut, new_path, small_batches

#: Payloads shorter than this are stored again even if equal.
REVISIT_BYTES = 1000
#: Parts over which a group of equal payloads is spread when its members are marked.
SALTS = 32
#: An archive is closed and the next begun beyond so many bytes of records.
ARCHIVE_BYTES = 1 << 30
RECORDS, INDEX = "archive/records.warc.gz", "indexes/index.cdxj"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Fixed value: no record of these tables has a capture time, so all carry the same date.
DATE = datetime(2024, 1, 1, tzinfo=UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record: a response with the payload, or a revisit that refers to another page's response."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe=":/?#[]@!$&'()*+,;=%~"))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Fields of one record; a response's digest is computed anew and must match its header."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(b": ", 1) for x in http.split(b"\r\n")[1:])[b"Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    page = lambda x: None if x in (None, "<urn:page:None>") else int(x[10:-1])
    if fields["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its header")
    return {"page_id": page(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": page(fields.get("WARC-Refers-To")), "payload": payload if fields["WARC-Type"] == "response" else None}


class ZipIndex:
    """Members of a ZIP archive from its central directory, plain or ZIP64, by ranges of an open file."""

    def __init__(self, src):
        self.src, self.size = src, src.size()
        tail_at = max(0, self.size - 65557)
        tail = self.range(tail_at, self.size - tail_at)
        k = tail.rfind(b"PK\x05\x06")
        if k < 0:
            raise ValueError("no end of central directory")
        n, length, start = struct.unpack("<HII", tail[k + 10 : k + 20])
        locator = tail_at + k - 20
        if locator >= 0 and (at := self.range(locator, 20))[:4] == b"PK\x06\x07":
            end64 = self.range(struct.unpack("<Q", at[8:16])[0], 56)
            if end64[:4] != b"PK\x06\x06":
                raise ValueError("broken ZIP64 end of central directory")
            n, length, start = struct.unpack("<QQQ", end64[32:56])
        self.members: dict[str, tuple[int, int, int]] = {}
        raw, i = self.range(start, length), 0
        for _ in range(n):
            sig, method, packed, plain, n_name, n_extra, n_note, offset = struct.unpack("<4s6xH8xIIHHH8xI", raw[i : i + 46])
            if sig != b"PK\x01\x02":
                raise ValueError("broken central directory")
            name = raw[i + 46 : i + 46 + n_name].decode()
            extra = raw[i + 46 + n_name : i + 46 + n_name + n_extra]
            while len(extra) >= 4:
                kind, size = struct.unpack("<HH", extra[:4])
                if kind == 1:  # ZIP64: those of the three values that did not fit, in this order
                    wide = list(struct.unpack(f"<{size // 8}Q", extra[4 : 4 + size // 8 * 8]))
                    plain = wide.pop(0) if plain == 0xFFFFFFFF else plain
                    packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                    offset = wide.pop(0) if offset == 0xFFFFFFFF else offset
                extra = extra[4 + size :]
            self.members[name] = (offset, packed, method)
            i += 46 + n_name + n_extra + n_note

    def range(self, at: int, n: int) -> bytes:
        self.src.seek(at)
        return self.src.read(n)

    def stored(self, name: str) -> tuple[int, int]:
        """Where a stored member's bytes lie in the archive: offset and length."""
        offset, size, method = self.members[name]
        if method:
            raise ValueError(f"{name} is not stored")
        n_name, n_extra = struct.unpack("<HH", self.range(offset + 26, 4))
        return offset + 30 + n_name + n_extra, size


class ArchiveWriter:
    """One ZIP archive with two stored members: records (a gzip member each) and an index of their ranges."""

    def __init__(self, path: str):
        fs, at = FileSystem.from_uri(path)
        fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
        self.path, self.out, self.at, self.lines = path, fs.open_output_stream(at, compression=None), 0, []
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(RECORDS, "w", force_zip64=True)

    def add(self, page_id, raw: bytes) -> None:
        packed = gzip.compress(raw, 6, mtime=0)
        self.member.write(packed)
        self.lines.append(json.dumps({"page_id": page_id, "offset": self.at, "length": len(packed)}))
        self.at += len(packed)

    def close(self) -> tuple[str, int]:
        self.member.close()
        with self.zip.open(INDEX, "w", force_zip64=True) as f:
            f.write("\n".join(self.lines).encode())
        self.zip.close()
        self.out.close()
        return self.path, len(self.lines)


def mark_revisits(pages: DataFrame, min_bytes: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload (binary), digest, refers_to: null for responses, else the page whose response it is."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)))
    groups = rows.where(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
    groups = groups.where("n > 1").select("digest", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    marked = rows.join(groups, ["digest", "salt"], "left")
    refers = F.when(F.col("page_id") < F.col("first"), F.col("first")).when(F.col("page_id").isNull(), F.col("first"))
    return marked.select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def write_archives(pages: DataFrame, path: str | None = None, min_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Write a WARC record for every page into ZIP archives; returns the manifest: file, n_records.

    Of records with equal payloads of at least ``min_bytes`` bytes the one with the largest page_id is a response and
    the others are revisits that refer to it. Each task writes archives under names of its own; only those of tasks
    that ended are in the manifest.

    Null html: empty payload. Null page_id: a revisit if another page of its group has an id, else a response. Rows
    that share the largest page_id are all responses. Null url: no target in the record. Empty table: no archives.
    """
    spark = pages.sparkSession
    small_batches(spark)
    path = path or new_path(spark, "warc")

    def run(batches):
        made, out = [], None
        for b in batches:
            for page, url, payload, digest, refers in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if out is None:
                    out = ArchiveWriter(f"{path}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.zip")
                out.add(page, record(page, url, payload, digest, refers))
                if out.at >= ARCHIVE_BYTES:
                    made.append(out.close())
                    out = None
        if out is not None:
            made.append(out.close())
        yield pa.RecordBatch.from_pydict({"file": pa.array([m[0] for m in made], pa.string()), "n_records": pa.array([m[1] for m in made], pa.int64())})

    return cut(mark_revisits(pages, min_bytes).mapInArrow(run, "file string, n_records long"), "warc-manifest")


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """Records of the archives in a manifest: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload.

    The index member gives each record's range; one range is read and one record unpacked at a time.
    """
    files = manifest.select("file").repartition(manifest.count() or 1)
    kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}

    def run(batches):
        for b in batches:
            for file in b.column(0).to_pylist():
                fs, name = FileSystem.from_uri(file)
                with fs.open_input_file(name) as src:
                    zip_ = ZipIndex(src)
                    base, _ = zip_.stored(RECORDS)
                    lines = zip_.range(*zip_.stored(INDEX)).decode().split("\n")
                    rows, held = [], 0
                    for line in filter(None, lines):
                        at = json.loads(line)
                        rows.append(parse_record(gzip.decompress(zip_.range(base + at["offset"], at["length"]))))
                        held += rows[-1]["payload_bytes"]
                        if not payloads:
                            rows[-1]["payload"] = None
                        if held > 8 << 20:
                            yield _batch(rows, kinds)
                            rows, held = [], 0
                    yield _batch(rows, kinds)

    return files.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def _batch(rows: list[dict], kinds: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kinds.items()], list(kinds))

"""WARC records in seekable Zstandard bundles, with revisit records for payloads that are there already.

Records are grouped into independent zstd frames of bounded size; a bundle is a row of frames and ends in a seek table
(a skippable frame in the public seekable format: for each frame its compressed and decompressed size, then the number
of frames). The index maps every record identifier to its bundle, frame and offset inside the frame, so that one record
is read by one seek and one frame. Tasks write bundles through the file system that the folder's URI names (a path
without scheme is on the cluster's default file system; ``SCHEMES`` says how Hadoop's names are opened), each under
a name of its own; the index lists only bundles of tasks that ended well, so a lost executor leaves no half archive.

Of records with equal payloads of at least ``least`` bytes the one with the smallest page_id is the response, the others
are revisits that refer to it, by its record identifier, page, target and date. On reading, a revisit is sound if the archives hold a
response of that page with the same digest. Payloads are compared by SHA-256 and length, and only
digests are shuffled: the table of revisits goes to the pages where it is small (``SENT``), else texts travel once, by page.

Nulls: null html is an empty payload, a null url leaves out the target; null page_ids come last and may be responses
only if a payload has no other. Page ids are integers, or texts of such (others are an error). Rows that repeat a page_id and payload have one record
identifier; those of the smallest page_id are all responses. An empty table
gives no bundle and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ironsieve.operators.components import hot_bar, join_by_key
from ironsieve.session import cut

FRAME = 1 << 20
BUNDLE = 1 << 28
#: Bytes of the table of revisits up to which it is broadcast.
SENT = 32 << 20
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
DATE = "2000-01-01T00:00:00Z"
#: Hadoop's names of stores, and how tasks open them.
SCHEMES = {"s3a://": "s3://", "s3n://": "s3://", "dbfs:/": "file:///dbfs/", "abfss://": "abfss://", "viewfs://": "viewfs://"}
INDEX = "page_id long, record_id string, bundle string, frame int, frame_offset long, frame_bytes long, at long, bytes long"


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", c, d) for c, d in frames) + struct.pack("<IBI", len(frames), 0, _SEEKABLE)
    return struct.pack("<II", _SKIPPABLE, len(body)) + body


def read_seek_table(f, size: int) -> list[tuple[int, int, int]]:
    """(offset, compressed size, decompressed size) of every frame, from the bundle's end."""
    f.seek(size - 9)
    n, flags, magic = struct.unpack("<IBI", f.read(9))
    if magic != _SEEKABLE or flags:
        raise ValueError("not a seekable bundle")
    f.seek(size - 9 - 8 * n - 8)
    head, length = struct.unpack("<II", f.read(8))
    if head != _SKIPPABLE or length != 8 * n + 9:
        raise ValueError("damaged seek table")
    out, at = [], 0
    for c, d in struct.iter_unpack("<II", f.read(8 * n)):
        out.append((at, c, d))
        at += c
    return out


def record_id(page_id: int | None, digest: str) -> str:
    """A record's identifier, from its page and the SHA-256 of its payload, so that revisits can name their response."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with its scheme, on the cluster's default file system if it has none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def located(folder: str) -> str:
    """The URI under which tasks open a qualified folder."""
    for name, opened in SCHEMES.items():
        if folder.startswith(name):
            return opened + folder[len(name) :].lstrip("/") if name.endswith(":/") else opened + folder[len(name) :]
    return "file://" + folder.removeprefix("file:").removeprefix("//") if folder.startswith("file:") else folder


def _opened(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a qualified folder; local paths keep signs that a URI would quote."""
    uri = located(folder)
    return (pafs.LocalFileSystem(), uri.removeprefix("file://")) if uri.startswith("file://") else pafs.FileSystem.from_uri(uri)


def _target(url: str) -> str:
    return quote(url, safe=":/?#[]@!$&'()*+,;=%~-._")


def record(page_id, url, payload: bytes, refers_to, rid: str, refers_url: str | None = None, refers_id: str | None = None) -> bytes:
    """One WARC/1.1 record; with ``refers_to`` a revisit without payload."""
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {rid}"]
    head += [f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + _target(url))
    head.append(f"WARC-Payload-Digest: sha1:{payload_digest(payload)}")
    head += [f"X-Page-ID: {page_id}", f"X-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if refers_id is not None:
            head.append(f"WARC-Refers-To: {refers_id}")
        if refers_url is not None:
            head.append("WARC-Refers-To-Target-URI: " + _target(refers_url))
        head += [f"WARC-Refers-To-Date: {DATE}", f"X-Refers-To-Page: {refers_to}"]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """The named fields (lower-cased) and the HTTP payload of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return fields, block.partition(b"\r\n\r\n")[2]


class Bundle:
    """Writes records into frames of one file; ``index`` has a row for each."""

    def __init__(self, fs: pafs.FileSystem, folder: str, frame: int):
        self.fs, self.name, self.frame = fs, f"{folder}/{uuid.uuid4().hex}.warc.zst", frame
        self.out, self.packer = fs.open_output_stream(self.name, compression=None), zstandard.ZstdCompressor(level=3)
        self.frames, self.index, self.open, self.held, self.offset = [], [], [], 0, 0

    def add(self, page_id, rid: str, data: bytes) -> None:
        self.open.append((page_id, rid, self.held, len(data), data))
        self.held += len(data)
        if self.held >= self.frame:
            self.flush()

    def flush(self) -> None:
        if self.open:
            packed = self.packer.compress(b"".join(x[4] for x in self.open))
            self.out.write(packed)
            self.index += [(p, r, self.name, len(self.frames), self.offset, len(packed), a, n) for p, r, a, n, _ in self.open]
            self.frames.append((len(packed), self.held))
            self.offset += len(packed)
            self.open, self.held = [], 0

    def close(self) -> list[tuple]:
        self.flush()
        self.out.write(seek_table(self.frames))
        self.out.close()
        return self.index


def _columns(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names
    )


_INDEX_TYPES = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]


def _write(folder: str, frame: int, bundle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _opened(folder)
        fs.create_dir(path, recursive=True)
        names = [x.split()[0] for x in INDEX.split(", ")]
        at = None
        for b in batches:
            for page_id, url, html, refers, refers_url, revisit in zip(*(c.to_pylist() for c in b.columns), strict=True):
                at = at or Bundle(fs, path, frame)
                payload = (html or "").encode("utf-8", "surrogatepass")
                sha = hashlib.sha256(payload).hexdigest()
                rid = record_id(page_id, sha)
                to = (refers if refers is not None else "null") if revisit else None
                at.add(page_id, rid, record(page_id, url, payload, to, rid, refers_url, record_id(refers, sha) if revisit else None))
                if at.offset >= bundle:
                    yield _columns(at.close(), names, _INDEX_TYPES)
                    at = None
        if at:
            yield _columns(at.close(), names, _INDEX_TYPES)

    return run


def write_archives(
    pages: DataFrame,
    folder: str,
    least: int = 0,
    frame: int = FRAME,
    bundle: int = BUNDLE,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """Write a record for every row of ``pages`` into bundles under ``folder``; returns the index (see INDEX)."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), html.alias("html"))
    digest = F.sha2(F.encode("html", "UTF-8"), 256)
    keys = cut(rows.select("id", "url", digest.alias("sha"), F.octet_length("html").alias("n")))
    # copies are combined before they meet; single payloads need no partner
    first = (
        keys.where(F.col("n") >= least)
        .groupBy("sha", "n")
        .agg(F.min("id").alias("first"), F.min_by("url", "id").alias("first_url"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1")
    )
    later = join_by_key(keys.drop("url"), first, ["sha", "n"], "copies", hot_bar(keys.count())).where(~F.col("id").eqNullSafe(F.col("first")))
    later = cut(later.select(F.col("id").alias("own"), F.col("sha").alias("same"), "first", "first_url").distinct())
    # with few revisits their table goes to the pages, which then are not shuffled
    size = later.agg(F.sum(F.coalesce(F.octet_length("first_url"), F.lit(0)) + 160)).first()[0] or 0
    later = F.broadcast(later) if size <= SENT else later
    whole = rows.withColumn("sha", digest)
    joined = whole.join(later, F.col("id").eqNullSafe(F.col("own")) & (F.col("sha") == F.col("same")), "left")
    # a revisit's payload is only measured and digested by its task
    ready = joined.select("id", "url", "html", F.col("first").alias("refers"), F.col("first_url").alias("refers_url"), F.col("same").isNotNull().alias("revisit"))
    return cut(ready.mapInArrow(_write(qualified(pages.sparkSession, folder), frame, bundle), INDEX))


_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, sound boolean"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _READ.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_()]
    fs, unpack = None, zstandard.ZstdDecompressor()
    name = held = table = f = None
    for b in batches:
        out = []
        for bundle, frame, records, folder in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if fs is None:
                fs = _opened(folder)[0]
            if bundle != name:
                f = fs.open_input_file(bundle)
                table, name = read_seek_table(f, f.size()), bundle
            offset, packed, size = table[frame]
            f.seek(offset)
            held = unpack.decompress(f.read(packed), max_output_size=size)
            for r in records:
                fields, payload = parse_record(held[r["at"] : r["at"] + r["bytes"]])
                digest = fields["warc-payload-digest"].removeprefix("sha1:")
                kind, n = fields["warc-type"], int(fields["x-payload-length"])
                fine = fields["warc-record-id"] == r["record_id"]
                if kind == "response":
                    fine &= payload_digest(payload) == digest and len(payload) == n
                page, refers = (None if x in (None, "None", "null") else int(x) for x in (fields["x-page-id"], fields.get("x-refers-to-page")))
                out.append((page, n, digest, kind, refers, fine))
        yield _columns(out, names, types)


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """Every record of the index, read back by seeking to its frame: its fields as the archive has them, and whether it
    is sound: identifier, length and digest hold, and a revisit's response is there."""
    frames = index.groupBy("bundle", "frame").agg(
        F.sort_array(F.collect_list(F.struct("at", "bytes", "record_id"))).alias("records")
    )
    folder = qualified(index.sparkSession, folder)
    back = cut(frames.select("bundle", "frame", "records", F.lit(folder).alias("folder")).mapInArrow(_read, _READ))
    kind, ends = F.col("record_type"), ["refers_to", "payload_digest"]
    held = back.where(kind == "response").select(F.col("page_id").alias("refers_to"), "payload_digest").distinct()
    lost = cut(back.where(kind == "revisit").select(*ends).distinct().join(held, [back[ends[0]].eqNullSafe(held[ends[0]]), back[ends[1]] == held[ends[1]]], "left_anti"))
    if lost.isEmpty():
        return back
    lost = lost.select(F.col("refers_to").alias("to"), F.col("payload_digest").alias("of"), F.lit(True).alias("lost"))
    joined = back.join(lost, back["refers_to"].eqNullSafe(lost["to"]) & (back["payload_digest"] == lost["of"]), "left")
    return joined.select(*back.columns[:-1], (F.col("sound") & ~(F.coalesce("lost", F.lit(False)) & (kind == "revisit"))).alias("sound"))

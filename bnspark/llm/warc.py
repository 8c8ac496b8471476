"""WARC archives: a writer of one gzip member a record, and a splittable reader.

A reading task gets a byte range of a file.  It looks for gzip magic in its range, and takes a place as
the start of a record if the member there decodes to a WARC header and then to as many bytes as the header
says, with its checksum.  It goes on at the end of the record; where no record is there, because of damage,
a cut or padding, it reports the place and looks for the next magic.  A record belongs to the range in which
it starts, however far it reaches, so ranges need no order and a lost task reads its own range again.  A
range may begin inside a record whose payload is an archive itself, stored as it is: what starts before
the end of a whole record of an earlier range is part of that record and is taken out afterwards.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Callable, Iterator
from uuid import UUID

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bnspark.llm.common import drop, materialize, maybe_broadcast, new_path

MAGIC = b"\x1f\x8b\x08"
DATE = "2024-01-01T00:00:00Z"
SPLIT_BYTES = 8 << 20
WINDOW, FEED = 1 << 20, 1 << 14  # bytes read, and given to the decoder, at once
URN_SPACE = 0x626E737061726B00  # high half of the record ids, whose low half is the row's id
URN_NONE = URN_SPACE + 1  # that of rows without an id, whose low half is a number
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id long, record_id string, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, intact boolean"
PLACE = "file string, split long, start long, stop long, fault string"


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI (file, hdfs, s3, gs), and the path in it."""
    return pafs.FileSystem.from_uri(path if ":/" in path else "file://" + path)


def record_id(row: int, space: int = URN_SPACE) -> str:
    return f"<urn:uuid:{UUID(int=(space << 64) | (row & (1 << 64) - 1))}>"


def row_of(urn: str | None) -> int | None:
    """The row that an id of record_id() stands for; None for any other."""
    try:
        whole = UUID((urn or "").strip("<> ")).int
    except ValueError:
        return None
    low = whole & (1 << 64) - 1
    return None if whole >> 64 != URN_SPACE else low - (1 << 64) if low >> 63 else low


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(row: int | None, url: str, payload: bytes, refers_to: int | None, number: int = 0) -> bytes:
    """One record as a gzip member; number tells rows without an id apart.  A revisit holds the HTTP header
    alone, whose Content-Length still is the payload's."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(number, URN_NONE) if row is None else record_id(row)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", "".join(c if c > " " else f"%{ord(c):02X}" for c in url)),
        ("WARC-Payload-Digest", "sha1:" + digest(payload)),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to)), ("WARC-Refers-To-Date", DATE)]
    body = http if refers_to is not None else http + payload
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(body)))])
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(b"WARC/1.1\r\n" + head.encode("utf-8", "replace") + b"\r\n" + body + b"\r\n\r\n") + z.flush()


def _writer(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = filesystem(path)
        context = TaskContext.get()
        name = f"{folder}/part-{context.partitionId():06d}.warc.gz"
        scratch = f"{folder}/.part-{context.partitionId():06d}-{context.taskAttemptId()}"
        size = n = 0
        sink = None
        for batch in batches:
            for row, url, html, refers in zip(*(batch.column(i) for i in range(4)), strict=True):
                sink = sink or fs.open_output_stream(scratch)
                payload = (html.as_py() or "").encode("utf-8", "replace")
                data = record(row.as_py(), url.as_py() or "", payload, refers.as_py(), context.partitionId() << 32 | n)
                sink.write(data)
                size += len(data)
                n += 1
        if sink:  # a file gets its name when it is whole; a second attempt replaces it by its like
            sink.close()
            if fs.get_file_info(name).type != pafs.FileType.NotFound:
                fs.delete_file(name)
            fs.move(scratch, name)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name.rpartition("/")[2]]), pa.array([size]), pa.array([n])], names=["file", "bytes", "records"]
            )

    return write


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0) -> DataFrame:
    """Write a record for each row of pages (page_id, url, html) into files under path; returns the
    manifest (file, bytes, records).

    Null html or url count as empty; a null page_id stays null and is below any other.  Of records with
    equal payloads of at least min_bytes bytes the one with the largest page_id is a response and the
    others revisit it; rows that repeat that page_id and payload are all responses, and so are rows of a
    group without any page_id.  Payloads are equal by SHA-1 and length.  An empty table writes no file."""
    known = F.col("page_id").cast("long")
    rows = pages.select(
        known.alias("page_id"), F.coalesce(known, F.lit(0)).alias("key"), known.isNull().alias("none"),
        F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    )
    sha = F.unhex(F.sha1("html")).alias("sha")
    marks = rows.select("key", "none", "page_id", sha, F.octet_length("html").alias("n")).where(F.col("n") >= min_bytes)
    marks = materialize(marks, "marks")
    owners = marks.groupBy("sha", "n").agg(F.max("page_id").alias("owner"), F.count("*").alias("copies"))
    owners = materialize(owners.where("copies > 1 and owner is not null"), "owners")
    refs = marks.join(maybe_broadcast(owners), ["sha", "n"]).where("none or page_id <> owner").select("key", "none", "sha", "owner").distinct()
    refs = materialize(refs, "refs")
    fs, folder = filesystem(path)
    fs.create_dir(folder, recursive=True)
    keyed = rows.withColumn("sha", sha)
    out = keyed.join(maybe_broadcast(refs), ["key", "none", "sha"], "left").select("page_id", "url", "html", "owner")
    manifest = materialize(out.mapInArrow(_writer(path), "file string, bytes long, records long"), "manifest")
    for old in (marks, owners, refs):
        drop(old)
    return manifest


class Bytes:
    """An open file, read in windows."""

    def __init__(self, source: pa.NativeFile, size: int):
        self.source, self.size, self.lo, self.held = source, size, 0, memoryview(b"")

    def at(self, place: int) -> memoryview:
        """Some bytes from place on; none at the end of the file."""
        if not self.lo <= place < self.lo + len(self.held):
            self.source.seek(place)
            self.lo, self.held = place, memoryview(self.source.read(min(WINDOW, max(self.size - place, 0))))
        return self.held[place - self.lo :]

    def magic(self, place: int, stop: int) -> int:
        """The first place from `place` on, below stop, where gzip magic starts; else stop."""
        while place < stop:
            some = bytes(self.at(place))
            hit = some.find(MAGIC)
            if hit >= 0:
                return min(place + hit, stop)
            if place + len(some) >= self.size:
                return stop
            if len(some) < len(MAGIC):  # it may go on in the next window
                self.lo, self.held = 0, memoryview(b"")
            place += max(len(some) - len(MAGIC) + 1, 0)
        return stop


def parse(source: Bytes, start: int) -> tuple[dict[str, str], bytes, int] | str | None:
    """Header, block and end of the record whose member starts at start.  What is wrong, if it has a header
    but is not whole; None if there is no header of a record."""
    z, data, at = zlib.decompressobj(31), bytearray(), start
    fields: dict[str, str] | None = None

    def more() -> None:
        nonlocal at
        raw = source.at(at)[:FEED]
        if not raw:
            raise zlib.error("cut off")
        at += len(raw)
        data.extend(z.decompress(raw))

    try:
        seen = 0
        while (head := data.find(b"\r\n\r\n", max(seen - 3, 0))) < 0:
            if z.eof or not data.startswith(b"WARC/1."[: len(data)]):
                return None
            seen = len(data)
            more()
        first, *lines = data[:head].decode("utf-8", "replace").split("\r\n")
        found = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        if not first.startswith("WARC/1.") or not {"warc-type", "content-length"} <= found.keys():
            return None
        length = int(found["content-length"])
        fields = found
        while not z.eof and len(data) <= head + 4 + length + 4:
            more()
        block = bytes(data[head + 4 : head + 4 + length])
        if not z.eof or len(block) < length:
            return "its length differs from its header's"
        return fields, block, at - len(z.unused_data)
    except (zlib.error, ValueError) as error:
        return str(error) if fields is not None else None


Found = tuple[int, int, dict[str, str] | None, bytes, str | None]  # start, end, header, block, fault


def records(source: Bytes, start: int, stop: int) -> Iterator[Found]:
    """Records that start in [start, stop), and places there where a record was to be and none is."""
    at, due = start, start == 0
    while at < stop:
        got = parse(source, at) if bytes(source.at(at)[:1]) == MAGIC[:1] else None
        if isinstance(got, tuple):
            yield at, got[2], got[0], got[1], None
            at, due = got[2], True
            continue
        if got or due:
            yield at, at, None, b"", got or "no record starts here"
        due = False
        at = source.magic(at + 1, stop)
    if due and at < source.size and parse(source, at) is None:  # the range of that place can't know of it
        yield at, at, None, b"", "no record starts here"


def http_payload(block: bytes) -> tuple[int, bytes]:
    """Length of the payload by the HTTP header, and the payload that is there."""
    head, _, body = block.partition(b"\r\n\r\n")
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length" and value.strip().isdigit():
            return int(value), body
    return len(body), body


def _row(fields: dict[str, str], block: bytes) -> tuple[tuple, bytes]:
    """A row of RECORD, and the payload: of HTTP messages what follows their header, else the block."""
    kind = fields["warc-type"]
    http = fields.get("content-type", "").startswith("application/http")
    length, body = http_payload(block) if http else (len(block), block)
    algorithm, _, told = fields.get("warc-payload-digest", "").partition(":")
    if kind == "revisit":
        own, intact = told or None, True
    else:
        own, length = digest(body), len(body)
        intact = algorithm.lower() != "sha1" or not http or told.upper() in (own, base64.b32decode(own).hex().upper())
    refers = row_of(fields.get("warc-refers-to"))
    return (row_of(fields.get("warc-record-id")), fields.get("warc-record-id"), fields.get("warc-target-uri"), kind, own, length, refers, intact), body


def _reader(path: str, payloads: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    types += [pa.int64(), *[pa.string()] * 4, pa.int64(), pa.int64(), pa.bool_(), *[pa.binary()] * payloads]
    names = [x.split()[0] for x in f"{PLACE}, {RECORD}".split(", ")] + ["payload"] * payloads

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = filesystem(path)

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for batch in batches:
            for split in batch.to_pylist():
                rows, held = [], 0
                with fs.open_input_file(f"{folder}/{split['file']}") as source:
                    for start, end, fields, block, fault in records(Bytes(source, split["size"]), split["start"], split["stop"]):
                        row, body = _row(fields, block) if fields else ((None,) * 8, b"")
                        place = (split["file"], split["start"], start, end, fault)
                        rows.append((*place, *row, *[body] * payloads))
                        held += len(body) * payloads
                        if len(rows) >= 10_000 or held >= SPLIT_BYTES:
                            yield out(rows)
                            rows, held = [], 0
                if rows:
                    yield out(rows)

    return read


def scan_warc(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, payloads: bool = False) -> DataFrame:
    """What the archives under path hold: a row for each whole record, with its file, start and stop, and a row
    with a fault for each place where a record was to be and none can be read.  It is a written table."""
    fs, folder = filesystem(path)
    found = fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
    files = [(f.base_name, f.size) for f in found if f.base_name.endswith(".warc.gz")]
    splits = [
        (name, size, at, min(at + split_bytes, size)) for name, size in sorted(files) for at in range(0, size, split_bytes)
    ]
    table = spark.createDataFrame(splits, "file string, size long, start long, stop long")
    schema = f"{PLACE}, {RECORD}" + ", payload binary" * payloads
    rows = table.repartitionByRange(max(len(splits), 1), "file", "start").mapInArrow(_reader(path, payloads), schema)
    rows = materialize(rows, "records")
    number = lambda c: F.floor(c / split_bytes) * split_bytes
    wide = rows.where(F.col("stop") > F.col("split") + split_bytes)  # it reaches into later ranges
    reach = wide.select("file", "stop", F.explode(F.sequence(F.col("split") + split_bytes, number(F.col("stop") - 1), F.lit(split_bytes))).alias("split"))
    reach = materialize(reach.groupBy("file", "split").agg(F.max("stop").alias("upto")), "reach")
    out = rows.join(maybe_broadcast(reach), ["file", "split"], "left").where("upto is null or start >= upto").select(*rows.columns)
    out = materialize(out, "scan")
    drop(rows)
    drop(reach)
    return out


def read_warc(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, payloads: bool = False) -> DataFrame:
    """The records of the archives under path, one row each; a file is read by a task for each
    split_bytes of it.  page_id and refers_to are null in records that write_warc() didn't write, and for
    rows without an id.  The digest is the payload's bare base32 SHA-1 as it is read, and intact says whether
    the header's agrees where it gives a SHA-1; of a revisit, length and digest are its header's.  Records of
    every type are returned.  Places that can't be read are left out: scan_warc() has them.  A folder without
    archives gives no rows."""
    rows = scan_warc(spark, path, split_bytes, payloads).where("fault is null")
    return rows.select(*[x.split()[0] for x in RECORD.split(", ")], *["payload"] * payloads)


def round_trip(pages: DataFrame, min_bytes: int = 0, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Write pages as WARC into the shared folder and read the archives back; raises if any file gives back
    another number of records than were written, a place that can't be read, or another payload."""
    path = new_path(pages.sparkSession, "warc")
    manifest = write_warc(pages, path, min_bytes)
    rows = scan_warc(pages.sparkSession, path, split_bytes)
    got = rows.groupBy("file").agg(F.count_if("intact").alias("whole"), F.count("*").alias("all"))
    lost = manifest.join(got, "file", "full").where("not (records <=> whole and records <=> all)").limit(5).collect()
    if lost:
        raise ValueError(f"archives under {path} do not give back what was written: {lost}")
    drop(manifest)
    return rows.select(*[x.split()[0] for x in RECORD.split(", ")])

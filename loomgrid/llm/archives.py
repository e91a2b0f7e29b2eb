"""Legacy archive conversion: ARC files of either version become WARC files, and both are read back.

ARC records are parsed by the header line of their version (1: URL, IP, date, type, length; 2: also result code, checksum,
location, offset and file name) and by the declared length, never by looking for a separator. The converter synthesises
what WARC needs and ARC lacks: record identifiers from a digest of the record, ISO timestamps from 14-digit dates, record
types, and payload and block digests. Of records with equal payloads of at least `least` bytes the one with the largest
page number is the response; the others become revisits that refer to it.

Archives are written by Spark's text writer, a record a row, so writing commits and survives lost executors as any Spark
output does, and they are read as binary files. Every record is a gzip member of its own, as readers that seek need it; the
line separator between two rows is an empty member, which such readers pass over. An archive is as long as one partition of
the pages, and is read member by member.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Generator, Iterable, Iterator
from datetime import datetime, timedelta, timezone
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.llm.common import shared_path, stored, texts_of

V1 = "URL IP-address Archive-date Content-type Archive-length"
V2 = "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
EPOCH = datetime(2000, 1, 1, tzinfo=timezone.utc)
BROADCAST_ROWS = 50_000
_RECORD = "page_id long, url string, ip string, stamp string, mime string, head binary, payload binary, payload_digest string"


EMPTY = gzip.compress(b"", mtime=0)


def member(record: bytes) -> bytes:
    """A record as a gzip member."""
    return gzip.compress(record, 5, mtime=0)


def members(content: bytes, step: int = 1 << 14) -> Iterator[bytes]:
    """What the members of a gzip file hold, one after the other; a plain file is one piece."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    view, at = memoryview(content), 0
    while at < len(view):
        unpack, out = zlib.decompressobj(31), []
        while not unpack.eof and at < len(view):
            out.append(unpack.decompress(view[at : at + step]))
            at += min(step, len(view) - at)
        at -= len(unpack.unused_data)
        if any(out):
            yield b"".join(out)


def _save(rows: DataFrame, path: str) -> None:
    rows.select(F.col("value").cast("string")).write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY.decode("latin-1")).text(path)


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def write_arc(pages: DataFrame, path: str, version: int | None = None) -> None:
    """Write pages (page_id, url, html) as ARC files; `version` 1 or 2, else files of both.

    A null html is an empty payload, a null url is `urn:page:` and the number. Blanks in URLs are percent-encoded.
    """

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        kind = version or part % 2 + 1
        name, offset = f"part-{part:05d}.arc.gz", 0
        about = f"{kind} 0 loomgrid\n{V1 if kind == 1 else V2}\n".encode()
        tail = b"" if kind == 1 else f" 200 - - 0 {name}".encode()
        first = [member(b"filedesc://" + name.encode() + b" 0.0.0.0 20000101000000 text/plain" + tail + b" %d\n" % len(about) + about + b"\n")]
        offset = len(first[0]) + len(EMPTY)
        for batch in batches:
            out = first
            first = []
            for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: " + (b"" if page_id is None else b"%d" % page_id) + b"\r\n\r\n" + (html or b"")
                stamp = (EPOCH + timedelta(seconds=(page_id or 0) % 10**9)).strftime("%Y%m%d%H%M%S")
                where = quote(url, safe=":/?#[]@!$&'()*+,;=%~") if url else f"urn:page:{page_id}"
                extra = "" if kind == 1 else f" 200 {sha1_base32(block)} - {offset} {name}"
                out.append(member(f"{where} 127.0.0.1 {stamp} text/html{extra} {len(block)}\n".encode() + block + b"\n"))
                offset += len(out[-1]) + len(EMPTY)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
        if first:
            yield pa.RecordBatch.from_arrays([pa.array(first, pa.binary())], ["value"])

    rows = texts_of(pages.select(F.col("page_id").cast("long"), "url", F.col("html").cast("binary"))).mapInArrow(records, "value binary")
    _save(rows, path)


def arc_records(pieces: Iterable[bytes], lost: list[int] | None = None) -> Iterator[tuple[dict, bytes]]:
    """Header fields and block of each record; the version block says which header line the others have.

    A header line with another number of fields, no 14-digit date or no length, and a block that is cut short, are damage: reading goes
    on at the next sound header line. A piece that begins with damage is one record (a gzip member), and its lines are not searched, for
    its payload may hold what looks like a header; only the first piece is, as a plain file is one. lost[0] counts the places of damage.
    """
    names = V1.split()
    lost = [0] if lost is None else lost
    for n, data in enumerate(pieces):
        names = yield from _arc_piece(data, names, n == 0, lost)


def _arc_fields(line: str, names: list[str]) -> dict | None:
    """The fields of a sound header line of the file's version, else of either version."""
    for layout in (names, V1.split(), V2.split()):
        # a URL may hold blanks, so fields count from the right
        fields = dict(zip(layout, line.rsplit(" ", len(layout) - 1), strict=False))
        if len(fields) == len(layout) and re.fullmatch(r"[0-9]{14}", fields.get("Archive-date", "")) and re.fullmatch(r"[0-9]{1,18}", fields.get("Archive-length", "")):
            return fields
    return None


def _arc_piece(data: bytes, names: list[str], search: bool, lost: list[int]) -> Generator[tuple[dict, bytes], None, list[str]]:
    at, astray = 0, False
    while at < len(data):
        end = data.find(b"\n", at)
        line = data[at : end if end >= 0 else len(data)].decode("utf-8", "replace").strip()
        at = end + 1 if end >= 0 else len(data)
        if not line:
            continue
        fields = _arc_fields(line, names)
        if fields is None or at + int(fields["Archive-length"]) > len(data):
            lost[0] += not astray
            if not search:
                break
            astray = True
            continue
        length = int(fields["Archive-length"])
        block = data[at : at + length]
        at += length
        search, astray = True, False  # a piece with a sound record at its head is read on by lines
        if line.startswith("filedesc:"):
            about = block.decode("utf-8", "replace").split("\n")
            if len(about) > 1 and "Archive-length" in about[1]:
                names = about[1].split()
            continue
        yield fields, block
    return names


def arc_damage(spark: SparkSession, path: str) -> DataFrame:
    """path and n_lost of every ARC file: at how many places read_arc() skips damage."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                lost = [0]
                for _ in arc_records(members(content.as_py()), lost):
                    pass
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array(lost, pa.int64())], ["path", "n_lost"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(count, "path string, n_lost long")


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """Records of ARC files, with the payload parted from the HTTP head, and its digest. Damaged records are skipped; see arc_damage()."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _RECORD.split(", ")]
        types = [pa.int64(), *[pa.string()] * 4, pa.binary(), pa.binary(), pa.string()]
        for batch in batches:
            for content in batch.column(0):
                rows: list[tuple] = []
                for fields, block in arc_records(members(content.as_py())):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    number = next((h.split(b":", 1)[1].strip() for h in head.split(b"\r\n") if h.lower().startswith(b"x-page-id:")), b"")
                    rows.append((int(number) if re.fullmatch(rb"-?[0-9]{1,18}", number) else None, fields["URL"], fields["IP-address"], fields["Archive-date"], fields["Content-type"], head, payload, sha1_base32(payload)))
                    if len(rows) == 500:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, _RECORD)


def with_roles(records: DataFrame, least: int = 0) -> DataFrame:
    """Add `original`, the page number of the response with the same payload, where there is one among several rows.

    The table of repeated payloads is broadcast only if it is counted to be small; else the join is salted, as one payload
    may have a third of all rows.
    """
    sized = records.where(F.length("payload") >= least)
    repeated = stored(sized.groupBy("payload_digest").agg(F.max("page_id").alias("original"), F.count("*").alias("n")).where("n > 1").drop("n"), "repeated")
    able = F.length("payload") >= least
    if repeated.count() <= BROADCAST_ROWS:
        return records.join(F.broadcast(repeated), "payload_digest", "left").withColumn("original", F.when(able, F.col("original")))
    return _salted(records, repeated, "payload_digest").withColumn("original", F.when(able, F.col("original")))


def _salted(rows: DataFrame, table: DataFrame, key: str, salts: int = 16) -> DataFrame:
    """rows left join table on a key that a third of the rows may share."""
    spread = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int"))
    return salted.join(spread, [key, "salt"], "left").drop("salt")


def record_id(page_id: int | None, digest: str) -> str:
    """The identifier a page's record gets: the same for the same page and payload, whoever computes it."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{page_id} {digest}'.encode()).digest()[:16], version=5)}>"


def write_warc(records: DataFrame, path: str) -> None:
    """Write records (read_arc with `original`) as WARC 1.1 files, each led by a warcinfo record."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        about = b"software: loomgrid\r\nformat: WARC File Format 1.1\r\n"
        out = [member(b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:%s>\r\nWARC-Date: 2000-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\nContent-Length: %d\r\n\r\n" % (str(uuid.UUID(int=0, version=5)).encode(), len(about)) + about + b"\r\n\r\n")]
        for batch in batches:
            for row in batch.to_pylist():
                s = row["stamp"]
                revisit = row["original"] is not None and row["original"] != row["page_id"]
                block = row["head"] + b"\r\n\r\n" + (b"" if revisit else row["payload"])
                lines = [
                    "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(row['page_id'], row['payload_digest'])}",
                    f"WARC-Date: {s[:4]}-{s[4:6]}-{s[6:8]}T{s[8:10]}:{s[10:12]}:{s[12:14]}Z", f"WARC-Target-URI: {row['url']}", f"WARC-IP-Address: {row['ip']}",
                    f"WARC-Payload-Digest: sha1:{row['payload_digest']}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}", f"X-Payload-Length: {len(row['payload'])}",
                ]
                if revisit:
                    lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(row['original'], row['payload_digest'])}"]
                lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
                out.append(member("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
            out = []

    rows = records.select("page_id", "url", "ip", "stamp", "head", "payload", "payload_digest", "original").mapInArrow(build, "value binary")
    _save(rows, path)


def warc_records(data: bytes) -> Iterator[tuple[dict, bytes]]:
    """Header fields (names in lower case) and block of each record, by the declared lengths."""
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.index(b"\r\n\r\n", at)
        fields = {k.strip().lower(): v.strip() for k, _, v in (h.partition(":") for h in data[at:end].decode("utf-8", "replace").split("\r\n")[1:])}
        at = end + 4
        length = int(fields["content-length"])
        yield fields, data[at : at + length]
        at += length


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files other than warcinfo: page_id, url, record_id, record_type, payload_digest, payload_bytes, refers_id, warc_date, intact."""
    names = ["page_id", "url", "record_id", "record_type", "payload_digest", "payload_bytes", "refers_id", "warc_date", "intact"]
    types = [pa.int64(), *[pa.string()] * 4, pa.int64(), pa.string(), pa.string(), pa.bool_()]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for f, block in (r for piece in members(content.as_py()) for r in warc_records(piece)):
                    if f["warc-type"] == "warcinfo":
                        continue
                    head, _, payload = block.partition(b"\r\n\r\n")
                    number = next((h.split(b":", 1)[1].strip() for h in head.split(b"\r\n") if h.lower().startswith(b"x-page-id:")), b"")
                    digest = f["warc-payload-digest"].removeprefix("sha1:")
                    full = f["warc-type"] == "response"
                    intact = f["warc-block-digest"] == f"sha1:{sha1_base32(block)}" and (not full or sha1_base32(payload) == digest)
                    rows.append((int(number) if number else None, f["warc-target-uri"], f["warc-record-id"], f["warc-type"], digest, len(payload) if full else int(f["x-payload-length"]), f.get("warc-refers-to"), f["warc-date"], intact))
                    if len(rows) == 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, "page_id long, url string, record_id string, record_type string, payload_digest string, payload_bytes long, refers_id string, warc_date string, intact boolean")


def convert(pages: DataFrame, least: int = 0) -> DataFrame:
    """pages -> ARC -> WARC -> the records read back, with refers_to as page number.

    Rows that repeat the largest page_id of a payload are all responses, and rows of equal page_id and payload have one record
    identifier. A null page_id has no number in the archive and
    comes back null. Null and empty html are empty payloads. Other columns are ignored.
    """
    spark = pages.sparkSession
    arc, warc = shared_path(spark, "arc"), shared_path(spark, "warc")
    write_arc(pages, arc)
    write_warc(with_roles(read_arc(spark, arc), least), warc)
    back = stored(read_warc(spark, warc), "records")
    targets = back.where(F.col("record_type") == "response").select(F.col("record_id").alias("refers_id"), F.col("page_id").alias("refers_to")).distinct()
    revisits = back.where(F.col("refers_id").isNotNull()).select("refers_id").distinct()
    meant = stored(targets.join(revisits, "refers_id", "left_semi"), "responses")
    if meant.count() <= BROADCAST_ROWS:
        return back.join(F.broadcast(meant), "refers_id", "left")
    return _salted(back, meant, "refers_id")


def op4_warc(spark, sf_dir: str) -> DataFrame:
    return convert(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: The same rows from the pages themselves; base 32 takes twenty bits of the hexadecimal digest at a time.
OP4_SQL = """WITH d AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS x FROM pages),
  b AS (SELECT page_id, payload_bytes, list_aggregate(list_transform(range(8), lambda k: list_aggregate(list_transform([15, 10, 5, 0], lambda s:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(x, CAST(5 * k + 1 AS INTEGER), 5) AS INTEGER) >> s) & 31 AS INTEGER) + 1, 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest FROM d),
  r AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM b)
  SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM r"""

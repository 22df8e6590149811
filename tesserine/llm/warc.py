"""WARC archives: a writer, and a reader that salvages what it can.

``write_warc`` makes one gzip member a record, deduplicates payloads with
revisit records and leaves the files to Spark's text sink, so they land in any
store Spark can write.  (A member that does not end with a zero byte is
followed by an empty one; that byte is then the sink's line separator, and the
file is a plain sequence of members.)

``read_warc`` reads whole files (``binaryFile``), compressed or not.  A record
must have a version line, a header with a length, a block of that length, the
closing blank lines, and digests that match where they are given.  If a check
fails, the bytes from there to the next member or version line at which a
record can be read are quarantined: a row with ``ok`` false, the reason, and
the place and length of the gap.  All later records are recovered.  A member is
unpacked as a stream and searched for version lines too, so one of its records
that fails costs no other, and of one that breaks off the records before are kept.

Bounds: a file is read as one row.  Files roll by bytes: beyond ``file_bytes`` a
new one begins, so a file has that and one record at most, which bounds the
memory of a task; archives of others are bounded by
spark.sql.sources.binaryFile.maxLength.

Defined results: a null payload is empty; null page ids and addresses are left
out of the header and read as null; repeated rows are a record each; further
columns are not read, whatever their names.  Of equal
payloads the largest page_id is the response (null last, and of repeated ids
one row), the others revisit it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Generator, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.llm.common import bound_batches, checkpoint

VERSION = b"WARC/1.1"
# Names of the format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EMPTY_MEMBER = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff\x03\x00\x00\x00\x00\x00\x00\x00\x00\x00"
GZIP_MAGIC = b"\x1f\x8b\x08"
START = re.compile(rb"\x1f\x8b\x08|WARC/1\.")
#: Bytes buffered for one record of a member: what a value of Spark can hold.
MAX_RECORD = (1 << 31) - 1
#: Bytes after which a new file begins, and those that go to the sink as one line.
FILE_BYTES, LINE_BYTES = 64 << 20, 1 << 20
#: Deflate level: 2 takes half the time of 6 for about a tenth more bytes.
LEVEL = 2


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{payload_digest}')}>"


def record(page_id, url: str | None, payload: bytes, refers_to, date: str, is_revisit: bool) -> bytes:
    """One record, not compressed."""
    name = digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if is_revisit else "response"),
        ("WARC-Record-ID", record_id(page_id, name)),
        ("WARC-Date", date),
        ("WARC-Target-URI", None if url is None else re.sub(r"[\r\n]+", " ", url)),
        ("WARC-Payload-Digest", f"sha1:{name}"),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        ("WARC-Profile", REVISIT_PROFILE if is_revisit else None),
        ("WARC-Refers-To", record_id(refers_to, name) if is_revisit else None),
        ("X-Page-ID", page_id),
        ("X-Refers-To-Page-ID", refers_to if is_revisit else None),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(block)),
    ]
    header = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None).encode()
    return VERSION + b"\r\n" + header + b"\r\n" + block + b"\r\n\r\n"


def member(raw: bytes) -> bytes:
    """``raw`` as a gzip member; ends with a zero byte."""
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    out = packer.compress(raw) + packer.flush()
    return out if out.endswith(b"\0") else out + EMPTY_MEMBER


def write_warc(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> None:
    """Write ``pages`` as archives (part-*.warc.gz) under ``path``.

    The sink counts lines, not bytes: members are joined to lines of about
    ``LINE_BYTES``, and a longer one is followed by empty members that count
    for the rest of it.

    Payloads of at least ``min_bytes`` are deduplicated.  Only digests that
    occur twice or more are joined back, so where they are few the pages are
    not shuffled (adaptive execution broadcasts what is measured as small).
    """
    body = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), body.alias("payload")).withColumn("digest", F.unhex(F.sha1("payload")))
    order = F.struct(F.col("page_id").isNotNull().alias("known"), F.col("page_id").alias("id"))
    groups = rows.where(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max(order)["id"].alias("keeper")).where("n > 1").select("digest", "keeper", F.lit(True).alias("grouped"))
    # Of rows that repeat the keeper's id one is the response.
    met = rows.join(groups, "digest", "left")
    twins = groups.join(rows.select("digest", F.col("page_id").alias("twin")), "digest").where(F.col("twin").eqNullSafe(F.col("keeper"))).groupBy("digest").count().where("count > 1").select("digest")
    if twins.take(1):
        from pyspark.sql import Window

        hit = F.col("page_id").eqNullSafe(F.col("keeper")) & F.col("grouped")
        nth = F.row_number().over(Window.partitionBy("digest", "page_id").orderBy("url"))
        met = met.where(~F.coalesce(hit, F.lit(False))).withColumn("nth", F.lit(2)).unionByName(met.where(hit).withColumn("nth", nth))
    else:
        met = met.withColumn("nth", F.lit(1))
    revisit = F.coalesce(F.col("grouped") & ~(F.col("page_id").eqNullSafe(F.col("keeper")) & (F.col("nth") == 1)), F.lit(False))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line, size = [], 0

        def lines() -> pa.RecordBatch:
            # The last zero byte is the sink's separator.
            fill = [EMPTY_MEMBER[:-1]] * (size // LINE_BYTES - 1)
            return pa.RecordBatch.from_arrays([pa.array([b"".join(line)[:-1], *fill], pa.binary())], ["value"])

        for batch in batches:
            for p, u, h, k, r in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "keeper", "revisit")), strict=True):
                line.append(member(record(p.as_py(), u.as_py(), h.as_py().encode(), k.as_py(), date, r.as_py())))
                size += len(line[-1])
                if size >= LINE_BYTES:
                    yield lines()
                    line, size = [], 0
        if line:
            yield lines()

    bound_batches(pages.sparkSession)
    members = met.select("page_id", "url", "payload", "keeper", revisit.alias("revisit")).mapInArrow(build, "value binary")
    members.select(F.col("value").cast("string")).write.option("lineSep", "\0").option("maxRecordsPerFile", max(1, file_bytes // LINE_BYTES)).text(path)
    _name_archives(pages.sparkSession, path)


def _name_archives(spark: SparkSession, path: str) -> None:
    """Give the sink's files the ending of what they are."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in store.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith("part-") and name.endswith(".txt"):
            store.rename(status.getPath(), spark._jvm.org.apache.hadoop.fs.Path(folder, name.removesuffix(".txt") + ".warc.gz"))


class Broken(Exception):
    """A record that fails a check; with ``need`` it could be whole if there were so many bytes."""

    def __init__(self, reason: str, need: int | None = None):
        super().__init__(reason)
        self.need = need


def parse_record(raw: bytes | bytearray, at: int) -> tuple[dict[str, str], bytes, int]:
    """Header, block and end of the record at ``at``."""
    if not raw.startswith(b"WARC/", at):
        raise Broken("no version line", at + 5 if b"WARC/".startswith(raw[at : at + 5]) else None)
    stop = raw.find(b"\r\n\r\n", at)
    if stop < 0:
        raise Broken("header has no end", len(raw) + 1)
    fields: dict[str, str] = {}
    for line in raw[at:stop].decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise Broken("header line without a name")
        fields[name.strip().lower()] = value.strip()
    if not fields.get("content-length", "").isdigit():
        raise Broken("no length")
    begin = stop + 4
    end = begin + int(fields["content-length"])
    if end + 4 > len(raw) and raw[end : end + 4] != b"\r\n\r\n"[: max(0, len(raw) - end)]:
        raise Broken("block does not end where its length says")
    if end + 4 > len(raw):
        raise Broken("block is cut off", end + 4)
    if raw[end : end + 4] != b"\r\n\r\n":
        raise Broken("block does not end where its length says")
    block = bytes(memoryview(raw)[begin:end])
    wanted = fields.get("warc-block-digest", "")
    if wanted.startswith("sha1:") and wanted[5:] != digest(block):
        raise Broken("block digest differs")
    payload = block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else block
    wanted = fields.get("warc-payload-digest", "")
    if fields.get("warc-type") != "revisit" and wanted.startswith("sha1:") and wanted[5:] != digest(payload):
        raise Broken("payload digest differs")
    return fields, block, end + 4


def pieces(raw: bytes, at: int, step: int = 16_384, most: int = 1 << 20) -> Generator[bytes, None, tuple[int, str | None, bool]]:
    """Content of the gzip member at ``at`` as far as it can be read; returns its end, what ails it, and whether that is damage (not a cut).

    The member is fed in small pieces, as what lies behind its end in a piece
    is copied.  A piece with an error is fed again byte by byte, for what
    comes before the error.
    """
    unpacker, view, fed = zlib.decompressobj(31), memoryview(raw), at
    while not unpacker.eof:
        data = unpacker.unconsumed_tail
        if not data:
            if fed >= len(raw):
                yield unpacker.flush()
                return fed, "member is cut off", False
            data = view[fed : fed + step]
            fed += len(data)
        before = unpacker.copy()
        try:
            part = unpacker.decompress(data, most)
        except zlib.error as error:
            try:
                for k in range(len(data)):
                    yield before.decompress(data[k : k + 1])
            except zlib.error:
                pass
            return fed, f"member: {error}", True
        yield part
    return fed - len(unpacker.unused_data), None, False


def probe(raw: bytes, at: int, keep: int = 1 << 20) -> tuple[int, int, str | None, bool, list[bytes] | None]:
    """Size of the content of the member at ``at``, what ``pieces`` returns, and the content itself if it is small."""
    size, kept, stream = 0, [], pieces(raw, at)
    while True:
        try:
            part = next(stream)
        except StopIteration as stop:
            return size, *stop.value, kept
        size += len(part)
        if kept is not None:
            kept.append(part)
            if size > keep:
                kept = None


def salvage(stream: Iterator[bytes], size: int, damaged: bool, limit: int) -> Iterator[tuple[str | None, dict[str, str], bytes]]:
    """(reason, header, block) of the records, and with a reason of the gaps, of a member with ``size`` bytes of content.

    Of a damaged member only records with a digest can be trusted.  What is
    buffered is one record, of at most ``limit`` bytes, and a piece.
    """
    buffer, at, read, lost = bytearray(), 0, 0, None

    def fill(n: int) -> None:
        nonlocal read
        while len(buffer) < n and read < size:
            part = next(stream)
            buffer.extend(part)
            read += len(part)

    while True:
        if 2 * at >= len(buffer):
            del buffer[:at]
            at = 0
        fill(at + 1)
        if at == len(buffer):
            break
        try:
            fields, block, end = parse_record(buffer, at)
            if damaged and not any(fields.get(f"warc-{x}-digest", "").startswith("sha1:") for x in (["block"] if fields.get("warc-type") == "revisit" else ["block", "payload"])):
                raise Broken("member is damaged and the record has no digest")
        except Broken as error:
            if error.need and error.need <= len(buffer) + size - read:
                if error.need - at <= limit:
                    fill(error.need)
                    continue
                error = Broken("record is too long")
            lost = lost or str(error)
            found = buffer.find(b"WARC/1.", at + 1)
            while found < 0 and read < size:
                del buffer[: max(at + 1, len(buffer) - 6)]
                at = -1
                fill(len(buffer) + 1)
                found = buffer.find(b"WARC/1.")
            at = found if found >= 0 else len(buffer)
            continue
        if lost:
            yield lost, {}, b""
            lost = None
        yield None, fields, block
        at = end
    if lost:
        yield lost, {}, b""


def scan_archive(raw: bytes, limit: int = MAX_RECORD) -> Iterator[tuple[int, int, str | None, dict[str, str], bytes]]:
    """(offset, length, reason, header, block) of each record and, with a reason, of each quarantined gap.

    What is inside a member has the member's place and length; one that breaks
    off counts up to the next place where a record could begin, and its unread
    rest begins a gap at the same offset.
    """
    at, gap, why = 0, None, ""
    while at < len(raw):
        step, broken = None, None
        if raw.startswith(GZIP_MAGIC, at):
            size, end, broken, damaged, kept = probe(raw, at)
            if broken:
                step = START.search(raw, at + 1)
                end = step.start() if step else len(raw)
            found = salvage(iter(kept) if kept is not None else pieces(raw, at), size, damaged, limit)
        else:
            try:
                fields, block, end = parse_record(raw, at)
                found = iter([(None, fields, block)])
            except Broken as error:
                step, broken, found = START.search(raw, at + 1), str(error), iter(())
                end = step.start() if step else len(raw)
        # Gaps before the first record of a member join the gap before it, if there is one.
        first, inner = None, None
        for first in found:
            if first[0] is None:
                break
            inner, first = inner or first[0], None
        if first is None:
            if broken or inner:
                if gap is None:
                    gap, why = at, broken or inner
            elif gap is not None:
                yield gap, at - gap, why, {}, b""
                gap = None
            at = end
            continue
        if gap is not None:
            yield gap, at - gap, why, {}, b""
            gap = None
        if inner:
            yield at, end - at, inner, {}, b""
        yield at, end - at, *first
        lost = None
        for part in found:
            if lost:
                yield at, end - at, *lost
                lost = None
            if part[0] is None:
                yield at, end - at, *part
            else:
                lost = part
        if broken:
            gap, why = at, broken
        elif lost:
            yield at, end - at, *lost
        at = end
    if gap is not None:
        yield gap, len(raw) - gap, why, {}, b""


RECORDS = "file string, offset long, length long, ok boolean, reason string, record_type string, record_id string, target_uri string, refers_to string, page_id long, refers_to_page_id long, payload_bytes long, payload_digest string, payload binary"


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Records and quarantined gaps of all files under ``path``."""
    names = [f.split()[0] for f in RECORDS.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                file, raw = batch.column("path")[k].as_py(), batch.column("content")[k].as_py()
                rows: list[tuple] = []
                size = 0
                for offset, length, reason, fields, block in scan_archive(raw):
                    number = lambda n, f=fields: int(f[n]) if re.fullmatch(r"-?\d+", f.get(n, "")) else None
                    head, _, payload = block.partition(b"\r\n\r\n") if fields.get("content-type", "").startswith("application/http") else (b"", b"", block)
                    full = re.search(rb"(?i)\r\ncontent-length: *(\d+)", head)
                    n = int(full[1]) if full and fields.get("warc-type") == "revisit" else len(payload)
                    name = fields.get("warc-payload-digest", "").removeprefix("sha1:") or (digest(payload) if reason is None else None)
                    rows.append(
                        (file, offset, length, reason is None, reason, fields.get("warc-type"), fields.get("warc-record-id"), fields.get("warc-target-uri"), fields.get("warc-refers-to"),
                         number("x-page-id"), number("x-refers-to-page-id"), n if reason is None else None, name, payload if with_payload and reason is None else None)
                    )
                    size += len(payload) if with_payload else 0
                    if size > 8 << 20 or len(rows) >= 5000:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        types = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, types[f.split()[1]]) for c, f in zip(columns, RECORDS.split(", "), strict=True)], names)

    # A file is a row, and a batch ends as soon as it has the bytes of one.
    bound_batches(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(scan, RECORDS)


def round_trip(pages: DataFrame, path: str, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` under ``path``, read the archives back, and report the records (an error if any is lost); what is returned no longer needs the archives."""
    write_warc(pages, path, min_bytes=min_bytes)
    records = checkpoint(read_warc(pages.sparkSession, path, with_payload=False).where("ok").drop("payload"))
    bound_batches(pages.sparkSession)
    if (lost := pages.count() - records.count()) != 0:
        raise RuntimeError(f"{lost} of the pages written to {path} cannot be read back")
    return records

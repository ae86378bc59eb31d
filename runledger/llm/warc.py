"""WARC archives in ZIP files: writing them, and reading records by ranges.

An archive is a ZIP file with stored members: `archive/data.warc` (the records), `indexes/index.cdx`
(a line per record with its place in the data) and `datapackage.json`. Archives are kept as rows
(archive, block, bytes) of a Parquet table in blocks of a fixed size, which any store takes and which
Spark reads by range: a filter on archive and block reaches the scan. `from_files` brings ZIP files of
other origin into that form.

The reader never takes an archive apart as a whole. It reads the last bytes for the end record (and the
ZIP64 locator and end record), then the central directory, then the local header of each member, then
the index, then each record, and each of these is a join of ranges with the blocks that they touch.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.llm.arrow import broadcast_if_small, prepare
from runledger.session import cut_to_table, shared_dir

BLOCK = 1 << 20
ARCHIVE_BYTES = 32 << 20
BLOCKS = "archive string, block long, size long, bytes binary"
DATA, INDEX = "archive/data.warc", "indexes/index.cdx"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page: str, url: str, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One WARC 1.1 record. A revisit has an empty body and names the record it repeats."""
    body = b"" if refers_to is not None else payload
    uri = "".join(c for c in url if c not in "\r\n")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page}>", f"WARC-Target-URI: {uri}",
            "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: text/html", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-cased names) and body of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    return fields, rest[: int(fields["content-length"])]


def zip_bytes(members: list[tuple[str, bytes]], zip64: bool = False) -> bytes:
    """A ZIP file with stored members; ZIP64 records where sizes ask for them, or always."""
    out, directory = bytearray(), bytearray()
    for name, body in members:
        at, crc, long = len(out), zlib.crc32(body), zip64 or len(body) >= 0xFFFFFFFF or len(out) >= 0xFFFFFFFF
        extra = struct.pack("<HHQQ", 1, 16, len(body), len(body)) if long else b""
        size = 0xFFFFFFFF if long else len(body)
        out += struct.pack("<IHHHHHIIIHH", 0x04034B50, 45, 0x800, 0, 0, 33, crc, size, size, len(name.encode()), len(extra)) + name.encode() + extra + body
        extra = struct.pack("<HHQQQ", 1, 24, len(body), len(body), at) if long else b""
        directory += struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45, 0x800, 0, 0, 33, crc, size, size, len(name.encode()), len(extra), 0, 0, 0, 0, 0xFFFFFFFF if long else at)
        directory += name.encode() + extra
    at, n = len(out), len(members)
    out += directory
    if zip64 or at >= 0xFFFFFFFF or n >= 0xFFFF:
        end = len(out)
        out += struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, n, n, len(directory), at) + struct.pack("<IIQI", 0x07064B50, 0, end, 1)
        out += struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    else:
        out += struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, n, n, len(directory), at, 0)
    return bytes(out)


def find_directory(tail: bytes, size: int) -> tuple[str, int, int]:
    """From the last bytes of a file: ("directory" or "end64", offset, length) of what to read next."""
    at = tail.rfind(b"PK\x05\x06")
    while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):  # the mark may stand in the note
        at = tail.rfind(b"PK\x05\x06", 0, at)
    if at < 0:
        raise ValueError("no end of central directory")
    n, length, offset = struct.unpack_from("<HII", tail, at + 10)
    if at >= 20 and tail[at - 20: at - 16] == b"PK\x06\x07" and (n == 0xFFFF or 0xFFFFFFFF in (length, offset)):
        return "end64", struct.unpack_from("<Q", tail, at - 12)[0], 56
    return "directory", offset, length


def parse_end64(raw: bytes) -> tuple[int, int]:
    """Offset and length of the central directory from the ZIP64 end record."""
    if raw[:4] != b"PK\x06\x06":
        raise ValueError("no ZIP64 end record")
    length, offset = struct.unpack_from("<QQ", raw, 40)
    return offset, length


def parse_directory(raw: bytes) -> list[tuple[str, int, int, int]]:
    """Members: name, offset of the local header, size, method."""
    out, at = [], 0
    while raw[at: at + 4] == b"PK\x01\x02":
        method, _, _, _, packed, size, n_name, n_extra, n_note, _, _, _, offset = struct.unpack_from("<HHHIIIHHHHHII", raw, at + 10)
        name = raw[at + 46: at + 46 + n_name].decode()
        extra, p = raw[at + 46 + n_name: at + 46 + n_name + n_extra], 0
        while p + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, p)
            if kind == 1:
                wide = list(struct.unpack_from(f"<{n // 8}Q", extra, p + 4))
                size = wide.pop(0) if size == 0xFFFFFFFF else size
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                offset = wide.pop(0) if offset == 0xFFFFFFFF else offset
            p += 4 + n
        out.append((name, offset, size, method))
        at += 46 + n_name + n_extra + n_note
    return out


def archive_bytes(records: list[tuple[str, str, bytes]], zip64: bool = False) -> bytes:
    """An archive of (page, digest, record)."""
    lines, at = [], 0
    for page, digest, raw in records:
        lines.append(f"{page} {digest} {at} {len(raw)}\n")
        at += len(raw)
    note = json.dumps({"profile": "data-package", "resources": [{"path": DATA}, {"path": INDEX}]}).encode()
    return zip_bytes([(DATA, b"".join(r for _, _, r in records)), (INDEX, "".join(lines).encode()), ("datapackage.json", note)], zip64)


def write_archives(records: DataFrame, archive_size: int = ARCHIVE_BYTES, zip64: bool = False) -> DataFrame:
    """Archives, as stored blocks, of rows (page, url, payload, digest, refers_to), all text but payload.

    Each task fills one archive after the other; a record is in one archive. An archive is named by its
    task, its number there and the hash of its bytes.
    """

    def blocks(raw: bytes, number: int):
        name = f"{TaskContext.get().partitionId():06d}-{number:06d}-{hashlib.sha256(raw).hexdigest()[:16]}"
        starts = range(0, len(raw), BLOCK)
        return pa.RecordBatch.from_arrays([pa.array([name] * len(starts)), pa.array(range(len(starts)), pa.int64()), pa.array([len(raw)] * len(starts), pa.int64()),
                                           pa.array([raw[s: s + BLOCK] for s in starts], pa.binary())], names=["archive", "block", "size", "bytes"])

    def run(batches):
        waiting, size, number = [], 0, 0
        for batch in batches:
            for row in batch.to_pylist():
                raw = record_bytes(row["page"], row["url"], row["payload"], row["digest"], row["refers_to"])
                waiting.append((row["page"], row["digest"], raw))
                size += len(raw)
                if size >= archive_size:
                    yield blocks(archive_bytes(waiting, zip64), number)
                    waiting, size, number = [], 0, number + 1
        if waiting:
            yield blocks(archive_bytes(waiting, zip64), number)

    return _stored(records.select("page", "url", "payload", "digest", "refers_to").mapInArrow(run, BLOCKS))


def from_files(spark: SparkSession, path: str) -> DataFrame:
    """Archives of ZIP files, as stored blocks. A file is one row on its way in, so it has less than 2 GB."""
    files = spark.read.format("binaryFile").load(path)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                for s in range(0, len(row["content"]), BLOCK):
                    yield pa.RecordBatch.from_pylist([{"archive": row["path"], "block": s // BLOCK, "size": len(row["content"]), "bytes": row["content"][s: s + BLOCK]}])

    return _stored(files.select("path", "content").mapInArrow(run, BLOCKS))


def _stored(blocks: DataFrame) -> DataFrame:
    """Blocks written to the shared folder, well packed."""
    path = f"{shared_dir(blocks.sparkSession)}/archives-{uuid.uuid4().hex}"
    blocks.write.option("compression", "zstd").parquet(path)
    return blocks.sparkSession.read.schema(BLOCKS).parquet(path)


def read_ranges(blocks: DataFrame, ranges: DataFrame) -> DataFrame:
    """Rows (archive, offset, length, ...) with `raw`, the bytes there. Only the blocks that a range touches are joined.

    Ranges are sent to the blocks where they are few, else both are shuffled. A range in one block is cut out
    of it; those over several blocks are put together after a shuffle of their bytes.
    """
    keys = ranges.columns
    last = F.greatest(F.col("offset"), F.col("offset") + F.col("length") - 1)
    ranges = cut_to_table(ranges.withColumns({"block": F.floor(F.col("offset") / BLOCK), "last": F.floor(last / BLOCK)}))
    bytes_of = blocks.select("archive", "block", "bytes")
    one = broadcast_if_small(ranges.where("block = last")).join(bytes_of, ["archive", "block"])
    one = one.select(*keys, F.substring("bytes", (F.col("offset") - F.col("block") * BLOCK + 1).cast("int"), F.col("length").cast("int")).alias("raw"))
    several = ranges.where("block < last").withColumn("block", F.explode(F.sequence("block", "last")))
    joined = broadcast_if_small(several).join(bytes_of, ["archive", "block"])
    start = F.greatest(F.lit(0).cast("long"), F.col("offset") - F.col("block") * BLOCK)
    end = F.least(F.lit(BLOCK).cast("long"), F.col("offset") + F.col("length") - F.col("block") * BLOCK)
    part = F.substring(F.col("bytes"), (start + 1).cast("int"), F.greatest(end - start, F.lit(0)).cast("int"))
    parts = F.array_sort(F.collect_list(F.struct("block", part.alias("bytes"))))
    whole = joined.groupBy(*keys).agg(parts.alias("parts"))
    return one.union(whole.select(*keys, F.expr("aggregate(parts, cast('' as binary), (a, p) -> concat(a, p.bytes))").alias("raw")))


def _parsed(df: DataFrame, schema: str, fields: list[str], parse) -> DataFrame:
    """`parse(*values)` gives rows for every row of `df`."""

    def run(batches):
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(f)).to_pylist() for f in fields]
            rows = [r for values in zip(*columns, strict=True) for r in parse(*values)]
            yield pa.RecordBatch.from_pylist(rows, schema=_arrow(schema))

    return df.select(*fields).mapInArrow(run, schema)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "int": pa.int32()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.strip().split() for x in schema.split(","))])


def members(blocks: DataFrame) -> DataFrame:
    """Stored members of all archives: archive, name, offset of the data, length."""
    sizes = blocks.where("block = 0").select("archive", "size")
    tail = F.least(F.col("size"), F.lit(22 + 20 + 0xFFFF).cast("long"))
    tails = read_ranges(blocks, sizes.select("archive", "size", (F.col("size") - tail).alias("offset"), tail.alias("length")))
    next_read = _parsed(tails, "archive string, kind string, offset long, length long", ["archive", "raw", "size"],
                        lambda a, raw, size: [dict(zip(("kind", "offset", "length"), find_directory(raw, size), strict=True), archive=a)])
    next_read = cut_to_table(next_read)
    far = read_ranges(blocks, next_read.where("kind = 'end64'").select("archive", "offset", "length"))
    far = _parsed(far, "archive string, offset long, length long", ["archive", "raw"], lambda a, raw: [dict(zip(("offset", "length"), parse_end64(raw), strict=True), archive=a)])
    directories = next_read.where("kind = 'directory'").select("archive", "offset", "length").union(far)
    listed = _parsed(read_ranges(blocks, directories), "archive string, name string, header long, length long, method int", ["archive", "raw"],
                     lambda a, raw: [{"archive": a, "name": n, "header": o, "length": s, "method": m} for n, o, s, m in parse_directory(raw)])
    headers = read_ranges(blocks, listed.where("method = 0").select("archive", "name", F.col("length").alias("size"), F.col("header").alias("offset"), F.lit(30).cast("long").alias("length")))
    return _parsed(headers, "archive string, name string, offset long, length long", ["archive", "name", "size", "offset", "raw"],
                   lambda a, name, size, at, raw: [{"archive": a, "name": name, "offset": at + 30 + sum(struct.unpack_from("<HH", raw, 26)), "length": size}])


def read_records(blocks: DataFrame) -> DataFrame:
    """All records of archives: archive, page, digest, type, refers_to, payload_bytes, payload (null in a revisit)."""
    found = cut_to_table(members(blocks))
    index = read_ranges(blocks, found.where(F.col("name") == INDEX).select("archive", "offset", "length"))
    lines = _parsed(index, "archive string, at long, length long", ["archive", "raw"],
                    lambda a, raw: [{"archive": a, "at": int(x[2]), "length": int(x[3])} for x in (line.split(" ") for line in raw.decode().splitlines())])
    data = found.where(F.col("name") == DATA).select("archive", F.col("offset").alias("start"))
    records = read_ranges(blocks, lines.join(data, "archive").select("archive", (F.col("start") + F.col("at")).alias("offset"), "length"))

    def parse(archive, raw):
        head, body = parse_record(raw)
        kind = head["warc-type"]
        digest = head["warc-payload-digest"].removeprefix("sha1:")
        if kind == "response" and sha1_base32(body) != digest:
            raise ValueError("payload differs from its digest")
        page = lambda field: head[field].removeprefix("<urn:page:").removesuffix(">") if field in head else None
        return [{"archive": archive, "page": page("warc-record-id"), "digest": digest, "type": kind, "refers_to": page("warc-refers-to"),
                 "payload_bytes": int(head["warc-payload-length"]), "payload": body if kind == "response" else None}]

    return _parsed(records, "archive string, page string, digest string, type string, refers_to string, payload_bytes long, payload binary", ["archive", "raw"], parse)


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> DataFrame:
    """Records of pages. Of equal payloads of at least `least` bytes, the one with the largest id is the response.

    Null html is an empty payload, a null url an empty one, a null id the text "" (smaller than all).
    Rows with the same id and payload are all responses where their id is the largest. Ids are numbers.
    """

    def run(batches):
        for batch in batches:
            payload = batch.column(2).cast(pa.binary()).fill_null(b"")
            raw = payload.to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), payload, pa.array([sha1_base32(p) for p in raw], pa.string())], names=["id", "url", "payload", "digest"])

    prepare(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.col(html_col).alias("html"))
    rows = rows.mapInArrow(run, "id long, url string, payload binary, digest string")
    largest = rows.where(F.length("payload") >= least).groupBy("digest").agg(F.max("id").alias("largest"), F.count("*").alias("times")).where("times > 1").select("digest", "largest")
    name = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    largest = broadcast_if_small(cut_to_table(largest))
    repeats = F.col("largest").isNotNull() & ~F.col("id").eqNullSafe(F.col("largest"))
    return rows.join(largest, "digest", "left").select(name(F.col("id")).alias("page"), "url", "payload", "digest", F.when(repeats, name(F.col("largest"))).alias("refers_to"))

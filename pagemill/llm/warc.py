"""WARC archives: writing, normalising whole-file gzip streams, reading by offset.

Some tools gzip a whole WARC file as one stream, which can only be read from its
start. The normaliser inflates such a stream once, rewrites every record as a gzip
member of its own, and a sidecar index lists each member's offset and length, so
that a reader inflates just the records it wants.

All files go through Spark's own readers and writers, so any file system that Spark
knows can hold them, tasks can be repeated, and nothing is left by lost executors. A
WARC file is a text file whose records end with an empty line; a file of members is
a text file whose lines end with the zero byte that a member under 16 MiB ends with
(the top byte of its length; a longer one is followed by an empty member, which
readers skip).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import drop_path, scratch_path, stored

#: Shorter payloads are never revisits.
LEAST_PAYLOAD = 100
#: Records of one archive; with Spark's partition size this bounds a file.
MAX_RECORDS = 100_000
#: Index rows (24 bytes each) that are sent to every executor at most.
SENT = 2_000_000
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EMPTY_MEMBER_AT = 1 << 24


def _line(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(F.regexp_replace(value, "\r", "%0D"), "\n", "%0A"), F.lit("\r\n")), F.lit(""))


def with_revisits(pages: DataFrame, *, least: int = LEAST_PAYLOAD) -> DataFrame:
    """page_id, url, body, payload_bytes, payload_digest, refers_to.

    Of payloads with equal digests and at least `least` bytes, the smallest page_id
    keeps its payload; the others refer to it. A null html is an empty payload. The
    digests that occur more than once are stored first: Spark then knows the size of
    that list, and pages are only dealt out again where it is too long to be sent.
    """
    body = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("body"))
    rows = rows.withColumn("payload_bytes", F.octet_length("body").cast("long")).withColumn("payload_digest", F.sha2("body", 256))
    first = rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("payload_digest", "first")
    joined = rows.join(stored(first, "digests"), "payload_digest", "left")
    return joined.select("page_id", "url", "body", "payload_bytes", "payload_digest", F.when(F.col("page_id") == F.col("first"), None).otherwise(F.col("first")).alias("refers_to"))


def write_monolithic(records: DataFrame, path: str) -> None:
    """Write records (see with_revisits) as WARC files that are one gzip stream each."""
    revisit = F.col("refers_to").isNotNull()
    body = F.when(revisit, F.lit(b"")).otherwise(F.col("body"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\n"),
        _line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))),
        _line("WARC-Target-URI", F.col("url")),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z\r\n"),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "payload_digest")),
        _line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        F.when(revisit, F.concat(_line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))), F.lit(f"WARC-Profile: {PROFILE}\r\n"))).otherwise(""),
        F.lit("Content-Type: text/html; charset=utf-8\r\n"),
        _line("Content-Length", F.octet_length(body).cast("string")),
        F.lit("\r\n"),
    )
    text = F.concat(head.cast("binary"), body).cast("string")
    records.select(text.alias("value")).write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", MAX_RECORDS).text(path)


def records_of(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The records of a WARC stream, each with its head, block and closing empty line."""
    held, want = bytearray(), 0
    for chunk in chunks:
        held += chunk
        while True:
            if not want:
                if (cut := held.find(END)) < 0:
                    break
                size = next((int(x[15:]) for x in bytes(held[:cut]).split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
                if size is None or not held.startswith(b"WARC/"):
                    raise ValueError("not a WARC record")
                want = cut + len(END) + size + len(END)
            if len(held) < want:
                break
            if held[want - len(END) : want] != END:
                raise ValueError("a record is longer than its Content-Length")
            yield bytes(held[:want])
            del held[:want]
            want = 0
    if held:
        raise ValueError("the archive ends within a record")


def inflated(raw: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """The content of a gzip file, one stream or many members, inflated once and in pieces."""
    view, at = memoryview(raw), 0
    while at < len(view):
        stream = zlib.decompressobj(31)
        while not stream.eof:
            if at >= len(view):
                raise ValueError("the gzip stream is cut off")
            out = stream.decompress(view[at : at + step], step * 4)
            at += min(step, len(view) - at)
            yield out
            while stream.unconsumed_tail:
                yield stream.decompress(stream.unconsumed_tail, step * 4)
        at -= len(stream.unused_data)


def member(record: bytes, level: int = 6) -> bytes:
    """The record as a gzip member that ends with a zero byte."""

    def pack(x: bytes) -> bytes:
        z = zlib.compressobj(level, zlib.DEFLATED, 31)
        return z.compress(x) + z.flush()

    return pack(record) + (pack(b"") if len(record) >= EMPTY_MEMBER_AT else b"")


def normalise(spark: SparkSession, source: str, path: str, index: str | None = None) -> None:
    """Rewrite every archive below source, one gzip stream each, as members below path/archive=NAME.

    index: where the sidecar index goes, as write_index() would write it. Offsets are
    counted while members are made: a stream is inflated once, and no member at all.
    An archive is held by one task, so it has to be under 2 GiB, as Spark's rows are.
    """
    names = ["archive", "seq", "offset", "length", "record_type", "page_id", "url", "member"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0), batch.column(1), strict=True):
                name, held, size, offset = name.as_py(), [], 0, 0
                for seq, record in enumerate(records_of(inflated(raw.as_py()))):
                    kinds, _ = _fields(record)
                    own = member(record)
                    held.append((name, seq, offset, len(own), kinds["warc-type"], _number(kinds["warc-record-id"]), kinds.get("warc-target-uri"), own[:-1]))  # the line's end adds the zero byte
                    offset += len(own)
                    size += len(own)
                    if size > 1 << 22:
                        yield out(held)
                        held, size = [], 0
                if held:
                    yield out(held)

    def out(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), types, strict=True)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source)
    name = F.regexp_extract("path", r"([^/]*?)(\.txt)?\.gz$", 1)
    members = files.select(name.alias("archive"), "content").mapInArrow(run, "archive string, seq long, offset long, length long, record_type string, page_id long, url string, member binary")
    if index:
        members = stored(members, "members")  # the archives and their index are written from it
    # The writer wants rows by archive; sorted by seq below that, they need no further sort.
    ordered = members.select("archive", "seq", "member").sortWithinPartitions("archive", "seq").select(F.col("member").cast("string").alias("value"), "archive")
    ordered.write.partitionBy("archive").option("lineSep", "\u0000").option("compression", "none").text(path)
    if index:
        written = _archives(spark, path).select(F.regexp_extract("path", r"/archive=([^/]*)/[^/]*$", 1).alias("archive"), F.col("path").alias("file"))
        members.drop("member").join(written, "archive").select("file", "seq", "offset", "length", "record_type", "page_id", "url").write.parquet(index)


def _fields(record: bytes) -> tuple[dict[str, str], memoryview]:
    cut = record.index(END)
    lines = record[:cut].decode().split("\r\n")[1:]
    return {k.lower(): v for k, v in (x.split(": ", 1) for x in lines)}, memoryview(record)[cut + len(END) : len(record) - len(END)]


def members_of(raw: memoryview) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and record of each member, empty members left out."""
    at = 0
    while at < len(raw):
        stream, end, out = zlib.decompressobj(31), at, []
        while not stream.eof:
            if end >= len(raw):
                raise ValueError("the archive ends within a member")
            out.append(stream.decompress(raw[end : end + (1 << 16)]))
            end += 1 << 16
        end = min(end, len(raw)) - len(stream.unused_data)
        if record := b"".join(out):
            yield at, end - at, record
        at = end


def _number(urn: str | None) -> int | None:
    digits = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


INDEX = "file string, seq long, offset long, length long, record_type string, page_id long, url string"
FIELDS = "file string, seq long, offset long, length long, record_type string, page_id long, url string, payload binary, payload_bytes long, payload_digest string, refers_to long"


def _batches(records: Iterator[tuple[str, int, int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    """Records (file, seq, offset, length, bytes) as rows of FIELDS; a payload that hasn't its stated digest is an error."""
    names = [x.split()[0] for x in FIELDS.split(", ")]
    types = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in FIELDS.split(", ")]
    rows, size = [], 0
    for file, seq, offset, length, record in records:
        kinds, payload = _fields(record)
        kind, stated = kinds["warc-type"], kinds["warc-payload-digest"].removeprefix("sha256:")
        response = kind == "response"
        if response and hashlib.sha256(payload).hexdigest() != stated:
            raise ValueError(f"{kinds['warc-record-id']}: the payload has another digest")
        rows.append((file, seq, offset, length, kind, _number(kinds["warc-record-id"]), kinds.get("warc-target-uri"), bytes(payload) if response else None, len(payload) if response else int(kinds["x-payload-length"]), stated, _number(kinds.get("warc-refers-to"))))
        size += len(record)
        if size > 1 << 22:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def _archives(spark: SparkSession, archives: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(archives).select("path", "content")


def read_archives(spark: SparkSession, archives: str) -> DataFrame:
    """All records of normalised archives, read one member after another: FIELDS.

    payload is null for a revisit; payload_bytes and payload_digest are those of the
    full payload.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0), batch.column(1), strict=True):
                file = name.as_py()
                yield from _batches((file, i, *x) for i, x in enumerate(members_of(memoryview(raw.as_buffer()))))

    return _archives(spark, archives).mapInArrow(run, FIELDS)


def write_index(spark: SparkSession, archives: str, path: str) -> None:
    """Write the sidecar index of normalised archives: file, seq, offset, length, record_type, page_id, url."""
    read_archives(spark, archives).select("file", "seq", "offset", "length", "record_type", "page_id", "url").write.parquet(path)


def read_records(spark: SparkSession, archives: str, index: DataFrame) -> DataFrame:
    """Only the records that rows of a sidecar index name, each inflated by itself: FIELDS.

    Up to SENT rows, the index is sent to the archives; a longer one meets them in a
    shuffle by file, which moves the archives.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw, places in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                file, view = name.as_py(), memoryview(raw.as_buffer())
                yield from _batches((file, p["seq"], p["offset"], p["length"], zlib.decompress(view[p["offset"] : p["offset"] + p["length"]], 31)) for p in places.as_py())

    places = index.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "seq"))).alias("places"))  # an archive's records are bounded
    files = _archives(spark, archives)
    places = F.broadcast(places) if index.count() <= SENT else places
    joined = files.join(places, files["path"] == places["file"]).select("file", "content", "places")
    return joined.mapInArrow(run, FIELDS)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write pages(page_id, url, html) as monolithic archives, normalise and index them, and read all records back by the index.

    One row for each row of pages. Null ids stay null; null urls have no target line;
    line breaks in a url are percent-encoded; repeated rows are records of their own; an
    empty table gives an empty result. Other columns are not read, so their names cannot
    clash. A payload, and an archive, has to be under 2 GiB.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_monolithic(with_revisits(pages), f"{path}/monolithic")
    normalise(spark, f"{path}/monolithic", f"{path}/members", f"{path}/index")
    drop_path(spark, f"{path}/monolithic")
    index = spark.read.schema(INDEX).parquet(f"{path}/index")
    return read_records(spark, f"{path}/members", index)

"""WARC archives written and read through an index of their records.

The index comes first: every record written leaves a row with its file, offset, length,
URL and digest, and nothing is ever found by scanning an archive. Each task writes files of
its own, one gzip member per record, under a name no other attempt uses, and hands its
index rows to Spark. Only rows of a finished task reach the index, so what a lost executor
left behind is named by no row and never read. To read, the selected index rows are dealt
out by file and offset and sorted; each task joins neighbouring records into one byte
range and reads that at once.

A payload that occurs again is stored once: of the rows with equal payloads the one with
the greatest key becomes a response, the others revisit it. Equal means equal SHA-1, length
and a second 64-bit hash. Digests are grouped after partial aggregation, and only groups of
several rows are joined back, so a payload shared by a third of all rows moves as one row
per task.

Defined results: a null payload is empty, and empty payloads are equal; a null key is less
than any other; where several rows tie for the greatest key, the greatest URL among them
is the response, and where those are equal too, one of the equal rows. A null URL leaves
out the target field. Repeated rows each have a record. Payloads below ``least`` bytes are
all responses. An empty table gives an empty index. Columns other than the three named are
not read. One payload is held by one task, whatever its length; files roll over at
``FILE_BYTES``.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from qaloom.lineage import scratch_path, written, written_side

FILE_BYTES = 1 << 30  # an archive file is closed once it is this long
READ_BYTES = 16 << 20  # bytes of archives that one reading task is meant to take
GAP = 64 << 10  # bytes between two records that are read and dropped rather than skipped
RANGE_BYTES = 8 << 20  # a joined range ends with the record that reaches this length
DATE = "1970-01-01T00:00:00Z"  # the tables name no time of capture

# Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"

INDEX = (
    "file string, offset long, length long, record_type string, page string, url string, "
    "payload_bytes long, payload_digest string, refers_to string"
)
RECORD = (
    "page string, url string, record_type string, refers_to string, payload_bytes long, "
    "payload_digest string, payload binary"
)
_VISIBLE = "!\"#$&'()*+,-./:;<=>?@[\\]^_`{|}~"


def shared_uri(spark: SparkSession, path: str) -> str:
    """``path`` with its scheme, so that a task opens the store that Spark means."""
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place)
    return re.sub(r"^file:/+", "file:///", place.toString())


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_id(page: str | None, url: str | None, digest: str, copy: int) -> str:
    """The same id wherever it is computed, so that a revisit can name its response."""
    name = "\n".join(("-" if v is None else "+" + v) for v in (page, url)) + f"\n{digest}\n{copy}"
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(name.encode()).digest()[:16], version=5)}>"


def record(page: str | None, url: str | None, payload: bytes | None, size: int, digest: str, copy: int, top: tuple | None) -> bytes:
    """One record; ``top`` is the page and URL of the response that it revisits, or None."""
    fields = [
        ("WARC-Type", "response" if top is None else "revisit"),
        ("WARC-Record-ID", record_id(page, url, digest, copy)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", url and quote(url, safe=_VISIBLE + "%")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Page-Id", page and quote(page, safe=_VISIBLE)),
    ]
    if top is not None:
        fields += [
            ("WARC-Profile", PROFILE),
            ("WARC-Refers-To", record_id(*top, digest, 0)),
            ("WARC-Refers-To-Target-URI", top[1] and quote(top[1], safe=_VISIBLE + "%")),
            ("Refers-To-Page-Id", top[0] and quote(top[0], safe=_VISIBLE)),
        ]
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    if top is None:
        block += payload
    fields.append(("Content-Length", str(len(block))))
    head = "".join(f"{name}: {value}\r\n" for name, value in fields if value is not None)
    return VERSION + b"\r\n" + head.encode() + b"\r\n" + block + END


def parsed(raw: bytes) -> dict:
    """Fields and payload of one record; a response's payload is held against its digest."""
    head, _, rest = raw.partition(END)
    first, *lines = head.decode().split("\r\n")
    if first.encode() != VERSION:
        raise ValueError(f"no record of {VERSION.decode()} where the index names one")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    if len(rest) != len(block) + len(END):
        raise ValueError(f"record {fields['WARC-Record-ID']} is not as long as it says")
    http, _, payload = block.partition(END)
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    response = fields["WARC-Type"] == "response"
    if response and (len(payload) != size or base32(hashlib.sha1(payload).digest()) != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    named = lambda field: unquote(fields[field]) if field in fields else None
    return {
        "page": named("Page-Id"),
        "record_type": fields["WARC-Type"],
        "refers_to": named("Refers-To-Page-Id"),
        "payload_bytes": size,
        "payload_digest": digest,
        "payload": payload if response else None,
    }


class Archive:
    """Files of one writing task, one after the other."""

    def __init__(self, folder: str, file_bytes: int):
        self.folder, self.file_bytes = folder, file_bytes
        self.out, self.name, self.at = None, None, 0

    def append(self, raw: bytes) -> tuple[str, int, int]:
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        member = packer.compress(raw) + packer.flush()
        if self.out is not None and self.at >= self.file_bytes:
            self.close()
        if self.out is None:
            self.name, self.at = f"{self.folder}/{uuid.uuid4().hex}.warc.gz", 0
            system, path = fs.FileSystem.from_uri(self.name)
            system.create_dir(path.rpartition("/")[0], recursive=True)
            self.out = system.open_output_stream(path, compression=None)
        place = self.name, self.at, len(member)
        self.out.write(member)
        self.at += len(member)
        return place

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
        self.out = None


def roles(pages: DataFrame, key: str, url: str, payload: str, least: int) -> DataFrame:
    """``page, url, payload, copies`` and the page and URL of the response to revisit.

    ``top_page``, ``top_url`` are set and ``revisits`` is true for a row that revisits.
    ``copies`` above one stands for so many equal rows: a response and its own revisits.
    """
    base = pages.select(
        F.col(key).alias("page"),
        F.col(url).cast("string").alias("url"),
        F.coalesce(F.col(payload).cast("string").cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumns({"sha": F.sha1("payload"), "check": F.xxhash64("payload"), "size": F.octet_length("payload")})
    same = ["sha", "check", "size"]
    groups = (
        base.where(F.col("size") >= least)
        .groupBy(*same, "page", "url")
        .agg(F.count("*").alias("copies"))
        .groupBy(*same)
        .agg(F.max(F.struct("page", "url", "copies")).alias("top"), F.sum("copies").alias("members"))
        .where("members > 1")
    )
    side = written_side(
        groups.select(*same, F.col("top.page").alias("top_page"), F.col("top.url").alias("top_url"), F.col("top.copies").alias("top_copies")),
        "warc-groups",
    )
    is_top = F.col("top_copies").isNotNull() & F.col("page").eqNullSafe(F.col("top_page")) & F.col("url").eqNullSafe(F.col("top_url"))
    joined = base.join(side, same, "left").withColumn("is_top", is_top)
    several = F.col("is_top") & (F.col("top_copies") > 1)
    out = joined.where(~several).withColumn("copies", F.lit(1).cast("long"))
    # Equal rows that tie for the response become one row, which is written as many times.
    if side.where("top_copies > 1").limit(1).count():
        out = out.unionByName(joined.where(several).dropDuplicates(same).withColumn("copies", F.col("top_copies")))
    return out.select(
        F.col("page").cast("string"),
        "url",
        "payload",
        "copies",
        F.col("top_page").cast("string"),
        "top_url",
        (F.col("top_copies").isNotNull() & ~F.col("is_top")).alias("revisits"),
    )


def write_archives(
    pages: DataFrame,
    folder: str,
    key: str = "page_id",
    url: str = "url",
    payload: str = "html",
    least: int = 0,
    file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Write one record per row below ``folder`` and return the index, a written table."""
    spark = pages.sparkSession
    target = shared_uri(spark, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = Archive(f"{target}/archives", file_bytes)
        try:
            for batch in batches:
                rows: list[tuple] = []
                for page, link, body, copies, top_page, top_url, revisits in zip(*(c.to_pylist() for c in batch.columns)):
                    digest = base32(hashlib.sha1(body).digest())
                    for copy in range(copies):
                        top = (top_page, top_url) if revisits else (page, link) if copy else None
                        place = archive.append(record(page, link, body, len(body), digest, copy, top))
                        kind, of = ("response", None) if top is None else ("revisit", top[0])
                        rows.append((*place, kind, page, link, len(body), digest, of))
                        if len(rows) == 1000:
                            yield table_of(rows)
                            rows = []
                if rows:
                    yield table_of(rows)
        finally:
            archive.close()

    index = roles(pages, key, url, payload, least).mapInArrow(run, INDEX)
    return written(index, "warc-index", f"{folder.rstrip('/')}/index")


def table_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), kinds)], names=[c.split()[0] for c in INDEX.split(", ")])


def ranges(places: list[tuple[str, int, int]], gap: int = GAP, range_bytes: int = RANGE_BYTES) -> Iterator[tuple[str, int, int, list[int]]]:
    """File, start, end and members of the byte ranges that cover sorted records."""
    start, stop, members = 0, 0, []
    for i, (file, offset, length) in enumerate(places):
        if members and (file != places[members[0]][0] or offset - stop > gap or stop - start >= range_bytes):
            yield places[members[0]][0], start, stop, members
            members = []
        if not members:
            start = stop = offset
        members.append(i)
        stop = max(stop, offset + length)
    if members:
        yield places[members[0]][0], start, stop, members


def read_records(index: DataFrame, payloads: bool = True, read_bytes: int = READ_BYTES, gap: int = GAP) -> DataFrame:
    """The records that the rows of ``index`` name, which may be any selection of an index.

    Without ``payloads`` the payload column is null; it is read and checked all the same.
    """
    total = index.agg(F.sum("length")).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, source = None, None
        for batch in batches:
            places = list(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))))
            for file, start, stop, members in ranges(places, gap):
                if file != opened:
                    if source is not None:
                        source.close()
                    system, path = fs.FileSystem.from_uri(file)
                    opened, source = file, system.open_input_file(path)
                data = source.read_at(stop - start, start)
                rows = []
                for i in members:
                    _, offset, length = places[i]
                    row = parsed(zlib.decompress(data[offset - start : offset - start + length], 31))
                    row["url"] = batch.column("url")[i].as_py()
                    row["payload"] = row["payload"] if payloads else None
                    rows.append(row)
                kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
                names = [c.split()[0] for c in RECORD.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, kinds)], names)
        if source is not None:
            source.close()

    dealt = index.select("file", "offset", "length", "url").repartitionByRange(max(1, -(-total // read_bytes)), "file", "offset")
    return dealt.sortWithinPartitions("file", "offset").mapInArrow(run, RECORD)


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 0, folder: str | None = None) -> DataFrame:
    """Archive every row and report each record as it was read back."""
    spark = pages.sparkSession
    kind = pages.schema[key].dataType
    index = write_archives(pages, folder or scratch_path(spark, "warc"), key, url, payload, least)
    return read_records(index, payloads=False).select(
        F.col("page").cast(kind).alias(key),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
    )

"""Web archives (WARC) with dictionary compression: writing, reading back, restoring payloads.

Rows are dealt by their payload's digest and size and sorted, so the first of each payload (largest page id) becomes the
response and the rest refer to it; payloads move once, in the shuffle that also deals records to archives.  Payloads are counted
first, with map-side combination: one with more than a thousandth of all copies is dealt over salts, its response being
known from the count.  There are fewer than a thousand such payloads, a bound that makes them safe to broadcast.

Each task writes archives of bounded size.  It gathers the first records up to ``SAMPLE_BYTES``, builds a Zstandard dictionary
from them, embeds it in a leading skippable frame (magic 0x184D2A5D) and compresses every record, those first ones included,
as a frame of its own.  Records too few to train on make a dictionary of their plain bytes.  An archive starts with a
``warcinfo`` record, so any reader of dictionary-compressed archives can open it on its own.  File names hold the attempt of the
task; which archives count is decided by the table of archives, written through Spark's own commit, so the files of a
lost or repeated attempt are never read.

Reading takes that table only for the paths: dictionary, frames and header fields are parsed from the files, payloads are
checked against their digests, and a file is streamed with one record in memory.  A ``revisit`` record has the headers of
the page (with the full length) and refers to the response; ``restore`` joins the payload back.

Compression and file systems are loaded where they are used, in tasks: the driver needs neither.

Archives go to a folder that all executors reach (any file system that Arrow can open).

Defined cases: a null payload is empty and comes back empty; empty payloads are copies of each other; payloads below
``least`` bytes are all responses; equal payloads of one page id keep one response, the others refer to that page; a null
page id comes after all others, ties go to the larger url; rows that repeat everything are records of their own (only those
equal to the response of a hot payload in id and url meet in one task, as a stream); an empty table writes no archive; other
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from switchyard.llm.common import arrow_pass, partitions
from switchyard.session import scratch_path, shared_dir

#: Magic number of the skippable frame that holds the dictionary (fixed value of the archive format).
DICTIONARY_FRAME = 0x184D2A5D
#: Bytes of records that the dictionary of an archive is built from, and the dictionary's size.
SAMPLE_BYTES, DICTIONARY_BYTES = 4 << 20, 112 << 10
#: Bytes (compressed) at which a task begins its next archive.
ARCHIVE_BYTES = 1 << 30
LEVEL = 3
#: A payload with more than 1 / HOT of all rows is salted.
HOT, SALTS = 1000, 64
READ_BYTES = 1 << 20
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"  # pages hold no time of capture


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Date", DATE), *fields, ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def record_id(page_id: int | None, digest: str, place: str = "") -> str:
    """``place`` tells records apart that are not the response of their payload."""
    return f"<urn:page:{'null' if page_id is None else page_id}:{digest}{place and ':' + place}>"


def page_of(urn: str) -> int | None:
    name = urn.strip("<>").split(":")[2]
    return None if name == "null" else int(name)


def page_record(page_id: int | None, url: str | None, payload: bytes, place: str, refers_to: tuple[int | None, str | None] | None) -> bytes:
    """A response, or a revisit of the response of ``refers_to`` (page id, url)."""
    address = lambda u: quote(u or "", safe=":/?#[]@!$&'()*+,;=%-._~")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    digest = payload_digest(payload)
    fields = [
        ("WARC-Record-ID", record_id(page_id, digest, place)), ("WARC-Target-URI", address(url)),
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response"),
    ]
    if refers_to is None:
        return record_bytes("response", fields, http + payload)
    fields += [
        ("WARC-Profile", SAME_PAYLOAD), ("WARC-Refers-To", record_id(refers_to[0], digest)),
        ("WARC-Refers-To-Target-URI", address(refers_to[1])), ("WARC-Refers-To-Date", DATE), ("WARC-Truncated", "length"),
    ]
    return record_bytes("revisit", fields, http)


def build_dictionary(records: list[bytes]) -> bytes:
    """A trained dictionary, or plain bytes of the records if they are too few or too small to train on."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, records).as_bytes()
    except zstandard.ZstdError:
        return b"".join(records)[-DICTIONARY_BYTES:]


class Archive:
    """Writes one archive to a stream: dictionary frame first, then a frame per record."""

    def __init__(self, out):
        self.out, self.size, self.records = out, 0, 0
        self.first: list[bytes] = [record_bytes("warcinfo", [
            ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("Content-Type", "application/warc-fields"),
        ], b"format: WARC File Format 1.1\r\n")]
        self.held = 0
        self.compressor = None  # there once the dictionary is written

    def add(self, record: bytes) -> None:
        self.records += 1
        if self.compressor is not None:
            self._write(self.compressor.compress(record))
            return
        self.first.append(record)
        self.held += len(record)
        if self.held >= SAMPLE_BYTES:
            self._begin()

    def close(self) -> None:
        if self.compressor is None:
            self._begin()

    def _begin(self) -> None:
        import zstandard

        data = build_dictionary(self.first)
        self._write(struct.pack("<II", DICTIONARY_FRAME, len(data)) + data)
        shared = zstandard.ZstdCompressionDict(data)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_checksum=True, write_content_size=True)
        for record in self.first:
            self._write(self.compressor.compress(record))
        self.first.clear()

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)


def read_records(stream) -> Iterator[bytes]:
    """The records of an archive, one in memory at a time."""
    import zstandard

    magic, size = struct.unpack("<II", stream.read(8))
    if magic != DICTIONARY_FRAME:
        raise ValueError("the archive does not begin with a dictionary")
    opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(stream.read(size)))
    rest = stream.read(READ_BYTES)
    while rest:
        frame, parts = opener.decompressobj(), []
        while not frame.eof:
            if not rest:
                raise ValueError("the archive ends inside a record")
            parts.append(frame.decompress(rest))
            rest = frame.unused_data if frame.eof else stream.read(READ_BYTES)
        rest = rest or stream.read(READ_BYTES)
        yield b"".join(parts)


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and block."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines[1:])}
    return fields, rest[: int(fields["content-length"])]


def dealt_by_payload(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", least: int = 0) -> DataFrame:
    """page_id, url, payload (binary, null: empty), same, salt, ref_id, ref_url; copies together and in order.

    With salt 0 the first row of a payload is its response; above 0 (hot payloads) a row refers to ref_id; below 0 it is
    too small to refer to anything.
    """
    shared_dir(pages.sparkSession)
    body = F.coalesce(F.col(f"`{payload}`").cast("binary"), F.lit(b""))
    rows = pages.select(
        F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), body.alias("payload"),
    ).withColumn("same", F.concat(F.sha2("payload", 256), F.lit(":"), F.octet_length("payload").cast("string")))
    small = F.octet_length("payload") < least
    counted = rows.where(~small).groupBy("same").agg(F.count(F.lit(1)).alias("_n"), F.max(F.struct("page_id", "url")).alias("_first"))
    copied = counted.where("_n > 1").checkpoint()
    total = copied.agg(F.sum("_n")).first()[0] or 0
    hot = copied.where(F.col("_n") > total / HOT).select(F.col("same").alias("_same"), "_first")  # fewer than HOT rows
    joined = rows.join(F.broadcast(hot), F.col("same") == F.col("_same"), "left")
    first = F.col("page_id").eqNullSafe(F.col("_first.page_id")) & F.col("url").eqNullSafe(F.col("_first.url"))
    spread = F.monotonically_increasing_id() % SALTS  # any value is right
    salt = F.when(small, -1 - spread).when(F.col("_same").isNull() | first, F.lit(0)).otherwise(1 + spread)
    named = joined.select(
        "page_id", "url", "payload", "same", salt.cast("int").alias("salt"),
        F.col("_first.page_id").alias("ref_id"), F.col("_first.url").alias("ref_url"),
    )
    sorted_by = ["same", "salt", F.col("page_id").desc_nulls_last(), F.col("url").desc_nulls_last()]
    return named.repartition(partitions(pages.sparkSession), "same", "salt").sortWithinPartitions(*sorted_by)


def write_archives(
    pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", payload: str = "html", least: int = 0,
    archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Write archives below ``folder`` and return the table of archives (path, records, bytes), which is kept there too."""
    spark = pages.sparkSession
    target = full_uri(spark, folder)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(target)
        store.create_dir(f"{base}/archives", recursive=True)
        task = TaskContext.get()
        written, out, archive, path = 0, None, None, ""
        same, owner, nth = None, None, 0

        def end() -> pa.RecordBatch:
            archive.close()
            out.close()
            return pa.RecordBatch.from_pylist([{"path": path, "records": archive.records, "bytes": archive.size}])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if archive is None:
                    path = f"archives/pages-{task.partitionId():06d}-{written:04d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.zst"
                    out = store.open_output_stream(f"{base}/{path}", compression=None)
                    archive, written = Archive(out), written + 1
                page, address, body, key, salt, *refers_to = row
                place, nth = f"{task.partitionId()}.{nth}", nth + 1
                if salt == 0 and key != same:
                    same, owner, place, refers_to = key, (page, address), "", None
                elif salt <= 0:
                    refers_to = None if salt else owner
                archive.add(page_record(page, address, body, place, refers_to))
                if archive.size >= archive_bytes:
                    yield end()
                    archive = None
        if archive is not None:
            yield end()

    listed = arrow_pass(dealt_by_payload(pages, page_id, url, payload, least), work, "path string, records long, bytes long")
    listed.write.parquet(f"{target}/table")
    return spark.read.parquet(f"{target}/table")


def full_uri(spark: SparkSession, folder: str) -> str:
    """``folder`` with its scheme, as Spark resolves it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def read_archives(archives: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page record, from the files alone.

    ``payloads`` adds payload (null in a revisit) and record_id and refers_to_id, which name records.
    """
    target = full_uri(archives.sparkSession, folder)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(target)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                with store.open_input_stream(f"{base}/{path}", compression=None) as stream:
                    for record in read_records(stream):
                        fields, block = parse(record)
                        if fields["warc-type"] == "warcinfo":
                            continue
                        row = page_row(fields, block)
                        rows.append(row if payloads else row[:5])
                        held += len(block) if payloads else 0
                        if len(rows) == 4096 or held >= READ_BYTES:
                            yield as_batch(rows)
                            rows, held = [], 0
                if rows:
                    yield as_batch(rows)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    dealt = archives.select("path").repartition(partitions(archives.sparkSession), "path")
    return arrow_pass(dealt, work, schema + (", payload binary, record_id string, refers_to_id string" if payloads else ""))


COLUMNS = [
    ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
    ("refers_to", pa.int64()), ("payload", pa.binary()), ("record_id", pa.string()), ("refers_to_id", pa.string()),
]


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = COLUMNS[: len(rows[0])]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, (_, t) in zip(zip(*rows), columns)], names=[n for n, _ in columns])


def page_row(fields: dict[str, str], block: bytes) -> tuple:
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(line for line in http.decode().split("\r\n") if line.lower().startswith("content-length:")).split(":")[1])
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    kind = fields["warc-type"]
    if kind == "response" and (len(payload) != size or payload_digest(payload) != digest):
        raise ValueError(f"record {fields['warc-record-id']} does not hold what its digest says")
    refers = fields.get("warc-refers-to")
    return (
        page_of(fields["warc-record-id"]), size, digest, kind, page_of(refers) if refers else None,
        payload if kind == "response" else None, fields["warc-record-id"], refers,
    )


def restore(archives: DataFrame, folder: str) -> DataFrame:
    """page_id and payload of every record; revisits get the payload of the record they refer to."""
    rows = read_archives(archives, folder, payloads=True)
    responses = rows.where("record_type = 'response'")
    revisits = rows.where("record_type = 'revisit'").select("page_id", "refers_to_id")
    held = responses.select(F.col("record_id").alias("refers_to_id"), "payload")
    return responses.select("page_id", "payload").unionByName(revisits.join(held, "refers_to_id").select("page_id", "payload"))


def round_trip(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", least: int = 0) -> DataFrame:
    """Write archives into the shared folder and read them back."""
    folder = scratch_path(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder, page_id, url, payload, least), folder)

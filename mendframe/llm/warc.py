"""WARC archives compressed per record with an embedded Zstandard dictionary.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the
dictionary, itself compressed, followed by one Zstandard frame per record.  The
dictionary is trained on records of the same archive: an even choice of about
`SAMPLE_BYTES` bytes of them, the first `SAMPLE_PIECE` bytes of each (documented
bounds of the training only; every record is written whole).

Records with equal payloads become one `response`, that with the smallest id,
and `revisit` records that refer to it.  Which one that is comes from a narrow
aggregate over digests; rows meet it in an ordinary join whose hot digests AQE
splits.  A task buffers one archive at most and rolls at `ARCHIVE_BYTES`.

Recovery: rows are sorted within a partition and archives are named by partition
and number, so a repeated task writes the same files again; each is written under
another name and then moved, so a reader never sees half of one.

Cases: a NULL payload is an empty one, a NULL address is left out, a NULL id is
larger than any other, rows that repeat the smallest id are all responses, an
empty table makes no archive and reads back as no record.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mendframe.llm.common import batches_of
from mendframe.session import materialize, new_path

# Fixed values of the formats.
SKIPPABLE_MAGIC = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"

ARCHIVE_BYTES = 32 << 20
DICTIONARY_BYTES = 64 << 10
SAMPLE_BYTES = 4 << 20
SAMPLE_PIECE = 128 << 10
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"

RECORDS = "page_id long, target_uri string, record_type string, refers_to long, payload_bytes long, payload_digest string"


def _record(page_id, url, payload: bytes, sha: str, first) -> bytes:
    """One WARC record; `first` is the id of the response that a revisit refers to."""
    digest = base64.b32encode(bytes.fromhex(sha)).decode()
    head = HTTP_HEAD % len(payload)
    block = head if first is not None else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if first is None else 'revisit'}",
        f"WARC-Record-ID: <urn:x-page:{'null' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if first is not None:
        lines += [f"WARC-Refers-To: <urn:x-page:{first}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _dictionary(records: list[bytes], size: int, sample_bytes: int):
    """A trained dictionary, or the first records themselves where there are too few to train on."""
    import zstandard

    total = sum(map(len, records))
    step = max(1, -(-total // sample_bytes))
    samples = [r[:SAMPLE_PIECE] for r in records[::step]]
    try:
        return zstandard.train_dictionary(size, samples, k=512, d=8)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[:size], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def pack_archive(records: list[bytes], level: int = LEVEL, size: int = DICTIONARY_BYTES, sample_bytes: int = SAMPLE_BYTES) -> bytes:
    """One archive: the dictionary's frame, then a frame per record."""
    import zstandard

    trained = _dictionary(records, size, sample_bytes)
    held = zstandard.ZstdCompressor(level=level).compress(trained.as_bytes())
    packer = zstandard.ZstdCompressor(level=level, dict_data=trained)
    return b"".join([struct.pack("<II", SKIPPABLE_MAGIC, len(held)), held, *map(packer.compress, records)])


def unpack_archive(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, block) of each record of an archive."""
    import zstandard

    magic, size = struct.unpack_from("<II", content)
    if magic != SKIPPABLE_MAGIC:
        raise ValueError("the archive does not start with a dictionary frame")
    trained = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(content[8 : 8 + size]))
    frames = memoryview(content)[8 + size :]
    source = io.BufferedReader(zstandard.ZstdDecompressor(dict_data=trained).stream_reader(frames, read_across_frames=True), 1 << 16)
    while source.readline():  # WARC/1.1
        header = {}
        while line := source.readline().rstrip(b"\r\n"):
            name, _, value = line.decode().partition(": ")
            header[name] = value
        block = source.read(int(header["Content-Length"]))
        source.read(4)
        yield header, block


def write_archives(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload: Column | None = None,
    min_revisit_bytes: int = 0,
    archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Write `pages` as archives under `folder`; returns (archive, records, bytes), already stored."""
    body = F.encode(F.coalesce(F.col("html") if payload is None else payload, F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    firsts = (
        rows.where(F.col("size") >= min_revisit_bytes)
        .groupBy(F.col("sha").alias("_sha"), F.col("size").alias("_size"))
        .agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 AND first IS NOT NULL")
        .select("_sha", "_size", "first")
    )
    firsts = materialize(firsts, "warc-firsts")  # a table of its own size: broadcast if small, else hot digests are split
    linked = rows.join(firsts, (F.col("sha") == F.col("_sha")) & (F.col("size") == F.col("_size")), "left")
    linked = linked.withColumn("first", F.when(~F.col("first").eqNullSafe(F.col("id")), F.col("first")))
    linked = linked.select("id", "url", "payload", "sha", "first").sortWithinPartitions("id", "sha", "url")

    def write(batches):
        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        store, top = fs.FileSystem.from_uri(folder)
        store.create_dir(top, recursive=True)
        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def roll():
            nonlocal number, held, size
            packed = pack_archive(held)
            name = f"part-{part:06d}-{number:05d}.warc.zst"
            draft = f"{top}/.{name}.{uuid.uuid4().hex}"
            with store.open_output_stream(draft) as out:
                out.write(packed)
            store.move(draft, f"{top}/{name}")
            row = pa.RecordBatch.from_pydict({"archive": [name], "records": [len(held)], "bytes": [len(packed)]})
            number, held, size = number + 1, [], 0
            return row

        for rows in batches_of(batches):
            for record in map(_record, rows["id"], rows["url"], rows["payload"], rows["sha"], rows["first"]):
                held.append(record)
                size += len(record)
                if size >= archive_bytes:
                    yield roll()
        if held:
            yield roll()

    return materialize(linked.mapInArrow(write, "archive string, records long, bytes long"), "warc-manifest")


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The records of all archives under `folder`; a response's digest and length are checked against its payload."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.warc.zst").load(folder).select("path", "content")

    def identity(urn: str) -> int | None:
        name = urn.removesuffix(">").rpartition(":")[2]
        return None if name == "null" else int(name)

    def parse(batches):
        import pyarrow as pa

        columns = [x.partition(" ")[0] for x in RECORDS.split(", ")]
        types = [pa.int64() if x.endswith("long") else pa.string() for x in RECORDS.split(", ")]
        schema = pa.schema(list(zip(columns, types, strict=True)))
        for files_ in batches_of(batches, 1):
            rows = []
            for header, block in unpack_archive(files_["content"][0]):
                digest = header["WARC-Payload-Digest"].removeprefix("sha1:")
                length = int(header["WARC-Payload-Length"])
                if header["WARC-Type"] == "response":
                    body = block[block.index(b"\r\n\r\n") + 4 :]
                    if len(body) != length or base64.b32encode(hashlib.sha1(body).digest()).decode() != digest:
                        raise ValueError(f"damaged record in {files_['path'][0]}")
                refers = header.get("WARC-Refers-To")
                rows.append((identity(header["WARC-Record-ID"]), header.get("WARC-Target-URI"), header["WARC-Type"], refers and identity(refers), length, digest))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], schema=schema)

    return files.mapInArrow(parse, RECORDS)


def archive_pages(spark: SparkSession, pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Write all pages as archives and read the records back."""
    folder = folder or new_path(spark, "warc")
    manifest = write_archives(pages, folder, **options)
    return read_archives(spark, folder) if manifest.head(1) else spark.createDataFrame([], RECORDS)

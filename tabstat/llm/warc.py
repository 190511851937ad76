"""Operator 2: WARC archives with a two-level capture index.

Writing. Every page is one record, compressed as a gzip member of its own.
Of pages with equal payloads of REVISIT_LEAST bytes or more, the one with the
largest page_id is a ``response`` and the others are ``revisit`` records
without payload that refer to it; shorter payloads are always ``response``.
Payloads are compared by length and digest in a narrow table, and the HTML is
shuffled once, by page, to meet that table. Members go out through Spark's
text writer, byte for byte, to any file system Spark writes to.

Index. The archives are read back member by member. Every capture gives a
line: its key (reversed host, path, page_id), file, offset and length. Lines
are range-partitioned and sorted by key into shards, cut into compressed
blocks of BLOCK_LINES lines (second level), and a sparse directory keeps the
first key of every block (first level) by shard.

Lookup. A key finds its shard by binary search over the shards' first keys
(one for about SHARD_LINES captures, the only thing sent to all tasks), its
block by binary search in the shard's directory, its line by binary search in
the decompressed block; then its bytes are read by range. Lookups meet their
shard in one group of bounded size, and range reads are sorted by file and
offset.

Defined results: null html is the empty payload; a null url has an empty key
before its page_id; rows with a null page_id are ``response`` records; of
repeated rows with the largest page_id each is a response; other columns are
not read; an empty table gives an empty result. Range reads use pyarrow's file
systems, so the shared folder must be one of those (file, hdfs, s3, gs).
"""

from __future__ import annotations


import math
import string
import uuid
import zlib
from bisect import bisect_left, bisect_right
from urllib.parse import quote, urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabstat.llm.common import prepare, written
from tabstat.session import checkpoint_dir

REVISIT_LEAST = 1000
#: Records of one archive file, lines of a block, captures of a shard.
FILE_RECORDS, BLOCK_LINES, SHARD_LINES = 4_000, 256, 50_000
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_PLAIN = string.ascii_letters + string.digits + string.punctuation
#: An empty gzip member; it ends in a zero byte.
_EMPTY = zlib.compressobj(9, zlib.DEFLATED, 31).flush()


def target(url: str | None) -> str:
    """The URL as one header value: spaces, controls and non-ASCII quoted."""
    return quote(url or "", safe=_PLAIN)


def capture_key(uri: str, page_id) -> str:
    """Reversed host, port, path and query, then the page_id."""
    try:
        parts = urlsplit(uri)
        host = ",".join(reversed((parts.hostname or "").split(".")))
        if parts.port:
            host += f":{parts.port}"
        key = f"{host}){parts.path or '/'}{'?' + parts.query if parts.query else ''}" if host else uri
    except ValueError:
        key = uri
    return f"{key} {page_id if page_id is not None else ''}"


def member(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One record as a gzip member that ends in a zero byte.

    The last byte of a member is the top byte of the record's length, zero
    below 16 MiB; a longer record is followed by an empty member.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {target(url)}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    out = packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()
    return out if out[-1] == 0 else out + _EMPTY


def read_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one decompressed record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[:int(fields["Content-Length"])]


def members(data: bytes, step: int = 1 << 14):
    """(offset, length, record) of every gzip member of an archive; an empty
    member belongs to the record before it."""
    at, view = 0, memoryview(data)
    held = None
    while at < len(data):
        inflate, start, out = zlib.decompressobj(31), at, []
        while not inflate.eof:
            chunk = view[at:at + step]
            if not len(chunk):
                raise ValueError("archive ends inside a member")
            out.append(inflate.decompress(chunk))
            at += len(chunk) - len(inflate.unused_data)
        raw = b"".join(out)
        if raw:
            if held:
                yield held
            held = (start, at - start, raw)
        else:
            held = (held[0], at - held[0], held[2])
    if held:
        yield held


def _page(urn: str | None) -> str | None:
    return urn[len("<urn:page:"):-1] or None if urn else None


def write_archives(pages: DataFrame) -> str:
    """Write all pages; the folder of the archives."""
    spark = pages.sparkSession
    prepare(spark)
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    pages = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    narrow = pages.select("page_id", "digest", F.octet_length("payload").alias("n")).where(F.col("n") >= REVISIT_LEAST)
    kept = narrow.groupBy("digest", "n").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    revisits = narrow.join(kept, ["digest", "n"]).where("page_id < refers_to").select("page_id", "digest", "refers_to").distinct()
    records = pages.join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "payload", "digest", "refers_to")

    def run(batches):
        for batch in batches:
            out = [member(*row)[:-1] for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to")))]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])

    folder = f"{checkpoint_dir(spark).rstrip('/')}/llm-warc-{uuid.uuid4().hex}"
    (records.mapInArrow(run, "member binary").select(F.col("member").cast("string").alias("value"))
     .write.option("lineSep", "\0").option("maxRecordsPerFile", FILE_RECORDS).text(folder))  # the last, zero byte is the separator
    return folder


def captures(spark: SparkSession, folder: str) -> DataFrame:
    """(key, file, offset, length) of every record in the archives."""
    def run(batches):
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content")):
                rows = []
                for offset, length, raw in members(data.as_py()):
                    fields, _ = read_record(raw)
                    rows.append((capture_key(fields.get("WARC-Target-URI", ""), _page(fields["WARC-Record-ID"])), path.rsplit("/", 1)[1], offset, length))
                columns = zip(*rows) if rows else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()))], ["key", "file", "offset", "length"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "content")
    return files.mapInArrow(run, "key string, file string, offset long, length long")


def build_index(lines: DataFrame, n: int) -> DataFrame:
    """(shard, block, first_key, lines binary): sorted, compressed blocks.

    The first three columns are the sparse directory.
    """
    from pyspark import TaskContext

    spark = lines.sparkSession
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / SHARD_LINES))

    def run(batches):
        shard, block, held = TaskContext.get().partitionId(), 0, []

        def close(rows):
            data = zlib.compress("\n".join("\t".join(map(str, r)) for r in rows).encode())
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([rows[0][0]]), pa.array([data], pa.binary())], ["shard", "block", "first_key", "lines"])

        for batch in batches:
            held += zip(*(c.to_pylist() for c in batch.columns))
            while len(held) >= BLOCK_LINES:
                yield close(held[:BLOCK_LINES])
                held, block = held[BLOCK_LINES:], block + 1
        if held:
            yield close(held)

    ordered = lines.select("key", "file", "offset", "length").repartitionByRange(shards, "key").sortWithinPartitions("key", "file", "offset")
    return written(ordered.mapInArrow(run, "shard int, block int, first_key string, lines binary"), "index")


def _search(requests: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
    """Lines of a shard whose keys are asked for."""
    blocks = blocks.sort_values("block")
    first, data = blocks["first_key"].tolist(), blocks["lines"].tolist()
    opened, lines = -1, []
    keys: list[str] = []
    out = []
    for key in sorted(set(requests["key"])):
        at = max(0, bisect_left(first, key) - 1)  # equal keys may begin in the block before
        while at < len(first) and first[at] <= key:
            if at != opened:
                lines = [line.split("\t") for line in zlib.decompress(data[at]).decode().split("\n")]
                keys, opened = [line[0] for line in lines], at
            out += lines[bisect_left(keys, key):bisect_right(keys, key)]
            at += 1
    found = pd.DataFrame(out, columns=["key", "file", "offset", "length"])
    return found.astype({"offset": "int64", "length": "int64"})


def locate(requests: DataFrame, index: DataFrame) -> DataFrame:
    """(key, file, offset, length) of all captures with the requested keys."""
    prepare(index.sparkSession)
    shards = sorted((r.first_key, r.shard) for r in index.groupBy("shard").agg(F.min("first_key").alias("first_key")).collect())
    bounds = index.sparkSession.sparkContext.broadcast(shards)

    def run(batches):
        first, numbers = [s[0] for s in bounds.value], [s[1] for s in bounds.value]
        for batch in batches:
            keys, at = [], []
            for key in batch.column("key").to_pylist():
                # the shard that may hold it; range partitions never part equal keys
                k = bisect_right(first, key) - 1
                if k >= 0:
                    keys.append(key)
                    at.append(numbers[k])
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(keys, pa.string())], ["shard", "key"])

    asked = requests.select("key").distinct().mapInArrow(run, "shard int, key string")
    return asked.groupBy("shard").cogroup(index.groupBy("shard")).applyInPandas(_search, "key string, file string, offset long, length long")


def fetch(located: DataFrame, folder: str) -> DataFrame:
    """Records read by range: (page_id, url, record_type, refers_to, digest, payload)."""
    prepare(located.sparkSession)
    names = ["page_id", "url", "record_type", "refers_to", "digest", "payload"]

    def run(batches):
        from pyarrow.fs import FileSystem

        base = folder if "://" in folder else folder.replace("file:/", "file:///", 1)
        system, path = FileSystem.from_uri(base) if ":" in base else FileSystem.from_uri("file://" + base)
        name, stream = None, None
        for batch in batches:
            out = []
            for file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))):
                if file != name:
                    name, stream = file, system.open_input_file(f"{path}/{file}")
                fields, block = read_record(next(members(stream.read_at(length, offset)))[2])
                revisit = fields["WARC-Type"] == "revisit"
                out.append((_page(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), fields["WARC-Type"], _page(fields.get("WARC-Refers-To")),
                            fields["WARC-Payload-Digest"].removeprefix("sha1:"), None if revisit else block.partition(b"\r\n\r\n")[2]))
                if len(out) >= 256:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.string()] * 5 + [pa.binary()])], names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.string()] * 5 + [pa.binary()])], names)

    ordered = located.repartition("file").sortWithinPartitions("file", "offset").select("file", "offset", "length")
    return ordered.mapInArrow(run, "page_id string, url string, record_type string, refers_to string, digest string, payload binary")


def requests_of(pages: DataFrame) -> DataFrame:
    """(key) of every page."""
    def run(batches):
        for batch in batches:
            keys = [capture_key(target(u), p) for p, u in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string())], ["key"])

    prepare(pages.sparkSession)
    return pages.select("page_id", "url").mapInArrow(run, "key string")


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Write all pages, index the archives, and read every page back.

    (page_id, payload_bytes, payload_digest, record_type, refers_to); length
    and digest of a revisit's payload are those of the record it refers to.
    """
    spark, kind = pages.sparkSession, pages.schema["page_id"].dataType
    folder = write_archives(pages)
    lines = written(captures(spark, folder), "captures")
    index = build_index(lines, lines.count())
    read = fetch(locate(requests_of(pages), index), folder).select(
        F.col("page_id").cast(kind).alias("page_id"), "record_type", F.col("refers_to").cast(kind).alias("refers_to"), "digest",
        F.octet_length("payload").cast("long").alias("n"), F.sha1("payload").alias("own"))
    read = written(read, "records")  # read by range once; small rows
    full = read.where("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), F.col("own").alias("digest")).agg(F.max("n").alias("full"))
    revisits = read.where("record_type = 'revisit'").join(full, ["refers_to", "digest"]).select("page_id", F.col("full").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")
    return read.where("record_type = 'response'").select("page_id", F.col("n").alias("payload_bytes"), F.col("own").alias("payload_digest"), "record_type", "refers_to").unionByName(revisits)

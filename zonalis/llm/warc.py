"""WARC archives and a two-level capture index over them.

Archives are written by Spark's text sink, so its commit protocol covers lost executors: every record is a gzip
member of its own. The sink ends each line with a separator; the last byte of a gzip member is the high byte of
its length, zero for every member under 16 MiB, and serves as that separator. A larger record is followed by an
empty member, which ends in zero as well.

The index sorts captures by reversed-host URL key into compressed blocks and keeps one directory line per block.
A lookup reads the directory alone, deals its keys to the shards, finds their blocks by binary search, then reads and
unpacks only these blocks, finds the lines by binary search again and reads the records' byte ranges.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import re
import zlib
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonalis.llm.words import map_texts
from zonalis.runtime import broadcast_if_small, cut, fresh_path, shuffle_partitions

#: Payloads shorter than this are never revisits.
LEAST_REVISIT = 100
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ONE_MEMBER = 1 << 24
BLOCK_LINES = 512


def surt(url: str | None) -> str:
    """Sort-friendly key: host labels reversed, then path and query; scheme, user, port and fragment go."""
    if not url:
        return ""
    try:
        parts = urlsplit(url if "//" in url else "//" + url)
        host = (parts.hostname or "").lower()
    except ValueError:
        return re.sub(r"\s", "%20", url)
    key = ",".join(reversed(host.split("."))) + ")" + (parts.path or "/") + ("?" + parts.query if parts.query else "")
    return re.sub(r"\s", "%20", key)


def capture_key(url: str | None, page_id: int | None) -> str:
    """The index key: surt() of the URL; a record without one stands under its own number."""
    return surt(url) or f"urn,page){'' if page_id is None else page_id}"


def _header_value(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, first_url: str | None, date: str) -> bytes:
    """One WARC record; a revisit of ``first`` where that is given, else a response."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if first is not None else http + payload
    lines = ["WARC/1.1", "WARC-Type: " + ("response" if first is None else "revisit"), f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + _header_value(url))
    lines.append("WARC-Payload-Digest: sha256:" + digest)
    if first is not None:
        lines += ["WARC-Profile: " + REVISIT_PROFILE, f"WARC-Refers-To: <urn:page:{first}>"]
        if first_url is not None:
            lines.append("WARC-Refers-To-Target-URI: " + _header_value(first_url))
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(raw: bytes) -> bytes:
    """The gzip member(s) of a record, less the zero byte that the sink's separator supplies."""
    packed = gzip.compress(raw, 6, mtime=0)
    if packed[-1]:
        packed += gzip.compress(b"", mtime=0)
    return packed[:-1]


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST_REVISIT, date: str = "2024-01-01T00:00:00Z", records_per_file: int = 20_000) -> str:
    """Writes a record for every row to gzip-member WARC files under ``path``.

    NULL html is the empty payload. Of rows with equal payloads of ``least`` bytes or more, those with the
    smallest id are responses and the rest revisit them; a NULL id is never the smallest. Other columns are
    ignored.
    """
    row = pages.select(F.col(f"`{page_id}`").cast("bigint").alias("page_id"), F.col(f"`{url}`").alias("url"), F.coalesce(F.col(f"`{html}`"), F.lit("")).alias("html"))
    row = row.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256)).withColumn("long", F.octet_length("html") >= least)
    firsts = row.where("long and page_id is not null").groupBy("digest").agg(F.min(F.struct("page_id", "url")).alias("first"))
    typed = row.join(firsts.select(F.col("digest").alias("of"), "first"), F.when(F.col("long"), F.col("digest")) == F.col("of"), "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    typed = typed.select("page_id", "url", "html", "digest", F.when(revisit, F.col("first.page_id")).alias("first"), F.when(revisit, F.col("first.url")).alias("first_url"))

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        out = [_member(record(p, u, h.encode("utf-8", "surrogatepass"), d, f, fu, date)) for p, u, h, d, f, fu in zip(*columns)]
        return pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    records = map_texts(typed, one, "record binary", "html").select(F.col("record").cast("string").alias("value"))
    records.write.option("lineSep", "\x00").option("maxRecordsPerFile", records_per_file).text(path)
    return path


def _members(stream):
    """Offset, length and bytes of each non-empty gzip member of a file, read piece by piece."""
    at, held, ended = 0, b"", False
    while True:
        inflate, size, out = zlib.decompressobj(31), 0, []
        while not inflate.eof:
            if not held and not ended:
                held = stream.read(1 << 16)
                ended = not held
            if not held:
                break
            out.append(inflate.decompress(held))
            size += len(held) - len(inflate.unused_data)
            held = inflate.unused_data
        if not size:
            return
        raw = b"".join(out)
        if raw:
            yield at, size, raw
        at += size


def _open(uri: str):
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", re.sub("^file:/+", "file:///", uri)))
    return store.open_input_file(inner)


def parse(raw: bytes) -> dict:
    """Headers and payload of one unpacked record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:]:
        name, _, value = line.partition(": ")
        fields[name.lower()] = value
    block = rest[: int(fields.get("content-length", 0))]
    _, _, payload = block.partition(b"\r\n\r\n")
    number = lambda v: int(v[len("<urn:page:") : -1]) if v and v != "<urn:page:>" else None
    return {
        "page_id": number(fields.get("warc-record-id")), "type": fields["warc-type"], "url": fields.get("warc-target-uri"),
        "digest": fields.get("warc-payload-digest", "").removeprefix("sha256:"), "refers_to": number(fields.get("warc-refers-to")),
        "refers_url": fields.get("warc-refers-to-target-uri"), "payload": payload,
    }


CAPTURE = "page_id bigint, type string, url string, digest string, refers_to bigint, refers_url string, payload_bytes bigint, payload_digest string, file string, offset bigint, length bigint, surt string"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record: headers, payload size and digest as read, and where it stands (file, offset, length).

    ``payload_bytes`` and ``payload_digest`` are NULL for revisits, which carry no payload. Spark lists the files and
    deals them to tasks; a task reads its files as streams and holds one record and up to 2,000 result rows.
    """
    names = [f.split(" ")[0] for f in CAPTURE.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = {"bigint": pa.int64(), "string": pa.string()}
        types = [kinds[f.split(" ")[1]] for f in CAPTURE.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    def run(batches):
        for batch in batches:
            for file in batch.column(0).to_pylist():
                rows = []
                with _open(file) as stream:
                    for offset, length, raw in _members(stream):
                        r = parse(raw)
                        full = r["type"] == "response"
                        rows.append((r["page_id"], r["type"], r["url"], r["digest"], r["refers_to"], r["refers_url"], len(r["payload"]) if full else None, hashlib.sha256(r["payload"]).hexdigest() if full else None, file, offset, length, capture_key(r["url"], r["page_id"])))
                        if len(rows) == 2000:
                            yield batch_of(rows)
                            rows = []
                if rows:
                    yield batch_of(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("path")
    return files.repartition(shuffle_partitions(spark), "path").mapInArrow(run, CAPTURE)


def build_index(captures: DataFrame, path: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Writes the index of ``captures(surt, page_id, type, digest, file, offset, length)`` and returns its blocks.

    Range partitioning on key, file and offset splits even a single URL's captures over shards. A block row has
    its shard, first and last key and the packed lines; all but the lines make the sparse directory. The table is
    partitioned by shard, so a lookup that needs few blocks reads few shards.
    """

    def run(batches):
        held: list[str] = []
        keys: list[str] = []
        number = 0

        def flush():
            nonlocal held, keys, number
            packed = zlib.compress("\n".join(held).encode("utf-8", "surrogatepass"))
            out = pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([keys[0]]), pa.array([keys[-1]]), pa.array([len(keys)], pa.int64()), pa.array([packed])], names=["block", "first_key", "last_key", "n", "lines"])
            held, keys, number = [], [], number + 1
            return out

        for batch in batches:
            for key, *rest in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
                keys.append(key)
                held.append("\t".join([key, *("" if x is None else str(x) for x in rest)]))
                if len(held) == block_lines:
                    yield flush()
        if held:
            yield flush()

    order = ["surt", "file", "offset"]
    lines = captures.select("surt", *LINE).repartitionByRange(shuffle_partitions(captures.sparkSession), *order).sortWithinPartitions(*order)
    blocks = lines.mapInArrow(run, BLOCK).withColumn("shard", F.spark_partition_id())
    blocks.write.partitionBy("shard").parquet(path)
    return captures.sparkSession.read.schema(BLOCK + ", shard int").parquet(path)


#: A capture's line in the index after its key, and a block's row.
LINE = ["page_id", "type", "digest", "file", "offset", "length"]
BLOCK = "block bigint, first_key string, last_key string, n bigint, lines binary"
FOUND = "key string, page_id bigint, type string, digest string, file string, offset bigint, length bigint"
#: Wanted blocks, of some 50 bytes each and their keys, go to every task up to so many.
BROADCAST_BLOCKS = 10_000


def lookup(index: DataFrame, keys: DataFrame) -> DataFrame:
    """Captures of each distinct ``keys(key)``: ``(key, page_id, type, digest, file, offset, length)``.

    Shard bounds, one row per shard, go to the driver and out to the tasks; a key goes to every shard whose
    range holds it, so a URL that spans shards is found whole. A shard's task holds its directory lines and the keys
    of its range, and finds blocks by binary search. Only then are the wanted blocks joined with their packed lines.
    """
    directory = index.select("shard", "block", "first_key", "last_key")
    bounds = [(r["shard"], r["lo"], r["hi"]) for r in directory.groupBy("shard").agg(F.min("first_key").alias("lo"), F.max("last_key").alias("hi")).orderBy("lo", "shard").collect()]
    lows = [b[1] for b in bounds]

    @F.pandas_udf("array<int>")
    def shards(key: pd.Series) -> pd.Series:
        out = []
        for k in key:
            found, i = [], bisect.bisect_right(lows, k) - 1
            while i >= 0 and bounds[i][2] >= k:
                found.append(bounds[i][0])
                i -= 1
            out.append(found)
        return pd.Series(out)

    def search(blocks: pa.Table, wanted: pa.Table) -> pa.Table:
        blocks = blocks.sort_by("block")
        first, last, number = (blocks.column(c).to_pylist() for c in ("first_key", "last_key", "block"))
        shard = blocks.column("shard")[0].as_py() if number else None
        rows = []
        for key in sorted(wanted.column("key").to_pylist()):
            # Blocks stand in order of their first keys, and so of their last ones.
            i = bisect.bisect_left(last, key)
            while i < len(first) and first[i] <= key:
                rows.append((shard, number[i], key))
                i += 1
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ([], [], []), (pa.int32(), pa.int64(), pa.string()))], names=["shard", "block", "key"])

    def unpack(batches):
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        for batch in batches:
            for lines, wanted in zip(batch.column(0), batch.column(1).to_pylist()):
                opened = [x.split("\t") for x in zlib.decompress(lines.as_py()).decode("utf-8", "surrogatepass").split("\n")]
                heads = [x[0] for x in opened]
                rows = [(k, int(p) if p else None, t, d, f, int(o), int(n)) for key in wanted for k, p, t, d, f, o, n in opened[bisect.bisect_left(heads, key) : bisect.bisect_right(heads, key)]]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[f.split(" ")[0] for f in FOUND.split(", ")])

    dealt = keys.select("key").distinct().withColumn("shard", F.explode(shards("key")))
    places = directory.groupBy("shard").cogroup(dealt.groupBy("shard")).applyInArrow(search, "shard int, block bigint, key string")
    # A block has block_lines lines, so its list of keys is bounded.
    wanted = cut(places.groupBy("shard", "block").agg(F.collect_list("key").alias("keys")))
    blocks = index.select("shard", "block", "lines").join(broadcast_if_small(wanted, BROADCAST_BLOCKS), ["shard", "block"])
    return blocks.select("lines", "keys").mapInArrow(unpack, FOUND)


def fetch(found: DataFrame) -> DataFrame:
    """Reads the byte range of every ``found(page_id, file, offset, length)`` and returns the record's payload size and
    digest as read."""

    def run(batches):
        name, stream = None, None
        for batch in batches:
            rows = []
            for page, file, offset, length in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if file != name:
                    if stream is not None:
                        stream.close()
                    name, stream = file, _open(file)
                stream.seek(offset)
                payload = parse(zlib.decompress(stream.read(length), 31))["payload"]
                rows.append((page, len(payload), hashlib.sha256(payload).hexdigest()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string()))], names=["page_id", "payload_bytes", "payload_digest"])

    placed = found.select("page_id", "file", "offset", "length").repartition(F.col("file"), F.floor(F.col("offset") / (1 << 22)))
    return placed.sortWithinPartitions("file", "offset").mapInArrow(run, "page_id bigint, payload_bytes bigint, payload_digest string")


def archive_and_read(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes ``pages`` as WARC, reads the archives back and resolves revisits through the index.

    ``(page_id, payload_bytes, payload_digest, record_type, refers_to, file, offset, length)`` per row of
    ``pages``. A revisit's size and digest are those of the response record of the page it refers to that has the
    digest in the revisit's header; it is found by its URL key, read as a byte range, and its digest as read must be
    that of the header (else both are NULL). So a page_id that occurs with several payloads does no harm, whichever of
    them are revisits. An empty table gives no rows.
    """
    spark = pages.sparkSession
    root = path or fresh_path(spark, "warc")
    write_archives(pages, f"{root}/archive")
    captures = cut(read_archives(spark, f"{root}/archive"))
    index = build_index(captures, f"{root}/index")
    revisits = captures.where("type = 'revisit'")

    @F.pandas_udf("string")
    def key_of(url: pd.Series, page_id: pd.Series) -> pd.Series:
        return pd.Series([capture_key(u, p) for u, p in zip(url, page_id)], dtype="object")

    targets = cut(revisits.select("refers_to", "refers_url", "digest").distinct().withColumn("key", key_of("refers_url", "refers_to")))
    wanted = targets.select("key", F.col("refers_to").alias("page_id"), "digest")
    found = lookup(index, targets).where("type = 'response'").join(wanted, ["key", "page_id", "digest"], "left_semi").dropDuplicates(["page_id", "digest"])
    read = fetch(found).withColumnsRenamed({"page_id": "refers_to", "payload_bytes": "b", "payload_digest": "digest"})
    resolved = revisits.join(read, ["refers_to", "digest"], "left").withColumns({"payload_bytes": F.col("b"), "payload_digest": F.when(F.col("b").isNotNull(), F.col("digest"))}).drop("b")
    every = captures.where("type <> 'revisit'").unionByName(resolved)
    return every.select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to", "file", "offset", "length")


ORACLE = """
with p as (
  select page_id, coalesce(html, '') as payload from pages
), d as (
  select page_id, strlen(payload)::bigint as payload_bytes, sha256(payload) as payload_digest from p
), f as (
  select *, min(page_id) over (partition by payload_digest) as first_id from d
)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 100 and page_id <> first_id then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 100 and page_id <> first_id then first_id end as refers_to from f
"""

"""Deterministic sharded WARC writer, and the reader that proves it.

Records are dealt to shards by ranges of page id. The ranges come from a histogram of payload bytes over at
most ``BLOCKS`` equal id blocks, so the same input gives the same shards whatever the number of tasks.
Within a shard records are sorted and written as gzip members; a new file begins when the compressed
size reaches ``roll_bytes``. Headers, record ids and digests are made anew from the rows.

A task writes under a temporary name of its own and returns a manifest row per file; the manifest
is a Spark table, so of repeated attempts exactly one is in it. Files are then renamed to their final names
from the manifest (repeatable: a file already renamed is left), and the committed manifest is written last.

Of records with equal payloads of at least ``revisit_bytes`` bytes, that with the largest page id is a
response and the others are revisits without payload.

Rows: a null html is an empty payload, a null url gets a urn of the page id. Rows that share a page id are all
written; those with the largest id of a payload are all responses. A null page id is written before
all others, as a response. An empty table gives an empty manifest. Extra columns are not read.
"""
from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from prosopo.session import cut_lineage, new_folder

BLOCKS = 4096
SHARD_BYTES = 16 << 20      #: payload bytes of a shard
ROLL_BYTES = 64 << 20       #: compressed bytes after which a file ends
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"   #: the capture date written, as the rows have none
MANIFEST = "shard long, part long, temp string, name string, records long, bytes long, sha256 string"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")   # fixed value: the URL name space of RFC 4122


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode().rstrip("=")


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers: int | None, date: str = DATE) -> bytes:
    """One WARC/1.1 record; a revisit holds the HTTP header alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers is not None else http + payload
    name = lambda p, d: f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{p} {d}')}>"
    target = quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url else f"urn:page:{page}"
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: {name(page, digest)}", f"WARC-Date: {date}",
            f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32(hashlib.sha1(block).digest())}"]
    if refers is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers, digest)}", f"X-Refers-To-Page: {refers}"]
    head += [f"X-Page: {'' if page is None else page}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class ShardFile:
    """A file being written under a temporary name."""

    def __init__(self, folder: str, shard: int, part: int):
        from pyarrow import fs
        self.store, path = fs.FileSystem.from_uri(folder)
        self.store.create_dir(path, recursive=True)
        self.shard, self.part, self.records, self.bytes, self.sum = shard, part, 0, 0, hashlib.sha256()
        self.name = f"shard-{shard:08d}-{part:05d}.warc.gz"
        self.temp = f"{self.name}.{uuid.uuid4().hex}.tmp"
        self.out = self.store.open_output_stream(f"{path}/{self.temp}")

    def add(self, data: bytes, level: int) -> None:
        z = zlib.compressobj(level, zlib.DEFLATED, 31)
        member = z.compress(data) + z.flush()
        self.out.write(member)
        self.sum.update(member)
        self.records, self.bytes = self.records + 1, self.bytes + len(member)

    def close(self) -> tuple:
        self.out.close()
        return self.shard, self.part, self.temp, self.name, self.records, self.bytes, self.sum.hexdigest()


def roles(pages: DataFrame, revisit_bytes: int) -> DataFrame:
    """(page_id, digest, refers_to) of the revisits; digests alone are shuffled."""
    small = pages.select("page_id", "digest").where(F.col("size") >= revisit_bytes)
    shared = small.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return small.join(shared, "digest").where("page_id < refers_to").select("page_id", "digest", "refers_to").distinct()


def shards(pages: DataFrame, shard_bytes: int) -> tuple[int, int, list[tuple[int, int]]]:
    """(smallest id, block width, [(block, shard)]) from the bounded histogram."""
    low, high = pages.agg(F.min("page_id"), F.max("page_id")).first()
    if low is None:
        return 0, 1, []
    width = (high - low) // BLOCKS + 1
    sizes = pages.where("page_id is not null").groupBy(F.floor((F.col("page_id") - low) / width).alias("block")).agg(F.sum("size").alias("bytes")).collect()
    out, shard, filled = [], 0, 0
    for block, size in sorted(tuple(r) for r in sizes):
        if filled and filled + size > shard_bytes:
            shard, filled = shard + 1, 0
        out.append((block, shard))
        filled += size
    return low, width, out


def write(table: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, level: int = LEVEL,
          revisit_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes (page id, url, html) rows under ``folder`` and returns the committed manifest, one row per file."""
    spark = table.sparkSession
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    pages = table.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"),
                         F.octet_length(html).cast("long").alias("size"), F.sha1(html.cast("binary")).alias("digest"))
    low, width, dealt = shards(pages.select("page_id", "size"), shard_bytes)
    # at most BLOCKS rows, so the broadcast is bounded
    where = F.broadcast(spark.createDataFrame(dealt, "block long, shard long"))
    both = pages.select("page_id", "url", "html", "digest", F.lit(None).cast("long").alias("refers_to")).unionByName(
        roles(pages, revisit_bytes), allowMissingColumns=True)
    rows = (both.withColumn("block", F.floor((F.col("page_id") - low) / width)).join(where, "block", "left")
            .select(F.coalesce("shard", F.lit(-1).cast("long")).alias("shard"), "page_id", "digest", "refers_to", "url", "html")
            .repartitionById(dealt[-1][1] + 1 if dealt else 1, F.col("shard").cast("int")).sortWithinPartitions("shard", "page_id", "digest", F.col("refers_to").desc_nulls_last(), "url"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, done = None, []
        role: tuple | None = None
        for batch in batches:
            for shard, page, digest, refers, url, text in zip(*(c.to_pylist() for c in batch.columns)):
                if refers is not None:      # stands before the pages it is about
                    role = (page, digest, refers)
                    continue
                if out and (out.shard != shard or out.bytes >= roll_bytes):
                    done.append(out.close())
                    part = out.part + 1 if out.shard == shard else 0
                    out = ShardFile(folder, shard, part)
                elif not out:
                    out = ShardFile(folder, shard, 0)
                out.add(record(page, url, text.encode(), base32(bytes.fromhex(digest)), role[2] if role and role[:2] == (page, digest) else None), level)
        if out:
            done.append(out.close())
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate(
            (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()))],
            ["shard", "part", "temp", "name", "records", "bytes", "sha256"])

    def commit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        store, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for temp, name in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if store.get_file_info(f"{path}/{temp}").type == fs.FileType.File:
                    store.move(f"{path}/{temp}", f"{path}/{name}")
                elif store.get_file_info(f"{path}/{name}").type != fs.FileType.File:
                    raise FileNotFoundError(f"{folder}/{temp}")
            yield batch

    manifest = cut_lineage(rows.mapInArrow(run, MANIFEST), "warc-manifest")
    return cut_lineage(manifest.mapInArrow(commit, MANIFEST), "warc-committed")


def members(stream, piece: int = 1 << 16) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    z, out = zlib.decompressobj(31), []
    while data := stream.read(piece):
        while data:
            out.append(z.decompress(data))
            data = z.unused_data
            if z.eof:
                yield b"".join(out)
                z, out = zlib.decompressobj(31), []
    if out and any(out):
        raise ValueError("the file ends within a record")


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per record of the committed files; every digest is recomputed, a wrong one is an error."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        store, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, records in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                rows = []
                with store.open_input_stream(f"{path}/{name}", compression=None) as f:
                    for data in members(f):
                        head, _, rest = data.partition(b"\r\n\r\n")
                        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
                        block = rest[:int(fields["Content-Length"])]
                        http, _, payload = block.partition(b"\r\n\r\n")
                        length = int(http.decode().lower().split("content-length: ")[1].split("\r\n")[0])
                        kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        if fields["WARC-Block-Digest"] != "sha1:" + base32(hashlib.sha1(block).digest()) or rest[len(block):] != b"\r\n\r\n" or (
                                kind == "response" and (digest != base32(hashlib.sha1(payload).digest()) or length != len(payload))):
                            raise ValueError(f"{name}: {fields['WARC-Record-ID']} is damaged")
                        refers = fields.get("X-Refers-To-Page")
                        rows.append((int(p) if (p := fields["X-Page"]) else None, length, digest, kind, int(refers) if refers else None))
                if len(rows) != records:
                    raise ValueError(f"{name}: {len(rows)} of {records} records")
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(
                    (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return manifest.repartition(max(1, manifest.count()), "shard", "part").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(spark: SparkSession, pages: DataFrame, **options) -> DataFrame:
    """Writes the archives to the shared folder and reads them back."""
    folder = new_folder(spark, "warc")
    return read(write(pages, folder, **options), folder)

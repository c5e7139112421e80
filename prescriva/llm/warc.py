"""A deterministic sharded WARC writer and its reader (operator 9).

Rows are dealt to shards by ranges of page_id (``ranges``: by exact sums, not by a sample)
and sorted; a task writes gzip members, one
for each record, and begins a new file when the compressed size of the present one has
reached ``roll_bytes``. Headers and digests are made anew from the payload. Of the
records with equal payloads of at least ``min_payload`` bytes, the one with the largest
page_id is a response and the others are revisits of it; record ids are derived from
page_id and dates are a parameter, so that the same rows give the same bytes.

A file is written under a temporary name of its own and renamed when complete; a task
then reports it with its size and digest, and these reports are the manifest, a table
beside the files. A file that the manifest does not name (of a task that was lost) is
not part of the archive.

The winner of each payload comes from a group-by on the digest (partly summed before the
shuffle), and digests that occur more than once are joined back to narrow rows alone;
these travel among the pages by page_id, so that a payload is shuffled once, and one
that a third of all pages share is never gathered in one place.

Defined results: a null html is an empty payload; null urls give an empty target;
pages with equal page_id are all written, in the order of url and html, and the first
with the winning page_id is the response, the others revisit it; a null page_id counts
as smaller than all others; an empty table gives an empty archive.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prescriva.llm import ranges, shared

REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed: WARC 1.1
MANIFEST = "shard int, part int, file string, records long, bytes long, sha256 string"
PAGE_COLUMNS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, intact boolean"


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int | None, twin: int) -> str:
    """Derived from the page alone; rows that share a page_id are numbered."""
    return f"<urn:x-page:{'none' if page_id is None else page_id}{f':{twin}' if twin else ''}>"


def _target(url: str | None) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "")


def record(page_id: int | None, twin: int, url: str | None, payload: bytes, digest: str, refers_to: tuple[str, str | None] | None, date: str) -> bytes:
    """One WARC record; ``refers_to``: record id and url of the response. A revisit has the HTTP head alone; the payload's length and digest stay those of the full payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to else head + payload
    fields = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to else 'response'}",
        f"WARC-Record-ID: {_record_id(page_id, twin)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_target(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{_digest(block)}",
    ]
    if refers_to:
        id_, uri = refers_to
        fields += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {id_}", f"WARC-Refers-To-Target-URI: {_target(uri)}", f"WARC-Refers-To-Date: {date}", "WARC-Truncated: length"]
    fields += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Roller:
    """Writes records to files of one shard and begins a new one by compressed size."""

    def __init__(self, directory: str, shard: int, roll_bytes: int, level: int, date: str):
        self.fs, self.path = shared.store(directory)
        self.fs.create_dir(self.path, recursive=True)
        self.shard, self.roll_bytes, self.level, self.date = shard, roll_bytes, level, date
        self.part, self.out = 0, None

    def add(self, data: bytes) -> tuple | None:
        """Writes a record; the report of the file before it, if that was full."""
        done = self.close() if self.out and self.size >= self.roll_bytes else None
        if not self.out:
            self.temporary = f"{self.path}/_tmp.{uuid.uuid4().hex}"
            self.out, self.size, self.records, self.sha = self.fs.open_output_stream(self.temporary, compression=None), 0, 0, hashlib.sha256()
            self._write(self._info())
        self._write(data)
        self.records += 1
        return done

    def _info(self) -> bytes:
        body = b"format: WARC File Format 1.1\r\n"
        name = self._name()
        return f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:x-file:{name}>\r\nWARC-Date: {self.date}\r\nWARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"

    def _name(self) -> str:
        return f"pages-{self.shard:07d}-{self.part:05d}.warc.gz"

    def _write(self, data: bytes) -> None:
        z = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        member = z.compress(data) + z.flush()
        self.out.write(member)
        self.sha.update(member)
        self.size += len(member)

    def close(self) -> tuple | None:
        if not self.out:
            return None
        self.out.close()
        name = self._name()
        shared.commit(self.fs, self.temporary, f"{self.path}/{name}")
        done = (self.shard, self.part, name, self.records, self.size, self.sha.hexdigest())
        self.out, self.part = None, self.part + 1
        return done


def payload_facts(pages: DataFrame) -> DataFrame:
    """(page_id, url, digest, payload_bytes) for each row; the payload itself goes no further."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    return pages.select("page_id", "url", F.sha1(payload).alias("digest"), F.octet_length(payload).alias("payload_bytes"))


def winners(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """Payloads that several rows share: digest -> the largest page_id, and the first of its urls. Summed before its shuffle, so no payload is hot."""
    facts = payload_facts(pages).where(F.col("payload_bytes") >= min_payload)
    # Of equal page_ids, the first in the order of writing is the response.
    first = facts.groupBy("digest", "page_id").agg(F.min(F.struct(F.col("url").isNotNull(), "url")).getField("url").alias("url"), F.count(F.lit(1)).alias("n"))
    return first.groupBy("digest").agg(F.max_by(F.struct("page_id", "url"), "page_id").alias("top"), F.sum("n").alias("copies")).where("copies > 1").select("digest", F.col("top.page_id").alias("winner"), F.col("top.url").alias("winner_url"))


def write_warc(pages: DataFrame, directory: str, min_payload: int = 0, roll_bytes: int = 64 << 20, level: int = 6, date: str = "2024-01-01T00:00:00Z", shard_bytes: int = ranges.LEAST) -> DataFrame:
    """Write ``pages`` (page_id, url, html) below ``directory``; returns the manifest, one row per file."""
    spark = pages.sparkSession
    shared.small_batches(spark)
    archive = f"{directory}/archive"
    facts = payload_facts(pages).select("page_id", "digest").distinct()
    same = shared.written(facts.join(winners(pages, min_payload), "digest").select("page_id", "digest", "winner", "winner_url"), "copies")
    # What is known of a page comes just before its rows: narrow rows among the pages, so that payloads are shuffled once.
    none = F.lit(None)
    known = same.select("page_id", F.lit(0).alias("kind"), F.col("winner_url").alias("url"), none.cast("string").alias("html"), "digest", "winner")
    rows = pages.select("page_id", F.lit(1).alias("kind"), "url", "html", none.cast("string").alias("digest"), none.cast("long").alias("winner"))
    # Shards are ranges of page_id by exact sums of bytes, so that the same pages give the same files.
    points = ranges.split_points(pages, "page_id", F.coalesce(F.octet_length("html"), F.lit(0)) + 512, shard_bytes)
    both = known.union(rows).withColumn("shard", ranges.range_of("page_id", points))
    ordered = both.repartitionById(len(points) + 1, F.col("shard")).sortWithinPartitions("shard", "page_id", "kind", "url", "html")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, done, last, twin, winners_of, responded = None, [], object(), 0, {}, {}
        for batch in batches:
            htmls = pc.fill_null(batch.column("html"), "").cast(pa.binary()).to_pylist()
            names = ("shard", "page_id", "kind", "url", "digest", "winner")
            for shard, page_id, kind, url, known, winner, payload in zip(*(batch.column(c).to_pylist() for c in names), htmls, strict=True):
                if roller is None or shard != roller.shard:
                    done.append(roller and roller.close())
                    roller = _Roller(archive, shard, roll_bytes, level, date)
                if page_id != last:
                    last, twin, winners_of, responded = page_id, 0, {}, {}
                if kind == 0:
                    winners_of[known] = (winner, url)
                    continue
                sha, refers_to = hashlib.sha1(payload), None
                if sha.hexdigest() in winners_of:
                    winner, winner_url = winners_of[sha.hexdigest()]
                    if page_id != winner:
                        refers_to = (_record_id(winner, 0), winner_url)
                    else:
                        refers_to = responded.get(sha.digest())
                        responded.setdefault(sha.digest(), (_record_id(page_id, twin), url))
                done.append(roller.add(record(page_id, twin, url, payload, base64.b32encode(sha.digest()).decode(), refers_to, date)))
                twin += 1
        done = [x for x in [*done, roller and roller.close()] if x]
        if done:
            columns = list(zip(*done, strict=True))
            types = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["shard", "part", "file", "records", "bytes", "sha256"])

    with shared.step(spark):
        ordered.mapInArrow(write, MANIFEST).write.parquet(f"{directory}/manifest")
    shared.drop_table(same)
    shared.remove_unfinished(archive)
    return spark.read.schema(MANIFEST).parquet(f"{directory}/manifest")


def members(stream, size: int = 1 << 20) -> Iterator[bytes]:
    """The decompressed gzip members of a file, one at a time."""
    z, parts, rest = zlib.decompressobj(31), [], b""
    while data := rest or stream.read(size):
        parts.append(z.decompress(data))
        rest = b""
        if z.eof:
            rest = z.unused_data
            yield b"".join(parts)
            z, parts = zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("the file ends in the middle of a record")


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (small letters) and block of a record."""
    head, _, rest = member.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    fields = {k.lower(): v for k, v in fields.items()}
    return fields, rest[: int(fields["content-length"])]


def _page_of(record_id: str) -> int | None:
    value = record_id.removeprefix("<urn:x-page:").removesuffix(">").split(":")[0]
    return None if value == "none" else int(value)


def read_warc(spark: SparkSession, directory: str) -> DataFrame:
    """Per page record of the files that the manifest names; ``intact``: its digests are those of what was read."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{directory}/manifest")
    archive = f"{directory}/archive"

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
        names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "intact"]
        for batch in batches:
            for file in batch.column("file").to_pylist():
                fs, path = shared.store(archive)
                rows = []
                with fs.open_input_stream(f"{path}/{file}", compression=None) as stream:
                    for member in members(stream):
                        fields, block = parse(member)
                        if fields["warc-type"] == "warcinfo":
                            continue
                        head, _, payload = block.partition(b"\r\n\r\n")
                        length = int(head.decode().rpartition("Content-Length: ")[2])
                        digest = fields["warc-payload-digest"].removeprefix("sha1:")
                        whole = fields["warc-type"] == "revisit" or (len(payload) == length and _digest(payload) == digest)
                        whole = whole and fields["warc-block-digest"] == "sha1:" + _digest(block)
                        refers = fields.get("warc-refers-to")
                        rows.append((_page_of(fields["warc-record-id"]), fields["warc-target-uri"], fields["warc-type"], _page_of(refers) if refers else None, length, digest, whole))
                        if len(rows) == 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    files = max(1, manifest.count())
    return manifest.select("file").repartition(files).mapInArrow(read, PAGE_COLUMNS)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``pages`` written as WARC records and read back."""
    directory = shared.shared_dir(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), directory)
    back = read_warc(spark, directory)
    checked = F.when(F.col("intact"), F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("damaged record of page "), F.col("page_id").cast("string"))))
    return back.select("page_id", "payload_bytes", checked.alias("payload_digest"), "record_type", "refers_to")
